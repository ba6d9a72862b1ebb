"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained together in numpy."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_slices, lower_ascii, utf8

SIZES = (3, 4, 5, 6)  # bytes of an n-gram, the marks at both ends of a word included
BUCKETS = 1 << 18
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def subwords(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: which positions of a lower-cased buffer begin an n-gram, and the bucket of each position.

    Everything but letters, digits and bytes from 128 is a mark; an n-gram may have a mark at its ends only. A buffer begins and ends with a mark.
    """
    word = WORD_BYTE[data]
    byte = np.where(word, data, 0).astype(np.uint32)
    code = byte * np.uint32(0x01000193) + np.uint32(0x811C9DC5)
    inner = np.ones(len(data), bool)
    for n in range(2, max(SIZES) + 1):
        size = len(data) - n + 1
        if size <= 0:
            return
        code = (code[:size] ^ byte[n - 1:]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
        if n > 2:
            inner = inner[:size] & word[n - 2:n - 2 + size]
        if n in SIZES:
            yield inner[:size], (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 18)


class ToxicityModel:
    """P(toxic) of a word: softmax of a linear layer on the mean of its subword vectors. A text is as toxic as its most toxic word."""

    def __init__(self, docs: list[bytes], labels: list[int], width: int = 8, epochs: int = 2, rounds: int = 8, hard: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
        self.layer = rng.normal(0, 0.1, (width, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.slope, self.shift = 1.0, 0.0
        self.sums = [np.zeros(self.vectors.shape, np.float32), np.zeros(self.layer.shape, np.float32), np.zeros(2, np.float32)]
        y = np.array(labels, np.int64)
        if len(docs) and 0 < y.sum() < len(y):
            self.fit(docs, y, epochs, rounds, hard, rng)
        else:
            self.slope, self.shift = 0.0, (4.0 if y.all() else -4.0) if len(docs) else 0.0
        self.fold()

    def fold(self) -> None:
        """The layer applied to each bucket: means of vectors and of these numbers give the same score."""
        self.weight = (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)
        self.offset = float(self.bias[1] - self.bias[0])
        del self.vectors, self.sums

    def fit(self, docs: list[bytes], y: np.ndarray, epochs: int, rounds: int, hard: int, rng: np.random.Generator) -> None:
        types: dict[bytes, int] = {}
        bags = [np.array(sorted({types.setdefault(w, len(types)) for w in WORDS.findall(d.lower())}), np.int64) for d in docs]
        flat, sizes = np.concatenate(bags), np.array([len(b) for b in bags])
        doc = np.repeat(np.arange(len(bags)), sizes)
        grams, first = type_buckets(list(types))
        toxic = np.bincount(flat, weights=y[doc], minlength=len(types))
        clean = np.bincount(flat, weights=1 - y[doc], minlength=len(types))
        prior = y.mean()
        self.train(grams, first, toxic, clean * (prior / (1 - prior)), 1, rng)  # first each word has the labels of its texts
        full = doc_of(sizes)
        for _ in range(rounds):  # then a toxic text vouches for its most toxic word, a clean text against its `hard` most toxic ones; some others join in
            order, begin = self.ranked(flat, sizes, grams, first)
            pull = np.bincount(flat[order[begin[y[full] == 1]]], minlength=len(types)).astype(float)
            near = np.arange(len(order)) - np.repeat(begin, sizes[full]) < hard
            against = near & (y[doc[order]] == 0) | (rng.random(len(order)) < 0.05) & (y[doc[order]] == 0)
            push = np.bincount(flat[order[against]], minlength=len(types)).astype(float)
            self.train(grams, first, pull, push, epochs, rng)
        order, begin = self.ranked(flat, sizes, grams, first)
        value = np.full(len(bags), -10.0)
        value[full] = self.values(grams, first)[flat[order[begin]]]
        self.calibrate(value, y)

    def values(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        each = (self.vectors @ (self.layer[:, 1] - self.layer[:, 0]))[grams]
        return np.add.reduceat(each, first) / np.diff(np.append(first, len(grams))) + self.bias[1] - self.bias[0]

    def ranked(self, flat: np.ndarray, sizes: np.ndarray, grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `flat`, each text's words from the most toxic one on, and where each text with a word begins."""
        value = self.values(grams, first)[flat]
        full = sizes[sizes > 0]
        return np.lexsort((-value, np.repeat(np.arange(len(full)), full))), np.cumsum(full) - full

    def train(self, grams: np.ndarray, first: np.ndarray, pull: np.ndarray, push: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 0.3, step: int = 4096) -> None:
        """AdaGrad on the cross entropy of all words, weighted by how often they count for either class."""
        ends = np.append(first[1:], len(grams))
        some = np.flatnonzero(pull + push > 0)
        for _ in range(epochs):
            rng.shuffle(some)
            for lo in range(0, len(some), step):
                own = some[lo:lo + step]
                counts = ends[own] - first[own]
                at = np.cumsum(counts) - counts
                rows = grams[np.repeat(first[own] - at, counts) + np.arange(int(counts.sum()))]
                hidden = np.add.reduceat(self.vectors[rows], at, axis=0) / counts[:, None]
                logits = hidden @ self.layer + self.bias
                share = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -30, 30)))
                wrong = np.clip((pull[own] + push[own]) * share - pull[own], -20, 20)
                wrong = np.stack([-wrong, wrong], axis=1).astype(np.float32)
                back = (wrong @ self.layer.T) / counts[:, None]
                order = np.argsort(rows, kind="stable")
                new = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0))
                change = np.add.reduceat(np.repeat(back, counts, axis=0)[order], new, axis=0)
                self.move(self.vectors, 0, rows[order][new], change, rate)
                self.move(self.layer, 1, slice(None), hidden.T @ wrong / len(own), rate * 0.3)
                self.move(self.bias, 2, slice(None), wrong.mean(axis=0), rate * 0.3)

    def move(self, what: np.ndarray, k: int, rows, change: np.ndarray, rate: float) -> None:
        self.sums[k][rows] += change * change
        what[rows] -= rate * change / np.sqrt(self.sums[k][rows] + 1e-4)

    def calibrate(self, value: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the labels on the texts' values, with a slight pull to even odds."""
        value = np.clip(value, -30, 30)
        x = np.stack([value, np.ones(len(value))], axis=1)
        w = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - y) + 1e-2 * w)
        self.slope, self.shift = float(w[0]), float(w[1])

    def score(self, column) -> np.ndarray:
        """Score of each text from 0 to 1."""
        data, offsets = utf8(column)
        value = np.full(len(offsets) - 1, -10.0)
        for lo, hi in doc_slices(offsets):
            own = lower_ascii(data[offsets[lo]:offsets[hi]])
            at = offsets[lo:hi + 1] - offsets[lo]
            own = np.insert(own, at, 32)  # a mark before each text and after the last
            at = at + np.arange(len(at))
            total, count = np.zeros(len(own), np.float32), np.zeros(len(own), np.float32)
            for good, bucket in subwords(own):
                total[:len(good)] += np.where(good, self.weight[bucket], 0)
                count[:len(good)] += good
            word = WORD_BYTE[own]
            first = np.flatnonzero(~word[:-1] & word[1:])
            if not len(first):
                continue
            each = np.add.reduceat(total, first) / np.maximum(np.add.reduceat(count, first), 1) + self.offset
            edge = np.searchsorted(first, at)
            full = np.flatnonzero(np.diff(edge))
            value[lo + full] = np.maximum.reduceat(each, edge[full])
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(value, -30, 30) + self.shift, -30, 30)))


def doc_of(sizes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(sizes)


def type_buckets(types: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each word, one after the other, and where each word's begin."""
    data = np.frombuffer(b" " + b" ".join(types) + b" ", np.uint8)
    first = np.flatnonzero(~WORD_BYTE[data[:-1]] & WORD_BYTE[data[1:]])
    place, bucket = [], []
    for good, own in subwords(data):
        at = np.flatnonzero(good)
        place.append(at), bucket.append(own[at].astype(np.int64))
    place, bucket = np.concatenate(place), np.concatenate(bucket)
    order = np.argsort(place, kind="stable")
    return bucket[order], np.searchsorted(place[order], first)


def train_toxicity_model(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                         toxic_docs: int = 1500, clean_docs: int = 4500) -> ToxicityModel:
    """A model of labelled texts where `use` (a condition on `labels`) holds and the label is 0 or 1.

    At most `toxic_docs` and `clean_docs` whole texts are fetched, chosen by a hash of their id.
    """
    named = labels.filter(use).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    named = named.groupBy("id").agg(F.max("label").alias("label")).withColumn("mark", F.xxhash64(F.col("id"), F.lit(8)))
    counts = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}
    most = {0: clean_docs, 1: toxic_docs}
    rate = F.create_map(*[x for k, n in most.items() for x in (F.lit(k), F.lit(int(min(1.0, 1.3 * n / max(counts.get(k, 0), 1) + 0.001) * 10**6)))])
    few = named.filter(F.pmod("mark", F.lit(10**6)) < F.element_at(rate, F.col("label")))
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("mark", "id"))).filter(F.col("at") <= F.when(F.col("label") == 1, toxic_docs).otherwise(clean_docs))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).filter(F.col("text").isNotNull())
    got = texts.join(F.broadcast(few), F.col("doc") == F.col("id")).select("mark", "label", "text").toArrow().sort_by([("mark", "ascending"), ("text", "ascending")])
    return ToxicityModel([t.encode() for t in got.column("text").to_pylist()], got.column("label").to_pylist())


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of each whole text; an existing column of that name is replaced.

    Null texts, empty texts and texts without a word get the score of a text without any toxic word. Without labels every text gets 0.5, with labels of one class a score on its side. An empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            yield pa.array(shared.value.score(text))

    kept = [F.col(f"`{c}`") for c in docs.columns if c != score_out]
    return docs.select(*kept, F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text_col}`")).alias(score_out))
