"""Language ID: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression."""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import code_points, doc_slices, utf8

LIMIT = 0x110000  # code points; three of them fit 63 bits
ORDERS = (1, 2, 3)
BLOCK = 256  # documents of one matrix product


@cache
def lower_table() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all that is no letter."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(LIMIT))], np.uint32)


class Grams:
    """Presence of the n-grams (n = 1, 2, 3) of a dictionary in whole documents; n-grams are of lower-case letters of any script, all else is 0."""

    def __init__(self):
        self.known = {n: np.zeros(0, np.int64) for n in ORDERS}  # sorted codes
        self.first = dict.fromkeys(ORDERS, 0)  # column of the first of them
        self.size = 0

    def fit(self, texts: list[str], least: int = 2) -> None:
        """Dictionary: the n-grams of at least `least` of the texts (of any, if none is in so many)."""
        seen: dict[int, list[np.ndarray]] = {n: [] for n in ORDERS}
        for text in texts:
            symbols = lower_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
            for n in ORDERS:
                seen[n].append(np.unique(self.codes(symbols, n)))
        counted = {n: np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True) for n, own in seen.items()}
        least = min(least, max((int(c.max()) for _, c in counted.values() if len(c)), default=1) or 1)
        for n, (own, count) in counted.items():
            self.known[n] = own[(count >= least) & (own > 0)]  # without the one of no letters at all
            self.first[n] = self.size
            self.size += len(self.known[n])

    @staticmethod
    def codes(symbols: np.ndarray, n: int) -> np.ndarray:
        out = symbols[:max(0, len(symbols) - n + 1)].astype(np.int64)
        for i in range(1, n):
            out = (out << 21) | symbols[i:len(symbols) - n + 1 + i]
        return out

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents x dictionary, 0 or 1; and which documents have a letter."""
        points, at = code_points(data, offsets)
        symbols = lower_table()[points]
        letter = symbols > 0
        count = len(offsets) - 1
        doc = np.repeat(np.arange(count, dtype=np.int32), np.diff(at))
        seen = np.zeros((count, self.size + 1), np.uint8)
        flat = seen.reshape(-1)
        for n in ORDERS:
            if len(symbols) < n or not len(self.known[n]):
                continue
            own = self.codes(symbols, n)
            column = np.minimum(np.searchsorted(self.known[n], own), len(self.known[n]) - 1)
            good = self.known[n][column] == own
            column += self.first[n]
            if n > 1:
                good &= doc[:len(column)] == doc[n - 1:]
            flat[doc[:len(column)][good].astype(np.int64) * (self.size + 1) + column[good]] = 1
        has = np.zeros(count, bool)
        has[doc[letter]] = True
        return seen[:, :self.size].astype(np.float32), has


class LanguageModel:
    """f_c(x) = sum over landmarks l of a_cl * k(x, l), with k(x, y) = shared n-grams / sqrt(n-grams of x * n-grams of y)."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = 24, ridge: float = 1e-2):
        self.langs = sorted(set(langs))
        at = {name: [i for i, x in enumerate(langs) if x == name] for name in self.langs}
        chosen = [i for name in self.langs for i in at[name][:landmarks]]
        self.grams = Grams()
        self.grams.fit([texts[i] for i in chosen])
        if not self.langs:
            return
        unit = np.concatenate([self.unit(texts[i:i + BLOCK]) for i in range(0, len(texts), BLOCK)])
        self.marks = np.ascontiguousarray(unit[chosen].T)
        values, vectors = np.linalg.eigh((self.marks.T @ self.marks).astype(np.float64))
        good = values > 1e-6 * max(values.max(), 1e-6)
        root = vectors[:, good] / np.sqrt(values[good])  # Nystroem map: kernel rows of the landmarks to features
        features = np.hstack([(unit @ self.marks).astype(np.float64) @ root, np.ones((len(texts), 1))])
        wanted = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        share = np.array([1.0 / len(at[x]) for x in langs])[:, None]  # languages count alike
        square = features.T @ (share * features) + ridge * np.eye(features.shape[1])
        solved = np.linalg.solve(square, features.T @ (share * wanted))
        self.weights, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def unit(self, texts: list[str]) -> np.ndarray:
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        seen, _ = self.grams.presence(data, offsets)
        return seen / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))

    def predict(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: none) and score of each text."""
        data, offsets = utf8(column)
        best, score = np.full(len(offsets) - 1, -1, np.int64), np.zeros(len(offsets) - 1)
        if not self.langs:
            return best, score
        for lo, hi in doc_slices(offsets, most=BLOCK):
            seen, has = self.grams.presence(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            kernel = (seen @ self.marks) / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))
            values = kernel @ self.weights + self.bias
            top = values.argmax(axis=1)
            best[lo:hi] = np.where(has, top, -1)
            score[lo:hi] = np.where(has, np.clip((values[np.arange(hi - lo), top] + 1) / 2, 0, 1), 0)
        return best, score


def train_language_model(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 200, landmarks: int = 24) -> LanguageModel:
    """A model of the rows where `use` holds and text and language are not null.

    At most `per_lang` whole texts of each language are fetched, chosen by a hash of id and text length; of these the first `landmarks` are landmarks.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), use.alias("use"))
    rows = rows.filter(F.col("use") & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("mark", F.xxhash64(F.col("id"), F.lit(9)))
    counts = rows.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return LanguageModel([], [])
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, 1.5 * per_lang / r["count"] + 0.001) * 10**6)))])
    few = rows.filter(F.pmod("mark", F.lit(10**6)) < F.element_at(rate, F.col("lang")))
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "id", "text"))).filter(F.col("at") <= per_lang)
    got = few.select("lang", "mark", "text").orderBy("lang", "mark", "text").collect()
    return LanguageModel([r["text"] for r in got], [r["lang"] for r in got], landmarks)


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """`docs` with the predicted language and a score from 0 to 1 for each whole text; existing columns of these names are replaced.

    Null texts and texts without a letter are `und` with score 0, as is every text if the model has learned no language. The score is (f + 1) / 2 of the
    best language, cut to 0..1. Ties go to the first language by code point. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: landmarks x dictionary

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        names = np.array([*own.langs, "und"], object)
        for text in batches:
            best, score = own.predict(text)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang", "score"])

    udf = F.arrow_udf(predict, "struct<lang:string,score:double>", F.ArrowUDFType.SCALAR_ITER)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (lang_out, score_out)]
    return docs.select(*kept, udf(F.col(f"`{text_col}`")).alias(lang_out)).select(*kept, F.col(f"`{lang_out}`.lang").alias(lang_out), F.col(f"`{lang_out}`.score").alias(score_out))
