"""Ranked search, min-max near-duplicates and fill-in-middle against brute force and on the edges."""
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import rows, sentence
from test_documents import shingle_set

from curvekit.llm import best_position, fill_middle, min_max

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ranked search ---------------------------------------------------------------------------------------------------------------------------------------
def found_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_search(docs: list[tuple], queries: list[tuple], k: int) -> Counter:
    bags = [(d, Counter(found_terms(t))) for d, t in docs]
    texts, tokens = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    asked = {}
    for q, t in queries:
        asked.setdefault(q, set()).update(found_terms(t))
    out = Counter()
    for q, ws in asked.items():
        scored = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * texts) // max(tokens, 1)
            scored.append((sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 8 * m)) for w in ws if b[w]), d))
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out.update((q, n + 1, d, s) for n, (s, d) in enumerate(best))
    return out


@pytest.mark.parametrize("sizes", [{}, {"block": 8, "postings_per_shard": 40}])
def test_search(spark, docs, sizes):
    table = [(r[0], r[1]) for r in rows()]
    queries = [(1, "River, STONE! under7"), (2, None), (3, ""), (4, "é"), (5, sentence(2, 40)), (5, "bridge winter"), (6, "nothing like this"), (None, "x" * 5000), (7, "the the THE of")]
    asked = spark.createDataFrame([(*q, 3, 1.5) for q in queries], "item_id int, text string, rank int, doc_id double")
    got = best_position.search(docs, asked, k=4, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_search(table, queries, 4)


def test_search_empty(spark, docs, nothing):
    asked = spark.createDataFrame([(1, "river")], "item_id int, text string")
    assert best_position.search(nothing, asked).count() == 0
    assert best_position.search(docs, asked.limit(0)).count() == 0


def test_best_positions_stop_early():
    """Exact against all scores, ties at the k-th place included, and far from all documents scored where a few stand out."""
    rng = np.random.default_rng(3)
    for trial in range(30):
        many, terms = 3000, 6
        sizes = rng.integers(1, terms + 1, many)
        held = np.concatenate([np.sort(rng.choice(terms, n, replace=False)) for n in sizes]).astype(np.uint32)
        counts = rng.geometric(0.5, len(held)).astype(np.uint32)
        if trial % 2:
            counts[: terms * 4] = 500
        weights = rng.integers(0, 9000, terms)
        shard = best_position.Shard(sizes, held, counts, np.bincount(np.repeat(np.arange(many), sizes), weights=counts).astype(np.int64), weights, many, int(counts.sum()))
        asked = np.arange(0, terms, 1 + trial % 3)
        want = np.zeros(many, np.int64)
        norm = 10 + 90 * np.bincount(np.repeat(np.arange(many), sizes), weights=counts).astype(np.int64) * many // int(counts.sum())
        for d, w, c in zip(np.repeat(np.arange(many), sizes), held, counts.astype(np.int64)):
            if w in asked:
                want[d] += weights[w] * (10**9 * c // (1000 * c + 8 * norm[d]))
        docs, scores, scored = best_position.best_positions(shard.lists(asked), many, 10)
        order = np.lexsort((docs, -scores))[:10]
        best = np.lexsort((np.arange(many), -want))[:10]
        best = best[want[best] > 0]
        assert docs[order].tolist() == best.tolist() and scores[order].tolist() == want[best].tolist()
    one = best_position.best_positions(shard.lists(np.array([int(np.argmax(weights))])), many, 10)
    assert one[2] < many / 10


# min-max near-duplicates -----------------------------------------------------------------------------------------------------------------------------
def brute_copies(table: list[tuple], percent: int = 85) -> Counter:
    sets = [shingle_set(t) for _, t in table]
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(table):
        least.setdefault(find(i), []).append(d)
    out = Counter()
    for i, (d, _) in enumerate(table):
        own = min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else d
        out[d, len(sets[i]), own, d == own] += 1
    return out


def test_min_max_estimates_without_bias():
    """The share of agreeing values is close to the similarity and varies less than with minima alone."""
    rng = np.random.default_rng(8)
    both, lone = [], []
    for _ in range(150):
        base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        x, y = np.unique(base[:320]), np.unique(base[80:])  # similarity 0.6
        ends = min_max.min_max(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 64)
        agree = ends[0] == ends[1]
        both.append(agree.mean())
        lone.append(agree[:, 0].mean())
    assert abs(np.mean(both) - 0.6) < 0.01 and np.std(both) < np.std(lone)


def test_near_copies_edges(docs, nothing):
    got = min_max.near_copies(docs)
    assert got.columns == ["id", "n_shingles", "component_id", "kept"]
    assert Counter(tuple(r) for r in got.collect()) == brute_copies([(r[0], r[1]) for r in rows()])
    assert min_max.near_copies(nothing).count() == 0


def test_near_copies_families(spark):
    """Chains, families around the threshold, a passage that all texts share, short texts."""
    passage, table = sentence(99, 55), []
    for f in range(14):
        words = sentence(1000 + f, 60 + 15 * f).split()
        for k in range(14):
            own = list(words)
            for j in range(k if f % 2 else k // 3):
                own[(j * 17 + (k if f % 4 else 0)) % len(own)] = f"edit{f}-{k if f % 3 else j}-{j}"
            table.append((len(table), " ".join(own) + (" " + passage if f % 3 == 0 else "")))
    table += [(1000 + i, " ".join("abcdefg"[: i % 8])) for i in range(16)]
    frame = spark.createDataFrame(table, "doc_id int, text string")
    assert Counter(tuple(r) for r in min_max.near_copies(frame).collect()) == brute_copies(table)


def test_near_copies_later_steps(spark, monkeypatch):
    """Links that no centre shows: cells of one key hold several groups, whose members are compared in blocks."""
    monkeypatch.setattr(min_max, "BLOCK", 3)
    table = []
    for f in range(5):
        words = sentence(50 + f, 200).split()
        for k in range(24):  # each copy differs from the next by one word: only neighbours in the chain link
            own = list(words)
            own[: 5 * k : 5] = [f"w{f}-{j}" for j in range(len(own[: 5 * k : 5]))]
            table.append((len(table), " ".join(own)))
    frame = spark.createDataFrame(table, "doc_id int, text string")
    got = Counter(tuple(r) for r in min_max.near_copies(frame).collect())
    assert got == brute_copies(table)


# fill-in-middle --------------------------------------------------------------------------------------------------------------------------------------
UNITS = {"line": r"[^\n]*\n|[^\n]+", "clause": r"[^.!?;:\n]*[.!?;:\n]|[^.!?;:\n]+", "word": r"[^ \t\r\f\v\n]*[ \t\r\f\v\n]|[^ \t\r\f\v\n]+"}


def brute_cut(i, text, seed, percent, spm_percent, unit):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fill_middle.MARKS) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm_percent:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", list(UNITS))
@pytest.mark.parametrize("percent,spm_percent", [(100, 50), (60, 0)])
def test_fill_in_middle(spark, unit, percent, spm_percent):
    texts = [t for _, t, *_ in rows()] + ["a\nb\n\nc", "\n", "\n\n\n", "no end", "é x\n𝔘 y. z;\r\nü", "<P>", "a <S> b\nc", "<\n<M", "P>\n<", "<P\n>\nM>\n<M\n>S>", " ", "a" * 70000 + "\n" + "b\n" * 40000]
    ids = [r[0] for r in rows()] + list(range(100, 112))
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in zip(ids, texts)], "doc_id bigint, text string, fim_form string, n int")
    got = fill_middle.fill_in_middle(frame, seed=7, percent=percent, spm_percent=spm_percent, unit=unit)
    got = got.withColumn("back", fill_middle.middle_text(F.col("fim_text"), F.col("fim_form"))).collect()
    want = Counter((i, t, *brute_cut(i, t, 7, percent, spm_percent, unit)) for i, t in zip(ids, texts))
    assert Counter((r["doc_id"], r["text"], r["fim_units"], r["fim_form"], r["prefix_chars"], r["middle_chars"], r["fim_text"]) for r in got) == want
    assert all(r["back"] == (r["text"] or "") and r["n"] == 5 for r in got)


def test_fill_in_middle_empty(nothing):
    assert fill_middle.fill_in_middle(nothing).count() == 0


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    classes = rng.integers(0, 6, 1000).astype(np.uint8)
    matrix = fill_middle.WaveletMatrix(classes)
    lo = rng.integers(0, 1001, 300)
    hi = lo + (rng.random(300) * (1001 - lo)).astype(np.int64)
    for kinds in ((4,), (2, 4), (0, 3, 5)):
        assert matrix.count(kinds, lo, hi).tolist() == [int(np.isin(classes[a:b], kinds).sum()) for a, b in zip(lo, hi)]
    units, before, middle = fill_middle.cuts(pa.array(["", None, "x\ny"]), np.array([5, 5, 1]), np.array([6, 6, 2]), (fill_middle.NEWLINE,))
    assert units.tolist() == [0, 0, 2] and before.tolist() == [0, 0, 2] and middle.tolist() == [0, 0, 1]
