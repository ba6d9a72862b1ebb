import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvekit.llm import chat, neighbours

EVENTS = "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string, rendered int"


def test_escapes_are_reversible():
    parts = ["\\", "#", "##", "###", "####", "</turn>", "<", "/turn>", "\n", "a", " ", "é", "### "]
    x = 7
    for _ in range(3000):
        turns = []
        for _ in range(3):
            words = []
            for _ in range(14):
                x = (x * 1103515245 + 12345) % (1 << 31)
                words.append(parts[(x >> 8) % len(parts)])
            turns.append(("".join(words[:4]), "".join(words[4:])))
        assert chat.parse("".join(chat.render(*t)[0] for t in turns)) == turns


def test_fold(spark):
    log = [(1, 0, 0, "message", "user", "hi", 1), (1, 1, 1, "message", "assistant", "", 1), (1, 2, 1, "delta", None, "wor", 1), (1, 3, 1, "delta", None, "ld", 1), (1, 9, 0, "edit", None, "hello", 1),
           (1, 5, 1, "regenerate", None, None, 1), (1, 7, 1, "delta", None, "b</turn>", 1), (1, 6, 1, "delta", None, "a", 1), (2, None, None, None, None, None, 1),
           (None, 1, 1, "delta", "assistant", "x" * 10**5, 1), (3, 1, 1, "message", "user", "same", 1), (3, 1, 1, "message", "user", "same", 1), (3, 2, 2, "what", "assistant", "", 1)]
    messages = chat.rebuild(spark.createDataFrame(log, EVENTS))
    got = {}
    for r in sorted(messages.collect(), key=lambda r: r["no"]):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {1: [("user", "hello"), ("assistant", "ab</turn>")], 2: [("", "")], None: [("assistant", "x" * 10**5)], 3: [("user", "same"), ("user", "same"), ("assistant", "")]}
    for r in chat.read_back(messages).collect():
        turns = got[r["conv_id"]]
        loss = "".join(t for who, t in turns if who == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.render(*t)[0]) for t in turns)
    empty = chat.rebuild(spark.createDataFrame([], EVENTS))
    assert empty.count() == 0 and chat.read_back(empty).count() == 0


def test_logs_of_turns(spark):
    """Deltas, edits and regenerations of every kind leave the turns they were made of."""
    turns = [(1, 0, "user", "é" * n, "x") for n in range(9)] + [(1, 1, "assistant", "same###", "x")] * 3 + [(2, None, None, None, "x"), (2, 1, "assistant", "", "x"), (None, 1, "a\nb", "</turn>\\", "x"), (2, 1, "user", "abc", None)]
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, seq string")
    log = chat.as_events(table)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    want = {}
    for conv, turn, role, text, _ in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    messages = chat.rebuild(log)
    got = {}
    for r in sorted(messages.collect(), key=lambda r: r["no"]):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == want
    assert sorted(chat.read_back(messages, in_order=True).collect(), key=repr) == sorted(chat.read_back(messages).collect(), key=repr)
    assert chat.as_events(table.limit(0)).count() == 0


def brute(table: list[tuple], k: int) -> dict:
    good = [(i, np.array(v, float)) for i, v in table if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    out = {}
    for i, v in good:
        if i % 10 == 0:
            near = sorted({j: np.sqrt(((v - w) ** 2).sum()) for j, w in good if j != i}.items(), key=lambda x: (x[1], x[0]))[:k]
            out[i] = [(j, d) for j, d in near]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    table = [(i, [float(np.float32(x)) for x in (rng.normal(0, 1, 8) if i % 3 else [1, 0, 0, 0, 0, 0, 0, 0])]) for i in range(600)]
    table += [(600, None), (601, [0.0] * 8), (602, [None] + [1.0] * 7), (603, [float("nan")] * 8), (610, [float("inf")] * 8), (620, [1.0, 2.0]), (5, table[5][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in table], "vec_id bigint, embedding array<double>, rank int")
    want, got = brute(table, 10), {}
    for r in neighbours.nearest_neighbours(frame, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = [sum(d <= want[q][-1][1] + 1e-12 for _, d in got[q]) / 10 for q in want]
    assert np.mean(hit) >= 0.9
    assert got[0] == want[0] and all(v == sorted(v, key=lambda x: (x[1], x[0])) for v in got.values())


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    frame = spark.createDataFrame([(i * 10, [float(i + 1), 1.0]) for i in range(n)], "vec_id bigint, embedding array<float>")
    got = neighbours.nearest_neighbours(frame, F.col("vec_id") % 10 == 0).collect()
    assert len(got) == n * (n - 1)


def test_vectors_whose_squares_overflow(spark):
    table = [(i, [float(i + 1), 1.0]) for i in range(40)] + [(40 + i, [s * (1 + i) * 1e200, 1e200]) for i, s in enumerate((1, 1, 1, -1))] + [(50, [1.7e308, 0.0]), (60, [-1.7e308, 0.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in table], "vec_id bigint, embedding array<double>, score string")
    got = {}
    for r in neighbours.nearest_neighbours(frame, F.col("vec_id") % 10 == 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [i for i, _ in got[0]] == [1, 2, 3] and got[40][0] == (41, pytest.approx(1e200, rel=1e-12)) and [i for i, _ in got[40][1:]] == [0, 1]  # all small ones are equally far
    assert len(got[50]) == 3 and all(np.isfinite(d) for _, d in got[50]) and 60 not in [i for i, _ in got[50]]
