"""Recurrences by restart points against plain loops: short and long islands, hot keys, ties, nulls in keys."""
import random

import pytest
from pyspark.sql import functions as F

from curvekit import islands
from curvekit.operators import clean, masks, pixels, runs
from curvekit.ordered import Ordered

POINTS = "curve_id int, t double, s double"


def curves(seed: int, n: int, keys=3, dense=0.4) -> list[tuple]:
    rnd = random.Random(seed)
    out = []
    for k in [*range(keys - 1), None]:
        t, s = 0.0, 1.0
        for _ in range(n):
            t += rnd.choice([0.0, 0.001, 0.004, 0.02]) if rnd.random() < dense else 0.5
            s = max(0.0, s + rnd.uniform(-0.02, 0.015))
            out.append((k, round(t, 3), round(s, 4)))
    return out


def by_key(table):
    groups = {}
    for k, *row in table:
        groups.setdefault(k, []).append(tuple(row))
    return {k: sorted(v) for k, v in groups.items()}


def loop_thin(rows):
    kept = []
    for t, s in rows:
        if not kept or t - kept[-1][0] > 0.005 or kept[-1][1] - s > 0.005:
            kept.append((t, s))
    return kept


def loop_continuity(rows):
    times = {}
    for t, s in rows:
        times.setdefault(t, set()).add(s)
    prev, out = 1.0, []
    for t in sorted(times):
        near = [v for v in times[t] if prev - 0.15 <= v <= prev + 0.01]
        prev = max(near) if near and len(times[t]) > 1 else min(times[t], key=lambda v: (abs(v - prev), v))
        out.append((t, prev))
    return out


def loop_regions(rows):
    last, out = None, []
    for now in rows:
        if last is None:
            last = now
        elif now[0] - last[0] < 1.0:
            last = now if abs(now[1]) > abs(last[1]) else last
        else:
            out.append(last)
            last = now
    return out + [last]


def loop_jump(rows):
    kept = []
    for x, y in rows:
        if not kept or y - kept[-1][1] <= 0.01:
            kept.append((x, y))
    return kept


CASES = [(clean.thin, loop_thin), (clean.dedup_continuity, loop_continuity), (lambda p: runs.consolidate_regions(p, offset="s").drop("rank"), loop_regions),
         (lambda p: clean.max_jump_filter(p, x="t", y="s", plot_h=0.1, frac=0.1), loop_jump)]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("dense", [0.4, 1.0])
@pytest.mark.parametrize("mode", ["cold", "hot"])
def test_against_loops(request, spark, monkeypatch, case, dense, mode):
    """With dense rows whole curves are islands, longer than a chunk; in hot mode they are cut into runs of seven rows."""
    if mode == "hot":
        request.getfixturevalue("hot")
    monkeypatch.setattr(islands, "CHUNK", 16)
    apply, loop = CASES[case]
    table = curves(case, 90, dense=dense)
    inside = [r for r in table if r[2] <= 10.1] if case == 3 else table
    got = apply(spark.createDataFrame(table, POINTS)).collect()
    assert {k: sorted(v) for k, v in by_key(tuple(r) for r in got).items()} == {k: sorted(loop(v)) for k, v in by_key(inside).items()}


@pytest.mark.parametrize("mode", ["cold", "hot"])
def test_two_way(request, spark, mode):
    """All four functions of two ways, in random order."""
    if mode == "hot":
        request.getfixturevalue("hot")
    rnd = random.Random(5)
    table = [(k, i, *(rnd.choice([(0, 0), (1, 1)]) if i == 0 or rnd.random() < 0.1 else rnd.choice([(0, 1), (1, 0)]))) for k in range(3) for i in range(100)]
    o = Ordered(spark.createDataFrame(table, "k int, t int, a int, b int"), "k", "t")
    got = {(r["k"], r["t"]): r["_way"] for r in islands.two_way(o, F.col("a"), F.col("b")).df.collect()}
    way = {}
    for k, t, a, b in table:
        way[k] = (a, b)[way.get(k, 0)]
        assert got[k, t] == way[k]


def test_plans_without_python(spark):
    """No Python worker in the plans of recurrences over short islands."""
    points = spark.createDataFrame(curves(1, 20), POINTS)
    mask = points.select(F.col("curve_id").alias("image_id"), F.col("t").cast("int").alias("x"), (F.col("s") * 100).cast("int").alias("y"))
    frames = [clean.thin(points), clean.dedup_continuity(points), clean.drop_flat(points), clean.max_jump_filter(points, x="t", y="s"), pixels.column_pick_continuous(mask),
              pixels.column_pick_nearest(mask), runs.consolidate_regions(points, offset="s"), runs.group_tokens_by_row(mask, y="y", x="x")]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "Python" not in plan


def loop_bridges(cells: set, gap: int) -> list[tuple]:
    """Straight bridges: each free end, in reading order, to the closest later free end."""
    ends = sorted((y, x) for x, y in cells if sum((x + i, y + j) in cells for i in (-1, 0, 1) for j in (-1, 0, 1)) <= 2)
    taken, links = set(), []
    for y, x in ends:
        if (y, x) in taken:
            continue
        far = sorted((((v - y) ** 2 + (u - x) ** 2) ** 0.5, v, u) for v, u in ends if (v, u) > (y, x) and (v, u) not in taken)
        if far and 1 < (best := next((f for f in far if f[0] > 1), (0, 0, 0)))[0] <= gap:
            taken.add(best[1:])
            links.append((x, y, best[2], best[1], best[0]))
    return links


@pytest.mark.parametrize("mode", ["cold", "hot"])
def test_bridges(spark, request, mode):
    """Pictures full of ends, a chain of dashes in which every choice hangs on the one before, and a null key; in hot mode runs of seven ends."""
    if mode == "hot":
        request.getfixturevalue("hot")
    rnd = random.Random(5)
    pictures = {1: {(rnd.randrange(40), rnd.randrange(30)) for _ in range(170)}, None: {(x, 3) for x in range(90) if x % 5 < 2}, 2: {(4, 4)}}
    mask = spark.createDataFrame([(k, x, y) for k, cells in pictures.items() for x, y in cells], "image_id int, x int, y int")
    got = {}
    for r in masks.bridge_endpoints(mask, 6, shape="line").collect():
        got.setdefault(r["image_id"], set()).add((r["x"], r["y"]))
    want = {}
    for k, cells in pictures.items():
        want[k] = set(cells)
        for x, y, u, v, far in loop_bridges(cells, 6):
            n = int(far) + 1
            want[k] |= {((x * n + (u - x) * i) // n, (y * n + (v - y) * i) // n) for i in range(n + 1)}
    assert got == want
