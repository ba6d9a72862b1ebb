"""Hand-written cases, properties and brute-force comparisons on small inputs."""
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from curvekit.fold import fold
from curvekit.operators import atrisk, axis, choose, clean, joins, masks, pairs, pixels, quality, runs
from curvekit.operators.track import track
from curvekit.ordered import Ordered, exact_median, top_rows
from curvekit.sources import files


def curve(spark, rows, key=1):
    return spark.createDataFrame([(key, float(t), float(s)) for t, s in rows], "curve_id long, t double, s double")


def pts(df, *cols):
    rows = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*(cols or ("t", "s"))).collect()]
    return sorted(rows, key=lambda r: [(v is None, 0 if v is None else v) for v in r])


def cells(spark, rows, key=1):
    return spark.createDataFrame([(key, x, y) for x, y in rows], "image_id long, x int, y int")


# -- curve cleaning --------------------------------------------------------------------------------

def test_monotone(spark):
    c = curve(spark, [(0, 1), (1, .9), (2, .95), (3, .8)])
    assert pts(clean.monotone_cap(c)) == [(0, 1), (1, .9), (2, .9), (3, .8)]
    c = curve(spark, [(0, 1), (1, .9), (2, .95), (3, .904), (4, .8)])
    assert pts(clean.monotone_drop(c)) == [(0, 1), (1, .9), (3, .9), (4, .8)]


def test_dedup_continuity(spark):
    c = curve(spark, [(0, 1), (1, .97), (1, .5), (2, .5), (2, .4), (3, .45)])
    assert pts(clean.dedup_continuity(c)) == [(0, 1), (1, .97), (2, .5), (3, .45)]


def test_thin_rescale_anchor(spark):
    assert pts(clean.thin(curve(spark, [(0, 1), (.003, 1), (.006, 1)]))) == [(0, 1), (.006, 1)]
    assert pts(clean.rescale_to_one(curve(spark, [(0, .5), (1, .25)]))) == [(0, 1), (1, .5)]
    assert pts(clean.anchor_start(curve(spark, [(2, .9)]))) == [(0, 1), (2, .9)]
    assert pts(clean.anchor_start(curve(spark, [(0, .9), (1, .8)]))) == [(0, 1), (1, .8)]


def random_curves(spark, n=8, size=60, seed=3):
    rnd = random.Random(seed)
    rows = [(k, round(rnd.uniform(0, 20), 2), round(rnd.uniform(0, 1.1), 3)) for k in range(n) for _ in range(size if k else 4 * size)]
    return rows, spark.createDataFrame(rows, "curve_id long, t double, s double")


def drop_loop(rows, tol=.005, start=1.0):
    top, out = start, []
    for t, s in sorted(rows):
        if s <= top + tol:
            top = min(s, top)
            out.append((t, top))
    return out


@pytest.mark.parametrize("mode", ["plain", "hot"])
def test_drop_equals_loop(spark, request, mode):
    if mode == "hot":
        request.getfixturevalue("hot")
    rows, df = random_curves(spark)
    got = clean.monotone_drop(df)
    for k in range(8):
        assert pts(got.where(f"curve_id = {k}")) == sorted(drop_loop([r[1:] for r in rows if r[0] == k]))


@pytest.mark.parametrize("mode", ["plain", "hot"])
def test_clean_curve_properties(spark, request, mode):
    if mode == "hot":
        request.getfixturevalue("hot")
    _, df = random_curves(spark)
    once = clean.clean_curve(df)
    rows = {k: sorted((r["t"], r["s"]) for r in once.where(f"curve_id = {k}").collect()) for k in range(8)}
    for r in rows.values():
        assert r[0] == (0.0, 1.0)
        assert all(b[1] <= a[1] and b[0] > a[0] for a, b in zip(r, r[1:]))
    again = clean.clean_curve(spark.createDataFrame([(k, *p) for k, r in rows.items() for p in r], df.schema))
    assert pts(again, "curve_id", "t", "s") == pts(once, "curve_id", "t", "s")


def test_hot_equals_plain(spark, hot):
    """Slabs and carries give what plain windows give."""
    _, df = random_curves(spark, seed=9)
    o = Ordered(df, "curve_id", "t", "s")
    assert o._hot is not None
    o = o.lag(a="s").lead(b="s").running(c=("min", "s"), d=("last", F.when(F.col("s") > .8, F.col("s")))).running(reverse=True, before=True, e=("sum", "s"))
    o = o.row_number("f").total(g=F.max("s"), h=F.count("*"))
    got = pts(o.df, *sorted(o.df.columns))
    spark.conf.set("curvekit.slabRows", "1000000")
    p = Ordered(df, "curve_id", "t", "s")
    assert p._hot is None
    p = p.lag(a="s").lead(b="s").running(c=("min", "s"), d=("last", F.when(F.col("s") > .8, F.col("s")))).running(reverse=True, before=True, e=("sum", "s"))
    p = p.row_number("f").total(g=F.max("s"), h=F.count("*"))
    assert str(got) == str(pts(p.df, *sorted(p.df.columns)))


def test_hot_fold_repairs_wrong_guesses(spark, hot):
    """A fold that never forgets its start: slabs must be run again until their states agree."""
    df = spark.createDataFrame([(1, i, i % 5) for i in range(100)] + [(2, i, 1) for i in range(3)], "k long, i int, v int")
    got = fold(df, "k", ["i"], lambda s, r: (s + r["v"], [(r["i"], s + r["v"])]), 0, "i int, total long", lambda s: [(-1, s)])
    rows = {(r["k"], r["i"]): r["total"] for r in got.collect()}
    want, s = {}, 0
    for i in range(100):
        s += i % 5
        want[(1, i)] = s
    want[(1, -1)] = s
    want.update({(2, 0): 1, (2, 1): 2, (2, 2): 3, (2, -1): 3})
    assert rows == want


@pytest.mark.parametrize("mode", ["plain", "hot"])
def test_exact_median(spark, request, mode):
    if mode == "hot":
        request.getfixturevalue("hot")
    df = spark.createDataFrame([(k, float(v)) for k, vs in {1: range(41), 2: [3, 3, 9], 3: [1, 2, 2, 8]}.items() for v in vs], "k long, v double")
    assert pts(exact_median(df, "k", "v", "m"), "k", "m") == [(1, 20), (2, 3), (3, 2)]
    assert pts(exact_median(df, "k", "v", "m", upper=True), "k", "m") == [(1, 20), (2, 3), (3, 2)]


def test_top_rows(spark):
    df = spark.createDataFrame([(k, v) for k in (1, 2) for v in range(500)], "k long, v int")
    assert pts(top_rows(df, "k", 3, F.desc("v")), "k", "v", "rn") == [(k, 500 - i, i) for k in (1, 2) for i in (3, 2, 1)]


def skipped(points, i=0):
    """The rule by recursion: the rows from index i on, where a jump that comes back within 50 rows is held at the row before it."""
    if i >= len(points):
        return []
    (x, y), (px, py) = points[i], points[max(i - 1, 0)]
    jumps = i + 1 < len(points) and abs(y - py) > 15 and x - px < 5
    returns = [j for j, (_, v) in enumerate(points) if jumps and i < j < i + 50 and abs(v - py) < 10]
    if not returns:
        return [(x, y), *skipped(points, i + 1)]
    return [(f, py) for f in range(px + 1, points[returns[0]][0])] + skipped(points, returns[0])


@pytest.mark.parametrize("mode", ["plain", "hot"])
def test_skip_excursion_equals_rule(spark, request, mode):
    if mode == "hot":
        request.getfixturevalue("hot")
    rnd = random.Random(5)
    points, y = [], 20
    for x in range(300):
        y += rnd.choice([0, 0, 0, 1])
        points.append((x, y + (rnd.choice([20, 40]) if rnd.random() < .1 else 0)))
    df = spark.createDataFrame([(1, *p) for p in points], "curve_id long, x int, y int")
    assert pts(clean.skip_excursion(df), "x", "y") == sorted(skipped(points))


# -- quality ---------------------------------------------------------------------------------------

def test_score_and_empty_curve(spark):
    c = spark.createDataFrame([(1,), (2,), (3,)], "curve_id long")
    i = spark.createDataFrame([(1, "critical"), (1, "error"), (1, "error"), (1, "warning")], "curve_id long, severity string")
    got = {r["curve_id"]: (round(r["score"], 6), r["passed"]) for r in quality.qc_score(c, i).collect()}
    assert got == {1: (.0225, False), 2: (1.0, True), 3: (1.0, True)}
    few = quality.all_issues(curve(spark, [(t, 1 - t / 30) for t in range(12)], 2), curves=c).where("issue_type = 'too_few_points'")
    assert sorted((r["curve_id"], r["severity"]) for r in few.collect()) == [(1, "critical"), (3, "critical")]


def test_single_rules_equal_all_issues(spark):
    _, df = random_curves(spark, seed=4)
    df = df.withColumn("t", F.col("t") - 1).withColumn("s", F.col("s") * 1.2 - .1)
    single = [quality.min_points(df), quality.negative_time(df), quality.value_range(df), quality.sudden_drop(df), quality.early_zero(df),
              quality.flat_zero(df), quality.reference_line(df), quality.non_monotonic(df)]
    want = sorted(str(tuple(r)) for d in single for r in d.select("curve_id", *quality.ISSUE_COLS).collect())
    assert want == sorted(str(tuple(r)) for r in quality.all_issues(df).select("curve_id", *quality.ISSUE_COLS).collect())


# -- joins and pairs -------------------------------------------------------------------------------

@pytest.mark.parametrize("mode", ["plain", "hot"])
def test_asof_and_nearest(spark, request, mode):
    if mode == "hot":
        request.getfixturevalue("hot")
    p = curve(spark, [(1, .9), (3, .7)] + [(10 + i, .5) for i in range(12)])
    g = spark.createDataFrame([(1, float(t)) for t in (0, 1, 2, 3)], "curve_id long, t double")
    assert pts(joins.asof_step(p, g).na.fill(-1, ["s"])) == [(0, -1), (1, .9), (2, .9), (3, .7)]
    assert pts(joins.asof_step(p, g, or_first=True)) == [(0, .9), (1, .9), (2, .9), (3, .7)]
    assert pts(joins.nearest(p, g)) == [(0, .9), (1, .9), (2, .9), (3, .7)]


def test_swap_labels_twice(spark):
    c = spark.createDataFrame([(1, 1, "a", "solid"), (1, 2, "b", "dashed"), (2, 3, "c", "solid")], "image_id long, curve_id long, name string, style string")
    once = pairs.swap_labels(c)
    assert pts(once, "curve_id", "name", "style") == [(1, "b", "dashed"), (2, "a", "solid"), (3, "c", "solid")]
    assert pts(pairs.swap_labels(once), *c.columns) == pts(c, *c.columns)


def continuity_regions(y0, y1, window=10, jump=15, sep=30):
    """The rule over all regions: every (first, last) that may be one, and of these the ones that start first and do not touch an earlier one."""
    xs = sorted(set(y0) & set(y1))
    steps = [(y0[a], y1[a], y0[b], y1[b]) for a, b in zip(xs, xs[1:])]
    moves = [(abs(q0 - p0), abs(q1 - p1)) for p0, p1, q0, q1 in steps]
    crossed = {i for i, (p0, p1, q0, q1) in enumerate(steps) if abs(q1 - p0) < moves[i][0] and abs(q0 - p1) < moves[i][1]}
    calm = {i for i, m in enumerate(moves) if max(m) <= jump} - crossed
    starts = [i for i in sorted(crossed) if i < len(xs) - window and abs(steps[i][0] - steps[i][1]) < sep and max(moves[i]) > jump]
    regions = [(i + 1, max(j for j in crossed if i < j < stop) + 1) for i in starts for stop in [min((j for j in calm if j > i), default=len(xs))] if any(i < j < stop for j in crossed)]
    out = []
    for first, last in regions:
        if not out or first - 1 > out[-1][1]:
            out.append((first, last))
    return [(xs[first], xs[last]) for first, last in out]


@pytest.mark.parametrize("seed", range(4))
def test_fix_continuity_equals_walk(spark, seed):
    rnd = random.Random(seed)
    y0, y1, flip = {}, {}, False
    for x in range(120):
        flip = flip != (rnd.random() < .2)
        a, b = 40 + rnd.randint(0, 6), 60 + rnd.randint(0, 6)
        y0[x], y1[x] = (b, a) if flip else (a, b)
        if rnd.random() < .1:
            y0[x] += rnd.randint(0, 40)
    df = spark.createDataFrame([(1, k, x, y) for k, d in (("a", y0), ("b", y1)) for x, y in d.items()], "image_id long, style string, x int, y int")
    spans = continuity_regions(y0, y1)
    inside = lambda x: any(f <= x <= t for f, t in spans)
    want = sorted((("b" if k == "a" else "a") if inside(x) else k, x, y) for k, d in (("a", y0), ("b", y1)) for x, y in d.items())
    assert pts(pairs.fix_continuity(df), "style", "x", "y") == want


def test_fuzzy_names(spark):
    a = spark.createDataFrame([(1, "Arm A"), (1, "Placebo"), (1, "x")], "image_id long, name_a string")
    b = spark.createDataFrame([(1, "the arm-a group"), (1, "PLAC."), (1, "Other"), (1, "??")], "image_id long, name_b string")
    got = {(r["name_a"], r["name_b"]) for r in joins.first_similar(a, b).collect()}
    assert got == {("Arm A", "the arm-a group"), ("Placebo", "PLAC.")}


def test_first_similar_equals_rule(spark):
    """All names of up to six letters and marks, with empty, short and null ones, against the rule for each pair."""
    rnd = random.Random(11)
    name = lambda: None if rnd.random() < 0.03 else "".join(rnd.choice("aAb1- .") for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6, 9])))
    left = [(rnd.choice([1, 2, None]), name()) for _ in range(60)]
    right = [(rnd.choice([1, 2, None]), name()) for _ in range(90)]
    bare = lambda s: re.sub("[^a-z0-9]", "", s.lower())

    def similar(x, y):
        p, q = bare(x), bare(y)
        return (x.lower() in y.lower() or y.lower() in x.lower() or bool(p and q) and (p in q or q in p) or len(p) >= 4 and len(q) >= 4 and p[:4] == q[:4])

    want = {}
    for i, y in right:
        near = [x for k, x in left if k == i and x is not None and y is not None and similar(x, y)]
        if near:
            want[i, y] = min(near)
    got = joins.first_similar(spark.createDataFrame(left, "image_id long, name_a string"), spark.createDataFrame(right, "image_id long, name_b string")).collect()
    assert {(r["image_id"], r["name_b"]): r["name_a"] for r in got} == want and len(got) == len(want)


def test_merge_box_passes(spark):
    f = spark.createDataFrame([(1, 50, 50, 5, 5)], "image_id long, x int, y int, w int, h int")
    s = spark.createDataFrame([(1, i, x, y, 5, 5) for i, (x, y) in enumerate([(55, 55), (80, 80), (85, 85), (92, 80), (80, 80)])],
                              "image_id long, seq int, x int, y int, w int, h int")
    assert pts(joins.merge_box_passes(f, s), "x", "y") == [(50, 50), (80, 80), (92, 80)]


# -- at-risk and axes ------------------------------------------------------------------------------

def test_events(spark):
    c = spark.createDataFrame([(1, "g", float(t), n) for t, n in enumerate([10, 7, 8, 2])], "image_id long, grp string, t double, n long")
    assert pts(atrisk.events(c), "t", "events") == [(0, 3), (1, 0), (2, 6), (3, 0)]


def test_label_repair(spark):
    lab = spark.createDataFrame([(1, float(v), px) for v, px in [(100, 0), (5, 10), (50, 20), (5, 30), (0, 40)]], "image_id long, value double, px int")
    for filtered in (True, False):
        assert pts(axis.correct_axis_labels(lab, filtered), "px", "value") == [(0, 100), (10, 75), (20, 50), (30, 25), (40, 0)]


def test_map_round_trip(spark):
    cal = spark.createDataFrame([(1, 10, 210, 110, 10, 0.0, 20.0, 0.0, 100.0)], "image_id long, " + ", ".join(f"{n} int" for n in axis.CAL[:4]) + ", " + ", ".join(f"{n} double" for n in axis.CAL[4:]))
    p = cells(spark, [(10, 110), (110, 60), (210, 10)])
    data = axis.px_to_data(p, cal)
    assert pts(data) == [(0, 0), (10, .5), (20, 1)]
    assert pts(axis.data_to_px(data, cal).where("px = x and py = y"), "x") == [(10,), (110,), (210,)]


# -- pixels, masks, components ---------------------------------------------------------------------

def flood(points):
    left, out = set(points), {}
    while left:
        seed = min(left, key=lambda p: (p[1], p[0]))
        todo = [seed]
        left.discard(seed)
        while todo:
            x, y = todo.pop()
            out[(x, y)] = (seed[1] << 31) | seed[0]
            for n in [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    todo.append(n)
    return out


@pytest.mark.parametrize("tile", [512, 7])
def test_components_equal_flood_fill(spark, tile):
    rnd = random.Random(1)
    pictures = {1: {(rnd.randrange(40), rnd.randrange(40)) for _ in range(600)},
                2: {(x, y) for x in range(30) for y in range(30) if y % 2 == 0 or x == (0 if y % 4 == 1 else 29)}}
    df = spark.createDataFrame([(k, x, y) for k, ps in pictures.items() for x, y in ps], "image_id long, x int, y int")
    got = {(r["image_id"], r["x"], r["y"]): r["comp_id"] for r in runs.connected_components(df, tile=tile).collect()}
    assert got == {(k, *p): c for k, ps in pictures.items() for p, c in flood(ps).items()}


def test_two_components(spark):
    lab = runs.connected_components(cells(spark, [(0, 0), (1, 1), (5, 5)]))
    assert runs.component_stats(lab).count() == 2


def opened_loop(m):
    cross = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    out = set()
    while m:
        er = {p for p in m if all((p[0] + a, p[1] + b) in m for a, b in cross)}
        out |= m - {(x + a, y + b) for x, y in er for a, b in cross}
        m = er
    return out


def test_skeleton_equals_repeated_opening(spark):
    rnd = random.Random(2)
    m = {(x, y) for x in range(40) for y in range(25) if rnd.random() < .93}
    assert pts(masks.skeleton(cells(spark, m)), "x", "y") == sorted(opened_loop(m))


def test_bridge(spark):
    m = [(x, 5) for x in range(21)] + [(x, 6) for x in range(25, 46)]
    got = set(pts(masks.bridge_endpoints(cells(spark, m), 8), "x", "y"))
    assert got == set(m) | {(x, 5) for x in range(20, 26)}


def test_lines_removed_from_picture(spark):
    m = [(x, 20) for x in range(100)] + [(x, 40 + x // 10) for x in range(60)] + [(60, y) for y in range(2, 58)]
    im = spark.createDataFrame([(1, 100, 60)], "image_id long, width int, height int")
    d = cells(spark, m)
    h = set(pts(runs.reference_lines(d, im), "x", "y"))
    assert h == {(x, y) for x in range(100) for y in range(17, 24)}
    assert {(60, y) for y in range(2, 58)} <= set(pts(runs.reference_lines(d, im, "vertical"), "x", "y"))


def test_track_follows_two_curves(spark):
    rows = [(1, x, c) for x in range(80) for c in ([10.0] if x < 10 else [10.0 + x * .1, 10.0 + x * .5])]
    got = track(spark.createDataFrame(rows, "image_id long, x int, center double"), 2, 100, 100).where("x = 79")
    assert pts(got, "curve", "y", "present") == [(0, 17.9, True), (1, 49.5, True)]


def test_sweep_prefers_first_acceptable(spark):
    df = spark.createDataFrame([(1, 5), (2, 50)], "image_id long, v int")
    run = lambda d, limit: d.withColumn("r", F.least("v", F.lit(limit)))
    assess = lambda r, keys: r.select(*keys, (F.col("r") / 50).alias("confidence"), (F.col("r") >= 20).alias("acceptable"))
    got = choose.sweep(df, [{"limit": 10}, {"limit": 40}, {"limit": 60}], run, assess)
    assert pts(got, "image_id", "setting") == [(1, 0), (2, 1)]


# -- files -----------------------------------------------------------------------------------------

def png(path, rgb_rows):
    h, w = len(rgb_rows), len(rgb_rows[0])
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rgb_rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_png_to_pixels(spark, tmp_path):
    white, red, dark = (255, 255, 255), (255, 0, 0), (10, 20, 30)
    png(tmp_path / "a.png", [[white, red, white], [dark, white, white]])
    png(tmp_path / "B.PNG", [[white, white]])
    assert sorted(r["path"].split("/")[-1] for r in files.scan_images(spark, str(tmp_path)).collect()) == ["B.PNG", "a.png"]
    images = files.read_images(spark, str(tmp_path)).where("image_id like '%a.png'")
    px = pixels.with_hsv(files.read_pixels(images))
    assert pts(px, "x", "y", "b", "g", "r") == [(0, 1, 30, 20, 10), (1, 0, 0, 0, 255)]
    assert pts(px.where("x = 1"), "h", "s", "v") == [(0, 255, 255)]
    assert pts(files.read_pixels(images, bounds=(0, 1, 3, 1)), "x", "y") == [(0, 1)]


def test_column_overlap_rules(spark):
    cols = {0: [10], 1: [10, 12], 2: [10, 60, 61, 62, 63], 3: [12, 13, 14, 15, 45, 46, 47], 4: [2, 3, 90], 5: [20, 30, 31, 32], 6: [20, 21, 22, 23, 40]}
    df = spark.createDataFrame([(1, "blue", x, y) for x, ys in cols.items() for y in ys], "image_id long, color string, x int, y int")
    got = {r["x"]: (r["y"], r["rule"]) for r in pixels.column_overlap_rules(df, 100).collect()}
    assert got == {0: (10, "single"), 1: (10, "cluster"), 2: (60, "cross_above"), 3: (45, "gap_skip_text_top"), 4: (90, "noise_filtered_top_text"),
                   5: (30, "continuity_bottom"), 6: (20, "cross_below")}


def test_extend_plateau(spark):
    rows = [(1, "dashed", x, 20.0 + (5.0 if x == 45 else 0)) for x in range(50)] + [(1, "solid", x, 60.0) for x in range(80)]
    got = clean.extend_plateau(spark.createDataFrame(rows, "image_id long, style string, x int, y double"))
    up = {r["x"]: (r["y"], r["present"]) for r in got.where("style = 'dashed'").collect()}
    assert up[45] == (20.0, True) and up[60] == (20.0, False) and max(up) == 79


@pytest.mark.parametrize("sized", [False, True])
def test_rectangles_equal_offsets(spark, sized):
    """Morphology by stretches against every offset of the kernel."""
    from curvekit.operators import masks

    rnd = random.Random(4)
    size = {1: (9, 7), 2: (5, 12)}
    cells = {(i, x, y) for i, (w, h) in size.items() for x in range(w) for y in range(h) if rnd.random() < 0.8}
    df = spark.createDataFrame(sorted(cells), "image_id int, x int, y int")
    images = spark.createDataFrame([(i, *s) for i, s in size.items()], "image_id int, width int, height int") if sized else None
    for w, h in ((3, 3), (1, 4), (5, 2)):
        kernel = masks.rect(w, h)
        spots = [(i, x, y) for i in size for x in range(-6, 20) for y in range(-6, 20)]
        inside = lambda i, x, y: x >= 0 and y >= 0 and (not sized or (x < size[i][0] and y < size[i][1]))
        wide = {p for p in spots if inside(*p) and any((p[0], p[1] + dx, p[2] + dy) in cells for dx, dy in kernel)}
        narrow = {p for p in spots if inside(*p) and all((q := (p[0], p[1] + dx, p[2] + dy)) in cells or sized and not inside(*q) for dx, dy in kernel)}
        assert {tuple(r) for r in masks.dilate(df, kernel, images=images).collect()} == wide
        assert {tuple(r) for r in masks.erode(df, kernel, images=images).collect()} == narrow
