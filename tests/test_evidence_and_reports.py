"""Evidence for dashed lines against plain Python, and the two report forms line by line."""
import statistics

import numpy as np

from curvekit.operators import joins, pairs, quality, reports


def plain_evidence(path, gray, px, pw, width, height):
    """The same evidence for one curve {x: y} over one picture {(x, y): gray}."""
    darkest = lambda x, y: min([gray[x, v] for v in range(y - 2, y + 3) if (x, v) in gray], default=255)
    inside = lambda x, y: 0 <= x < width and 0 <= y < height
    span = range(px + int(pw * 0.4), px + int(pw * 0.7))
    held = [x for x in span if x in path]
    density = None
    if len(span) >= 30 and len(held) >= 10:
        level = path[held[-1]]
        density = sum(inside(x, level) and darkest(x, level) < 150 for x in span) / len(span) if 3 <= level < height - 3 else 0.0
    xs = sorted(path)
    xs = xs[len(xs) // 4:int(len(xs) * 0.85)] if len(xs) >= 50 else []
    seen = [darkest(x, path[x]) for x in xs[::max(1, len(xs) // 200)] if inside(x, path[x])] if len(xs) >= 30 else []
    if len(seen) < 30:
        return density, 0.0, 0, 0.0
    text = "".join("d" if v < np.percentile(seen, 30) else "." for v in seen)
    closed = text[1:].rsplit("d", 1)[0] + "d" if "d" in text[1:] else ""
    gaps = [len(g) for g in closed.split("d") if len(g) >= 2]
    cv = statistics.pstdev(gaps) / statistics.mean(gaps) if len(gaps) >= 3 else 1
    return density, text.count(".") / len(text), len(gaps), max(0.0, 1 - cv)


def test_dash_evidence(spark):
    rng = np.random.default_rng(8)
    traced, pixels, want = [], [], {}
    for image in range(4):
        gray = {}
        for curve in (0, 1):
            path = {x: (20 if curve else 60) + x // 40 for x in range(300) if rng.random() < 0.95}
            if image == 3 and curve:
                path = dict(list(path.items())[:40])  # too few columns
            for x, y in path.items():
                if curve == 0 or image == 2 or x % (12 + image) < 8:
                    gray[x, y] = int(rng.integers(0, 120))
            traced += [(image, curve, x, y) for x, y in path.items()]
            want[image, curve] = path
        pixels += [(image, x, y, g) for (x, y), g in gray.items()]
        for curve in (0, 1):
            want[image, curve] = plain_evidence(want[image, curve], gray, 0, 300, 300, 100)
    traced += [(0, 0, None, 5), (0, 0, 4, None), (9, 0, 1, 1)]  # null positions, and a curve without picture
    sized = spark.createDataFrame([(i, 0, 300, 300, 100) for i in range(4)], "image_id int, px int, pw int, width int, height int")
    frame = spark.createDataFrame(traced, "image_id int, curve_id int, x int, y int")
    found = pairs.dash_evidence(frame, spark.createDataFrame(pixels, "image_id int, x int, y int, gray int"), sized.drop("width", "height"), sized.drop("px", "pw"))
    got = {(r["image_id"], r["curve_id"]): r for r in found.collect()}
    assert set(got) == set(want) | {(9, 0)} and got[9, 0]["density"] is None and got[9, 0]["dash_score"] == 0
    for k, (density, ratio, gaps, regular) in want.items():
        r = got[k]
        assert r["n_gaps"] == gaps and abs(r["gap_ratio"] - ratio) < 1e-9 and abs(r["regularity"] - regular) < 1e-9
        assert (r["density"] is None) == (density is None) and abs((r["density"] or 0) - (density or 0)) < 1e-9
    styles = spark.createDataFrame([(i, c, "dashed" if c == 0 else "solid") for i in range(4) for c in (0, 1)] + [(9, 0, "dashed")], "image_id int, curve_id int, style string")
    said = {(r["image_id"], r["curve_id"]): (r["new_style"], r["decided_by"]) for r in pairs.relabel_by_evidence(styles, found).collect()}
    assert said[0, 1] == ("dashed", "density") and said[0, 0] == ("solid", "density") and said[1, 1] == ("dashed", "density")
    assert said[9, 0] == ("dashed", None)


def test_nearest_dark_by_brute_force(spark):
    rng = np.random.default_rng(5)
    points = [(i, int(x), int(y)) for i in (0, 1) for x, y in rng.integers(0, 40, (150, 2))]
    dark = {(i, int(x), int(y)) for i in (0, 1) for x, y in rng.integers(0, 40, (60 if i else 12, 2))}
    want = {}
    for i, x, y in points:
        near = [((a - x) ** 2 + (b - y) ** 2, b - y, a - x) for j, a, b in dark if j == i and abs(a - x) <= 8 and abs(b - y) <= 8]
        want[i, x, y] = (min(near)[0] ** 0.5, y + min(near)[1]) if near else (None, None)
    found = joins.nearest_dark(spark.createDataFrame(points, "image_id int, px int, py int"), spark.createDataFrame(sorted(dark), "image_id int, x int, y int"))
    rows = found.collect()
    assert len(rows) == len(points)
    assert all((r["dist"], r["near_y"]) == want[r["image_id"], r["px"], r["py"]] for r in rows)


def text_of(lines, image=1):
    return [r["line"] for r in lines.where(f"image_id = {image}").orderBy("image_id", *reports.ORDER).collect()]


def test_quality_report(spark):
    curves = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "image_id int, curve_id int")
    issues = spark.createDataFrame([(10, "non_monotonic", "warning", "Survival increases 2 times", None, None), (10, "sudden_drop", "error", "drop late", 9.0, 10.0), (10, "sudden_drop", "error", "drop soon", 1.0, 2.0),
                                    (12, "too_few_points", "critical", "No data points in curve", None, None), (12, "other", "error", "?", None, None)],
                                   "curve_id int, issue_type string, severity string, message string, t_lo double, t_hi double")
    lines = reports.quality_report(quality.qc_score(curves, issues).join(curves, "curve_id"), issues)
    advice = dict(reports.ADVICE)
    assert text_of(lines) == ["QUALITY CONTROL REPORT", "=" * 50, "10: FAILED (score: 22%)", "  ✗ [ERROR] drop soon", "      → " + advice["sudden_drop"], "  ✗ [ERROR] drop late", "      → " + advice["sudden_drop"],
                              "  ⚠ [WARNING] Survival increases 2 times", "      → " + advice["non_monotonic"], "11: PASSED (score: 100%)", "Overall: ISSUES DETECTED"]
    assert text_of(lines, 2)[3:6] == ["  ✗✗ [CRITICAL] No data points in curve", "      → " + reports.NO_POINTS, "  ✗ [ERROR] ?"]
    assert reports.quality_report(quality.qc_score(curves.limit(0), issues.limit(0)).join(curves, "curve_id"), issues.limit(0)).count() == 0


def test_dense_report(spark):
    match = {"summary": spark.createDataFrame([(1, 10, 40, 30, 1.5, 12, 7, 0.75), (1, 11, 0, 0, 0.0, 0, 0, None)], "image_id int, curve_id int, total int, matched int, avg_offset double, max_offset int, steps int, match_rate double"),
             "missing_steps": spark.createDataFrame([(1, 10, float(i), i + 1.0, 0.1) for i in range(7)], "image_id int, curve_id int, t_from double, t_to double, gap double"),
             "offset_regions": spark.createDataFrame([(1, 10, 3.0, -12, 1), (1, 10, 5.0, 9, 2)], "image_id int, curve_id int, t double, offset int, rank int")}
    seen = spark.createDataFrame([(1, 10, 9)], "image_id int, curve_id int, seen int")
    lines = text_of(reports.dense_report(match, seen))
    assert lines[:4] == ["=" * 60, "DENSE VALIDATION REPORT", "=" * 60, "Overall Accuracy: 75.0%"] and lines[-1] == "=" * 60
    assert lines[4:11] == ["--- 10 ---", "  Points matched: 30/40 (75.0%)", "  Average Y-offset: 1.50 pixels", "  Max Y-offset: 12.00 pixels", "  Steps detected: 7", "  Steps in original: 9", "  Missing step regions: 7"]
    assert lines[11:16] == [f"    - t={i}.0 to t={i + 1}.0 (gap of 0.100)" for i in range(5)]
    assert lines[16:19] == ["  Significant offset regions:", "    - t=3.0: offset=-12.0px (extracted above)", "    - t=5.0: offset=9.0px (extracted below)"]
    assert lines[19:21] == ["--- 11 ---", "  Points matched: 0/0 (0.0%)"]
