"""Queries of the pixel predicates and aggregates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.color import CLASSES, NAMED
from ..operators import pixels as p
from . import raster as r
from . import views as v
from .base import query, table
from .clean import with_

PX = with_(r.PIXELS)
PXI = with_(r.PIXELS, r.IMAGES)


def box(spec: dict) -> str:
    hue = " OR ".join(f"h BETWEEN {a} AND {b}" for a, b in spec["hues"])
    return (f"(({hue}) AND s BETWEEN {spec.get('s_min', 0)} AND {spec.get('s_max', 255)} "
            f"AND v BETWEEN {spec.get('v_min', 0)} AND {spec.get('v_max', 255)})")


@query("p01_with_hsv", PX + "SELECT * FROM pixels")
def p01(spark, sf):
    return r.pixels(spark, sf)


@query("p02_color_mask", PX + f"SELECT image_id, x, y, 'red' AS color FROM pixels WHERE {box(NAMED['red'])} UNION ALL SELECT image_id, x, y, 'black' FROM pixels WHERE {box(NAMED['black'])}")
def p02(spark, sf):
    px = r.pixels(spark, sf)
    red, black = (p.color_mask(px, n).select("image_id", "x", "y", F.lit(n).alias("color")) for n in ("red", "black"))
    return red.unionByName(black)


@query("p03_classify_color", PX + " UNION ALL ".join(f"SELECT image_id, x, y, '{n}' AS color FROM pixels WHERE {box(s)}" for n, s in CLASSES.items()))
def p03(spark, sf):
    return p.classify_color(r.pixels(spark, sf)).select("image_id", "x", "y", "color")


@query("p04_hue_to_name", PX + """SELECT image_id, x, y, CASE WHEN h < 8 OR h >= 165 THEN 'red' WHEN h < 25 THEN 'orange' WHEN h < 35 THEN 'yellow' WHEN h < 85 THEN 'green'
    WHEN h < 100 THEN 'cyan' WHEN h < 130 THEN 'blue' WHEN h < 150 THEN 'purple' ELSE 'magenta' END AS name FROM pixels""")
def p04(spark, sf):
    from ..functions.color import hue_name
    return r.pixels(spark, sf).select("image_id", "x", "y", hue_name(F.col("h")).alias("name"))


@query("p05_in_plot", with_(r.PIXELS, r.BOUNDS) + """SELECT image_id, x, y FROM pixels JOIN bounds USING (image_id)
    WHERE x BETWEEN px - 5 AND px + pw + 5 AND y BETWEEN py - 5 AND py + ph + 5""")
def p05(spark, sf):
    return p.in_plot(r.pixels(spark, sf), r.bounds(spark, sf), 5).select("image_id", "x", "y")


@query("p06_drop_zones", PXI + """SELECT image_id, x, y FROM pixels JOIN images USING (image_id) WHERE NOT (
    (x >= floor(width * 0.15e0) AND x < floor(width * 1e0) AND y >= 0 AND y < floor(height * 0.2e0)) OR (x >= floor(width * 0.35e0) AND x < floor(width * 1e0) AND y >= 0 AND y < floor(height * 0.35e0)))
    AND x >= 15 AND x < width - 5 AND y < height - 20""")
def p06(spark, sf):
    im = r.images(spark, sf)
    return p.drop_margins(p.drop_zones(r.pixels(spark, sf), im), im).select("image_id", "x", "y")


@query("p07_dark_pixels", PX + "SELECT image_id, x, y, 1 AS mode FROM pixels WHERE gray < 60 UNION ALL SELECT image_id, x, y, 2 FROM pixels WHERE b < 60 AND g < 60 AND r < 60")
def p07(spark, sf):
    px = r.pixels(spark, sf)
    return p.dark_pixels(px, 60).select("image_id", "x", "y", F.lit(1).alias("mode")).unionByName(
        p.dark_pixels(px, 60, channels=True).select("image_id", "x", "y", F.lit(2).alias("mode")))


BELL = "bell AS (SELECT * FROM (VALUES " + ", ".join(f"({i - 7}, {v!r}::DOUBLE)" for i, v in enumerate(p.gaussian_weights(15))) + ") v(d, w))"


@query("p08_adaptive_dark", PX + ", " + BELL + """, near AS (SELECT a.image_id, a.x, a.y, any_value(a.gray) AS gray, sum(bx.w * by_.w * (255 - b.gray)) AS n FROM pixels a JOIN pixels b
    ON a.image_id = b.image_id AND b.x BETWEEN a.x - 7 AND a.x + 7 AND b.y BETWEEN a.y - 7 AND a.y + 7 JOIN bell bx ON bx.d = b.x - a.x JOIN bell by_ ON by_.d = b.y - a.y GROUP BY 1, 2, 3)
    SELECT image_id, x, y FROM near WHERE gray <= 255 - n - 10""")
def p08_gaussian(spark, sf):
    return p.adaptive_dark(r.pixels(spark, sf)).select("image_id", "x", "y")


@query("p08_adaptive_dark_even", PX + """, near AS (SELECT a.image_id, a.x, a.y, any_value(a.gray) AS gray, sum(255 - b.gray) AS n FROM pixels a JOIN pixels b
    ON a.image_id = b.image_id AND b.x BETWEEN a.x - 7 AND a.x + 7 AND b.y BETWEEN a.y - 7 AND a.y + 7 GROUP BY 1, 2, 3)
    SELECT image_id, x, y FROM near WHERE gray <= 255 - n / 225 - 10""")
def p08(spark, sf):
    return p.adaptive_dark(r.pixels(spark, sf), weights="even").select("image_id", "x", "y")


@query("p09_remove_colors", PX + "SELECT image_id, x, y FROM pixels WHERE NOT (((h < 10 OR h > 170) AND s > 50 AND v > 50) OR (h BETWEEN 100 AND 130 AND s > 50 AND v > 50))")
def p09(spark, sf):
    return p.remove_colors(r.pixels(spark, sf), ["red", "blue"]).select("image_id", "x", "y")


@query("p10_isolate_color", PX + "SELECT image_id, x, y FROM pixels WHERE s < 50 AND v >= 80 AND v < 180")
def p10(spark, sf):
    return p.isolate_color(r.pixels(spark, sf), "gray").select("image_id", "x", "y")


@query("p10_isolate_curve", PX + """SELECT image_id, x, y FROM pixels WHERE NOT (((h < 10 OR h > 170) AND s > 50 AND v > 50) OR (h BETWEEN 35 AND 85 AND s > 50 AND v > 50))
    AND 255 - least(b, g, r) > 200 AND (DIFF_ * CAST(round_even(1044480e0 / greatest(255 - least(b, g, r), 1), 0) AS INTEGER) + 2048) // 4096 < 50""".replace("DIFF_", "(greatest(b, g, r) - least(b, g, r))"))
def p10b(spark, sf):
    return p.isolate_curve(r.pixels(spark, sf), "black", ["red", "green", "gray"]).select("image_id", "x", "y")


@query("p11_invert", PX + "SELECT image_id, x, y, 255 - b AS b, 255 - g AS g, 255 - r AS r FROM pixels")
def p11(spark, sf):
    return p.invert(r.raw(spark, sf))


@query("p12_content_bbox", PXI + """SELECT image_id, coalesce(greatest(0, a - 5), 0) AS x1, coalesce(least(width, b + 6), width) AS x2, coalesce(greatest(0, c - 5), 0) AS y1,
    coalesce(least(height, d + 6), height) AS y2 FROM images LEFT JOIN (SELECT image_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM pixels WHERE gray < 100 GROUP BY 1) USING (image_id)""")
def p12(spark, sf):
    return p.content_bbox(r.pixels(spark, sf), r.images(spark, sf), white=100)


@query("p13_image_profile", PXI + """SELECT image_id, width, height, coalesce(ss, 0) / (width * height) < 30 AS grayscale, coalesce(k, 0) / (width * height) * 100 AS colored_pct,
    width / height AS aspect, CASE WHEN width / height > 1.5e0 THEN 'wide' WHEN width / height < 0.8e0 THEN 'tall' ELSE 'standard' END AS shape
    FROM images LEFT JOIN (SELECT image_id, sum(s) AS ss, count(*) FILTER (s > 50) AS k FROM pixels GROUP BY 1) USING (image_id)""", "colored_pct aspect")
def p13(spark, sf):
    return p.image_profile(r.pixels(spark, sf), r.images(spark, sf))


@query("p14_is_grayscale", PXI + """SELECT image_id, coalesce(ss, 0) / (width * height) < 30 AS grayscale
    FROM images LEFT JOIN (SELECT image_id, sum(s) AS ss FROM pixels GROUP BY 1) USING (image_id)""")
def p14(spark, sf):
    return p.is_grayscale(r.pixels(spark, sf), r.images(spark, sf))


PEAKS = """hist AS (SELECT image_id, least(h // 5, 35) AS bin, count(*) AS n FROM pixels WHERE s > 40 AND v > 40 AND v < 250 GROUP BY 1, 2),
    pk AS (SELECT a.image_id, a.n, a.bin * 5 + 2.5e0 AS hue FROM hist a LEFT JOIN hist l ON l.image_id = a.image_id AND l.bin = a.bin - 1 LEFT JOIN hist q ON q.image_id = a.image_id AND q.bin = a.bin + 1
        WHERE a.n > {mp} AND a.n >= coalesce(l.n, 0) AND a.n >= coalesce(q.n, 0)),
    mg AS (SELECT image_id, list_reduce(list({{'n': n, 'hue': hue}} ORDER BY n DESC, hue DESC), lambda a, p: CASE WHEN len(list_filter(a, lambda q:
        least(abs(q.hue - p.hue), 180 - abs(q.hue - p.hue)) < 15)) > 0 THEN a ELSE list_append(a, p) END, CAST([] AS STRUCT(n BIGINT, hue DOUBLE)[]))[1:{mc}] AS peaks
        FROM pk WHERE image_id IN (SELECT image_id FROM hist GROUP BY 1 HAVING sum(n) >= {mp}) GROUP BY 1)"""


@query("p15_is_color", with_(r.PIXELS, r.IMAGES, PEAKS.format(mp=50, mc=4)) + """, c AS (SELECT image_id, coalesce(k, 0) / (width * height) AS ratio FROM images LEFT JOIN
    (SELECT image_id, count(*) FILTER (s > 50 AND v > 30 AND v < 250) AS k FROM pixels GROUP BY 1) USING (image_id))
    SELECT image_id, ratio, ratio > 0.3e0 OR (ratio > 0.001e0 AND coalesce(len(peaks) >= 2, false)) AS is_color FROM c LEFT JOIN mg USING (image_id)""", "ratio")
def p15(spark, sf):
    return p.is_color(r.pixels(spark, sf), r.images(spark, sf), threshold=0.3)


@query("p16_difficult_colors", PX + "SELECT image_id, count(*) FILTER (gray < 80 AND s < 50) AS dark, count(*) FILTER (gray < 80 AND s < 50) > 500 AS difficult FROM pixels GROUP BY 1")
def p16(spark, sf):
    return p.difficult_colors(r.pixels(spark, sf))


COUNTS = dict(cyan="h BETWEEN 80 AND 100", blue="h BETWEEN 100 AND 130", purple="h BETWEEN 130 AND 160", magenta="h BETWEEN 160 AND 175", red="(h <= 10 OR h >= 175)",
              orange="h BETWEEN 10 AND 25", green="h BETWEEN 35 AND 80")


@query("p17_color_counts", PX + "SELECT *, " + " + ".join(f"CAST({k} >= {1000 if k in ('black', 'gray') else 200} AS INTEGER)" for k in [*COUNTS, "black", "gray"])
       + " AS curves FROM (SELECT image_id, " + ", ".join(f"count(*) FILTER (s > 30 AND v > 50 AND v < 250 AND {q}) AS {k}" for k, q in COUNTS.items())
       + ", count(*) FILTER (gray < 80 AND s < 50) AS black, count(*) FILTER (gray >= 80 AND gray < 180 AND s < 50) AS gray FROM pixels GROUP BY 1)")
def p17(spark, sf):
    return p.color_counts(r.pixels(spark, sf), 200)


@query("a01_hue_histogram", PX + "SELECT image_id, least(h // 5, 35) AS bin, count(*) AS n FROM pixels WHERE s > 40 AND v > 40 AND v < 250 GROUP BY 1, 2")
def a01(spark, sf):
    return p.hue_histogram(r.pixels(spark, sf))


PALETTE = PEAKS.format(mp=30, mc=4) + """, pa AS (SELECT image_id, u.hue AS hue, u.n AS pixel_count, CASE WHEN u.hue BETWEEN 85 AND 100 THEN 10 WHEN u.hue BETWEEN 145 AND 170 THEN 12 ELSE 15 END AS w,
        u.hue BETWEEN 85 AND 100 AS cy, u.hue BETWEEN 145 AND 170 AS pu FROM (SELECT image_id, unnest(peaks) AS u FROM mg)),
    pb AS (SELECT image_id, hue, pixel_count, CASE WHEN hue < w THEN 0 ELSE CAST(floor(greatest(0e0, hue - w)) AS INTEGER) END AS lo, CASE WHEN hue > 180 - w THEN 180 ELSE CAST(floor(least(180e0, hue + w)) AS INTEGER) END AS hi,
        CASE WHEN cy OR pu THEN 30 ELSE 20 END AS s_min, CASE WHEN cy THEN 60 ELSE 50 END AS v_min FROM pa),
    pc AS (SELECT b.image_id, CASE WHEN hue < 8 OR hue >= 165 THEN 'red' WHEN hue < 25 THEN 'orange' WHEN hue < 35 THEN 'yellow' WHEN hue < 85 THEN 'green' WHEN hue < 100 THEN 'cyan' WHEN hue < 130 THEN 'blue'
        WHEN hue < 150 THEN 'purple' ELSE 'magenta' END AS name, hue, lo, hi, s_min, v_min, coalesce(CAST(floor(avg(x.r)) AS INTEGER), 0) AS mean_r, coalesce(CAST(floor(avg(x.g)) AS INTEGER), 0) AS mean_g,
        coalesce(CAST(floor(avg(x.b)) AS INTEGER), 0) AS mean_b, pixel_count FROM pb b LEFT JOIN pixels x ON x.image_id = b.image_id AND x.h BETWEEN lo AND hi AND x.s >= s_min AND x.v >= v_min
        GROUP BY b.image_id, hue, lo, hi, s_min, v_min, pixel_count)"""


@query("a02_detect_palette", with_(r.PIXELS, PALETTE) + "SELECT * FROM pc")
def a02(spark, sf):
    return p.detect_palette(r.pixels(spark, sf), 30)


@query("a03_gray_fallback", with_(r.PIXELS, PALETTE) + """, st AS (SELECT image_id, count(*) AS k, bool_or(pixel_count < 300) AS weak FROM pc GROUP BY 1),
    gr AS (SELECT image_id, count(*) FILTER (s <= 40 AND v > 80 AND v < 180) AS n, avg(v) FILTER (s <= 40 AND v > 80 AND v < 180) AS av, CAST(floor(avg(r) FILTER (s <= 40 AND v BETWEEN 80 AND 180)) AS INTEGER) AS mean_r,
        CAST(floor(avg(g) FILTER (s <= 40 AND v BETWEEN 80 AND 180)) AS INTEGER) AS mean_g, CAST(floor(avg(b) FILTER (s <= 40 AND v BETWEEN 80 AND 180)) AS INTEGER) AS mean_b FROM pixels GROUP BY 1),
    ad AS (SELECT gr.* FROM gr LEFT JOIN st USING (image_id) WHERE (coalesce(k, 0) < 4 OR weak) AND n >= 60 AND av BETWEEN 100 AND 170)
    SELECT * FROM pc WHERE NOT (pixel_count < 300 AND image_id IN (SELECT image_id FROM ad)) UNION ALL
    SELECT image_id, 'gray', 0e0, 0, 180, 0, 80, mean_r, mean_g, mean_b, n FROM ad""")
def a03(spark, sf):
    px = r.pixels(spark, sf)
    return p.gray_fallback(px, p.detect_palette(px, 30), 30)


DARKS = "darks AS (SELECT image_id, x, y FROM pixels WHERE gray < 90)"
PXD = with_(r.PIXELS, DARKS)


def darks(spark, sf):
    return p.dark_pixels(r.pixels(spark, sf), 90).select("image_id", "x", "y")


@query("a04_column_pick", PXD + "SELECT image_id, x, CAST(floor(median(y)) AS INTEGER) AS y FROM darks GROUP BY 1, 2")
def a04(spark, sf):
    return p.column_pick(darks(spark, sf))


@query("a05_column_top", PXD + "SELECT image_id, x, min(y) AS y FROM darks GROUP BY 1, 2")
def a05(spark, sf):
    return p.column_top(darks(spark, sf))


PICK = """cols AS (SELECT image_id, x, min(y) AS lo, CAST(floor(median(y)) AS INTEGER) AS med, count(*) AS n FROM darks GROUP BY 1, 2),
    f AS (SELECT image_id, list_reduce(list({{'x': x, 'lo': lo, 'med': med, 'n': n, 'y': 0}} ORDER BY x), lambda a, c: list_append(a, {{'x': c.x, 'lo': c.lo, 'med': c.med, 'n': c.n,
        'y': CASE WHEN c.n <= 3 THEN c.med {arms} END}}), CAST([] AS STRUCT(x INTEGER, lo INTEGER, med INTEGER, n BIGINT, y INTEGER)[])) AS r FROM cols GROUP BY 1)
    SELECT image_id, u.x AS x, u.y AS y FROM (SELECT image_id, unnest(r) AS u FROM f)"""


@query("a06_column_pick_continuous", PXD[:-1] + ", " + PICK.format(arms="WHEN len(a) > 0 AND abs(c.lo - a[-1].y) > 20 THEN c.med ELSE c.lo"))
def a06(spark, sf):
    return p.column_pick_continuous(darks(spark, sf))


NEAREST_ARMS = """WHEN len(a) = 0 THEN c.lo WHEN CASE WHEN c.lo >= a[-1].y - 5 THEN abs(c.lo - a[-1].y) ELSE 1000 END
        <= CASE WHEN c.med >= a[-1].y - 5 THEN abs(c.med - a[-1].y) ELSE 1000 END THEN c.lo ELSE c.med"""


@query("a07_column_pick_nearest", PXD[:-1] + ", " + PICK.format(arms=NEAREST_ARMS))
def a07(spark, sf):
    return p.column_pick_nearest(darks(spark, sf))


FIRST_CLASS = "classed AS (SELECT * FROM (SELECT image_id, x, y, CASE " + " ".join(f"WHEN {box(s)} THEN '{n}'" for n, s in CLASSES.items()) + " END AS color FROM pixels) WHERE color IS NOT NULL)"


@query("a08_column_overlap_rules", with_(r.PIXELS, FIRST_CLASS) + """, o0 AS (SELECT image_id, color, x, list_sort(list(DISTINCT y)) AS ys, len(ys) AS n, list_filter(range(1, n), lambda i: ys[i + 1] - ys[i] > 3)[1] AS g3,
        list_filter(range(1, n), lambda i: ys[i + 1] - ys[i] > 5)[1] AS g5 FROM classed GROUP BY 1, 2, 3),
    o1 AS (SELECT *, ys[1] AS top, ys[g3 + 1] AS low, ys[g3 + 1] - ys[g3] AS gap, 1 - ys[1] / 50e0 AS ts, 1 - ys[g3 + 1] / 50e0 AS bs FROM o0),
    o2 AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN ys[-1] - top < 5 THEN 'cluster' WHEN color = 'gray' THEN CASE WHEN ts > 0.98e0 AND g5 IS NOT NULL THEN 'gray_skip_top_noise' ELSE 'gray_topmost' END
        WHEN g3 IS NULL THEN 'topmost'
        WHEN gap > 25 THEN CASE WHEN ts > 0.9e0 AND bs > 0.05e0 AND bs < 0.5e0 THEN 'noise_filtered_top_text'
            WHEN ts > 0.9e0 AND bs <= 0.05e0 THEN CASE WHEN g3 > 3 THEN 'high_survival_curve' WHEN n - g3 > 3 THEN 'low_survival_curve' ELSE 'gap_top_both_sparse' END
            WHEN ts > 0.5e0 AND ts <= 0.9e0 AND bs < 0.3e0 THEN 'noise_filtered_bottom' WHEN bs > 0.5e0 AND ts > 0.95e0 THEN 'noise_filtered_top' ELSE 'gap_top' END
        WHEN g3 <= 2 AND n - g3 >= 4 THEN 'cross_above' WHEN n - g3 <= 2 AND g3 >= 4 THEN 'cross_below' WHEN gap > 20 AND ts > 0.85e0 THEN 'gap_skip_text_top' WHEN gap > 20 THEN 'gap' ELSE 'near' END AS rule FROM o1),
    o3 AS (SELECT image_id, color, x, rule, top, low, CASE WHEN rule IN ('gap', 'near') THEN NULL WHEN rule = 'gray_skip_top_noise' THEN ys[g5 + 1]
        WHEN rule IN ('noise_filtered_top_text', 'low_survival_curve', 'noise_filtered_top', 'cross_above', 'gap_skip_text_top') THEN low ELSE top END AS y FROM o2),
    o4 AS (SELECT image_id, color, list_reduce(list({'x': x, 'y': y, 'rule': rule, 'top': top, 'low': low} ORDER BY x), lambda a, c: list_append(a, CASE WHEN c.y IS NOT NULL THEN c
        WHEN len(a) = 0 THEN {'x': c.x, 'y': c.top, 'rule': CASE c.rule WHEN 'gap' THEN 'gap_prefer_top' ELSE 'default_top' END, 'top': c.top, 'low': c.low}
        WHEN abs(c.top - a[-1].y) > abs(c.low - a[-1].y) THEN {'x': c.x, 'y': c.low, 'rule': CASE c.rule WHEN 'gap' THEN 'gap_' ELSE '' END || 'continuity_bottom', 'top': c.top, 'low': c.low}
        ELSE {'x': c.x, 'y': c.top, 'rule': CASE c.rule WHEN 'gap' THEN 'gap_' ELSE '' END || 'continuity_top', 'top': c.top, 'low': c.low} END),
        list_filter(list({'x': x, 'y': y, 'rule': rule, 'top': top, 'low': low}), lambda c: false)) AS f FROM o3 GROUP BY 1, 2)
    SELECT image_id, color, u.x AS x, u.y AS y, u.rule AS rule FROM (SELECT image_id, color, unnest(f) AS u FROM o4)""")
def a08(spark, sf):
    px = p.classify_color(r.pixels(spark, sf), first_only=True)
    return p.column_overlap_rules(px, 50)


@query("a09_density", PXD + "SELECT image_id, 'row' AS axis, y AS line, count(*) AS n FROM darks GROUP BY 1, 3 UNION ALL SELECT image_id, 'col', x, count(*) FROM darks GROUP BY 1, 3")
def a09(spark, sf):
    d = darks(spark, sf)
    return p.row_density(d).select("image_id", F.lit("row").alias("axis"), F.col("y").alias("line"), "n").unionByName(
        p.col_density(d).select("image_id", F.lit("col").alias("axis"), F.col("x").alias("line"), "n"))


@query("a09_dense_bands", with_(r.PIXELS, r.IMAGES, DARKS) + """SELECT image_id, band, n AS rows FROM (SELECT image_id, band, count(DISTINCT y) AS n FROM
    (SELECT image_id, y, CAST(unnest(range(greatest(x - 3, 0), x + 1)) AS INTEGER) AS band FROM darks) GROUP BY 1, 2) JOIN images USING (image_id) WHERE n > height * 0.3e0""")
def a09b(spark, sf):
    return p.dense_bands(darks(spark, sf), r.images(spark, sf))


@query("a10_edges", PXD + "".join(f"""{u}SELECT image_id, '{n}' AS side, CAST(floor(median({c})) AS INTEGER) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {c}) AS rn,
    count(*) OVER (PARTITION BY image_id) AS k FROM (SELECT DISTINCT image_id, {c} FROM darks)) WHERE rn <= greatest(1, k // 20) GROUP BY 1""" for n, c, u in (("top", "y", ""), ("left", "x", " UNION ALL "))))
def a10(spark, sf):
    d = darks(spark, sf)
    return p.first_edge(d, "y").select("image_id", F.lit("top").alias("side"), "edge").unionByName(
        p.first_edge(d, "x").select("image_id", F.lit("left").alias("side"), "edge"))


CAL = """cal AS (SELECT CAST(n_nationkey AS BIGINT) AS image_id, CAST(10 + n_nationkey AS INTEGER) AS x_0_pixel, CAST(80 + n_nationkey * 2 AS INTEGER) AS x_max_pixel, 50 AS y_0_pixel, 2 AS y_100_pixel,
    0e0 AS time_min, 20e0 + n_nationkey AS time_max FROM nation)"""


def calibration(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        n.cast("bigint").alias("image_id"), (10 + n).cast("int").alias("x_0_pixel"), (80 + n * 2).cast("int").alias("x_max_pixel"), F.lit(50).alias("y_0_pixel"),
        F.lit(2).alias("y_100_pixel"), F.lit(0.0).alias("time_min"), (n + F.lit(20.0)).alias("time_max"))


@query("a11_curve_extent", with_(r.PIXELS, DARKS, CAL) + """, m AS (SELECT cal.*, least(ceil((time_min + (greatest(m, x_0_pixel) - x_0_pixel) / (x_max_pixel - x_0_pixel) * (time_max - time_min)) * 2) / 2, time_max) AS t
    FROM cal LEFT JOIN (SELECT image_id, max(x) AS m FROM darks GROUP BY 1) USING (image_id))
    SELECT image_id, t AS t_end, t < time_max * 0.95e0 AS applied, CASE WHEN t < time_max * 0.95e0 THEN t ELSE time_max END AS time_max FROM m""", "t_end time_max")
def a11(spark, sf):
    return p.curve_extent(darks(spark, sf), calibration(spark, sf))


@query("a12_rank_curves", with_(v.TRACED) + """, g AS (SELECT curve_id % 10 AS image_id, curve_id, count(*) AS n, round(count(*) * 0.4e0 + (max(x) - min(x)) / 500e0 * 1000 * 0.3e0 + (max(y) - min(y)) / 300e0 * 1000 * 0.3e0, 9) AS score
    FROM traced GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, curve_id) AS INTEGER) AS rn FROM g) WHERE rn <= 3""", "score")
def a12(spark, sf):
    return p.rank_curves(v.traced(spark, sf).withColumn("image_id", F.col("curve_id") % 10), 3, 500.0, 300.0)


@query("a13_tail_bands", with_(r.PIXELS, r.IMAGES, DARKS) + """, b AS (SELECT image_id, height, y - y % 10 AS band, count(*) AS n FROM darks JOIN images USING (image_id) WHERE x >= floor(width * 0.5e0) GROUP BY 1, 2, 3),
    c AS (SELECT *, n * CASE WHEN band BETWEEN floor(height * 0.65e0) AND floor(height * 0.85e0) THEN 2 ELSE 1 END AS sc FROM b WHERE n >= 10 AND band >= height * 0.1e0 AND band < 45 - 3 AND band >= height * 0.5e0)
    SELECT image_id, band, n, sc AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY sc DESC, band) AS rn FROM c) WHERE rn = 1""")
def a13(spark, sf):
    im = r.images(spark, sf)
    return p.tail_bands(darks(spark, sf), im, im.select("image_id", F.lit(45).alias("level")), tail=0.5)


@query("a14_mode_y", with_(v.TRACED) + """SELECT curve_id, CAST(y AS INTEGER) AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY n DESC, y) AS rn FROM
    (SELECT curve_id, y, count(*) AS n FROM traced WHERE x >= 50 AND x < 450 GROUP BY 1, 2)) WHERE rn = 1""")
def a14(spark, sf):
    return p.mode_y(v.traced(spark, sf), x_from=50, x_to=450)


@query("a15_percentile_threshold", PX + "SELECT image_id, quantile_cont(gray, 0.3) AS threshold FROM pixels GROUP BY 1", "threshold")
def a15(spark, sf):
    return p.percentile_threshold(r.pixels(spark, sf))


@query("a16_infer_axis_max", """WITH s AS (SELECT DISTINCT o_custkey % 300 AS image_id, CAST(floor(o_totalprice / 9000e0) AS INTEGER) * 3 + 9 AS v FROM orders),
    g AS (SELECT image_id, list_sort(list(v)) AS l FROM s WHERE v > 0 AND v <= 100 GROUP BY 1),
    h AS (SELECT *, (l[2] - l[1]) * 20 AS more FROM g)
    SELECT image_id, CAST(CASE WHEN len(l) >= 3 AND l[-1] < l[len(l) // 2 + 1] * 1.5e0 AND l[2] - l[1] > 0 AND more > l[-1] AND more <= 100 THEN more ELSE l[-1] END AS DOUBLE) AS time_max FROM h""")
def a16(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 300).alias("image_id"), (F.floor(F.col("o_totalprice") / 9000.0) * 3 + 9).alias("value"), F.lit(600).alias("pw"))
    return p.infer_axis_max(o, plot_w="pw")


@query("a17_distinct_times", with_(v.MANY) + "SELECT curve_id, array_to_string(list_sort(list(DISTINCT CAST(t AS INTEGER))), ',') AS times FROM many GROUP BY 1")
def a17(spark, sf):
    m = v.many(spark, sf).withColumn("t", F.col("t").cast("int"))
    return p.distinct_times(m, "curve_id").withColumn("times", F.array_join("times", ","))


@query("a18_split_by_column_mean", PXD + """SELECT image_id, x, y, CASE WHEN n < 2 OR y < m THEN 'upper' ELSE 'lower' END AS part FROM
    (SELECT *, avg(y) OVER (PARTITION BY image_id, x) AS m, count(*) OVER (PARTITION BY image_id, x) AS n FROM darks)""")
def a18(spark, sf):
    return p.split_by_column_mean(darks(spark, sf))


@query("a19_curve_summary", with_(v.NOISY) + "SELECT curve_id, count(*) AS points, min(t) AS t_from, max(t) AS t_to, min(s) AS s_from, max(s) AS s_to FROM noisy GROUP BY 1", "t_from t_to s_from s_to")
def a19(spark, sf):
    return p.curve_summary(v.noisy(spark, sf))
