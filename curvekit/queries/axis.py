"""Queries of coordinate mapping and calibration."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import axis as a
from ..operators import pixels as p
from . import raster as r
from . import views as v
from .base import query, table
from .clean import with_
from .pixels import DARKS, darks

CAL = """cal AS (SELECT CAST(n_nationkey AS BIGINT) AS image_id, CAST(3 + n_nationkey AS INTEGER) AS x_0_pixel, CAST(80 + n_nationkey * 2 AS INTEGER) AS x_max_pixel, 50 AS y_0_pixel, CAST(2 + n_nationkey % 3 AS INTEGER) AS y_100_pixel,
    0e0 AS time_min, 20e0 + n_nationkey AS time_max, 0e0 AS survival_min, CASE WHEN n_nationkey % 2 = 0 THEN 100e0 ELSE 1e0 END AS survival_max FROM nation)"""


def cal(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        n.cast("bigint").alias("image_id"), (3 + n).cast("int").alias("x_0_pixel"), (80 + n * 2).cast("int").alias("x_max_pixel"), F.lit(50).alias("y_0_pixel"), (2 + n % 3).cast("int").alias("y_100_pixel"),
        F.lit(0.0).alias("time_min"), (n + F.lit(20.0)).alias("time_max"), F.lit(0.0).alias("survival_min"), F.when(n % 2 == 0, 100.0).otherwise(1.0).alias("survival_max"))


MAPPED = """mapped AS (SELECT d.image_id, x, y, time_min + (x - x_0_pixel) * ((time_max - time_min) / (x_max_pixel - x_0_pixel)) AS t,
    (survival_min + (y_0_pixel - y) * ((survival_max - survival_min) / (y_0_pixel - y_100_pixel))) / CASE WHEN survival_max > 1.5e0 THEN survival_max ELSE 1e0 END AS s FROM darks d JOIN cal USING (image_id))"""


@query("c01_px_to_data", with_(r.PIXELS, DARKS, CAL, MAPPED) + "SELECT * FROM mapped", "t s", 9)
def c01(spark, sf):
    return a.px_to_data(darks(spark, sf), cal(spark, sf))


@query("c02_data_to_px", with_(v.NOISY, CAL) + """SELECT curve_id % 25 AS image_id, curve_id, t, s, CAST(trunc(x_0_pixel + (t + 0.003e0 - time_min) / ((time_max - time_min) / (x_max_pixel - x_0_pixel))) AS INTEGER) AS px,
    CAST(trunc(y_0_pixel - (CASE WHEN survival_max > 1.5e0 THEN (s + 0.00017e0) * survival_max ELSE s + 0.00017e0 END - survival_min) / ((survival_max - survival_min) / (y_0_pixel - y_100_pixel))) AS INTEGER) AS py
    FROM noisy JOIN cal ON cal.image_id = curve_id % 25""", "t s")
def c02(spark, sf):
    n = v.noisy(spark, sf).withColumn("image_id", F.col("curve_id") % 25).withColumns({"t0": F.col("t"), "s0": F.col("s"), "t": F.col("t") + 0.003, "s": F.col("s") + 0.00017})
    return a.data_to_px(n, cal(spark, sf)).select("image_id", "curve_id", F.col("t0").alias("t"), F.col("s0").alias("s"), "px", "py")


@query("c03_clip_points", with_(r.PIXELS, DARKS, CAL, MAPPED) + "SELECT image_id, t, greatest(0e0, least(1e0, s)) AS s FROM mapped WHERE t >= 0 AND t <= 20 + 0.5e0", "t s", 9)
def c03(spark, sf):
    return a.clip_points(a.px_to_data(darks(spark, sf), cal(spark, sf)), 20.0).select("image_id", "t", "s")


@query("c04_stretching_factors", with_(CAL) + """SELECT *, (time_max - time_min) / CASE WHEN x_max_pixel <= x_0_pixel THEN 1 ELSE x_max_pixel - x_0_pixel END AS x_stretching,
    (survival_max - survival_min) / CASE WHEN y_0_pixel <= y_100_pixel THEN 1 ELSE y_0_pixel - y_100_pixel END AS y_stretching FROM (SELECT * REPLACE (CASE WHEN image_id % 6 = 0 THEN x_0_pixel ELSE x_max_pixel END AS x_max_pixel) FROM cal)""", "x_stretching y_stretching")
def c04(spark, sf):
    return a.stretching_factors(cal(spark, sf).withColumn("x_max_pixel", F.when(F.col("image_id") % 6 == 0, F.col("x_0_pixel")).otherwise(F.col("x_max_pixel"))))


RAWTEXT = """CASE k % 8 WHEN 0 THEN ' 1O ' WHEN 1 THEN '.5' WHEN 2 THEN '1,' || (100 + k % 900) WHEN 3 THEN (k % 150) || '%' WHEN 4 THEN 'Time (m)' WHEN 5 THEN 'l2' WHEN 6 THEN 'week ' || k % 60 ELSE '-' || k % 9 || '.25x' END"""
PARSED = """CASE k % 8 WHEN 0 THEN 10e0 WHEN 1 THEN 0.5e0 WHEN 2 THEN CAST(1100 + k % 900 AS DOUBLE) WHEN 3 THEN CAST(k % 150 AS DOUBLE) WHEN 5 THEN 12e0 WHEN 7 THEN -(k % 9) - 0.25e0 END"""


def number_tokens(spark, sf):
    k = F.col("c_custkey")
    s = lambda q: q.cast("string")
    t = (F.when(k % 8 == 0, F.lit(" 1O ")).when(k % 8 == 1, F.lit(".5")).when(k % 8 == 2, F.concat(F.lit("1,"), s(100 + k % 900))).when(k % 8 == 3, F.concat(s(k % 150), F.lit("%")))
         .when(k % 8 == 4, F.lit("Time (m)")).when(k % 8 == 5, F.lit("l2")).when(k % 8 == 6, F.concat(F.lit("week "), s(k % 60))).otherwise(F.concat(F.lit("-"), s(k % 9), F.lit(".25x"))))
    return table(spark, sf, "customer").select(k.alias("k"), F.col("c_nationkey").cast("bigint").alias("image_id"), t.alias("text"), ((k % 10) / 10).alias("conf"),
                                               (k % 700).cast("double").alias("center_x"), (k % 333).cast("double").alias("center_y"))


@query("c05_parse_axis_number", f"SELECT c_custkey AS k, {PARSED.replace('k %', 'c_custkey %')} AS value FROM customer", "value")
def c05(spark, sf):
    return number_tokens(spark, sf).select("k", a.parse_axis_number(F.col("text")).alias("value"))


@query("c06_labels_from_tokens", f"""WITH z AS (SELECT CAST(c_nationkey AS BIGINT) AS image_id, {PARSED.replace('k %', 'c_custkey %')} AS value, CAST(c_custkey % 700 AS INTEGER) AS px, CAST(c_custkey % 333 AS INTEGER) AS py FROM customer WHERE (c_custkey % 10) / 10 > 0.2e0)
    SELECT 'x' AS axis, image_id, value, px FROM z WHERE value BETWEEN 0 AND 200 UNION ALL SELECT 'y', image_id, value, py FROM z WHERE value BETWEEN 0 AND 150""")
def c06(spark, sf):
    t = number_tokens(spark, sf)
    return a.labels_from_tokens(t, "x").withColumn("axis", F.lit("x")).unionByName(a.labels_from_tokens(t, "y").withColumn("axis", F.lit("y")))


# y labels per customer: misread duplicates, a clean percentage axis, decimals, and labels without a zero
YLAB = """ylab AS (SELECT c_custkey AS image_id, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN k IN (1, 3) THEN 5e0 ELSE k * 25e0 END WHEN 1 THEN k * 25e0 WHEN 2 THEN k * 0.25e0 ELSE CASE WHEN k = 4 THEN 0e0 ELSE (k + 1) * 17e0 END END AS value,
    CAST(400 - k * 80 - c_custkey % 3 * k - CASE WHEN c_custkey % 5 = 0 AND k = 4 THEN 190 ELSE 0 END AS INTEGER) AS px FROM customer, (SELECT unnest(range(0, 5)) AS k) q WHERE c_custkey % 4 <> 3 OR k <> c_custkey % 5)"""
XLAB = """xlab AS (SELECT c_custkey AS image_id, CAST(CASE WHEN c_custkey % 3 = 0 THEN k * 6 ELSE 6 + k * 6 END AS DOUBLE) AS value, CAST(60 + k * 97 + c_custkey % 7 AS INTEGER) AS px FROM customer, (SELECT unnest(range(0, 5)) AS k) q WHERE k <= c_custkey % 6)"""
LINES = "lines AS (SELECT c_custkey AS image_id, CAST(55 + c_custkey % 4 AS INTEGER) AS y_axis_x, CAST(480 + c_custkey % 9 AS INTEGER) AS x_axis_end, CAST(401 + c_custkey % 3 AS INTEGER) AS x_axis_y, CAST(70 + c_custkey % 5 AS INTEGER) AS y_axis_top, 24e0 AS t_max FROM customer)"


def ylab(spark, sf):
    k, q = F.col("c_custkey"), F.col("k")
    rows = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).where((k % 4 != 3) | (q != k % 5))
    value = F.when(k % 4 == 0, F.when(q.isin(1, 3), 5.0).otherwise(q * 25.0)).when(k % 4 == 1, q * 25.0).when(k % 4 == 2, q * 0.25).otherwise(F.when(q == 4, 0.0).otherwise((q + 1) * 17.0))
    return rows.select(k.alias("image_id"), value.alias("value"), (400 - q * 80 - k % 3 * q - F.when((k % 5 == 0) & (q == 4), 190).otherwise(0)).cast("int").alias("px"))


def xlab(spark, sf):
    k, q = F.col("c_custkey"), F.col("k")
    rows = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).where(q <= k % 6)
    return rows.select(k.alias("image_id"), F.when(k % 3 == 0, q * 6).otherwise(6 + q * 6).cast("double").alias("value"), (60 + q * 97 + k % 7).cast("int").alias("px"))


def lines(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("image_id"), (55 + k % 4).cast("int").alias("y_axis_x"), (480 + k % 9).cast("int").alias("x_axis_end"), (401 + k % 3).cast("int").alias("x_axis_y"),
                                               (70 + k % 5).cast("int").alias("y_axis_top"), F.lit(24.0).alias("t_max"))


FIXED = """gp AS (SELECT image_id, lead(px) OVER (PARTITION BY image_id ORDER BY px) - px AS g FROM (SELECT DISTINCT image_id, px FROM ylab)),
    gm AS (SELECT image_id, list_sort(list(g))[count(*) // 2 + 1] AS md FROM gp WHERE g IS NOT NULL GROUP BY 1),
    gs AS (SELECT gp.image_id, coalesce(avg(g) FILTER (g > 0.5e0 * md AND g < 2 * md), avg(g)) AS st FROM gp JOIN gm USING (image_id) WHERE g IS NOT NULL GROUP BY 1),
    ys AS (SELECT image_id, count(*) AS n, count(*) FILTER (abs(value) < 0.1e0) AS z, max(px) FILTER (abs(value) < 0.1e0) AS zp FROM ylab GROUP BY 1),
    yd AS (SELECT DISTINCT image_id FROM (SELECT image_id, value FROM ylab WHERE value BETWEEN 2 AND 9 GROUP BY 1, 2 HAVING count(*) > 1)),
    yp AS (SELECT image_id, zp, st FROM ys JOIN gs USING (image_id) WHERE n >= 2 AND zp IS NOT NULL AND (z > 1 OR image_id IN (SELECT image_id FROM yd))),
    fixed AS (SELECT y.image_id, CASE WHEN st IS NOT NULL THEN greatest(0e0, least(100e0, round_even((zp - px) / st, 0) * 25)) ELSE value END AS value, value AS raw, px FROM ylab y LEFT JOIN yp USING (image_id)),
    gt AS (SELECT image_id, (max(px) - min(px)) / (count(*) - 1) AS st, min(px) FILTER (abs(value) < 0.001e0) AS zp FROM ylab GROUP BY 1),
    yq AS (SELECT * FROM gt WHERE zp IS NOT NULL AND image_id IN (SELECT image_id FROM yd)),
    plainfix AS (SELECT y.image_id, CASE WHEN st IS NOT NULL THEN CASE WHEN abs(value) < 0.001e0 THEN 0e0 ELSE greatest(0e0, least(100e0, round_even((zp - px) / st, 0) * 25)) END ELSE value END AS value, value AS raw, px FROM ylab y LEFT JOIN yq USING (image_id))"""


@query("c07_correct_axis_labels", with_(YLAB, FIXED) + "SELECT 'filtered' AS variant, * FROM fixed UNION ALL SELECT 'plain', * FROM plainfix", "value raw")
def c07(spark, sf):
    y = ylab(spark, sf)
    return a.correct_axis_labels(y).withColumn("variant", F.lit("filtered")).unionByName(a.correct_axis_labels(y, filtered=False).withColumn("variant", F.lit("plain")))


ENDS = """en AS (SELECT image_id, l[1].v AS v1, l[1].p AS p1, l[2].v AS v2, l[2].p AS p2, h[1].v AS w1, h[1].p AS q1, h[2].v AS w2, h[2].p AS q2 FROM (SELECT image_id, list({{'v': value, 'p': px}} ORDER BY value, px) AS l,
    list({{'v': value, 'p': px}} ORDER BY value DESC, px) AS h FROM {src} GROUP BY 1))"""
XANCH = ENDS.format(src="xlab") + """, xs AS (SELECT x.image_id, count(*) AS n, min(px) FILTER (abs(value) < 0.1e0) AS z, min(px) FILTER (abs(value - t_max) < 0.5e0) AS hit, max(px) AS rp, max_by(value, px) AS rv FROM xlab x JOIN lines USING (image_id) GROUP BY 1),
    x1 AS (SELECT l.*, xs.* EXCLUDE (image_id), en.* EXCLUDE (image_id), CASE WHEN n >= 2 AND v1 > 0 AND v2 <> v1 THEN p1 - v1 * ((p2 - p1) / (v2 - v1)) END AS far FROM lines l LEFT JOIN xs USING (image_id) LEFT JOIN en USING (image_id)),
    x2 AS (SELECT *, CAST(coalesce(z, CASE WHEN far >= 0 THEN CAST(trunc(far) AS INTEGER) END, y_axis_x) AS INTEGER) AS x_0_pixel FROM x1),
    x3 AS (SELECT *, x_0_pixel + t_max * ((p1 - x_0_pixel) / v1) AS reach FROM x2),
    xa AS (SELECT image_id, x_0_pixel, CASE WHEN n >= 2 THEN CASE WHEN hit IS NOT NULL THEN hit WHEN rv < t_max AND w1 <> v1 THEN CAST(trunc(p1 + (t_max - v1) * ((q1 - p1) / (w1 - v1))) AS INTEGER) ELSE rp END
        WHEN n = 1 AND v1 > 0 AND p1 > x_0_pixel AND reach >= x_axis_end * 0.7e0 THEN CAST(trunc(reach) AS INTEGER) ELSE x_axis_end END AS x_max_pixel,
        CASE WHEN n >= 2 AND hit IS NULL AND NOT (rv < t_max AND w1 <> v1) THEN rv ELSE t_max END AS label_time_max FROM x3)"""
YANCH = """yt AS (SELECT image_id, count(*) AS n, min(px) FILTER (abs(value) < 0.1e0) AS z, max(value) AS top, min(px) FILTER (abs(value - 100) < 1 OR abs(value - 1) < 0.05e0) AS hit,
        min_by(px, struct_pack(a := -value, b := px)) AS hp FROM fixed GROUP BY 1),
    yu AS (SELECT l.*, yt.* EXCLUDE (image_id), CASE WHEN n >= 2 AND top > 0 THEN z - 100 * ((z - hp) / top) END AS far FROM lines l LEFT JOIN yt USING (image_id)),
    ya AS (SELECT image_id, CAST(coalesce(z, x_axis_y) AS INTEGER) AS y_0_pixel, CAST(coalesce(hit, CASE WHEN far >= 0 THEN CAST(trunc(far) AS INTEGER) END, y_axis_top) AS INTEGER) AS y_100_pixel, CASE WHEN top > 1.5e0 THEN 100e0 ELSE 1e0 END AS survival_max FROM yu)"""


@query("c08_x_anchors", with_(XLAB, LINES, XANCH) + "SELECT * FROM xa")
def c08(spark, sf):
    return a.x_anchors(xlab(spark, sf), lines(spark, sf))


@query("c08_y_anchors", with_(YLAB, LINES, FIXED, YANCH) + "SELECT * FROM ya")
def c08b(spark, sf):
    return a.y_anchors(a.correct_axis_labels(ylab(spark, sf)), lines(spark, sf))


CALIB = """calib AS (SELECT l.image_id, CASE WHEN ok THEN x_0_pixel END AS x_0_pixel, CASE WHEN ok THEN x_max_pixel END AS x_max_pixel, CASE WHEN ok THEN y_0_pixel END AS y_0_pixel, CASE WHEN ok THEN y_100_pixel END AS y_100_pixel,
    0e0 AS time_min, t_max AS time_max, 0e0 AS survival_min, survival_max FROM (SELECT *, x_max_pixel > x_0_pixel AND y_0_pixel > y_100_pixel AS ok FROM lines JOIN xa USING (image_id) JOIN ya USING (image_id)) l)"""


@query("c09_calibrate", with_(XLAB, YLAB, LINES, XANCH, FIXED, YANCH, CALIB) + "SELECT * FROM calib")
def c09(spark, sf):
    return a.calibrate(xlab(spark, sf), a.correct_axis_labels(ylab(spark, sf)), lines(spark, sf), 24.0)


@query("c09_default_lines", """WITH s AS (SELECT c_custkey AS image_id, CAST(300 + c_custkey % 500 AS INTEGER) AS width, CAST(200 + c_custkey % 300 AS INTEGER) AS height FROM customer)
    SELECT image_id, CASE WHEN image_id % 3 = 0 THEN CAST(floor(width * 0.1e0) AS INTEGER) ELSE 50 END AS y_axis_x, CASE WHEN image_id % 3 = 0 THEN CAST(floor(height * 0.8e0) AS INTEGER) ELSE 180 END AS x_axis_y,
    CASE WHEN image_id % 3 = 0 THEN CAST(floor(height * 0.1e0) AS INTEGER) ELSE 20 END AS y_axis_top, CASE WHEN image_id % 3 = 0 THEN CAST(floor(width * 0.9e0) AS INTEGER) ELSE 280 END AS x_axis_end FROM s""")
def c09b(spark, sf):
    k = F.col("c_custkey")
    im = table(spark, sf, "customer").select(k.alias("image_id"), (300 + k % 500).cast("int").alias("width"), (200 + k % 300).cast("int").alias("height"))
    ln = im.where("image_id % 3 > 0").select("image_id", *[F.lit(q).alias(n) for n, q in (("y_axis_x", 50), ("x_axis_y", 180), ("y_axis_top", 20), ("x_axis_to", 280))])
    return a.with_default_lines(im, ln)


@query("c10_calibration_from_curve_bounds", with_(r.PIXELS, DARKS) + """SELECT image_id, CAST(a - floor((b - a) * 0.02e0) AS INTEGER) AS x_0_pixel, CAST(b + floor((b - a) * 0.02e0) AS INTEGER) AS x_max_pixel, CAST(d + floor((d - c) * 0.05e0) AS INTEGER) AS y_0_pixel,
    CAST(c - floor((d - c) * 0.05e0) AS INTEGER) AS y_100_pixel, 0e0 AS time_min, 12e0 AS time_max, 0e0 AS survival_min, 1e0 AS survival_max, 0.5e0 AS confidence FROM (SELECT image_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM darks GROUP BY 1)""")
def c10(spark, sf):
    return a.calibration_from_curve_bounds(darks(spark, sf))


@query("c11_refine_bounds", with_(r.PIXELS, DARKS, r.BOUNDS) + """, e AS (SELECT image_id, CAST(floor(median(y)) AS INTEGER) AS t FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y) AS rn, count(*) OVER (PARTITION BY image_id) AS k FROM (SELECT DISTINCT image_id, y FROM darks WHERE y > image_id % 25)) WHERE rn <= greatest(1, k // 20) GROUP BY 1),
    l AS (SELECT image_id, CAST(floor(median(x)) AS INTEGER) AS f FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x) AS rn, count(*) OVER (PARTITION BY image_id) AS k FROM (SELECT DISTINCT image_id, x FROM darks WHERE x > image_id)) WHERE rn <= greatest(1, k // 20) GROUP BY 1),
    q AS (SELECT image_id, CASE WHEN f < px + pw AND f >= 0 THEN f ELSE px END AS nx, CASE WHEN t < py + ph AND t >= 0 THEN t ELSE py END AS ny, px + pw AS rt, py + ph AS bt FROM bounds LEFT JOIN e USING (image_id) LEFT JOIN l USING (image_id)),
    z AS (SELECT *, rt - nx >= 25 AND bt - ny >= 25 AS ok FROM q)
    SELECT image_id, CASE WHEN ok THEN nx END AS px, CASE WHEN ok THEN ny END AS py, CASE WHEN ok THEN rt - nx END AS pw, CASE WHEN ok THEN bt - ny END AS ph FROM z""")
def c11(spark, sf):
    d = darks(spark, sf)
    return a.refine_bounds(r.bounds(spark, sf), p.first_edge(d.where("y > image_id % 25"), "y"), p.first_edge(d.where("x > image_id"), "x"), least=25)


@query("c12_expand_bounds", with_(r.PIXELS, DARKS, r.BOUNDS) + """, b AS (SELECT image_id, CAST(px + image_id AS INTEGER) AS px, py, CAST(20 + image_id * 3 AS INTEGER) AS pw, ph, 0e0 AS time_min, 24e0 AS time_max FROM bounds), e AS (SELECT image_id, min(x) AS a, max(x) AS b FROM darks GROUP BY 1),
    w AS (SELECT *, e.b > px + pw + 20 OR (e.b - e.a) / pw > 1.5e0 AS wide, greatest(0, e.a - 10) AS nx FROM b LEFT JOIN e USING (image_id))
    SELECT image_id, CASE WHEN wide THEN nx ELSE px END AS px, py, CASE WHEN wide THEN b - nx + 10 ELSE pw END AS pw, ph, time_min, CASE WHEN wide THEN time_min + (time_max - time_min) * ((b - nx + 10) / pw) ELSE time_max END AS time_max, coalesce(wide, false) AS expanded FROM w""", "time_max")
def c12(spark, sf):
    b = r.bounds(spark, sf).withColumns({"px": (F.col("px") + F.col("image_id")).cast("int"), "pw": (20 + F.col("image_id") * 3).cast("int"), "time_min": F.lit(0.0), "time_max": F.lit(24.0)})
    return a.expand_bounds(b, darks(spark, sf))


RANGES = """ra AS (SELECT c_custkey AS image_id, CASE WHEN c_custkey % 7 > 0 THEN 0e0 END AS x_low, CASE WHEN c_custkey % 7 > 0 THEN 20e0 + c_custkey % 10 END AS x_high, CASE WHEN c_custkey % 6 > 0 THEN 0e0 END AS y_low, CASE WHEN c_custkey % 6 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 1e0 ELSE 100e0 END END AS y_high FROM customer WHERE c_custkey % 11 > 0),
    rb AS (SELECT c_custkey AS image_id, 0e0 AS x_low, CASE WHEN c_custkey % 13 > 0 THEN 24e0 END AS x_high, 0e0 AS y_low, CASE WHEN c_custkey % 3 = 0 THEN 1e0 ELSE 100e0 END AS y_high, (c_custkey % 20) / 20 AS q FROM customer WHERE c_custkey % 5 > 0),
    rj AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, a.x_low AS ax0, a.x_high AS ax, a.y_low AS ay0, a.y_high AS ay, b.x_low AS bx0, b.x_high AS bx, b.y_low AS by0, b.y_high AS by_, q, coalesce(b.x_high IS NOT NULL AND q >= 0.5e0, false) AS v,
        (a.y_high > 1.5e0) <> (b.y_high > 1.5e0) AS sc FROM ra a FULL OUTER JOIN rb b ON a.image_id = b.image_id)"""


def ranges(spark, sf):
    k = F.col("c_custkey")
    cu = table(spark, sf, "customer")
    first = cu.where("c_custkey % 11 > 0").select(k.alias("image_id"), F.when(k % 7 > 0, 0.0).alias("x_low"), F.when(k % 7 > 0, 20.0 + k % 10).alias("x_high"), F.when(k % 6 > 0, 0.0).alias("y_low"),
                                                  F.when(k % 6 > 0, F.when(k % 2 == 0, 1.0).otherwise(100.0)).alias("y_high"))
    second = cu.where("c_custkey % 5 > 0").select(k.alias("image_id"), F.lit(0.0).alias("x_low"), F.when(k % 13 > 0, 24.0).alias("x_high"), F.lit(0.0).alias("y_low"), F.when(k % 3 == 0, 1.0).otherwise(100.0).alias("y_high"), ((k % 20) / 20).alias("confidence"))
    return first, second


@query("c13_reconcile_axis", with_(RANGES) + """, s AS (SELECT *, abs((ax - ax0) - (bx - bx0)) / greatest(bx - bx0, 0.1e0) > 0.1e0 AS sp FROM rj),
    u AS (SELECT *, coalesce(v AND (ax IS NULL OR (sp AND q > 0.7e0)), false) AS tx, coalesce(v AND (ay IS NULL OR (sc AND q > 0.6e0)), false) AS ty,
        CASE WHEN NOT v THEN 0.5e0 WHEN ax IS NULL THEN q * 0.9e0 WHEN sp THEN CASE WHEN q > 0.7e0 THEN q ELSE 0.5e0 END ELSE least(0.95e0, q + 0.1e0) END AS c1 FROM s)
    SELECT image_id, CASE WHEN tx THEN bx0 ELSE ax0 END AS x_low, CASE WHEN tx THEN bx ELSE ax END AS x_high, CASE WHEN ty THEN by0 ELSE ay0 END AS y_low, CASE WHEN ty THEN by_ ELSE ay END AS y_high,
    CASE WHEN NOT v THEN 0.5e0 WHEN ay IS NULL THEN q * 0.9e0 ELSE least(0.95e0, c1 + 0.1e0) END AS confidence FROM u""", "confidence")
def c13(spark, sf):
    return a.reconcile_axis(*ranges(spark, sf))


@query("c13_reconcile_axis_rules", with_(RANGES) + """, u AS (SELECT *, 'merge' AS rule, coalesce(v AND q > 0.7e0 AND (ax IS NULL OR abs(bx - ax) / greatest(bx, 1e0) > 0.2e0), false) AS tx, coalesce(v AND q > 0.7e0 AND (ay IS NULL OR sc), false) AS ty FROM rj UNION ALL
    SELECT *, 'update', coalesce(v AND q >= 0.8e0 AND (ax IS NULL OR abs(bx - ax) / greatest(ax, 1e0) > 0.1e0), false), coalesce(v AND q >= 0.8e0 AND (ay IS NULL OR sc), false) FROM rj)
    SELECT rule, image_id, CASE WHEN tx THEN bx0 ELSE ax0 END AS x_low, CASE WHEN tx THEN bx ELSE ax END AS x_high, CASE WHEN ty THEN by0 ELSE ay0 END AS y_low, CASE WHEN ty THEN by_ ELSE ay END AS y_high, coalesce(q, 0e0) AS confidence FROM u""", "confidence")
def c13b(spark, sf):
    x, y = ranges(spark, sf)
    return a.reconcile_axis(x, y, "merge").withColumn("rule", F.lit("merge")).unionByName(a.reconcile_axis(x, y, "update").withColumn("rule", F.lit("update")))


@query("c14_axis_validity", with_(CAL) + """, b AS (SELECT * REPLACE (CASE WHEN image_id % 5 = 0 THEN 1e0 ELSE 0e0 END AS time_min, CASE WHEN image_id % 7 = 0 THEN 50e0 ELSE survival_max END AS survival_max, CASE WHEN image_id % 4 = 0 THEN 60 ELSE y_100_pixel END AS y_100_pixel,
        CASE WHEN image_id = 13 THEN NULL ELSE x_0_pixel END AS x_0_pixel) FROM cal),
    l AS (SELECT *, list_filter([CASE WHEN time_min <> 0 THEN 'Time should start at 0, got 1.0' END, CASE WHEN survival_max NOT IN (1e0, 100e0) THEN 'Survival max should be 1.0 or 100, got 50.0' END, CASE WHEN x_0_pixel >= x_max_pixel THEN 'Origin X should be less than X-axis end' END,
        CASE WHEN y_0_pixel <= y_100_pixel THEN 'Origin Y should be greater than Y-axis end (Y increases downward)' END], lambda z: z IS NOT NULL) AS l FROM b)
    SELECT image_id, CASE WHEN x_0_pixel IS NULL THEN 'FAIL' WHEN len(l) > 0 THEN 'WARNING' ELSE 'PASS' END AS status, CASE WHEN x_0_pixel IS NULL THEN 'No calibration data available' ELSE array_to_string(l, '; ') END AS issues FROM l""")
def c14(spark, sf):
    i = F.col("image_id")
    b = cal(spark, sf).withColumns({"time_min": F.when(i % 5 == 0, 1.0).otherwise(0.0), "survival_max": F.when(i % 7 == 0, 50.0).otherwise(F.col("survival_max")),
                                    "y_100_pixel": F.when(i % 4 == 0, 60).otherwise(F.col("y_100_pixel")), "x_0_pixel": F.when(i != 13, F.col("x_0_pixel"))})
    return a.axis_validity(b)


@query("c15_infer_percent_scale", with_(YLAB) + """, m AS (SELECT image_id % 700 AS image_id, max(value) AS mx, bool_or(value > 0 AND value < 1) AS dc, bool_or(abs(value) < 0.01e0) AS z, bool_or(abs(value - 1) < 0.01e0) AS o, bool_or(value BETWEEN 2 AND 9) AS odd FROM ylab GROUP BY 1),
    n AS (SELECT image_id, CASE WHEN dc OR (z AND o) THEN NOT (odd AND mx < 10) AND mx > 10 ELSE mx > 10 END AS percent FROM m) SELECT image_id, percent, CASE WHEN percent THEN 100e0 ELSE 1e0 END AS survival_max FROM n""")
def c15(spark, sf):
    return a.infer_percent_scale(ylab(spark, sf).withColumn("image_id", F.col("image_id") % 700))


BASIC = """basic AS (SELECT c_custkey AS image_id, 60 AS x_0_pixel, 500 AS x_max_pixel, 405 AS y_0_pixel, 75 AS y_100_pixel, 0e0 AS time_min, 12e0 AS time_max, 0e0 AS survival_min, 1e0 AS survival_max FROM customer)"""


def basic(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id"), *[F.lit(q).alias(k) for k, q in (
        ("x_0_pixel", 60), ("x_max_pixel", 500), ("y_0_pixel", 405), ("y_100_pixel", 75), ("time_min", 0.0), ("time_max", 12.0), ("survival_min", 0.0), ("survival_max", 1.0))])


@query("c16_calibrate_from_labels", with_(XLAB, YLAB, FIXED, BASIC, ENDS.format(src="xlab"), ENDS.format(src="(SELECT image_id, raw AS value, px FROM plainfix)").replace("en AS", "rr AS")) + """,
    xs AS (SELECT image_id, count(*) AS nx, min(px) FILTER (abs(value) < 0.001e0) AS x0, max(px) AS xr, max_by(value, px) AS xv FROM xlab GROUP BY 1),
    yy AS (SELECT image_id, count(*) AS ny, min(px) FILTER (abs(raw) < 0.001e0) AS y0, min(px) FILTER (abs(value - 1) < 0.01e0 OR abs(value - 100) < 1) AS h1, min(px) FILTER (abs(raw - 1) < 0.01e0 OR abs(raw - 100) < 1) AS h2,
        min(px) FILTER (value BETWEEN 0.9e0 AND 1.5e0) AS h3, min(px) FILTER (value BETWEEN 90 AND 150) AS h4, min(px) FILTER (abs(value) < 0.1e0) AS fz, max(value) AS hv, min_by(px, struct_pack(a := -value, b := px)) AS hp FROM plainfix GROUP BY 1),
    pm AS (SELECT image_id, CASE WHEN dc OR (z AND o) THEN NOT (odd AND mx < 10) AND mx > 10 ELSE mx > 10 END AS pc FROM (SELECT image_id, max(value) AS mx, bool_or(value > 0 AND value < 1) AS dc, bool_or(abs(value) < 0.01e0) AS z, bool_or(abs(value - 1) < 0.01e0) AS o, bool_or(value BETWEEN 2 AND 9) AS odd FROM plainfix GROUP BY 1)),
    j1 AS (SELECT basic.*, nx, x0, xr, xv, en.v1, en.p1, en.v2, en.p2, yy.* EXCLUDE (image_id), pc, en.p1 - en.v1 * ((en.p2 - en.p1) / (en.v2 - en.v1)) AS far, rr.w1 AS r1, rr.q1 AS s1, rr.w2 AS r2, rr.q2 AS s2 FROM basic LEFT JOIN xs USING (image_id) LEFT JOIN en USING (image_id) LEFT JOIN yy USING (image_id) LEFT JOIN pm USING (image_id) LEFT JOIN rr USING (image_id)),
    j2 AS (SELECT *, CASE WHEN ny >= 2 AND hv > 0 THEN fz - 100 * ((fz - hp) / hv) END AS e1, CASE WHEN ny >= 2 AND r1 <> r2 THEN s1 - (CASE WHEN r1 > 1.5e0 THEN 100e0 ELSE 1e0 END - r1) * ((s2 - s1) / (r1 - r2)) END AS e2 FROM j1),
    j3 AS (SELECT *, CAST(coalesce(x0, CASE WHEN nx >= 2 AND v1 > 0 AND abs(v2 - v1) > 0.001e0 AND far < p1 AND far >= 0 THEN CAST(trunc(far) AS INTEGER) END, x_0_pixel) AS INTEGER) AS a0, coalesce(y0, y_0_pixel) AS b0, coalesce(xr, x_max_pixel) AS a1,
        CAST(coalesce(h1, h2, h3, h4, CASE WHEN e1 >= 0 THEN CAST(trunc(e1) AS INTEGER) END, CASE WHEN e2 >= 0 THEN CAST(trunc(e2) AS INTEGER) END, y_100_pixel) AS INTEGER) AS b1 FROM j2), j4 AS (SELECT *, a1 - a0 >= 50 AND b0 - b1 >= 50 AS ok FROM j3)
    SELECT image_id, CASE WHEN ok THEN a0 ELSE x_0_pixel END AS x_0_pixel, CASE WHEN ok THEN a1 ELSE x_max_pixel END AS x_max_pixel, CASE WHEN ok THEN b0 ELSE y_0_pixel END AS y_0_pixel, CASE WHEN ok THEN b1 ELSE y_100_pixel END AS y_100_pixel, 0e0 AS time_min,
    CASE WHEN ok THEN coalesce(xv, time_max) ELSE time_max END AS time_max, 0e0 AS survival_min, CASE WHEN ok AND pc THEN 100e0 ELSE 1e0 END AS survival_max FROM j4""")
def c16(spark, sf):
    return a.calibrate_from_labels(xlab(spark, sf), ylab(spark, sf), basic(spark, sf))


@query("c16_label_confidence", with_(XLAB, YLAB) + """SELECT c_custkey AS image_id, CASE coalesce(CAST(nx >= 2 AS INTEGER), 0) + coalesce(CAST(ny >= 2 AS INTEGER), 0) WHEN 2 THEN 0.9e0 WHEN 1 THEN 0.6e0 ELSE 0.4e0 END AS confidence FROM customer
    LEFT JOIN (SELECT image_id, count(*) AS nx FROM xlab WHERE image_id % 4 <> 1 GROUP BY 1) x ON x.image_id = c_custkey LEFT JOIN (SELECT image_id, count(*) AS ny FROM ylab WHERE image_id % 6 <> 1 GROUP BY 1) y ON y.image_id = c_custkey""")
def c16b(spark, sf):
    return a.label_confidence(xlab(spark, sf).where("image_id % 4 <> 1"), ylab(spark, sf).where("image_id % 6 <> 1"), basic(spark, sf))


@query("c17_calibrate_from_ranges", with_(BASIC, RANGES) + """, j AS (SELECT b.image_id, x_0_pixel, x_max_pixel, y_0_pixel, y_100_pixel, coalesce(x_low, time_min) AS time_min, coalesce(x_high, time_max) AS time_max, coalesce(y_low, survival_min) AS survival_min, coalesce(y_high, survival_max) AS survival_max FROM basic b LEFT JOIN ra USING (image_id))
    SELECT *, (time_max - time_min) / 440 AS x_stretching, (survival_max - survival_min) / 330 AS y_stretching FROM j""", "x_stretching y_stretching")
def c17(spark, sf):
    return a.calibrate_from_ranges(basic(spark, sf), ranges(spark, sf)[0])


@query("c18_spread_numbers", """WITH t AS (SELECT event_id AS image_id, 200 + event_id % 400 AS width, regexp_extract_all(props || ' ' || user_id || ' ' || value, '\\d+') AS n FROM events)
    SELECT image_id, CAST(n[i] AS DOUBLE) AS value, CAST(width // (len(n) + 1) * i AS INTEGER) AS px FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM t)""")
def c18(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("image_id"), (200 + F.col("event_id") % 400).alias("width"), F.concat_ws(" ", "props", "user_id", "value").alias("text"))
    return a.spread_numbers(e)
