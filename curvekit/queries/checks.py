"""Queries of picture checks, tracking, choices, sources and whole extractions."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import atrisk as ar
from ..operators import checks as k
from ..operators import choose as ch
from ..operators import pixels as p
from ..operators import quality as q
from ..operators import reports
from ..operators import runs as w
from ..operators.track import track
from ..plans import flows
from ..runtime import shared_dir
from ..sources import files
from . import atrisk as qa
from . import quality as qq  # noqa: F401 - the reports are made of its queries
from . import raster as r
from . import views as v
from .base import ORACLES, QUERIES, query, round_doubles, table
from .clean import DROP, FLAT, RESAMPLE, THIN, with_
from .pixels import CLASSES, DARKS, NAMED, NEAREST_ARMS, box, darks

CAL = """cal AS (SELECT CAST(n_nationkey AS BIGINT) AS image_id, CAST(3 + n_nationkey % 4 AS INTEGER) AS x_0_pixel, CAST(80 + n_nationkey % 3 AS INTEGER) AS x_max_pixel, 48 AS y_0_pixel, 2 AS y_100_pixel, 0e0 AS time_min, 90e0 AS time_max FROM nation)"""


def cal(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(n.cast("bigint").alias("image_id"), (3 + n % 4).cast("int").alias("x_0_pixel"), (80 + n % 3).cast("int").alias("x_max_pixel"), F.lit(48).alias("y_0_pixel"),
                                             F.lit(2).alias("y_100_pixel"), F.lit(0.0).alias("time_min"), F.lit(90.0).alias("time_max"))


POINTS = f"""pts AS (SELECT l_suppkey % 25 AS image_id, l_suppkey AS curve_id, t, 1e0 - avg(s) AS s FROM (SELECT l_suppkey, CAST({v.MONTH} AS DOUBLE) - 1 AS t, l_discount * 6 + l_quantity / 200 AS s FROM lineitem) GROUP BY 1, 2, 3)"""


def points(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 25).alias("image_id"), F.col("l_suppkey").alias("curve_id"), (F.expr(v.MONTH).cast("double") - 1).alias("t")).agg(
        F.round(1.0 - F.avg(F.col("l_discount") * 6 + F.col("l_quantity") / 200), 9).alias("s"))


PTS = POINTS.replace("1e0 - avg(s) AS s", "round(1e0 - avg(s), 9) AS s")
NEAR = """{out} AS (SELECT e.*, b.dist, b.near_y FROM {src} e LEFT JOIN (SELECT e.image_id, e.px, e.py, sqrt(min((d.x - px) * (d.x - px) + (d.y - py) * (d.y - py))) AS dist, min_by(d.y, struct_pack(a := (d.x - px) * (d.x - px) + (d.y - py) * (d.y - py), b := d.y - py, c := d.x - px)) AS near_y
    FROM (SELECT DISTINCT image_id, px, py FROM {src} WHERE inside) e JOIN dk d ON d.image_id = e.image_id AND abs(d.x - px) <= {r} AND abs(d.y - py) <= {r} GROUP BY 1, 2, 3) b ON b.image_id = e.image_id AND b.px = e.px AND b.py = e.py AND e.inside)"""
MAP = """{out} AS (SELECT *, px BETWEEN 0 AND width - 1 AND py BETWEEN 0 AND height - 1 AS inside FROM (SELECT {src}.*, CAST(trunc(x_0_pixel + (t - time_min) / (time_max - time_min) * (x_max_pixel - x_0_pixel)) AS INTEGER) AS px,
    CAST(trunc(y_100_pixel + (1e0 - s) * (y_0_pixel - y_100_pixel)) AS INTEGER) AS py, width, height FROM {src} JOIN cal USING (image_id) JOIN images USING (image_id)))"""
DK = "dk AS (SELECT image_id, x, y FROM pixels WHERE gray < 35)"
BASE = with_(r.PIXELS, r.IMAGES, CAL, PTS, DK)


def thin_pixels(spark, sf):
    """Pixels in which few cells are dark: gray values scaled so that the usual limits select less."""
    return r.pixels(spark, sf).withColumn("gray", (F.col("gray") + 93).cast("int"))


@query("v05_early_region", BASE[:-1] + """, z AS (SELECT image_id, curve_id, min_by(t, struct_pack(a := t, b := s)) AS ft, min_by(s, struct_pack(a := t, b := s)) AS fs, count(*) FILTER (t <= 18) AS ep, max(s) FILTER (t <= 18) AS top FROM pts GROUP BY 1, 2),
    sm AS (SELECT image_id, curve_id, i, min(struct_pack(d := abs(t - 90e0 * c), t := t, s := s)) AS m FROM pts, (VALUES (0, 0.02e0), (1, 0.05e0), (2, 0.08e0), (3, 0.10e0), (4, 0.12e0), (5, 0.15e0), (6, 0.18e0)) q(i, c) WHERE t <= 18 GROUP BY 1, 2, 3),
    pr AS (SELECT image_id, curve_id, m.t AS t, m.s AS s FROM sm WHERE m.d < 1.8e0), """ + MAP.format(out="mp", src="pr") + ", " + NEAR.format(out="er", src="mp", r=15) + """, ag AS (SELECT image_id, curve_id, count(dist) AS kk, avg(dist) AS av, max(dist) AS mx FROM er GROUP BY 1, 2),
    l AS (SELECT z.*, kk, av, mx, list_filter([CASE WHEN abs(ft) > 0.001e0 THEN printf('First point time=%.3f (should be 0)', ft) END, CASE WHEN abs(fs - 1) > 0.005e0 THEN printf('First point survival=%.4f (should be 1.0)', fs) END, CASE WHEN ep < 3 THEN 'Only ' || ep || ' points in early region' END,
        CASE WHEN top < 0.99e0 THEN printf('Max survival in early region=%.3f', top) END, CASE WHEN mx > 4 THEN 'Early region pixel error' END, CASE WHEN kk >= 3 AND av > 2 THEN 'Possible curve misalignment in early region' END], lambda e: e IS NOT NULL) AS l FROM z LEFT JOIN ag USING (image_id, curve_id))
    SELECT image_id, curve_id, CASE WHEN len(l) = 0 THEN 'PASS' WHEN abs(ft) > 0.001e0 OR abs(fs - 1) > 0.005e0 THEN 'FAIL' ELSE 'WARNING' END AS status, array_to_string(l[1:3], '; ') AS message, ep AS early_points, av AS avg_error, mx AS max_error FROM l""", "avg_error max_error")
def v05(spark, sf):
    return k.early_region(points(spark, sf), cal(spark, sf), thin_pixels(spark, sf), r.images(spark, sf))


@query("v06_tail_coverage", BASE[:-1] + """, z AS (SELECT image_id, curve_id, count(*) AS n, max(t) AS e, count(*) FILTER (t >= 81) AS tp, max(s) FILTER (t >= 81) AS top, max(s) AS al FROM pts GROUP BY 1, 2),
    pr AS (SELECT image_id, curve_id, t, s FROM (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY t DESC, s DESC) AS rn FROM pts WHERE t >= 81) WHERE rn <= 5), """ + MAP.format(out="mp", src="pr") + ", " + NEAR.format(out="er", src="mp", r=15) + """, ag AS (SELECT image_id, curve_id, avg(dist) AS av, max(dist) AS mx FROM er GROUP BY 1, 2),
    l AS (SELECT z.*, e / 90e0 AS cv, av, mx, list_filter([CASE WHEN e / 90e0 < 0.95e0 THEN printf('Curve ends at t=%.1f', e) END, CASE WHEN tp < greatest(3, floor(n * 0.05e0)) THEN 'Only ' || tp || ' points in tail region' END, CASE WHEN mx > 5 THEN 'Tail region pixel error' END,
        CASE WHEN top >= al - 0.01e0 AND n > 10 THEN 'Tail survival not lower than max' END], lambda q: q IS NOT NULL) AS l FROM z LEFT JOIN ag USING (image_id, curve_id))
    SELECT image_id, curve_id, CASE WHEN len(l) = 0 THEN 'PASS' WHEN cv < 0.9e0 THEN 'FAIL' ELSE 'WARNING' END AS status, array_to_string(l[1:3], '; ') AS message, cv AS coverage, tp AS tail_points, av AS avg_error, mx AS max_error FROM l""", "coverage avg_error max_error")
def v06(spark, sf):
    return k.tail_coverage(points(spark, sf), cal(spark, sf), thin_pixels(spark, sf), r.images(spark, sf))


@query("v07_sample_accuracy", BASE[:-1] + """, sm AS (SELECT image_id, curve_id, c, min(struct_pack(d := abs(t - 90e0 * c), t := t, s := s)) AS m FROM pts, (VALUES (0e0), (0.1e0), (0.2e0), (0.25e0), (0.5e0), (0.75e0), (0.9e0), (1e0)) q(c) GROUP BY 1, 2, 3),
    pr AS (SELECT image_id, curve_id, 90e0 * c AS t, m.s AS s FROM sm), """ + MAP.format(out="mp", src="pr") + ", " + NEAR.format(out="er", src="mp", r=15) + """
    SELECT image_id, CASE WHEN count(dist) = 0 THEN 'WARNING' WHEN max(dist) > 10 THEN 'FAIL' WHEN max(dist) > 5 THEN 'WARNING' ELSE 'PASS' END AS status, count(*) AS samples, count(dist) AS measured, max(dist) AS max_error, avg(dist) AS avg_error FROM er GROUP BY 1""", "max_error avg_error")
def v07(spark, sf):
    return k.sample_accuracy(points(spark, sf), cal(spark, sf), thin_pixels(spark, sf), r.images(spark, sf))


@query("v08_overlay_match", BASE[:-1] + ", " + MAP.format(out="mp", src="pts") + ", " + NEAR.format(out="er", src="mp", r=8) + """, g AS (SELECT image_id, count(*) AS points, count(*) FILTER (dist <= 5) / count(*) AS match_ratio, coalesce(avg(near_y - py), 0e0) AS avg_y_offset FROM er WHERE inside GROUP BY 1)
    SELECT image_id, CASE WHEN match_ratio >= 0.95e0 THEN 'PASS' WHEN match_ratio >= 0.85e0 THEN 'WARNING' ELSE 'FAIL' END AS status, points, match_ratio, avg_y_offset, abs(avg_y_offset) > 2 AS adjust FROM g""", "match_ratio avg_y_offset")
def v08(spark, sf):
    return k.overlay_match(points(spark, sf), cal(spark, sf), thin_pixels(spark, sf), r.images(spark, sf))


DENSE = BASE[:-1] + """, mk AS (SELECT p.image_id, p.x, p.y FROM pixels p JOIN cal USING (image_id) WHERE gray < 60 AND p.y >= y_100_pixel AND p.y < y_0_pixel),
    gr AS (SELECT c.image_id, c.curve_id, CAST(xx AS INTEGER) AS x, time_min + (xx - x_0_pixel) / (x_max_pixel - x_0_pixel) * (time_max - time_min) AS t, y_0_pixel, y_100_pixel FROM (SELECT DISTINCT image_id, curve_id FROM pts) c JOIN (SELECT *, unnest(range(x_0_pixel, x_max_pixel, 2)) AS xx FROM cal) USING (image_id)),
    gs AS (SELECT g.*, p.s, CAST(trunc(y_100_pixel + (1e0 - p.s) * (y_0_pixel - y_100_pixel)) AS INTEGER) AS y FROM gr g ASOF JOIN pts p ON p.curve_id = g.curve_id AND g.t >= p.t),
    go AS (SELECT g.*, b.o FROM gs g LEFT JOIN (SELECT g.image_id, g.x, g.y, min_by(m.y - g.y, struct_pack(a := abs(m.y - g.y), b := m.y - g.y)) AS o FROM (SELECT DISTINCT image_id, x, y FROM gs) g JOIN mk m ON m.image_id = g.image_id AND m.x = g.x AND abs(m.y - g.y) <= 15 GROUP BY 1, 2, 3) b USING (image_id, x, y))"""


def mask60(spark, sf):
    return r.pixels(spark, sf).where("gray < 60").select("image_id", "x", "y")


@query("v09_dense_match", DENSE + """, st AS (SELECT curve_id, count(*) AS steps FROM (SELECT curve_id, lag(s) OVER (PARTITION BY curve_id ORDER BY t) - s AS d FROM pts) WHERE d > 0.01e0 GROUP BY 1)
    SELECT image_id, g.curve_id, count(*) AS total, count(*) FILTER (abs(o) <= 5) AS matched, coalesce(avg(o), 0e0) AS avg_offset, coalesce(max(abs(o)), 0) AS max_offset, coalesce(any_value(steps), 0) AS steps, count(*) FILTER (abs(o) <= 5) / count(*) AS match_rate FROM go g LEFT JOIN st ON st.curve_id = g.curve_id GROUP BY 1, 2""", "avg_offset match_rate")
def v09(spark, sf):
    return k.dense_match(points(spark, sf), cal(spark, sf), mask60(spark, sf))["summary"]


@query("v09_missing_steps", DENSE + """, gp AS (SELECT image_id, curve_id, x, t, abs(ps - s) AS gap, least(y, py) AS y1, greatest(y, py) AS y2 FROM (SELECT *, lag(s) OVER w AS ps, lag(y) OVER w AS py FROM gs WINDOW w AS (PARTITION BY image_id, curve_id ORDER BY t)) WHERE abs(ps - s) > 0.05e0),
    gh AS (SELECT *, EXISTS (SELECT 1 FROM mk WHERE mk.image_id = gp.image_id AND mk.x = gp.x AND mk.y >= y1 + 2 AND mk.y < y2 - 2) AS has FROM gp),
    gi AS (SELECT *, sum(CASE WHEN has AND NOT coalesce(ph, false) THEN 1 ELSE 0 END) OVER (PARTITION BY curve_id ORDER BY t) AS run FROM (SELECT *, lag(has) OVER (PARTITION BY curve_id ORDER BY t) AS ph FROM gh))
    SELECT image_id, curve_id, min(t) FILTER (has) AS t_from, min(t) FILTER (NOT has) AS t_to, min_by(gap, t) FILTER (NOT has) AS gap FROM gi GROUP BY image_id, curve_id, run HAVING min(t) FILTER (has) IS NOT NULL AND min(t) FILTER (NOT has) IS NOT NULL""", "t_from t_to gap")
def v09b(spark, sf):
    return k.dense_match(points(spark, sf), cal(spark, sf), mask60(spark, sf))["missing_steps"]


@query("v09_offset_regions", DENSE + """, f AS (SELECT image_id, curve_id, list_reduce(list({'t': t, 'o': o} ORDER BY t, o), lambda a, e: CASE WHEN e.t - a[-1].t < 1e0 THEN CASE WHEN abs(e.o) > abs(a[-1].o) THEN list_append(a[:-2], e) ELSE a END ELSE list_append(a, e) END,
        list({'t': t, 'o': o} ORDER BY t, o)[1:1]) AS r FROM go WHERE abs(o) > 8 GROUP BY 1, 2)
    SELECT * FROM (SELECT image_id, curve_id, u.t AS t, u.o AS "offset", row_number() OVER (PARTITION BY curve_id ORDER BY abs(u.o) DESC, u.t) AS rank FROM (SELECT image_id, curve_id, unnest(r) AS u FROM f)) WHERE rank <= 10""", "t")
def v09c(spark, sf):
    return k.dense_match(points(spark, sf), cal(spark, sf), mask60(spark, sf))["offset_regions"]


@query("x11_track")
def x11(spark, sf):
    d = darks(spark, sf)
    clusters = w.cluster_axis_adaptive(d, 2)
    return track(clusters, 2, 90.0, 50.0, d.where((F.col("x") + F.col("y")) % 3 == 0))


@query("x11_track_gaps", with_(r.PIXELS, DARKS) + """SELECT e.image_id, CAST(v.c AS INTEGER) AS curve, CAST(e.x AS INTEGER) AS x, false AS present
    FROM (SELECT image_id, unnest(range(min(x), max(x) + 1)) AS x FROM darks GROUP BY 1) e, (VALUES (0), (1), (2)) v(c)
    WHERE NOT EXISTS (SELECT 1 FROM darks d WHERE d.image_id = e.image_id AND d.x = e.x)""")
def x11_gaps(spark, sf):
    """The rows of columns without any cluster."""
    clusters = w.cluster_axis_adaptive(darks(spark, sf), 2)
    rows = track(clusters, 3, 90.0, 50.0)
    return rows.join(clusters.select("image_id", "x").distinct(), ["image_id", "x"], "left_anti").select("image_id", "curve", "x", "present")


# -- choices ---------------------------------------------------------------------------------------

def column_tops(px, threshold):
    return p.column_top(p.dark_pixels(px, threshold))


def column_share(results, keys):
    n = results.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.select(*keys, F.least(F.lit(1.0), F.col("n") / 84).alias("confidence"), (F.col("n") >= 78).alias("acceptable"))


LIMITS = (30, 45, 60, 90)


@query("g01_sweep", with_(r.PIXELS) + ", rs AS (" + " UNION ALL ".join(f"SELECT image_id, x, min(y) AS y, {i} AS setting FROM pixels WHERE gray < {t} GROUP BY 1, 2" for i, t in enumerate(LIMITS)) + """),
    sc AS (SELECT image_id, setting, least(1e0, count(*) / 84) AS cf, count(*) >= 78 AS ok FROM rs GROUP BY 1, 2),
    pk AS (SELECT image_id, coalesce(min(setting) FILTER (ok AND cf >= 0.7e0), max_by(setting, struct_pack(a := cf, b := -setting))) AS best FROM sc GROUP BY 1) SELECT rs.* FROM rs JOIN pk ON pk.image_id = rs.image_id AND best = setting""")
def g01(spark, sf):
    return ch.sweep(r.pixels(spark, sf), [{"threshold": t} for t in LIMITS], column_tops, column_share)


def color_curve_count(mask):
    return mask.groupBy("image_id", "v").agg(F.count("*").alias("n")).groupBy("image_id").agg(F.count_if(F.col("n") >= 40).alias("curves"))


def classes(px, cond):
    return p.classify_color(px.where(cond), first_only=True).select("image_id", "x", "y", F.col("color").alias("v"))


def class_sql(cond):
    from ..functions.color import CLASSES
    from .pixels import box
    return "SELECT image_id, x, y, CASE " + " ".join(f"WHEN {box(s)} THEN '{n}'" for n, s in CLASSES.items()) + f" END AS v FROM pixels WHERE ({cond}) AND (" + " OR ".join(box(s) for s in CLASSES.values()) + ")"


@query("g02_best_variant", with_(r.PIXELS) + ", b0 AS (" + class_sql("v > 200") + "), b1 AS (" + class_sql("v > 150 AND image_id % 2 = 0") + "), b2 AS (" + class_sql("v > 90") + """),
    sc AS (SELECT 0 AS i, image_id, v, count(*) AS n FROM b1 GROUP BY 2, 3 UNION ALL SELECT 1, image_id, v, count(*) FROM b2 GROUP BY 2, 3), kc AS (SELECT i, image_id, count(*) FILTER (n >= 40) AS c FROM sc GROUP BY 1, 2),
    ow AS (SELECT image_id, count(*) FILTER (n >= 40) AS c FROM (SELECT image_id, v, count(*) AS n FROM b0 GROUP BY 1, 2) GROUP BY 1),
    bs AS (SELECT kc.image_id, max_by(i, struct_pack(a := kc.c, b := -i)) AS best FROM kc LEFT JOIN ow USING (image_id) WHERE kc.c > coalesce(ow.c, 0) GROUP BY 1),
    ex AS (SELECT b1.* FROM b1 JOIN bs USING (image_id) WHERE best = 0 UNION ALL SELECT b2.* FROM b2 JOIN bs USING (image_id) WHERE best = 1) SELECT * FROM b0 UNION ALL SELECT ex.* FROM ex ANTI JOIN b0 USING (image_id, x, y)""")
def g02(spark, sf):
    px = r.pixels(spark, sf)
    return ch.best_variant(classes(px, "v > 200"), [("half", classes(px, "v > 150 and image_id % 2 = 0")), ("dark", classes(px, "v > 90"))], color_curve_count)


@query("g03_fallback_cascade", with_(v.NOISY) + """, c AS (SELECT curve_id AS image_id, t, s, 'isolated' AS method, 0 AS p, 0.4e0 AS lim FROM noisy UNION ALL SELECT curve_id, t, s + 0.1e0, 'marks', 1, 0.45e0 FROM noisy WHERE t > 20 UNION ALL SELECT curve_id, t, s + 0.3e0, 'bounded', 2, 0e0 FROM noisy),
    g AS (SELECT image_id, min(p) AS best FROM (SELECT image_id, p, lim FROM c GROUP BY 1, 2, 3 HAVING min(s) >= lim AND count(*) > 10) GROUP BY 1) SELECT c.image_id, t, s, method FROM c JOIN g ON g.image_id = c.image_id AND best = p""", "t s")
def g03(spark, sf):
    n = v.noisy(spark, sf).withColumnRenamed("curve_id", "image_id")
    return ch.fallback_cascade([("isolated", n, 0.4), ("marks", n.where("t > 20").withColumn("s", F.col("s") + 0.1), 0.45), ("bounded", n.withColumn("s", F.col("s") + 0.3), 0.0)])


# -- sources and sinks -----------------------------------------------------------------------------

def fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_scan_images", "SELECT p_size AS image_id, true AS found FROM part GROUP BY 1")
def s01(spark, sf):
    """The listing works on any file type: each part size has files of its own, written first."""
    path = fresh(spark, "scan")
    table(spark, sf, "part").select("p_size", "p_name").repartition("p_size").write.partitionBy("p_size").text(path)
    found = files.scan_images(spark, path, ("txt",))
    return found.groupBy(F.regexp_extract("path", r"p_size=(\d+)", 1).cast("int").alias("image_id")).agg((F.min("length") > 0).alias("found"))


@query("s02_read_pixels", """SELECT vec_id AS image_id, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, g AS b, g, g AS r FROM (SELECT vec_id, i, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1e0) * 127) AS INTEGER) AS g FROM embeddings, (SELECT unnest(range(1, 65)) AS i) q) WHERE g < 140""")
def s02(spark, sf):
    """Every embedding seen as an 8 x 8 gray picture."""
    e = table(spark, sf, "embeddings")
    hexed = F.array_join(F.transform("embedding", lambda q: F.lpad(F.hex(F.floor((q.cast("double") + 1.0) * 127)), 2, "0")), "")
    im = e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.unhex(hexed).alias("data"))
    return files.read_pixels(im, white=140)


@query("s02_read_pixels_cropped", """SELECT vec_id AS image_id, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, g AS b, g, g AS r FROM (SELECT vec_id, i, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1e0) * 127) AS INTEGER) AS g FROM embeddings, (SELECT unnest(range(1, 65)) AS i) q)
    WHERE g < 140 AND (vec_id % 7 = 0 OR ((i - 1) % 8 >= vec_id % 5 AND (i - 1) % 8 < vec_id % 5 + 4 AND (i - 1) // 8 >= vec_id % 3 - 1 AND (i - 1) // 8 < vec_id % 3 + 5))""")
def s02_cropped(spark, sf):
    """As s02, but each picture has a plot rectangle of its own, every seventh none."""
    e = table(spark, sf, "embeddings")
    hexed = F.array_join(F.transform("embedding", lambda q: F.lpad(F.hex(F.floor((q.cast("double") + 1.0) * 127)), 2, "0")), "")
    left = F.when(F.col("vec_id") % 7 != 0, F.col("vec_id") % 5)
    im = e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.unhex(hexed).alias("data"),
                  left.alias("left"), (F.col("vec_id") % 3 - 1).alias("top"), F.lit(4).alias("wide"), F.lit(6).alias("high"))
    return files.read_pixels(im, white=140, bounds=("left", "top", "wide", "high"))


@query("s03_read_calibration_json", "SELECT CAST(n_nationkey AS BIGINT) AS image_id, 10 + n_nationkey AS x_0_pixel, 400 AS x_max_pixel, 300 AS y_0_pixel, 20 AS y_100_pixel, 24e0 + n_regionkey AS time_max FROM nation")
def s03(spark, sf):
    path = fresh(spark, "calibration")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("image_id"), (10 + F.col("n_nationkey")).alias("x_0_pixel"), F.lit(400).alias("x_max_pixel"), F.lit(300).alias("y_0_pixel"),
                                          F.lit(20).alias("y_100_pixel"), (F.lit(24.0) + F.col("n_regionkey")).alias("time_max"))
    n.write.json(path)
    return files.read_calibration_json(spark, path)


@query("s04_read_at_risk_long", with_(qa.CELLS) + "SELECT image_id || ' ' || grp AS grp, t, CAST(n AS INTEGER) AS n FROM cells")
def s04(spark, sf):
    path = fresh(spark, "at-risk")
    qa.cells(spark, sf).select(F.concat_ws(" ", "image_id", "grp").alias("Group"), F.col("t").alias("Time"), F.col("n").alias("AtRisk")).write.option("header", "true").csv(path)
    return files.read_at_risk_long(spark, path)


@query("s05_read_at_risk_wide", with_(qa.CELLS) + "SELECT image_id || ' ' || grp AS grp, t, CAST(n AS INTEGER) AS n FROM cells WHERE t <= 6")
def s05(spark, sf):
    path = fresh(spark, "at-risk-wide")
    wide = ar.display_matrix(qa.cells(spark, sf), list(range(7)))
    wide.select(F.concat_ws(" ", "image_id", "grp").alias("Group"), F.lit("x").alias("note"), *[F.col(f"t_{i}").alias(str(i)) for i in range(7)]).write.option("header", "true").csv(path)
    return files.read_at_risk_wide(spark, path)


@query("s06_parse_grid", with_(qa.CELLS) + "SELECT image_id AS table_id, grp, t, n FROM cells WHERE t <= 6 AND t <> 3")
def s06(spark, sf):
    wide = ar.display_matrix(qa.cells(spark, sf), list(range(7)))
    body = wide.select(F.col("image_id").alias("table_id"), F.lit(1).alias("row_no"), F.array(F.concat(F.lit(" "), "grp"), *[F.coalesce(F.concat(F.col(f"t_{i}").cast("string"), F.lit(".0 ")), F.lit("-")) for i in range(7)]).alias("cells"))
    head = wide.select(F.col("image_id").alias("table_id")).distinct().select("table_id", F.lit(0).alias("row_no"), F.array(*[F.lit(q) for q in ("", "0", " 1", "2", "n/a", "4", "5.0", "6")]).alias("cells"))
    skip = head.select("table_id", F.lit(2).alias("row_no"), F.array(*[F.lit(q) for q in ("Months", "0", "1", "2", "3", "4", "5", "6")]).alias("cells"))
    return files.parse_grid(head.unionByName(body).unionByName(skip))


CURVES = "SELECT 'curve ' || curve_id AS Curve, CASE WHEN curve_id % 2 = 0 THEN 'solid' ELSE 'dashed' END AS Style, t AS Time, s AS Survival FROM {src}"


def named(points):
    k = F.col("curve_id")
    return points.select("curve_id").distinct().select("curve_id", F.concat(F.lit("curve "), k.cast("string")).alias("name"), F.when(k % 2 == 0, "solid").otherwise("dashed").alias("style"))


@query("s07_import_curve_csv", with_(v.NOISY, v.REMAINING) + CURVES.format(src="noisy") + " UNION ALL SELECT 'black', 'solid', t, s FROM remaining", "Time Survival")
def s07(spark, sf):
    path = fresh(spark, "curve")
    v.remaining(spark, sf).select(F.col("t").alias("Time"), F.col("s").alias("Survival")).write.option("header", "true").csv(path)
    n = v.noisy(spark, sf)
    return files.all_curves(n, named(n)).unionByName(files.import_curve_csv(spark, path, "black"))


@query("s08_write_points", with_(v.NOISY) + "SELECT CAST(curve_id AS INTEGER) AS curve_id, t AS Time, s AS Survival FROM noisy", "Time Survival")
def s08(spark, sf):
    path = fresh(spark, "points")
    files.write_points(v.noisy(spark, sf), path)
    return spark.read.schema("Time DOUBLE, Survival DOUBLE, curve_id INT").option("header", "true").csv(path)


@query("s09_write_all_curves", with_(v.NOISY) + CURVES.format(src="noisy"), "Time Survival")
def s09(spark, sf):
    path, n = fresh(spark, "all-curves"), v.noisy(spark, sf)
    files.write_all_curves(n, named(n), path, "parquet")
    return spark.read.parquet(path)


@query("s10_write_at_risk", with_(qa.CELLS) + """SELECT CAST(image_id AS INTEGER) AS image_id, grp AS "Group", t AS Time, CAST(n AS INTEGER) AS AtRisk, CAST(coalesce(greatest(0, n - lead(n) OVER (PARTITION BY image_id, grp ORDER BY t)), 0) AS INTEGER) AS Events FROM cells""")
def s10(spark, sf):
    path = fresh(spark, "at-risk-table")
    files.write_at_risk(qa.cells(spark, sf), path)
    return spark.read.schema("image_id INT, Group STRING, Time DOUBLE, AtRisk INT, Events INT").option("header", "true").csv(path)


@query("s11_at_risk_to_json", with_(qa.CELLS) + """, g AS (SELECT image_id, grp, '"' || grp || '":{' || string_agg('"' || CAST(t AS VARCHAR) || '":' || n, ',' ORDER BY CAST(t AS VARCHAR)) || '}' AS j FROM cells GROUP BY 1, 2),
    m AS (SELECT image_id, string_agg(j, ',' ORDER BY grp) AS j FROM g GROUP BY 1), t AS (SELECT image_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS tt FROM (SELECT DISTINCT image_id, t FROM cells) GROUP BY 1)
    SELECT image_id, '{"groups":{' || j || '},"time_points":[' || tt || '],"source":"manual"}' AS json FROM m JOIN t USING (image_id)""")
def s11(spark, sf):
    return files.at_risk_to_json(qa.cells(spark, sf))


@query("s12_write_reports", with_(v.NOISY) + """, g AS (SELECT curve_id, min_by(t, struct_pack(t := t, s := s)) AS ft, min_by(s, struct_pack(t := t, s := s)) AS fs FROM noisy GROUP BY 1),
    l AS (SELECT curve_id, ft, fs, list_filter([CASE WHEN abs(ft) > 0.01e0 THEN printf('First time=%.3f, should be 0', ft) END, CASE WHEN abs(fs - 1) > 0.01e0 THEN printf('First survival=%.3f, should be 1.0', fs) END], lambda z: z IS NOT NULL) AS l FROM g),
    c AS (SELECT curve_id, CASE WHEN len(l) = 0 THEN 'PASS' WHEN abs(fs - 1) < 0.05e0 THEN 'WARNING' ELSE 'FAIL' END AS st, CASE WHEN len(l) > 0 THEN array_to_string(l, '; ') ELSE printf('Starts at (%.2f, %.3f)', ft, fs) END AS ms FROM l)
    SELECT '  [' || st || '] Starting Point: ' || ms AS value FROM c UNION ALL SELECT 'CHECKS: ' || CAST(st = 'PASS' AS INTEGER) || '/1 checks passed' FROM c""")
def s12(spark, sf):
    path = fresh(spark, "report")
    files.write_reports(q.start_point(v.noisy(spark, sf)), path, "CHECKS", "curve_id")
    return spark.read.text(path)


@query("s12_dense_report", f"""WITH m AS ({ORACLES['v09_dense_match']}), g AS ({ORACLES['v09_missing_steps']}), f AS ({ORACLES['v09_offset_regions']}),
    n AS (SELECT curve_id, count(*) AS gaps FROM g GROUP BY 1), w AS (SELECT image_id, sum(matched) / sum(total) AS acc FROM m GROUP BY 1)
    SELECT unnest([repeat('=', 60), 'DENSE VALIDATION REPORT', repeat('=', 60), printf('Overall Accuracy: %.1f%%', acc * 100), repeat('=', 60)]) AS value FROM w
    UNION ALL SELECT unnest(list_filter(['--- ' || m.curve_id || ' ---', printf('  Points matched: %d/%d (%.1f%%)', matched, total, match_rate * 100), printf('  Average Y-offset: %.2f pixels', avg_offset),
     printf('  Max Y-offset: %.2f pixels', CAST(max_offset AS DOUBLE)), '  Steps detected: ' || steps, '  Steps in original: ' || steps, '  Missing step regions: ' || gaps], lambda z: z IS NOT NULL)) FROM m LEFT JOIN n ON n.curve_id = m.curve_id
    UNION ALL SELECT printf('    - t=%.1f to t=%.1f (gap of %.3f)', t_from, t_to, gap) FROM (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY t_from, t_to, gap) AS r FROM g) WHERE r <= 5
    UNION ALL SELECT DISTINCT ON (curve_id) '  Significant offset regions:' FROM f
    UNION ALL SELECT printf('    - t=%.1f: offset=%.1fpx (%s)', t, CAST("offset" AS DOUBLE), CASE WHEN "offset" < 0 THEN 'extracted above' ELSE 'extracted below' END) FROM f WHERE rank <= 5""")
def s12_dense(spark, sf):
    path = fresh(spark, "dense-report")
    match = {name: round_doubles(part) for name, part in k.dense_match(points(spark, sf), cal(spark, sf), mask60(spark, sf)).items()}
    files.write_lines(reports.dense_report(match), path)
    return spark.read.text(path)


RULES = [name for name in ORACLES if name[:3] in ("q01", "q02", "q03", "q04", "q05", "q06", "q07", "q08") and name in QUERIES]
ADVISED = " ".join(f"WHEN '{rule}' THEN " + (f"CASE severity WHEN 'critical' THEN '{reports.NO_POINTS}' ELSE '{text}' END" if rule == "too_few_points" else
                   f"replace('{text}', '%s', regexp_extract(message, 'follow (\\d+%) reference', 1))") for rule, text in reports.ADVICE)


@query("s12_quality_report", "WITH i AS (" + " UNION ALL ".join(f"SELECT curve_id, issue_type, severity, message FROM ({ORACLES[name]}) AS {name}_" for name in RULES) + f"""),
    c AS (SELECT c_custkey AS curve_id, c_nationkey AS image_id FROM customer),
    s AS (SELECT c.image_id, c.curve_id, count(*) FILTER (severity = 'critical') AS cr, count(*) FILTER (severity = 'error') AS er, count(*) FILTER (severity = 'warning') AS wa FROM c LEFT JOIN i USING (curve_id) GROUP BY 1, 2),
    w AS (SELECT image_id, bool_and(cr = 0 AND er = 0) AS ok FROM s GROUP BY 1)
    SELECT unnest(['QUALITY CONTROL REPORT', repeat('=', 50), 'Overall: ' || CASE WHEN ok THEN 'ALL PASSED' ELSE 'ISSUES DETECTED' END]) AS value FROM w
    UNION ALL SELECT printf('%d: %s (score: %.0f%%)', curve_id, CASE WHEN cr = 0 AND er = 0 THEN 'PASSED' ELSE 'FAILED' END, pow(0.1e0, cr) * pow(0.5e0, er) * pow(0.9e0, wa) * 100) FROM s
    UNION ALL SELECT unnest(['  ' || CASE severity WHEN 'warning' THEN '⚠' WHEN 'error' THEN '✗' ELSE '✗✗' END || ' [' || upper(severity) || '] ' || message, '      → ' || CASE issue_type {ADVISED} END]) FROM i JOIN c USING (curve_id)""")
def s12_quality(spark, sf):
    path = fresh(spark, "quality-report")
    issues = reduce(DataFrame.unionByName, [QUERIES[name](spark, sf) for name in RULES])
    curves = table(spark, sf, "customer").select(F.col("c_custkey").alias("curve_id"), F.col("c_nationkey").alias("image_id"))
    scored = q.qc_score(curves, issues).join(curves, "curve_id")
    files.write_lines(reports.quality_report(scored, issues), path)
    return spark.read.text(path)


# -- whole extractions -----------------------------------------------------------------------------

def full_cal(spark, sf):
    return cal(spark, sf).withColumns({"survival_min": F.lit(0.0), "survival_max": F.lit(1.0)})


PICKED = """picks AS (SELECT curve_id, list_reduce(list({{'x': x, 'lo': lo, 'med': med, 'n': n, 'y': 0}} ORDER BY x), lambda a, c: list_append(a, {{'x': c.x, 'lo': c.lo, 'med': c.med, 'n': c.n,
        'y': CASE WHEN c.n <= 3 THEN c.med {arms} END}}), CAST([] AS STRUCT(x INTEGER, lo INTEGER, med INTEGER, n BIGINT, y INTEGER)[])) AS f
        FROM (SELECT curve_id, x, min(y) AS lo, CAST(floor(median(y)) AS INTEGER) AS med, count(*) AS n FROM marked GROUP BY 1, 2) GROUP BY 1),
    picked AS (SELECT curve_id, CAST(split_part(curve_id, '@', 1) AS BIGINT) AS image_id, u.x AS x, u.y AS y FROM (SELECT curve_id, unnest(f) AS u FROM picks WHERE len(f) >= 10))"""
NAMED_BACK = "SELECT CAST(split_part(curve_id, '@', 1) AS BIGINT) AS image_id, split_part(curve_id, '@', 2) AS color, t, s FROM "


def marks_sql(specs: dict, source: str) -> str:
    """Cells of each colour, named picture@colour."""
    return " UNION ALL ".join(f"SELECT image_id || '@{n}' AS curve_id, x, y FROM {source} WHERE {box(spec)}" for n, spec in specs.items())


@query("flow_color_curves")
def flow_color(spark, sf):
    return flows.color_curves(r.pixels(spark, sf), r.bounds(spark, sf), full_cal(spark, sf), 30)


@query("flow_named_curves", with_(r.PIXELS, CAL, f"""inner_px AS (SELECT p.* FROM pixels p JOIN cal USING (image_id) WHERE x BETWEEN x_0_pixel AND x_max_pixel AND y BETWEEN y_100_pixel AND y_0_pixel),
    marked AS ({marks_sql({n: NAMED[n] for n in ("red", "green", "blue", "black")}, "inner_px")})""", PICKED.format(arms=NEAREST_ARMS),
    """points AS (SELECT curve_id, time_min + (x - x_0_pixel) * ((time_max - time_min) / (x_max_pixel - x_0_pixel)) AS t, greatest(0e0, least(1e0, 0e0 + (y_0_pixel - y) * (1e0 / (y_0_pixel - y_100_pixel)))) AS s
    FROM picked JOIN cal USING (image_id))""", DROP.format(src="points", tol="0.005e0", start="s"), FLAT + RESAMPLE.format(src="flat", st="5e-1")) + NAMED_BACK + "resampled", "t s")
def flow_named(spark, sf):
    return flows.named_curves(r.pixels(spark, sf), full_cal(spark, sf), ["red", "green", "blue", "black"])


@query("flow_classed_curves", with_(r.PIXELS, r.IMAGES, f"""every AS ({marks_sql(CLASSES, "pixels")}), marked AS (SELECT * FROM every QUALIFY count(*) OVER (PARTITION BY curve_id) >= 100)""",
    PICKED.format(arms="WHEN len(a) > 0 AND abs(c.lo - a[-1].y) > 20 THEN c.med ELSE c.lo"),
    "points AS (SELECT curve_id, x / width * 90e0 AS t, greatest(0e0, least(1e0, 1e0 - y / height)) AS s FROM picked JOIN images USING (image_id))",
    DROP.format(src="points", tol="0.005e0", start="1e0"), THIN.format(src="dropped", tt="0.1e0", ts="0.005e0"), """ranked AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY t, s) AS rn FROM thinned),
    anchored AS (SELECT curve_id, 0e0 AS t, 1e0 AS s FROM ranked WHERE rn = 1 AND (t > 0.01e0 OR s < 0.999e0) UNION ALL SELECT curve_id, t, s FROM ranked WHERE NOT (rn = 1 AND t <= 0.01e0 AND s < 0.999e0))""")
    + NAMED_BACK + "anchored", "t s")
def flow_classed(spark, sf):
    return flows.classed_curves(r.pixels(spark, sf), r.images(spark, sf), 90.0)


@query("flow_scored_curves")
def flow_scored(spark, sf):
    return flows.scored_curves(v.remaining(spark, sf), dedup="min", trim=False)
