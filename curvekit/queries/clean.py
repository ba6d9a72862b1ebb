"""Queries of the ordered curve cleaning."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as k
from . import views as v
from .base import query


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


@query("k01_dedup_median", with_(v.MANY) + """SELECT curve_id, t, list_sort(list(s))[count(*) // 2 + 1] AS s
    FROM (SELECT curve_id, round(t, 3) AS t, s FROM many) GROUP BY 1, 2""", "s")
def k01(spark, sf):
    return k.dedup_median(v.many(spark, sf))


@query("k02_dedup_min", with_(v.MANY) + "SELECT curve_id, round(t, 3) AS t, min(s) AS s FROM many GROUP BY 1, 2", "s")
def k02(spark, sf):
    return k.dedup_min(v.many(spark, sf))


CONTINUITY = """lists AS (SELECT curve_id, round(t, 3) AS t, list_sort(list(DISTINCT s)) AS v FROM {src} GROUP BY 1, 2),
folded AS (SELECT curve_id, list_reduce(list({{'t': t, 's': 0e0, 'v': v}} ORDER BY t), lambda a, x: list_append(a,
    {{'t': x.t, 's': CASE WHEN len(x.v) = 1 THEN x.v[1] ELSE coalesce(
        list_max(list_filter(x.v, lambda q: q <= a[-1].s + 0.01e0 AND q >= a[-1].s - 0.15e0)),
        list_reduce(x.v, lambda p, q: CASE WHEN abs(q - a[-1].s) < abs(p - a[-1].s) THEN q ELSE p END)) END, 'v': x.v}}),
    [{{'t': -1e0, 's': 1e0, 'v': CAST([] AS DOUBLE[])}}]) AS r FROM lists GROUP BY curve_id),
kept AS (SELECT curve_id, p.t AS t, p.s AS s FROM (SELECT curve_id, unnest(r[2:]) AS p FROM folded))"""


@query("k03_dedup_continuity", with_(v.MANY, CONTINUITY.format(src="many")) + "SELECT curve_id, t, s FROM kept", "s")
def k03(spark, sf):
    return k.dedup_continuity(v.many(spark, sf))


@query("k04_bin_median", with_(v.NOISY) + """SELECT curve_id, t, median(s) AS s
    FROM (SELECT curve_id, round(t / 5e0) * 5e0 AS t, s FROM noisy) GROUP BY 1, 2""", "s")
def k04(spark, sf):
    return k.bin_median(v.noisy(spark, sf), width=5.0)


@query("k05_rescale_to_one", with_(v.MANY, "low AS (SELECT curve_id % 7 AS curve_id, t, s - 0.3e0 AS s FROM many)") + """
    SELECT curve_id, t, CASE WHEN m > 0.1e0 AND m < 0.95e0 THEN least(1e0, s * (1e0 / m)) ELSE s END AS s
    FROM (SELECT *, max(s) OVER (PARTITION BY curve_id) AS m FROM low)""", "s")
def k05(spark, sf):
    return k.rescale_to_one(v.many(spark, sf).select((F.col("curve_id") % 7).alias("curve_id"), "t", (F.col("s") - 0.3).alias("s")))


@query("k06_anchor_start", with_(v.NOISY) + """
    , ranked AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY t, s) AS rn FROM noisy)
    SELECT curve_id, 0e0 AS t, 1e0 AS s FROM ranked WHERE rn = 1 AND (t > 0.01e0 OR s < 0.999e0)
    UNION ALL SELECT curve_id, t, s FROM ranked WHERE NOT (rn = 1 AND t <= 0.01e0 AND s < 0.999e0)""", "t s")
def k06(spark, sf):
    return k.anchor_start(v.noisy(spark, sf))


@query("k07_monotone_cap", with_(v.NOISY) + """SELECT curve_id, t, least(1e0, min(s) OVER (PARTITION BY curve_id ORDER BY t, s
    ROWS UNBOUNDED PRECEDING)) AS s FROM noisy""", "t s")
def k07(spark, sf):
    return k.monotone_cap(v.noisy(spark, sf))


DROP = """dropped AS (SELECT curve_id, t, least(s, p) AS s FROM (SELECT curve_id, t, s,
    least({start}, coalesce(min(s) OVER (PARTITION BY curve_id ORDER BY t, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    {start})) AS p FROM {src}) WHERE s <= p + {tol})"""


@query("k08_monotone_drop", with_(v.NOISY, DROP.format(src="noisy", tol="0.005e0", start="1e0"))
       + "SELECT * FROM dropped", "t s")
def k08(spark, sf):
    return k.monotone_drop(v.noisy(spark, sf))


@query("k08_monotone_drop_marks", with_(v.NOISY, DROP.format(src="noisy", tol="0.03e0", start="s"))
       + "SELECT * FROM dropped", "t s")
def k08_marks(spark, sf):
    return k.monotone_drop(v.noisy(spark, sf), tol=0.03, start=None)


THIN = """thinned AS (SELECT curve_id, p.t AS t, p.s AS s FROM (SELECT curve_id, unnest(list_reduce(
    list({{'t': t, 's': s}} ORDER BY t, s), lambda a, x: CASE WHEN x.t - a[-1].t > {tt} OR a[-1].s - x.s > {ts}
    THEN list_append(a, x) ELSE a END, list({{'t': t, 's': s}} ORDER BY t, s)[1:1])) AS p FROM {src} GROUP BY curve_id))"""


@query("k09_thin", with_(v.NOISY, THIN.format(src="noisy", tt="3e0", ts="0.05e0")) + "SELECT * FROM thinned", "t s")
def k09(spark, sf):
    return k.thin(v.noisy(spark, sf), tol_t=3.0, tol_s=0.05)


@query("k10_drop_flat", with_(v.NOISY) + """, ahead AS (SELECT curve_id, t, s, lead(s) OVER (PARTITION BY curve_id ORDER BY t, s) AS n,
        row_number() OVER (PARTITION BY curve_id ORDER BY t, s) AS rn FROM noisy),
    f AS (SELECT curve_id, list_reduce(list({'t': t, 's': s, 'n': n, 'rn': rn} ORDER BY t, s), lambda a, x:
        CASE WHEN x.rn = 1 THEN a WHEN x.n IS NULL OR abs(x.s - a[-1].s) > 0.02e0 OR abs(x.n - x.s) > 0.02e0
        THEN list_append(a, x) ELSE a END, list({'t': t, 's': s, 'n': n, 'rn': rn} ORDER BY t, s)[1:1]) AS r FROM ahead GROUP BY 1)
    SELECT curve_id, p.t AS t, p.s AS s FROM (SELECT curve_id, unnest(r) AS p FROM f)""", "t s")
def k10(spark, sf):
    return k.drop_flat(v.noisy(spark, sf), tol=0.02)


TRIM = """i0 AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY t, s) - 1 AS i, count(*) OVER (PARTITION BY curve_id) AS n FROM {src}),
i1 AS (SELECT *, CAST(floor(n * 0.8e0) AS BIGINT) AS f FROM i0),
i2 AS (SELECT *, i >= f AND i < n - CASE WHEN n - f > 5 THEN 3 ELSE 1 END AS st,
       i >= n - CASE WHEN n - f > 5 THEN 3 ELSE 1 END AS en FROM i1),
i3 AS (SELECT *, avg(s) FILTER (st) OVER (PARTITION BY curve_id) AS m, stddev_pop(s) FILTER (st) OVER (PARTITION BY curve_id) AS sd,
       min(s) FILTER (en) OVER (PARTITION BY curve_id) AS e FROM i2),
i4 AS (SELECT *, coalesce(max(i) FILTER (i > f AND s >= m - 0.05e0) OVER (PARTITION BY curve_id), f) AS ok FROM i3),
trimmed AS (SELECT curve_id, t, s FROM i4 WHERE NOT coalesce(n >= 10 AND n - f >= 3 AND sd < 0.05e0 AND m - e > 0.1e0 AND e < 0.05e0, false) OR i <= ok)"""
TAIL = """tail AS (SELECT curve_id, t, CASE WHEN row_number() OVER (PARTITION BY curve_id ORDER BY t DESC) <= curve_id % 4
    THEN 0.01e0 ELSE 0.6e0 + s * 0.01e0 END AS s FROM remaining)"""


def tail(spark, sf):
    """Flat curves that fall to zero in their last 0..3 rows."""
    from ..ordered import Ordered
    o = Ordered(v.remaining(spark, sf), "curve_id", "t").running(reverse=True, _r=("count", F.lit(1)))
    return o.df.select("curve_id", "t", F.when(F.col("_r") <= F.col("curve_id") % 4, 0.01).otherwise(0.6 + F.col("s") * 0.01).alias("s"))


@query("k11_trim_tail_drop", with_(v.REMAINING, TAIL, TRIM.format(src="tail")) + "SELECT * FROM trimmed", "s")
def k11(spark, sf):
    return k.trim_tail_drop(tail(spark, sf))


STEEP = """steep AS (SELECT curve_id, x, CASE WHEN row_number() OVER (PARTITION BY curve_id ORDER BY x DESC) <= curve_id % 5
    THEN y + 900e0 ELSE y END AS y FROM traced)"""


def steep(spark, sf):
    from ..ordered import Ordered
    o = Ordered(v.traced(spark, sf), "curve_id", "x").running(reverse=True, _r=("count", F.lit(1)))
    return o.df.select("curve_id", "x", F.when(F.col("_r") <= F.col("curve_id") % 5, F.col("y") + 900.0).otherwise(F.col("y")).alias("y"))


@query("k12_truncate_anomalous_tail", with_(v.TRACED, STEEP) + """,
    a AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY curve_id) AS n,
          lead(x) OVER (PARTITION BY curve_id ORDER BY x) AS x2, lead(y) OVER (PARTITION BY curve_id ORDER BY x) AS y2 FROM steep),
    b AS (SELECT curve_id, min_by(y, x) AS y0, max_by(y, x) AS y1, min(x) AS x0, max(x) AS x1, min(y) AS lo, max(y) AS hi
          FROM a WHERE i >= floor(n * 0.60e0) AND i < floor(n * 0.85e0) GROUP BY 1),
    c AS (SELECT a.*, lo, hi, greatest(20e0, (hi - lo) * 2) AS slack, CASE WHEN x1 <> x0 THEN (y1 - y0) / (x1 - x0) ELSE 0e0 END AS sl,
          (y2 - y) / (x2 - x) AS ls FROM a LEFT JOIN b USING (curve_id)),
    d AS (SELECT curve_id, min(x) AS cut FROM c WHERE n >= 50 AND floor(n * 0.85e0) - floor(n * 0.60e0) >= 10 AND i >= floor(n * 0.85e0)
          AND x2 IS NOT NULL AND ls > 0 AND CASE WHEN sl > 0 THEN ls > sl * 5 WHEN sl <= 0.01e0 THEN ls > 10e0 ELSE false END
          AND NOT (y2 BETWEEN lo - slack AND hi + slack) GROUP BY 1)
    SELECT curve_id, x, y FROM steep LEFT JOIN d USING (curve_id) WHERE cut IS NULL OR x <= cut""", "y")
def k12(spark, sf):
    return k.truncate_anomalous_tail(steep(spark, sf))


@query("k13_drop_spikes", with_(v.TRACED) + """, a AS (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS q, count(*) OVER (PARTITION BY curve_id) AS n
    FROM traced WINDOW w AS (PARTITION BY curve_id ORDER BY x))
    SELECT curve_id, x, y FROM a WHERE NOT coalesce(n >= 10 AND abs(y - p) > 15e0 AND abs(q - p) < 7.5e0, false)""", "y")
def k13(spark, sf):
    return k.drop_spikes(v.traced(spark, sf))


@query("k14_max_jump_filter", with_(v.TRACED) + """, f AS (SELECT curve_id, list_reduce(list({'x': x, 'y': y} ORDER BY x), lambda a, b:
        CASE WHEN b.x = a[1].x OR b.y - a[-1].y > 30e0 THEN a ELSE list_append(a, b) END, list({'x': x, 'y': y} ORDER BY x)[1:1]) AS r
        FROM traced WHERE y BETWEEN -10 AND 110 GROUP BY 1)
    SELECT curve_id, p.x AS x, p.y AS y FROM (SELECT curve_id, unnest(r) AS p FROM f)""", "y")
def k14(spark, sf):
    return k.max_jump_filter(v.traced(spark, sf))


@query("k15_fill_linear", with_(v.TRACED) + """, a AS (SELECT curve_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
    FROM traced WINDOW w AS (PARTITION BY curve_id ORDER BY x)),
    b AS (SELECT *, CAST(unnest(range(x1, coalesce(x2, x1 + 1))) AS INTEGER) AS x FROM a)
    SELECT curve_id, x, CASE WHEN x = x1 THEN y1 ELSE y1 + (y2 - y1) * ((x - x1) / (x2 - x1)) END AS y, x = x1 AS present FROM b""", "y")
def k15(spark, sf):
    return k.fill_linear(v.traced(spark, sf), counted=v.noisy(spark, sf))


@query("k16_fill_hold", with_(v.TRACED) + """, a AS (SELECT curve_id, x AS x1, y, lead(x) OVER (PARTITION BY curve_id ORDER BY x) AS x2,
    count(*) OVER (PARTITION BY curve_id) AS n FROM traced)
    SELECT curve_id, CAST(unnest(CASE WHEN n >= 10 AND x2 - x1 > 3 AND x2 - x1 <= 12 THEN range(x1, x2) ELSE [x1] END) AS INTEGER) AS x, y FROM a""", "y")
def k16(spark, sf):
    return k.fill_hold(v.traced(spark, sf), max_gap=12, counted=v.noisy(spark, sf))


def whole_traced(spark, sf):
    t = v.traced(spark, sf)
    return t.select("curve_id", "x", F.col("y").cast("int").alias("y"))


@query("k17_skip_excursion")
def k17(spark, sf):
    return k.skip_excursion(whole_traced(spark, sf), jump=4, reach=30, back=3)


@query("k18_prepend_shared_start", with_(v.TRACED) + """, f AS (SELECT curve_id % 5 AS image_id, curve_id, min(x) AS x0, min_by(y, x) AS y0 FROM traced GROUP BY 1, 2),
    g AS (SELECT image_id, min(x0) AS mx, min(y0) AS ty FROM f GROUP BY 1)
    SELECT curve_id % 5 AS image_id, curve_id, x, y FROM traced UNION ALL
    SELECT image_id, curve_id, CAST(unnest(range(mx, x0)) AS INTEGER) AS x, ty AS y FROM f JOIN g USING (image_id) WHERE x0 - mx > 5 AND y0 - ty < 15""", "y")
def k18(spark, sf):
    t = v.traced(spark, sf).withColumn("image_id", F.col("curve_id") % 5)
    return k.prepend_shared_start(t, late=5)


RESAMPLE = """g AS (SELECT *, lead(t) OVER w AS t2, lead(s) OVER w AS s2, row_number() OVER w AS rn, max(t) OVER (PARTITION BY curve_id) AS e,
    count(*) OVER (PARTITION BY curve_id) AS n FROM {src} WINDOW w AS (PARTITION BY curve_id ORDER BY t, s)),
grid AS (SELECT curve_id, unnest(range(0, CAST(ceil((max(e) + {st}) / {st}) AS BIGINT))) AS kk FROM g WHERE n > 1 GROUP BY curve_id),
resampled AS (SELECT grid.curve_id, kk * {st} AS t, CASE WHEN kk * {st} <= g.t OR g.t2 IS NULL THEN g.s
    ELSE g.s + (s2 - g.s) * ((kk * {st} - g.t) / (t2 - g.t)) END AS s
    FROM grid JOIN g ON g.curve_id = grid.curve_id AND (g.rn = 1 OR g.t <= kk * {st}) AND (g.t2 IS NULL OR g.t2 > kk * {st})
    UNION ALL SELECT curve_id, t, s FROM g WHERE n = 1)"""


@query("k19_resample", with_(v.NOISY, RESAMPLE.format(src="noisy", st="5e-1")) + "SELECT * FROM resampled", "", None)
def k19(spark, sf):
    return k.resample(v.noisy(spark, sf))


@query("k20_step_expand", with_(v.REMAINING) + """, a AS (SELECT *, lag(s) OVER w AS p, row_number() OVER w AS seq FROM remaining
    WINDOW w AS (PARTITION BY curve_id ORDER BY t, s))
    SELECT curve_id, seq, 1 AS part, t, s FROM a UNION ALL SELECT curve_id, seq, 0, t, p FROM a WHERE p IS NOT NULL""", "s")
def k20(spark, sf):
    return k.step_expand(v.remaining(spark, sf))


@query("k21_find_steps", with_(v.REMAINING) + """, a AS (SELECT *, lag(s) OVER (PARTITION BY curve_id ORDER BY t, s) AS from_s FROM remaining)
    SELECT curve_id, t, from_s, s AS to_s, from_s - s AS drop FROM a WHERE from_s - s > 0.003e0""", "from_s to_s drop")
def k21(spark, sf):
    return k.find_steps(v.remaining(spark, sf), threshold=0.003)


@query("k22_count_steps_mask", with_(v.TRACED) + """, a AS (SELECT curve_id, y, lag(y) OVER (PARTITION BY curve_id ORDER BY x) AS p
    FROM (SELECT curve_id, x, min(y) AS y FROM traced GROUP BY 1, 2) WHERE x % 5 = 0)
    SELECT c.curve_id, coalesce(n, 0) AS steps FROM (SELECT DISTINCT curve_id FROM traced) c LEFT JOIN
    (SELECT curve_id, count(*) FILTER (abs(y - p) > 3) AS n FROM a GROUP BY 1) USING (curve_id)""")
def k22(spark, sf):
    return k.count_steps_mask(v.traced(spark, sf))


@query("k23_extend_plateau", with_(v.PAIR) + """, tr AS (SELECT image_id, CASE style WHEN 'A' THEN 'dashed' ELSE 'solid' END AS style, CAST(t AS INTEGER) AS x, (1 - s) * 100 AS y FROM pair),
    la AS (SELECT *, style = 'dashed' AND row_number() OVER (w ORDER BY x) > floor(count(*) OVER w * 0.6e0) AS late FROM tr WINDOW w AS (PARTITION BY image_id, style)),
    lv AS (SELECT image_id, min(y) FILTER (late) AS top, max(x) FILTER (style = 'dashed') AS ux, max(x) FILTER (style = 'solid') AS lx FROM la GROUP BY 1 HAVING count(*) FILTER (late) >= 10),
    st AS (SELECT l.*, (SELECT min(x) FROM la WHERE la.image_id = l.image_id AND late AND abs(y - top) < 2) AS x0 FROM lv l WHERE lx IS NOT NULL),
    pl AS (SELECT s.*, (SELECT avg(y) FROM tr WHERE tr.image_id = s.image_id AND style = 'solid' AND x >= x0) AS mean FROM st s),
    fl AS (SELECT *, CASE WHEN top > mean - 5 THEN mean - 10 ELSE top END AS flat FROM pl)
    SELECT image_id, style, x, CASE WHEN style = 'dashed' AND x >= x0 AND y > flat + 3 THEN flat ELSE y END AS y, true AS present FROM tr LEFT JOIN fl USING (image_id)
    UNION ALL SELECT image_id, 'dashed', CAST(unnest(range(ux + 1, least(lx, 95) + 1)) AS INTEGER), flat, false FROM fl""", "y", 7)
def k23(spark, sf):
    p = v.pair(spark, sf)
    traced = p.select("image_id", F.when(F.col("style") == "A", "dashed").otherwise("solid").alias("style"),
                      F.col("t").cast("int").alias("x"), ((1 - F.col("s")) * 100).alias("y"))
    return k.extend_plateau(traced)


@query("clean_curve", with_(v.MANY, CONTINUITY.format(src="many")) + """,
    c1 AS (SELECT curve_id, t, CASE WHEN m > 0.1e0 AND m < 0.95e0 THEN least(1e0, s * (1e0 / m)) ELSE s END AS s FROM
        (SELECT *, max(s) OVER (PARTITION BY curve_id) AS m FROM kept)),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY t) AS rn FROM c1),
    c3 AS (SELECT curve_id, 0e0 AS t, 1e0 AS s FROM c2 WHERE rn = 1 AND (t > 0.01e0 OR s < 0.999e0)
        UNION ALL SELECT curve_id, t, s FROM c2 WHERE NOT (rn = 1 AND t <= 0.01e0 AND s < 0.999e0)),
    c4 AS (SELECT curve_id, t, least(1e0, min(s) OVER (PARTITION BY curve_id ORDER BY t ROWS UNBOUNDED PRECEDING)) AS s FROM c3),
    """ + THIN.format(src="c4", tt="0.005e0", ts="0.005e0") + ", " + TRIM.format(src="thinned") + " SELECT * FROM trimmed", "t s")
def clean_curve(spark, sf):
    return k.clean_curve(v.many(spark, sf))


@query("clean_curve_min_drop", with_(v.NOISY) + """,
    c0 AS (SELECT curve_id, round(t, 3) AS t, min(s) AS s FROM noisy GROUP BY 1, 2),
    c1 AS (SELECT curve_id, t, CASE WHEN m > 0.1e0 AND m < 0.95e0 THEN least(1e0, s * (1e0 / m)) ELSE s END AS s FROM
        (SELECT *, max(s) OVER (PARTITION BY curve_id) AS m FROM c0)),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY t) AS rn FROM c1),
    c3 AS (SELECT curve_id, 0e0 AS t, 1e0 AS s FROM c2 WHERE rn = 1 AND (t > 0.01e0 OR s < 0.99e0)
        UNION ALL SELECT curve_id, t, s FROM c2 WHERE NOT (rn = 1 AND t <= 0.01e0 AND s < 0.99e0)),
    """ + DROP.format(src="c3", tol="0.005e0", start="1e0") + ", " + THIN.format(src="dropped", tt="0.005e0", ts="0.005e0")
       + " SELECT * FROM thinned", "t s")
def clean_curve_min_drop(spark, sf):
    return k.clean_curve(v.noisy(spark, sf), dedup="min", monotone="drop", min_start=0.99, trim=False)


FLAT = """ahead AS (SELECT curve_id, t, s, lead(s) OVER (PARTITION BY curve_id ORDER BY t, s) AS n,
        row_number() OVER (PARTITION BY curve_id ORDER BY t, s) AS rn FROM dropped),
    f AS (SELECT curve_id, list_reduce(list({'t': t, 's': s, 'n': n, 'rn': rn} ORDER BY t, s), lambda a, x:
        CASE WHEN x.rn = 1 THEN a WHEN x.n IS NULL OR abs(x.s - a[-1].s) > 0.001e0 OR abs(x.n - x.s) > 0.001e0
        THEN list_append(a, x) ELSE a END, list({'t': t, 's': s, 'n': n, 'rn': rn} ORDER BY t, s)[1:1]) AS r FROM ahead GROUP BY 1),
    flat AS (SELECT curve_id, p.t AS t, p.s AS s FROM (SELECT curve_id, unnest(r) AS p FROM f)),
    """


@query("clean_curve_hybrid", with_(v.NOISY, DROP.format(src="noisy", tol="0.005e0", start="s")) + """,
    """ + FLAT + RESAMPLE.format(src="flat", st="5e-1") + " SELECT * FROM resampled", "", None)
def clean_curve_hybrid(spark, sf):
    points = v.noisy(spark, sf)
    return k.resample(k.drop_flat(k.monotone_drop(points, start=None), counted=points), counted=points)
