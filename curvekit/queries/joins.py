"""Queries of lookups, spatial joins and curve pairs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import pairs as x
from . import views as v
from .base import query, table
from .clean import with_

WIDE = """wide AS (SELECT image_id, t, max(s) FILTER (style = 'A') AS y1, max(s) FILTER (style = 'R') AS y2 FROM pair GROUP BY 1, 2)"""
AB = dict(a="A", b="R")

# pixel pictures: an image per nation, columns are order months, y from the price
DARK = """dark AS (SELECT DISTINCT c_nationkey AS image_id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS x,
    CAST(floor(o_totalprice / 2500e0) AS INTEGER) AS y FROM orders JOIN customer ON o_custkey = c_custkey)"""
SPOTS = """spots AS (SELECT s_nationkey AS image_id, s_suppkey AS curve_id, CAST(((year(l_shipdate) - 1995) * 12 + month(l_shipdate)) AS INTEGER) AS px,
    CAST(floor(avg(l_extendedprice) / 500e0) AS INTEGER) AS py FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)"""
# the same spots with prices in cents, whose sums do not depend on the order of addition
EXACT_SPOTS = SPOTS.replace("CAST(floor(avg(l_extendedprice) / 500e0) AS INTEGER)", "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // (count(l_extendedprice) * 50000) AS INTEGER)")
BOXES = """boxes AS (SELECT s_nationkey AS image_id, s_name AS "text", CAST(s_suppkey % 90 AS INTEGER) AS x, CAST(s_suppkey * 7 % 200 AS INTEGER) AS y,
    CAST(4 + s_suppkey % 13 AS INTEGER) AS w, CAST(3 + s_suppkey % 9 AS INTEGER) AS h, CAST(s_suppkey * 3 % 100 AS INTEGER) AS conf, s_suppkey AS seq FROM supplier)"""


def dark(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("image_id"),
                    ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("int").alias("x"),
                    F.floor(F.col("o_totalprice") / 2500.0).cast("int").alias("y")).distinct()


def spots(spark, sf):
    """Mean price per supplier and month as a row of the picture. Prices are added in cents: a sum of doubles depends on the order of addition, and the floor
    of a mean that lies on a whole row with it."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("int")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    sums = li.groupBy(F.col("s_nationkey").alias("image_id"), F.col("s_suppkey").alias("curve_id"), month.alias("px")).agg(cents.alias("_c"), (F.count("l_extendedprice") * 50000).alias("_n"))
    return sums.select("image_id", "curve_id", "px", F.expr("cast((_c - pmod(_c, nullif(_n, 0))) div nullif(_n, 0) as int)").alias("py"))


def boxes(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("image_id"), F.col("s_name").alias("text"), (k % 90).cast("int").alias("x"), (k * 7 % 200).cast("int").alias("y"),
        (4 + k % 13).cast("int").alias("w"), (3 + k % 9).cast("int").alias("h"), (k * 3 % 100).cast("int").alias("conf"), k.alias("seq"))


@query("j01_equi_join", with_(v.PAIR, WIDE) + "SELECT image_id, t, y1, y2 FROM wide WHERE y1 IS NOT NULL AND y2 IS NOT NULL", "y1 y2")
def j01(spark, sf):
    return j.side_by_side(v.pair(spark, sf), **AB)


def uneven(spark, sf):
    """Pairs where curve R misses every seventh month and both agree until month 30."""
    p = v.pair(spark, sf)
    near = F.when(F.col("t") < 30, 0.9 - F.col("t") * 1e-3 + F.floor(F.col("s") * 1e3) * 1e-6).otherwise(F.col("s"))
    return p.where((F.col("style") != "R") | (F.col("t") % 7 != 3)).withColumn("s", near)


UNEVEN = """uneven AS (SELECT image_id, style, t, CASE WHEN t < 30 THEN 0.9e0 - t * 1e-3 + floor(s * 1e3) * 1e-6 ELSE s END AS s FROM pair WHERE style <> 'R' OR t % 7 <> 3)"""
UWIDE = WIDE.replace("FROM pair", "FROM uneven").replace("wide AS", "uwide AS")
UDIV = """udiv AS (SELECT image_id, count(*) AS common, coalesce(min(t) FILTER (abs(y1 - y2) > {thr}), {none}) AS t_div FROM uwide
    WHERE y1 IS NOT NULL AND y2 IS NOT NULL GROUP BY 1)"""
DIV2, DIV1 = UDIV.format(thr="0.02e0", none="max(t) + 1"), UDIV.format(thr="0.01e0", none="NULL")


@query("j02_early_union", with_(v.PAIR, UNEVEN, UWIDE, DIV2) + """SELECT image_id, t, y1, y2, CASE WHEN y1 IS NOT NULL AND y2 IS NOT NULL THEN (y1 + y2) / 2
    ELSE coalesce(y1, y2) END AS shared FROM uwide JOIN udiv USING (image_id) WHERE t < t_div""", "y1 y2 shared")
def j02(spark, sf):
    p = uneven(spark, sf)
    return j.early_union(p, x.divergence_time(p, **AB), **AB)


GRID = """grid AS (SELECT c.curve_id, g.t FROM (SELECT DISTINCT curve_id FROM noisy) c, (SELECT unnest(range(0, 21)) * 5e0 AS t) g)"""


def grid(spark, sf):
    return v.noisy(spark, sf).select("curve_id").distinct().withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i * F.lit(5.0))))


@query("j04_asof_step", with_(v.NOISY, GRID) + "SELECT g.curve_id, g.t, p.s FROM grid g ASOF LEFT JOIN noisy p ON g.curve_id = p.curve_id AND g.t >= p.t", "s")
def j04(spark, sf):
    return j.asof_step(v.noisy(spark, sf), grid(spark, sf))


@query("j05_asof_step_or_first", with_(v.NOISY, GRID) + """SELECT g.curve_id, g.t, coalesce(p.s, f.s) AS s FROM grid g ASOF LEFT JOIN noisy p
    ON g.curve_id = p.curve_id AND g.t >= p.t LEFT JOIN (SELECT curve_id, min_by(s, t) AS s FROM noisy GROUP BY 1) f ON f.curve_id = g.curve_id""", "s")
def j05(spark, sf):
    return j.asof_step(v.noisy(spark, sf), grid(spark, sf), or_first=True)


@query("j06_nearest", with_(v.NOISY, GRID) + """SELECT g.curve_id, g.t, min_by(p.t, struct_pack(d := abs(p.t - g.t), t := p.t)) AS near_t,
    min_by(p.s, struct_pack(d := abs(p.t - g.t), t := p.t)) AS s FROM grid g JOIN noisy p USING (curve_id) GROUP BY 1, 2 HAVING min(abs(p.t - g.t)) < 2e0""", "s near_t")
def j06(spark, sf):
    return j.nearest(v.noisy(spark, sf), grid(spark, sf), within=2.0)


@query("j07_mask_boxes", with_(DARK, BOXES) + """SELECT image_id, x, y FROM dark d WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.image_id = d.image_id AND b.conf > 30
    AND b.w >= 5 AND b.h >= 5 AND d.x >= greatest(0, b.x - 3) AND d.x < b.x + b.w + 3 AND d.y >= greatest(0, b.y - 3) AND d.y < b.y + b.h + 3)""")
def j07(spark, sf):
    return j.mask_boxes(dark(spark, sf), j.readable_boxes(boxes(spark, sf)), tile=16)


@query("j08_protect_then_mask", with_(DARK, BOXES) + """SELECT image_id, x, y FROM dark d WHERE (x + y) % 3 = 0 OR NOT EXISTS (SELECT 1 FROM boxes b WHERE b.image_id = d.image_id
    AND d.x >= greatest(0, b.x - 5) AND d.x < b.x + b.w + 5 AND d.y >= greatest(0, b.y - 5) AND d.y < b.y + b.h + 5)""")
def j08(spark, sf):
    d = dark(spark, sf)
    return j.protect_then_mask(d, j.box_edges(boxes(spark, sf), pad=5), d.where((F.col("x") + F.col("y")) % 3 == 0), tile=16)


@query("j09_nearest_dark", with_(DARK, EXACT_SPOTS) + """SELECT s.image_id, s.curve_id, px, py, d.dist, d.near_y FROM spots s LEFT JOIN
    (SELECT s.image_id, s.px, s.py, sqrt(min((d.x - px) * (d.x - px) + (d.y - py) * (d.y - py))) AS dist,
     min_by(d.y, struct_pack(a := (d.x - px) * (d.x - px) + (d.y - py) * (d.y - py), b := d.y - py, c := d.x - px)) AS near_y
     FROM (SELECT DISTINCT image_id, px, py FROM spots) s JOIN dark d ON d.image_id = s.image_id AND abs(d.x - px) <= 8 AND abs(d.y - py) <= 8 GROUP BY 1, 2, 3) d
    USING (image_id, px, py)""", "dist")
def j09(spark, sf):
    return j.nearest_dark(spots(spark, sf), dark(spark, sf))


@query("j10_nearest_vertical", with_(DARK, EXACT_SPOTS) + """SELECT s.image_id, s.curve_id, px AS x, py AS y, d.o AS "offset" FROM spots s LEFT JOIN
    (SELECT s.image_id, s.px, s.py, min_by(d.y - py, struct_pack(a := abs(d.y - py), b := d.y - py)) AS o FROM (SELECT DISTINCT image_id, px, py FROM spots) s
     JOIN dark d ON d.image_id = s.image_id AND d.x = px AND abs(d.y - py) <= 15 GROUP BY 1, 2, 3) d USING (image_id, px, py)""")
def j10(spark, sf):
    return j.nearest_vertical(spots(spark, sf).withColumnsRenamed({"px": "x", "py": "y"}), dark(spark, sf))


@query("j11_any_in_gap", with_(DARK, SPOTS) + """, g AS (SELECT image_id, curve_id, px AS x, py AS y1, py + curve_id % 40 AS y2 FROM spots)
    SELECT image_id, curve_id, x, y1, y2, EXISTS (SELECT 1 FROM dark d WHERE d.image_id = g.image_id AND d.x = g.x AND d.y >= y1 + 2 AND d.y < y2 - 2) AS has_pixels FROM g""")
def j11(spark, sf):
    g = spots(spark, sf).select("image_id", "curve_id", F.col("px").alias("x"), F.col("py").alias("y1"), (F.col("py") + F.col("curve_id") % 40).alias("y2"))
    return j.any_in_gap(g, dark(spark, sf))


NAMES = """names_a AS (SELECT DISTINCT p_size AS image_id, p_type || ' ' || p_brand AS name_a FROM part),
    names_b AS (SELECT DISTINCT p_size AS image_id, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) WHEN p_partkey % 3 = 0 THEN upper(substr(p_type, 1, 5)) ELSE p_name END AS name_b FROM part),
    sim AS (SELECT image_id, name_a, name_b FROM (SELECT *, regexp_replace(lower(name_a), '[^a-z0-9]', '', 'g') AS na, regexp_replace(lower(name_b), '[^a-z0-9]', '', 'g') AS nb
    FROM names_a JOIN names_b USING (image_id)) WHERE contains(lower(name_a), lower(name_b)) OR contains(lower(name_b), lower(name_a))
    OR (na <> '' AND nb <> '' AND (contains(na, nb) OR contains(nb, na) OR substr(na, 1, least(4, len(na), len(nb))) = substr(nb, 1, least(4, len(na), len(nb))))))"""


@query("j12_fuzzy_name", with_(NAMES) + "SELECT image_id, name_b, min(name_a) AS name_a FROM sim GROUP BY 1, 2")
def j12(spark, sf):
    p = table(spark, sf, "part")
    a = p.select(F.col("p_size").alias("image_id"), F.concat_ws(" ", "p_type", "p_brand").alias("name_a"))
    b = p.select(F.col("p_size").alias("image_id"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).when(
        F.col("p_partkey") % 3 == 0, F.upper(F.substring("p_type", 1, 5))).otherwise(F.col("p_name")).alias("name_b"))
    return j.first_similar(a, b)


@query("j13_upper_bound_filter", with_(DARK, SPOTS) + """SELECT image_id, d.x, d.y FROM dark d LEFT JOIN (SELECT image_id, px AS x, min(py) AS top FROM spots GROUP BY 1, 2) u
    USING (image_id, x) WHERE top IS NULL OR d.y >= top - 3""")
def j13(spark, sf):
    return j.upper_bound_filter(dark(spark, sf), spots(spark, sf).withColumnsRenamed({"px": "x", "py": "y"}))


@query("j14_dash_overlap", with_(DARK, SPOTS) + """SELECT s.image_id, s.curve_id, count(*) AS cells, count(d.x) / count(*) AS ratio
    FROM spots s LEFT JOIN dark d ON d.image_id = s.image_id AND d.x = s.px AND d.y = s.py GROUP BY 1, 2""", "ratio")
def j14(spark, sf):
    return j.dash_overlap(spots(spark, sf), dark(spark, sf), x="px", y="py")


@query("j15_merge_masks", with_(DARK, SPOTS) + """, s2 AS (SELECT DISTINCT image_id, px AS x, py AS y, 'second' AS v FROM spots)
    SELECT image_id, x, y, 'first' AS v FROM dark UNION ALL SELECT * FROM s2 ANTI JOIN dark USING (image_id, x, y)""")
def j15(spark, sf):
    return j.merge_masks(dark(spark, sf).withColumn("v", F.lit("first")), spots(spark, sf).select(
        "image_id", F.col("px").alias("x"), F.col("py").alias("y"), F.lit("second").alias("v")))


@query("j16_merge_box_passes", with_(BOXES) + """, f AS (SELECT image_id, x, y, w, h FROM boxes WHERE conf > 70),
    g AS (SELECT image_id, list_reduce(list({'x': x, 'y': y, 'w': w, 'h': h} ORDER BY seq), lambda a, b: CASE WHEN len(list_filter(a, lambda q: abs(q.x - b.x) < 10 AND abs(q.y - b.y) < 10)) > 0
        THEN a ELSE list_append(a, b) END, coalesce(any_value(p), CAST([] AS STRUCT(x INTEGER, y INTEGER, w INTEGER, h INTEGER)[]))) AS r FROM
        (SELECT b.*, p FROM boxes b LEFT JOIN (SELECT image_id, list({'x': x, 'y': y, 'w': w, 'h': h}) AS p FROM f GROUP BY 1) USING (image_id) WHERE conf <= 70) GROUP BY 1)
    SELECT image_id, u.x AS x, u.y AS y, u.w AS w, u.h AS h FROM (SELECT image_id, unnest(r) AS u FROM g) UNION ALL
    SELECT * FROM f WHERE image_id NOT IN (SELECT image_id FROM g)""")
def j16(spark, sf):
    b = boxes(spark, sf)
    return j.merge_box_passes(b.where("conf > 70"), b.where("conf <= 70"))


@query("j17_paint_layers", with_(DARK, SPOTS) + """SELECT image_id, x, y, max_by(label, p) AS label FROM (SELECT image_id, x, y, 'dark' AS label, 0 AS p FROM dark
    UNION ALL SELECT image_id, px, py, 'spot', 1 FROM spots UNION ALL SELECT image_id, x, y, 'third', 2 FROM dark WHERE (x + y) % 3 = 0) GROUP BY 1, 2, 3""")
def j17(spark, sf):
    d = dark(spark, sf)
    s = spots(spark, sf).select("image_id", F.col("px").alias("x"), F.col("py").alias("y"), F.lit("spot").alias("label"))
    return j.paint_layers([d.withColumn("label", F.lit("dark")), s, d.where((F.col("x") + F.col("y")) % 3 == 0).withColumn("label", F.lit("third"))])


# -- sets ------------------------------------------------------------------------------------------

SPOT_CELLS = "cells AS (SELECT DISTINCT image_id, px AS x, py AS y FROM spots)"


def spot_cells(spark, sf):
    return spots(spark, sf).select("image_id", F.col("px").alias("x"), F.col("py").alias("y")).distinct()


@query("u01_mask_union", with_(DARK, SPOTS, SPOT_CELLS) + "SELECT * FROM dark UNION SELECT * FROM cells")
def u01(spark, sf):
    from ..operators import masks
    return masks.mask_union(dark(spark, sf), spot_cells(spark, sf))


@query("u02_mask_intersect", with_(DARK, SPOTS, SPOT_CELLS) + "SELECT * FROM dark INTERSECT SELECT * FROM cells")
def u02(spark, sf):
    from ..operators import masks
    return masks.mask_intersect(dark(spark, sf), spot_cells(spark, sf))


@query("u03_mask_except", with_(DARK, SPOTS, SPOT_CELLS) + "SELECT * FROM dark EXCEPT SELECT * FROM cells")
def u03(spark, sf):
    from ..operators import masks
    return masks.mask_except(dark(spark, sf), spot_cells(spark, sf))


# -- curve pairs -----------------------------------------------------------------------------------

@query("x01_divergence_time", with_(v.PAIR, UNEVEN, UWIDE, DIV2) + "SELECT * FROM udiv")
def x01(spark, sf):
    return x.divergence_time(uneven(spark, sf), **AB)


@query("x02_merge_overlap", with_(v.PAIR, UNEVEN, UWIDE, DIV2) + """SELECT image_id, style, t, CASE WHEN t < t_div AND y1 IS NOT NULL AND y2 IS NOT NULL THEN (y1 + y2) / 2 ELSE s END AS s
    FROM uneven JOIN uwide USING (image_id, t) LEFT JOIN udiv USING (image_id) UNION ALL
    SELECT image_id, CASE WHEN y1 IS NULL THEN 'A' ELSE 'R' END, t, coalesce(y1, y2) FROM uwide JOIN udiv USING (image_id) WHERE t < t_div AND (y1 IS NULL OR y2 IS NULL)""", "s")
def x02(spark, sf):
    return x.merge_overlap(uneven(spark, sf), **AB)


@query("x03_fix_ordering", with_(v.PAIR, UNEVEN, UWIDE, DIV1) + """, c AS (SELECT *, t >= t_div AND y1 < y2 - 0.001e0 AS w, t >= t_div AND NOT (y1 < y2 - 0.001e0) AS g FROM uwide
    JOIN udiv USING (image_id) WHERE y1 IS NOT NULL AND y2 IS NOT NULL),
    a AS (SELECT image_id FROM c GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (w) > 0 AND count(*) FILTER (g) >= count(*) FILTER (w))
    SELECT image_id, style, t, s FROM uneven ANTI JOIN a USING (image_id) UNION ALL
    SELECT image_id, 'A', t, CASE WHEN w THEN y2 ELSE y1 END FROM c SEMI JOIN a USING (image_id) UNION ALL
    SELECT image_id, 'R', t, CASE WHEN w THEN y1 ELSE y2 END FROM c SEMI JOIN a USING (image_id)""", "s")
def x03(spark, sf):
    return x.fix_ordering(uneven(spark, sf), upper="A", lower="R")


FLAGS = f"""flags AS (SELECT l_linenumber AS image_id, l_returnflag AS style, CAST({v.MONTH} AS INTEGER) AS x, round(avg(l_quantity), 9) AS y FROM lineitem GROUP BY 1, 2, 3)"""


def flags(spark, sf):
    """Three pixel curves per image: mean quantity per month and return flag."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("image_id"), F.col("l_returnflag").alias("style"),
                                                F.expr(v.MONTH).cast("int").alias("x")).agg(F.round(F.avg("l_quantity"), 9).alias("y"))


@query("x04_crossings", with_(FLAGS) + """, d AS (SELECT a.image_id, a.x, a.style AS curve_a, b.style AS curve_b, a.y - b.y AS d,
    lag(a.y - b.y) OVER (PARTITION BY a.image_id, a.style, b.style ORDER BY a.x) AS p FROM flags a JOIN flags b ON a.image_id = b.image_id AND a.x = b.x AND a.style < b.style)
    SELECT image_id, x, curve_a, curve_b FROM d WHERE d * p < 0""")
def x04(spark, sf):
    return x.crossings(flags(spark, sf), ["A", "N", "R"])


FWIDE = """fwide AS (SELECT * FROM (SELECT image_id, x, max(y) FILTER (style = 'A') AS y1, max(y) FILTER (style = 'R') AS y2 FROM flags GROUP BY 1, 2) WHERE y1 IS NOT NULL AND y2 IS NOT NULL)"""
SWAPPED = """SELECT image_id, style, x, CASE WHEN z.y1 IS NOT NULL AND style = 'A' THEN z.y2 WHEN z.y1 IS NOT NULL AND style = 'R' THEN z.y1 ELSE y END AS y
    FROM flags LEFT JOIN swaps z USING (image_id, x)"""


@query("x05_reorder_segments", with_(FLAGS, FWIDE) + """, a AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x) AS rn, count(*) OVER (PARTITION BY image_id) AS n, y1 - y2 AS d FROM fwide),
    b AS (SELECT *, count(*) FILTER (rn <= greatest(30, n // 3) AND abs(d) > 3) OVER w AS k, avg(d) FILTER (rn <= greatest(30, n // 3) AND abs(d) > 3) OVER w AS m1,
        avg(d) FILTER (rn <= greatest(30, n // 3)) OVER w AS m0 FROM a WINDOW w AS (PARTITION BY image_id)),
    swaps AS (SELECT * FROM b WHERE n >= 5 AND (y1 > y2) <> (CASE WHEN k >= 5 THEN m1 ELSE m0 END > 0)) """ + SWAPPED, "y")
def x05(spark, sf):
    return x.reorder_segments(flags(spark, sf), **AB)


@query("x06_swap_where", with_(FLAGS, FWIDE) + """, swaps AS (SELECT image_id, x, y1, y2 FROM fwide JOIN (SELECT image_id, count(*) AS n FROM fwide GROUP BY 1) USING (image_id)
    WHERE n >= 20 AND y1 > y2 + 1) """ + SWAPPED, "y")
def x06(spark, sf):
    return x.swap_where(flags(spark, sf), upper="A", lower="R", slack=1)


SEGS = """s0 AS (SELECT *, CASE WHEN abs(y2 - y1) >= 1 THEN y2 - y1 > 0 END AS up FROM fwide),
    s1 AS (SELECT *, lag(up) OVER (PARTITION BY image_id ORDER BY x) AS pu FROM s0),
    segs AS (SELECT *, CAST(sum(CASE WHEN up IS NOT NULL AND (pu IS NULL OR pu <> up) THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY x) AS BIGINT) AS seg FROM s1)"""


@query("w18_order_segments", with_(FLAGS, FWIDE, SEGS) + """SELECT image_id, seg AS segment, min(x) AS x_from, max(x) AS x_to, count(*) AS columns, bool_and(up) AS a_above
    FROM segs WHERE up IS NOT NULL GROUP BY 1, 2""")
def w18(spark, sf):
    return x.order_segments(flags(spark, sf), **AB, min_sep=1)


DASHES = f"""dashes AS (SELECT DISTINCT l_linenumber AS image_id, CAST({v.MONTH} AS INTEGER) AS x, CAST(l_quantity AS INTEGER) AS y FROM lineitem WHERE l_discount > 0.08e0 AND l_tax > 0.06e0)"""


def dashes(spark, sf):
    return table(spark, sf, "lineitem").where("l_discount > 0.08D and l_tax > 0.06D").select(
        F.col("l_linenumber").alias("image_id"), F.expr(v.MONTH).cast("int").alias("x"), F.col("l_quantity").cast("int").alias("y")).distinct()


@query("x07_swap_segments_by_evidence", with_(FLAGS, FWIDE, SEGS, DASHES) + """,
    hit AS (SELECT s.image_id, s.x, s.seg, s.y1, s.y2, (SELECT count(*) FROM dashes d WHERE d.image_id = s.image_id AND d.x = s.x AND d.y BETWEEN CAST(trunc(s.y1) AS INTEGER) - 1 AND CAST(trunc(s.y1) AS INTEGER) + 1) AS h1,
        (SELECT count(*) FROM dashes d WHERE d.image_id = s.image_id AND d.x = s.x AND d.y BETWEEN CAST(trunc(s.y2) AS INTEGER) - 1 AND CAST(trunc(s.y2) AS INTEGER) + 1) AS h2 FROM segs s WHERE up IS NOT NULL),
    dash AS (SELECT image_id, seg, sum(h1) AS d1, sum(h2) AS d2, count(*) AS n FROM hit GROUP BY 1, 2),
    votes AS (SELECT image_id, coalesce(sum(n * greatest(1, abs(d1 - d2))) FILTER (d1 > d2), 0) > coalesce(sum(n * greatest(1, abs(d1 - d2))) FILTER (d2 > d1), 0) AS f FROM dash WHERE n >= 5 GROUP BY 1),
    swaps AS (SELECT h.* FROM hit h JOIN dash USING (image_id, seg) JOIN votes USING (image_id) WHERE n >= 3 AND (d1 > d2) <> f
        AND image_id IN (SELECT image_id FROM fwide GROUP BY 1 HAVING count(*) >= 10)) """ + SWAPPED, "y")
def x07(spark, sf):
    return x.swap_segments_by_evidence(flags(spark, sf), dashes(spark, sf), **AB, min_sep=1)


@query("x08_fix_continuity", with_(FLAGS, FWIDE) + """, a AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY image_id) AS n, lead(y1) OVER w AS z1, lead(y2) OVER w AS z2, lead(x) OVER w AS x2
        FROM fwide WINDOW w AS (PARTITION BY image_id ORDER BY x)),
    b AS (SELECT *, coalesce(abs(z2 - y1) < abs(z1 - y1) AND abs(z1 - y2) < abs(z2 - y2), false) AS helps, abs(z1 - y1) AS j1, abs(z2 - y2) AS j2 FROM a),
    c AS (SELECT *, NOT helps AND j1 <= 1 AND j2 <= 1 AS calm, helps AND abs(y1 - y2) < 30 AND (j1 > 1 OR j2 > 1) AND i <= n - 10 AS trig FROM b),
    d AS (SELECT *, sum(CASE WHEN calm THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY x) AS blk FROM c),
    e AS (SELECT image_id, blk, max(i) FILTER (helps) AS li, max_by(x2, i) FILTER (helps) AS lx, any_value(n) AS n FROM d GROUP BY 1, 2),
    r AS (SELECT d.image_id, min(d.x2) AS f, any_value(lx) AS l FROM d JOIN e USING (image_id, blk) WHERE trig AND d.i < li AND e.n >= 20 GROUP BY d.image_id, blk)
    SELECT image_id, CASE WHEN style = 'A' AND hit THEN 'R' WHEN style = 'R' AND hit THEN 'A' ELSE style END AS style, x, y FROM
    (SELECT f.*, EXISTS (SELECT 1 FROM r WHERE r.image_id = f.image_id AND f.x BETWEEN r.f AND r.l) AS hit FROM flags f)""", "y")
def x08(spark, sf):
    return x.fix_continuity(flags(spark, sf), **AB, jump=1)


SUPP = """supp AS (SELECT n_nationkey AS image_id, s_suppkey AS curve_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'dashed' ELSE 'solid' END AS style FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def supp(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("image_id"), F.col("s_suppkey").alias("curve_id"), F.col("s_name").alias("name"),
                                               F.when(F.col("s_suppkey") % 3 == 0, "dashed").otherwise("solid").alias("style"))


@query("x09_relabel_by_overlap", with_(DARK, SPOTS, SUPP) + """, r AS (SELECT s.image_id, s.curve_id, count(d.x) / count(*) AS ratio FROM spots s LEFT JOIN dark d ON d.image_id = s.image_id AND d.x = s.px AND d.y = s.py GROUP BY 1, 2),
    c AS (SELECT s.*, ratio, row_number() OVER (PARTITION BY image_id ORDER BY curve_id) AS rn, count(*) OVER (PARTITION BY image_id) AS n FROM supp s LEFT JOIN r USING (image_id, curve_id)),
    g AS (SELECT a.image_id, a.style AS s0, b.style AS s1, (a.ratio > b.ratio) <> contains(a.style, 'dashed') AS sw FROM c a JOIN c b ON a.image_id = b.image_id AND a.rn = 1 AND b.rn = 2 WHERE a.n = 2)
    SELECT image_id, curve_id, name, style, CASE WHEN sw THEN CASE WHEN rn = 1 THEN s1 ELSE s0 END ELSE style END AS new_style FROM c LEFT JOIN g USING (image_id)""")
def x09(spark, sf):
    return x.relabel_by_overlap(supp(spark, sf), j.dash_overlap(spots(spark, sf), dark(spark, sf), x="px", y="py"))


DAYS = """cells0 AS (SELECT l_suppkey AS image_id, CAST(l_linenumber % 2 AS INTEGER) AS curve_id, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 10 AS INTEGER) AS x,
    CAST(l_quantity AS INTEGER) AS y, CAST(l_partkey * 37 % 256 AS INTEGER) AS gray FROM lineitem),
    traced AS (SELECT image_id, curve_id, x, min(y) AS y FROM cells0 GROUP BY 1, 2, 3), cells AS (SELECT image_id, x, y, min(gray) AS gray FROM cells0 GROUP BY 1, 2, 3),
    styles AS (SELECT DISTINCT image_id, curve_id, CASE WHEN curve_id = image_id % 2 THEN 'dashed' ELSE 'solid' END AS style FROM cells0)"""
#: a band of 30 to 60 columns; every third picture has one too short to decide
EVIDENCE = DAYS + """, plots AS (SELECT DISTINCT image_id, 5 AS px, CASE WHEN image_id % 3 = 0 THEN 90 ELSE 110 + image_id % 90 END AS pw FROM styles),
    span AS (SELECT image_id, CAST(px + floor(pw * 0.4e0) AS INTEGER) AS a, CAST(px + floor(pw * 0.7e0) AS INTEGER) AS b FROM plots),
    ends AS (SELECT image_id, curve_id, a, b, max_by(y, x) AS y FROM traced JOIN span USING (image_id) WHERE x >= a AND x < b GROUP BY 1, 2, 3, 4 HAVING b - a >= 30 AND count(*) >= 10),
    level AS (SELECT image_id, curve_id, y, b - a AS wide, unnest(range(a, b)) AS x FROM ends),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY image_id, curve_id) AS n, row_number() OVER (PARTITION BY image_id, curve_id ORDER BY x) - 1 AS i FROM traced),
    mid AS (SELECT *, floor(n * 0.25e0) AS lo, floor(n * 0.85e0) AS hi FROM ranked WHERE n >= 50),
    taken AS (SELECT image_id, curve_id, x, y FROM mid WHERE hi - lo >= 30 AND i >= lo AND i < hi AND (i - lo) % greatest(1, floor((hi - lo) / 200)) = 0),
    asked AS (SELECT image_id, curve_id, x, y, wide FROM level UNION ALL SELECT image_id, curve_id, x, y, NULL FROM taken),
    seen AS (SELECT a.image_id, a.curve_id, a.x, a.y, a.wide, coalesce(min(c.gray), 255) AS gray FROM asked a LEFT JOIN cells c ON c.image_id = a.image_id AND c.x = a.x AND c.y BETWEEN a.y - 2 AND a.y + 2
     WHERE a.x < 240 AND a.y < 48 GROUP BY 1, 2, 3, 4, 5),
    dens AS (SELECT image_id, curve_id, count(*) FILTER (gray < 150 AND y >= 3 AND y < 45) / max(wide) AS density FROM seen WHERE wide IS NOT NULL GROUP BY 1, 2),
    lim AS (SELECT image_id, curve_id, count(*) AS m, quantile_cont(gray, 0.3) AS cut FROM seen WHERE wide IS NULL GROUP BY 1, 2 HAVING count(*) >= 30),
    line AS (SELECT s.*, m, gray < cut AS dark, row_number() OVER w AS k FROM seen s JOIN lim USING (image_id, curve_id) WHERE wide IS NULL WINDOW w AS (PARTITION BY image_id, curve_id ORDER BY x)),
    chain AS (SELECT *, k - row_number() OVER (PARTITION BY image_id, curve_id, dark ORDER BY x) AS run FROM line),
    stretch AS (SELECT image_id, curve_id, m, dark, count(*) AS size, max(k) < m AS closed, count(*) - CAST(min(k) = 1 AS INTEGER) AS long FROM chain GROUP BY 1, 2, 3, 4, run),
    gaps AS (SELECT image_id, curve_id, coalesce(sum(size) FILTER (NOT dark), 0) / max(m) AS gap_ratio, count(*) FILTER (NOT dark AND closed AND long >= 2) AS n_gaps,
     stddev_pop(long) FILTER (NOT dark AND closed AND long >= 2) / avg(long) FILTER (NOT dark AND closed AND long >= 2) AS cv FROM stretch GROUP BY 1, 2),
    ev AS (SELECT image_id, curve_id, density, coalesce(gap_ratio, 0e0) AS gap_ratio, coalesce(n_gaps, 0) AS n_gaps, CASE WHEN n_gaps >= 3 AND cv < 1 THEN 1 - cv ELSE 0e0 END AS regularity
     FROM styles LEFT JOIN dens USING (image_id, curve_id) LEFT JOIN gaps USING (image_id, curve_id)),
    score AS (SELECT *, greatest(0e0, 3 * regularity + CASE WHEN gap_ratio BETWEEN 0.15e0 AND 0.4e0 THEN 1e0 WHEN gap_ratio > 0.4e0 THEN 0.5e0 * (1 - least(1e0, (gap_ratio - 0.4e0) / 0.3e0)) ELSE 0e0 END
     + CASE WHEN n_gaps BETWEEN 5 AND 30 THEN 0.8e0 WHEN n_gaps > 30 THEN -(n_gaps - 30) / 50e0 ELSE 0e0 END) AS dash_score FROM ev)"""


def daily(spark, sf):
    """Cells of pictures whose number grows with the suppliers, the curves traced in them, and their plots and sizes."""
    li = table(spark, sf, "lineitem")
    cells = li.select(F.col("l_suppkey").alias("image_id"), (F.col("l_linenumber") % 2).cast("int").alias("curve_id"), F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 10).cast("int").alias("x"),
                      F.col("l_quantity").cast("int").alias("y"), (F.col("l_partkey") * 37 % 256).cast("int").alias("gray"))
    ids = cells.select("image_id").distinct()
    n = F.col("image_id")
    return (cells, ids.select(n, F.lit(5).alias("px"), F.when(n % 3 == 0, 90).otherwise(110 + n % 90).cast("int").alias("pw")),
            ids.select(n, F.lit(240).alias("width"), F.lit(48).alias("height")))


@query("x09_dash_evidence", with_(EVIDENCE) + " SELECT * FROM score", "density gap_ratio regularity dash_score")
def x09_evidence(spark, sf):
    cells, plots, images = daily(spark, sf)
    return x.dash_evidence(cells, cells, plots, images)


@query("x09_relabel_by_evidence", with_(EVIDENCE) + """, two AS (SELECT a.image_id, a.density AS d0, b.density AS d1, a.dash_score AS s0, b.dash_score AS s1 FROM score a JOIN score b ON a.image_id = b.image_id AND a.curve_id = 0 AND b.curve_id = 1),
    who AS (SELECT image_id, CASE WHEN greatest(d0, d1) > 0.1e0 AND d0 IS NOT NULL AND d1 IS NOT NULL THEN CASE WHEN d0 > d1 * 1.3e0 THEN 1 WHEN d1 > d0 * 1.3e0 THEN 0 END END AS band,
     CASE WHEN abs(s0 - s1) > 0.2e0 THEN CASE WHEN s0 > s1 THEN 0 ELSE 1 END END AS gaps FROM two)
    SELECT image_id, curve_id, style, CASE WHEN coalesce(band, gaps) IS NULL THEN style WHEN curve_id = coalesce(band, gaps) THEN 'dashed' ELSE 'solid' END AS new_style,
    CASE WHEN band IS NOT NULL THEN 'density' WHEN gaps IS NOT NULL THEN 'gaps' END AS decided_by, CASE WHEN band IS NOT NULL THEN 0.85e0 WHEN gaps IS NOT NULL THEN 0.7e0 END AS sure
    FROM styles LEFT JOIN who USING (image_id)""")
def x09_relabel_evidence(spark, sf):
    cells, plots, images = daily(spark, sf)
    style = F.when(F.col("curve_id") == F.col("image_id") % 2, "dashed").otherwise("solid").alias("style")
    return x.relabel_by_evidence(cells.select("image_id", "curve_id", style).distinct(), x.dash_evidence(cells, cells, plots, images))


@query("x10_swap_labels", with_(SUPP) + """, c AS (SELECT *, count(*) OVER w AS n, CASE WHEN lag(curve_id) OVER o IS NULL THEN lead(name) OVER o ELSE lag(name) OVER o END AS on_, CASE WHEN lag(curve_id) OVER o IS NULL THEN lead(style) OVER o ELSE lag(style) OVER o END AS os
    FROM supp WINDOW w AS (PARTITION BY image_id), o AS (PARTITION BY image_id ORDER BY curve_id))
    SELECT image_id, curve_id, CASE WHEN n = 2 THEN on_ ELSE name END AS name, CASE WHEN n = 2 THEN os ELSE style END AS style FROM c""")
def x10(spark, sf):
    return x.swap_labels(supp(spark, sf))


@query("x12_curve_separation", with_(v.PAIR) + ", k AS (SELECT image_id, style" + "".join(
    f", coalesce(max_by(s, t) FILTER (t <= 90e0 * {f}), min_by(s, t)) AS v{i}" for i, f in enumerate(("0.25e0", "0.5e0", "0.75e0"))) + """ FROM pair GROUP BY 1, 2),
    d AS (SELECT a.image_id, abs(a.v0 - b.v0) AS d0, abs(a.v1 - b.v1) AS d1, abs(a.v2 - b.v2) AS d2 FROM k a JOIN k b ON a.image_id = b.image_id AND a.style = 'A' AND b.style = 'R')
    SELECT image_id, (d0 + d1 + d2) / 3 AS avg_diff, greatest(d0, d1, d2) AS max_diff, CASE WHEN greatest(d0, d1, d2) < 0.02e0 THEN 'WARNING' ELSE 'PASS' END AS status FROM d""", "avg_diff max_diff")
def x12(spark, sf):
    return x.curve_separation(v.pair(spark, sf), 90.0, **AB)
