"""Queries of runs, lines, components, morphology and line styles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks as m
from ..operators import runs as w
from . import raster as r
from . import views as v
from .base import query, table
from .clean import with_
from .pixels import DARKS, darks

SPARSE = "sparse AS (SELECT image_id, x, y FROM pixels WHERE gray < 60)"
PXD = with_(r.PIXELS, DARKS)
PXI = with_(r.PIXELS, DARKS, r.IMAGES)
ALL = with_(r.PIXELS, r.IMAGES, "cells AS (SELECT image_id, x, y FROM pixels)")


def sparse(spark, sf):
    return r.pixels(spark, sf).where("gray < 60").select("image_id", "x", "y")


def islands(src: str, line: str, pos: str, gap: int, name: str = "rn") -> str:
    """Common table expressions that number the runs of `src` as `run` in `name`."""
    return f"""{name}_0 AS (SELECT *, {pos} - lag({pos}) OVER (PARTITION BY image_id, {line} ORDER BY {pos}) AS gp FROM {src}),
    {name} AS (SELECT *, CAST(sum(CASE WHEN coalesce(gp, 999999) > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, {line} ORDER BY {pos}) AS INTEGER) AS run FROM {name}_0)"""


@query("w01_runs", PXD + ", " + islands("darks", "y", "x", 2) + ", " + islands("darks", "x", "y", 1, "cn")
       + """SELECT 'row' AS axis, image_id, y AS line, run, min(x) AS "start", max(x) AS "end", count(*) AS cells FROM rn GROUP BY 2, 3, 4
       UNION ALL SELECT 'col', image_id, x, run, min(y), max(y), count(*) FROM cn GROUP BY 2, 3, 4""")
def w01(spark, sf):
    d = darks(spark, sf)
    return w.runs(d, "row", 2).withColumn("axis", F.lit("row")).unionByName(w.runs(d, "col").withColumn("axis", F.lit("col")))


@query("w02_dash_rows", PXD + ", " + islands("darks", "y", "x", 1) + """,
    rs AS (SELECT image_id, y, run, min(x) AS a, max(x) AS b, count(*) AS n FROM rn GROUP BY 1, 2, 3),
    rg AS (SELECT *, b - a + 1 AS ln, a - lag(b) OVER (PARTITION BY image_id, y ORDER BY a) - 1 AS gp FROM rs),
    st AS (SELECT image_id, y, avg(gp) FILTER (gp <= 25) AS ga, avg(ln) FILTER (ln <= 30) AS ra, var_pop(gp) FILTER (gp <= 25) AS gv, var_pop(ln) FILTER (ln <= 30) AS rv, sum(n) AS n,
        count(*) FILTER (gp <= 25) AS kg, count(*) FILTER (ln <= 30) AS kr FROM rg GROUP BY 1, 2),
    ok AS (SELECT image_id, y FROM st WHERE n >= 10 AND kr >= 3 AND kg >= 2 AND ra < 15 AND ga > 2 AND gv / (ga + 0.1e0) < 5 AND rv / (ra + 0.1e0) < 5)
    SELECT DISTINCT d.image_id, d.x, d.y FROM darks d JOIN (SELECT image_id, x, y FROM darks SEMI JOIN ok USING (image_id, y)) s ON s.image_id = d.image_id AND abs(s.x - d.x) <= 1 AND abs(s.y - d.y) <= 1""")
def w02(spark, sf):
    d = darks(spark, sf)
    return w.dash_rows(d, d)


@query("w03_cluster_axis", PXD + ", " + islands("darks", "x", "y", 5) + "SELECT image_id, x, run AS cluster, median(y) AS center, count(*) AS cells FROM rn GROUP BY 1, 2, 3", "center")
def w03(spark, sf):
    return w.cluster_axis(darks(spark, sf))


ADAPT = """ga AS (SELECT *, y - lag(y) OVER (PARTITION BY image_id, x ORDER BY y) AS gp FROM darks),
    gb AS (SELECT *, 1 + count(*) FILTER (gp > 5) OVER p AS n5, 1 + count(*) FILTER (gp > 4) OVER p AS n4, 1 + count(*) FILTER (gp > 3) OVER p AS n3 FROM ga WINDOW p AS (PARTITION BY image_id, x)),
    gc AS (SELECT *, CASE WHEN n5 >= {k} THEN 5 WHEN n4 >= {k} THEN 4 WHEN n3 >= {k} THEN 3 ELSE 2 END AS g FROM gb),
    gd AS (SELECT *, CAST(sum(CASE WHEN gp IS NULL OR gp > g THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, x ORDER BY y) AS INTEGER) AS cluster FROM gc)"""


@query("w04_cluster_axis_adaptive", PXD + ", " + ADAPT.format(k=4) + "SELECT image_id, x, cluster, g AS gap, median(y) AS center, count(*) AS cells FROM gd GROUP BY 1, 2, 3, 4", "center")
def w04(spark, sf):
    return w.cluster_axis_adaptive(darks(spark, sf), 4)


NARROW = "darks AS (SELECT image_id, x, y FROM pixels WHERE gray < 120)"


@query("w05_cluster_with_style", with_(r.PIXELS, NARROW) + ", " + ADAPT.format(k=2) + """, sd AS (SELECT *, (x + y) % 3 = 0 AS d FROM gd),
    sc AS (SELECT *, max(cluster) OVER p AS k, count(*) FILTER (d) OVER p AS nd, count(*) OVER p AS n, (min(y) OVER p + max(y) OVER p) / 2 AS mid, max(y) OVER p - min(y) OVER p AS span FROM sd WINDOW p AS (PARTITION BY image_id, x)),
    hv AS (SELECT image_id, x, abs(median(y) FILTER (y > mid) - median(y) FILTER (y <= mid)) >= 3 AS h FROM sc GROUP BY 1, 2),
    pt AS (SELECT image_id, x, y, CASE WHEN k > 1 THEN CAST(cluster AS VARCHAR) WHEN nd > 0 AND nd < n THEN CASE WHEN d THEN 'd' ELSE 's' END
        WHEN n >= 4 AND span >= 4 AND h THEN CASE WHEN y <= mid THEN 'a' ELSE 'b' END ELSE '1' END AS part FROM sc JOIN hv USING (image_id, x))
    SELECT image_id, x, part, median(y) AS center, count(*) AS cells FROM pt GROUP BY 1, 2, 3""", "center")
def w05(spark, sf):
    d = r.pixels(spark, sf).where("gray < 120").select("image_id", "x", "y")
    return w.cluster_with_style(d, d.where((F.col("x") + F.col("y")) % 3 == 0))


def lines_sql(axis: str, share: str, gap: int, thick: int, near: bool) -> str:
    line, pos, along, across = ("y", "x", "width", "height") if axis == "h" else ("x", "y", "height", "width")
    edge = f" AND r.{line} >= floor({across} * 0.05e0)" if axis == "v" and not near else ""
    beside = f"""WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.image_id = l.image_id AND c.{pos} = l.pos AND (c.{line} BETWEEN l.line - 8 AND l.line - 5 OR c.{line} BETWEEN l.line + 5 AND l.line + 8))""" if near else ""
    return islands("cells", line, pos, gap, f"{axis}r") + ", " + islands("cells", line, pos, 1, f"{axis}q") + f""",
    {axis}1 AS (SELECT r.* FROM (SELECT image_id, {line}, run, min({pos}) AS a, max({pos}) AS b, count(*) AS n FROM {axis}r GROUP BY 1, 2, 3) r JOIN images USING (image_id) WHERE n >= floor({along} * {share}){edge}),
    {axis}2 AS (SELECT k.image_id, k.{line}, k.run, k.a, k.b, c.{line} AS o, count(*) AS n FROM {axis}1 k JOIN cells c ON c.image_id = k.image_id AND c.{line} BETWEEN k.{line} - 4 AND k.{line} + 4 AND c.{pos} BETWEEN a AND b GROUP BY 1, 2, 3, 4, 5, 6),
    {axis}3 AS (SELECT image_id, {line} AS line, run, a, b FROM {axis}2 GROUP BY 1, 2, 3, 4, 5 HAVING count(*) FILTER (n / (b - a + 1) > 0.5e0) <= {thick}),
    {axis}4 AS (SELECT image_id, line, unnest(range(a, b + 1)) AS pos FROM {axis}3),
    {axis}5 AS (SELECT image_id, line + unnest(range(-3, 4)) AS line, pos FROM {axis}4 l {beside}),
    {axis}6 AS (SELECT image_id, line, pos FROM {axis}5 JOIN images USING (image_id) WHERE line >= 0 AND line < {across} UNION
        SELECT image_id, {line}, unnest(range(a, b + 1)) FROM (SELECT image_id, {line}, run, min({pos}) AS a, max({pos}) AS b, count(*) AS n FROM {axis}q GROUP BY 1, 2, 3) JOIN images USING (image_id)
        WHERE n >= floor({along} / 4) AND {line} >= floor({across} * 0.05e0) AND {line} < {across} - floor({across} * 0.05e0)),
    {axis}7 AS (SELECT image_id, CAST({'pos' if axis == 'h' else 'line'} AS INTEGER) AS x, CAST({'line' if axis == 'h' else 'pos'} AS INTEGER) AS y FROM {axis}6)"""


@query("w06_reference_lines", ALL + ", " + lines_sql("h", "0.3e0", 5, 8, False) + ", " + lines_sql("v", "0.2e0", 5, 8, False)
       + " SELECT 'h' AS axis, * FROM h7 UNION ALL SELECT 'v', * FROM v7")
def w06(spark, sf):
    d, im = r.pixels(spark, sf).select("image_id", "x", "y"), r.images(spark, sf)
    h = w.reference_lines(d, im, "horizontal", 0.3).withColumn("axis", F.lit("h"))
    return h.unionByName(w.reference_lines(d, im, "vertical", 0.2).withColumn("axis", F.lit("v")))


@query("w06_reference_lines_near", ALL + ", " + lines_sql("h", "0.3e0", 3, 6, True) + " SELECT * FROM h7")
def w06b(spark, sf):
    d, im = r.pixels(spark, sf).select("image_id", "x", "y"), r.images(spark, sf)
    return w.reference_lines(d, im, "horizontal", 0.3, 3, 6, keep_near_curves=True)


AXES = islands("cells", "y", "x", 3, "hr") + ", " + islands("cells", "x", "y", 3, "vr") + """,
    ha AS (SELECT image_id, max(struct_pack(score := ((b - a) / width + y / height) / 2, line := y, a := a, b := b)) AS h FROM (SELECT image_id, y, run, min(x) AS a, max(x) AS b FROM hr GROUP BY 1, 2, 3) JOIN images USING (image_id)
        WHERE y >= height * 0.4e0 AND b - a >= width * 0.3e0 GROUP BY 1),
    va AS (SELECT image_id, max(struct_pack(score := ((b - a) / height + 1 - x / width) / 2, line := x, a := a, b := b)) AS v FROM (SELECT image_id, x, run, min(y) AS a, max(y) AS b FROM vr GROUP BY 1, 2, 3) JOIN images USING (image_id)
        WHERE x <= width * 0.4e0 AND b - a >= height * 0.5e0 GROUP BY 1),
    axes AS (SELECT image_id, h.line AS x_axis_y, h.a AS x_axis_from, h.b AS x_axis_to, v.line AS y_axis_x, v.a AS y_axis_top, v.b AS y_axis_bottom FROM images LEFT JOIN ha USING (image_id) LEFT JOIN va USING (image_id))"""


@query("w07_axis_candidates", ALL + ", " + AXES + "SELECT * FROM axes")
def w07(spark, sf):
    return w.axis_candidates(r.pixels(spark, sf), r.images(spark, sf))


@query("w08_axis_origin_ends", ALL + ", " + AXES + """SELECT image_id, y_axis_x AS origin_x, CASE WHEN abs(y_axis_bottom - x_axis_y) < 20 THEN x_axis_y ELSE y_axis_bottom END AS origin_y,
    x_axis_to AS x_end, y_axis_top AS y_end FROM axes WHERE x_axis_y IS NOT NULL AND y_axis_x IS NOT NULL""")
def w08(spark, sf):
    return w.axis_origin_ends(w.axis_candidates(r.pixels(spark, sf), r.images(spark, sf)))


@query("w09_tick_marks", ALL + ", " + AXES + """, tk AS (SELECT image_id, CAST(x - (x - x_axis_from) % 5 AS INTEGER) AS pos, count(*) AS n FROM pixels JOIN axes USING (image_id) WHERE gray < 100 AND y >= x_axis_y AND y < x_axis_y + 20
        AND x >= x_axis_from AND x - (x - x_axis_from) % 5 < x_axis_to AND (x - x_axis_from) % 5 < 3 GROUP BY 1, 2),
    tf AS (SELECT image_id, list_reduce(list(pos ORDER BY pos), lambda a, p: CASE WHEN len(a) = 0 OR p - a[-1] > 10 THEN list_append(a, p) ELSE a END, CAST([] AS INTEGER[])) AS l FROM tk WHERE n > 6 GROUP BY 1)
    SELECT image_id, unnest(l) AS pos FROM tf""")
def w09(spark, sf):
    px = r.pixels(spark, sf)
    return w.tick_marks(px, w.axis_candidates(px, r.images(spark, sf)), share=0.3)


def comp_sql(src: str, name: str = "comp", four: bool = False) -> str:
    """Component label of every cell as the smallest reading-order number that reaches it."""
    steps = "(VALUES (-1,0),(1,0),(0,-1),(0,1)" + ("" if four else ",(-1,-1),(-1,1),(1,-1),(1,1)") + ") o(dx, dy)"
    return f"""{name}_r(image_id, x, y, l) AS (SELECT image_id, x, y, CAST(y AS BIGINT) * 2147483648 + x FROM {src} UNION
    SELECT s.image_id, s.x, s.y, r.l FROM {name}_r r, {steps}, {src} s WHERE s.image_id = r.image_id AND s.x = r.x + o.dx AND s.y = r.y + o.dy AND r.l < CAST(s.y AS BIGINT) * 2147483648 + s.x),
    {name} AS (SELECT image_id, x, y, min(l) AS comp_id FROM {name}_r GROUP BY 1, 2, 3)"""


def comp_with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


STATS = """stats AS (SELECT image_id, comp_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM comp GROUP BY 1, 2),
    sized AS (SELECT s.*, width, height, area / (w * h) AS fill, w / h AS asp FROM stats s JOIN images USING (image_id))"""
MID = "mid AS (SELECT image_id, x, y FROM pixels WHERE gray < 90)"
CP = comp_with(r.PIXELS, r.IMAGES, MID, comp_sql("mid"), STATS)
OUT = "SELECT image_id, comp_id, x, y, w, h, area, cx, cy FROM "


def labelled(spark, sf):
    return w.connected_components(darks(spark, sf))


def stats(spark, sf):
    return w.component_stats(labelled(spark, sf))


@query("w10_connected_components", CP + OUT + "stats", "cx cy")
def w10(spark, sf):
    return stats(spark, sf)


def or_largest(ok: str) -> str:
    return f"""SELECT image_id, comp_id, x, y, w, h, area, cx, cy FROM (SELECT *, bool_or(ok) OVER (PARTITION BY image_id) AS hit, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, comp_id DESC) AS rn
    FROM (SELECT *, {ok} AS ok FROM sized)) WHERE ok OR (NOT hit AND rn = 1)"""


@query("w11_filter_components_curve", CP + or_largest("""area >= 20 AND w >= greatest(8e0, width * 0.02e0) AND NOT (h / height > 0.9e0 AND w / width < 0.2e0) AND NOT (cy > height * 0.85e0 AND w < width * 0.1e0)
    AND NOT (w < least(300e0, width * 0.25e0) AND h > 12 AND h < least(50e0, height * 0.1e0) AND fill < 0.35e0)"""), "cx cy")
def w11(spark, sf):
    return w.filter_components_curve(stats(spark, sf), r.images(spark, sf))


@query("w11_filter_components_points", CP + or_largest("""area >= 30 AND w >= greatest(10e0, width * 0.02e0) AND NOT (h / height > 0.9e0 AND w / width < 0.3e0) AND NOT (cy > height * 0.8e0 AND w < width * 0.1e0)"""), "cx cy")
def w11b(spark, sf):
    return w.filter_components_curve(stats(spark, sf), r.images(spark, sf), strict=False)


@query("w11_filter_components_annotation", CP + OUT + "sized WHERE area >= 3 AND (w >= 3 OR h >= 3)", "cx cy")
def w11c(spark, sf):
    return w.filter_components_annotation(stats(spark, sf), least=3, side=3)


@query("w12_filter_components_noise", CP + OUT + "sized WHERE area >= 20 AND NOT (area < 100 AND greatest(w, h) / least(w, h) < 2 AND fill > 0.6e0)", "cx cy")
def w12(spark, sf):
    return w.filter_components_noise(stats(spark, sf))


SECOND = "second AS (SELECT image_id, area AS second FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, comp_id) AS rn FROM stats) WHERE rn = 2)"


@query("w13_filter_components_text", CP[:-1] + ", " + SECOND + ", z AS (SELECT s.*, second, cy > height * 0.2e0 AND cy < height * 0.85e0 AS mid FROM sized s LEFT JOIN second USING (image_id)) " + OUT + """z WHERE NOT CASE WHEN area > coalesce(second * 0.3e0, 500e0) THEN false
    WHEN cy < height * 0.35e0 AND cx > width * 0.55e0 AND area < 1600 THEN true WHEN cy < height * 0.25e0 AND area < 800 THEN true
    WHEN cx > width * 0.7e0 AND area < 800 AND area > 30 AND fill > 0.15e0 THEN NOT (h < 15 AND asp > 1.5e0 AND mid) WHEN cy > height * 0.85e0 AND area < 500 THEN true
    WHEN cy > height * 0.55e0 AND cx > width * 0.55e0 AND area < 4000 AND h < 80 AND h / w < 3 AND NOT (h < 15 AND asp > 2) THEN true
    WHEN cx > width * 0.75e0 AND area < 6400 AND area > 30 AND NOT ((asp > 3 OR (asp > 1.5e0 AND h < 15)) AND mid) AND (fill > 0.25e0 OR h > 30) THEN true
    WHEN area > 30 AND area < 800 AND asp > 1.5e0 AND h < 30 AND fill > 0.2e0 THEN NOT (h < 15 AND asp > 2 AND mid) ELSE false END""", "cx cy")
def w13(spark, sf):
    return w.filter_components_text(stats(spark, sf), r.images(spark, sf))


@query("w13_filter_components_labels", CP + OUT + """sized WHERE (w > width * 0.3e0 AND area > 500) OR (w > width * 0.1e0 AND w > h * 2 AND area > 200 AND fill < 0.4e0) OR area < 5 OR NOT (
    (y < height * 0.15e0 AND area < 2000) OR (x > width * 0.85e0 AND w < width * 0.1e0 AND area < 300) OR (area < 200 AND w < 30 AND h < 30 AND fill > 0.2e0 AND fill < 0.95e0 AND asp > 0.2e0 AND asp < 4)
    OR (area < 1500 AND w < 150 AND h < 50 AND fill > 0.1e0 AND fill < 0.8e0 AND (asp > 2 OR asp < 0.5e0)) OR (w < width * 0.05e0 AND area < 200 AND h > w)
    OR (((y < height * 0.2e0 AND (x < width * 0.15e0 OR x + w > width * 0.85e0)) OR (y + h > height * 0.8e0 AND x < width * 0.15e0)) AND area < 500 AND w < width * 0.1e0))""", "cx cy")
def w13b(spark, sf):
    return w.filter_components_labels(stats(spark, sf), r.images(spark, sf))


@query("w14_filter_components_dark", CP + OUT + """sized WHERE area >= 5 AND y <= height - 10 AND ((w > 10 AND h < 8) OR (h > 10 AND w < 8) OR (area < 60 AND asp > 0.3e0 AND asp < 3 AND w < 18 AND h < 18)
    OR asp > 2.5e0 OR asp < 0.4e0 OR area > 50)""", "cx cy")
def w14(spark, sf):
    return w.filter_components_dark(stats(spark, sf), r.images(spark, sf))


@query("w14_filter_components_black", CP + OUT + """sized WHERE area >= 5 AND area <= 5000 AND (asp > 5 OR asp < 0.2e0 OR (area > 100 AND (w > 30 OR h > 30)) OR (area < 50 AND (w < 8 OR h < 8))
    OR (area < 40 AND asp > 0.5e0 AND asp < 2 AND w < 12 AND h < 12)) AND NOT (area > 200 AND area < 3000 AND asp > 1.5e0 AND asp < 10 AND h < 30) AND NOT (area > 10 AND area < 200 AND asp > 0.3e0 AND asp < 3 AND w < 25 AND h < 25)""", "cx cy")
def w14b(spark, sf):
    return w.filter_components_black(stats(spark, sf))


@query("w14_filter_components_isolated", CP[:-1] + """, nr AS (SELECT s.image_id, s.comp_id, count(m.x) AS near FROM stats s LEFT JOIN mid m ON m.image_id = s.image_id AND m.x >= greatest(0, s.x - 15) AND m.x < s.x + s.w + 15
        AND m.y >= greatest(0, s.y - 15) AND m.y < s.y + s.h + 15 AND NOT (m.x BETWEEN s.x AND s.x + s.w - 1 AND m.y BETWEEN s.y AND s.y + s.h - 1) GROUP BY 1, 2),
    z AS (SELECT * FROM sized JOIN nr USING (image_id, comp_id)) """ + OUT + """z WHERE (x < floor(width * 0.15e0) AND y < floor(height * 0.15e0)) OR NOT (
    (((area < 300 AND w < 35 AND h < 35) OR (area > 5 AND area < 800 AND asp > 0.1e0 AND asp < 1.2e0 AND h > 8 AND w < 35 AND fill < 0.65e0) OR (area < 50 AND w < 15 AND h < 15) OR (area < 400 AND asp > 0.3e0 AND asp < 3 AND w < 40 AND h < 40))
      AND NOT (asp > 5 OR asp < 0.2e0 OR w > 70 OR h > 70 OR area > 600)) OR (near < 50 AND area < 400))""", "cx cy")
def w14c(spark, sf):
    return w.filter_components_isolated(stats(spark, sf), darks(spark, sf), r.images(spark, sf), tile=16)


@query("w14_filter_components_letters", CP + OUT + """sized WHERE (x < floor(width * 0.15e0) AND y < floor(height * 0.15e0)) OR NOT ((area > 20 AND area < 2000 AND asp > 0.3e0 AND asp < 3 AND w < 50 AND h < 50 AND fill > 0.2e0)
    AND NOT (asp > 4 OR asp < 0.25e0 OR w > 50 OR h > 50 OR area > 2000))""", "cx cy")
def w14d(spark, sf):
    return w.filter_components_letters(stats(spark, sf), r.images(spark, sf))


@query("w15_protect_components", CP[:-1] + ", " + SECOND + ", z AS (SELECT s.*, second FROM sized s LEFT JOIN second USING (image_id)) " + OUT + """z WHERE area >= 20 AND (area > coalesce(second * 0.1e0, 200e0) OR greatest(w, h) / greatest(1, least(w, h)) > 3
    OR h > height * 0.15e0 OR (w > 30 AND h < 20 AND fill < 0.5e0) OR (cy > height * 0.1e0 AND cy < height * 0.9e0 AND w > 50))""", "cx cy")
def w15(spark, sf):
    return w.protect_components(stats(spark, sf), r.images(spark, sf))


@query("w15_protected_cells", CP[:-1] + """, z AS (SELECT image_id, comp_id FROM sized WHERE area >= 8 AND (greatest(w, h) / greatest(1, least(w, h)) > 3 OR area > 500)),
    q AS (SELECT DISTINCT image_id, x + CAST(unnest(range(-2, 3)) AS INTEGER) AS x, y FROM comp SEMI JOIN z USING (image_id, comp_id)), u AS (SELECT DISTINCT image_id, x, y + CAST(unnest(range(-2, 3)) AS INTEGER) AS y FROM q)
    SELECT u.image_id, u.x, u.y FROM u JOIN images USING (image_id) WHERE u.x >= 0 AND u.y >= 0 AND u.x < width AND u.y < height""")
def w15b(spark, sf):
    lab = labelled(spark, sf)
    return w.protected_cells(lab, w.component_stats(lab), r.images(spark, sf), short=True, least=8)


@query("w16_legend_components", comp_with(r.PIXELS, r.IMAGES, MID, "zn AS (SELECT m.*, m.y < floor(height * 0.35e0) AND m.x >= floor(width * 0.5e0) AS z FROM mid m JOIN images USING (image_id))",
                                          "inz AS (SELECT image_id, x, y FROM zn WHERE z)", comp_sql("inz"))
       + "SELECT image_id, x, y FROM zn WHERE NOT z UNION ALL SELECT image_id, x, y FROM comp SEMI JOIN (SELECT image_id, comp_id FROM comp GROUP BY 1, 2 HAVING count(*) >= 8) USING (image_id, comp_id)")
def w16(spark, sf):
    im = r.images(spark, sf)
    return w.legend_components(darks(spark, sf), im, 8, right=0.5)


@query("w17_marks", comp_with(r.PIXELS, r.IMAGES, "dk AS (SELECT image_id, x, y FROM pixels WHERE s % 30 < 30 AND v % 105 > 20 AND v % 105 < 100)",
                              """er AS (SELECT d.image_id, d.x, d.y FROM dk d JOIN images i USING (image_id) WHERE (d.y = 0 OR EXISTS (SELECT 1 FROM dk e WHERE e.image_id = d.image_id AND e.x = d.x AND e.y = d.y - 1))
    AND (d.y = height - 1 OR EXISTS (SELECT 1 FROM dk e WHERE e.image_id = d.image_id AND e.x = d.x AND e.y = d.y + 1)) AND (d.x = 0 OR EXISTS (SELECT 1 FROM dk e WHERE e.image_id = d.image_id AND e.x = d.x - 1 AND e.y = d.y))
    AND (d.x = width - 1 OR EXISTS (SELECT 1 FROM dk e WHERE e.image_id = d.image_id AND e.x = d.x + 1 AND e.y = d.y)))""", comp_sql("er", four=True))
       + "SELECT image_id, CAST(floor(avg(x)) AS INTEGER) AS x, CAST(floor(avg(y)) AS INTEGER) AS y, count(*) AS area FROM comp GROUP BY image_id, comp_id HAVING count(*) < 50")
def w17(spark, sf):
    return w.marks(r.pixels(spark, sf).withColumns({"s": F.col("s") % 30, "v": F.col("v") % 105}), r.images(spark, sf))


PRESENT = "pres AS (SELECT curve_id, x, y, value > 20 AS present FROM (SELECT user_id AS curve_id, CAST(event_id // 20 AS INTEGER) AS x, min(event_id) AS y, max(value) AS value FROM events GROUP BY 1, 2))"


@query("w19_line_style", with_(PRESENT) + """, a AS (SELECT *, lag(present) OVER (PARTITION BY curve_id ORDER BY x) AS p FROM pres),
    b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> present THEN 1 ELSE 0 END) OVER (PARTITION BY curve_id ORDER BY x) AS run FROM a),
    c AS (SELECT curve_id, run, any_value(present) AS o, count(*) AS n FROM b GROUP BY 1, 2),
    d AS (SELECT curve_id, coalesce(sum(n) FILTER (o), 0) / sum(n) AS ratio, sum(n) AS t, count(*) FILTER (o) AS kon, count(*) FILTER (NOT o) AS koff, avg(n) FILTER (o) AS aon, avg(n) FILTER (NOT o) AS aoff,
        stddev_pop(n) FILTER (o) AS son, stddev_pop(n) FILTER (NOT o) AS soff, median(n) FILTER (o) AS md FROM c GROUP BY 1),
    e AS (SELECT curve_id, count(*) FILTER (lg <> pl) AS alt FROM (SELECT curve_id, lg, lag(lg) OVER (PARTITION BY curve_id ORDER BY run) AS pl FROM (SELECT c.curve_id, run, n > md AS lg FROM c JOIN d USING (curve_id) WHERE o)) GROUP BY 1),
    f AS (SELECT d.*, alt, son / aon < 0.5e0 AND soff / aoff < 0.5e0 AS reg FROM d LEFT JOIN e USING (curve_id)),
    g AS (SELECT *, CASE WHEN t < 5 THEN 'unknown:0.3' WHEN ratio > 0.85e0 THEN 'solid:0.9' WHEN ratio < 0.3e0 AND kon > 0 AND aon < 5 THEN 'dotted:0.6' WHEN ratio < 0.3e0 THEN 'unknown:0.4'
        WHEN kon > 0 AND koff > 0 AND aon < 8 AND aoff > 3 THEN CASE WHEN reg THEN 'dotted:0.7' ELSE 'dotted:0.5' END WHEN kon > 0 AND koff > 0 AND aon > 10 AND aoff > 5 THEN CASE WHEN reg THEN 'dashed:0.8' ELSE 'dashed:0.6' END
        WHEN kon > 4 AND koff > 0 AND alt > kon * 0.6e0 THEN 'dash_dot:0.7' WHEN 1 - ratio < 0.15e0 THEN 'solid:0.7' WHEN 1 - ratio < 0.4e0 THEN 'dashed:0.6' ELSE 'dotted:0.5' END AS q FROM f)
    SELECT curve_id, ratio, split_part(q, ':', 1) AS style, CAST(split_part(q, ':', 2) AS DOUBLE) AS confidence FROM g""", "ratio confidence")
def w19(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("curve_id"), F.expr("cast(event_id div 20 as int)").alias("x")).agg(F.max("value").alias("value"))
    return w.line_style(e.select("curve_id", "x", (F.col("value") > 20).alias("present")))


PATH = f"""path0 AS (SELECT l_suppkey % 25 AS image_id, l_suppkey AS curve_id, CAST({v.MONTH} AS INTEGER) AS x, CAST(floor(avg(l_quantity)) AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2, 3)"""


def path(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("image_id"), F.col("l_suppkey").alias("curve_id"), F.expr(v.MONTH).cast("int").alias("x")).agg(
        F.floor(F.avg("l_quantity")).cast("double").alias("y"))


@query("w20_dash_score", with_(r.PIXELS, PATH) + """, a AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY curve_id) AS n FROM path0 WINDOW w AS (PARTITION BY curve_id ORDER BY x)),
    b AS (SELECT image_id, curve_id, n, xx AS x, CAST(trunc(CASE WHEN xx = x THEN y ELSE y + (y2 - y) * ((xx - x) / (x2 - x)) END) AS INTEGER) AS y FROM (SELECT *, CAST(unnest(range(x, coalesce(x2, x + 1))) AS INTEGER) AS xx FROM a)),
    c AS (SELECT b.image_id, b.curve_id, b.n, b.x, min(coalesce(p.gray, 255)) AS i FROM b LEFT JOIN pixels p ON p.image_id = b.image_id AND p.x = b.x AND p.y BETWEEN b.y - 2 AND b.y + 2 GROUP BY 1, 2, 3, 4),
    d AS (SELECT *, i > 180 AS li, i < 100 AS dk, lag(i > 180) OVER w AS pl, lag(i < 100) OVER w AS pd FROM c WINDOW w AS (PARTITION BY curve_id ORDER BY x)),
    e AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> li THEN 1 ELSE 0 END) OVER w AS rl, sum(CASE WHEN pd IS NULL OR pd <> dk THEN 1 ELSE 0 END) OVER w AS rd FROM d WINDOW w AS (PARTITION BY curve_id ORDER BY x)),
    g AS (SELECT curve_id, count(*) AS gaps, avg(n) AS ga, stddev_pop(n) AS gs FROM (SELECT curve_id, rl, count(*) AS n FROM e WHERE li GROUP BY 1, 2) WHERE n >= 3 GROUP BY 1),
    s AS (SELECT curve_id, avg(n) AS sa FROM (SELECT curve_id, rd, count(*) AS n FROM e WHERE dk GROUP BY 1, 2) WHERE n >= 3 GROUP BY 1),
    t AS (SELECT image_id, curve_id, any_value(n) AS cols, avg(CASE WHEN dk THEN 1e0 ELSE 0e0 END) AS dark FROM e GROUP BY 1, 2),
    u AS (SELECT t.*, coalesce(gaps, 0) AS gaps, ga, sa, CASE WHEN gaps >= 3 THEN CASE WHEN gs / ga < 0.5e0 THEN 1e0 WHEN gs / ga < 1 THEN 0.5e0 ELSE 0e0 END ELSE 0e0 END AS reg FROM t LEFT JOIN g USING (curve_id) LEFT JOIN s USING (curve_id)),
    z AS (SELECT *, CAST(greatest(0, CASE WHEN gaps >= 10 THEN 4 WHEN gaps >= 6 THEN 3 WHEN gaps >= 3 THEN 2 ELSE 0 END + CASE WHEN reg >= 0.5e0 AND gaps >= 3 THEN 2 ELSE 0 END + CASE WHEN gaps >= 2 AND ga BETWEEN 4 AND 20 THEN 1 ELSE 0 END
        + CASE WHEN dark < 0.8e0 THEN 1 ELSE 0 END - CASE WHEN dark > 0.95e0 THEN 2 WHEN dark > 0.9e0 THEN 1 ELSE 0 END - CASE WHEN gaps <= 1 THEN 2 ELSE 0 END - CASE WHEN sa > 50 AND gaps < 5 THEN 1 ELSE 0 END) AS INTEGER) AS sc FROM u)
    SELECT image_id, curve_id, gaps, dark, CASE WHEN cols >= 30 THEN sc END AS score, CASE WHEN cols < 30 THEN 'unknown' WHEN sc >= 3 THEN 'dashed' ELSE 'solid' END AS style,
    CASE WHEN cols < 30 THEN 0.3e0 WHEN sc >= 5 THEN 0.9e0 WHEN sc >= 3 THEN 0.7e0 ELSE 0.85e0 END AS confidence FROM z""", "dark confidence")
def w20(spark, sf):
    return w.dash_score(path(spark, sf), r.pixels(spark, sf))


OFFS = "offs AS (SELECT user_id AS curve_id, event_id * 1e-2 AS t, CAST(round(value - 50) AS INTEGER) AS off FROM events)"


@query("w22_consolidate_regions", with_(OFFS) + """, f AS (SELECT curve_id, list_reduce(list({'t': t, 'o': off} ORDER BY t, off), lambda a, x: CASE WHEN x.t - a[-1].t < 2e0
        THEN CASE WHEN abs(x.o) > abs(a[-1].o) THEN list_append(a[:-2], x) ELSE a END ELSE list_append(a, x) END, list({'t': t, 'o': off} ORDER BY t, off)[1:1]) AS r FROM offs GROUP BY 1)
    SELECT curve_id, u.t AS t, u.o AS "offset", row_number() OVER (PARTITION BY curve_id ORDER BY abs(u.o) DESC, u.t) AS rank FROM (SELECT curve_id, unnest(r) AS u FROM f)""", "t")
def w22(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("curve_id"), (F.col("event_id") * 1e-2).alias("t"), F.round(F.col("value") - 50).cast("int").alias("offset"))
    return w.consolidate_regions(e, gap=2.0)


@query("w23_index_ranges", """WITH d AS (SELECT DISTINCT o_custkey % 50 AS curve_id, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) // 3 AS INTEGER) AS x FROM orders),
    a AS (SELECT *, x - row_number() OVER (PARTITION BY curve_id ORDER BY x) AS g FROM d)
    SELECT curve_id, min(x) AS first, max(x) AS last, CASE WHEN min(x) = max(x) THEN CAST(min(x) AS VARCHAR) ELSE min(x) || '-' || max(x) END AS range FROM a GROUP BY curve_id, g""")
def w23(spark, sf):
    o = table(spark, sf, "orders")
    return w.index_ranges(o.select((F.col("o_custkey") % 50).alias("curve_id"), F.floor(F.datediff("o_orderdate", F.lit("1995-01-01")) / 3).cast("int").alias("x")))


PANEL = """wide AS (SELECT i.image_id, width, height, px, py, pw, ph FROM images i JOIN bounds USING (image_id) WHERE width / height >= 1.5e0 AND px + pw <= floor(width / 2) + 50),
    tp AS (SELECT p.*, w.py, w.ph, width, height FROM pixels p JOIN wide w USING (image_id)),
    ac AS (SELECT image_id, x FROM tp WHERE s > 40 AND v > 40 AND v < 250 AND y >= py AND y < py + floor(ph * 0.6e0) AND x >= floor(width / 2) + 50 GROUP BY 1, 2 HAVING count(*) >= 3 AND max(y) - min(y) < 30),
    sx AS (SELECT image_id, min(x) AS start_x FROM ac GROUP BY 1),
    lb AS (SELECT image_id, x, sum(255 - gray) AS d FROM tp JOIN sx USING (image_id) WHERE x BETWEEN start_x - 30 AND start_x + 19 AND y >= py + ph - 5 AND y < least(height, py + ph + 25) GROUP BY 1, 2),
    lx AS (SELECT image_id, x AS label_x FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d DESC, x) AS rn FROM lb) WHERE rn = 1)
    SELECT image_id, start_x, coalesce(label_x, greatest(0, start_x - 30)) AS new_px, CAST(width - floor(width * 0.02e0) - coalesce(label_x, greatest(0, start_x - 30)) AS INTEGER) AS new_pw FROM wide JOIN sx USING (image_id) LEFT JOIN lx USING (image_id)"""


@query("w24_panel_start", with_(r.PIXELS, "images AS (SELECT CAST(n_nationkey AS BIGINT) AS image_id, 60 AS width, 38 AS height FROM nation)", "bounds AS (SELECT CAST(n_nationkey AS BIGINT) AS image_id, 2 AS px, 3 AS py, 40 AS pw, 30 AS ph FROM nation)") + ", " + PANEL)
def w24(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("image_id"))
    im = n.withColumns({"width": F.lit(60), "height": F.lit(38)})
    b = n.withColumns({"px": F.lit(2), "py": F.lit(3), "pw": F.lit(40), "ph": F.lit(30)})
    return w.panel_start(r.pixels(spark, sf), im, b)


@query("w25_text_boxes", comp_with(r.PIXELS, r.IMAGES, "lt AS (SELECT image_id, x, y FROM pixels WHERE gray > 215)", comp_sql("lt", "lc"),
                                   "rt AS (SELECT p.image_id, p.x, p.y FROM pixels p JOIN images USING (image_id) WHERE gray < 150 AND p.x >= floor(width * 0.55e0))", comp_sql("rt", "rc")) + """,
    bx AS (SELECT 'light' AS kind, image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, 15 AS mg FROM lc GROUP BY image_id, comp_id UNION ALL
        SELECT 'right', image_id, min(x), min(y), max(x) - min(x) + 1, max(y) - min(y) + 1, count(*), 10 FROM rc GROUP BY image_id, comp_id)
    SELECT image_id, kind, greatest(0, x - mg) AS x1, greatest(0, y - mg) AS y1, least(width, x + w + mg) AS x2, least(height, y + h + mg) AS y2 FROM bx JOIN images USING (image_id)
    WHERE (kind = 'light' AND w * h > 100 AND w * h < 25000 AND w / h > 0.8e0) OR (kind = 'right' AND area > 200 AND area < 8000 AND w / h > 1.5e0 AND w / h < 10 AND h < 35) UNION ALL
    SELECT image_id, 'top', greatest(0, a - 20), 0, least(width, b + 21), least(height, CAST(floor(height * 0.12e0) AS INTEGER) + 15) FROM (SELECT image_id, any_value(width) AS width, any_value(height) AS height, min(x) AS a, max(x) AS b, count(*) AS n
        FROM pixels p JOIN images USING (image_id) WHERE gray < 200 AND p.y < floor(height * 0.12e0) GROUP BY 1) WHERE n * 255 > 500""")
def w25(spark, sf):
    return w.text_boxes(r.pixels(spark, sf), r.images(spark, sf))


# -- morphology ------------------------------------------------------------------------------------

@query("m01_dilate", PXI + """, u AS (SELECT image_id, x + CAST(unnest(range(-1, 2)) AS INTEGER) AS x, y FROM darks), q AS (SELECT DISTINCT image_id, x, y + CAST(unnest(range(-1, 2)) AS INTEGER) AS y FROM u)
    SELECT image_id, q.x, q.y FROM q JOIN images USING (image_id) WHERE q.x >= 0 AND q.y >= 0 AND q.x < width AND q.y < height""")
def m01(spark, sf):
    return m.dilate(darks(spark, sf), images=r.images(spark, sf))


@query("m02_erode", PXI + """SELECT d.image_id, d.x, d.y FROM darks d JOIN darks e ON e.image_id = d.image_id AND abs(e.x - d.x) + abs(e.y - d.y) <= 1 JOIN images i ON i.image_id = d.image_id
    GROUP BY 1, 2, 3 HAVING count(*) = 1 + CAST(any_value(d.x > 0) AS INTEGER) + CAST(any_value(d.y > 0) AS INTEGER) + CAST(any_value(d.x < width - 1) AS INTEGER) + CAST(any_value(d.y < height - 1) AS INTEGER)""")
def m02(spark, sf):
    return m.erode(darks(spark, sf), m.CROSS, images=r.images(spark, sf))


OPENED = """er AS (SELECT d.image_id, d.x, d.y FROM {src} d JOIN {src} e ON e.image_id = d.image_id AND e.x IN (d.x, d.x - 1) AND e.y IN (d.y, d.y - 1) GROUP BY 1, 2, 3 HAVING count(*) = 4),
    op AS (SELECT DISTINCT image_id, x + CAST(dx AS INTEGER) AS x, y + CAST(dy AS INTEGER) AS y FROM er, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dx, dy))"""


@query("m03_open_close", PXD + ", " + OPENED.format(src="darks") + """, di AS (SELECT DISTINCT image_id, x + CAST(dx AS INTEGER) AS x, y + CAST(dy AS INTEGER) AS y FROM darks, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dx, dy)),
    cl AS (SELECT d.image_id, d.x, d.y FROM di d JOIN di e ON e.image_id = d.image_id AND e.x IN (d.x, d.x - 1) AND e.y IN (d.y, d.y - 1) GROUP BY 1, 2, 3 HAVING count(*) = 4)
    SELECT 'open' AS op, * FROM op UNION ALL SELECT 'close', * FROM cl""")
def m03(spark, sf):
    d, k = darks(spark, sf), m.rect(2, 2)
    return m.opened(d, k).withColumn("op", F.lit("open")).unionByName(m.closed(d, k).withColumn("op", F.lit("close")))


# Steps to the closest cell that is not set, in two passes over a frame one cell wider than the mask: along the rows, then along the columns
STEPS = """frame AS (SELECT image_id, unnest(range(x1, x2 + 1)) AS x, y1, y2 FROM (SELECT image_id, min(x) - 1 AS x1, max(x) + 1 AS x2, min(y) - 1 AS y1, max(y) + 1 AS y2 FROM cells GROUP BY 1)),
    grid AS (SELECT f.image_id, CAST(f.x AS INTEGER) AS x, CAST(f.y AS INTEGER) AS y, c.x IS NOT NULL AS own FROM (SELECT image_id, x, unnest(range(y1, y2 + 1)) AS y FROM frame) f LEFT JOIN (SELECT DISTINCT image_id, x, y FROM cells) c ON c.image_id = f.image_id AND c.x = f.x AND c.y = f.y),
    across AS (SELECT *, least(x - max(x) FILTER (NOT own) OVER (w ROWS UNBOUNDED PRECEDING), min(x) FILTER (NOT own) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - x) AS h FROM grid WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
    ds AS (SELECT image_id, x, y, d FROM (SELECT *, least(y + min(h - y) OVER (w ROWS UNBOUNDED PRECEDING), min(h + y) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - y) AS d FROM across WINDOW w AS (PARTITION BY image_id, x ORDER BY y)) WHERE own)"""


@query("m04_skeleton", with_(r.PIXELS, "cells AS (SELECT image_id, x, y FROM pixels WHERE gray < 170)", STEPS) + """SELECT image_id, x, y FROM ds a
    WHERE NOT EXISTS (SELECT 1 FROM ds b WHERE b.image_id = a.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND b.d > a.d)""")
def m04(spark, sf):
    return m.skeleton(r.pixels(spark, sf).where("gray < 170"))


@query("m05_endpoints", PXD + "SELECT d.image_id, d.x, d.y FROM darks d JOIN darks e ON e.image_id = d.image_id AND abs(e.x - d.x) <= 1 AND abs(e.y - d.y) <= 1 GROUP BY 1, 2, 3 HAVING count(*) <= 2")
def m05(spark, sf):
    return m.endpoints(darks(spark, sf))


def bridges_sql(kind: str, fill: str) -> str:
    """Greedy bridges of length 8 in reading order: one list fold over the endpoints of a picture keeps the targets taken (t) and the bridges made (l).

    `kind` names the type of a pair by its distances dx and dy and `far`, `fill` lists the cells of a bridge."""
    return with_(r.PIXELS, SPARSE) + f""", ends AS (SELECT a.image_id, a.x, a.y, CAST(a.y AS BIGINT) * 1000000 + a.x AS p FROM sparse a JOIN sparse b
        ON b.image_id = a.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3 HAVING count(*) <= 2),
    met AS (SELECT a.image_id, a.p, a.x AS x1, a.y AS y1, b.p AS q, b.x AS x2, b.y AS y2, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, sqrt(dx * dx + dy * dy) AS far
        FROM ends a JOIN ends b ON a.image_id = b.image_id AND a.p < b.p AND abs(a.x - b.x) <= 8 AND abs(a.y - b.y) <= 8),
    kinds AS (SELECT *, {kind} AS kind FROM met),
    wishes AS (SELECT image_id, p, list({{'dist': CASE kind WHEN 'h' THEN dx WHEN 'v' THEN dy WHEN 'l' THEN dx + dy ELSE far END, 'q': q, 'kind': kind, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}
        ORDER BY CASE kind WHEN 'h' THEN dx WHEN 'v' THEN dy WHEN 'l' THEN dx + dy ELSE far END, q) AS o FROM kinds WHERE kind IS NOT NULL GROUP BY 1, 2),
    went AS (SELECT image_id, list_reduce(list({{'t': [p], 'l': o}} ORDER BY p), lambda a, e: CASE WHEN list_contains(a.t, e.t[1]) THEN a
        ELSE {{'t': list_concat(a.t, list_transform(list_filter(e.l, lambda c: NOT list_contains(a.t, c.q))[1:1], lambda c: c.q)),
               'l': list_concat(a.l, list_filter(e.l, lambda c: NOT list_contains(a.t, c.q))[1:1])}} END,
        {{'t': CAST([] AS BIGINT[]), 'l': list_filter(first(o), lambda c: false)}}) AS s FROM wishes GROUP BY 1),
    links AS (SELECT image_id, unnest(s.l, recursive := true) FROM went),
    filled AS ({fill})
    SELECT image_id, x, y FROM sparse UNION SELECT image_id, CAST(x AS INTEGER), CAST(y AS INTEGER) FROM filled"""


@query("m06_bridge_endpoints", bridges_sql("CASE WHEN dy <= 3 AND dx BETWEEN 2 AND 8 THEN 'h' WHEN dx <= 3 AND dy BETWEEN 2 AND 8 THEN 'v' WHEN dx + dy <= 12 THEN 'l' END",
       """SELECT image_id, unnest(range(least(x1, x2), greatest(x1, x2) + 1)) AS x, CASE kind WHEN 'h' THEN (y1 + y2) // 2 ELSE y1 END AS y FROM links WHERE kind IN ('h', 'l')
    UNION ALL SELECT image_id, CASE kind WHEN 'v' THEN (x1 + x2) // 2 ELSE x2 END, unnest(range(y1, y2 + 1)) FROM links WHERE kind IN ('v', 'l')"""))
def m06(spark, sf):
    return m.bridge_endpoints(sparse(spark, sf), 8)


@query("m06_bridge_endpoints_line", bridges_sql("CASE WHEN far > 1 AND far <= 8 THEN 's' END",
       """SELECT image_id, floor(x1 + (x2 - x1) * i / n) AS x, floor(y1 + (y2 - y1) * i / n) AS y FROM
    (SELECT *, CAST(floor(dist) AS INTEGER) + 1 AS n, unnest(range(0, CAST(floor(dist) AS INTEGER) + 2)) AS i FROM links)"""))
def m06b(spark, sf):
    return m.bridge_endpoints(sparse(spark, sf), 8, shape="line")


@query("m07_skeleton_by_color")
def m07(spark, sf):
    from ..operators import pixels as p
    px = p.classify_color(r.pixels(spark, sf), first_only=True).select("image_id", "color", "x", "y")
    return m.skeleton_by_color(px, 50, 4, r.images(spark, sf))


@query("m08_line_crossings", PXI + """, ln AS (SELECT image_id, CAST(unnest(range(0, 84)) AS INTEGER) AS x, CAST(10 + image_id % 20 AS INTEGER) AS y FROM images),
    cv AS (SELECT * FROM darks ANTI JOIN ln USING (image_id, x, y)),
    h AS (SELECT * FROM ln WHERE EXISTS (SELECT 1 FROM cv WHERE cv.image_id = ln.image_id AND cv.x = ln.x AND (cv.y BETWEEN ln.y - 10 AND ln.y - 4 OR cv.y BETWEEN ln.y + 4 AND ln.y + 10)))
    SELECT DISTINCT image_id, x + CAST(dx AS INTEGER) AS x, y + CAST(dy AS INTEGER) AS y FROM h, (SELECT unnest(range(-1, 2)) AS dx) a, (SELECT unnest(range(-2, 3)) AS dy) b WHERE x + dx >= 0 AND y + dy >= 0""")
def m08(spark, sf):
    ln = r.images(spark, sf).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(83))).alias("x"), (10 + F.col("image_id") % 20).cast("int").alias("y"))
    return m.line_crossings(darks(spark, sf), ln)
