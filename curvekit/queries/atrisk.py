"""Queries of the at-risk tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import atrisk as r
from ..operators import runs as w
from . import views as v
from .base import query, table
from .clean import with_

CELLS = """cells AS (SELECT image_id, grp, CAST(t AS DOUBLE) AS t, count(*) AS n FROM (SELECT CAST(c_nationkey AS BIGINT) AS image_id, grp, unnest(range(0, last_t + 1)) AS t FROM (SELECT c_nationkey, c_mktsegment AS grp, c_custkey,
    max(year(o_orderdate)) - 1995 AS last_t FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)) GROUP BY 1, 2, 3)"""


def cells(spark, sf):
    """Customers by nation and segment whose last order is at or after year t."""
    last = table(spark, sf, "orders").groupBy("o_custkey").agg((F.max(F.year("o_orderdate")) - 1995).alias("last_t"))
    cu = table(spark, sf, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"))
    rows = cu.select(F.col("c_nationkey").cast("bigint").alias("image_id"), F.col("c_mktsegment").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("last_t"))).alias("t"))
    rows = rows.withColumn("t", F.col("t").cast("double"))
    return rows.groupBy("image_id", "grp", "t").agg(F.count("*").alias("n"))


# pages of tokens: per customer a header, a time line, two data lines and notes
PAGE = """lines0 AS (SELECT c_custkey AS image_id, c_custkey AS k, c_nationkey AS n, c_mktsegment AS m FROM customer),
txt AS (SELECT image_id, CAST(10 AS DOUBLE) AS y, CASE WHEN k % 4 = 0 THEN 'Number at  risk' ELSE 'Summary of arms' END AS s FROM lines0
    UNION ALL SELECT image_id, 50, m || ' : ' || (60 + n) || ' ' || (40 + n) || ' ' || (20 + n) || '.5' FROM lines0
    UNION ALL SELECT image_id, 90, CASE WHEN k % 5 = 0 THEN '' ELSE 'Arm_ B ' END || (160 + n) || ' ' || (140 + n) || ' ' || (120 + n) FROM lines0
    UNION ALL SELECT image_id, 130, CASE WHEN k % 3 = 0 THEN 'no numbers' WHEN k % 3 = 1 THEN '0 6 12 18' ELSE 'Time (months)' END FROM lines0
    UNION ALL SELECT image_id, 170, '5 6 7' FROM lines0 WHERE k % 7 = 0),
toks AS (SELECT image_id, w[i] AS "text", CAST(i * 40 AS DOUBLE) AS center_x, y + (i * 5) % 9 AS center_y FROM (SELECT image_id, y, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT image_id, y, string_split(s, ' ') AS w FROM txt)))"""


def page_tokens(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    s = lambda q: q.cast("string")
    line = lambda y, text: F.struct(F.lit(float(y)).alias("y"), text.alias("s"))
    lines = F.array_compact(F.array(
        line(10, F.when(k % 4 == 0, F.lit("Number at  risk")).otherwise(F.lit("Summary of arms"))),
        line(50, F.concat("c_mktsegment", F.lit(" : "), s(60 + n), F.lit(" "), s(40 + n), F.lit(" "), s(20 + n), F.lit(".5"))),
        line(90, F.concat(F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("Arm_ B ")), s(160 + n), F.lit(" "), s(140 + n), F.lit(" "), s(120 + n))),
        line(130, F.when(k % 3 == 0, F.lit("no numbers")).when(k % 3 == 1, F.lit("0 6 12 18")).otherwise(F.lit("Time (months)"))),
        F.when(k % 7 == 0, line(170, F.lit("5 6 7")))))
    rows = table(spark, sf, "customer").select(k.alias("image_id"), F.explode(lines).alias("l"))
    rows = rows.select("image_id", F.col("l.y").alias("y"), F.posexplode(F.split("l.s", " ")).alias("i", "text"))
    return rows.select("image_id", "text", ((F.col("i") + 1) * 40).cast("double").alias("center_x"), (F.col("y") + ((F.col("i") + 1) * 5) % 9).alias("center_y"))


WORDS = """tw AS (SELECT conv_id AS image_id, turn, i - 1 AS pos, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))),
tokens AS (SELECT image_id, word AS "text", CAST(pos * 40 AS DOUBLE) AS center_x, CAST(turn * 20 + length(word) % 7 AS DOUBLE) AS center_y FROM tw)"""


def tokens(spark, sf):
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("image_id"), "turn", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    return t.select("image_id", "text", (F.col("pos") * 40).cast("double").alias("center_x"), (F.col("turn") * 20 + F.length("text") % 7).cast("double").alias("center_y"))


def anchored(src: str) -> str:
    return f"""ty AS (SELECT image_id, CAST(floor(center_y) AS INTEGER) AS y, min(struct_pack(a := center_y, b := center_x)) AS o FROM {src} GROUP BY 1, 2),
    ta AS (SELECT image_id, list_reduce(list(y ORDER BY o, y), lambda a, b: CASE WHEN len(list_filter(a, lambda q: abs(q - b) < 15)) > 0 THEN a ELSE list_append(a, b) END, CAST([] AS INTEGER[])) AS anchors FROM ty GROUP BY 1),
    tr AS (SELECT t.*, list_filter(anchors, lambda q: abs(q - CAST(floor(center_y) AS INTEGER)) < 15)[1] AS row_y FROM {src} t JOIN ta USING (image_id))"""


@query("w21_group_tokens_by_row", with_(WORDS, anchored("tokens")) + """SELECT image_id, "text", center_x, center_y, row_y FROM tr""")
def w21(spark, sf):
    return w.group_tokens_by_row(tokens(spark, sf))


HEAD = "number\\s*at\\s*risk|n\\s*at\\s*risk|patients\\s*at\\s*risk|no\\.?\\s*at\\s*risk|at\\s*risk"
KIND = f"""rw AS (SELECT image_id, row_y, list(trim("text") ORDER BY center_x) AS words FROM tr GROUP BY 1, 2),
    ra AS (SELECT *, lower(array_to_string(words, ' ')) AS s, list_filter(words, lambda q: regexp_matches(q, '^\\d+\\.?\\d*$')) AS nm, list_filter(words, lambda q: q <> '' AND NOT regexp_matches(q, '^\\d+\\.?\\d*$')) AS wd, count(*) OVER (PARTITION BY image_id) AS lines, max(row_y) OVER (PARTITION BY image_id) AS lst FROM rw),
    rb AS (SELECT *, CASE WHEN regexp_matches(s, '{HEAD}') THEN 'header' WHEN regexp_matches(s, 'time\\s*\\(?months?\\)?|months?|years?') THEN 'axis' WHEN len(wd) >= 1 AND len(nm) >= 3 THEN 'data' WHEN len(nm) / len(words) > 0.8e0 AND len(nm) >= 3 THEN
        CASE WHEN len(list_filter(nm, lambda q: CAST(q AS DOUBLE) >= 100)) = 0 THEN 'time' ELSE 'unlabeled' END ELSE 'other' END AS k0 FROM ra),
    rc AS (SELECT *, min(row_y) FILTER (k0 = 'time') OVER p AS f, max(row_y) FILTER (k0 = 'time' AND row_y = lst) OVER p AS lt, max(row_y) FILTER (row_y = lst AND len(nm) >= 3 AND len(nm) / len(words) > 0.7e0) OVER p AS tl FROM rb WINDOW p AS (PARTITION BY image_id)),
    kinds AS (SELECT image_id, row_y, words, CASE WHEN row_y = coalesce(lt, f, tl) THEN 'time' WHEN k0 = 'time' AND row_y = f THEN 'other' WHEN k0 = 'time' THEN 'unlabeled' ELSE k0 END AS kind FROM rc WHERE lines >= 2)"""
PAGED = with_(PAGE, anchored("toks"), KIND)


def kinds(spark, sf):
    return r.classify_rows(r.token_rows(page_tokens(spark, sf)))


@query("r01_classify_rows", PAGED + "SELECT image_id, row_y, kind FROM kinds")
def r01(spark, sf):
    return kinds(spark, sf).drop("words")


ROWS = """pa AS (SELECT image_id, row_y, kind, words, list_position(list_transform(words, lambda q: regexp_matches(q, '^\\d+$|^\\d+\\.\\d+$')), true) AS fp FROM kinds),
    pb AS (SELECT image_id, row_y, kind, array_to_string(list_filter(CASE WHEN fp > 0 THEN words[1:fp - 1] ELSE words END, lambda q: q <> '' AND q NOT IN ('|', '-', ':', '_', '.', ',')), ' ') AS nm,
        list_transform(list_filter(words, lambda q: regexp_matches(q, '^\\d+$|^\\d+\\.\\d+$')), lambda q: CAST(trunc(CAST(q AS DOUBLE)) AS BIGINT)) AS vals FROM pa),
    parsed AS (SELECT image_id, row_y, kind, CASE WHEN n2 <> '' THEN n2 WHEN len(vals) > 0 THEN 'Group_' || len(vals) END AS grp, vals FROM (SELECT *, regexp_replace(regexp_replace(nm, '^[|:\\-_\\s]+', ''), '[|:\\-_\\s]+$', '') AS n2 FROM pb))"""


@query("r02_parse_data_rows", PAGED[:-1] + ", " + ROWS + "SELECT image_id, row_y, grp, array_to_string(vals, ',') AS values FROM parsed")
def r02(spark, sf):
    return r.parse_data_rows(kinds(spark, sf)).withColumn("values", F.array_join(F.transform("values", lambda q: q.cast("string")), ","))


@query("r03_clean_group_name", """SELECT p_partkey, CASE WHEN t = '' THEN 'Unknown' ELSE t END AS grp FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(CASE WHEN p_partkey % 9 = 0 THEN '-_|' ELSE (['| ', '', '--: ', '.,'])[p_partkey % 4 + 1] || p_name || ([' |', '_;', '', ' - .'])[p_partkey % 4 + 1] END,
    '^[|:\\-_\\s]+', ''), '[|:\\-_\\s]+$', ''), '.,;:|-_ ') AS t FROM part)""")
def r03(spark, sf):
    k = F.col("p_partkey") % 4 + 1
    pre, post = F.array(*[F.lit(q) for q in ("| ", "", "--: ", ".,")]), F.array(*[F.lit(q) for q in (" |", "_;", "", " - .")])
    raw = F.when(F.col("p_partkey") % 9 == 0, F.lit("-_|")).otherwise(F.concat(F.element_at(pre, k.cast("int")), "p_name", F.element_at(post, k.cast("int"))))
    return table(spark, sf, "part").select("p_partkey", r.clean_group_name(raw).alias("grp"))


TIMES = """tm AS (SELECT image_id, list_sort(list_transform(list_filter(words, lambda q: regexp_matches(q, '^\\d+\\.?\\d*$')), lambda q: CAST(q AS DOUBLE))) AS tt FROM kinds WHERE kind = 'time'),
    td AS (SELECT image_id, min_by(len(list_filter(words, lambda q: regexp_matches(q, '^\\d+$'))), row_y) AS k FROM kinds WHERE kind IN ('data', 'unlabeled') GROUP BY 1),
    times AS (SELECT image_id, CASE WHEN len(tt) > 0 THEN tt WHEN k IS NOT NULL THEN CASE WHEN image_id % 2 = 0 THEN list_transform(range(0, greatest(k, 7)), lambda i: i * 24e0 / (greatest(k, 7) - 1)) ELSE [0e0, 3e0, 6e0, 9e0, 12e0, 15e0, 18e0] END END AS times
        FROM (SELECT DISTINCT image_id FROM kinds) LEFT JOIN tm USING (image_id) LEFT JOIN td USING (image_id))"""


def even_calibration(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("image_id"), F.lit(0.0).alias("time_min"), F.lit(24.0).alias("time_max"))


@query("r04_time_points", PAGED[:-1] + ", " + TIMES + "SELECT image_id, unnest(times) AS t FROM times", "t")
def r04(spark, sf):
    return r.time_points(kinds(spark, sf), even_calibration(spark, sf)).select("image_id", F.explode("times").alias("t"))


ASSEMBLED = """ga AS (SELECT image_id, row_y, vals, CASE WHEN trim(g, '.,;:|-_ ') = '' THEN 'Unknown' ELSE trim(g, '.,;:|-_ ') END AS grp FROM (SELECT *, regexp_replace(regexp_replace(grp, '^[|:\\-_\\s]+', ''), '[|:\\-_\\s]+$', '') AS g FROM parsed WHERE kind IN ('data', 'unlabeled') AND len(vals) >= 3)),
    gb AS (SELECT image_id, grp, max_by(vals, row_y) AS vals FROM ga GROUP BY 1, 2), gc AS (SELECT image_id, grp, unnest(range(1, least(len(vals), len(times)) + 1)) AS i, vals, times FROM gb JOIN times USING (image_id)),
    acells AS (SELECT image_id, grp, times[i] AS t, max(vals[i]) AS n FROM gc GROUP BY 1, 2, 3)"""


@query("r05_assemble_cells", PAGED[:-1] + ", " + ROWS + ", " + TIMES + ", " + ASSEMBLED + """SELECT image_id, grp, t, n, c / greatest(g * len(times), 1) AS confidence FROM acells JOIN
    (SELECT image_id, count(*) AS c, count(DISTINCT grp) AS g FROM acells GROUP BY 1) USING (image_id) JOIN times USING (image_id)""", "t confidence")
def r05(spark, sf):
    k = kinds(spark, sf)
    return r.assemble_cells(k, r.time_points(k, even_calibration(spark, sf)))


@query("r06_events", with_(CELLS) + "SELECT *, coalesce(greatest(0, n - lead(n) OVER (PARTITION BY image_id, grp ORDER BY t)), 0) AS events FROM cells")
def r06(spark, sf):
    return r.events(cells(spark, sf))


HEADED = """headed AS (SELECT * FROM cells UNION ALL SELECT image_id, CASE WHEN image_id % 2 = 0 THEN '0' ELSE '01 ' END, CAST(k AS DOUBLE), CASE WHEN image_id % 3 = 0 THEN k * 6 ELSE k * 6 + 6 END AS n FROM (SELECT CAST(n_nationkey AS BIGINT) AS image_id, unnest(range(0, CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 9 END)) AS k FROM nation))"""


def headed(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("image_id"))
    h = n.select("image_id", F.explode(F.sequence(F.lit(0), F.when(F.col("image_id") % 4 == 0, 1).otherwise(8))).alias("k"))
    h = h.select("image_id", F.when(F.col("image_id") % 2 == 0, "0").otherwise("01 ").alias("grp"), F.col("k").cast("double").alias("t"),
                 F.when(F.col("image_id") % 3 == 0, F.col("k") * 6).otherwise(F.col("k") * 6 + 6).cast("bigint").alias("n"))
    return cells(spark, sf).unionByName(h)


@query("r07_fix_header_group", with_(CELLS, HEADED) + """, o AS (SELECT *, row_number() OVER (PARTITION BY image_id, grp ORDER BY t) AS i, count(*) OVER (PARTITION BY image_id, grp) AS k FROM headed),
    hs AS (SELECT image_id, grp, list(n ORDER BY t) AS l FROM headed WHERE trim(grp) IN ('0', '0 1', '01') GROUP BY 1, 2), hq AS (SELECT image_id, grp AS hg, CASE WHEN l[1] > 0 THEN list_concat([0], l) ELSE l END AS tt FROM hs WHERE len(l) >= 3 AND l[1] < 10 AND list_max(l) < 100)
    SELECT image_id, grp, CASE WHEN hg IS NOT NULL AND len(tt) >= k THEN CAST(tt[i] AS DOUBLE) ELSE t END AS t, n FROM o LEFT JOIN hq USING (image_id) WHERE hg IS NULL OR grp <> hg""")
def r07(spark, sf):
    return r.fix_header_group(headed(spark, sf))


@query("r08_survival_anchors", with_(CELLS) + "SELECT image_id, grp, t, n / first_value(n) OVER (PARTITION BY image_id, grp ORDER BY t) * 0.95e0 AS s FROM cells", "s")
def r08(spark, sf):
    return r.survival_anchors(cells(spark, sf))


SHORT = """short AS (SELECT curve_id, t, CASE WHEN curve_id % 3 = 0 AND t > 40 THEN 0.02e0 ELSE s END AS s FROM noisy WHERE curve_id % 4 = 0 OR t < 70),
    refs AS (SELECT curve_id, CAST(t AS DOUBLE) AS t, 0.9e0 * (1 - t / 150) AS s FROM (SELECT DISTINCT curve_id FROM noisy), (SELECT unnest(range(0, 100, 10)) AS t) q WHERE curve_id % 5 > 0 OR t < 30)"""


def short(spark, sf):
    n = v.noisy(spark, sf).where("curve_id % 4 = 0 or t < 70")
    return n.withColumn("s", F.when((F.col("curve_id") % 3 == 0) & (F.col("t") > 40), 0.02).otherwise(F.col("s")))


def refs(spark, sf):
    c = v.noisy(spark, sf).select("curve_id").distinct().withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i * F.lit(10.0))))
    return c.where("curve_id % 5 > 0 or t < 30").select("curve_id", "t", (0.9 * (1 - F.col("t") / 150)).alias("s"))


LINE = """sg AS (SELECT *, lead(t) OVER w AS t2, lead(s) OVER w AS s2, row_number() OVER w AS i, count(*) OVER (PARTITION BY curve_id) AS k FROM {anch} WINDOW w AS (PARTITION BY curve_id ORDER BY t)),
    gd AS (SELECT p.curve_id, coalesce(from_t, 0e0) + kk * 0.1e0 AS t FROM (SELECT *, unnest(range(CASE WHEN from_t IS NULL THEN 0 ELSE 1 END, CAST(floor((100e0 - coalesce(from_t, 0e0)) / 0.1e0) AS BIGINT) + 1)) AS kk FROM {plan}) p),
    ext AS (SELECT gd.curve_id, gd.t, greatest(0e0, least(1e0, sg.s + (s2 - sg.s) * ((gd.t - sg.t) / (t2 - sg.t)))) AS s FROM gd JOIN sg ON sg.curve_id = gd.curve_id AND t2 IS NOT NULL AND (i = 1 OR gd.t >= sg.t - 1e-9) AND (i = k - 1 OR gd.t < t2 - 1e-9))"""


@query("r09_repair_with_anchors", with_(v.NOISY, SHORT) + """, st AS (SELECT curve_id, max(t) < 80 AS need FROM short GROUP BY 1), nr AS (SELECT p.curve_id, p.t, min_by(r.s, struct_pack(a := abs(r.t - p.t), b := r.t)) AS rs, min(abs(r.t - p.t)) AS d FROM short p JOIN refs r USING (curve_id) GROUP BY 1, 2),
    mk AS (SELECT p.*, need AND coalesce(d < 3 AND p.s < rs * 0.3e0, false) AS bad FROM short p JOIN st USING (curve_id) LEFT JOIN nr USING (curve_id, t)),
    pl AS (SELECT curve_id, min(t) FILTER (bad) AS f, max(t) FILTER (NOT bad) AS from_t FROM mk GROUP BY 1 HAVING min(t) FILTER (bad) IS NOT NULL),
    us AS (SELECT refs.* FROM refs JOIN pl USING (curve_id) WHERE from_t IS NULL OR t >= f - 2), plan AS (SELECT curve_id, from_t FROM pl SEMI JOIN (SELECT curve_id FROM us GROUP BY 1 HAVING count(*) >= 2) USING (curve_id)),
    """ + LINE.format(anch="us", plan="plan") + " SELECT curve_id, t, s FROM mk LEFT JOIN (SELECT curve_id, true AS go FROM plan) USING (curve_id) WHERE go IS NULL OR NOT bad UNION ALL SELECT * FROM ext", "t s")
def r09(spark, sf):
    return r.repair_with_anchors(short(spark, sf), refs(spark, sf), 100.0)


@query("r10_merge_waypoints", with_(v.NOISY, SHORT) + """, la AS (SELECT curve_id, max(t) AS from_t, max_by(s, t) AS s FROM short GROUP BY 1), us AS (SELECT refs.* FROM refs JOIN la USING (curve_id) WHERE refs.t > from_t UNION ALL SELECT curve_id, from_t, s FROM la WHERE s > 0),
    plan AS (SELECT curve_id, from_t FROM la SEMI JOIN (SELECT curve_id FROM us GROUP BY 1 HAVING count(*) >= 2) USING (curve_id)), """ + LINE.format(anch="us", plan="plan") + " SELECT * FROM short UNION ALL SELECT * FROM ext", "t s")
def r10(spark, sf):
    return r.merge_waypoints(short(spark, sf), refs(spark, sf), 100.0)


@query("r11_apply_corrections", with_(CELLS) + """, k AS (SELECT image_id, grp, t, n + 5 AS n FROM cells WHERE t = 3 UNION ALL SELECT image_id, 'EXTRA', 0e0, max(n) FROM cells GROUP BY 1)
    SELECT * FROM (SELECT c.image_id, c.grp, c.t, coalesce(k.n, c.n) AS n FROM cells c LEFT JOIN k USING (image_id, grp, t) UNION ALL SELECT * FROM k WHERE grp = 'EXTRA') WHERE NOT (grp = 'MACHINERY' AND image_id % 2 = 0)""")
def r11(spark, sf):
    c = cells(spark, sf)
    fix = c.where("t = 3").withColumn("n", F.col("n") + 5)
    extra = c.groupBy("image_id").agg(F.max("n").alias("n")).select("image_id", F.lit("EXTRA").alias("grp"), F.lit(0.0).alias("t"), "n")
    gone = c.where("grp = 'MACHINERY' and image_id % 2 = 0").select("image_id", "grp").distinct()
    return r.apply_corrections(c, fix.unionByName(extra), gone)


@query("r12_retain_times", with_(CELLS) + "SELECT * FROM cells WHERE t IN (0, 2, 5)")
def r12(spark, sf):
    return r.retain_times(cells(spark, sf), [0, 2, 5, 11])


@query("r13_pad_values", with_(CELLS) + """, l AS (SELECT image_id, grp, list(n ORDER BY t) AS v FROM cells GROUP BY 1, 2)
    SELECT image_id, grp, ([0e0, 2e0, 4e0, 6e0, 8e0])[i] AS t, coalesce(v[i], 0) AS n FROM l, (SELECT unnest(range(1, 6)) AS i) q""")
def r13(spark, sf):
    c = cells(spark, sf).groupBy("image_id", "grp").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("v"))
    return r.pad_values(c.select("image_id", "grp", F.transform("v", lambda q: q["n"]).alias("values")), [0, 2, 4, 6, 8])


SECOND = """second AS (SELECT image_id, CASE WHEN grp = 'BUILDING' THEN 'The building arm' WHEN grp = 'MACHINERY' THEN 'mach-inery' WHEN grp = 'HOUSEHOLD' THEN 'house' ELSE 'Other ' || grp END AS grp, t, CASE WHEN t > 3 THEN n * 2 ELSE n + 1 END AS n FROM cells WHERE t <> 1),
    first_ AS (SELECT * FROM cells WHERE t <> 2), conf AS (SELECT CAST(n_nationkey AS BIGINT) AS image_id, n_nationkey / 25 AS q FROM nation)"""
MATCHED = """ma AS (SELECT DISTINCT f.image_id, s.grp AS b, f.grp AS a, regexp_replace(lower(f.grp), '[^a-z0-9]', '', 'g') AS na, regexp_replace(lower(s.grp), '[^a-z0-9]', '', 'g') AS nb FROM first_ f JOIN second s USING (image_id)),
    mb AS (SELECT image_id, b, min(a) AS a FROM ma WHERE contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) OR contains(na, nb) OR contains(nb, na) OR na[1:4] = nb[1:4] GROUP BY 1, 2),
    mh AS (SELECT s.image_id, mb.a AS grp, s.t, max_by(s.n, s.grp) AS n2, any_value(q) AS q FROM second s JOIN mb ON mb.image_id = s.image_id AND mb.b = s.grp JOIN conf ON conf.image_id = s.image_id GROUP BY 1, 2, 3),
    {name} AS (SELECT coalesce(f.image_id, h.image_id) AS image_id, coalesce(f.grp, h.grp) AS grp, coalesce(f.t, h.t) AS t, CASE WHEN f.n IS NULL THEN CASE WHEN h.q > {fill} THEN n2 END WHEN abs(n2 - f.n) / greatest(n2, 1) > {part} AND h.q > 0.8e0 THEN n2 ELSE f.n END AS n
        FROM first_ f FULL OUTER JOIN mh h ON f.image_id = h.image_id AND f.grp = h.grp AND f.t = h.t),
    {name}_all AS (SELECT * FROM {name} WHERE n IS NOT NULL UNION ALL SELECT s.image_id, s.grp, s.t, s.n FROM second s JOIN conf USING (image_id) LEFT JOIN mb ON mb.image_id = s.image_id AND mb.b = s.grp WHERE mb.a IS NULL AND q > 0.7e0)"""


def two_sources(spark, sf):
    c = cells(spark, sf)
    g = F.col("grp")
    name = F.when(g == "BUILDING", F.lit("The building arm")).when(g == "MACHINERY", F.lit("mach-inery")).when(g == "HOUSEHOLD", F.lit("house")).otherwise(F.concat(F.lit("Other "), g))
    second = c.where("t <> 1").select("image_id", name.alias("grp"), "t", F.when(F.col("t") > 3, F.col("n") * 2).otherwise(F.col("n") + 1).alias("n"))
    conf = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("image_id"), (F.col("n_nationkey") / 25).alias("confidence"))
    return c.where("t <> 2"), second, conf


@query("r14_reconcile_tables", with_(CELLS, SECOND, MATCHED.format(name="mf", fill="0.6e0", part="0.3e0")) + "SELECT * FROM mf_all")
def r14(spark, sf):
    return r.reconcile_tables(*two_sources(spark, sf))


@query("r14_reconcile_tables_check", with_(CELLS, SECOND, MATCHED.format(name="mf", fill="2e0", part="0.2e0")) + "SELECT * FROM mf_all")
def r14b(spark, sf):
    return r.reconcile_tables(*two_sources(spark, sf), rules="check")


@query("r15_display_matrix", with_(CELLS) + "SELECT image_id, grp" + "".join(f", max(n) FILTER (t = {k}) AS t_{k}" for k in range(7)) + " FROM cells GROUP BY 1, 2")
def r15(spark, sf):
    return r.display_matrix(cells(spark, sf), list(range(7)))


@query("r16_numeric_grid", with_(PAGE) + """, b AS (SELECT image_id, floor(center_y / 20) AS b, count(*) FILTER (regexp_matches(trim("text"), '^\\d+$')) AS k FROM toks GROUP BY 1, 2)
    SELECT image_id, count(*) >= 2 AND count(*) FILTER (k >= 3) >= 2 AS has_grid FROM b GROUP BY 1""")
def r16(spark, sf):
    return r.numeric_grid(page_tokens(spark, sf))


@query("r17_merge_token_passes", with_(WORDS) + """, f AS (SELECT image_id, "text" FROM tokens WHERE length("text") > 8 + image_id % 17), s AS (SELECT image_id, CASE WHEN length("text") % 2 = 0 THEN "text" ELSE "text" || 'x' END AS "text" FROM tokens WHERE length("text") > 6)
    SELECT * FROM f UNION ALL SELECT s.* FROM s LEFT JOIN (SELECT image_id, count(*) AS n FROM f GROUP BY 1) USING (image_id) WHERE coalesce(n, 0) < 5 AND NOT EXISTS (SELECT 1 FROM f WHERE f.image_id = s.image_id AND lower(trim(f."text")) = lower(trim(s."text")))""")
def r17(spark, sf):
    t = tokens(spark, sf).select("image_id", "text")
    return r.merge_token_passes(t.where(F.length("text") > 8 + F.col("image_id") % 17), t.where(F.length("text") > 6).withColumn("text", F.when(F.length("text") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))))


@query("r18_table_region", """WITH im AS (SELECT c_custkey AS image_id, CAST(260 + c_custkey % 9 AS INTEGER) AS width, CAST(200 + c_custkey % 40 AS INTEGER) AS height, 0 AS py, CAST(60 + c_custkey % 30 AS INTEGER) AS ph FROM customer),
    pix AS (SELECT o_custkey AS image_id, CAST(o_orderkey * 7 % 250 AS INTEGER) AS x, CAST(o_orderkey * 13 % 200 AS INTEGER) AS y, CAST(o_orderkey % 256 AS INTEGER) AS gray FROM orders), """ + PAGE + """,
    b AS (SELECT image_id, any_value(width) AS width, any_value(height) AS height, tp, min(x) AS a, max(x) AS b, min(y) - tp AS c, max(y) - tp AS d FROM (SELECT p.*, width, height, CAST(floor(py + ph * 0.75e0) AS INTEGER) AS tp FROM pix p JOIN im USING (image_id) WHERE gray < 200) WHERE y >= tp AND height - tp >= 50 GROUP BY image_id, tp),
    e AS (SELECT *, greatest(0, a - 14) AS x1, least(width - 1, b + 14) AS x2, greatest(0, c - 2) AS y1, least(height - tp - 1, d + 2) AS y2 FROM b),
    g AS (SELECT image_id, greatest(0, x1 - 10) AS x, tp + greatest(0, y1 - 10) AS y, least(width - greatest(0, x1 - 10), x2 - x1 + 21) AS w, least(height - tp - greatest(0, y1 - 10), y2 - y1 + 21) AS h FROM e WHERE x2 - x1 + 1 >= 100 AND y2 - y1 + 1 >= 50),
    i AS (SELECT t.*, x, y, w, h FROM toks t JOIN g USING (image_id) WHERE center_x BETWEEN x AND x + w AND center_y BETWEEN y AND y + h),
    hd AS (SELECT image_id, regexp_matches(string_agg(lower("text"), ' ' ORDER BY center_y, center_x, "text"), '""" + HEAD + """') AS hh FROM i WHERE center_y < y + least(40, h // 3) GROUP BY 1),
    ng AS (SELECT image_id, count(*) >= 2 AND count(*) FILTER (k >= 3) >= 2 AS gr FROM (SELECT image_id, floor(center_y / 20) AS bb, count(*) FILTER (regexp_matches(trim("text"), '^\\d+$')) AS k FROM i GROUP BY 1, 2) GROUP BY 1)
    SELECT image_id, x, y, w, h, coalesce(hh, false) AS header, coalesce(gr, false) AS grid FROM g LEFT JOIN hd USING (image_id) LEFT JOIN ng USING (image_id) WHERE coalesce(hh, false) OR coalesce(gr, false)""")
def r18(spark, sf):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    im = table(spark, sf, "customer").select(k.alias("image_id"), (260 + k % 9).cast("int").alias("width"), (200 + k % 40).cast("int").alias("height"), F.lit(0).alias("py"), (60 + k % 30).cast("int").alias("ph"))
    px = table(spark, sf, "orders").select(F.col("o_custkey").alias("image_id"), (o * 7 % 250).cast("int").alias("x"), (o * 13 % 200).cast("int").alias("y"), (o % 256).cast("int").alias("gray"))
    return r.table_region(px, page_tokens(spark, sf), im, im)


@query("r19_choose_source", with_(CELLS, SECOND.replace("FROM cells WHERE t <> 2)", "FROM cells WHERE t <> 2 AND image_id % 5 > 0)"), MATCHED.format(name="mf", fill="0.6e0", part="0.3e0")) + """,
    pl AS (SELECT CAST(n_nationkey AS BIGINT) AS image_id, CASE WHEN n_nationkey % 5 > 0 THEN (n_nationkey % 10) / 10 END AS q1, CASE WHEN n_nationkey / 25 >= 0.5e0 THEN n_nationkey / 25 END AS q2 FROM nation),
    ps AS (SELECT *, CASE WHEN q1 >= 0.7e0 OR q2 IS NULL THEN 'first' WHEN q1 IS NULL THEN 'second' ELSE 'both' END AS cs FROM pl WHERE q1 IS NOT NULL OR q2 IS NOT NULL),
    al AS (SELECT f.*, 'first' AS source FROM first_ f SEMI JOIN (SELECT image_id FROM ps WHERE cs = 'first') USING (image_id) UNION ALL SELECT s.*, 'second' FROM second s SEMI JOIN (SELECT image_id FROM ps WHERE cs = 'second') USING (image_id)
        UNION ALL SELECT m.*, 'both' FROM mf_all m SEMI JOIN (SELECT image_id FROM ps WHERE cs = 'both') USING (image_id))
    SELECT al.image_id, grp, t, n, source, CASE cs WHEN 'first' THEN q1 WHEN 'second' THEN q2 * 0.9e0 ELSE greatest(q1, (q1 + q2) / 2) END AS confidence FROM al JOIN ps USING (image_id)""", "confidence")
def r19(spark, sf):
    first, second, conf = two_sources(spark, sf)
    q1 = conf.where("image_id % 5 > 0").select("image_id", ((F.col("image_id") % 10) / 10).alias("confidence"))
    got, chosen = r.choose_source(first.where("image_id % 5 > 0"), q1, second, conf)
    return got.join(chosen, "image_id")


@query("r20_flatten_groups", with_(CELLS) + "SELECT * FROM cells")
def r20(spark, sf):
    c = cells(spark, sf)
    g = c.groupBy("image_id", "grp").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("m"))
    return r.flatten_groups(g.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("grp", "m"))).alias("groups")))
