"""Queries of the text parsing: model answers are written from the supplier, customer and part tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from .base import query, table
from .clean import with_


def answers(spark, sf):
    """Table answers in both line forms, with markdown marks, repeated groups and missing time lines."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = lambda c: c.cast("string")
    head = F.when(k % 5 == 4, F.lit("no times here")).otherwise(F.lit("**TIME_POINTS:** 0, 3, 6, x"))
    body = F.when(k % 3 == 0, F.concat(F.lit("- GROUP: "), F.col("s_name"), F.lit(" | "), s(40 + n), F.lit(", "), s(20 + n), F.lit(", "), s(n)))
    body = body.otherwise(F.concat(F.lit("GROUP: Arm "), F.when(k % 2 == 0, F.lit("A")).otherwise(F.lit("B two")), F.lit(" "), s(40 + n), F.lit(", "), s(20 + n), F.lit(".7, "), s(n)))
    again = F.when(k % 7 == 0, F.concat(F.lit("\nGROUP: Arm A | "), s(k), F.lit(", 1, 2, 3"))).otherwise(F.lit(""))
    text = F.concat(F.lit("## Result\n"), head, F.lit("\n\n"), body, again, F.lit("\nCONFIDENCE: "), s(50 + k % 50), F.lit("%"))
    return table(spark, sf, "supplier").select(k.alias("image_id"), text.alias("text"))


@query("t01_parse_table_response", """WITH a AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name FROM supplier),
    g AS (SELECT k, CASE WHEN k % 3 = 0 THEN s_name WHEN k % 2 = 0 THEN 'Arm A' ELSE 'Arm B two' END AS grp, [CAST(40 + n AS BIGINT), CAST(20 + n AS BIGINT), CAST(n AS BIGINT)] AS c, 1 AS o FROM a
        UNION ALL SELECT k, 'Arm A', [CAST(k AS BIGINT), 1, 2, 3], 2 FROM a WHERE k % 7 = 0),
    h AS (SELECT k, grp, max_by(c, o) AS c FROM g GROUP BY 1, 2), e AS (SELECT k, grp, unnest(range(1, len(c) + 1)) AS i, c FROM h)
    SELECT k AS image_id, grp, (i - 1) * 3e0 AS t, c[i] AS n, (50 + k % 50) / 100 AS confidence FROM e WHERE k % 5 = 4 OR i <= 3""", "confidence t")
def t01(spark, sf):
    return x.parse_table_response(answers(spark, sf))


def pieces(spark, sf, *parts):
    """Answers per customer from constant texts and columns."""
    cols = [p if not isinstance(p, str) else F.lit(p) for p in parts]
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id"), F.concat(*[c.cast("string") for c in cols]).alias("text"))





@query("t02_parse_curve_list", """WITH a AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m FROM customer), b AS (SELECT k, n, CAST(unnest([0, 1]) AS INTEGER) AS pos, m FROM a)
    SELECT k AS image_id, pos, CASE WHEN pos = 0 THEN m || ' solid' ELSE 'dashed gray' END AS description, 0e0 AS x_low, CASE WHEN k % 3 = 0 THEN 24e0 ELSE CAST(n + 12 AS DOUBLE) END AS x_high,
    0e0 AS y_low, 100e0 AS y_high, k % 2 = 0 AS percent, CASE WHEN k % 4 = 0 THEN 0.5e0 ELSE (k % 90) / 100 END AS confidence FROM b WHERE k % 90 > 1 UNION ALL
    SELECT k, pos, CASE WHEN pos = 0 THEN m || ' solid' ELSE 'dashed gray' END, 0e0, CASE WHEN k % 3 = 0 THEN 24e0 ELSE CAST(n + 12 AS DOUBLE) END, 0e0, 100e0, k % 2 = 0,
    CASE WHEN k % 4 = 0 THEN 0.5e0 ELSE CAST(k % 90 AS DOUBLE) END FROM b WHERE k % 90 <= 1""", "confidence x_high")
def t02(spark, sf):
    k = F.col("c_custkey")
    return x.parse_curve_list_response(pieces(
        spark, sf, "CURVE_1: ", F.col("c_mktsegment"), " solid (upper)\n* curve-2: dashed gray\nX_RANGE: ", F.when(k % 3 == 0, F.lit("unknown")).otherwise(F.concat(F.lit("0 to "), (F.col("c_nationkey") + 12).cast("string"))),
        "\nY_RANGE: 0%, 100%\nY_SCALE: ", F.when(k % 2 == 0, F.lit("Percentage")).otherwise(F.lit("decimal")), "\nCONFIDENCE: ", F.when(k % 4 == 0, F.lit("high")).otherwise((k % 90).cast("string"))))


@query("t03_parse_points", """WITH a AS (SELECT l_orderkey AS image_id, l_linenumber - 1 AS pos, CAST(l_linenumber AS DOUBLE) AS t, l_quantity AS q FROM lineitem)
    SELECT image_id, 'order ' || image_id AS name, pos, t, CASE WHEN q > 1.5e0 THEN q / 100 ELSE q END AS s, 0.8e0 AS confidence FROM
    (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pos, q) - 1 AS INTEGER) AS pos, t, q FROM a)""", "t s")
def t03(spark, sf):
    return x.parse_points_response(point_answers(spark, sf))


def point_answers(spark, sf):
    """One answer per order: a line per item (an order has at most a handful)."""
    li = table(spark, sf, "lineitem")
    row = F.struct("l_linenumber", "l_quantity")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda q: F.concat(
        F.when(q["l_linenumber"] % 2 == 0, F.lit("- time: ")).otherwise(F.lit("TIME: ")), q["l_linenumber"].cast("string"),
        F.when(q["l_linenumber"] % 2 == 0, F.lit(", survival: ")).otherwise(F.lit(" | SURVIVAL: ")), q["l_quantity"].cast("string"))), "\n")
    return li.groupBy(F.col("l_orderkey").alias("image_id")).agg(text.alias("_t")).select(
        "image_id", F.concat(F.lit("**CURVE:** order "), F.col("image_id").cast("string"), F.lit("\n"), F.col("_t"), F.lit("\nCONFIDENCE: 80/100")).alias("text"))


@query("t04_parse_axis", """SELECT c_custkey AS image_id, 'Time: ' || c_mktsegment AS x_label, CASE WHEN c_custkey % 3 > 0 THEN 0e0 END AS x_low, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey + 0.5e0 END AS x_high,
    CAST(NULL AS VARCHAR) AS y_label, 0e0 AS y_low, 1e0 AS y_high, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 5 AS INTEGER) END AS curve_count,
    CASE WHEN c_custkey % 4 = 0 THEN 0.5e0 ELSE (c_custkey % 4) * 0.25e0 END AS confidence, c_custkey % 3 > 0 AND c_custkey % 4 <> 1 AS is_valid FROM customer""", "x_high confidence")
def t04(spark, sf):
    k = F.col("c_custkey")
    return x.parse_axis_response(pieces(
        spark, sf, "# Axes\n- X_LABEL: Time: ", F.col("c_mktsegment"), "\nXRANGE: ", F.when(k % 3 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("0, "), F.col("c_nationkey").cast("string"), F.lit(".5 months"))),
        "\nY_RANGE: 0.0 1.0\nCURVES: ", F.when(k % 5 == 0, F.lit("many")).otherwise(F.concat(F.lit("about "), (k % 5).cast("string"))), "\nCONFIDENCE: ",
        F.when(k % 4 == 0, F.lit("?")).otherwise(((k % 4) * 0.25).cast("string"))))


@query("t05_parse_verdict", """WITH a AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE 'PARTIAL' END AS m, (40 + c_custkey % 60) / 100 AS c FROM customer)
    SELECT k AS image_id, m AS match, c AS confidence, CASE WHEN k % 2 = 0 THEN 'None' ELSE 'gap;extra line' END AS issues, 'lower saturation' AS suggestions,
    m = 'YES' OR (m = 'PARTIAL' AND c >= 0.7e0) AS is_valid, m = 'NO' OR (m = 'PARTIAL' AND c < 0.7e0) AS needs_retry FROM a""", "confidence")
def t05(spark, sf):
    k = F.col("c_custkey")
    v = x.parse_verdict_response(pieces(
        spark, sf, "Match: ", F.when(k % 3 == 0, F.lit("yes, fully")).when(k % 3 == 1, F.lit("no")).otherwise(F.lit("partly")), "\nCONFIDENCE: ", 40 + k % 60, "%\nISSUES: ",
        F.when(k % 2 == 0, F.lit("none")).otherwise(F.lit("gap, , extra line")), "\nSUGGESTIONS: lower saturation"))
    return v.withColumns({"issues": F.array_join("issues", ";"), "suggestions": F.array_join("suggestions", ";")})


@query("t06_plot_area_assessment", """SELECT c_custkey AS image_id, c_custkey % 5 IN (2, 3) AND NOT (c_custkey % 5 = 3 AND c_custkey % 2 = 0) AS acceptable,
    CASE c_custkey % 5 WHEN 4 THEN 0e0 WHEN 3 THEN 0.5e0 WHEN 1 THEN 0.5e0 ELSE 0.8e0 END AS confidence, c_custkey % 5 = 0 AS adjust_bottom, c_custkey % 5 = 1 AS adjust_left, c_custkey % 5 = 1 OR (c_custkey % 5 = 3 AND c_custkey % 2 = 0) AS adjust_bounds FROM customer""")
def t06a(spark, sf):
    k = F.col("c_custkey") % 5
    return x.parse_plot_area_assessment(pieces(spark, sf, F.when(k == 0, F.lit("X_AXIS_LABELS: YES\nY_AXIS_LABELS: NO\nCORRECT: NO")).when(k == 1, F.lit("x axis labels: no\ny axis labels: Yes")).when(
        k == 2, F.lit("X_AXIS_LABELS: NO\nCORRECT: YES")).when(k == 3, F.when(F.col("c_custkey") % 2 == 0, F.lit("I see numbers at the left")).otherwise(F.lit("all fine"))).otherwise(F.lit("Error: timeout"))))


@query("t06_extraction_assessment", """SELECT c_custkey AS image_id, c_custkey % 4 IN (1, 2) AS acceptable, CASE c_custkey % 4 WHEN 0 THEN 0.85e0 WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.6e0 + 0.1e0 * 3 ELSE 0.3e0 END AS confidence,
    CASE c_custkey % 4 WHEN 0 THEN 'Curves incomplete; Text issue: ' || c_mktsegment || '; Artifacts remain' WHEN 3 THEN 'Possible curve gaps detected; Possible text/annotation remaining' ELSE '' END AS issues FROM customer""", "confidence")
def t06b(spark, sf):
    k = F.col("c_custkey") % 4
    return x.parse_extraction_assessment(pieces(spark, sf, F.when(k == 0, F.concat(F.lit("CURVES_COMPLETE: no\nCURVE-ISSUES: none\nTEXT_REMOVED: yes\nTEXT_ISSUES: "), F.col("c_mktsegment"), F.lit("\nARTIFACTS_REMOVED: NO\nOVERALL: NO\nCONFIDENCE: 85%"))).when(
        k == 1, F.lit("CURVES_COMPLETE: YES\nACCEPTABLE: yes\nCONFIDENCE: 0.9")).when(k == 2, F.lit("All curves are clean and good")).otherwise(F.lit("there is a gap and a text box"))))


@query("t06_curve_count", """SELECT c_custkey AS image_id, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey % 9 AS INTEGER) WHEN 1 THEN 3 WHEN 2 THEN 2 END AS curve_count,
    CASE WHEN c_custkey % 4 = 0 THEN 'red, cyan' END AS colors, CASE WHEN c_custkey % 4 = 3 THEN 0.3e0 ELSE 0.8e0 END AS confidence FROM customer""")
def t06c(spark, sf):
    k = F.col("c_custkey") % 4
    return x.parse_curve_count(pieces(spark, sf, F.when(k == 0, F.concat(F.lit("CURVES: "), (F.col("c_custkey") % 9).cast("string"), F.lit("\nCOLORS: Red, Cyan"))).when(
        k == 1, F.lit("I can see 3 survival lines")).when(k == 2, F.lit("maybe 2 of 24")).otherwise(F.lit("none visible"))))


@query("t06_completeness", """SELECT c_custkey AS image_id, CAST(c_custkey % 6 AS INTEGER) AS found, c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AS acceptable, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS missing FROM customer""")
def t06d(spark, sf):
    k = F.col("c_custkey")
    return x.parse_completeness(pieces(spark, sf, "FOUND: ", k % 6, " curves\nCOMPLETE: ", F.when(k % 3 == 0, F.lit("No")).otherwise(F.lit("YES")), "\nMISSING: ", F.when(k % 2 == 1, F.col("c_mktsegment")).otherwise(F.lit("none"))))


@query("t07_text_regions", """SELECT c_custkey AS image_id, CAST(p AS INTEGER) AS pos, CASE p WHEN 0 THEN c_mktsegment ELSE 'legend' END AS location, CASE p WHEN 0 THEN c_name[1:8] ELSE 'p = 0.01' END AS content,
    p = 0 AND c_custkey % 2 = 0 AS overlaps_curve FROM customer, (VALUES (0), (1)) v(p)""")
def t07a(spark, sf):
    return x.parse_text_regions(pieces(spark, sf, "found:\nTEXT_REGION: ", F.col("c_mktsegment"), " - \"", F.substring("c_name", 1, 8), "\" - overlaps: ", F.when(F.col("c_custkey") % 2 == 0, F.lit("Yes")).otherwise(F.lit("no")),
                                       "\n TEXT_REGION: legend - p = 0.01"))


@query("t07_removal_verdict", """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'COMPLETE' ELSE 'FAILED' END AS t, CASE WHEN c_custkey % 3 = 0 THEN 'NO' ELSE 'Partial' END AS c, CASE WHEN c_custkey % 5 = 0 THEN 'pass' ELSE 'UNKNOWN' END AS o FROM customer)
    SELECT k AS image_id, t AS text_removed, c AS curves_intact, o AS overall, 'label left; gap at 3' AS issues, o = 'pass' OR (t = 'COMPLETE' AND c = 'Partial') AS success FROM a""")
def t07b(spark, sf):
    k = F.col("c_custkey")
    return x.parse_removal_verdict(pieces(spark, sf, "TEXT_REMOVED: ", F.when(k % 2 == 0, F.lit("COMPLETE")).otherwise(F.lit("FAILED")), "\nCURVES_INTACT: ", F.when(k % 3 == 0, F.lit("NO")).otherwise(F.lit("Partial")),
                                          "\nISSUES:\n- label left\n- gap at 3", F.when(k % 5 == 0, F.lit("\nOVERALL: pass")).otherwise(F.lit(""))))


@query("t08_color_and_style", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(d, '{w}') THEN '{n}'" for w, n in [(w, w) for w in x.COLOR_WORDS] + list(x.COLOR_ALIASES.items()))
       + """ ELSE 'unknown' END AS color, CASE WHEN contains(d, 'dash') THEN 'dashed' WHEN contains(d, 'dot') THEN 'dotted' ELSE 'solid' END AS style FROM
       (SELECT p_partkey, lower(p_name || ' ' || CASE p_partkey % 5 WHEN 0 THEN 'Grey dashed' WHEN 1 THEN 'DOTTED teal' WHEN 2 THEN 'navy' WHEN 3 THEN 'dark' ELSE '' END) AS d FROM part)""")
def t08(spark, sf):
    k = F.col("p_partkey") % 5
    d = F.concat_ws(" ", "p_name", F.when(k == 0, F.lit("Grey dashed")).when(k == 1, F.lit("DOTTED teal")).when(k == 2, F.lit("navy")).when(k == 3, F.lit("dark")).otherwise(F.lit("")))
    return table(spark, sf, "part").select("p_partkey", x.color_of(d).alias("color"), x.style_of(d).alias("style"))


@query("t09_dedup_by_color_group", "WITH a AS (SELECT p_size AS image_id, p_partkey AS pos, CASE " + " ".join(f"WHEN contains(lower(p_name), '{w}') THEN '{n}'" for w, n in [(w, w) for w in x.COLOR_WORDS] + list(x.COLOR_ALIASES.items()))
       + " ELSE 'unknown' END AS color FROM part), b AS (SELECT *, CASE " + " ".join(f"WHEN color IN ({', '.join(repr(m) for m in ms)}) THEN '{g}'" for g, ms in x.COLOR_GROUPS.items())
       + " ELSE color END AS color_group FROM a) SELECT image_id, color_group, min(pos) AS pos, min_by(color, pos) AS color FROM b GROUP BY 1, 2")
def t09(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").alias("image_id"), F.col("p_partkey").alias("pos"), x.color_of(F.col("p_name")).alias("color"))
    return x.dedup_by_color_group(p)


@query("t10_safe_name", "SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N} _\\-]', '_', 'g') AS safe FROM documents")
def t10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", x.safe_name(F.col("text")).alias("safe"))


WORDS = ["lower saturation", "Increase saturation", "wider color tolerance", "decrease color tolerance", "stricter overlap", "looser overlap"]
LIST = "[" + ", ".join(repr(w) for w in WORDS) + "]"


@query("t11_adjust_params", f"""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS o, l_partkey % 6 AS w FROM lineitem),
    b AS (SELECT k, list_reduce(list({{'w': w, 'a': 15, 'b': 15, 'c': 3}} ORDER BY o, w), lambda p, s: {{'w': s.w, 'a': CASE s.w WHEN 0 THEN greatest(5, p.a - 5) WHEN 1 THEN least(50, p.a + 5) ELSE p.a END,
        'b': CASE s.w WHEN 2 THEN least(30, p.b + 5) WHEN 3 THEN greatest(5, p.b - 5) ELSE p.b END, 'c': CASE s.w WHEN 4 THEN greatest(1, p.c - 1) WHEN 5 THEN least(10, p.c + 1) ELSE p.c END}}, {{'w': -1::BIGINT, 'a': 15, 'b': 15, 'c': 3}}) AS r FROM a GROUP BY 1)
    SELECT k AS image_id, r.a AS saturation_min, r.b AS hue_tolerance, r.c AS overlap_threshold FROM b""")
def t11(spark, sf):
    w = F.element_at(F.array(*[F.lit(q) for q in WORDS]), (F.col("l_partkey") % 6 + 1).cast("int"))
    # an order has at most a handful of items
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("o"), (F.col("l_partkey") % 6).alias("k"), w.alias("w")))).alias("_s"))
    p = s.select("image_id", F.transform("_s", lambda q: q["w"]).alias("suggestions"), F.lit(15).alias("saturation_min"), F.lit(15).alias("hue_tolerance"), F.lit(3).alias("overlap_threshold"))
    return x.adjust_params(p).drop("suggestions")


@query("t11_adjust_extraction", """SELECT p_partkey AS image_id, CASE WHEN k IN (0, 3) THEN least(p_size + 5, 30) ELSE p_size END AS box_margin, CASE WHEN k IN (0, 3) THEN 50 ELSE 60 END AS box_min_area, CASE WHEN k IN (0, 3) THEN 240 ELSE 230 END AS light_threshold,
    CASE WHEN k IN (1, 3) THEN 120 ELSE 100 END AS black_threshold, CASE WHEN k IN (1, 3) THEN 2 ELSE 3 END AS min_component_area, CASE WHEN k = 2 THEN 200 ELSE 300 END AS rect_min_area, CASE WHEN k = 2 THEN 50 ELSE 40 END AS rect_max_height FROM (SELECT *, p_partkey % 5 AS k FROM part)""")
def t11b(spark, sf):
    k = F.col("p_partkey") % 5
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.when(k == 0, F.lit("Text left")).when(k == 1, F.lit("curve GAP")).when(k == 2, F.lit("artifact")).when(k == 3, F.lit("box; missing part")).otherwise(F.lit("")).alias("issues"),
                                        F.col("p_size").alias("box_margin"), F.lit(60).alias("box_min_area"), F.lit(230).alias("light_threshold"), F.lit(100).alias("black_threshold"), F.lit(3).alias("min_component_area"),
                                        F.lit(300).alias("rect_min_area"), F.lit(40).alias("rect_max_height"))
    return x.adjust_extraction(p).drop("issues")


def way_answers(spark, sf):
    k = F.col("c_custkey")
    return pieces(spark, sf, "points:\nT=", F.col("c_nationkey"), ", survival = ", F.round(F.abs("c_acctbal") / 100, 2), "\nnothing\n t = 30 -> Survival=0.", (k % 90 + 10))


@query("t12_parse_waypoints", """SELECT c_custkey AS image_id, 0 AS pos, CAST(c_nationkey AS DOUBLE) AS t, least(1e0, CASE WHEN v > 1 THEN v / 100 ELSE v END) AS s FROM (SELECT *, (CAST(round(abs(c_acctbal) * 100) AS BIGINT) + 50) // 100 / 100e0 AS v FROM customer)
    UNION ALL SELECT c_custkey, 1, 30e0, (c_custkey % 90 + 10) / 100 FROM customer""", "s")
def t12(spark, sf):
    p = x.parse_waypoints(way_answers(spark, sf))
    return p.withColumn("pos", F.col("pos").cast("int"))


@query("t12_low_coverage", "SELECT image_id FROM (SELECT l_orderkey % 500 AS image_id, max(l_linenumber) AS m FROM lineitem GROUP BY 1) WHERE m / 8 < 0.8e0")
def t12_low(spark, sf):
    points = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("image_id"), F.col("l_linenumber").alias("t"))
    return x.low_coverage(points, 8.0)


@query("t13_model_points_to_curves", """WITH a AS (SELECT l_orderkey % 500 AS image_id, l_orderkey AS curve, CAST(l_linenumber AS DOUBLE) AS t, CASE WHEN l_quantity > 1.5e0 THEN l_quantity / 100 ELSE l_quantity END AS s FROM lineitem),
    b AS (SELECT * FROM a UNION ALL SELECT DISTINCT image_id, curve, 0e0, 1e0 FROM a)
    SELECT image_id, curve, t, least(1e0, min(s) OVER (PARTITION BY image_id, curve ORDER BY t, s ROWS UNBOUNDED PRECEDING)) AS s, 0.8e0 AS mean_confidence FROM b""", "s mean_confidence")
def t13(spark, sf):
    a = point_answers(spark, sf).withColumn("curve", F.col("image_id")).withColumn("image_id", F.col("image_id") % 500)
    return x.model_points_to_curves(a)
