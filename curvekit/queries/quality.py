"""Queries of the quality rules and checks without pixels."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from . import views as v
from .base import query, table
from .clean import with_

SUPPLIERS = "SELECT s_suppkey AS curve_id, s_nationkey AS image_id FROM supplier"
TWISTED = """twisted AS (SELECT user_id AS curve_id, event_id * 1e-2 - 0.5e0 AS t,
    1.05e0 - event_id * 6e-5 - CASE WHEN value > 200 THEN 0.4e0 ELSE value / 1e3 END AS s FROM events)"""


def twisted(spark, sf):
    """Curves with negative times, values outside [0, 1], drops and rises."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("curve_id"), (F.col("event_id") * 1e-2 - 0.5).alias("t"),
                    (1.05 - F.col("event_id") * 6e-5 - F.when(F.col("value") > 200, 0.4).otherwise(F.col("value") / 1e3)).alias("s"))


def curves(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("curve_id"), F.col("c_nationkey").alias("image_id"))


CURVES = "curves AS (SELECT c_custkey AS curve_id, c_nationkey AS image_id FROM customer)"
NN = "CAST(NULL AS DOUBLE)"


@query("q01_min_points", with_(TWISTED, CURVES) + f"""SELECT curve_id, 'too_few_points' AS issue_type,
    CASE WHEN n = 0 THEN 'critical' ELSE 'error' END AS severity,
    CASE WHEN n = 0 THEN 'No data points in curve' ELSE 'Only ' || n || ' points (minimum: 60)' END AS message, {NN} AS t_lo, {NN} AS t_hi
    FROM (SELECT c.curve_id, count(p.t) AS n FROM curves c LEFT JOIN twisted p USING (curve_id) GROUP BY 1) WHERE n < 60""")
def q01(spark, sf):
    return q.min_points(twisted(spark, sf), curves=curves(spark, sf), least=60)


@query("q02_negative_time", with_(TWISTED) + """SELECT curve_id, 'negative_time' AS issue_type, 'error' AS severity,
    'Found ' || count(*) || ' points with negative time' AS message, min(t) AS t_lo, max(t) AS t_hi FROM twisted WHERE t < 0 GROUP BY 1""", "t_lo t_hi")
def q02(spark, sf):
    return q.negative_time(twisted(spark, sf))


@query("q03_value_range", with_(TWISTED) + f"""SELECT curve_id, 'survival_out_of_range' AS issue_type, 'error' AS severity,
    'Found ' || count(*) || ' points with survival outside [0,1]' AS message, {NN} AS t_lo, {NN} AS t_hi FROM twisted WHERE s < 0 OR s > 1 GROUP BY 1""")
def q03(spark, sf):
    return q.value_range(twisted(spark, sf))


LAGGED = "lagged AS (SELECT *, lag(t) OVER w AS pt, lag(s) OVER w AS ps FROM {src} WINDOW w AS (PARTITION BY curve_id ORDER BY t, s))"


@query("q04_sudden_drop", with_(TWISTED, LAGGED.format(src="twisted")) + """SELECT curve_id, 'sudden_drop' AS issue_type, 'error' AS severity,
    printf('Sudden drop of %.1f%% at time %.1f-%.1f (from %.1f%% to %.1f%%)', (ps - s) * 100, pt, t, ps * 100, s * 100) AS message,
    pt AS t_lo, t AS t_hi FROM lagged WHERE s - ps < -0.25e0""", "t_lo t_hi")
def q04(spark, sf):
    return q.sudden_drop(twisted(spark, sf))


@query("q05_early_zero", with_(TWISTED) + """SELECT curve_id, 'early_zero' AS issue_type, 'critical' AS severity,
    printf('Curve reaches zero at time %.1f, which is only %.0f%% of the time range', z, z / e * 100) AS message, z AS t_lo, e AS t_hi
    FROM (SELECT curve_id, min(t) FILTER (s - 0.6e0 < 0.01e0) AS z, max(t) AS e FROM twisted GROUP BY 1) WHERE z < e * 0.3e0""", "t_lo t_hi")
def q05(spark, sf):
    return q.early_zero(twisted(spark, sf).withColumn("s", F.col("s") - 0.6))


@query("q06_flat_zero", with_(v.REMAINING) + f"""SELECT curve_id, 'flat_region' AS issue_type, 'critical' AS severity,
    printf('%.0f%% of curve points are at zero', f * 100) AS message, {NN} AS t_lo, {NN} AS t_hi
    FROM (SELECT curve_id % 7 AS curve_id, avg(CASE WHEN s - 0.5e0 < 0.01e0 THEN 1e0 ELSE 0e0 END) AS f FROM remaining GROUP BY 1) WHERE f > 0.3e0""")
def q06(spark, sf):
    p = v.remaining(spark, sf).select((F.col("curve_id") % 7).alias("curve_id"), (F.col("s") - 0.5).alias("s"))
    return q.flat_zero(p, share=0.3)


NEAR_REF = """nearref AS (SELECT curve_id, t, CASE WHEN t < 20 + curve_id % 9 THEN s ELSE 0.5e0 + value / 1e4 * (curve_id % 3) END AS s FROM (
    SELECT user_id AS curve_id, round(event_id * 1e-2, 3) AS t, greatest(0e0, 1e0 - event_id * 5e-5 - value / 1e3) AS s, value FROM events))"""


@query("q07_reference_line", with_(NEAR_REF, LAGGED.format(src="nearref")) + """, g AS (SELECT curve_id, count(*) AS n, max(t) AS e,
    count(*) FILTER (abs(s - 0.5e0) < 0.03e0) AS c0, min(pt) FILTER (abs(s - 0.5e0) < 0.03e0 AND abs(s - ps) > 0.1e0) AS j0,
    count(*) FILTER (abs(s - 0.25e0) < 0.03e0) AS c1, min(pt) FILTER (abs(s - 0.25e0) < 0.03e0 AND abs(s - ps) > 0.1e0) AS j1,
    count(*) FILTER (abs(s - 0.75e0) < 0.03e0) AS c2, min(pt) FILTER (abs(s - 0.75e0) < 0.03e0 AND abs(s - ps) > 0.1e0) AS j2 FROM lagged GROUP BY 1),
    h AS (SELECT *, CASE WHEN c0 > n * 0.3e0 AND j0 IS NOT NULL THEN 0 WHEN c1 > n * 0.3e0 AND j1 IS NOT NULL THEN 1
        WHEN c2 > n * 0.3e0 AND j2 IS NOT NULL THEN 2 END AS k FROM g WHERE n >= 10)
    SELECT curve_id, 'reference_line_contamination' AS issue_type, 'error' AS severity,
    printf('Curve appears to follow %.0f%% reference line after time %.1f', ([50e0, 25e0, 75e0])[k + 1], ([j0, j1, j2])[k + 1]) AS message,
    ([j0, j1, j2])[k + 1] AS t_lo, e AS t_hi FROM h WHERE k IS NOT NULL""", "t_lo t_hi")
def q07(spark, sf):
    e = table(spark, sf, "events")
    s = F.greatest(F.lit(0.0), 1.0 - F.col("event_id") * 5e-5 - F.col("value") / 1e3)
    t = F.round(F.col("event_id") * 1e-2, 3)
    near = F.when(t < 20 + F.col("user_id") % 9, s).otherwise(0.5 + F.col("value") / 1e4 * (F.col("user_id") % 3))
    return q.reference_line(e.select(F.col("user_id").alias("curve_id"), t.alias("t"), near.alias("s")))


@query("q08_non_monotonic", with_(TWISTED, LAGGED.format(src="twisted")) + f"""SELECT curve_id, 'non_monotonic' AS issue_type, 'warning' AS severity,
    'Survival increases ' || n || printf(' times (max increase: %.1f%%)', m * 100) AS message, {NN} AS t_lo, {NN} AS t_hi
    FROM (SELECT curve_id, count(*) FILTER (s - ps > 0.02e0) AS n, max(s - ps) AS m FROM lagged GROUP BY 1) WHERE n > 0""")
def q08(spark, sf):
    return q.non_monotonic(twisted(spark, sf))


ISSUES = """issues AS (SELECT curve_id, 'error' AS sev, 1 AS n FROM twisted WHERE t < 0 GROUP BY 1
    UNION ALL SELECT curve_id, 'error', 1 FROM twisted WHERE s < 0 OR s > 1 GROUP BY 1
    UNION ALL SELECT curve_id, 'error', 1 FROM lagged WHERE s - ps < -0.25e0
    UNION ALL SELECT curve_id, 'critical', 1 FROM (SELECT curve_id, min(t) FILTER (s < 0.01e0) AS z, max(t) AS e FROM twisted GROUP BY 1) WHERE z < e * 0.3e0
    UNION ALL SELECT curve_id, 'critical', 1 FROM (SELECT curve_id, avg(CASE WHEN s < 0.01e0 THEN 1e0 ELSE 0e0 END) AS f FROM twisted GROUP BY 1) WHERE f > 0.5e0
    UNION ALL SELECT curve_id, 'warning', 1 FROM lagged GROUP BY 1 HAVING count(*) FILTER (s - ps > 0.02e0) > 0
    UNION ALL SELECT curve_id, 'error', 1 FROM (SELECT curve_id, count(*) AS n,
        bool_or(abs(s - 0.5e0) < 0.03e0 AND abs(s - ps) > 0.1e0) AND count(*) FILTER (abs(s - 0.5e0) < 0.03e0) > count(*) * 0.3e0 AS a,
        bool_or(abs(s - 0.25e0) < 0.03e0 AND abs(s - ps) > 0.1e0) AND count(*) FILTER (abs(s - 0.25e0) < 0.03e0) > count(*) * 0.3e0 AS b,
        bool_or(abs(s - 0.75e0) < 0.03e0 AND abs(s - ps) > 0.1e0) AND count(*) FILTER (abs(s - 0.75e0) < 0.03e0) > count(*) * 0.3e0 AS c
        FROM lagged GROUP BY 1) WHERE n >= 10 AND (a OR b OR c)
    UNION ALL SELECT c.curve_id, CASE WHEN count(p.t) = 0 THEN 'critical' ELSE 'error' END, 1 FROM curves c LEFT JOIN twisted p USING (curve_id)
        GROUP BY 1 HAVING count(p.t) < 10)"""
SCORED = """scored AS (SELECT curve_id, image_id, critical, error, warning, pow(0.1e0, critical) * pow(0.5e0, error) * pow(0.9e0, warning) AS score,
    critical = 0 AND error = 0 AS passed FROM (SELECT c.curve_id, c.image_id, count(*) FILTER (sev = 'critical') AS critical,
    count(*) FILTER (sev = 'error') AS error, count(*) FILTER (sev = 'warning') AS warning FROM curves c LEFT JOIN issues USING (curve_id) GROUP BY 1, 2))"""
ALL = with_(TWISTED, CURVES, LAGGED.format(src="twisted"), ISSUES, SCORED)


def scored(spark, sf):
    p, c = twisted(spark, sf), curves(spark, sf)
    return q.qc_score(c, q.all_issues(p, curves=c))


@query("q09_qc_score", ALL + "SELECT curve_id, critical, error, warning, score, passed FROM scored", "score", 12)
def q09(spark, sf):
    return scored(spark, sf)


@query("q10_qc_report", ALL + """SELECT image_id, count(*) AS curves, count(*) FILTER (NOT passed) AS failed, avg(score) AS mean_score,
    bool_and(passed) AS passed FROM scored GROUP BY 1""", "mean_score")
def q10(spark, sf):
    return q.qc_report(scored(spark, sf).join(curves(spark, sf), "curve_id"))


@query("q11_curve_quality", with_(TWISTED, CURVES, LAGGED.format(src="twisted")) + """, g AS (SELECT curve_id, min_by(t, struct_pack(t := t, s := s)) AS ft,
    min_by(s, struct_pack(t := t, s := s)) AS fs, count(*) FILTER (s > ps + 0.001e0) AS up, count(*) FILTER (t <= pt) AS st, min(s) AS lo, max(s) AS hi FROM lagged GROUP BY 1)
    SELECT c.curve_id, len(l) = 0 AS is_valid, coalesce(array_to_string(l, '; '), '') AS issues FROM (SELECT c.curve_id, list_filter([
    CASE WHEN ft IS NULL THEN 'No points extracted' END, CASE WHEN abs(ft) > 0.01e0 THEN printf('Does not start at time=0 (starts at t=%.2f)', ft) END,
    CASE WHEN abs(fs - 1) > 0.01e0 THEN printf('Does not start at survival=1.0 (starts at s=%.3f)', fs) END,
    CASE WHEN up > 0 THEN 'Monotonicity violation: ' || up || ' point(s) where survival increases' END,
    CASE WHEN st > 0 THEN 'Time ordering violation: ' || st || ' point(s) with non-increasing time' END,
    CASE WHEN lo < 0 THEN printf('Invalid survival: minimum is %.3f (should be >= 0)', lo) END,
    CASE WHEN hi > 1.001e0 THEN printf('Invalid survival: maximum is %.3f (should be <= 1.0)', hi) END], lambda z: z IS NOT NULL) AS l
    FROM curves c LEFT JOIN g USING (curve_id)) c""")
def q11(spark, sf):
    return q.curve_quality(twisted(spark, sf), curves=curves(spark, sf))


@query("q12_plausible_curve", with_(v.NOISY, LAGGED.format(src="noisy")) + """SELECT curve_id, count(*) >= 10 AND count(*) FILTER (s - ps > 0.01e0) <= (count(*) - 1) * 0.4e0
    AND max(t) >= 50 AND max_by(s, struct_pack(t := t, s := s)) BETWEEN 0.3e0 AND 0.48e0 AS plausible FROM lagged GROUP BY 1""")
def q12(spark, sf):
    return q.plausible_curve(v.noisy(spark, sf), share=0.4, end_range=(0.3, 0.48))


@query("q13_keep_passed", ALL + "SELECT curve_id, t, s FROM twisted WHERE curve_id NOT IN (SELECT curve_id FROM scored WHERE NOT passed)", "t s")
def q13(spark, sf):
    c = curves(spark, sf)
    p = twisted(spark, sf)
    return q.keep_passed(p, q.qc_score(c, q.all_issues(p, curves=c)))


@query("v01_curve_count", """SELECT n.n_nationkey AS image_id, 'Curve Count' AS "check", CASE WHEN k = 0 THEN 'FAIL' WHEN k = 2 THEN 'PASS' ELSE 'WARNING' END AS status,
    CASE WHEN k = 0 THEN 'No curves detected' WHEN k = 1 THEN 'Only 1 curve detected (expected 2 for comparison)' WHEN k = 2 THEN '2 curves detected'
    ELSE k || ' curves detected (expected 2)' END AS message FROM (SELECT n_nationkey, count(DISTINCT s_suppkey) AS k FROM nation LEFT JOIN supplier
    ON s_nationkey = n_nationkey GROUP BY 1) n""")
def v01(spark, sf):
    images = table(spark, sf, "nation").select(F.col("n_nationkey").alias("image_id"))
    sup = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("image_id"), F.col("s_suppkey").alias("curve_id"))
    return q.curve_count(images, sup)


@query("v02_start_point", with_(v.NOISY, CURVES) + """, g AS (SELECT curve_id, min_by(t, struct_pack(t := t, s := s)) AS ft, min_by(s, struct_pack(t := t, s := s)) AS fs FROM noisy GROUP BY 1),
    h AS (SELECT c.curve_id, ft, fs, list_filter([CASE WHEN abs(ft) > 0.01e0 THEN printf('First time=%.3f, should be 0', ft) END,
    CASE WHEN abs(fs - 1) > 0.01e0 THEN printf('First survival=%.3f, should be 1.0', fs) END], lambda z: z IS NOT NULL) AS l FROM curves c LEFT JOIN g USING (curve_id))
    SELECT curve_id, 'Starting Point' AS "check", CASE WHEN ft IS NULL THEN 'FAIL' WHEN len(l) = 0 THEN 'PASS' WHEN abs(fs - 1) < 0.05e0 THEN 'WARNING' ELSE 'FAIL' END AS status,
    CASE WHEN ft IS NULL THEN 'No points in curve' WHEN len(l) > 0 THEN array_to_string(l, '; ') ELSE printf('Starts at (%.2f, %.3f)', ft, fs) END AS message FROM h""")
def v02(spark, sf):
    return q.start_point(v.noisy(spark, sf), curves=curves(spark, sf))


@query("v03_monotonicity", with_(v.NOISY, LAGGED.format(src="noisy")) + """, g AS (SELECT curve_id, count(*) AS n, count(*) FILTER (s > ps + 0.001e0) AS up,
    coalesce(array_to_string(list(printf('Survival increased at t=%.2f: %.3f -> %.3f', t, ps, s) ORDER BY t, s) FILTER (s > ps + 0.001e0)[1:5], '; '), '') AS violations FROM lagged GROUP BY 1)
    SELECT curve_id, 'Monotonicity' AS "check", CASE WHEN n < 2 THEN 'WARNING' WHEN up > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
    CASE WHEN n < 2 THEN 'Not enough points to check' WHEN up > 0 THEN up || ' violation(s)' ELSE 'Monotonically non-increasing' END AS message, violations FROM g""")
def v03(spark, sf):
    return q.monotonicity(v.noisy(spark, sf))


@query("v04_range_bounds", with_(TWISTED, CURVES) + """, h AS (SELECT c.curve_id, a, b, lo, hi, list_filter([CASE WHEN a < -0.01e0 THEN printf('Negative time: %.3f', a) END,
    CASE WHEN lo < -0.01e0 THEN printf('Negative survival: %.3f', lo) END, CASE WHEN hi > 1.01e0 THEN printf('Survival > 1: %.3f', hi) END], lambda z: z IS NOT NULL) AS l
    FROM curves c LEFT JOIN (SELECT curve_id, min(t) AS a, max(t) AS b, min(s) AS lo, max(s) AS hi FROM twisted GROUP BY 1) USING (curve_id))
    SELECT curve_id, 'Range Bounds' AS "check", CASE WHEN a IS NULL THEN 'FAIL' WHEN len(l) > 0 THEN 'WARNING' ELSE 'PASS' END AS status,
    CASE WHEN a IS NULL THEN 'No points' WHEN len(l) > 0 THEN array_to_string(l, '; ') ELSE printf('t:[%.1f,%.1f] s:[%.2f,%.2f]', a, b, lo, hi) END AS message FROM h""")
def v04(spark, sf):
    return q.range_bounds(twisted(spark, sf), curves=curves(spark, sf))


@query("v10_overall_status", """SELECT lang AS scope, count(*) AS checks, CASE WHEN max(r) = 2 THEN 'FAIL' WHEN max(r) = 1 THEN 'WARNING' ELSE 'PASS' END AS status
    FROM (SELECT lang, CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS r FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def v10(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    s = F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 0, "WARNING").otherwise("PASS")
    return q.overall_status(d.select(F.col("lang").alias("scope"), s.alias("status")), "scope")


@query("v11_offset_direction", with_(v.TRACED) + """, o AS (SELECT curve_id, CAST(y - x // 5 AS INTEGER) AS d FROM traced)
    SELECT curve_id, count(*) FILTER (d < -2) / count(d) AS above, count(*) FILTER (abs(d) <= 2) / count(d) AS within, count(*) FILTER (d > 2) / count(d) AS below,
    avg(d) AS mean, stddev_pop(d) AS std, min(d) AS lowest, max(d) AS highest FROM o GROUP BY 1""", "above within below mean std")
def v11(spark, sf):
    d = v.traced(spark, sf).select("curve_id", (F.col("y") - F.expr("x div 5")).cast("int").alias("offset"))
    return q.offset_direction(d)


@query("v12_truth_at_time", with_(v.NOISY) + """SELECT curve_id, a AS at, avg(s) AS mean, avg(s) BETWEEN lo AND hi AS ok FROM noisy
    JOIN (VALUES (12e0, 0.85e0, 0.95e0), (18e0, 0.6e0, 0.9e0)) x(a, lo, hi) ON abs(t - a) <= 2.5e0 GROUP BY curve_id, a, lo, hi""", "mean")
def v12(spark, sf):
    return q.truth_at_time(v.noisy(spark, sf), {12: (0.85, 0.95), 18: (0.6, 0.9)}, half=2.5)
