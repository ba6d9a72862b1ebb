"""Text reports as ordered line tables: a heading per picture, a section per curve, and an end. `files.write_lines` writes them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import as_list, attach, cut_lineage
from .quality import num, pct

ORDER = ["part", "curve", "section", "at", "text", "no"]
TOP = 5

# Rules in the order in which a report lists them, and the advice each gives.
ADVICE = [("too_few_points", "Increase image resolution or check detection"), ("negative_time", "Check axis calibration"), ("survival_out_of_range", "Check Y-axis calibration"),
          ("sudden_drop", "May be picking up reference line or wrong curve segment"), ("early_zero", "Curve may be following the X-axis instead of actual data"),
          ("flat_region", "Curve may be following the X-axis or bottom of plot"), ("reference_line_contamination", "May be picking up the dashed %s reference line"),
          ("non_monotonic", "May indicate noise or detection errors")]
NO_POINTS = "Check curve detection settings"
# Names of the sides of the picture's curve.
ABOVE, BELOW = "extracted above", "extracted below"
ICONS = {"warning": "⚠", "error": "✗", "critical": "✗✗"}


def _lines(rows: DataFrame, images: list[str], part: int, curve: Column, section: int, at: Column, text: Column, lines: list[Column]) -> DataFrame:
    """`lines` of each row one below the other, null ones left out."""
    return rows.select(*images, F.lit(part).alias("part"), curve.cast("string").alias("curve"), F.lit(section).alias("section"), at.cast("double").alias("at"),
                       text.alias("text"), F.posexplode(F.array_compact(F.array(*lines))).alias("no", "line"))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_report(scored: DataFrame, issues: DataFrame, image="image_id", key="curve_id") -> DataFrame:
    """Report of `quality.qc_score` and its issues: each curve with its score, its issues by rule and time with advice, and an overall line.

    scored: image, curve, score, passed; issues: curve and the issue columns. A curve may have any number of issues; each is rows of its own, never a list.
    """
    images, rule, none = as_list(image), F.col("issue_type"), F.lit(None)
    place = F.coalesce(*[F.when(rule == k, i) for i, (k, _) in enumerate(ADVICE)], F.lit(len(ADVICE)))
    line = F.concat(F.regexp_extract("message", "follow (\\d+%) reference", 1))
    advice = F.when((rule == "too_few_points") & (F.col("severity") == "critical"), NO_POINTS)
    for k, text in ADVICE:
        advice = advice.when(rule == k, F.replace(F.lit(text), F.lit("%s"), line))
    icon = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in ICONS.items()], F.lit("?"))
    owned = issues.join(scored.select(*images, key), key)
    bad = F.concat(F.lit("  "), icon, F.lit(" ["), F.upper("severity"), F.lit("] "), F.col("message"))
    whole = scored.groupBy(*images).agg(F.bool_and("passed").alias("_ok"))
    state = F.when(F.col("passed"), "PASSED").otherwise("FAILED")
    told = owned.select(*images, F.lit(1).alias("part"), F.col(key).cast("string").alias("curve"), (place + 1).alias("section"), F.col("t_lo").alias("at"), F.col("message").alias("text"),
                        F.posexplode(F.array_compact(F.array(bad, F.concat(F.lit("      → "), advice)))).alias("no", "line"))
    return _together([
        _lines(whole, images, 0, none, 0, none, F.lit(""), [F.lit("QUALITY CONTROL REPORT"), F.lit("=" * 50)]),
        _lines(scored, images, 1, F.col(key), 0, none, F.lit(""), [F.concat(F.col(key).cast("string"), F.lit(": "), state, F.lit(" (score: "), pct(F.col("score")), F.lit(")"))]),
        told,
        _lines(whole, images, 2, none, 0, none, F.lit(""), [F.concat(F.lit("Overall: "), F.when(F.col("_ok"), "ALL PASSED").otherwise("ISSUES DETECTED"))])])


def dense_report(match: dict[str, DataFrame], original: DataFrame | None = None, image="image_id", key="curve_id") -> DataFrame:
    """Report of `checks.dense_match`: overall accuracy, and for each curve its matches, offsets, steps, first missing steps and largest offsets.

    original: image, curve and `seen`, the steps counted in the picture; without it they are the steps of the curve. Each part of the match is worked out once:
    it gives lines of several kinds, and lines are read twice to be put in order.
    """
    images, none = as_list(image), F.lit(None)
    match = {name: cut_lineage(part) for name, part in match.items()}
    keys = [*images, key]
    st = match["summary"].withColumn("_seen", F.col("steps"))
    if original is not None:
        st = attach(st.drop("_seen"), original.select(*keys, F.col("seen").alias("_seen")), keys)
    missing = match["missing_steps"]
    st = attach(st, missing.groupBy(*keys).agg(F.count("*").alias("_gaps")), keys)
    whole = st.groupBy(*images).agg(F.coalesce(F.try_divide(F.sum("matched"), F.sum("total")), F.lit(0.0)).alias("_all"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    first = missing.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("t_from", "t_to", "gap"))).where(F.col("_r") <= TOP)
    far = match["offset_regions"].where(F.col("rank") <= TOP)
    title = [F.lit("=" * 60), F.lit("DENSE VALIDATION REPORT"), F.lit("=" * 60), said("Overall Accuracy: ", pct(F.col("_all"), 1))]
    body = [said("--- ", F.col(key), " ---"), said("  Points matched: ", F.col("matched"), "/", F.col("total"), " (", pct(F.coalesce("match_rate", F.lit(0.0)), 1), ")"),
            said("  Average Y-offset: ", num(F.col("avg_offset"), 2), " pixels"), said("  Max Y-offset: ", num(F.col("max_offset"), 2), " pixels"),
            said("  Steps detected: ", F.col("steps")), said("  Steps in original: ", F.coalesce("_seen", F.lit(0))), said("  Missing step regions: ", F.col("_gaps"))]
    gap = said("    - t=", num(F.col("t_from")), " to t=", num(F.col("t_to")), " (gap of ", num(F.col("gap"), 3), ")")
    off = said("    - t=", num(F.col("t")), ": offset=", num(F.col("offset")), "px (", F.when(F.col("offset") < 0, ABOVE).otherwise(BELOW), ")")
    return _together([
        _lines(whole, images, 0, none, 0, none, F.lit(""), title),
        _lines(st, images, 1, F.col(key), 0, none, F.lit(""), body),
        _lines(first, images, 1, F.col(key), 1, F.col("_r"), F.lit(""), [gap]),
        _lines(far.select(*keys).distinct(), images, 1, F.col(key), 2, none, F.lit(""), [F.lit("  Significant offset regions:")]),
        _lines(far, images, 1, F.col(key), 2, F.col("rank"), F.lit(""), [off]),
        _lines(whole, images, 2, none, 0, none, F.lit(""), [F.lit("=" * 60)])])
