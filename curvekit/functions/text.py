"""Parsing of model answers, colour words, names and settings. Every answer is one row and is parsed inside the row."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[\d.]+$"


def lines_of(text: Column, markdown: bool = True) -> Column:
    """Trimmed non-empty lines; emphasis, heading and list marks are taken off."""
    if markdown:
        text = F.regexp_replace(F.regexp_replace(text, r"\*+", ""), r"(?m)^#+\s*", "")
    rows = F.filter(F.transform(F.split(text, "\n"), lambda q: F.regexp_replace(q, r"^\s+|\s+$", "")), lambda q: q != "")
    return F.transform(rows, lambda q: F.regexp_replace(q, "^[-*•]\\s*", "")) if markdown else rows


def having(lines: Column, key: str) -> Column:
    """Lines whose start matches `key` (case-insensitive) up to a colon."""
    return F.filter(lines, lambda q: F.rlike(q, F.lit(rf"(?i)^{key}\s*:")))


def value_of(line: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(line, r"(?s)^[^:]*:\s*(.*)$", 1), r"^\s+|\s+$", "")


def last_value(lines: Column, key: str) -> Column:
    return value_of(F.try_element_at(having(lines, key), F.lit(-1)))


def numbers_in(text: Column) -> Column:
    """The blank- or comma-separated parts that consist of digits and points, as numbers (null where unreadable)."""
    return F.transform(F.filter(F.split(text, r"[,\s]+"), lambda q: F.rlike(q, F.lit(NUMBER))), lambda q: q.try_cast("double"))


def loose_numbers(text: Column) -> Column:
    """Numbers of the parts that hold a digit, with everything but digits, points and minus signs removed."""
    parts = F.filter(F.split(text, r"[,\s]+"), lambda q: F.rlike(q, F.lit(r"\d")))
    return F.transform(parts, lambda q: F.regexp_replace(q, r"[^\d.\-]", "").try_cast("double"))


def confidence_of(lines: Column, default: float, failed: float | None = 0.5, key: str = "CONFIDENCE") -> Column:
    """Share in 0..1 from the last confidence line; `failed` is used for one that holds no number (None keeps default)."""
    raw = last_value(lines, key)
    n = F.regexp_replace(F.regexp_replace(raw, r"[%/].*", ""), r"\s+", "").try_cast("double")
    return F.when(raw.isNull(), F.lit(default)).when(n.isNull(), F.lit(default if failed is None else failed)).when(
        n > 1, n / 100).otherwise(n)


def range_of(lines: Column, key: str) -> Column:
    """(low, high) of the last range line with two readable numbers, else null."""
    found = F.filter(F.transform(having(lines, key), lambda q: loose_numbers(value_of(q))),
                     lambda n: (F.size(n) >= 2) & ~F.exists(n, lambda v: v.isNull()))
    last = F.try_element_at(found, F.lit(-1))
    return F.when(last.isNotNull(), F.struct(F.element_at(last, 1).alias("low"), F.element_at(last, 2).alias("high")))


# -- tables ----------------------------------------------------------------------------------------

def _group_line(value: Column) -> Column:
    """Name and counts of `name | 1, 2` or `name 1 2`."""
    piped = F.contains(value, F.lit("|"))
    parts = F.filter(F.transform(F.split(value, r"\s+"), lambda q: F.rtrim(q, F.lit(","))), lambda q: q != "")
    first = F.array_position(F.transform(parts, lambda q: F.rlike(q, F.lit(NUMBER))), F.lit(True))
    words = F.when(first > 0, F.slice(parts, F.lit(1), (first - 1).cast("int"))).otherwise(parts)
    name = F.when(piped, F.trim(F.substring_index(value, "|", 1))).otherwise(F.array_join(words, " "))
    counts = F.when(piped, numbers_in(F.regexp_replace(F.regexp_extract(value, r"(?s)\|(.*)$", 1), r"^\s+|\s+$", ""))).otherwise(
        F.transform(F.filter(parts, lambda q: F.rlike(q, F.lit(NUMBER))), lambda q: q.try_cast("double")))
    ok = (name != "") & (F.size(counts) > 0) & ~F.exists(counts, lambda v: v.isNull())
    return F.when(ok, F.struct(name.alias("grp"), F.transform(counts, lambda v: v.try_cast("bigint")).alias("counts")))


def parse_table_response(responses: DataFrame, image="image_id", text="text", default_step: float | None = 3.0) -> DataFrame:
    """Cells (image, grp, t, n, confidence) of table answers.

    A group takes the time line before it; a repeated group replaces the earlier one. Answers without any time line
    get times 0, default_step, ...; with None their groups stay without cells.
    """
    rows = responses.select(image, lines_of(F.col(text)).alias("_l"))
    marked = F.transform("_l", lambda q, i: F.struct(i.alias("i"), q.alias("q")))
    is_time = lambda s: F.rlike(s["q"], F.lit(r"(?i)^TIME[-_\s]*POINTS?\s*:"))
    rows = rows.select(image, confidence_of(F.col("_l"), 0.0).alias("confidence"),
                       F.transform(F.filter(marked, is_time), lambda s: F.struct(s["i"].alias("i"), numbers_in(value_of(s["q"])).alias("times"))).alias("_t"),
                       F.filter(F.transform(F.filter(marked, lambda s: F.rlike(s["q"], F.lit(r"(?i)^GROUP\s*:"))),
                                            lambda s: F.struct(s["i"].alias("i"), _group_line(value_of(s["q"])).alias("g"))),
                                lambda s: s["g"].isNotNull()).alias("_g"))
    kept = F.filter("_g", lambda s: ~F.exists("_g", lambda o: (o["g"]["grp"] == s["g"]["grp"]) & (o["i"] > s["i"])))
    times = F.try_element_at(F.filter("_t", lambda t: t["i"] < F.col("_s.i")), F.lit(-1))["times"]
    rows = rows.select(image, "confidence", "_t", F.explode(kept).alias("_s"))
    rows = rows.select(image, "confidence", F.col("_s.g.grp").alias("grp"), times.alias("_times"), F.size("_t").alias("_nt"), F.posexplode("_s.g.counts").alias("pos", "n"))
    t = F.get("_times", F.col("pos"))
    if default_step is not None:
        t = F.when(F.col("_nt") == 0, F.col("pos") * F.lit(float(default_step))).otherwise(t)
    return rows.withColumn("t", t).where(F.col("t").isNotNull()).select(image, "grp", "t", "n", "confidence")


def parse_curve_list_response(responses, image="image_id", text="text") -> DataFrame:
    """Listed curve descriptions with the ranges and the confidence of the answer."""
    rows = responses.select(image, lines_of(F.col(text)).alias("_l"))
    pattern = r"(?is)^CURVE[-_]?\d+\s*:\s*(.+)"
    names = F.transform(F.filter("_l", lambda q: F.rlike(q, F.lit(pattern))),
                        lambda q: F.regexp_replace(F.trim(F.regexp_extract(q, pattern, 1)), r"\s*\([^)]*\)\s*$", ""))
    x, y = range_of(F.col("_l"), "X[-_]?RANGE"), range_of(F.col("_l"), "Y[-_]?RANGE")
    percent = F.exists(having(F.col("_l"), "Y[-_]?SCALE"), lambda q: F.contains(F.lower(value_of(q)), F.lit("percent")))
    rows = rows.select(image, names.alias("_n"), x.alias("_x"), y.alias("_y"), percent.alias("percent"), confidence_of(F.col("_l"), 0.5, None).alias("confidence"))
    return rows.select(image, F.posexplode_outer("_n").alias("pos", "description"), F.coalesce("_x.low", F.lit(0.0)).alias("x_low"), F.coalesce("_x.high", F.lit(24.0)).alias("x_high"),
                       F.coalesce("_y.low", F.lit(0.0)).alias("y_low"), F.coalesce("_y.high", F.lit(1.0)).alias("y_high"), "percent", "confidence")


def _point_answers(responses, image, text) -> DataFrame:
    """Answers (image, name, confidence) with the list `_found` of their readable points."""
    rows = responses.select(image, lines_of(F.col(text)).alias("_l"))

    def point(line, pos):
        parts = F.when(F.contains(line, F.lit("|")), F.split(line, r"\|")).otherwise(F.split(line, ","))
        t = F.regexp_extract(F.element_at(parts, 1), r"(?i)TIME\s*:\s*([\d.]+)", 1).try_cast("double")
        s = F.regexp_extract(F.try_element_at(parts, F.lit(2)), r"(?i)SURVIVAL\s*:\s*([\d.]+)", 1).try_cast("double")
        return F.struct(pos.alias("pos"), t.alias("t"), s.alias("s"))

    found = F.filter(F.transform(having(F.col("_l"), "TIME"), point), lambda q: q["t"].isNotNull() & q["s"].isNotNull())
    return rows.select(image, F.coalesce(last_value(F.col("_l"), "CURVE"), F.lit("")).alias("name"), confidence_of(F.col("_l"), 0.5, None).alias("confidence"), found.alias("_found"))


def parse_points_response(responses, image="image_id", text="text") -> DataFrame:
    """Points of `TIME: t | SURVIVAL: s` lines; values above 1.5 are percentages."""
    # an outer explode: Spark's test for empty lists would read every answer a second time
    rows = _point_answers(responses, image, text).select(image, "name", "confidence", F.explode_outer("_found").alias("_p")).where("_p is not null")
    s = F.col("_p.s")
    return rows.select(image, "name", "_p.pos", "_p.t", F.when(s > 1.5, s / 100).otherwise(s).alias("s"), "confidence")


def parse_axis_response(responses, image="image_id", text="text") -> DataFrame:
    rows = responses.select(image, lines_of(F.col(text)).alias("_l"))
    x, y = range_of(F.col("_l"), "X[-_]?RANGE"), range_of(F.col("_l"), "Y[-_]?RANGE")
    count = F.regexp_extract(last_value(F.col("_l"), "CURVES?"), r"(\d+)", 1).try_cast("int")
    rows = rows.select(image, last_value(F.col("_l"), "X[-_]?LABEL").alias("x_label"), x.alias("_x"), last_value(F.col("_l"), "Y[-_]?LABEL").alias("y_label"), y.alias("_y"),
                       count.alias("curve_count"), confidence_of(F.col("_l"), 0.0).alias("confidence"))
    return rows.select(image, "x_label", F.col("_x.low").alias("x_low"), F.col("_x.high").alias("x_high"), "y_label", F.col("_y.low").alias("y_low"), F.col("_y.high").alias("y_high"),
                       "curve_count", "confidence", (F.col("_x").isNotNull() & F.col("_y").isNotNull() & (F.col("confidence") >= 0.5)).alias("is_valid"))


def _listed(value: Column) -> Column:
    """Comma-separated entries; `none` or nothing gives the single entry None."""
    items = F.filter(F.transform(F.split(value, ","), lambda q: F.trim(q)), lambda q: q != "")
    return F.when(value.isNull() | (F.lower(value) == "none") | (F.size(items) == 0), F.array(F.lit("None"))).otherwise(items)


def parse_verdict_response(responses, image="image_id", text="text") -> DataFrame:
    rows = responses.select(image, lines_of(F.col(text), markdown=False).alias("_l"))
    m = F.upper(last_value(F.col("_l"), "MATCH"))
    match = F.when(F.contains(m, F.lit("YES")), "YES").when(F.contains(m, F.lit("NO")), "NO").otherwise("PARTIAL")
    rows = rows.select(image, match.alias("match"), confidence_of(F.col("_l"), 0.5).alias("confidence"),
                       _listed(last_value(F.col("_l"), "ISSUES")).alias("issues"), _listed(last_value(F.col("_l"), "SUGGESTIONS")).alias("suggestions"))
    sure = F.col("confidence") >= 0.7
    return rows.select("*", ((F.col("match") == "YES") | ((F.col("match") == "PARTIAL") & sure)).alias("is_valid"),
                       ((F.col("match") == "NO") | ((F.col("match") == "PARTIAL") & ~sure)).alias("needs_retry"))


# -- assessments -----------------------------------------------------------------------------------

def parse_plot_area_assessment(responses, image="image_id", text="text") -> DataFrame:
    up = F.upper(F.col(text))
    lines = F.split(up, "\n")
    x = F.exists(lines, lambda q: F.rlike(q, F.lit("X[_ ]AXIS")) & F.contains(q, F.lit("YES")))
    y = F.exists(lines, lambda q: ~F.rlike(q, F.lit("X[_ ]AXIS")) & F.rlike(q, F.lit("Y[_ ]AXIS")) & F.contains(q, F.lit("YES")))
    wrong = F.exists(lines, lambda q: ~F.rlike(q, F.lit("[XY][_ ]AXIS")) & F.contains(q, F.lit("CORRECT")) & F.contains(q, F.lit("NO")))
    formal = F.rlike(up, F.lit("X_AXIS|Y_AXIS|CORRECT"))
    talk = ~formal & F.rlike(F.lower(F.col(text)), F.lit("numbers at bottom|numbers on left|see numbers|axis label"))
    failed = F.startswith(F.col(text), F.lit("Error:"))
    return responses.select(image, F.when(failed, False).otherwise(~(x | y | wrong | talk)).alias("acceptable"),
                            F.when(failed, 0.0).when(formal, 0.8).otherwise(0.5).alias("confidence"),
                            (~failed & x).alias("adjust_bottom"), (~failed & y).alias("adjust_left"), (~failed & talk).alias("adjust_bounds"))


# Words that speak for and against an extraction (the issue texts further down are fixed as well).
POSITIVE = ["complete", "all curves", "fully visible", "clean", "no text", "removed", "acceptable", "good"]
NEGATIVE = ["gap", "missing", "incomplete", "text visible", "annotation", "box", "artifact", "not removed"]


def _keyed(text: Column) -> Column:
    """Lines with a colon as (key, value); the key upper-case with blanks for _ and -."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda q: F.trim(q)), lambda q: F.contains(q, F.lit(":")))
    return F.transform(rows, lambda q: F.struct(F.translate(F.upper(F.trim(F.substring_index(q, ":", 1))), "_-", "  ").alias("k"), value_of(q).alias("v")))


def parse_extraction_assessment(responses, image="image_id", text="text") -> DataFrame:
    """Issues, verdict and confidence of a checklist answer, or of its wording when it holds no checklist."""
    has = lambda c, w: F.contains(c, F.lit(w))
    none = lambda v: F.lower(v).isin("none", "n/a", "no issues", "")

    def kind(s):
        k = s["k"]
        return (F.when(has(k, "CURVES") & has(k, "COMPLETE"), "curves_done").when(has(k, "CURVES") & has(k, "ISSUE"), "curve_issue")
                .when(has(k, "TEXT") & has(k, "REMOVED"), "text_done").when(has(k, "TEXT") & has(k, "ISSUE"), "text_issue")
                .when(has(k, "ARTIFACT") & has(k, "REMOVED"), "artifact_done").when(has(k, "ARTIFACT") & has(k, "ISSUE"), "artifact_issue")
                .when(has(k, "OVERALL") | has(k, "ACCEPTABLE"), "overall").when(has(k, "CONFIDENCE"), "confidence").when(has(k, "SUGGESTION"), "suggestion"))

    rows = responses.select(image, F.lower(F.col(text)).alias("_low"), F.transform(_keyed(F.col(text)), lambda s: F.struct(kind(s).alias("c"), s["v"].alias("v"))).alias("_k"))

    def issue(s):
        v, no = s["v"], F.contains(F.upper(s["v"]), F.lit("NO"))
        tell = lambda name, label: F.when((s["c"] == name) & ~none(v), F.concat(F.lit(label), v))
        return F.coalesce(F.when((s["c"] == "curves_done") & (no | F.contains(F.upper(v), F.lit("INCOMPLETE"))), "Curves incomplete"),
                          tell("curve_issue", "Curve issue: "), F.when((s["c"] == "text_done") & no, "Text not fully removed"), tell("text_issue", "Text issue: "),
                          F.when((s["c"] == "artifact_done") & no, "Artifacts remain"), tell("artifact_issue", "Artifact issue: "))

    of = lambda name: F.filter("_k", lambda s: s["c"] == name)
    overall = F.try_element_at(of("overall"), F.lit(-1))["v"]
    nums = F.filter(F.transform(of("confidence"), lambda s: F.regexp_extract(s["v"], r"([\d.]+)", 1).try_cast("double")), lambda n: n.isNotNull())
    conf = F.try_element_at(nums, F.lit(-1))
    conf = F.when(conf.isNull(), 0.0).otherwise(F.least(F.when(conf > 1, conf / 100).otherwise(conf), F.lit(1.0)))
    rows = rows.select(image, "_low", F.array_compact(F.transform("_k", issue)).alias("_i"), F.coalesce(F.contains(F.upper(overall), F.lit("YES")), F.lit(False)).alias("_ok"), conf.alias("_c"))
    count = lambda words: reduce(lambda p, q: p + q, [F.contains("_low", F.lit(w)).cast("int") for w in words])
    plain = (F.col("_c") == 0) & (F.size("_i") == 0)
    good = count(POSITIVE) > count(NEGATIVE)
    guess = F.array_compact(F.array(F.when(F.rlike("_low", F.lit("gap|missing")), F.lit("Possible curve gaps detected")),
                                    F.when(F.rlike("_low", F.lit("text|annotation|box")), F.lit("Possible text/annotation remaining"))))
    issues = F.when(plain & ~good, guess).otherwise(F.col("_i"))
    return rows.select(image, F.when(plain, good).otherwise(F.col("_ok")).alias("acceptable"),
                       F.when(plain & good, 0.6 + 0.1 * count(POSITIVE)).when(plain, 0.3).otherwise(F.col("_c")).alias("confidence"), F.array_join(issues, "; ").alias("issues"))


def parse_curve_count(responses, image="image_id", text="text") -> DataFrame:
    rows = responses.select(image, F.col(text).alias("_t"), F.filter(F.transform(F.split(F.col(text), "\n"), lambda q: F.trim(q)), lambda q: F.contains(q, F.lit(":"))).alias("_l"))
    key = lambda q: F.upper(F.substring_index(q, ":", 1))
    counts = F.filter(F.transform(F.filter("_l", lambda q: F.rlike(key(q), F.lit("CURVES|COUNT"))), lambda q: F.regexp_extract(value_of(q), r"(\d+)", 1).try_cast("int")), lambda n: n.isNotNull())
    colors = F.try_element_at(F.filter("_l", lambda q: F.contains(key(q), F.lit("COLOR")) & ~F.rlike(key(q), F.lit("CURVES|COUNT"))), F.lit(-1))
    worded = F.regexp_extract(F.lower("_t"), r"(\d+)\s*(?:curve|line|survival)", 1).try_cast("int")
    single = F.try_element_at(F.filter(F.transform(F.regexp_extract_all("_t", F.lit(r"\b(\d)\b"), F.lit(1)), lambda q: q.cast("int")), lambda n: n.between(1, 10)), F.lit(1))
    n = F.coalesce(F.try_element_at(counts, F.lit(-1)), F.when(worded.isNotNull(), F.when(worded.between(1, 10), worded)).otherwise(single))
    return rows.select(image, n.alias("curve_count"), F.lower(value_of(colors)).alias("colors"), F.when(n.isNotNull(), 0.8).otherwise(0.3).alias("confidence"))


def parse_completeness(responses, image="image_id", text="text") -> DataFrame:
    rows = responses.select(image, F.filter(F.transform(F.split(F.col(text), "\n"), lambda q: F.trim(q)), lambda q: F.contains(q, F.lit(":"))).alias("_l"))
    key = lambda q: F.upper(F.substring_index(q, ":", 1))
    found = F.filter(F.transform(F.filter("_l", lambda q: F.contains(key(q), F.lit("FOUND"))), lambda q: F.regexp_extract(value_of(q), r"(\d+)", 1).try_cast("int")), lambda n: n.isNotNull())
    partial = F.exists("_l", lambda q: ~F.contains(key(q), F.lit("FOUND")) & F.contains(key(q), F.lit("COMPLETE")) & F.contains(F.upper(value_of(q)), F.lit("NO")))
    lost = F.filter("_l", lambda q: ~F.rlike(key(q), F.lit("FOUND|COMPLETE")) & F.contains(key(q), F.lit("MISSING")) & ~F.lower(value_of(q)).isin("none", "n/a", "no", ""))
    return rows.select(image, F.try_element_at(found, F.lit(-1)).alias("found"), (~partial & (F.size(lost) == 0)).alias("acceptable"), value_of(F.try_element_at(lost, F.lit(-1))).alias("missing"))


def parse_text_regions(responses, image="image_id", text="text") -> DataFrame:
    """Text regions listed as `TEXT_REGION: place - "content" - overlaps ...`."""
    rows = responses.select(image, F.posexplode(F.filter(F.split(F.col(text), "\n"), lambda q: F.startswith(F.trim(q), F.lit("TEXT_REGION:")))).alias("pos", "_q"))
    parts = F.split("_q", "-")
    low = F.lower("_q")
    return rows.where(F.size(parts) >= 2).select(image, "pos", F.trim(F.replace(F.element_at(parts, 1), F.lit("TEXT_REGION:"), F.lit(""))).alias("location"),
                                                 F.regexp_replace(F.trim(F.element_at(parts, 2)), '^"+|"+$', "").alias("content"),
                                                 (F.contains(low, F.lit("yes")) & F.contains(low, F.lit("overlaps"))).alias("overlaps_curve"))


def parse_removal_verdict(responses, image="image_id", text="text") -> DataFrame:
    rows = responses.select(image, F.transform(F.split(F.col(text), "\n"), lambda q: F.trim(q)).alias("_l"))
    tail = lambda name: F.coalesce(F.trim(F.regexp_extract(F.try_element_at(F.filter("_l", lambda q: F.startswith(q, F.lit(name + ":"))), F.lit(-1)), r"^[^:]*:(.*)$", 1)), F.lit("UNKNOWN"))
    bullets = F.filter("_l", lambda q: F.startswith(q, F.lit("ISSUES:")) | F.startswith(q, F.lit("-")))
    issues = F.filter(F.transform(bullets, lambda q: F.trim(F.replace(F.replace(q, F.lit("ISSUES:"), F.lit("")), F.lit("-"), F.lit("")))), lambda q: q != "")
    rows = rows.select(image, tail("TEXT_REMOVED").alias("text_removed"), tail("CURVES_INTACT").alias("curves_intact"), tail("OVERALL").alias("overall"), F.array_join(issues, "; ").alias("issues"))
    return rows.select("*", ((F.upper("overall") == "PASS") | (F.upper("text_removed").isin("COMPLETE", "PARTIAL") & F.upper("curves_intact").isin("YES", "PARTIAL"))).alias("success"))


def parse_waypoints(responses, image="image_id", text="text") -> DataFrame:
    """Points of `t = .. survival = ..` lines; values above 1 are percentages, all clamped to 0..1."""
    pattern = r"(?i)t\s*=\s*([\d.]+).*?survival\s*=\s*([\d.]+)"
    rows = responses.select(image, F.posexplode(F.filter(F.split(F.col(text), "\n"), lambda q: F.rlike(q, F.lit(pattern)))).alias("pos", "_q"))
    s = F.regexp_extract("_q", pattern, 2).try_cast("double")
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(s > 1, s / 100).otherwise(s)))
    return rows.select(image, "pos", F.regexp_extract("_q", pattern, 1).try_cast("double").alias("t"), s.alias("s")).where("t is not null and s is not null")


def low_coverage(points: DataFrame, t_max: float, key="image_id", t="t", share=0.8) -> DataFrame:
    """Keys whose last time covers less than `share` of the time range."""
    return points.groupBy(key).agg(F.max(t).alias("_e")).where(F.col("_e") / t_max < share).select(key)


def model_points_to_curves(responses, image="image_id", curve="curve", text="text") -> DataFrame:
    """Points of curve answers sorted, anchored at (0, 1) and made non-increasing, with the image's mean confidence."""
    from ..operators.clean import _anchored
    from ..ordered import Ordered
    named = responses.withColumn("_id", F.struct(image, curve))
    own = [F.col(f"_id.{image}").alias(image), F.col(f"_id.{curve}").alias(curve)]
    p = parse_points_response(named, "_id", text).select(*own, "t", "s")
    # the confidence is read once per answer that has points, not once per point
    sure = _point_answers(named, "_id", text).where(F.size("_found") > 0).select(*own, "confidence")
    mean = sure.groupBy(image, curve).agg(F.max("confidence").alias("_c")).groupBy(image).agg(F.avg("_c").alias("mean_confidence"))
    o = _anchored(Ordered(p.select(image, curve, "t", "s"), [image, curve], "t", "s"), "t", "s", 0.01, -1.0)
    o = o.running(_m=("min", "s")).with_columns(s=F.least(F.lit(1.0), F.col("_m")))
    from ..runtime import attach
    return attach(o.df.select(image, curve, "t", "s"), mean, [image])


# -- words, names, settings ------------------------------------------------------------------------

# Colour words in the order in which they are looked for, then their other names.
COLOR_WORDS = ["red", "orange", "yellow", "green", "cyan", "blue", "purple", "magenta", "black", "gray", "white"]
COLOR_ALIASES = {"grey": "gray", "dark": "black", "light blue": "cyan", "teal": "cyan", "aqua": "cyan", "pink": "magenta",
                 "lime": "green", "navy": "blue", "maroon": "red", "olive": "green"}
COLOR_GROUPS = {"dark": ["black", "gray", "dark"], "red": ["red", "maroon"], "green": ["green", "lime"], "blue": ["blue", "navy"],
                "cyan": ["cyan", "teal", "aqua"]}


def color_of(text: Column) -> Column:
    low = F.lower(text)
    out = F
    for word, name in [(w, w) for w in COLOR_WORDS] + list(COLOR_ALIASES.items()):
        out = out.when(F.contains(low, F.lit(word)), F.lit(name))
    return out.otherwise("unknown")


def style_of(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("dash")), "dashed").when(F.contains(low, F.lit("dot")), "dotted").otherwise("solid")


def color_group(color: Column) -> Column:
    out = F
    for name, members in COLOR_GROUPS.items():
        out = out.when(color.isin(*members), F.lit(name))
    return out.otherwise(color)


def dedup_by_color_group(curves: DataFrame, image="image_id", color="color", order="pos") -> DataFrame:
    """The first curve of each colour family per image."""
    rows = curves.withColumn("color_group", color_group(F.col(color)))
    rest = [c for c in rows.columns if c not in (image, "color_group", order)]
    first = rows.groupBy(image, "color_group").agg(F.min(F.struct(order, *rest)).alias("_f"))
    return first.select(image, "color_group", "_f.*")


def safe_name(name: Column) -> Column:
    """Everything but letters, digits, blanks, _ and - becomes _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N} _\-]", "_")


def adjust_params(params: DataFrame, suggestions="suggestions") -> DataFrame:
    """Settings changed by each suggestion in turn; a step is clamped at once, so the order counts."""
    has = lambda s, *words: reduce(lambda a, b: a | b, [F.contains(F.lower(s), F.lit(w)) for w in words])
    start = F.struct(F.col("saturation_min").alias("a"), F.col("hue_tolerance").alias("b"), F.col("overlap_threshold").alias("c"))

    def step(p, s):
        # Words, steps and bounds of the settings.
        a = F.when(has(s, "saturation") & has(s, "lower", "decrease"), F.greatest(F.lit(5), p["a"] - 5)).when(
            has(s, "saturation") & has(s, "higher", "increase"), F.least(F.lit(50), p["a"] + 5)).otherwise(p["a"])
        hue = has(s, "color") & has(s, "tolerance")
        b = F.when(hue & has(s, "wider", "increase"), F.least(F.lit(30), p["b"] + 5)).when(
            hue & has(s, "narrower", "decrease"), F.greatest(F.lit(5), p["b"] - 5)).otherwise(p["b"])
        c = F.when(has(s, "overlap") & has(s, "stricter", "decrease"), F.greatest(F.lit(1), p["c"] - 1)).when(
            has(s, "overlap") & has(s, "looser", "increase"), F.least(F.lit(10), p["c"] + 1)).otherwise(p["c"])
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))

    rows = params.withColumn("_p", F.aggregate(suggestions, start, step))
    return rows.withColumns({"saturation_min": F.col("_p.a"), "hue_tolerance": F.col("_p.b"), "overlap_threshold": F.col("_p.c")}).drop("_p")


def adjust_extraction(params: DataFrame, issues="issues") -> DataFrame:
    """The second rule set: one change per kind of issue found in the joined issue texts."""
    says = lambda *words: reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(issues)), F.lit(w)) for w in words])
    text, gaps, shapes = says("text", "annotation", "box"), says("incomplete", "gap", "missing"), says("artifact", "rectangle")
    move = lambda cond, c, by, low=None, high=None: F.when(cond, F.least(F.col(c) + by, F.lit(high)) if high is not None else F.greatest(F.col(c) + by, F.lit(low))).otherwise(F.col(c))
    # Steps and bounds of the settings.
    return params.withColumns({
        "box_margin": move(text, "box_margin", 5, high=30), "box_min_area": move(text, "box_min_area", -30, low=50), "light_threshold": move(text, "light_threshold", 10, high=240),
        "black_threshold": move(gaps, "black_threshold", 20, high=150), "min_component_area": move(gaps, "min_component_area", -1, low=1),
        "rect_min_area": move(shapes, "rect_min_area", -100, low=100), "rect_max_height": move(shapes, "rect_max_height", 10, high=60)})
