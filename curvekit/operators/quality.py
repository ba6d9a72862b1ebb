"""Quality rules over curves: issue rows per curve, scores, and named checks with a status."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordered import Ordered, top_rows
from ..runtime import as_list, attach

ISSUE_COLS = ["issue_type", "severity", "message", "t_lo", "t_hi"]


def num(c: Column, digits: int = 1) -> Column:
    """Fixed decimals, rounded half-even on the exact binary value (Java's %f rounds the shortest decimal up)."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def pct(c: Column, digits: int = 0) -> Column:
    return F.concat(num(c * 100, digits), F.lit("%"))


def issue(keys, kind: str, severity: str, message: Column, lo=None, hi=None) -> list:
    return [*keys, F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), message.alias("message"),
            F.lit(lo).cast("double").alias("t_lo"), F.lit(hi).cast("double").alias("t_hi")]


def _curves_with(points, curves, keys, **aggs):
    stats = points.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return stats if curves is None else attach(curves.select(*keys).distinct(), stats, keys)


def min_points(points, key="curve_id", curves=None, least=10) -> DataFrame:
    """Curves with fewer rows than `least`; a curve of `curves` without any row is critical."""
    keys = as_list(key)
    n = F.coalesce(F.col("n"), F.lit(0))
    few = _curves_with(points, curves, keys, n=F.count("*")).where(n < least)
    message = F.when(n == 0, F.lit("No data points in curve")).otherwise(
        F.concat(F.lit("Only "), n.cast("string"), F.lit(f" points (minimum: {least})")))
    return few.select(*keys, F.lit("too_few_points").alias("issue_type"),
                      F.when(n == 0, "critical").otherwise("error").alias("severity"), message.alias("message"),
                      F.lit(None).cast("double").alias("t_lo"), F.lit(None).cast("double").alias("t_hi"))


def negative_time(points, key="curve_id", t="t") -> DataFrame:
    keys = as_list(key)
    bad = points.where(F.col(t) < 0).groupBy(*keys).agg(F.count("*").alias("n"), F.min(t).alias("a"), F.max(t).alias("b"))
    return bad.select(*issue(keys, "negative_time", "error", F.concat(
        F.lit("Found "), F.col("n").cast("string"), F.lit(" points with negative time")), F.col("a"), F.col("b")))


def value_range(points, key="curve_id", s="s") -> DataFrame:
    keys = as_list(key)
    bad = points.where((F.col(s) < 0) | (F.col(s) > 1)).groupBy(*keys).agg(F.count("*").alias("n"))
    return bad.select(*issue(keys, "survival_out_of_range", "error", F.concat(
        F.lit("Found "), F.col("n").cast("string"), F.lit(" points with survival outside [0,1]"))))


def sudden_drop(points, key="curve_id", t="t", s="s", most=0.25) -> DataFrame:
    """One issue per drop between neighbours above `most`."""
    keys = as_list(key)
    o = Ordered(points.select(*keys, F.col(t).alias("t"), F.col(s).alias("s")), keys, "t", "s").lag(_t="t", _s="s")
    return _drops(o.df, keys, most)


def _drops(rows, keys, most) -> DataFrame:
    text = F.concat(F.lit("Sudden drop of "), pct(F.col("_s") - F.col("s"), 1), F.lit(" at time "), num(F.col("_t")), F.lit("-"),
                    num(F.col("t")), F.lit(" (from "), pct(F.col("_s"), 1), F.lit(" to "), pct(F.col("s"), 1), F.lit(")"))
    return rows.where(F.col("s") - F.col("_s") < -most).select(*issue(keys, "sudden_drop", "error", text, F.col("_t"), F.col("t")))


def early_zero(points, key="curve_id", t="t", s="s", share=0.3, t_max=None) -> DataFrame:
    """Curves whose first value below 1% comes before `share` of the time range."""
    keys = as_list(key)
    end = F.max(t) if t_max is None else F.lit(float(t_max))
    z = points.groupBy(*keys).agg(F.min(F.when(F.col(s) < 0.01, F.col(t))).alias("z"), end.alias("e"))
    text = F.concat(F.lit("Curve reaches zero at time "), num(F.col("z")), F.lit(", which is only "),
                    F.coalesce(pct(F.try_divide("z", "e")), F.lit("0%")), F.lit(" of the time range"))
    return z.where(F.col("z") < F.col("e") * share).select(*issue(keys, "early_zero", "critical", text, F.col("z"), F.col("e")))


def flat_zero(points, key="curve_id", s="s", share=0.5) -> DataFrame:
    keys = as_list(key)
    z = points.groupBy(*keys).agg((F.count_if(F.col(s) < 0.01) / F.count("*")).alias("f"))
    return z.where(F.col("f") > share).select(*issue(
        keys, "flat_region", "critical", F.concat(pct(F.col("f")), F.lit(" of curve points are at zero"))))


def reference_line(points, key="curve_id", t="t", s="s", refs=(0.5, 0.25, 0.75), near=0.03) -> DataFrame:
    """Curves of which over 30% lies near a reference value and which jump onto it; the first such value counts."""
    keys = as_list(key)
    o = Ordered(points.select(*keys, t, s), keys, t, s).lag(_t=t, _s=s)
    aggs = [F.count("*").alias("n"), F.max(t).alias("end")]
    for i, r in enumerate(refs):
        close = F.abs(F.col(s) - r) < near
        aggs += [F.count_if(close).alias(f"c{i}"),
                 F.min(F.when(close & (F.abs(F.col(s) - F.col("_s")) > 0.1), F.col("_t"))).alias(f"j{i}")]
    got = o.df.groupBy(*keys).agg(*aggs)
    pick = F.coalesce(*[F.when((F.col(f"c{i}") > F.col("n") * 0.3) & F.col(f"j{i}").isNotNull(),
                               F.struct(F.lit(float(r)).alias("ref"), F.col(f"j{i}").alias("j"))) for i, r in enumerate(refs)])
    bad = got.where(F.col("n") >= 10).withColumn("_p", pick).where(F.col("_p").isNotNull())
    text = F.concat(F.lit("Curve appears to follow "), pct(F.col("_p.ref")), F.lit(" reference line after time "), num(F.col("_p.j")))
    return bad.select(*issue(keys, "reference_line_contamination", "error", text, F.col("_p.j"), F.col("end")))


def non_monotonic(points, key="curve_id", t="t", s="s", tol=0.02) -> DataFrame:
    keys = as_list(key)
    o = Ordered(points.select(*keys, t, s), keys, t, s).lag(_s=s)
    up = F.col(s) - F.col("_s")
    bad = o.df.groupBy(*keys).agg(F.count_if(up > tol).alias("n"), F.max(up).alias("m")).where("n > 0")
    return bad.select(*issue(keys, "non_monotonic", "warning", F.concat(
        F.lit("Survival increases "), F.col("n").cast("string"), F.lit(" times (max increase: "), pct(F.col("m"), 1), F.lit(")"))))


def all_issues(points, key="curve_id", t="t", s="s", curves=None, strict=False, t_max=None) -> DataFrame:
    """Every rule at once: neighbour columns and all per-curve aggregates share one shuffle on the key.

    The rules above give the same rows one at a time; here a curve's aggregates become an array of issues, and only
    the drops, which are one issue per row, are a second branch over the same neighbour columns.
    """
    keys = as_list(key)
    most, share = (0.15, 0.2) if strict else (0.25, 0.3)
    o = Ordered(points.select(*keys, F.col(t).alias("t"), F.col(s).alias("s")), keys, "t", "s").lag(_t="t", _s="s")
    up = F.col("s") - F.col("_s")
    near = lambda r: F.abs(F.col("s") - r) < 0.03
    refs = (0.5, 0.25, 0.75)
    aggs = {"n": F.count("*"), "end": F.max("t"), "neg": F.count_if(F.col("t") < 0), "neg_lo": F.min("t"),
            "neg_hi": F.max(F.when(F.col("t") < 0, F.col("t"))), "out": F.count_if((F.col("s") < 0) | (F.col("s") > 1)),
            "zero_t": F.min(F.when(F.col("s") < 0.01, F.col("t"))), "zero": F.count_if(F.col("s") < 0.01) / F.count("*"),
            "ups": F.count_if(up > 0.02), "most_up": F.max(up)}
    for i, r in enumerate(refs):
        aggs[f"c{i}"] = F.count_if(near(r))
        aggs[f"j{i}"] = F.min(F.when(near(r) & (F.abs(up) > 0.1), F.col("_t")))
    st = o.df.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()])
    if curves is not None:
        st = attach(curves.select(*keys).distinct(), st, keys)
    n = F.coalesce(F.col("n"), F.lit(0))
    end = F.col("end") if t_max is None else F.lit(float(t_max))
    hit = F.coalesce(*[F.when((F.col(f"c{i}") > n * 0.3) & F.col(f"j{i}").isNotNull(),
                              F.struct(F.lit(float(r)).alias("ref"), F.col(f"j{i}").alias("j"))) for i, r in enumerate(refs)])
    st = st.withColumn("_h", F.when(n >= 10, hit))

    def one(cond, kind, severity, message, lo=None, hi=None):
        return F.when(cond, F.struct(*issue([], kind, severity, message, lo, hi)))

    say = lambda *parts: F.concat(*[F.lit(q) if isinstance(q, str) else q.cast("string") for q in parts])
    found = F.array_compact(F.array(
        one(n == 0, "too_few_points", "critical", F.lit("No data points in curve")),
        one((n > 0) & (n < 10), "too_few_points", "error", say("Only ", n, " points (minimum: 10)")),
        one(F.col("neg") > 0, "negative_time", "error", say("Found ", F.col("neg"), " points with negative time"), F.col("neg_lo"), F.col("neg_hi")),
        one(F.col("out") > 0, "survival_out_of_range", "error", say("Found ", F.col("out"), " points with survival outside [0,1]")),
        one(F.col("zero_t") < end * share, "early_zero", "critical",
            say("Curve reaches zero at time ", num(F.col("zero_t")), ", which is only ", F.coalesce(pct(F.try_divide("zero_t", end)), F.lit("0%")), " of the time range"),
            F.col("zero_t"), end),
        one(F.col("zero") > 0.5, "flat_region", "critical", say(pct(F.col("zero")), " of curve points are at zero")),
        one(F.col("_h").isNotNull(), "reference_line_contamination", "error",
            say("Curve appears to follow ", pct(F.col("_h.ref")), " reference line after time ", num(F.col("_h.j"))), F.col("_h.j"), F.col("end")),
        one(F.col("ups") > 0, "non_monotonic", "warning",
            say("Survival increases ", F.col("ups"), " times (max increase: ", pct(F.col("most_up"), 1), ")"))))
    per_curve = st.select(*keys, F.explode(found).alias("_i")).select(*keys, *[F.col(f"_i.{c}").alias(c) for c in ISSUE_COLS])
    return per_curve.unionByName(_drops(o.df, keys, most))


def qc_score(curves: DataFrame, issues: DataFrame, key="curve_id") -> DataFrame:
    """Score 0.1^critical * 0.5^error * 0.9^warning per curve; curves without issues score 1 and pass."""
    keys = as_list(key)
    n = issues.groupBy(*keys).agg(*[F.count_if(F.col("severity") == k).alias(k) for k in ("critical", "error", "warning")])
    rows = attach(curves.select(*keys).distinct(), n, keys).na.fill(0, ["critical", "error", "warning"])
    score = F.pow(F.lit(0.1), "critical") * F.pow(F.lit(0.5), "error") * F.pow(F.lit(0.9), "warning")
    return rows.select(*keys, "critical", "error", "warning", score.alias("score"),
                       ((F.col("critical") == 0) & (F.col("error") == 0)).alias("passed"))


def qc_report(scored: DataFrame, by="image_id") -> DataFrame:
    return scored.groupBy(*as_list(by)).agg(F.count("*").alias("curves"), F.count_if(~F.col("passed")).alias("failed"),
                                            F.avg("score").alias("mean_score"), F.bool_and("passed").alias("passed"))


def curve_quality(points, key="curve_id", t="t", s="s", curves=None) -> DataFrame:
    """Start, order and range problems per curve as one list of texts."""
    keys = as_list(key)
    o = Ordered(points.select(*keys, t, s), keys, t, s).lag(_t=t, _s=s)
    stats = o.df.groupBy(*keys).agg(
        F.min(F.struct(t, s)).alias("f"), F.count_if(F.col(s) > F.col("_s") + 0.001).alias("up"),
        F.count_if(F.col(t) <= F.col("_t")).alias("still"), F.min(s).alias("lo"), F.max(s).alias("hi"))
    if curves is not None:
        stats = attach(curves.select(*keys).distinct(), stats, keys)
    ft, fs = F.col("f").getField(t), F.col("f").getField(s)
    texts = F.array_compact(F.array(
        F.when(F.col("f").isNull(), F.lit("No points extracted")),
        F.when(F.abs(ft) > 0.01, F.concat(F.lit("Does not start at time=0 (starts at t="), num(ft, 2), F.lit(")"))),
        F.when(F.abs(fs - 1) > 0.01, F.concat(F.lit("Does not start at survival=1.0 (starts at s="), num(fs, 3), F.lit(")"))),
        F.when(F.col("up") > 0, F.concat(F.lit("Monotonicity violation: "), F.col("up").cast("string"),
                                         F.lit(" point(s) where survival increases"))),
        F.when(F.col("still") > 0, F.concat(F.lit("Time ordering violation: "), F.col("still").cast("string"),
                                            F.lit(" point(s) with non-increasing time"))),
        F.when(F.col("lo") < 0, F.concat(F.lit("Invalid survival: minimum is "), num(F.col("lo"), 3), F.lit(" (should be >= 0)"))),
        F.when(F.col("hi") > 1.001, F.concat(F.lit("Invalid survival: maximum is "), num(F.col("hi"), 3), F.lit(" (should be <= 1.0)")))))
    out = stats.select(*keys, texts.alias("_l"))
    return out.select(*keys, (F.size("_l") == 0).alias("is_valid"), F.array_join("_l", "; ").alias("issues"))


def plausible_curve(points, key="curve_id", t="t", s="s", least=10, rise=0.01, share=0.1, t_end=50.0, end_range=None) -> DataFrame:
    keys = as_list(key)
    o = Ordered(points.select(*keys, t, s), keys, t, s).lag(_s=s)
    st = o.df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(s) - F.col("_s") > rise).alias("up"),
                                 F.max(F.struct(t, s)).alias("last"))
    ok = (F.col("n") >= least) & (F.col("up") <= (F.col("n") - 1) * share) & (F.col("last").getField(t) >= t_end)
    if end_range is not None:
        ok = ok & F.col("last").getField(s).between(*end_range)
    return st.select(*keys, ok.alias("plausible"))


def keep_passed(points, scored, key="curve_id") -> DataFrame:
    """Drop the curves that failed; curves missing from the report stay."""
    keys = as_list(key)
    failed = scored.where(~F.col("passed")).select(*[F.col(k).alias(f"__f_{k}") for k in keys])
    return points.join(failed, [F.col(k).eqNullSafe(F.col(f"__f_{k}")) for k in keys], "left_anti")


# -- named checks ------------------------------------------------------------------------------------

def check(keys, name: Column, status: Column, message: Column) -> list:
    return [*keys, name.alias("check"), status.alias("status"), message.alias("message")]


def curve_count(images: DataFrame, curves: DataFrame, image="image_id", key="curve_id") -> DataFrame:
    n = attach(images.select(image).distinct(), curves.groupBy(image).agg(F.count_distinct(key).alias("n")), [image])
    n = n.withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "FAIL").when(F.col("n") == 2, "PASS").otherwise("WARNING")
    text = (F.when(F.col("n") == 0, "No curves detected").when(F.col("n") == 1, "Only 1 curve detected (expected 2 for comparison)")
            .when(F.col("n") == 2, "2 curves detected").otherwise(F.concat(F.col("n").cast("string"), F.lit(" curves detected (expected 2)"))))
    return n.select(*check([image], F.lit("Curve Count"), status, text))


def start_point(points, key="curve_id", t="t", s="s", curves=None) -> DataFrame:
    keys = as_list(key)
    f = _curves_with(points, curves, keys, f=F.min(F.struct(t, s)))
    ft, fs = F.col("f").getField(t), F.col("f").getField(s)
    texts = F.array_compact(F.array(
        F.when(F.abs(ft) > 0.01, F.concat(F.lit("First time="), num(ft, 3), F.lit(", should be 0"))),
        F.when(F.abs(fs - 1) > 0.01, F.concat(F.lit("First survival="), num(fs, 3), F.lit(", should be 1.0")))))
    status = (F.when(F.col("f").isNull(), "FAIL").when(F.size(texts) == 0, "PASS")
              .when(F.abs(fs - 1) < 0.05, "WARNING").otherwise("FAIL"))
    text = (F.when(F.col("f").isNull(), "No points in curve").when(F.size(texts) > 0, F.array_join(texts, "; "))
            .otherwise(F.concat(F.lit("Starts at ("), num(ft, 2), F.lit(", "), num(fs, 3), F.lit(")"))))
    return f.select(*check(keys, F.lit("Starting Point"), status, text))


def monotonicity(points, key="curve_id", t="t", s="s", keep=5) -> DataFrame:
    """Rises per curve, with the texts of the first `keep` of them."""
    keys = as_list(key)
    o = Ordered(points.select(*keys, t, s), keys, t, s).lag(_s=s)
    n = o.df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(s) > F.col("_s") + 0.001).alias("up"))
    first = top_rows(o.df.where(F.col(s) > F.col("_s") + 0.001), keys, keep, t, s)
    text = F.concat(F.lit("Survival increased at t="), num(F.col(t), 2), F.lit(": "), num(F.col("_s"), 3), F.lit(" -> "), num(F.col(s), 3))
    listed = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(t, s, text.alias("m")))),
                                                               lambda r: r["m"]), "; ").alias("violations"))
    rows = attach(n, listed, keys)
    status = F.when(F.col("n") < 2, "WARNING").when(F.col("up") > 0, "FAIL").otherwise("PASS")
    message = (F.when(F.col("n") < 2, "Not enough points to check")
               .when(F.col("up") > 0, F.concat(F.col("up").cast("string"), F.lit(" violation(s)"))).otherwise("Monotonically non-increasing"))
    return rows.select(*check(keys, F.lit("Monotonicity"), status, message), F.coalesce("violations", F.lit("")).alias("violations"))


def range_bounds(points, key="curve_id", t="t", s="s", curves=None) -> DataFrame:
    keys = as_list(key)
    r = _curves_with(points, curves, keys, a=F.min(t), b=F.max(t), lo=F.min(s), hi=F.max(s))
    texts = F.array_compact(F.array(
        F.when(F.col("a") < -0.01, F.concat(F.lit("Negative time: "), num(F.col("a"), 3))),
        F.when(F.col("lo") < -0.01, F.concat(F.lit("Negative survival: "), num(F.col("lo"), 3))),
        F.when(F.col("hi") > 1.01, F.concat(F.lit("Survival > 1: "), num(F.col("hi"), 3)))))
    status = F.when(F.col("a").isNull(), "FAIL").when(F.size(texts) > 0, "WARNING").otherwise("PASS")
    text = (F.when(F.col("a").isNull(), "No points").when(F.size(texts) > 0, F.array_join(texts, "; "))
            .otherwise(F.concat(F.lit("t:["), num(F.col("a")), F.lit(","), num(F.col("b")), F.lit("] s:["),
                                num(F.col("lo"), 2), F.lit(","), num(F.col("hi"), 2), F.lit("]"))))
    return r.select(*check(keys, F.lit("Range Bounds"), status, text))


def overall_status(checks: DataFrame, by) -> DataFrame:
    """FAIL over WARNING over PASS."""
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARNING", 1).otherwise(0)
    worst = checks.groupBy(*as_list(by)).agg(F.max(rank).alias("_r"), F.count("*").alias("checks"))
    return worst.select(*as_list(by), "checks", F.element_at(F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("FAIL")),
                                                            (F.col("_r") + 1).cast("int")).alias("status"))


def offset_direction(offsets: DataFrame, key="curve_id", d="offset", tol=2) -> DataFrame:
    keys = as_list(key)
    n = F.count(d)
    return offsets.groupBy(*keys).agg(
        (F.count_if(F.col(d) < -tol) / n).alias("above"), (F.count_if(F.abs(F.col(d)) <= tol) / n).alias("within"),
        (F.count_if(F.col(d) > tol) / n).alias("below"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"),
        F.min(d).alias("lowest"), F.max(d).alias("highest"))


def truth_at_time(points, truth: dict, key="curve_id", t="t", s="s", half=0.5) -> DataFrame:
    """Mean value around each given time against an expected interval: {time: (low, high)}."""
    keys = as_list(key)
    cases = F.array(*[F.struct(F.lit(float(a)).alias("at"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"))
                      for a, (lo, hi) in truth.items()])
    near = points.select(*keys, t, s, F.explode(F.filter(cases, lambda c: F.abs(F.col(t) - c["at"]) <= half)).alias("c"))
    m = near.groupBy(*keys, "c.at", "c.low", "c.high").agg(F.avg(s).alias("mean"))
    return m.select(*keys, "at", "mean", F.col("mean").between(F.col("low"), F.col("high")).alias("ok"))
