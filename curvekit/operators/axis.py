"""Coordinate mapping, axis labels and calibration rows (image_id, four pixel anchors, data bounds)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordered import Ordered, exact_median, top_rows
from ..runtime import attach

c = F.col
CAL = ["x_0_pixel", "x_max_pixel", "y_0_pixel", "y_100_pixel", "time_min", "time_max", "survival_min", "survival_max"]


# -- mapping ---------------------------------------------------------------------------------------

def px_to_data(points, calibration, image="image_id", x="x", y="y", t="t", s="s") -> DataFrame:
    """Pixels to time and survival; percentage axes are divided by their maximum."""
    rows = attach(points, calibration.select(image, *CAL), [image])
    per_t = F.try_divide(c("time_max") - c("time_min"), c("x_max_pixel") - c("x_0_pixel"))
    per_s = F.try_divide(c("survival_max") - c("survival_min"), c("y_0_pixel") - c("y_100_pixel"))
    raw = c("survival_min") + (c("y_0_pixel") - c(y)) * per_s
    return rows.select(*points.columns, (c("time_min") + (c(x) - c("x_0_pixel")) * per_t).alias(t),
                       F.when(c("survival_max") > 1.5, raw / c("survival_max")).otherwise(raw).alias(s))


def data_to_px(points, calibration, image="image_id", t="t", s="s", x="px", y="py") -> DataFrame:
    """The inverse, cut to whole pixels."""
    rows = attach(points, calibration.select(image, *CAL), [image])
    per_t = F.try_divide(c("time_max") - c("time_min"), c("x_max_pixel") - c("x_0_pixel"))
    per_s = F.try_divide(c("survival_max") - c("survival_min"), c("y_0_pixel") - c("y_100_pixel"))
    value = F.when(c("survival_max") > 1.5, c(s) * c("survival_max")).otherwise(c(s))
    return rows.select(*points.columns, (c("x_0_pixel") + F.try_divide(c(t) - c("time_min"), per_t)).try_cast("int").alias(x),
                       (c("y_0_pixel") - F.try_divide(value - c("survival_min"), per_s)).try_cast("int").alias(y))


def clip_points(points, t_max, t="t", s="s", slack=0.5) -> DataFrame:
    """Values clamped to 0..1, times kept within 0..t_max + slack."""
    end = t_max if isinstance(t_max, Column) else F.lit(float(t_max))
    return points.where((c(t) >= 0) & (c(t) <= end + slack)).withColumn(s, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(s))))


def stretching_factors(calibration) -> DataFrame:
    """Data units per pixel; empty pixel ranges count as one pixel."""
    wx, wy = c("x_max_pixel") - c("x_0_pixel"), c("y_0_pixel") - c("y_100_pixel")
    return calibration.withColumns({"x_stretching": (c("time_max") - c("time_min")) / F.when(wx <= 0, 1).otherwise(wx),
                                    "y_stretching": (c("survival_max") - c("survival_min")) / F.when(wy <= 0, 1).otherwise(wy)})


# -- labels ----------------------------------------------------------------------------------------

def parse_axis_number(text: Column, strict: bool = True) -> Column:
    """Number in an axis label; `strict` refuses texts that are mostly letters."""
    t = F.trim(text)
    letters, digits = F.length(F.regexp_replace(t, r"\P{L}", "")), F.length(F.regexp_replace(t, r"\P{Nd}", ""))
    bare = F.regexp_replace(t, "[%, ]", "")
    bare = F.when(F.length(bare) <= 3, F.translate(bare, "OolI", "0011")).otherwise(bare)
    dot = F.rlike(bare, F.lit(r"^\.\d")) if strict else F.startswith(bare, F.lit(".")) & (F.length(bare) >= 2)
    bare = F.when(dot, F.concat(F.lit("0"), bare)).otherwise(bare)
    value = F.regexp_extract(bare, r"(-?\d+\.?\d*)", 1).try_cast("double")
    return F.when((letters > digits + 1) | ((F.length(t) > 5) & (letters > 1)), None).otherwise(value) if strict else value


def labels_from_tokens(tokens, axis="x", text="text", least=0.2, strict=True) -> DataFrame:
    """Tokens with enough confidence and a plausible number as axis labels (value, px)."""
    rows = tokens.withColumn("value", parse_axis_number(c(text), strict))
    ok = c("value").between(0, 200) if axis == "x" else c("value").between(0, 150)
    pos = "center_x" if axis == "x" else "center_y"
    return rows.where((c("conf") > least) & ok).select("image_id", "value", c(pos).cast("int").alias("px"))


def correct_axis_labels(labels, filtered=True, image="image_id") -> DataFrame:
    """Repeated zeros or repeated misread digits are replaced by steps of 25 counted from the lowest zero.

    The step is the mean spacing of the label rows without outliers (more than double or less than half the upper
    median). `filtered=False` is the simpler variant: plain mean over all labels, topmost zero, duplicates of 2..9 only.
    Columns: value (corrected), raw, px.
    """
    rows = labels.select(image, c("value").cast("double").alias("value"), "px")
    zero = F.abs("value") < (0.1 if filtered else 0.001)
    small = rows.where(c("value").between(2, 9)).groupBy(image, "value").agg(F.count("*").alias("_k")).groupBy(image).agg((F.max("_k") > 1).alias("_dup"))
    st = rows.groupBy(image).agg(F.count("*").alias("_n"), F.count_if(zero).alias("_zeros"),
                                 (F.max if filtered else F.min)(F.when(zero, c("px"))).alias("_zero_px"))
    if filtered:
        gaps = Ordered(rows.select(image, "px").distinct(), image, "px").lead(_nx="px").df.where(c("_nx").isNotNull()).select(image, (c("_nx") - c("px")).alias("_gap"))
        med = exact_median(gaps, image, "_gap", "_med", upper=True).select(image, "_med")
        near = (c("_gap") > 0.5 * c("_med")) & (c("_gap") < 2 * c("_med"))
        step = attach(gaps, med, [image]).groupBy(image).agg(F.coalesce(F.avg(F.when(near, c("_gap"))), F.avg("_gap")).alias("_step"))
    else:
        step = rows.groupBy(image).agg(F.try_divide(F.max("px") - F.min("px"), F.count("*") - 1).alias("_step"))
    plan = attach(attach(st, small, [image]), step, [image])
    again = F.coalesce(c("_dup"), F.lit(False))
    plan = plan.where((c("_n") >= 2) & c("_zero_px").isNotNull() & c("_step").isNotNull() & (((c("_zeros") > 1) | again) if filtered else again))
    out = attach(rows, plan.select(image, "_zero_px", "_step"), [image])
    steps = F.rint(F.try_divide(c("_zero_px") - c("px"), c("_step"))) * 25
    fixed = F.greatest(F.lit(0.0), F.least(F.lit(100.0), steps))
    if not filtered:
        fixed = F.when(zero, 0.0).otherwise(fixed)
    return out.select(image, F.when(c("_step").isNotNull(), fixed + 0.0).otherwise(c("value")).alias("value"), c("value").alias("raw"), "px")


def _ends(labels, image) -> DataFrame:
    """Lowest two and highest two labels by value per image, as v1 p1 v2 p2 w1 q1 w2 q2."""
    low = top_rows(labels.select(image, "value", "px"), image, 2, "value", "px")
    high = top_rows(labels.select(image, "value", "px"), image, 2, F.desc("value"), "px")
    pick = lambda n, col: F.max(F.when(c("rn") == n, c(col)))
    a = low.groupBy(image).agg(pick(1, "value").alias("v1"), pick(1, "px").alias("p1"), pick(2, "value").alias("v2"), pick(2, "px").alias("p2"))
    b = high.groupBy(image).agg(pick(1, "value").alias("w1"), pick(1, "px").alias("q1"), pick(2, "value").alias("w2"), pick(2, "px").alias("q2"))
    return attach(a, b, [image])


def x_anchors(labels, lines, t_max="t_max", image="image_id") -> DataFrame:
    """Pixels of time 0 and of the axis end, and the end's time.

    lines: image_id, y_axis_x, x_axis_end, t_max (the expected end). Zero: a label hit, else extrapolation from the two
    smallest labels, else the axis line. End: a label hit, else extrapolation, else the rightmost label or the axis line.
    """
    rows = attach(labels.select(image, "value", "px"), lines.select(image, c(t_max).alias("_tm")), [image])
    st = rows.groupBy(image).agg(F.count("*").alias("_n"), F.min(F.when(F.abs("value") < 0.1, c("px"))).alias("_zero"),
                                 F.min(F.when(F.abs(c("value") - c("_tm")) < 0.5, c("px"))).alias("_hit"),
                                 F.max("px").alias("_rp"), F.max_by("value", "px").alias("_rv"))
    # the last label by value, the lowest px first among equals
    all_ = attach(attach(lines, st, [image]), _ends(labels, image), [image])
    last_p = c("q1")
    unit = F.try_divide(c("p2") - c("p1"), c("v2") - c("v1"))
    far = F.when((c("_n") >= 2) & (c("v1") > 0) & (c("v2") != c("v1")), c("p1") - c("v1") * unit)
    x0 = F.coalesce("_zero", F.when(far >= 0, far.cast("int")), "y_axis_x").cast("int")
    all_ = all_.withColumn("x_0_pixel", x0)
    tm = c(t_max)
    span = F.try_divide(last_p - c("p1"), c("w1") - c("v1"))
    many = (F.when(c("_hit").isNotNull(), F.struct(c("_hit").cast("int").alias("x"), tm.alias("t")))
            .when((c("_rv") < tm) & (c("w1") != c("v1")), F.struct((c("p1") + (tm - c("v1")) * span).cast("int").alias("x"), tm.alias("t")))
            .otherwise(F.struct(c("_rp").cast("int").alias("x"), c("_rv").alias("t"))))
    line = F.struct(c("x_axis_end").cast("int").alias("x"), tm.alias("t"))
    reach = c("x_0_pixel") + tm * F.try_divide(c("p1") - c("x_0_pixel"), c("v1"))
    one = F.when((c("v1") > 0) & (c("p1") > c("x_0_pixel")) & (reach >= c("x_axis_end") * 0.7), F.struct(reach.cast("int").alias("x"), tm.alias("t"))).otherwise(line)
    end = F.when(c("_n") >= 2, many).when(c("_n") == 1, one).otherwise(line)
    return all_.withColumn("_e", end).select(image, "x_0_pixel", c("_e.x").alias("x_max_pixel"), c("_e.t").cast("double").alias("label_time_max"))


def y_anchors(labels, lines, image="image_id") -> DataFrame:
    """Pixels of survival 0 and 100% and the axis maximum (1 or 100).

    lines: image_id, x_axis_y, y_axis_top. 100%: a label hit, else extrapolation from the zero and the highest label.
    """
    v = c("value")
    st = labels.groupBy(image).agg(F.count("*").alias("_n"), F.min(F.when(F.abs(v) < 0.1, c("px"))).alias("_zero"), F.max(v).alias("_top"),
                                   F.min(F.when((F.abs(v - 100) < 1) | (F.abs(v - 1) < 0.05), c("px"))).alias("_hit"),
                                   F.min(F.struct((-v).alias("a"), c("px").alias("p"))).getField("p").alias("_hp"))
    rows = attach(lines, st, [image])
    far = F.when((c("_n") >= 2) & (c("_top") > 0), c("_zero") - 100 * F.try_divide(c("_zero") - c("_hp"), c("_top")))
    return rows.select(image, F.coalesce("_zero", "x_axis_y").cast("int").alias("y_0_pixel"),
                       F.coalesce("_hit", F.when(far >= 0, far.cast("int")), "y_axis_top").cast("int").alias("y_100_pixel"),
                       F.when(c("_top") > 1.5, 100.0).otherwise(1.0).alias("survival_max"))


def with_default_lines(images, lines, image="image_id") -> DataFrame:
    """Axis lines per picture; pictures without both lines get 10% and 80..90% of their size."""
    rows = attach(images.select(image, "width", "height"), lines, [image])
    none = c("x_axis_y").isNull() | c("y_axis_x").isNull()
    part = lambda size, f: F.floor(c(size) * f).cast("int")
    pick = lambda col, size, f: F.when(none, part(size, f)).otherwise(c(col)).cast("int").alias(col)
    return rows.select(image, pick("y_axis_x", "width", 0.1), pick("x_axis_y", "height", 0.8), pick("y_axis_top", "height", 0.1),
                       F.when(none, part("width", 0.9)).otherwise(c("x_axis_to")).cast("int").alias("x_axis_end"))


def calibrate(x_labels, y_labels, lines, time_max, image="image_id") -> DataFrame:
    """Calibration row per image from labels and axis lines; anchors of empty ranges are null."""
    lines = lines.withColumn("t_max", time_max if isinstance(time_max, Column) else F.lit(float(time_max)))
    xa, ya = x_anchors(x_labels, lines, image=image), y_anchors(y_labels, lines, image)
    rows = attach(attach(lines.select(image, "t_max"), xa, [image]), ya, [image])
    ok = (c("x_max_pixel") > c("x_0_pixel")) & (c("y_0_pixel") > c("y_100_pixel"))
    keep = lambda col: F.when(ok, c(col)).alias(col)
    return rows.select(image, keep("x_0_pixel"), keep("x_max_pixel"), keep("y_0_pixel"), keep("y_100_pixel"), F.lit(0.0).alias("time_min"),
                       c("t_max").alias("time_max"), F.lit(0.0).alias("survival_min"), "survival_max")


def calibration_from_curve_bounds(traced, image="image_id", x="x", y="y", time_max=12.0) -> DataFrame:
    """Calibration guessed from the extent of the curves, with margins of 2% and 5%."""
    b = traced.groupBy(image).agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"))
    mx, my = F.floor((c("b") - c("a")) * 0.02), F.floor((c("d") - c("c")) * 0.05)
    return b.select(image, (c("a") - mx).cast("int").alias("x_0_pixel"), (c("b") + mx).cast("int").alias("x_max_pixel"), (c("d") + my).cast("int").alias("y_0_pixel"),
                    (c("c") - my).cast("int").alias("y_100_pixel"), F.lit(0.0).alias("time_min"), F.lit(float(time_max)).alias("time_max"),
                    F.lit(0.0).alias("survival_min"), F.lit(1.0).alias("survival_max"), F.lit(0.5).alias("confidence"))


def refine_bounds(bounds, top_edges, left_edges, least=50, image="image_id") -> DataFrame:
    """Plot rectangles (px, py, pw, ph) moved to the curves' top and left edges (column `edge`); null below `least` pixels."""
    rows = attach(attach(bounds, top_edges.select(image, c("edge").alias("_top")), [image]), left_edges.select(image, c("edge").alias("_left")), [image])
    bottom, right = c("py") + c("ph"), c("px") + c("pw")
    y = F.when((c("_top") < bottom) & (c("_top") >= 0), c("_top")).otherwise(c("py"))
    x = F.when((c("_left") < right) & (c("_left") >= 0), c("_left")).otherwise(c("px"))
    rows = rows.select(image, x.alias("_x"), y.alias("_y"), (right - x).alias("_w"), (bottom - y).alias("_h"))
    ok = (c("_w") >= least) & (c("_h") >= least)
    return rows.select(image, *[F.when(ok, c(a)).cast("int").alias(b) for a, b in (("_x", "px"), ("_y", "py"), ("_w", "pw"), ("_h", "ph"))])


def expand_bounds(bounds, traced, image="image_id", x="x", beyond=20, ratio=1.5) -> DataFrame:
    """Widen plot rectangles that the curves leave by more than `beyond` pixels or exceed `ratio` times; the time range
    (time_min, time_max) grows in proportion."""
    ext = traced.groupBy(image).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    rows = attach(bounds, ext, [image])
    wide = (c("_b") > c("px") + c("pw") + beyond) | (F.try_divide(c("_b") - c("_a"), c("pw")) > ratio)
    nx = F.greatest(F.lit(0), c("_a") - 10)
    rows = rows.withColumns({"_wide": F.coalesce(wide, F.lit(False)), "_nx": nx}).withColumn("_nw", c("_b") - c("_nx") + 10)
    end = c("time_min") + (c("time_max") - c("time_min")) * F.try_divide("_nw", "pw")
    return rows.select(image, F.when(c("_wide"), c("_nx")).otherwise(c("px")).cast("int").alias("px"), "py", F.when(c("_wide"), c("_nw")).otherwise(c("pw")).cast("int").alias("pw"), "ph",
                       "time_min", F.when(c("_wide"), end).otherwise(c("time_max")).alias("time_max"), c("_wide").alias("expanded"))


def reconcile_axis(first, second, rules="validate", image="image_id", tolerance=0.1) -> DataFrame:
    """Axis ranges (x_low, x_high, y_low, y_high, confidence) of two sources.

    rules "validate": missing ranges come from the second source, different spans from a second source surer than 0.7,
    another scale from one surer than 0.6. "merge": the first source's ranges change when the ends differ by over 20% or
    the scale differs, given confidence over 0.7. "update": over 10% or another scale, given at least 0.8.
    """
    a = first.select(image, *[c(k).alias(f"a_{k}") for k in ("x_low", "x_high", "y_low", "y_high")])
    b = second.select(c(image).alias("_img"), *[c(k).alias(f"b_{k}") for k in ("x_low", "x_high", "y_low", "y_high")], c("confidence").alias("q"))
    both = a.join(b, c(image).eqNullSafe(c("_img")), "full_outer").withColumn(image, F.coalesce(image, "_img"))
    ax, bx, ay, by = (c(k).isNotNull() for k in ("a_x_high", "b_x_high", "a_y_high", "b_y_high"))
    scale = (c("a_y_high") > 1.5) != (c("b_y_high") > 1.5)
    valid = F.coalesce(bx & by & (c("q") >= 0.5), F.lit(False))
    if rules == "validate":
        spans = F.abs((c("a_x_high") - c("a_x_low")) - (c("b_x_high") - c("b_x_low"))) / F.greatest(c("b_x_high") - c("b_x_low"), F.lit(0.1)) > tolerance
        take_x = valid & (~ax | (spans & (c("q") > 0.7)))
        take_y = valid & (~ay | (scale & (c("q") > 0.6)))
        conf = F.when(~valid, 0.5).when(~ax, c("q") * 0.9).when(spans, F.when(c("q") > 0.7, c("q")).otherwise(0.5)).otherwise(F.least(F.lit(0.95), c("q") + 0.1))
        conf = F.when(~valid, 0.5).when(~ay, c("q") * 0.9).otherwise(F.least(F.lit(0.95), conf + 0.1))
    else:
        part, sure, base = (0.2, c("q") > 0.7, c("b_x_high")) if rules == "merge" else (0.1, c("q") >= 0.8, c("a_x_high"))
        ends = F.abs(c("b_x_high") - c("a_x_high")) / F.greatest(base, F.lit(1.0)) > part
        take_x, take_y, conf = valid & sure & (~ax | ends), valid & sure & (~ay | scale), F.coalesce("q", F.lit(0.0))
    take_x, take_y = F.coalesce(take_x, F.lit(False)), F.coalesce(take_y, F.lit(False))
    pick = lambda take, k: F.when(take, c(f"b_{k}")).otherwise(c(f"a_{k}")).alias(k)
    return both.select(image, pick(take_x, "x_low"), pick(take_x, "x_high"), pick(take_y, "y_low"), pick(take_y, "y_high"), conf.alias("confidence"))


def axis_validity(calibration, image="image_id") -> DataFrame:
    """Six checks of ranges and order; a row without anchors fails."""
    say = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    found = F.array_compact(F.array(
        say(c("time_min") != 0, "Time should start at 0, got ", c("time_min")), say(c("time_max") <= 0, "Invalid max time: ", c("time_max")),
        say(c("survival_min") != 0, "Survival min should be 0, got ", c("survival_min")),
        say(~c("survival_max").isin(1.0, 100.0), "Survival max should be 1.0 or 100, got ", c("survival_max")),
        say(c("x_0_pixel") >= c("x_max_pixel"), "Origin X should be less than X-axis end"),
        say(c("y_0_pixel") <= c("y_100_pixel"), "Origin Y should be greater than Y-axis end (Y increases downward)")))
    none = c("x_0_pixel").isNull()
    return calibration.select(image, F.when(none, "FAIL").when(F.size(found) > 0, "WARNING").otherwise("PASS").alias("status"),
                              F.when(none, F.array(F.lit("No calibration data available"))).otherwise(found).alias("_l")).select(
        image, "status", F.array_join("_l", "; ").alias("issues"))


def infer_percent_scale(labels, image="image_id") -> DataFrame:
    """Whether labels are percentages, judged by decimals, end points, large values and suspicious digits 2..9."""
    v = c("value")
    st = labels.groupBy(image).agg(F.max(v).alias("_max"), F.bool_or((v > 0) & (v < 1)).alias("_dec"), F.bool_or(F.abs(v) < 0.01).alias("_z"),
                                   F.bool_or(F.abs(v - 1) < 0.01).alias("_o"), F.bool_or(v.between(2, 9)).alias("_odd"))
    small = c("_dec") | (c("_z") & c("_o"))
    percent = F.when(small, ~(c("_odd") & (c("_max") < 10)) & (c("_max") > 10)).otherwise(c("_max") > 10)
    return st.select(image, percent.alias("percent"), F.when(percent, 100.0).otherwise(1.0).alias("survival_max"))


def calibrate_from_labels(x_labels, y_labels, basic, time_max=None, least=50, image="image_id") -> DataFrame:
    """Label positions override the anchors of the `basic` calibration; too small rectangles keep the basic row."""
    fixed = correct_axis_labels(y_labels, filtered=False, image=image)
    v = c("value")
    xs = x_labels.groupBy(image).agg(F.count("*").alias("_nx"), F.min(F.when(F.abs(v) < 0.001, c("px"))).alias("_x0"), F.max("px").alias("_xr"), F.max_by(v, c("px")).alias("_xv"))
    ends = _ends(x_labels, image)
    raw = c("raw")
    top = lambda value: (F.abs(value - 1) < 0.01) | (F.abs(value - 100) < 1)
    ys = fixed.groupBy(image).agg(
        F.count("*").alias("_ny"), F.min(F.when(F.abs(raw) < 0.001, c("px"))).alias("_y0"), F.min(F.when(top(v), c("px"))).alias("_h1"), F.min(F.when(top(raw), c("px"))).alias("_h2"),
        F.min(F.when(v.between(0.9, 1.5), c("px"))).alias("_h3"), F.min(F.when(v.between(90, 150), c("px"))).alias("_h4"), F.min(F.when(F.abs(v) < 0.1, c("px"))).alias("_fz"),
        F.min(F.struct((-v).alias("a"), c("px").alias("p"))).alias("_fh"))
    raws = _ends(fixed.select(image, raw.alias("value"), "px"), image).select(image, c("w1").alias("r1"), c("q1").alias("s1"), c("w2").alias("r2"), c("q2").alias("s2"))
    rows = attach(attach(attach(attach(attach(basic, xs, [image]), ends, [image]), ys, [image]), raws, [image]), infer_percent_scale(fixed, image).select(image, c("survival_max").alias("_sm")), [image])
    far = c("p1") - c("v1") * F.try_divide(c("p2") - c("p1"), c("v2") - c("v1"))
    x0 = F.coalesce("_x0", F.when((c("_nx") >= 2) & (c("v1") > 0) & (F.abs(c("v2") - c("v1")) > 0.001) & (far < c("p1")) & (far >= 0), far.cast("int")), "x_0_pixel")
    y0 = F.coalesce("_y0", "y_0_pixel")
    high = -c("_fh.a")
    ext1 = F.when((c("_ny") >= 2) & (high > 0), c("_fz") - 100 * ((c("_fz") - c("_fh.p")) / high))
    unit = F.try_divide(c("s2") - c("s1"), c("r1") - c("r2"))
    ext2 = F.when((c("_ny") >= 2) & (c("r1") != c("r2")), c("s1") - (F.when(c("r1") > 1.5, 100.0).otherwise(1.0) - c("r1")) * unit)
    y1 = F.coalesce("_h1", "_h2", "_h3", "_h4", F.when(ext1 >= 0, ext1.cast("int")), F.when(ext2 >= 0, ext2.cast("int")), "y_100_pixel")
    xe = F.coalesce("_xr", "x_max_pixel")
    tm = F.lit(float(time_max)) if time_max is not None else F.coalesce("_xv", "time_max")
    ok = (xe - x0 >= least) & (y0 - y1 >= least)
    pick = lambda new, old: F.when(ok, new).otherwise(c(old)).alias(old)
    return rows.select(image, pick(x0.cast("int"), "x_0_pixel"), pick(xe.cast("int"), "x_max_pixel"), pick(y0.cast("int"), "y_0_pixel"), pick(y1.cast("int"), "y_100_pixel"),
                       pick(F.lit(0.0), "time_min"), pick(tm, "time_max"), pick(F.lit(0.0), "survival_min"), pick(F.coalesce("_sm", F.lit(1.0)), "survival_max"))


def label_confidence(x_labels, y_labels, images, image="image_id") -> DataFrame:
    """0.9 with at least two labels on both axes, 0.6 on one, else 0.4."""
    n = lambda labels, name: labels.groupBy(image).agg((F.count("*") >= 2).cast("int").alias(name))
    rows = attach(attach(images.select(image), n(x_labels, "_x"), [image]), n(y_labels, "_y"), [image])
    k = F.coalesce("_x", F.lit(0)) + F.coalesce("_y", F.lit(0))
    return rows.select(image, F.when(k == 2, 0.9).when(k == 1, 0.6).otherwise(0.4).alias("confidence"))


def calibrate_from_ranges(basic, ranges, time_max=None, image="image_id") -> DataFrame:
    """Keep the pixel anchors and take the data ranges of a second source where it has them; factors follow."""
    rows = attach(basic, ranges.select(image, "x_low", "x_high", "y_low", "y_high"), [image])
    end = F.coalesce("x_high", "time_max") if time_max is None else F.when(c("x_high").isNotNull(), F.lit(float(time_max))).otherwise(c("time_max"))
    rows = rows.withColumns({"time_min": F.coalesce("x_low", "time_min"), "time_max": end, "survival_min": F.coalesce("y_low", "survival_min"),
                             "survival_max": F.coalesce("y_high", "survival_max")}).drop("x_low", "x_high", "y_low", "y_high")
    return stretching_factors(rows)


def spread_numbers(texts, width="width", image="image_id", text="text") -> DataFrame:
    """Numbers read without positions, spread evenly over the region's width."""
    rows = texts.select(image, width, F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)).alias("_n"))
    space = F.floor(c(width) / (F.size("_n") + 1))
    return rows.select(image, space.alias("_s"), F.posexplode("_n").alias("pos", "_v")).select(
        image, c("_v").try_cast("double").alias("value"), (c("_s") * (c("pos") + 1)).cast("int").alias("px"))
