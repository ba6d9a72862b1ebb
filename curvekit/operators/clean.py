"""Ordered cleaning of curves: rows (key, t, s), or (key, x, y) for traced pixel curves.

`counted` is handed to `Ordered`: the table that a chain of steps began with.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fold import fold
from ..islands import fold_islands, keep_since, once
from ..ordered import Ordered, exact_median
from ..runtime import as_list, attach

INTERIOR_LOOKAHEAD = 50
STRETCH = 256  # numbers of a grid that are made for one key, then for the next


def clip_negative_time(points: DataFrame, t="t") -> DataFrame:
    return points.withColumn(t, F.greatest(F.lit(0.0), F.col(t)))


def dedup_median(points: DataFrame, key="curve_id", t="t", s="s", digits=3) -> DataFrame:
    """One row per curve and rounded time with the upper median of its values."""
    keys = as_list(key)
    rounded = points.select(*keys, F.round(t, digits).alias(t), s)
    return exact_median(rounded, keys + [t], s, "_m", upper=True).select(*keys, t, F.col("_m").alias(s))


def dedup_min(points: DataFrame, key="curve_id", t="t", s="s", digits=3) -> DataFrame:
    keys = as_list(key)
    return points.groupBy(*keys, F.round(t, digits).alias(t)).agg(F.min(s).alias(s))


def dedup_continuity(points: DataFrame, key="curve_id", t="t", s="s", digits=3, up=0.01, down=0.15) -> DataFrame:
    """One value per time: the highest within [prev - down, prev + up] of the last selected value, else the closest.

    A single value is taken as it is. Equal values at one time cannot change the choice, so they are merged first.
    """
    keys = as_list(key)
    rows = points.where(F.col(s).isNotNull()).groupBy(*keys, F.round(t, digits).alias(t)).agg(F.array_sort(F.collect_set(s)).alias("_vs"))  # what was found in one place
    value = dict(points.dtypes)[s]

    def step(prev, row, put):
        vs = row["_vs"]
        best = F.array_max(F.filter(vs, lambda v: (v >= prev - down) & (v <= prev + up)))
        near = F.array_min(F.transform(vs, lambda v: F.struct(F.abs(v - prev).alias("d"), v.alias("v"))))["v"]
        chosen = F.when(F.size(vs) == 1, F.element_at(vs, 1)).otherwise(F.coalesce(best, near))
        return once(chosen, lambda chosen: put(chosen, F.struct(row[t].alias(t), chosen.alias(s))))

    return fold_islands(Ordered(rows, keys, t, counted=points), F.size("_vs") == 1, step, value, f"struct<{t}: double, {s}: double>", start=F.lit(1.0))


def bin_median(points: DataFrame, key="curve_id", t="t", s="s", width=0.5) -> DataFrame:
    keys = as_list(key)
    binned = points.select(*keys, (F.round(F.col(t) / width) * width).alias(t), s)
    return exact_median(binned, keys + [t], s, "_m").select(*keys, t, F.col("_m").alias(s))


def rescale_to_one(points: DataFrame, key="curve_id", t="t", s="s", low=0.1, high=0.95) -> DataFrame:
    """Curves whose highest value lies between `low` and `high` are stretched to reach 1."""
    o = Ordered(points, key, t).total(_top=F.max(s))
    return _rescaled(o, s, low, high).df


def _rescaled(o: Ordered, s, low=0.1, high=0.95) -> Ordered:
    fix = (F.col("_top") > low) & (F.col("_top") < high)
    value = F.when(fix, F.least(F.lit(1.0), F.col(s) * F.try_divide(F.lit(1.0), F.col("_top")))).otherwise(F.col(s))
    return o.with_columns(**{s: value}).select(*[c for c in o.df.columns if c != "_top"])


def anchor_start(points: DataFrame, key="curve_id", t="t", s="s", eps=0.01, min_start=0.999) -> DataFrame:
    """Curves start at (0, 1): a row is added when the first time is above `eps`, the first row replaced when low."""
    return _anchored(Ordered(points, key, t, s), t, s, eps, min_start).df


def _anchored(o: Ordered, t, s, eps, min_start) -> Ordered:
    o = o.row_number("_rn")
    row, start = F.struct(F.col(t).alias("t"), F.col(s).alias("s")), F.struct(F.lit(0.0).alias("t"), F.lit(1.0).alias("s"))
    first = F.col("_rn") == 1
    rows = (F.when(first & (F.col(t) > eps), F.array(start, row))
            .when(first & (F.col(s) < min_start), F.array(start)).otherwise(F.array(row)))
    rest = [c for c in o.df.columns if c not in (t, s, "_rn")]
    return o.select(*rest, F.explode(rows).alias("_p")).select(*rest, F.col("_p.t").alias(t), F.col("_p.s").alias(s))


def monotone_cap(points: DataFrame, key="curve_id", t="t", s="s", top=1.0) -> DataFrame:
    """Each value becomes the smallest value so far, starting from `top`."""
    o = Ordered(points, key, t, s).running(_m=("min", s))
    return o.with_columns(**{s: F.least(F.lit(top), F.col("_m"))}).df.drop("_m")


def monotone_drop(points: DataFrame, key="curve_id", t="t", s="s", tol=0.005, start=1.0) -> DataFrame:
    """Rows above the smallest earlier value by more than `tol` are dropped, the rest clipped to it.

    Neither dropped nor clipped rows lower the running minimum, so the minimum over all earlier rows is exact.
    `start=None` keeps the first row as it is.
    """
    o = Ordered(points, key, t, s).running(before=True, _m=("min", s))
    return _dropped(o, s, tol, start).df.drop("_m")


def _dropped(o: Ordered, s, tol, start) -> Ordered:
    p = F.coalesce("_m", F.col(s)) if start is None else F.least(F.lit(start), F.coalesce("_m", F.lit(start)))
    return o.where(F.col(s) <= p + tol).with_columns(**{s: F.least(F.col(s), p)})


def thin(points: DataFrame, key="curve_id", t="t", s="s", tol_t=0.005, tol_s=0.005, counted=None) -> DataFrame:
    """Keep a row when time advanced or the value fell by more than its tolerance since the last kept row."""

    keys = as_list(key)
    o = Ordered(points.select(*keys, t, s), keys, t, s, counted=counted).lag(_p=t)
    return keep_since(o, F.col("_p").isNull() | (F.col(t) - F.col("_p") > tol_t),
                      lambda last, row: (row[t] - last[t] > tol_t) | (last[s] - row[s] > tol_s), [t, s])


def drop_flat(points: DataFrame, key="curve_id", t="t", s="s", tol=0.001, counted=None) -> DataFrame:
    """Drop inner rows that equal both the last kept and the next value."""
    keys = as_list(key)
    o = Ordered(points.select(*keys, t, s), keys, t, s, counted=counted).lead(_next=s)
    return keep_since(o, F.col("_next").isNull() | (F.abs(F.col("_next") - F.col(s)) > tol), lambda last, row: F.abs(row[s] - last[s]) > tol, [t, s])


def trim_tail_drop(points: DataFrame, key="curve_id", t="t", s="s", stable=0.05, drop=0.1, floor=0.05, counted=None) -> DataFrame:
    """Cut a trailing run that falls to about zero after a flat tail (curves of at least ten rows)."""
    cols = points.columns
    o = Ordered(points, key, t, s, counted=counted).row_number("_rn").total(_n=F.count("*"))
    o = o.with_columns(_i=F.col("_rn") - 1, _from=F.floor(F.col("_n") * 0.8))
    m = F.col("_n") - F.col("_from")
    ends = F.when(m > 5, 3).otherwise(1)
    in_tail, in_end = F.col("_i") >= F.col("_from"), F.col("_i") >= F.col("_n") - ends
    o = o.total(_mean=F.avg(F.when(in_tail & ~in_end, F.col(s))), _std=F.stddev_pop(F.when(in_tail & ~in_end, F.col(s))),
                _end=F.min(F.when(in_end, F.col(s))))
    o = o.total(_ok=F.max(F.when((F.col("_i") > F.col("_from")) & (F.col(s) >= F.col("_mean") - stable), F.col("_i"))))
    cut = ((F.col("_n") >= 10) & (F.col("_n") - F.col("_from") >= 3) & (F.col("_std") < stable)
           & (F.col("_mean") - F.col("_end") > drop) & (F.col("_end") < floor))
    keep = F.col("_i") <= F.coalesce("_ok", "_from")
    return o.where(~F.coalesce(cut, F.lit(False)) | keep).select(*cols).df


def truncate_anomalous_tail(traced: DataFrame, key="curve_id", x="x", y="y", plot_h=100.0) -> DataFrame:
    """Cut a pixel curve where its last 15% falls far faster than the 60..85% stretch did (at least 50 rows)."""
    cols = traced.columns
    o = Ordered(traced, key, x).row_number("_rn").total(_n=F.count("*")).lead(_x2=x, _y2=y)
    i = F.col("_rn") - 1
    tail, ref = F.floor(F.col("_n") * 0.85), F.floor(F.col("_n") * 0.60)
    in_ref = (i >= ref) & (i < tail)
    rx, ry = F.when(in_ref, F.col(x)), F.when(in_ref, F.col(y))
    o = o.total(_y0=F.min_by(y, rx), _y1=F.max_by(y, rx), _x0=F.min(rx), _x1=F.max(rx), _lo=F.min(ry), _hi=F.max(ry))
    slope = F.when(F.col("_x1") != F.col("_x0"),
                   F.try_divide(F.col("_y1") - F.col("_y0"), F.col("_x1") - F.col("_x0"))).otherwise(0.0)
    local = F.try_divide(F.col("_y2") - F.col(y), F.col("_x2") - F.col(x))
    slack = F.greatest(F.lit(20.0), (F.col("_hi") - F.col("_lo")) * 2)
    back = F.col("_y2").between(F.col("_lo") - slack, F.col("_hi") + slack)
    steep = F.when(slope > 0, local > slope * 5).when(slope <= 0.01, local > plot_h * 0.10).otherwise(False)
    bad = (F.col("_n") >= 50) & (tail - ref >= 10) & (i >= tail) & F.col("_x2").isNotNull() & (local > 0) & steep & ~back
    o = o.total(_cut=F.min(F.when(bad, F.col(x))))
    return o.where(F.col("_cut").isNull() | (F.col(x) <= F.col("_cut"))).select(*cols).df


def drop_spikes(traced: DataFrame, key="curve_id", x="x", y="y", plot_h=100.0, frac=0.15) -> DataFrame:
    """Drop single rows that jump away by more than frac * plot_h while the next row returns to within half of it."""
    cols, big = traced.columns, plot_h * frac
    o = Ordered(traced, key, x).lag(_p=y).lead(_q=y).total(_n=F.count("*"))
    spike = (F.col("_n") >= 10) & (F.abs(F.col(y) - F.col("_p")) > big) & (F.abs(F.col("_q") - F.col("_p")) < big * 0.5)
    return o.where(~F.coalesce(spike, F.lit(False))).select(*cols).df


def max_jump_filter(traced: DataFrame, key="curve_id", x="x", y="y", plot_y=0.0, plot_h=100.0, frac=0.3, margin=10) -> DataFrame:
    """Drop rows outside the plot and rows that fall more than frac * plot_h below the last kept row."""
    keys, jump = as_list(key), plot_h * frac
    inside = traced.where(F.col(y).between(plot_y - margin, plot_y + plot_h + margin)).select(*keys, x, y)
    o = Ordered(inside, keys, x, y).running(before=True, _m=("min", y))  # no kept row is higher up than that
    return keep_since(o, F.col("_m").isNull() | (F.col(y) - F.col("_m") <= jump), lambda last, row: row[y] - last[y] <= jump, [x, y])


def by_stretch(rows: DataFrame, order: list[str], lo: str, hi: str, name: str) -> DataFrame:
    """Each row once for every number from `lo` to `hi` (none where that is empty), as the column `name`.

    A task makes the numbers of all its keys stretch by stretch: key after key would give a column of numbers that files hardly compress, while the
    stretch of one key is that of the next. The last stretches come first, as curves end flat and a file's first values decide how it keeps all others.
    Only rows and their stretches are sorted, not what is made of them.
    """
    parts = rows.withColumn("_part", F.explode(F.when(F.col(lo) <= F.col(hi), F.sequence(F.floor(F.col(lo) / STRETCH), F.floor(F.col(hi) / STRETCH)))))
    first = F.greatest(F.col(lo), F.col("_part") * STRETCH)
    last = F.least(F.col(hi), F.col("_part") * STRETCH + (STRETCH - 1))
    return parts.sortWithinPartitions(F.desc("_part"), *order).withColumn(name, F.explode(F.sequence(first, last))).drop("_part")


def fill_linear(traced: DataFrame, key="curve_id", x="x", y="y", counted=None) -> DataFrame:
    """Every x between a curve's first and last, linearly interpolated; `present` tells the measured ones."""
    keys = as_list(key)
    o = Ordered(traced.select(*keys, x, y), keys, x, counted=counted).lead(_x2=x, _y2=y)
    to = F.greatest(F.coalesce(F.col("_x2") - 1, F.col(x)), F.col(x))  # a repeated x gives its own row
    rows = o.df.select(*keys, F.col(x).alias("_x1"), F.col(y).cast("double").alias("_y1"), "_x2", "_y2", to.alias("_to"))
    rows = by_stretch(rows, [*keys, "_x1", "_y1"], "_x1", "_to", "_x").withColumn(x, F.col("_x").cast(dict(traced.dtypes)[x]))
    share = F.try_divide(F.col(x) - F.col("_x1"), F.col("_x2") - F.col("_x1"))
    value = F.when(F.col(x) == F.col("_x1"), F.col("_y1")).otherwise(F.col("_y1") + (F.col("_y2") - F.col("_y1")) * share)
    return rows.select(*keys, x, value.alias(y), (F.col(x) == F.col("_x1")).alias("present"))


def fill_hold(traced: DataFrame, key="curve_id", x="x", y="y", max_gap=100, min_gap=3, min_points=10, counted=None) -> DataFrame:
    """Gaps wider than min_gap and up to max_gap repeat the previous y; short curves pass unchanged."""
    keys = as_list(key)
    o = Ordered(traced.select(*keys, x, y), keys, x, counted=counted).lead(_x2=x).total(_n=F.count("*"))
    gap = F.col("_x2") - F.col(x)
    grid = F.when((F.col("_n") >= min_points) & (gap > min_gap) & (gap <= max_gap),
                  F.sequence(F.col(x), F.col("_x2") - 1)).otherwise(F.array(F.col(x)))
    return o.df.select(*keys, y, F.explode(grid).alias(x)).select(*keys, x, y)


def skip_excursion(traced: DataFrame, key="curve_id", x="x", y="y", jump=15, reach=5, back=10,
                   lookahead=INTERIOR_LOOKAHEAD, min_points=10) -> DataFrame:
    """A jump that returns to the previous level within `lookahead` rows is replaced by a flat stretch."""
    keys = as_list(key)
    kinds = dict(traced.dtypes)
    rows = Ordered(traced.select(*keys, x, y), keys, x, y).total(_n=F.count("*")).df

    def advance(before, buf, out):
        (hx, hy, n), later = buf[0], buf[1:]
        if before is not None and later and n >= min_points and abs(hy - before[1]) > jump and hx - before[0] < reach:
            for j, (fx, fy, _) in enumerate(later[:lookahead - 1]):
                if abs(fy - before[1]) < back:
                    out.extend((fill, before[1]) for fill in range(before[0] + 1, fx))
                    skipped = buf[:j + 1]
                    return skipped[-1][:2], buf[j + 1:]
        out.append((hx, hy))
        return (hx, hy), later

    def step(state, row):
        before, buf = state
        buf = buf + ((row[x], row[y], row["_n"]),)
        out = []
        while len(buf) >= lookahead:
            before, buf = advance(before, buf, out)
        return (before, buf), out

    def finish(state):
        before, buf = state
        out = []
        while buf:
            before, buf = advance(before, buf, out)
        return out

    return fold(rows, keys, [x, y], step, (None, ()), f"{x} {kinds[x]}, {y} {kinds[y]}", finish)


def prepend_shared_start(traced: DataFrame, image="image_id", key="curve_id", x="x", y="y", late=20, near=15) -> DataFrame:
    """Curves that start `late` pixels after the image's first one, near the top, begin where the first one does."""
    firsts = traced.groupBy(image, key).agg(F.min(x).alias("_x0"), F.min(F.struct(x, y)).getField(y).alias("_y0"))
    starts = firsts.groupBy(image).agg(F.min("_x0").alias("_min_x"), F.min("_y0").alias("_top"))
    late_ones = attach(firsts, starts, [image]).where(
        (F.col("_x0") - F.col("_min_x") > late) & (F.col("_y0") - F.col("_top") < near))
    head = late_ones.select(image, key, F.explode(F.sequence("_min_x", F.col("_x0") - 1)).alias(x), F.col("_top").alias(y))
    return traced.select(image, key, x, y).unionByName(head)


def resample(points: DataFrame, key="curve_id", t="t", s="s", step=0.5, t_max=None, counted=None) -> DataFrame:
    """Values on the grid 0, step, 2 step, ... up to the curve's end, linear between rows and held at both ends.

    Each row makes the grid points up to the next row, so no grid table is joined. Single rows pass unchanged. Rows come in no order of curves.
    """
    keys = as_list(key)
    o = Ordered(points.select(*keys, t, s), keys, t, s, counted=counted).lead(_t2=t, _s2=s).row_number("_rn")
    o = o.total(_n=F.count("*"), _end=F.max(t))
    end = F.col("_end") if t_max is None else F.least(F.col("_end"), F.lit(float(t_max)))
    last = F.ceil((end + step) / step) - 1
    lo = F.when(F.col("_rn") == 1, F.lit(0)).otherwise(F.ceil(F.col(t) / step))
    hi = F.when(F.col("_t2").isNull(), last).otherwise(F.least(last, F.ceil(F.col("_t2") / step) - 1))
    rows = o.df.where(F.col("_n") > 1).select(*keys, F.col(t).alias("_t1"), F.col(s).alias("_s1"), "_t2", "_s2", lo.alias("_lo"), hi.alias("_hi"))
    rows = by_stretch(rows, [*keys, "_t1", "_s1"], "_lo", "_hi", "_k").withColumn(t, F.col("_k") * F.lit(float(step)))
    share = F.try_divide(F.col(t) - F.col("_t1"), F.col("_t2") - F.col("_t1"))
    value = F.when((F.col(t) <= F.col("_t1")) | F.col("_t2").isNull(), F.col("_s1")).otherwise(
        F.col("_s1") + (F.col("_s2") - F.col("_s1")) * share)
    return rows.select(*keys, t, value.alias(s)).unionByName(o.df.where(F.col("_n") == 1).select(*keys, t, s))


def step_expand(points: DataFrame, key="curve_id", t="t", s="s") -> DataFrame:
    """Corner points of the step function: each time after the first appears with the old and the new value."""
    keys = as_list(key)
    o = Ordered(points.select(*keys, t, s), keys, t, s).lag(_p=s).row_number("_i")
    corners = F.when(F.col("_p").isNull(), F.array(F.struct(F.lit(1).alias("part"), F.col(s).alias("s")))).otherwise(
        F.array(F.struct(F.lit(0).alias("part"), F.col("_p").alias("s")), F.struct(F.lit(1).alias("part"), F.col(s).alias("s"))))
    return (o.df.select(*keys, t, F.col("_i").alias("seq"), F.explode(corners).alias("_c"))
            .select(*keys, "seq", F.col("_c.part").alias("part"), t, F.col("_c.s").alias(s)))


def find_steps(points: DataFrame, key="curve_id", t="t", s="s", threshold=0.01) -> DataFrame:
    keys = as_list(key)
    o = Ordered(points.select(*keys, t, s), keys, t, s).lag(from_s=s)
    drop = F.col("from_s") - F.col(s)
    return o.df.where(drop > threshold).select(*keys, t, "from_s", F.col(s).alias("to_s"), drop.alias("drop"))


def count_steps_mask(mask: DataFrame, key="curve_id", x="x", y="y", x0=0, every=5, jump=3) -> DataFrame:
    """Steps of a mask: the topmost cell of every `every`-th column against the last sampled column that had one."""
    keys = as_list(key)
    tops = mask.groupBy(*keys, x).agg(F.min(y).alias(y))
    o = Ordered(tops.where((F.col(x) - x0) % every == 0), keys, x).lag(_p=y)
    steps = o.df.groupBy(*keys).agg(F.count_if(F.abs(F.col(y) - F.col("_p")) > jump).alias("steps"))
    return attach(tops.select(*keys).distinct(), steps, keys).withColumn("steps", F.coalesce("steps", F.lit(0)))


def extend_plateau(traced: DataFrame, image="image_id", style="style", x="x", y="y", upper="dashed", lower="solid",
                   plot_w=100.0, plot_h=100.0) -> DataFrame:
    """Hold the upper curve's late level: rows more than 3% below it are lifted, and the curve is extended to the
    lower curve's end (at most 95% of the width). Images without both curves, or with fewer than ten late rows,
    pass unchanged. Output rows carry `present`; added ones are not present.
    """
    cols = [image, style, x, y]
    rows = traced.select(*cols).withColumn(y, F.col(y).cast("double"))
    o = Ordered(rows, [image, style], x).row_number("_rn").total(_n=F.count("*"))
    late = (F.col(style) == upper) & (F.col("_rn") - 1 >= F.floor(F.col("_n") * 0.60))
    o = o.with_columns(_late=late)
    base = o.df
    level = base.groupBy(image).agg(
        F.count_if("_late").alias("_k"), F.min(F.when(F.col("_late"), F.col(y))).alias("_py"),
        F.max(F.when(F.col(style) == upper, F.col(x))).alias("_ux"), F.max(F.when(F.col(style) == lower, F.col(x))).alias("_lx"))
    marked = attach(base, level, [image])
    near = F.col("_late") & (F.abs(F.col(y) - F.col("_py")) < plot_h * 0.02)
    start = marked.groupBy(image).agg(F.min(F.when(near, F.col(x))).alias("_from"))
    marked = attach(marked, start, [image])
    under = marked.groupBy(image).agg(F.avg(F.when((F.col(style) == lower) & (F.col(x) >= F.col("_from")), F.col(y))).alias("_mean"))
    plan = attach(attach(level, start, [image]), under, [image]).where((F.col("_k") >= 10) & F.col("_lx").isNotNull())
    flat = F.when(F.col("_py") > F.col("_mean") - plot_h * 0.05, F.col("_mean") - plot_h * 0.10).otherwise(F.col("_py"))
    plan = plan.select(image, "_from", "_ux", F.least(F.col("_lx"), F.lit(int(plot_w * 0.95))).alias("_to"), flat.alias("_flat"))
    fixed = attach(base.select(*cols), plan, [image])
    low = (F.col(style) == upper) & (F.col(x) >= F.col("_from")) & (F.col(y) > F.col("_flat") + plot_h * 0.03)
    fixed = fixed.select(image, style, x, F.when(low, F.col("_flat")).otherwise(F.col(y)).alias(y), F.lit(True).alias("present"))
    more = plan.where(F.col("_to") > F.col("_ux")).select(
        image, F.lit(upper).alias(style), F.explode(F.sequence(F.col("_ux") + 1, F.col("_to").cast(dict(traced.dtypes)[x]))).alias(x),
        F.col("_flat").alias(y), F.lit(False).alias("present"))
    return fixed.unionByName(more)


def clean_curve(points: DataFrame, key="curve_id", t="t", s="s", dedup="continuity", monotone="cap",
                min_start=0.999, tol=0.005, trim=True) -> DataFrame:
    """Dedup, rescale, anchor at (0, 1), make non-increasing, thin and trim.

    dedup: continuity | median | min | bin; monotone: cap | drop. The rescale, anchor and monotone steps share
    one shuffle and one sort.
    """
    keys = as_list(key)
    points = clip_negative_time(points.select(*keys, t, s), t) if dedup in ("continuity", "median") else points.select(*keys, t, s)
    rows = {"continuity": dedup_continuity, "median": dedup_median, "min": dedup_min, "bin": bin_median}[dedup](points, key, t, s)
    o = Ordered(rows, keys, t, counted=points)
    if dedup == "bin":
        return o.running(_m=("min", s)).with_columns(**{s: F.least(F.lit(1.0), F.col("_m"))}).df.drop("_m")
    o = _rescaled(o.total(_top=F.max(s)), s)
    o = _anchored(o, t, s, 0.01, min_start)
    if monotone == "cap":
        o = o.running(_m=("min", s)).with_columns(**{s: F.least(F.lit(1.0), F.col("_m"))})
    else:
        o = _dropped(o.running(before=True, _m=("min", s)), s, tol, 1.0)
    out = thin(o.df.drop("_m"), key, t, s, tol, tol, counted=points)
    return trim_tail_drop(out, key, t, s, counted=points) if trim else out
