"""Operators on the curves of one image: divergence, merging, ordering, crossings, labels."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ordered import Ordered
from ..runtime import as_list, attach
from .joins import side_by_side


def divergence_time(points, image="image_id", style="style", a="a", b="b", t="t", s="s", threshold=0.02,
                    digits=3, never="after") -> DataFrame:
    """First common time with a difference above `threshold`; if none, the last common time + 1 or null."""
    wide = side_by_side(points, image, style, a, b, t, s, digits)
    first = F.min(F.when(F.abs(F.col("y1") - F.col("y2")) > threshold, F.col(t)))
    none = F.max(t) + 1 if never == "after" else F.lit(None)
    return wide.groupBy(*as_list(image)).agg(F.count("*").alias("common"), F.coalesce(first, none).alias("t_div"))


def merge_overlap(points, image="image_id", style="style", a="a", b="b", t="t", s="s", threshold=0.02) -> DataFrame:
    """Before the divergence both curves take the mean at common times and copy each other's single times.

    Images without a common time pass unchanged.
    """
    images = as_list(image)
    until = divergence_time(points, image, style, a, b, t, s, threshold).select(*images, "t_div")
    full = attach(side_by_side(points, image, style, a, b, t, s, how="full"), until, images).where(F.col(t) < F.col("t_div"))
    both = F.col("y1").isNotNull() & F.col("y2").isNotNull()
    shared = full.where(both).select(*images, F.col(t).alias("_tk"), ((F.col("y1") + F.col("y2")) / 2).alias("_m"))
    rows = attach(points.select(*images, style, t, s, F.round(t, 3).alias("_tk")), shared, images + ["_tk"])
    mine = F.col(style).isin(a, b) & F.col("_m").isNotNull()
    rows = rows.select(*images, style, t, F.when(mine, F.col("_m")).otherwise(F.col(s)).alias(s))
    alone = full.where(~both).select(*images, F.when(F.col("y1").isNull(), a).otherwise(b).alias(style), t,
                                     F.coalesce("y1", "y2").alias(s))
    return rows.unionByName(alone)


def fix_ordering(points, image="image_id", style="style", upper="dashed", lower="solid", t="t", s="s",
                 threshold=0.01, slack=0.001, least=5, keep_unmatched=False) -> DataFrame:
    """Swap values after the divergence where the upper curve lies below, if most points are ordered.

    As soon as an image needs one swap only its common times survive, unless `keep_unmatched`.
    """
    images = as_list(image)
    wide = side_by_side(points, image, style, upper, lower, t, s, digits=None)
    until = divergence_time(points, image, style, upper, lower, t, s, threshold, None, "null")
    wide = attach(wide, until, images)
    late = F.coalesce(F.col(t) >= F.col("t_div"), F.lit(False))
    wrong = late & (F.col("y1") < F.col("y2") - slack)
    votes = wide.groupBy(*images).agg(F.count_if(wrong).alias("_bad"), F.count_if(late & ~wrong).alias("_good"),
                                      F.max("common").alias("_n"))
    act = (F.col("_n") >= least) & (F.col("_bad") > 0) & (F.col("_good") >= F.col("_bad"))
    acting = votes.where(act).select(*images, F.lit(True).alias("_act"))
    fixed = attach(wide, acting, images).where("_act").withColumn("_w", wrong)
    pairs = F.array(F.struct(F.lit(upper).alias("k"), F.when(F.col("_w"), F.col("y2")).otherwise(F.col("y1")).alias("v")),
                    F.struct(F.lit(lower).alias("k"), F.when(F.col("_w"), F.col("y1")).otherwise(F.col("y2")).alias("v")))
    fixed = fixed.select(*images, t, F.explode(pairs).alias("_p")).select(*images, F.col("_p.k").alias(style), t, F.col("_p.v").alias(s))
    rest = attach(points.select(*images, style, t, s), acting, images)
    if keep_unmatched:
        matched = wide.select(*images, t).withColumn("_m", F.lit(True))
        rest = attach(rest, matched, images + [t]).where(
            F.col("_act").isNull() | F.col("_m").isNull() | ~F.col(style).isin(upper, lower)).drop("_m")
    else:
        rest = rest.where(F.col("_act").isNull() | ~F.col(style).isin(upper, lower))
    return rest.drop("_act").unionByName(fixed)


def crossings(traced, names: list[str], image="image_id", style="style", x="x", y="y") -> DataFrame:
    """Places where the order of two of the named curves flips between their consecutive common x.

    One row per (image, x) holds all named curves as columns, so every pair is compared inside a row and only
    real crossings become rows.
    """
    images = as_list(image)
    aggs = [F.max(F.when(F.col(style) == n, F.col(y))).alias(f"_y{i}") for i, n in enumerate(names)]
    o = Ordered(traced.where(F.col(style).isin(*names)).groupBy(*images, x).agg(*aggs), images, x)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    o = o.with_columns(**{f"_d{i}_{j}": F.col(f"_y{i}") - F.col(f"_y{j}") for i, j in pairs})
    o = o.running(before=True, **{f"_p{i}_{j}": ("last", f"_d{i}_{j}") for i, j in pairs})
    found = F.array_compact(F.array(*[
        F.when(F.col(f"_d{i}_{j}") * F.col(f"_p{i}_{j}") < 0,
               F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"))) for i, j in pairs]))
    return o.df.select(*images, x, F.explode(found).alias("_c")).select(
        *images, x, F.col("_c.a").alias("curve_a"), F.col("_c.b").alias("curve_b"))


def _swapped(traced, swaps, images, style, a, b, x, y) -> DataFrame:
    """Points with the values of a and b exchanged at the (image, x) rows of `swaps` (columns y1, y2)."""
    rows = attach(traced.select(*images, style, x, y), swaps.select(*images, x, "y1", "y2"), images + [x])
    value = (F.when(F.col("y1").isNotNull() & (F.col(style) == a), F.col("y2"))
             .when(F.col("y1").isNotNull() & (F.col(style) == b), F.col("y1")).otherwise(F.col(y)))
    return rows.select(*images, style, x, value.alias(y))


def reorder_segments(traced, image="image_id", style="style", a="a", b="b", x="x", y="y", plot_h=100.0) -> DataFrame:
    """Swap every common x whose order contradicts the one voted by the first third of the common columns."""
    images = as_list(image)
    o = Ordered(side_by_side(traced, image, style, a, b, x, y, None), images, x).row_number("_rn").total(_n=F.count("*"))
    diff = F.col("y1") - F.col("y2")
    early = F.col("_rn") <= F.greatest(F.lit(30), F.expr("_n div 3"))
    apart = early & (F.abs(diff) > plot_h * 0.03)
    o = o.total(_k=F.count_if(apart), _m1=F.avg(F.when(apart, diff)), _m0=F.avg(F.when(early, diff)))
    below = F.when(F.col("_k") >= 5, F.col("_m1")).otherwise(F.col("_m0")) > 0
    swaps = o.df.where((F.col("_n") >= 5) & ((F.col("y1") > F.col("y2")) != below))
    return _swapped(traced, swaps, images, style, a, b, x, y)


def swap_where(traced, image="image_id", style="style", upper="dashed", lower="solid", x="x", y="y", slack=3, least=20) -> DataFrame:
    """Swap the two curves wherever the upper one lies more than `slack` pixels below (at least 20 common x)."""
    images = as_list(image)
    wide = side_by_side(traced, image, style, upper, lower, x, y, None)
    enough = wide.groupBy(*images).agg(F.count("*").alias("_n"))
    swaps = attach(wide, enough, images).where((F.col("_n") >= least) & (F.col("y1") > F.col("y2") + slack))
    return _swapped(traced, swaps, images, style, upper, lower, x, y)


def _segments(traced, images, style, a, b, x, y, min_sep) -> Ordered:
    """Common columns in order with `_seg`, null where the curves are closer than `min_sep`."""
    o = Ordered(side_by_side(traced, images, style, a, b, x, y, None), images, x)
    sep = F.col("y2") - F.col("y1")
    o = o.with_columns(_above=F.when(F.abs(sep) >= min_sep, sep > 0)).lag(_prev="_above")
    start = F.col("_above").isNotNull() & (F.col("_prev").isNull() | (F.col("_prev") != F.col("_above")))
    return o.islands("_seg", start)


def order_segments(traced, image="image_id", style="style", a="a", b="b", x="x", y="y", min_sep=3) -> DataFrame:
    """Maximal runs of common columns in which curve a stays above (or below) curve b by at least `min_sep`."""
    images = as_list(image)
    o = _segments(traced, images, style, a, b, x, y, min_sep)
    return (o.df.where(F.col("_above").isNotNull()).groupBy(*images, F.col("_seg").alias("segment"))
            .agg(F.min(x).alias("x_from"), F.max(x).alias("x_to"), F.count("*").alias("columns"), F.bool_and("_above").alias("a_above")))


def swap_segments_by_evidence(traced, mask, image="image_id", style="style", a="a", b="b", x="x", y="y", min_sep=3) -> DataFrame:
    """Segments vote which curve is dashed (mask cells within one pixel); segments that disagree are swapped."""
    images = as_list(image)
    rows = _segments(traced, images, style, a, b, x, y, min_sep).df.where(F.col("_above").isNotNull())
    rows = rows.select(*images, x, "y1", "y2", "_seg")
    cells = mask.select(*images, F.col("x").alias(x), F.col("y").alias("_y")).distinct().withColumn("_m", F.lit(1))
    spots = F.array(*[F.struct(F.lit(c).alias("c"), (F.col(v).cast("int") + d).alias("y")) for c, v in (("d1", "y1"), ("d2", "y2")) for d in (-1, 0, 1)])
    hits = attach(rows.select(*images, x, "_seg", F.explode(spots).alias("_s")).select(*images, x, "_seg", "_s.c", F.col("_s.y").alias("_y")),
                  cells, images + [x, "_y"])
    dash = hits.groupBy(*images, "_seg").agg(F.count(F.when(F.col("c") == "d1", F.col("_m"))).alias("d1"),
                                             F.count(F.when(F.col("c") == "d2", F.col("_m"))).alias("d2"),
                                             (F.count("*") / 6).cast("bigint").alias("n"))
    weight = F.col("n") * F.greatest(F.lit(1), F.abs(F.col("d1") - F.col("d2")))
    votes = dash.where("n >= 5").groupBy(*images).agg(
        (F.coalesce(F.sum(F.when(F.col("d1") > F.col("d2"), weight)), F.lit(0))
         > F.coalesce(F.sum(F.when(F.col("d2") > F.col("d1"), weight)), F.lit(0))).alias("_first"))
    enough = side_by_side(traced, image, style, a, b, x, y, None).groupBy(*images).agg(F.count("*").alias("_n"))
    wrong = attach(attach(dash, votes, images), enough, images).where(
        (F.col("n") >= 3) & (F.col("_n") >= 10) & ((F.col("d1") > F.col("d2")) != F.col("_first"))).select(*images, "_seg", F.lit(True).alias("_w"))
    swaps = attach(rows, wrong, images + ["_seg"]).where("_w")
    return _swapped(traced, swaps, images, style, a, b, x, y)


def fix_continuity(traced, image="image_id", style="style", a="a", b="b", x="x", y="y", window=10, jump=15, sep=30, least=20) -> DataFrame:
    """Exchange the curves in regions where swapping reduces both jumps.

    A region starts after the first jumping column whose swap helps and reaches the last such column before the
    curves run calmly again. Between two calm steps there is at most one region, so regions are islands of columns
    split at the calm steps and no step-by-step walk is needed.
    """
    images = as_list(image)
    low = F.min(F.when(F.col(style) == a, F.col(y)))
    high = F.max(F.when(F.col(style) == b, F.col(y)))
    wide = traced.where(F.col(style).isin(a, b)).groupBy(*images, x).agg(low.alias("y1"), high.alias("y2"))
    o = Ordered(wide.where(F.col("y1").isNotNull() & F.col("y2").isNotNull()), images, x)
    o = o.row_number("_i").total(_n=F.count("*")).lead(_z1="y1", _z2="y2", _x2=x)
    j1, j2 = F.abs(F.col("_z1") - F.col("y1")), F.abs(F.col("_z2") - F.col("y2"))
    helps = (F.abs(F.col("_z2") - F.col("y1")) < j1) & (F.abs(F.col("_z1") - F.col("y2")) < j2)
    calm = ~helps & (j1 <= jump) & (j2 <= jump)
    trigger = helps & (F.abs(F.col("y1") - F.col("y2")) < sep) & ((j1 > jump) | (j2 > jump)) & (F.col("_i") <= F.col("_n") - window)
    o = o.with_columns(_helps=helps, _calm=calm, _trigger=trigger).islands("_block", F.col("_calm"))
    blocks = o.df.groupBy(*images, "_block").agg(
        F.max(F.when(F.col("_helps"), F.struct("_i", "_x2"))).alias("_l"), F.max("_n").alias("_n"))
    rows = attach(o.df.where("_trigger").select(*images, "_block", "_i", "_x2"), blocks, images + ["_block"])
    regions = rows.where((F.col("_n") >= least) & (F.col("_i") < F.col("_l._i"))).groupBy(*images, "_block").agg(
        F.min(F.struct("_i", "_x2")).alias("_f"), F.max("_l._x2").alias("_to"))
    spans = regions.select(*images, F.col("_f._x2").alias("_from"), "_to")
    # regions of an image are disjoint: the last one starting at or before x decides
    p = traced.select(*images, style, x, y).withColumns({"_g": F.lit(1), "_to": F.lit(None).cast(dict(traced.dtypes)[x])})
    g = spans.select(*images, F.lit(None).cast("string").alias(style), F.col("_from").alias(x),
                     F.lit(None).cast(dict(traced.dtypes)[y]).alias(y), F.lit(0).alias("_g"), "_to")
    m = Ordered(p.unionByName(g), images, x, ["_g"]).running(_end=("last", "_to"))
    inside = F.coalesce(F.col(x) <= F.col("_end"), F.lit(False))
    other = F.when(inside & (F.col(style) == a), b).when(inside & (F.col(style) == b), a).otherwise(F.col(style))
    return m.df.where("_g = 1").select(*images, other.alias(style), x, y)


def relabel_by_overlap(curves, overlaps, image="image_id", key="curve_id", style="style", ratio="ratio", dashed="dashed") -> DataFrame:
    """In images of two curves the one with the larger mask share gets the dashed label, if that is not so yet."""
    rows = attach(curves, overlaps.select(image, key, ratio), [image, key])
    o = rows.groupBy(image).agg(F.count("*").alias("_n"), F.min(F.struct(key, ratio, style)).alias("_a"), F.max(F.struct(key, ratio, style)).alias("_b"))
    r0, r1 = F.col(f"_a.{ratio}"), F.col(f"_b.{ratio}")
    first = r0 > r1
    swap = (F.col("_n") == 2) & r0.isNotNull() & r1.isNotNull() & (first != F.contains(F.lower(F.col(f"_a.{style}")), F.lit(dashed)))
    o = o.select(image, swap.alias("_swap"), F.col(f"_a.{style}").alias("_s0"), F.col(f"_b.{style}").alias("_s1"), F.col(f"_a.{key}").alias("_k0"))
    out = attach(rows, o, [image])
    sibling = F.when(F.col(key) == F.col("_k0"), F.col("_s1")).otherwise(F.col("_s0"))
    return out.select(*curves.columns, F.when(F.col("_swap"), sibling).otherwise(F.col(style)).alias("new_style"))


# The columns of the plot, and the grey levels, gaps and limits by which a line counts as dashed.
BAND = (0.40, 0.70)
BAND_COLUMNS, BAND_TRACED = 30, 10
BAND_DARK, BAND_LEAST, BAND_RATIO = 150, 0.1, 1.3
MIDDLE = (0.25, 0.85)
CURVE_COLUMNS, MIDDLE_COLUMNS, SAMPLES = 50, 30, 200
DARK_SHARE, GAP, GAPS_FOR_REGULARITY = 0.3, 2, 3
DASH_RATIO, DASH_GAPS = (0.15, 0.40), (5, 30)
SCORE_APART = 0.2


def _darkest(asked, pixels, images, image, half=2) -> DataFrame:
    """Rows of `asked` whose (x, y) lies in the picture, with `gray`: the darkest pixel at most `half` rows above or below (255 where there is none).

    A position asks for five cells, so no pairs are made; many curves that ask for a position ask once.
    """
    spot = attach(asked.select(image, "x", "y").distinct(), images.select(image, "width", "height"), [image])
    spot = spot.where((F.col("x") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") >= 0) & (F.col("y") < F.col("height")))
    near = spot.select(image, "x", "y", F.explode(F.sequence(F.col("y") - half, F.col("y") + half)).alias("_y"))
    cells = pixels.groupBy(image, "x", F.col("y").alias("_y")).agg(F.min("gray").alias("_gray"))
    found = attach(near, cells, [image, "x", "_y"]).groupBy(image, "x", "y").agg(F.coalesce(F.min("_gray"), F.lit(255)).alias("gray"))
    return attach(asked, found, [image, "x", "y"]).where("gray is not null")


def dash_evidence(traced, pixels, plots, images, image="image_id", key="curve_id") -> DataFrame:
    """One row per traced curve: how dark the picture is along it.

    `density`: share of dark columns in the middle band of the plot at the height where the curve leaves it; null where band or curve is too short.
    `gap_ratio`, `n_gaps`, `regularity`: light stretches between dark ones along the curve itself, `dash_score`: how much they look like dashes; all 0
    for curves of few columns. traced: image, curve, x, y; pixels: image, x, y, gray; plots: image, px, pw; images: image, width, height. Of several rows of
    a curve in a column the topmost counts. Null positions count as none. Windows hold one curve of one picture, at most a row for each of its columns.
    """
    path = traced.where("x is not null and y is not null").groupBy(image, key, F.col("x").cast("int").alias("x")).agg(F.min(F.floor("y").cast("int")).alias("y"))
    span = [(F.col("px") + F.floor(F.col("pw") * f)).cast("int") for f in BAND]
    band = attach(path, plots.select(image, span[0].alias("_from"), span[1].alias("_to")), [image]).where((F.col("x") >= F.col("_from")) & (F.col("x") < F.col("_to")))
    ends = band.groupBy(image, key, "_from", "_to").agg(F.count("*").alias("_n"), F.max(F.struct("x", "y")).getField("y").alias("y"))
    ends = ends.where((F.col("_to") - F.col("_from") >= BAND_COLUMNS) & (F.col("_n") >= BAND_TRACED))
    level = ends.select(image, key, "y", (F.col("_to") - F.col("_from")).alias("_wide"), F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("x"))

    n = Window.partitionBy(image, key)
    o = n.orderBy("x")
    lo, hi = F.floor(F.col("_n") * MIDDLE[0]), F.floor(F.col("_n") * MIDDLE[1])
    mid = path.withColumns({"_n": F.count("*").over(n), "_i": F.row_number().over(o) - 1})
    mid = mid.where((F.col("_n") >= CURVE_COLUMNS) & (hi - lo >= MIDDLE_COLUMNS) & (F.col("_i") >= lo) & (F.col("_i") < hi))
    step = F.greatest(F.lit(1), F.floor((hi - lo) / SAMPLES))
    mid = mid.where((F.col("_i") - lo) % step == 0)

    cols = [image, key, "x", "y", "_wide"]
    seen = _darkest(level.select(*cols).unionByName(mid.select(image, key, "x", "y", F.lit(None).cast("int").alias("_wide"))), pixels, images, image)
    seen = attach(seen, images.select(image, F.col("height").alias("_h")), [image])
    # heights at the picture's edge count as light
    inner = (F.col("y") >= 3) & (F.col("y") < F.col("_h") - 3)
    dark = seen.where("_wide is not null").groupBy(image, key).agg((F.count_if(inner & (F.col("gray") < BAND_DARK)) / F.max("_wide")).alias("density"))

    along = seen.where("_wide is null").withColumns({"_m": F.count("*").over(n), "_limit": F.percentile("gray", DARK_SHARE).over(n), "_k": F.row_number().over(o)})
    along = along.where(F.col("_m") >= MIDDLE_COLUMNS).withColumn("_dark", F.col("gray") < F.col("_limit"))
    along = along.withColumn("_run", F.sum(F.coalesce(F.col("_dark") != F.lag("_dark").over(o), F.lit(False)).cast("int")).over(o))
    runs = along.groupBy(image, key, "_run", "_m", "_dark").agg(F.count("*").alias("_size"), F.min("_k").alias("_a"), F.max("_k").alias("_b"))
    # a stretch counts up to the next dark column; the first column only leads
    long = F.col("_size") - (F.col("_a") == 1).cast("int")
    gap = F.when(~F.col("_dark") & (F.col("_b") < F.col("_m")) & (long >= GAP), long)
    gaps = runs.groupBy(image, key).agg((F.sum(F.when(~F.col("_dark"), F.col("_size")).otherwise(0)) / F.max("_m")).alias("gap_ratio"),
                                        F.count(gap).alias("n_gaps"), (F.stddev_pop(gap) / F.avg(gap)).alias("_cv"))
    regular = F.when((F.col("n_gaps") >= GAPS_FOR_REGULARITY) & (F.col("_cv") < 1), 1 - F.col("_cv")).otherwise(0.0)
    gaps = gaps.select(image, key, "gap_ratio", "n_gaps", regular.alias("regularity"))
    out = attach(attach(path.select(image, key).distinct(), dark, [image, key]), gaps, [image, key])
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast(dict(gaps.dtypes)[c])) for c in ("gap_ratio", "n_gaps", "regularity")})
    ratio, many = F.col("gap_ratio"), F.col("n_gaps")
    score = (F.col("regularity") * 3.0
             + F.when(ratio.between(*DASH_RATIO), 1.0).when(ratio > DASH_RATIO[1], 0.5 * (1.0 - F.least(F.lit(1.0), (ratio - DASH_RATIO[1]) / 0.30))).otherwise(0.0)
             + F.when(many.between(*DASH_GAPS), 0.8).when(many > DASH_GAPS[1], -(many - DASH_GAPS[1]) / 50.0).otherwise(0.0))
    return out.withColumn("dash_score", F.greatest(F.lit(0.0), score))


def relabel_by_evidence(curves, evidence, image="image_id", key="curve_id", style="style") -> DataFrame:
    """`curves` with `new_style`, `decided_by` and `sure`: in images of two curves, the one that looks dashed in the picture (`dash_evidence`) is called so.

    A clearly lighter middle band decides first (`density`), then clearly different dash scores (`gaps`); otherwise, and in images of more or fewer
    curves, styles stay and `decided_by` is null.
    """
    rows = attach(curves, evidence.select(image, key, "density", "dash_score"), [image, key])
    side = F.struct(F.col(key).alias("k"), F.col("density").alias("d"), F.coalesce("dash_score", F.lit(0.0)).alias("s"))
    two = rows.groupBy(image).agg(F.count("*").alias("_n"), F.min(side).alias("_p"), F.max(side).alias("_q")).where("_n = 2")
    d0, d1, s0, s1 = (F.col(c) for c in ("_p.d", "_q.d", "_p.s", "_q.s"))
    by_band = F.when(F.greatest(d0, d1) > BAND_LEAST, F.when(d0 > d1 * BAND_RATIO, F.col("_q.k")).when(d1 > d0 * BAND_RATIO, F.col("_p.k")))
    by_band = F.when(d0.isNotNull() & d1.isNotNull(), by_band)
    by_gaps = F.when(F.abs(s0 - s1) > SCORE_APART, F.when(s0 > s1, F.col("_p.k")).otherwise(F.col("_q.k")))
    two = two.select(image, by_band.alias("_band"), by_gaps.alias("_gaps"))
    out = attach(curves, two, [image])
    dashed = F.coalesce("_band", "_gaps")
    return out.select(*curves.columns, F.when(dashed.isNull(), F.col(style)).when(F.col(key) == dashed, "dashed").otherwise("solid").alias("new_style"),
                      F.when(F.col("_band").isNotNull(), "density").when(F.col("_gaps").isNotNull(), "gaps").alias("decided_by"),
                      F.when(F.col("_band").isNotNull(), 0.85).when(F.col("_gaps").isNotNull(), 0.7).alias("sure"))


def swap_labels(curves, image="image_id", key="curve_id", name="name", style="style") -> DataFrame:
    """Exchange name and style between the two curves of an image; other images stay as they are."""
    o = curves.groupBy(image).agg(F.count("*").alias("_n"), F.min(F.struct(key, name, style)).alias("_a"), F.max(F.struct(key, name, style)).alias("_b"))
    rows = attach(curves, o, [image])
    other = F.when(F.col(key) == F.col(f"_a.{key}"), F.col("_b")).otherwise(F.col("_a"))
    pick = lambda c: F.when(F.col("_n") == 2, other.getField(c)).otherwise(F.col(c)).alias(c)
    return rows.select(*[pick(c) if c in (name, style) else F.col(c) for c in curves.columns])


def curve_separation(points, t_max, image="image_id", style="style", a="a", b="b", t="t", s="s", least=0.02) -> DataFrame:
    """Difference of two curves at 25, 50 and 75% of the time range; merged when it never reaches `least`.

    A value is the last one at or before the sample time, or the first one; all come from one aggregation.
    """
    images = as_list(image)
    aggs = []
    for k in (a, b):
        mine = F.col(style) == k
        for i, f in enumerate((0.25, 0.5, 0.75)):
            at = F.max(F.when(mine & (F.col(t) <= t_max * f), F.struct(t, s))).getField(s)
            aggs.append(F.coalesce(at, F.min(F.when(mine, F.struct(t, s))).getField(s)).alias(f"_{k}{i}"))
    w = points.groupBy(*images).agg(*aggs)
    d = [F.abs(F.col(f"_{a}{i}") - F.col(f"_{b}{i}")) for i in range(3)]
    w = w.withColumns({"avg_diff": (d[0] + d[1] + d[2]) / 3, "max_diff": F.greatest(*d)})
    status = F.when(F.col("max_diff") >= least, "PASS").otherwise("WARNING")
    return w.select(*images, "avg_diff", "max_diff", status.alias("status"))
