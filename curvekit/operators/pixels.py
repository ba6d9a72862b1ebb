"""Predicates and aggregates over pixel rows (image_id, x, y, b, g, r [, h, s, v, gray]).

Rasters are sparse: a missing cell is white. Image sizes come from `images` (image_id, width, height). A cell
appears once per image, so anything grouped by (image, column) or (image, row) is bounded by the picture's height
or width, and a large image still spreads over its columns.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..islands import two_way
from ..functions import color as c
from ..ordered import Ordered, exact_median
from ..runtime import as_list, attach


def with_hsv(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns(c.hsv(F.col("b"), F.col("g"), F.col("r")))


def color_mask(pixels, name: str) -> DataFrame:
    return pixels.where(c.in_range(c.NAMED[name]))


def classify_color(pixels, first_only=False) -> DataFrame:
    """One row per pixel and colour class it falls in (two where inclusive ranges meet), or only the first class."""
    found = F.array_compact(F.array(*[F.when(c.in_range(spec), F.lit(n)) for n, spec in c.CLASSES.items()]))
    labels = F.slice(found, 1, 1) if first_only else found
    return pixels.select("*", F.explode(labels).alias("color"))


def in_plot(pixels, bounds: DataFrame, margin=0, image="image_id") -> DataFrame:
    """Pixels inside the plot rectangle (px, py, pw, ph) of their image, widened by `margin`."""
    rows = attach(pixels, bounds.select(image, "px", "py", "pw", "ph"), [image])
    return rows.where(F.col("x").between(F.col("px") - margin, F.col("px") + F.col("pw") + margin)
                      & F.col("y").between(F.col("py") - margin, F.col("py") + F.col("ph") + margin)).drop("px", "py", "pw", "ph")


# Zones as fractions (x_from, x_to, y_from, y_to) of the picture that hold legends or axis strips.
LEGEND_ZONES = [(0.15, 1.0, 0.0, 0.20), (0.35, 1.0, 0.0, 0.35)]
TRACKING_ZONES = [(0.75, 1.0, 0.0, 0.15), (0.0, 1.0, 0.95, 1.0)]
LEGEND_BOX = [(0.3, 1.0, 0.0, 0.25)]


def drop_zones(pixels, images, zones=LEGEND_ZONES, image="image_id") -> DataFrame:
    """Drop pixels in any zone; zone edges are cut to whole pixels."""
    rows = attach(pixels, images.select(image, "width", "height"), [image])
    edge = lambda size, f: F.floor(F.col(size) * f)
    inside = [(F.col("x") >= edge("width", a)) & (F.col("x") < edge("width", b))
              & (F.col("y") >= edge("height", t)) & (F.col("y") < edge("height", u)) for a, b, t, u in zones]
    return rows.where(~reduce(lambda p, q: p | q, inside)).drop("width", "height")


def drop_margins(pixels, images, left=15, right=5, bottom=20, image="image_id") -> DataFrame:
    rows = attach(pixels, images.select(image, "width", "height"), [image])
    return rows.where((F.col("x") >= left) & (F.col("x") < F.col("width") - right)
                      & (F.col("y") < F.col("height") - bottom)).drop("width", "height")


def dark_pixels(pixels, threshold=128, channels=False) -> DataFrame:
    """gray < threshold, or every channel below it."""
    if channels:
        return pixels.where((F.col("b") < threshold) & (F.col("g") < threshold) & (F.col("r") < threshold))
    return pixels.where(F.col("gray") < threshold)


def gaussian_weights(block: int) -> list[float]:
    """Weights of a row or column of the neighbourhood, sum 1; the width of the bell follows from the block."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - block // 2) ** 2) / (2 * sigma * sigma)) for i in range(block)]
    return [v / sum(raw) for v in raw]


def adaptive_dark(pixels, block=15, offset=10, image="image_id", weights="gaussian") -> DataFrame:
    """Pixels darker than the mean of their block x block neighbourhood by at least `offset`; `weights` is "gaussian" or "even".

    Missing cells are white, so only darkness (255 - gray) is summed. Both kernels separate: each cell gives its darkness to the columns of its row within
    reach, then the rows are added up, by a running range over each column (even weights) or by giving on to the rows within reach.
    """
    r = block // 2
    bell = F.array(*[F.lit(v) for v in (gaussian_weights(block) if weights == "gaussian" else [1.0 / block] * block)])

    def given(to: str, other: str, frame):
        steps = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.struct((F.col(to) + i - r).alias("at"), (F.col("_d") * F.get(bell, i)).alias("d")))
        return frame.select(image, other, F.explode(steps).alias("_s")).groupBy(image, F.col("_s.at").alias(to), other).agg(F.sum("_s.d").alias("_d"))

    dark = pixels.select(image, "x", "y", (255 - F.col("gray")).alias("_d"))
    if weights == "gaussian":
        near = given("y", "x", given("x", "y", dark)).withColumnRenamed("_d", "_n")
        mean = 255 - F.col("_n")
    else:
        spread = dark.select(image, "y", "_d", F.explode(F.sequence(F.col("x") - r, F.col("x") + r)).alias("x"))
        w = Window.partitionBy(image, "x").orderBy("y").rangeBetween(-r, r)
        near = spread.groupBy(image, "x", "y").agg(F.sum("_d").alias("_d")).withColumn("_n", F.sum("_d").over(w)).select(image, "x", "y", "_n")
        mean = 255 - F.col("_n") / (block * block)
    got = attach(pixels, near, [image, "x", "y"])
    return got.where(F.col("gray") <= mean - offset).drop("_n")


def remove_colors(pixels, colors: list[str]) -> DataFrame:
    """Named colours become white, which in a sparse raster means their pixels are left out."""
    found = [m for m in (c.isolated(n) for n in colors if n not in ("black", "gray")) if m is not None]
    return pixels.where(~reduce(lambda a, b: a | b, found)) if found else pixels


def isolate_color(pixels, name: str) -> DataFrame:
    mask = c.isolated(name)
    return pixels.where(F.lit(False)) if mask is None else pixels.where(mask)


def isolate_curve(pixels, name: str, others: list[str] = ()) -> DataFrame:
    """The pixels of one curve: its colour, or for dark curves what is dark once other colours are removed."""
    if name in ("black", "gray"):
        cleaned = remove_colors(pixels, [o for o in others if o not in ("black", "gray", "white")])
        turned = c.hsv(*[255 - F.col(k) for k in ("b", "g", "r")])
        return cleaned.where((turned["v"] > 200) & (turned["s"] < 50))
    return color_mask(pixels, name)


def invert(pixels) -> DataFrame:
    return pixels.withColumns({k: 255 - F.col(k) for k in ("b", "g", "r")})


def content_bbox(pixels, images, margin=5, white=250, image="image_id") -> DataFrame:
    """Bounding box of the non-white cells plus a margin, cut to the picture; the whole picture if it is empty."""
    box = pixels.where(F.col("gray") < white).groupBy(image).agg(
        F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    rows = attach(images.select(image, "width", "height"), box, [image])
    zero = F.lit(0)
    return rows.select(image, F.coalesce(F.greatest(zero, F.col("a") - margin), zero).alias("x1"),
                       F.coalesce(F.least("width", F.col("b") + 1 + margin), "width").alias("x2"),
                       F.coalesce(F.greatest(zero, F.col("c") - margin), zero).alias("y1"),
                       F.coalesce(F.least("height", F.col("d") + 1 + margin), "height").alias("y2"))


def image_profile(pixels, images, image="image_id") -> DataFrame:
    """Size, mean saturation, gray flag, share of coloured cells and aspect class per image."""
    st = pixels.groupBy(image).agg(F.sum("s").alias("_s"), F.count_if(F.col("s") > 50).alias("_k"))
    rows = attach(images.select(image, "width", "height"), st, [image]).na.fill(0, ["_s", "_k"])
    size = F.col("width") * F.col("height")
    aspect = F.try_divide("width", "height")
    return rows.select(image, "width", "height", (F.col("_s") / size < 30).alias("grayscale"),
                       (F.col("_k") / size * 100).alias("colored_pct"), aspect.alias("aspect"),
                       F.when(aspect > 1.5, "wide").when(aspect < 0.8, "tall").otherwise("standard").alias("shape"))


def is_grayscale(pixels, images, limit=30, image="image_id") -> DataFrame:
    """Mean saturation over all cells below `limit`."""
    st = pixels.groupBy(image).agg(F.sum("s").alias("_s"))
    rows = attach(images.select(image, "width", "height"), st, [image])
    return rows.select(image, (F.try_divide(F.coalesce(F.col("_s"), F.lit(0)), F.col("width") * F.col("height")) < limit).alias("grayscale"))


def is_color(pixels, images, threshold=0.005, image="image_id") -> DataFrame:
    """Over `threshold` of the cells coloured, or over 0.1% of them with at least two palette colours."""
    colored = (F.col("s") > 50) & (F.col("v") > 30) & (F.col("v") < 250)
    st = pixels.groupBy(image).agg(F.count_if(colored).alias("_k"))
    rows = attach(images.select(image, "width", "height"), st, [image])
    ratio = F.try_divide(F.coalesce(F.col("_k"), F.lit(0)), F.col("width") * F.col("height"))
    rows = rows.select(image, ratio.alias("ratio"))
    unsure = rows.where((F.col("ratio") > 0.001) & (F.col("ratio") <= threshold)).select(image)
    palette = _peaks(pixels.join(unsure, image, "left_semi"), 50, 4, image)
    rows = attach(rows, palette.select(image, F.size("peaks").alias("_p")), [image])
    return rows.select(image, "ratio", ((F.col("ratio") > threshold) | F.coalesce(F.col("_p") >= 2, F.lit(False))).alias("is_color"))


def difficult_colors(pixels, least=500, image="image_id") -> DataFrame:
    dark = F.count_if((F.col("gray") < 80) & (F.col("s") < 50))
    return pixels.groupBy(image).agg(dark.alias("dark")).select(image, "dark", (F.col("dark") > least).alias("difficult"))


def color_counts(pixels, least=500, image="image_id") -> DataFrame:
    """Pixels per colour family and the number of families large enough for a curve (black and gray need 5 times more)."""
    h, s, v, gray = (F.col(k) for k in ("h", "s", "v", "gray"))
    vivid = (s > 30) & (v > 50) & (v < 250)
    kinds = {"cyan": vivid & h.between(80, 100), "blue": vivid & h.between(100, 130), "purple": vivid & h.between(130, 160),
             "magenta": vivid & h.between(160, 175), "red": vivid & ((h <= 10) | (h >= 175)), "orange": vivid & h.between(10, 25),
             "green": vivid & h.between(35, 80), "black": (gray < 80) & (s < 50), "gray": (gray >= 80) & (gray < 180) & (s < 50)}
    n = pixels.groupBy(image).agg(*[F.count_if(m).alias(k) for k, m in kinds.items()])
    real = reduce(lambda a, b: a + b, [(F.col(k) >= least * (5 if k in ("black", "gray") else 1)).cast("int") for k in kinds])
    return n.withColumn("curves", real)


# -- colours of an image ---------------------------------------------------------------------------

def _saturated(pixels):
    return pixels.where((F.col("s") > 40) & (F.col("v") > 40) & (F.col("v") < 250))


def hue_histogram(pixels, image="image_id") -> DataFrame:
    """Counts in 36 hue bins of width 5; the last one holds 180 as well."""
    return _saturated(pixels).groupBy(image, F.least(F.floor(F.col("h") / 5), F.lit(35)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def _peaks(pixels, min_pixels, max_colors, image) -> DataFrame:
    """Largest separate hue peaks per image, as an array of (n, hue). A histogram has at most 36 entries."""
    hist = hue_histogram(pixels, image).groupBy(image).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_h"), F.sum("n").alias("_all"))
    at = lambda i: F.coalesce(F.try_element_at("_h", i.cast("int")), F.lit(0))
    bins = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.struct(
        at(i).alias("n"), (i * 5 + 2.5).alias("hue"), ((at(i) > min_pixels) & (at(i) >= at(i - 1)) & (at(i) >= at(i + 1))).alias("peak")))
    peaks = F.sort_array(F.transform(F.filter(bins, lambda p: p["peak"]), lambda p: F.struct(p["n"].alias("n"), p["hue"].alias("hue"))), asc=False)
    gap = lambda a, b: F.least(F.abs(a["hue"] - b["hue"]), 180 - F.abs(a["hue"] - b["hue"]))
    merged = F.aggregate("_p", F.array().cast("array<struct<n:bigint,hue:double>>"),
                         lambda acc, p: F.when(F.exists(acc, lambda q: gap(p, q) < 15), acc).otherwise(F.concat(acc, F.array(p))))
    return (hist.where(F.col("_all") >= min_pixels).select(image, peaks.cast("array<struct<n:bigint,hue:double>>").alias("_p"))
            .select(image, F.slice(merged, 1, max_colors).alias("peaks")))


def palette_bounds(pixels, min_pixels=100, max_colors=4, image="image_id") -> DataFrame:
    """Distinct curve colours as one array `colors` per image: hue, n, HSV bounds lo hi s_min v_min."""
    p = _peaks(pixels, min_pixels, max_colors, image)

    def bounds(q):
        cyan, purple = q["hue"].between(85, 100), q["hue"].between(145, 170)
        reach = F.when(cyan, 10).when(purple, 12).otherwise(15)
        lo = F.when(q["hue"] < reach, 0).otherwise(F.floor(F.greatest(F.lit(0.0), q["hue"] - reach))).cast("int")
        hi = F.when(q["hue"] > 180 - reach, 180).otherwise(F.floor(F.least(F.lit(180.0), q["hue"] + reach))).cast("int")
        return F.struct(q["hue"].alias("hue"), q["n"].alias("n"), lo.alias("lo"), hi.alias("hi"),
                        F.when(cyan | purple, 30).otherwise(20).alias("s_min"), F.when(cyan, 60).otherwise(50).alias("v_min"))

    return p.select(image, F.transform("peaks", bounds).alias("colors"))


def palette_masks(pixels, palette, image="image_id") -> DataFrame:
    """Each pixel with the palette colours it fits (`q`): the palette travels as one array per image, so pixels are not
    multiplied by it first."""
    met = attach(pixels, palette.select(image, "colors"), [image])
    fits = F.filter("colors", lambda q: F.col("h").between(q["lo"], q["hi"]) & (F.col("s") >= q["s_min"]) & (F.col("v") >= q["v_min"]))
    return met.select(*pixels.columns, F.explode(fits).alias("q"))


def detect_palette(pixels, min_pixels=100, max_colors=4, image="image_id") -> DataFrame:
    """Distinct curve colours per image: name, hue, HSV bounds, mean RGB over the bounds and size of the hue peak."""
    palette = palette_bounds(pixels, min_pixels, max_colors, image)
    met = palette_masks(pixels.select(image, "b", "g", "r", "h", "s", "v"), palette, image)
    mean = met.groupBy(image, "q.hue").agg(*[F.floor(F.avg(k)).cast("int").alias(f"mean_{k}") for k in ("r", "g", "b")])
    rows = attach(palette.select(image, F.explode("colors").alias("q")).select(image, "q.*"), mean, [image, "hue"]).na.fill(0, ["mean_r", "mean_g", "mean_b"])
    return rows.select(image, c.hue_name(F.col("hue")).alias("name"), "hue", "lo", "hi", "s_min", "v_min", "mean_r", "mean_g", "mean_b", F.col("n").alias("pixel_count"))


def gray_fallback(pixels, palette, min_pixels=100, max_colors=4, image="image_id") -> DataFrame:
    """Add a gray colour where few or weak colours were found and medium gray is common; weak colours then go."""
    weak = F.col("pixel_count") < min_pixels * 10
    st = palette.groupBy(image).agg(F.count("*").alias("_k"), F.bool_or(weak).alias("_weak"))
    low = (F.col("s") <= 40) & (F.col("v") > 80) & (F.col("v") < 180)
    full = (F.col("s") <= 40) & F.col("v").between(80, 180)
    g = pixels.groupBy(image).agg(F.count_if(low).alias("_n"), F.avg(F.when(low, F.col("v"))).alias("_v"),
                                  *[F.floor(F.avg(F.when(full, F.col(k)))).cast("int").alias(f"mean_{k}") for k in ("r", "g", "b")])
    g = attach(g, st, [image])
    add = g.where((F.coalesce(F.col("_k"), F.lit(0)) < max_colors) | F.col("_weak")).where(
        (F.col("_n") >= min_pixels * 2) & F.col("_v").between(100, 170))
    gray = add.select(image, F.lit("gray").alias("name"), F.lit(0.0).alias("hue"), F.lit(0).alias("lo"), F.lit(180).alias("hi"), F.lit(0).alias("s_min"),
                      F.lit(80).alias("v_min"), "mean_r", "mean_g", "mean_b", F.col("_n").alias("pixel_count"))
    kept = attach(palette, add.select(image, F.lit(True).alias("_add")), [image]).where(F.col("_add").isNull() | ~weak).drop("_add")
    return kept.unionByName(gray)


# -- one y per column ------------------------------------------------------------------------------

def column_pick(mask, key=("image_id",), x="x", y="y") -> DataFrame:
    """Whole-number median row per column."""
    keys = as_list(key)
    return mask.groupBy(*keys, x).agg(F.floor(F.median(y)).cast("int").alias(y))


def column_top(mask, key=("image_id",), x="x", y="y") -> DataFrame:
    keys = as_list(key)
    return mask.groupBy(*keys, x).agg(F.min(y).alias(y))


def _columns(mask, keys, x, y):
    return mask.groupBy(*keys, x).agg(F.min(y).alias("_min"), F.floor(F.median(y)).cast("int").alias("_med"), F.count("*").alias("_n"))


def _top_or_median(mask, keys, x, y, after) -> DataFrame:
    """One row per column, its top or its median; `after(name)` tells which (0 or 1) if the row chosen before is the column `name`, null before the first."""
    o = Ordered(_columns(mask, keys, x, y), keys, x).lag(_p0="_min", _p1="_med")
    o = two_way(o, after("_p0"), after("_p1"))
    return o.df.select(*keys, F.col(x).cast("int").alias(x), F.when(F.col("_way") == 0, F.col("_min")).otherwise(F.col("_med")).cast("int").alias(y))


def column_pick_continuous(mask, key=("image_id",), x="x", y="y", jump=20) -> DataFrame:
    """Thin columns take the median, others the top unless it jumps from the last chosen row, then the median."""

    def after(prev):
        return F.when(F.col("_n") <= 3, 1).when(F.col(prev).isNull(), 0).otherwise((F.abs(F.col("_min") - F.col(prev)) > jump).cast("int"))

    return _top_or_median(mask, as_list(key), x, y, after)


def column_pick_nearest(mask, key=("image_id",), x="x", y="y", up=5) -> DataFrame:
    """Thin columns take the median, others the top or median closest to the last chosen row and not above it by more than `up`."""

    def after(prev):
        far = lambda q: F.when(F.col(q) >= F.col(prev) - up, F.abs(F.col(q) - F.col(prev))).otherwise(1000)
        return F.when(F.col("_n") <= 3, 1).when(F.col(prev).isNull(), 0).otherwise((far("_min") > far("_med")).cast("int"))

    return _top_or_median(mask, as_list(key), x, y, after)


def column_overlap_rules(mask, height: int, key=("image_id", "color"), x="x", y="y", gray="color") -> DataFrame:
    """One row per column from its clusters; the rule that applied is kept as `rule`.

    Everything but the continuity arms is decided inside the column; those leave two candidates, the one nearer to the row chosen before.
    """
    keys = as_list(key)
    cols = mask.groupBy(*keys, x).agg(F.array_sort(F.collect_set(y)).alias("_ys"))
    n = F.size("_ys")
    gaps = lambda size: F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                                 lambda i: F.try_element_at("_ys", i + 1) - F.element_at("_ys", i) > size)
    cols = cols.withColumns({"_n": n, "_g3": F.get(gaps(3), F.lit(0)), "_g5": F.get(gaps(5), F.lit(0))})
    top, last = F.element_at("_ys", 1), F.element_at("_ys", -1)
    bottom = F.try_element_at("_ys", F.col("_g3") + 1)
    top_n, bottom_n = F.col("_g3"), F.col("_n") - F.col("_g3")
    gap = bottom - F.element_at("_ys", F.coalesce("_g3", F.lit(1)))
    ts, bs = 1 - top / height, 1 - bottom / height
    say = lambda rule, value: F.struct(F.lit(rule).alias("rule"), value.cast("int").alias("y"))
    # Names of the rules, and the shares of the height and sizes by which they are told apart.
    huge = (F.when((ts > 0.9) & (bs > 0.05) & (bs < 0.5), say("noise_filtered_top_text", bottom))
            .when((ts > 0.9) & (bs <= 0.05), F.when(top_n > 3, say("high_survival_curve", top)).when(
                bottom_n > 3, say("low_survival_curve", bottom)).otherwise(say("gap_top_both_sparse", top)))
            .when((ts > 0.5) & (ts <= 0.9) & (bs < 0.3), say("noise_filtered_bottom", top))
            .when((bs > 0.5) & (ts > 0.95), say("noise_filtered_top", bottom)).otherwise(say("gap_top", top)))
    gray_rule = F.when((ts > 0.98) & F.col("_g5").isNotNull(), say("gray_skip_top_noise", F.try_element_at("_ys", F.col("_g5") + 1))).otherwise(
        say("gray_topmost", top))
    is_gray = F.lower(F.col(gray)) == "gray"
    choice = (F.when(F.col("_n") == 1, say("single", top)).when(last - top < 5, say("cluster", top)).when(is_gray, gray_rule)
              .when(F.col("_g3").isNull(), say("topmost", top)).when(gap > height * 0.5, huge)
              .when((top_n <= 2) & (bottom_n >= 4), say("cross_above", bottom)).when((bottom_n <= 2) & (top_n >= 4), say("cross_below", top))
              .when((gap > 20) & (ts > 0.85), say("gap_skip_text_top", bottom))
              .when(gap > 20, say("gap", F.lit(None))).otherwise(say("near", F.lit(None))))
    rows = cols.select(*keys, x, choice.alias("_c"), top.cast("int").alias("_top"), bottom.cast("int").alias("_bottom"))
    rows = rows.select(*keys, x, F.col("_c.rule").alias("_rule"), F.col("_c.y").alias("_y"), "_top", "_bottom")

    rows = rows.withColumns({"_c0": F.coalesce("_y", "_top"), "_c1": F.coalesce("_y", "_bottom")})

    def after(prev):
        far = lambda q: F.abs(F.col(q) - F.col(prev))
        return F.when(F.col("_y").isNotNull() | F.col(prev).isNull(), 0).otherwise((far("_top") > far("_bottom")).cast("int"))

    o = two_way(Ordered(rows, keys, x).lag(_p0="_c0", _p1="_c1"), after("_p0"), after("_p1"))
    gap, down = F.col("_rule") == "gap", F.col("_way") == 1
    rule = (F.when(F.col("_y").isNotNull(), F.col("_rule")).when(F.col("_p0").isNull(), F.when(gap, "gap_prefer_top").otherwise("default_top"))
            .otherwise(F.concat(F.when(gap, "gap_").otherwise(""), F.when(down, "continuity_bottom").otherwise("continuity_top"))))
    return o.df.select(*keys, F.col(x).cast("int").alias(x), F.when(down, F.col("_c1")).otherwise(F.col("_c0")).cast("int").alias(y), rule.alias("rule"))


# -- densities, edges, extents ---------------------------------------------------------------------

def row_density(mask, image="image_id") -> DataFrame:
    return mask.groupBy(image, "y").agg(F.count_distinct("x").alias("n"))


def col_density(mask, image="image_id") -> DataFrame:
    return mask.groupBy(image, "x").agg(F.count_distinct("y").alias("n"))


def dense_bands(mask, images, width=4, share=0.3, image="image_id") -> DataFrame:
    """Starts of `width`-column bands whose set rows exceed `share` of the height: likely vertical lines."""
    starts = F.filter(F.sequence(F.col("x") - (width - 1), F.col("x")), lambda s: s >= 0)
    rows = mask.select(image, "y", F.explode(starts).alias("band")).distinct().groupBy(image, "band").agg(F.count("*").alias("rows"))
    return attach(rows, images.select(image, "height"), [image]).where(F.col("rows") > F.col("height") * share).drop("height")


def first_edge(mask, axis="y", image="image_id", share=20) -> DataFrame:
    """Whole-number median of the first 5% (at least one) of the occupied rows (axis y) or columns (axis x)."""
    lines = mask.select(image, axis).distinct()
    o = Ordered(lines, image, axis).row_number("_rn").total(_n=F.count("*"))
    head = o.df.where(F.col("_rn") <= F.greatest(F.lit(1), F.expr(f"_n div {share}")))
    m = exact_median(head, image, axis, "edge")
    return m.select(image, F.floor("edge").cast("int").alias("edge"))


def curve_extent(traced, calibration, image="image_id", x="x") -> DataFrame:
    """Time where the curves end, up to half a unit, at most the axis end; `applied` when below 95% of it."""
    m = traced.groupBy(image).agg(F.max(x).alias("_m"))
    rows = attach(calibration, m, [image])
    at = F.greatest(F.col("_m"), F.col("x_0_pixel"))
    span = F.col("x_max_pixel") - F.col("x_0_pixel")
    t = F.col("time_min") + (at - F.col("x_0_pixel")) / span * (F.col("time_max") - F.col("time_min"))
    t = F.when((span > 0) & (F.col("time_max") > F.col("time_min")), F.least(F.ceil(t * 2) / 2, F.col("time_max")))
    return rows.select(image, t.alias("t_end"), (t < F.col("time_max") * 0.95).alias("applied"),
                       F.when(t < F.col("time_max") * 0.95, t).otherwise(F.col("time_max")).alias("time_max"))


def rank_curves(traced, keep: int, plot_w: float, plot_h: float, image="image_id", key="curve_id", x="x", y="y") -> DataFrame:
    """The `keep` best curves per image by points, width and height covered."""
    st = traced.groupBy(image, key).agg(F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("_w"), (F.max(y) - F.min(y)).alias("_h"))
    score = F.col("n") * 0.4 + F.col("_w") / plot_w * 1000 * 0.3 + F.col("_h") / plot_h * 1000 * 0.3
    from ..ordered import top_rows
    return top_rows(st.select(image, key, "n", F.round(score, 9).alias("score")), image, keep, F.desc("score"), key)


def tail_bands(mask, images, current: DataFrame, tail=0.75, image="image_id") -> DataFrame:
    """Best plateau level in the tail: 10-pixel bands with enough pixels above the current level (`current.level`),
    counted double between 65% and 85% of the height."""
    rows = attach(mask, images.select(image, "width", "height"), [image]).where(F.col("x") >= F.floor(F.col("width") * tail))
    bands = rows.groupBy(image, "height", (F.col("y") - F.col("y") % 10).alias("band")).agg(F.count("*").alias("n"))
    bands = attach(bands, current.select(image, "level"), [image])
    h = F.col("height")
    ok = (F.col("n") >= 10) & (F.col("band") >= h * 0.1) & (F.col("band") < F.col("level") - 3) & (F.col("band") >= h * 0.5)
    score = F.col("n") * F.when(F.col("band").between(F.floor(h * 0.65), F.floor(h * 0.85)), 2).otherwise(1)
    best = bands.where(ok).groupBy(image).agg(F.min(F.struct((-score).alias("s"), "band", "n")).alias("_b"))
    return best.select(image, F.col("_b.band").alias("band"), F.col("_b.n").alias("n"), (-F.col("_b.s")).alias("score"))


def mode_y(traced, key="curve_id", y="y", x="x", x_from=None, x_to=None) -> DataFrame:
    """Most common whole row in a column range; the smallest one on ties."""
    keys = as_list(key)
    rows = traced if x_from is None else traced.where((F.col(x) >= x_from) & (F.col(x) < x_to))
    n = rows.groupBy(*keys, F.col(y).cast("int").alias("_y")).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col("_y")).alias("_m"))).alias("_b")).select(
        *keys, (-F.col("_b._m")).alias("mode"), F.col("_b._n").alias("n"))


def percentile_threshold(pixels, share=0.3, value="gray", image="image_id") -> DataFrame:
    """Interpolated percentile of the values of each image, from value counts (at most 256 for 8-bit intensities)."""
    counts = pixels.groupBy(image, value).agg(F.count("*").alias("_c"))
    return counts.groupBy(image).agg(F.percentile(value, F.lit(share), F.col("_c")).alias("threshold"))


def infer_axis_max(numbers, image="image_id", value="value", limit=100, plot_w=None) -> DataFrame:
    """Axis end from the distinct whole numbers seen (1..limit); extended by the first step when the largest is below
    1.5 times the upper median. `plot_w` names the column with the plot width in pixels."""
    seen = numbers.where((F.col(value) > 0) & (F.col(value) <= limit)).select(image, F.col(value).cast("int").alias("v")).distinct()
    # at most `limit` distinct numbers per image
    st = seen.groupBy(image).agg(F.array_sort(F.collect_list("v")).alias("_v"))
    n = F.size("_v")
    top, med = F.element_at("_v", -1), F.element_at("_v", (F.floor(n / 2) + 1).cast("int"))
    if plot_w is None:
        return st.select(image, top.cast("double").alias("time_max"))
    st = attach(st, numbers.groupBy(image).agg(F.max(plot_w).alias("_w")), [image])
    step = F.try_element_at("_v", F.lit(2)) - F.element_at("_v", 1)
    more = step * F.floor(F.col("_w") / 30)
    wide = (n >= 3) & (top < med * 1.5) & (step > 0) & (more > top) & (more <= limit)
    return st.select(image, F.when(wide, more).otherwise(top).cast("double").alias("time_max"))


def distinct_times(cells, key="image_id", t="t") -> DataFrame:
    keys = as_list(key)
    return cells.select(*keys, t).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(t)).alias("times"))


def split_by_column_mean(mask, image="image_id") -> DataFrame:
    """Upper part: pixels above the mean row of their column (single pixels count as upper)."""
    m = mask.groupBy(image, "x").agg(F.avg("y").alias("_m"), F.count("*").alias("_n"))
    rows = attach(mask, m, [image, "x"])
    return rows.select(image, "x", "y", F.when((F.col("_n") < 2) | (F.col("y") < F.col("_m")), "upper").otherwise("lower").alias("part"))


def curve_summary(rows, key="curve_id", t="t", s="s") -> DataFrame:
    keys = as_list(key)
    return rows.groupBy(*keys).agg(F.count("*").alias("points"), F.min(t).alias("t_from"), F.max(t).alias("t_to"),
                                   F.min(s).alias("s_from"), F.max(s).alias("s_to"))
