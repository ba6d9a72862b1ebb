"""Whole extractions as one lazy plan over all pictures at once."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color as c
from ..operators import axis, clean, pixels as p, quality, runs
from ..ordered import Ordered
from ..runtime import attach, cut_lineage

KEYS = ["image_id", "color"]


def color_curves(pixels: DataFrame, bounds: DataFrame, calibration: DataFrame, min_pixels=100, max_colors=4) -> DataFrame:
    """Palette colours of each picture, one row per column (median), mapped to data and cleaned: (image_id, color, t, s)."""
    inside = p.in_plot(pixels, bounds, 10)
    found = p.palette_masks(inside.select("image_id", "x", "y", "h", "s", "v"), p.palette_bounds(inside, min_pixels, max_colors))
    masks = found.select("image_id", F.concat_ws("@", c.hue_name(F.col("q.hue")), F.col("q.hue").cast("string")).alias("color"), "x", "y")
    points = axis.px_to_data(p.column_pick(masks, KEYS), calibration).select(*KEYS, "t", "s")
    clipped = axis.clip_points(attach(points, calibration.select("image_id", F.col("time_max").alias("_tm")), ["image_id"]), F.col("_tm")).drop("_tm")
    return clean.clean_curve(clipped, KEYS)


def named_curves(pixels: DataFrame, calibration: DataFrame, colors: list[str], step=0.5) -> DataFrame:
    """Curves of given colours: nearest-row picks, mapped, violations dropped, flat rows dropped, resampled."""
    found = F.array_compact(F.array(*[F.when(c.in_range(c.NAMED[n]), F.lit(n)) for n in colors]))
    masks = pixels.select("image_id", "x", "y", F.explode(found).alias("color"))
    rows = attach(masks, calibration, ["image_id"])
    inside = rows.where(F.col("x").between(F.col("x_0_pixel"), F.col("x_max_pixel")) & F.col("y").between(F.col("y_100_pixel"), F.col("y_0_pixel"))).select(*KEYS, "x", "y")
    picked = p.column_pick_nearest(inside, KEYS)
    enough = Ordered(picked, KEYS, "x").total(_n=F.count("*")).where(F.col("_n") >= 10).df.drop("_n")
    points = axis.px_to_data(enough, calibration).select(*KEYS, "t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s"))).alias("s"))
    return clean.resample(clean.drop_flat(clean.monotone_drop(points, KEYS, start=None), KEYS, counted=points), KEYS, step=step, counted=points)


def classed_curves(pixels: DataFrame, images: DataFrame, time_max: float, least=100) -> DataFrame:
    """Curves of all colour classes of a cropped plot: continuous picks, violations dropped, thinned, anchored."""
    classes = p.classify_color(pixels).select("image_id", "color", "x", "y")
    enough = classes.groupBy(*KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*KEYS, F.lit(True).alias("_ok"))
    picked = p.column_pick_continuous(attach(classes, enough, KEYS).where("_ok"), KEYS)
    rows = attach(picked, images.select("image_id", "width", "height"), ["image_id"])
    points = rows.select(*KEYS, (F.col("x") / F.col("width") * time_max).alias("t"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("y") / F.col("height"))).alias("s"))
    points = Ordered(points, KEYS, "t").total(_n=F.count("*")).where(F.col("_n") >= 10).df.drop("_n")
    return clean.anchor_start(clean.thin(clean.monotone_drop(points, KEYS), KEYS, tol_t=0.1, counted=points), KEYS)


def scored_curves(points: DataFrame, key="curve_id", curves: DataFrame | None = None, **options) -> DataFrame:
    """Cleaned and scored curves: the quality row of every curve."""
    cleaned = cut_lineage(clean.clean_curve(points, key, **options))  # every rule reads them
    known = curves if curves is not None else points.select(key).distinct()
    return quality.qc_score(known, quality.all_issues(cleaned, key, curves=known), key)
