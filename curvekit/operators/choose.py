"""Choosing between settings, variants and fallbacks: all candidates run in one job and the best is picked per key."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import as_list, attach
from .joins import merge_masks


def sweep(data: DataFrame, settings: list[dict], run: Callable[..., DataFrame], assess: Callable[[DataFrame, list[str]], DataFrame],
          key="image_id", enough=0.7) -> DataFrame:
    """Run `run(data, **setting)` for every setting and keep each key's first acceptable result, else the surest one.

    `assess(results, keys)` gives (keys, confidence, acceptable) per result; `setting` numbers the settings in order.
    """
    keys = as_list(key)
    results = None
    for i, s in enumerate(settings):
        part = run(data, **s).withColumn("setting", F.lit(i))
        results = part if results is None else results.unionByName(part)
    scores = assess(results, keys + ["setting"])
    good = F.col("acceptable") & (F.col("confidence") >= enough)
    best = scores.groupBy(*keys).agg(F.coalesce(F.min(F.when(good, F.col("setting"))),
                                                (-F.max(F.struct("confidence", (-F.col("setting")).alias("_n"))).getField("_n"))).alias("_best"))
    return attach(results, best, keys).where(F.col("setting") == F.col("_best")).drop("_best")


def best_variant(base: DataFrame, variants: list[tuple[str, DataFrame]], count: Callable[[DataFrame], DataFrame], image="image_id", value="v") -> DataFrame:
    """Merge into each image's mask the variant with the most curves, if that is more than the mask itself has.

    `count(mask)` gives (image_id, curves).
    """
    own = count(base).select(image, F.col("curves").alias("_own"))
    scores = None
    for i, (_, v) in enumerate(variants):
        part = count(v).select(image, "curves", F.lit(-i).alias("_n"))
        scores = part if scores is None else scores.unionByName(part)
    best = attach(scores, own, [image]).where(F.col("curves") > F.coalesce("_own", F.lit(0))).groupBy(image).agg(
        (-F.max(F.struct("curves", "_n")).getField("_n")).alias("_best"))
    extra = None
    for i, (_, v) in enumerate(variants):
        part = v.select(image, "x", "y", value).withColumn("_i", F.lit(i))
        extra = part if extra is None else extra.unionByName(part)
    extra = attach(extra, best, [image]).where(F.col("_i") == F.col("_best"))
    return merge_masks(base, extra.select(image, "x", "y", value), image, value)


def fallback_cascade(candidates: list[tuple[str, DataFrame, float]], key="image_id", s="s", least=10) -> DataFrame:
    """The first candidate curve per key whose lowest value reaches its limit and which has more than `least` points.

    candidates: (method, points, limit) in order of preference.
    """
    keys = as_list(key)
    rows = None
    for i, (name, points, limit) in enumerate(candidates):
        part = points.withColumns({"method": F.lit(name), "_p": F.lit(i), "_limit": F.lit(float(limit))})
        rows = part if rows is None else rows.unionByName(part)
    st = rows.groupBy(*keys, "_p", "_limit").agg(F.min(s).alias("_low"), F.count("*").alias("_n"))
    first = st.where((F.col("_low") >= F.col("_limit")) & (F.col("_n") > least)).groupBy(*keys).agg(F.min("_p").alias("_best"))
    return attach(rows, first, keys).where(F.col("_p") == F.col("_best")).drop("_p", "_best", "_limit")
