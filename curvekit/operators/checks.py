"""Checks of extracted curves against the picture: points are mapped to pixels and compared with nearby dark cells.

calibration: one row per image with x_0_pixel x_max_pixel y_0_pixel y_100_pixel time_min time_max (survival 0..1).
images: image_id, width, height. Points outside a picture, or without a dark cell near, have no error.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordered import Ordered, top_rows
from ..runtime import attach, cut_lineage
from .clean import find_steps
from .joins import any_in_gap, asof_step, nearest_dark, nearest_vertical
from .quality import num
from .runs import consolidate_regions

c = F.col
KEYS = ["image_id", "curve_id"]


def to_pixels(points, calibration, t="t", s="s") -> DataFrame:
    """Whole-pixel positions px, py of (t, s)."""
    rows = attach(points, calibration, ["image_id"])
    px = c("x_0_pixel") + F.try_divide(c(t) - c("time_min"), c("time_max") - c("time_min")) * (c("x_max_pixel") - c("x_0_pixel"))
    py = c("y_100_pixel") + (1.0 - c(s)) * (c("y_0_pixel") - c("y_100_pixel"))
    return rows.select(*points.columns, px.try_cast("int").alias("px"), py.try_cast("int").alias("py"))


def pixel_errors(points, calibration, pixels, images, radius=15, dark=128, t="t", s="s") -> DataFrame:
    """Points with `dist` to the closest dark cell and its row `near_y`; `inside` tells whether they lie in the picture."""
    rows = attach(to_pixels(points, calibration, t, s), images.select("image_id", "width", "height"), ["image_id"])
    inside = c("px").between(0, c("width") - 1) & c("py").between(0, c("height") - 1)
    rows = rows.withColumn("inside", inside).drop("width", "height")
    found = nearest_dark(rows, pixels.where(c("gray") < dark), radius=radius)
    return found.withColumns({"dist": F.when(c("inside"), c("dist")), "near_y": F.when(c("inside"), c("near_y"))})


def _issues(*pairs):
    return F.array_compact(F.array(*[F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])) for cond, parts in pairs]))


def early_region(points, calibration, pixels, images, share=0.2) -> DataFrame:
    """Start, number and height of the points in the first fifth, and their pixel error at seven sample times."""
    rows = attach(points.select(*KEYS, "t", "s"), calibration.select("image_id", c("time_max").alias("_tm")), ["image_id"])
    early = c("t") <= c("_tm") * share
    samples = [0.02, 0.05, 0.08, 0.10, 0.12, 0.15, 0.18]
    st = rows.groupBy(*KEYS, "_tm").agg(F.min(F.struct("t", "s")).alias("_f"), F.count_if(early).alias("early_points"), F.max(F.when(early, c("s"))).alias("_top"),
                                        *[F.min(F.when(early, F.struct(F.abs(c("t") - c("_tm") * q).alias("d"), "t", "s"))).alias(f"_n{i}") for i, q in enumerate(samples)])
    taken = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_n{i}").alias("p")) for i in range(len(samples))]), lambda q: q["p"].isNotNull() & (q["p"]["d"] < c("_tm") * 0.02))
    probe = st.select(*KEYS, F.explode(taken).alias("q")).select(*KEYS, c("q.p.t").alias("t"), c("q.p.s").alias("s"))
    err = pixel_errors(probe, calibration, pixels, images).groupBy(*KEYS).agg(F.count("dist").alias("_k"), F.avg("dist").alias("avg_error"), F.max("dist").alias("max_error"))
    st = attach(st, err, KEYS)
    found = _issues((F.abs("_f.t") > 0.001, ["First point time=", num(c("_f.t"), 3), " (should be 0)"]), (F.abs(c("_f.s") - 1) > 0.005, ["First point survival=", num(c("_f.s"), 4), " (should be 1.0)"]),
                    (c("early_points") < 3, ["Only ", c("early_points").cast("string"), " points in early region"]), (c("_top") < 0.99, ["Max survival in early region=", num(c("_top"), 3)]),
                    (c("max_error") > 4, ["Early region pixel error"]), ((c("_k") >= 3) & (c("avg_error") > 2), ["Possible curve misalignment in early region"]))
    start = (F.abs("_f.t") > 0.001) | (F.abs(c("_f.s") - 1) > 0.005)
    return st.select(*KEYS, F.when(F.size(found) == 0, "PASS").when(start, "FAIL").otherwise("WARNING").alias("status"),
                     F.array_join(F.slice(found, 1, 3), "; ").alias("message"), "early_points", "avg_error", "max_error")


def tail_coverage(points, calibration, pixels, images, share=0.9) -> DataFrame:
    """Coverage of the time range, number and level of the points in the last tenth, and the error of the last five."""
    rows = attach(points.select(*KEYS, "t", "s"), calibration.select("image_id", c("time_max").alias("_tm")), ["image_id"])
    tail = c("t") >= c("_tm") * share
    st = rows.groupBy(*KEYS, "_tm").agg(F.count("*").alias("_n"), F.max("t").alias("_end"), F.count_if(tail).alias("tail_points"), F.max(F.when(tail, c("s"))).alias("_top"), F.max("s").alias("_all"))
    last = top_rows(rows.where(tail).select(*KEYS, "t", "s"), KEYS, 5, F.desc("t"), F.desc("s")).select(*KEYS, "t", "s")
    err = pixel_errors(last, calibration, pixels, images).groupBy(*KEYS).agg(F.avg("dist").alias("avg_error"), F.max("dist").alias("max_error"))
    st = attach(st, err, KEYS).withColumn("coverage", F.when(c("_tm") > 0, c("_end") / c("_tm")).otherwise(0.0))
    found = _issues((c("coverage") < 0.95, ["Curve ends at t=", num(c("_end"))]), (c("tail_points") < F.greatest(F.lit(3), F.floor(c("_n") * 0.05)), ["Only ", c("tail_points").cast("string"), " points in tail region"]),
                    (c("max_error") > 5, ["Tail region pixel error"]), ((c("_top") >= c("_all") - 0.01) & (c("_n") > 10), ["Tail survival not lower than max"]))
    return st.select(*KEYS, F.when(F.size(found) == 0, "PASS").when(c("coverage") < 0.9, "FAIL").otherwise("WARNING").alias("status"),
                     F.array_join(F.slice(found, 1, 3), "; ").alias("message"), "coverage", "tail_points", "avg_error", "max_error")


def sample_accuracy(points, calibration, pixels, images) -> DataFrame:
    """Pixel error at eight sample times of every curve, judged per image: above 10 fails, above 5 warns."""
    rows = attach(points.select(*KEYS, "t", "s"), calibration.select("image_id", c("time_max").alias("_tm")), ["image_id"])
    samples = [0.0, 0.1, 0.2, 0.25, 0.5, 0.75, 0.9, 1.0]
    st = rows.groupBy(*KEYS, "_tm").agg(*[F.min(F.struct(F.abs(c("t") - c("_tm") * q).alias("d"), "t", "s")).getField("s").alias(f"_s{i}") for i, q in enumerate(samples)])
    probe = st.select(*KEYS, F.explode(F.array(*[F.struct((c("_tm") * q).alias("t"), c(f"_s{i}").alias("s")) for i, q in enumerate(samples)])).alias("q")).select(*KEYS, "q.t", "q.s")
    e = pixel_errors(probe, calibration, pixels, images).groupBy("image_id").agg(F.count("*").alias("samples"), F.count("dist").alias("measured"), F.max("dist").alias("max_error"), F.avg("dist").alias("avg_error"))
    status = F.when(c("measured") == 0, "WARNING").when(c("max_error") > 10, "FAIL").when(c("max_error") > 5, "WARNING").otherwise("PASS")
    return e.select("image_id", status.alias("status"), "samples", "measured", "max_error", "avg_error")


def overlay_match(points, calibration, pixels, images, within=5, radius=8) -> DataFrame:
    """Share of the points inside the picture with a dark cell within 5 pixels: 95% passes, 85% warns."""
    e = pixel_errors(points.select(*KEYS, "t", "s"), calibration, pixels, images, radius).where("inside")
    st = e.groupBy("image_id").agg(F.count("*").alias("points"), (F.count_if(c("dist") <= within) / F.count("*")).alias("match_ratio"), F.coalesce(F.avg(c("near_y") - c("py")), F.lit(0.0)).alias("avg_y_offset"))
    return st.select("image_id", F.when(c("match_ratio") >= 0.95, "PASS").when(c("match_ratio") >= 0.85, "WARNING").otherwise("FAIL").alias("status"),
                     "points", "match_ratio", "avg_y_offset", (F.abs("avg_y_offset") > 2).alias("adjust"))


def dense_rows(points, calibration, every=2) -> DataFrame:
    """Every second pixel column of each curve from its first point on: its value there and the row it maps to."""
    cal = calibration.where((c("x_max_pixel") > c("x_0_pixel")) & (c("y_0_pixel") > c("y_100_pixel")))
    w = c("x_max_pixel") - c("x_0_pixel")
    cols = cal.select("image_id", "y_0_pixel", "y_100_pixel", "time_min", "time_max", "x_0_pixel", w.alias("_w"), F.explode(F.sequence(c("x_0_pixel"), c("x_max_pixel") - 1, F.lit(every))).alias("x"))
    cols = cols.select("image_id", "x", (c("time_min") + F.try_divide(c("x") - c("x_0_pixel"), c("_w")) * (c("time_max") - c("time_min"))).alias("t"), "y_0_pixel", "y_100_pixel")
    asked = attach(points.select(*KEYS).distinct(), cols.select("image_id", "x", "t"), ["image_id"]).where(c("x").isNotNull())
    # the columns of a picture are the same for all its curves, so they are looked up by picture and time, not once more by curve
    rows = attach(asof_step(points, asked, KEYS).where(c("s").isNotNull()), cols, ["image_id", "t"])
    return rows.withColumn("y", (c("y_100_pixel") + (1.0 - c("s")) * (c("y_0_pixel") - c("y_100_pixel"))).cast("int"))


def in_plot(mask, calibration) -> DataFrame:
    """The mask's cells between the top and the bottom of the plot, each once."""
    cal = calibration.where((c("x_max_pixel") > c("x_0_pixel")) & (c("y_0_pixel") > c("y_100_pixel")))
    inside = attach(mask.select("image_id", "x", "y"), cal.select("image_id", c("y_100_pixel").alias("_a"), c("y_0_pixel").alias("_b")), ["image_id"]).where(c("y").between(c("_a"), c("_b") - 1))
    return inside.select("image_id", "x", "y").distinct()


def dense_match(points, calibration, mask, every=2, close_open=False) -> dict[str, DataFrame]:
    """Dense comparison of curves with a mask: `summary` per curve, `offset_regions` (consolidated, ten largest) and
    `missing_steps` (spans whose value gaps hold mask cells).

    A span that is still open at the end of the curve is reported only with `close_open`. Points, the mask's cells in the plot and the values at the columns
    serve several steps each and the counting of rows per curve, so each of them is worked out once and written to the shared folder.
    """
    points = cut_lineage(points.select(*KEYS, "t", "s"))
    rows, inside = cut_lineage(dense_rows(points, calibration, every)), cut_lineage(in_plot(mask, calibration))
    grid = nearest_vertical(rows, inside).select(*KEYS, "x", "t", "offset")
    o = Ordered(rows.select(*KEYS, "x", "t", "s", "y"), KEYS, "t").lag(_ps="s", _py="y")
    gaps = o.df.where(F.abs(c("_ps") - c("s")) > 0.05).select(*KEYS, "x", "t", F.abs(c("_ps") - c("s")).alias("gap"), F.least("y", "_py").alias("y1"), F.greatest("y", "_py").alias("y2"))
    held = any_in_gap(gaps, inside)
    g = Ordered(held, KEYS, "t").lag(_before="has_pixels")
    g = g.islands("_run", c("has_pixels") & ~F.coalesce(c("_before"), F.lit(False)))
    spans = g.df.groupBy(*KEYS, "_run").agg(F.min(F.when(c("has_pixels"), c("t"))).alias("t_from"), F.min(F.when(~c("has_pixels"), F.struct("t", "gap"))).alias("_e"), F.max(F.struct("t", "gap")).alias("_l"))
    spans = spans.where(c("t_from").isNotNull() & (F.lit(close_open) | c("_e").isNotNull()))
    missing = spans.select(*KEYS, "t_from", F.coalesce("_e", "_l").getField("t").alias("t_to"), F.coalesce("_e", "_l").getField("gap").alias("gap"))
    far = grid.where(F.abs("offset") > 8).select(*KEYS, "t", "offset")
    regions = consolidate_regions(far, KEYS, "t", "offset").where("rank <= 10")
    steps = find_steps(points, KEYS).groupBy(*KEYS).agg(F.count("*").alias("steps"))
    st = grid.groupBy(*KEYS).agg(F.count("*").alias("total"), F.count_if(F.abs("offset") <= 5).alias("matched"), F.coalesce(F.avg("offset"), F.lit(0.0)).alias("avg_offset"),
                                 F.coalesce(F.max(F.abs("offset")), F.lit(0)).alias("max_offset"))
    st = attach(st, steps, KEYS).withColumns({"steps": F.coalesce("steps", F.lit(0)), "match_rate": F.try_divide("matched", "total")})
    return {"summary": st, "offset_regions": regions, "missing_steps": missing}
