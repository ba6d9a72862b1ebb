"""Runs, clusters, lines and connected components of sparse masks, and rules over them."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..islands import fold_islands, keep_since
from ..ordered import Ordered
from ..runtime import as_list, attach, cut_lineage
from . import masks as m

TILE = 512
c = F.col


# -- runs ------------------------------------------------------------------------------------------

def _marked_runs(mask, keys, line, pos, max_gap):
    """Cells with a run number along `pos`; a partition is one row or column of one picture."""
    w = Window.partitionBy(*keys, line).orderBy(pos)
    gap = F.col(pos) - F.lag(pos).over(w)
    return mask.withColumn("_new", (F.coalesce(gap, F.lit(FAR)) > max_gap).cast("int")).withColumn("run", F.sum("_new").over(w).cast("int")).drop("_new")


FAR = 1 << 30


def runs(mask, axis="row", max_gap=1, keys=("image_id",)) -> DataFrame:
    """Maximal runs along rows (or columns): line, start, end (inclusive) and number of set cells."""
    keys = as_list(keys)
    line, pos = ("y", "x") if axis == "row" else ("x", "y")
    return (_marked_runs(mask.select(*keys, "x", "y").distinct(), keys, line, pos, max_gap)
            .groupBy(*keys, F.col(line).alias("line"), "run").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("cells")))


def dash_rows(mask, binary, keys=("image_id",), max_gap=25, max_run=30) -> DataFrame:
    """Cells of rows with a regular dash pattern, widened by one and cut to `binary`."""
    keys = as_list(keys)
    r = runs(mask, "row", 1, keys)
    w = Window.partitionBy(*keys, "line").orderBy("start")
    r = r.withColumns({"_len": (F.col("end") - F.col("start") + 1).cast("double"),
                       "_gap": (F.col("start") - F.lag("end").over(w) - 1).cast("double")})
    run, gap = F.when(F.col("_len") <= max_run, F.col("_len")), F.when(F.col("_gap") <= max_gap, F.col("_gap"))
    st = r.groupBy(*keys, "line").agg(F.sum("cells").alias("_n"), F.count(run).alias("_r"), F.count(gap).alias("_g"), F.avg(run).alias("_ra"),
                                      F.avg(gap).alias("_ga"), F.var_pop(run).alias("_rv"), F.var_pop(gap).alias("_gv"))
    ok = ((F.col("_n") >= 10) & (F.col("_r") >= 3) & (F.col("_g") >= 2) & (F.col("_ra") < 15) & (F.col("_ga") > 2)
          & (F.col("_gv") / (F.col("_ga") + 0.1) < 5) & (F.col("_rv") / (F.col("_ra") + 0.1) < 5))
    rows = attach(mask.select(*keys, "x", "y"), st.where(ok).select(*keys, F.col("line").alias("y"), F.lit(True).alias("_ok")), keys + ["y"])
    return m.mask_intersect(m.dilate(rows.where("_ok"), keys=keys), binary, keys + ["x", "y"])


def cluster_axis(mask, min_gap=5, keys=("image_id",), x="x", y="y") -> DataFrame:
    """Clusters of each column, split where the gap exceeds `min_gap`: median centre and size."""
    keys = as_list(keys)
    marked = _marked_runs(mask, keys, x, y, min_gap)
    return marked.groupBy(*keys, x, F.col("run").alias("cluster")).agg(F.median(y).alias("center"), F.count("*").alias("cells"))


def _adaptive(mask, expected, keys, x, y):
    w = Window.partitionBy(*keys, x)
    rows = mask.withColumn("_gap", F.col(y) - F.lag(y).over(w.orderBy(y)))
    n = {g: 1 + F.count_if(F.col("_gap") > g).over(w) for g in (5, 4, 3)}
    pick = F.when(n[5] >= expected, 5).when(n[4] >= expected, 4).when(n[3] >= expected, 3).otherwise(2 if expected > 1 else 5)
    rows = rows.withColumn("_g", pick)
    rows = rows.withColumn("_new", F.coalesce(F.col("_gap") > F.col("_g"), F.lit(True)).cast("int"))
    return rows.withColumn("cluster", F.sum("_new").over(w.orderBy(y)).cast("int"))


def cluster_axis_adaptive(mask, expected=2, keys=("image_id",), x="x", y="y") -> DataFrame:
    """As `cluster_axis` with the largest of the gaps 5, 4, 3 that gives the expected number of clusters, else 2."""
    keys = as_list(keys)
    return _adaptive(mask, expected, keys, x, y).groupBy(*keys, x, "cluster", F.col("_g").alias("gap")).agg(
        F.median(y).alias("center"), F.count("*").alias("cells"))


def cluster_with_style(mask, dashes, keys=("image_id",), x="x", y="y") -> DataFrame:
    """Two centres per column where possible: adaptive clusters, else dashed against other cells, else the halves of a
    thick cluster."""
    keys = as_list(keys)
    flag = dashes.select(*keys, F.col("x").alias(x), F.col("y").alias(y)).distinct().withColumn("_d", F.lit(True))
    rows = attach(_adaptive(mask.select(*keys, x, y), 2, keys, x, y), flag, keys + [x, y])
    w = Window.partitionBy(*keys, x)
    rows = rows.withColumns({"_k": F.max("cluster").over(w), "_nd": F.count("_d").over(w), "_n": F.count("*").over(w),
                             "_mid": (F.min(y).over(w) + F.max(y).over(w)) / 2, "_span": F.max(y).over(w) - F.min(y).over(w)})
    halves = F.when((F.col("_k") == 1) & (F.col("_nd") == 0) | (F.col("_nd") == F.col("_n")),
                    F.when((F.col("_k") == 1) & (F.col("_n") >= 4) & (F.col("_span") >= 4), F.when(F.col(y) <= F.col("_mid"), "a").otherwise("b")))
    part = F.when(F.col("_k") > 1, F.col("cluster").cast("string")).when(
        (F.col("_nd") > 0) & (F.col("_nd") < F.col("_n")), F.when(F.col("_d"), "d").otherwise("s")).otherwise(F.coalesce(halves, F.lit("1")))
    c = rows.withColumn("part", part).groupBy(*keys, x, "part").agg(F.median(y).alias("center"), F.median(y).alias("_c"), F.count("*").alias("cells"))
    wx = Window.partitionBy(*keys, x)
    near = (F.max(F.col("part").isin("a", "b").cast("int")).over(wx) == 1) & (F.max("center").over(wx) - F.min("center").over(wx) < 3)
    c = c.withColumn("_near", near)
    single = attach(c.where("_near").select(*keys, x).distinct(), rows.groupBy(*keys, x).agg(F.median(y).alias("center"), F.count("*").alias("cells")), keys + [x])
    return c.where(~F.col("_near")).select(*keys, x, "part", "center", "cells").unionByName(
        single.select(*keys, x, F.lit("1").alias("part"), "center", "cells"))


# -- lines and axes --------------------------------------------------------------------------------

def _oriented(df, axis):
    """(line, pos) view of a mask: rows for horizontal lines, columns for vertical ones."""
    return df.select("image_id", *((F.col("y").alias("line"), F.col("x").alias("pos")) if axis == "horizontal"
                                   else (F.col("x").alias("line"), F.col("y").alias("pos"))))


def reference_lines(mask, images, axis="horizontal", share=0.4, max_gap=5, thick=8, reach=3, keep_near_curves=False) -> DataFrame:
    """Cells covered by straight reference lines: long runs that are not too thick, and unbroken runs of a quarter of the
    extent outside the outer 5%. With `keep_near_curves` a long run leaves out the columns that have mask cells 5..8
    beside the line.
    """
    along, across = ("width", "height") if axis == "horizontal" else ("height", "width")
    o = _oriented(mask, axis).distinct()
    dims = images.select("image_id", F.col(along).alias("_along"), F.col(across).alias("_across"))

    def long_runs(gap):
        r = _marked_runs(o, ["image_id"], "line", "pos", gap).groupBy("image_id", "line", "run").agg(
            F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n"))
        return attach(r, dims, ["image_id"])

    first = long_runs(max_gap).where(F.col("n") >= F.floor(F.col("_along") * share))
    if axis == "vertical" and not keep_near_curves:
        first = first.where(F.col("line") >= F.floor(F.col("_across") * 0.05))
    around = first.select("image_id", "line", "run", "a", "b", F.explode(F.sequence(F.col("line") - 4, F.col("line") + 4)).alias("_l"))
    met = around.join(o.select(F.col("image_id").alias("_img"), F.col("line").alias("_ol"), F.col("pos").alias("_p")),
                      [F.col("image_id").eqNullSafe(F.col("_img")), F.col("_l") == F.col("_ol"), F.col("_p").between(F.col("a"), F.col("b"))])
    dense = met.groupBy("image_id", "line", "run", "a", "b", "_l").agg(F.count("*").alias("_k")).groupBy("image_id", "line", "run", "a", "b").agg(
        F.count_if(F.col("_k") / (F.col("b") - F.col("a") + 1) > 0.5).alias("_thick"))
    cells = dense.where(F.col("_thick") <= thick).select("image_id", "line", F.explode(F.sequence("a", "b")).alias("pos"))
    if keep_near_curves:
        both = cells.distinct().withColumn("_m", F.lit(0)).unionByName(o.withColumn("_m", F.lit(1)))
        w = Window.partitionBy("image_id", "pos").orderBy("line")
        near = F.coalesce(F.sum("_m").over(w.rangeBetween(-8, -5)), F.lit(0)) + F.coalesce(F.sum("_m").over(w.rangeBetween(5, 8)), F.lit(0))
        cells = both.withColumn("_near", near).where((F.col("_m") == 0) & (F.col("_near") == 0))
    cells = cells.select("image_id", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("line"), "pos")
    cells = attach(cells, dims, ["image_id"]).where(F.col("line").between(0, F.col("_across") - 1)).select("image_id", "line", "pos")
    edge = F.floor(F.col("_across") * 0.05)
    quarter = long_runs(1).where((F.col("n") >= F.floor(F.col("_along") / 4)) & (F.col("line") >= edge) & (F.col("line") < F.col("_across") - edge))
    cells = cells.unionByName(quarter.select("image_id", "line", F.explode(F.sequence("a", "b")).alias("pos"))).distinct()
    x, y = ("pos", "line") if axis == "horizontal" else ("line", "pos")
    return cells.select("image_id", F.col(x).alias("x"), F.col(y).alias("y"))


def axis_candidates(dark, images, max_gap=3, longest=False) -> DataFrame:
    """Best x axis (bottom 60%, at least 30% wide) and y axis (left 40%, at least 50% tall) of each picture from runs of
    dark cells, by length and position, or the longest."""
    dims = images.select("image_id", "width", "height")
    h = attach(runs(dark, "row", max_gap), dims, ["image_id"])
    v = attach(runs(dark, "col", max_gap), dims, ["image_id"])
    size = F.col("end") - F.col("start")
    hs = (F.try_divide(size, F.col("width")) + F.try_divide("line", "height")) / 2
    vs = (F.try_divide(size, F.col("height")) + 1 - F.try_divide("line", "width")) / 2
    pick = lambda score: F.max(F.struct((size if longest else score).cast("double").alias("score"), "line", "start", "end"))
    xa = h.where((F.col("line") >= F.col("height") * 0.4) & (size >= F.col("width") * 0.3)).groupBy("image_id").agg(pick(hs).alias("_x"))
    ya = v.where((F.col("line") <= F.col("width") * 0.4) & (size >= F.col("height") * 0.5)).groupBy("image_id").agg(pick(vs).alias("_y"))
    out = attach(attach(images.select("image_id"), xa, ["image_id"]), ya, ["image_id"])
    return out.select("image_id", F.col("_x.line").alias("x_axis_y"), F.col("_x.start").alias("x_axis_from"), F.col("_x.end").alias("x_axis_to"),
                      F.col("_y.line").alias("y_axis_x"), F.col("_y.start").alias("y_axis_top"), F.col("_y.end").alias("y_axis_bottom"))


def axis_origin_ends(axes, agree=20) -> DataFrame:
    """Origin and far ends: the x axis' row counts when it lies within `agree` of the y axis' bottom."""
    oy = F.when(F.abs(F.col("y_axis_bottom") - F.col("x_axis_y")) < agree, F.col("x_axis_y")).otherwise(F.col("y_axis_bottom"))
    both = F.col("x_axis_y").isNotNull() & F.col("y_axis_x").isNotNull()
    return axes.where(both).select("image_id", F.col("y_axis_x").alias("origin_x"), oy.alias("origin_y"),
                                   F.col("x_axis_to").alias("x_end"), F.col("y_axis_top").alias("y_end"))


def tick_marks(pixels, axes, reach=20, dark=100, every=5, width=3, share=0.5, apart=10) -> DataFrame:
    """Tick positions along the x axis: every `every` columns a strip below the axis is tested, then close ones merge
    into the last kept."""
    rows = attach(pixels.where(F.col("gray") < dark), axes, ["image_id"])
    off = F.col("x") - F.col("x_axis_from")
    rows = rows.where((F.col("y") >= F.col("x_axis_y")) & (F.col("y") < F.col("x_axis_y") + reach) & (off >= 0)
                      & (F.col("x") - off % every < F.col("x_axis_to")) & (off % every < width))
    dense = rows.groupBy("image_id", (F.col("x") - off % every).cast("int").alias("pos")).agg(F.count("*").alias("n")).where(F.col("n") > reach * share)

    o = Ordered(dense.select("image_id", "pos"), "image_id", "pos").lag(_p="pos")
    return keep_since(o, c("_p").isNull() | (c("pos") - c("_p") > apart), lambda last, row: row["pos"] - last["pos"] > apart, ["pos"])


# -- connected components --------------------------------------------------------------------------

def _tile_labels(keys, conn):
    """Labels the runs of one tile by joining them to touching runs of the row above.

    A tile has at most TILE * TILE / 2 runs. The label of a component is its first cell in reading order.
    """
    reach = 1 if conn == 8 else 0

    def label(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["y", "a"], ignore_index=True)
        row, a, b = (tile[k].to_numpy(np.int64) for k in ("y", "a", "b"))
        root = list(range(len(row)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        above = 0
        for i in range(len(row)):
            while row[above] < row[i] - 1 or (row[above] == row[i] - 1 and b[above] + reach < a[i]):
                above += 1
            j = above
            while row[j] == row[i] - 1 and a[j] <= b[i] + reach:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
                j += 1
        top = np.array([find(i) for i in range(len(row))], dtype=np.int64)
        tile["comp_id"] = (row[top] << 31) | a[top]
        return tile[[*keys, "y", "a", "b", "comp_id"]]

    return label


def connected_components(mask, conn=8, keys=("image_id",), tile=TILE) -> DataFrame:
    """Cells with `comp_id`, the reading-order number (y * 2^31 + x) of the component's first cell.

    Cells are shuffled once, by picture row, and become runs that end at tile borders; everything after that moves runs, and cells are spelt out at the
    end. Tiles are labelled on their own. Only labels that touch over a tile border go through rounds of minimum labels with pointer jumping, so pictures
    smaller than a tile need no round.
    """
    keys = as_list(keys)
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    cells = mask.select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    # a window holds one row of one picture; repeated cells share their rank
    numbered = cells.withColumn("_g", F.col("x") - F.dense_rank().over(Window.partitionBy(*keys, "y").orderBy("x")))
    pieces = numbered.groupBy(*keys, "y", at("x").alias("_tx"), "_g").agg(F.min("x").alias("a"), F.max("x").alias("b")).drop("_g")
    whole = T.IntegerType()
    schema = T.StructType([cells.schema[k] for k in keys] + [T.StructField(k, whole) for k in ("y", "a", "b")] + [T.StructField("comp_id", T.LongType())])
    local = cut_lineage(pieces.withColumn("_ty", at("y")).groupBy(*keys, "_tx", "_ty").applyInPandas(_tile_labels(keys, conn), schema))
    spell = lambda rows: rows.select(*keys, F.explode(F.sequence("a", "b")).alias("x"), "y", "comp_id")
    steps = [(-1, 0), (-1, -1), (-1, 1), (0, -1), (1, -1)] if conn == 8 else [(-1, 0), (0, -1)]
    # cells along the tile borders: whole runs of the first and last row, one end of runs that reach the first or last column
    last = F.lit(tile - 1)
    rows_of_rim = F.pmod("y", F.lit(tile)).isin(0, tile - 1)
    ends = F.filter(F.array_distinct(F.array("a", "b")), lambda x: (F.pmod(x, F.lit(tile)) == 0) | (F.pmod(x, F.lit(tile)) == last))
    rim = local.select(*keys, F.explode(F.when(rows_of_rim, F.sequence("a", "b")).otherwise(ends)).alias("x"), "y", "comp_id")
    moved = rim.select(*keys, F.col("comp_id").alias("u"), F.explode(F.array(*[F.struct(
        (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])).alias("_m")).select(*keys, "u", "_m.x", "_m.y")
    other = rim.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("comp_id").alias("v"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("x") == F.col("_x"), F.col("y") == F.col("_y"), F.col("u") != F.col("v")]
    edges = moved.join(other, on).select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = cut_lineage(edges)
    if edges.isEmpty():
        return spell(local)
    roots = _min_labels(edges, keys)
    out = attach(local, roots.select(*keys, F.col("node").alias("comp_id"), "label"), keys + ["comp_id"])
    return spell(out.withColumn("comp_id", F.coalesce("label", "comp_id")))


def _min_labels(edges, keys) -> DataFrame:
    """Smallest reachable node per node of an edge list, by hooking and pointer jumping."""
    both = edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("near")).unionByName(
        edges.select(*keys, F.col("v").alias("node"), F.col("u").alias("near")))
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(*keys, "node").agg(F.least(F.min("near"), F.col("node")).alias("label")))
    while True:
        near = attach(both, labels.select(*keys, F.col("node").alias("near"), F.col("label").alias("_n")), keys + ["near"])
        best = near.groupBy(*keys, "node").agg(F.min("_n").alias("_n"))
        hooked = attach(labels, best, keys + ["node"]).withColumn("_m", F.least("label", "_n"))
        pulled = hooked.groupBy(*keys, F.col("label").alias("node")).agg(F.min("_m").alias("_p"))
        moved = attach(hooked, pulled, keys + ["node"]).select(*keys, "node", "label", F.least("_m", "_p").alias("_m"))
        jump = attach(moved, moved.select(*keys, F.col("node").alias("_m"), F.col("_m").alias("_j")), keys + ["_m"])
        after = cut_lineage(jump.select(*keys, "node", F.col("label").alias("_old"), F.least("_m", "_j").alias("label")))
        labels = after.drop("_old")
        if after.where(F.col("_old") != F.col("label")).isEmpty():
            return labels


def component_stats(labelled, keys=("image_id",)) -> DataFrame:
    keys = as_list(keys)
    return labelled.groupBy(*keys, "comp_id").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def keep_components(labelled, kept, keys=("image_id",)) -> DataFrame:
    """Cells of the components in `kept`."""
    keys = as_list(keys)
    ok = kept.select(*keys, "comp_id", F.lit(True).alias("_ok"))
    return attach(labelled, ok, keys + ["comp_id"]).where("_ok").drop("_ok")


# -- rules over components (columns x y w h area cx cy width height) --------------------------------

def _sized(components, images):
    return attach(components, images.select("image_id", "width", "height"), ["image_id"]) if images is not None else components




def _fill():
    return c("area") / F.greatest(c("w") * c("h"), F.lit(1))


def _aspect():
    return c("w") / F.greatest(c("h"), F.lit(1))


def _or_largest(rows, ok, out):
    """Components that pass, or the largest one of an image where none does."""
    best = rows.groupBy("image_id").agg(F.bool_or(ok).alias("_any"), F.max(F.struct("area", "comp_id")).getField("comp_id").alias("_big"))
    return attach(rows, best, ["image_id"]).where(ok | (~c("_any") & (c("comp_id") == c("_big")))).select(*out)


def filter_components_curve(components, images, strict=True) -> DataFrame:
    """Components that look like pieces of a curve, or the largest one. `strict` also drops text-like blobs."""
    rows = _sized(components, images)
    W, H = c("width"), c("height")
    # Sizes and shares of the rules.
    if strict:
        text = ((c("w") < F.least(F.lit(300.0), W * 0.25)) & (c("h") > 12) & (c("h") < F.least(F.lit(50.0), H * 0.1)) & (_fill() < 0.35))
        ok = ((c("area") >= 20) & (c("w") >= F.greatest(F.lit(8.0), W * 0.02)) & ~((c("h") / H > 0.9) & (c("w") / W < 0.2))
              & ~((c("cy") > H * 0.85) & (c("w") < W * 0.1)) & ~text)
    else:
        ok = ((c("area") >= 30) & (c("w") >= F.greatest(F.lit(10.0), W * 0.02)) & ~((c("h") / H > 0.9) & (c("w") / W < 0.3))
              & ~((c("cy") > H * 0.8) & (c("w") < W * 0.1)))
    return _or_largest(rows, ok, components.columns)


def filter_components_noise(components) -> DataFrame:
    """Without small components and small compact dense blobs."""
    # Sizes and shares of the rules.
    squat = F.greatest("w", "h") / F.least("w", "h") < 2
    return components.where((c("area") >= 20) & ~((c("area") < 100) & squat & (_fill() > 0.6)))


def filter_components_text(components, images) -> DataFrame:
    """Without legend, label and annotation components; those above 30% of the second largest area always stay."""
    rows = _sized(components, images)
    W, H, A = c("width"), c("height"), c("area")
    second = _second_area(components)
    rows = attach(rows, second, ["image_id"])
    exempt = A > F.coalesce(c("_second") * 0.3, F.lit(500.0))
    ratio = c("w") / c("h")
    mid = (c("cy") > H * 0.20) & (c("cy") < H * 0.85)
    # Limits of the rules, in their order.
    rules = [  # the first rule that applies decides: True drops, False keeps
        ((c("cy") < H * 0.35) & (c("cx") > W * 0.55) & (A < 1600), True),
        ((c("cy") < H * 0.25) & (A < 800), True),
        ((c("cx") > W * 0.70) & (A < 800) & (A > 30) & (_fill() > 0.15) & (c("h") < 15) & (ratio > 1.5) & mid, False),
        ((c("cx") > W * 0.70) & (A < 800) & (A > 30) & (_fill() > 0.15), True),
        ((c("cy") > H * 0.85) & (A < 500), True),
        ((c("cy") > H * 0.55) & (c("cx") > W * 0.55) & (A < 4000) & (c("h") < 80) & (c("h") / c("w") < 3) & ~((c("h") < 15) & (ratio > 2)), True),
        ((c("cx") > W * 0.75) & (A < 6400) & (A > 30) & ~(((ratio > 3) | ((ratio > 1.5) & (c("h") < 15))) & mid) & ((_fill() > 0.25) | (c("h") > 30)), True),
        ((A > 30) & (A < 800) & (ratio > 1.5) & (c("h") < 30) & (_fill() > 0.2) & ~((c("h") < 15) & (ratio > 2) & mid), True)]
    drop = F.when(exempt, False)
    for cond, verdict in rules:
        drop = drop.when(cond, verdict)
    return rows.where(~drop.otherwise(False)).select(*components.columns)


def filter_components_labels(components, images) -> DataFrame:
    """The second rule set: main curves are exempt, then top strip, right edge, letter, word and corner shapes go."""
    rows = _sized(components, images)
    W, H, A, w, h, x, y = c("width"), c("height"), c("area"), c("w"), c("h"), c("x"), c("y")
    main = ((w > W * 0.3) & (A > 500)) | ((w > W * 0.1) & (w > h * 2) & (A > 200) & (_fill() < 0.4))
    ratio = w / h
    text = (((y < H * 0.15) & (A < 2000)) | ((x > W * 0.85) & (w < W * 0.1) & (A < 300))
            | ((A < 200) & (w < 30) & (h < 30) & (_fill() > 0.2) & (_fill() < 0.95) & (ratio > 0.2) & (ratio < 4.0))
            | ((A < 1500) & (w < 150) & (h < 50) & (_fill() > 0.1) & (_fill() < 0.8) & ((ratio > 2) | (ratio < 0.5)))
            | ((w < W * 0.05) & (A < 200) & (h > w))
            | ((((y < H * 0.2) & ((x < W * 0.15) | (x + w > W * 0.85))) | ((y + h > H * 0.8) & (x < W * 0.15))) & (A < 500) & (w < W * 0.1)))
    return rows.where(main | (A < 5) | ~text).select(*components.columns)


def _second_area(components):
    """Second largest area per image, from the two largest only."""
    from ..ordered import top_rows
    two = top_rows(components.select("image_id", "comp_id", "area"), "image_id", 2, F.desc("area"), "comp_id")
    return two.where("rn = 2").select("image_id", c("area").alias("_second"))


def filter_components_dark(components, images, least=5) -> DataFrame:
    """Dark components that can be lines, censor marks, curve pieces or large parts."""
    rows = _sized(components, images)
    A, w, h, a = c("area"), c("w"), c("h"), _aspect()
    # Sizes and shares of the rules.
    keep = (((w > 10) & (h < 8)) | ((h > 10) & (w < 8)) | ((A < 60) & (a > 0.3) & (a < 3) & (w < 18) & (h < 18)) | (a > 2.5) | (a < 0.4) | (A > 50))
    return rows.where((A >= least) & (c("y") <= c("height") - 10) & keep).select(*components.columns)


def filter_components_black(components) -> DataFrame:
    """Curve pieces and censor marks of a black-on-white picture, without text boxes and letters."""
    A, w, h, a = c("area"), c("w"), c("h"), _aspect()
    # Sizes and shares of the rules.
    box = (A > 200) & (A < 3000) & (a > 1.5) & (a < 10) & (h < 30)
    letter = (A > 10) & (A < 200) & (a > 0.3) & (a < 3) & (w < 25) & (h < 25)
    curve = (a > 5) | (a < 0.2) | ((A > 100) & ((w > 30) | (h > 30))) | ((A < 50) & ((w < 8) | (h < 8)))
    censor = (A < 40) & (a > 0.5) & (a < 2) & (w < 12) & (h < 12)
    return components.where((A >= 5) & (A <= 5000) & (curve | censor) & ~box & ~letter)


def filter_components_letters(components, images) -> DataFrame:
    """Without text-like blobs that are not curve-like, outside the zone where curves start."""
    rows = _sized(components, images)
    A, w, h, a = c("area"), c("w"), c("h"), _aspect()
    # Sizes and shares of the rules.
    start = (c("x") < F.floor(c("width") * 0.15)) & (c("y") < F.floor(c("height") * 0.15))
    text = (A > 20) & (A < 2000) & (a > 0.3) & (a < 3) & (w < 50) & (h < 50) & (_fill() > 0.2)
    curve = (a > 4) | (a < 0.25) | (w > 50) | (h > 50) | (A > 2000)
    return rows.where(start | ~(text & ~curve)).select(*components.columns)


def filter_components_isolated(components, cells, images, margin=15, near=50, tile=64) -> DataFrame:
    """Without small, parenthesis-like or isolated blobs: isolated means fewer than `near` other mask cells within
    `margin` of the box. Boxes and cells meet in tiles."""
    from .joins import _tiles
    rows = _sized(components, images)
    A, w, h, a = c("area"), c("w"), c("h"), _aspect()
    boxes = rows.select("image_id", "comp_id", "x", "y", "w", "h", F.greatest(F.lit(0), c("x") - margin).alias("x1"), (c("x") + c("w") + margin).alias("x2"),
                        F.greatest(F.lit(0), c("y") - margin).alias("y1"), (c("y") + c("h") + margin).alias("y2"))
    parts = boxes.withColumn("_tx", F.explode(_tiles(c("x1"), c("x2"), tile))).withColumn("_ty", F.explode(_tiles(c("y1"), c("y2"), tile)))
    spots = cells.select(c("image_id").alias("_img"), c("x").alias("_x"), c("y").alias("_y")).distinct()
    own = c("_x").between(c("x"), c("x") + c("w") - 1) & c("_y").between(c("y"), c("y") + c("h") - 1)
    met = parts.join(spots, [c("image_id").eqNullSafe(c("_img")), c("_tx") == F.floor(c("_x") / tile).cast("int"), c("_ty") == F.floor(c("_y") / tile).cast("int"),
                             c("_x") >= c("x1"), c("_x") < c("x2"), c("_y") >= c("y1"), c("_y") < c("y2"), ~own])
    n = met.groupBy("image_id", "comp_id").agg(F.count("*").alias("_near"))
    rows = attach(rows, n, ["image_id", "comp_id"])
    alone = F.coalesce(c("_near"), F.lit(0)) < near
    start = (c("x") < F.floor(c("width") * 0.15)) & (c("y") < F.floor(c("height") * 0.15))
    small = (A < 300) & (w < 35) & (h < 35)
    paren = (A > 5) & (A < 800) & (a > 0.1) & (a < 1.2) & (h > 8) & (w < 35) & (_fill() < 0.65)
    dot = (A < 50) & (w < 15) & (h < 15)
    text = (A < 400) & (a > 0.3) & (a < 3) & (w < 40) & (h < 40)
    curve = (a > 5) | (a < 0.2) | (w > 70) | (h > 70) | (A > 600)
    drop = ((small | paren | dot | text) & ~curve) | (alone & (A < 400))
    return rows.where(start | ~drop).select(*components.columns)


def filter_components_annotation(components, least=800, side=80) -> DataFrame:
    """Large connected regions only, for colours that mostly colour text."""
    return components.where((c("area") >= least) & ((c("w") >= side) | (c("h") >= side)))


def protect_components(components, images, short=False, least=50) -> DataFrame:
    """Components to protect from text removal."""
    A, w, h = c("area"), c("w"), c("h")
    stretched = F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h))
    if short:
        return components.where((A >= least) & ((stretched > 3) | (A > 500)))
    rows = attach(_sized(components, images), _second_area(components), ["image_id"])
    H = c("height")
    curve = ((A > F.coalesce(c("_second") * 0.1, F.lit(200.0))) | (stretched > 3) | (h > H * 0.15) | ((w > 30) & (h < 20) & (_fill() < 0.5))
             | ((c("cy") > H * 0.1) & (c("cy") < H * 0.9) & (w > 50)))
    return rows.where((A >= 20) & curve).select(*components.columns)


def protected_cells(labelled, components, images, short=False, least=50) -> DataFrame:
    kept = keep_components(labelled, protect_components(components, images, short, least))
    return m.dilate(kept, images=images, n=2)


def legend_components(mask, images, least=500, bottom=0.35, right=0.65) -> DataFrame:
    """Drop small components of the top right (35% high, right of 65%): the cells of that zone form their own components."""
    rows = attach(mask.select("image_id", "x", "y"), images.select("image_id", "width", "height"), ["image_id"])
    zone = (c("y") < F.floor(c("height") * bottom)) & (c("x") >= F.floor(c("width") * right))
    rows = rows.select("image_id", "x", "y", zone.alias("_z"))
    inner = connected_components(rows.where("_z"))
    big = component_stats(inner).where(c("area") >= least)
    return rows.where(~c("_z")).select("image_id", "x", "y").unionByName(keep_components(inner, big).select("image_id", "x", "y"))


def marks(pixels, images, most=50) -> DataFrame:
    """Centres of small components of the eroded dark unsaturated pixels: censor marks as anchor points."""
    dark = pixels.where((c("s") < 30) & (c("v") > 20) & (c("v") < 100)).select("image_id", "x", "y")
    parts = component_stats(connected_components(m.erode(dark, m.CROSS, images=images), conn=4))
    return parts.where(c("area") < most).select("image_id", F.floor("cx").cast("int").alias("x"), F.floor("cy").cast("int").alias("y"), "area")


def text_boxes(pixels, images) -> DataFrame:
    """Boxes that probably hold text: light regions, the dark strip across the top, and wide short parts on the right.

    Light regions are components of light cells that are present in the raster.
    """
    dims = images.select("image_id", "width", "height")
    light = component_stats(connected_components(pixels.where(c("gray") > 215)))
    light = light.where((c("w") * c("h") > 100) & (c("w") * c("h") < 25000) & (_aspect() > 0.8)).withColumn("_margin", F.lit(15))
    right = attach(pixels.where(c("gray") < 150), dims, ["image_id"]).where(c("x") >= F.floor(c("width") * 0.55))
    right = component_stats(connected_components(right))
    right = right.where((c("area") > 200) & (c("area") < 8000) & (_aspect() > 1.5) & (_aspect() < 10) & (c("h") < 35)).withColumn("_margin", F.lit(10))
    cols = ["image_id", "x", "y", "w", "h", "_margin"]
    boxes = attach(light.select(*cols).withColumn("kind", F.lit("light")).unionByName(right.select(*cols).withColumn("kind", F.lit("right"))), dims, ["image_id"])
    boxes = boxes.select("image_id", "kind", F.greatest(F.lit(0), c("x") - c("_margin")).alias("x1"), F.greatest(F.lit(0), c("y") - c("_margin")).alias("y1"),
                         F.least("width", c("x") + c("w") + c("_margin")).alias("x2"), F.least("height", c("y") + c("h") + c("_margin")).alias("y2"))
    top = attach(pixels.where(c("gray") < 200), dims, ["image_id"])
    strip = F.floor(c("height") * 0.12).cast("int")
    top = top.where(c("y") < strip).groupBy("image_id", "width", "height").agg(F.count("*").alias("_n"), F.min("x").alias("a"), F.max("x").alias("b"))
    top = top.where(c("_n") * 255 > 500).select("image_id", F.lit("top").alias("kind"), F.greatest(F.lit(0), c("a") - 20).alias("x1"), F.lit(0).alias("y1"),
                                                F.least("width", c("b") + 21).alias("x2"), F.least("height", strip + 15).alias("y2"))
    return boxes.unionByName(top)


def panel_start(pixels, images, bounds) -> DataFrame:
    """In wide pictures whose plot lies in the left half: the first column of the right half where at least three coloured
    cells of the upper 60% lie within 30 rows, and the darkest label column near it."""
    rows = attach(images.select("image_id", "width", "height"), bounds, ["image_id"])
    mid = F.floor(c("width") / 2)
    wide = rows.where((F.try_divide("width", "height") >= 1.5) & (c("px") + c("pw") <= mid + 50))
    top = attach(pixels, wide.select("image_id", "py", "ph", "width", "height"), ["image_id"]).where(c("py").isNotNull())
    area = top.where((c("s") > 40) & (c("v") > 40) & (c("v") < 250) & (c("y") >= c("py")) & (c("y") < c("py") + F.floor(c("ph") * 0.6))
                     & (c("x") >= F.floor(c("width") / 2) + 50))
    cols = area.groupBy("image_id", "x").agg(F.count("*").alias("_n"), (F.max("y") - F.min("y")).alias("_r")).where((c("_n") >= 3) & (c("_r") < 30))
    start = cols.groupBy("image_id").agg(F.min("x").alias("start_x"))
    near = attach(top, start, ["image_id"]).where(c("x").between(c("start_x") - 30, c("start_x") + 19)
                                                  & (c("y") >= c("py") + c("ph") - 5) & (c("y") < F.least("height", c("py") + c("ph") + 25)))
    label = near.groupBy("image_id", "x").agg(F.sum(255 - c("gray")).alias("_d")).groupBy("image_id").agg(
        F.max(F.struct("_d", (-c("x")).alias("_x"))).alias("_b")).select("image_id", (-c("_b._x")).alias("label_x"))
    out = attach(attach(wide, start, ["image_id"]), label, ["image_id"]).where(c("start_x").isNotNull())
    return out.select("image_id", "start_x", F.coalesce("label_x", F.greatest(F.lit(0), c("start_x") - 30)).alias("new_px"),
                      (c("width") - F.floor(c("width") * 0.02) - F.coalesce("label_x", F.greatest(F.lit(0), c("start_x") - 30))).cast("int").alias("new_pw"))


# -- line styles -----------------------------------------------------------------------------------

def _presence_runs(rows, keys, x, present):
    o = Ordered(rows, keys, x).lag(_p=present)
    o = o.islands("_run", c("_p").isNull() | (c("_p") != c(present)))
    return o.df.groupBy(*keys, "_run", F.col(present).alias("_on")).agg(F.count("*").alias("_len"), F.min(x).alias("_x"))


def line_style(traced, key="curve_id", x="x", present="present") -> DataFrame:
    """Style and confidence of each curve from its runs of present and missing columns."""
    keys = as_list(key)
    r = _presence_runs(traced.select(*keys, x, present), keys, x, present)
    on, off = F.when(c("_on"), c("_len")), F.when(~c("_on"), c("_len"))
    med = r.where("_on").groupBy(*keys).agg(F.percentile("_len", F.lit(0.5)).alias("_med"))
    st = r.groupBy(*keys).agg(F.sum(F.coalesce(on, F.lit(0))).alias("_p"), F.sum("_len").alias("_t"), F.count(on).alias("_kon"), F.count(off).alias("_koff"),
                              F.avg(on).alias("_aon"), F.avg(off).alias("_aoff"), F.stddev_pop(on).alias("_son"), F.stddev_pop(off).alias("_soff"))
    ons = attach(r.where("_on"), med, keys).withColumn("_long", c("_len") > c("_med"))
    o = Ordered(ons, keys, "_x").lag(_before="_long")
    alt = o.df.groupBy(*keys).agg(F.count_if(c("_before") != c("_long")).alias("_alt"))
    st = attach(st, alt, keys)
    ratio = F.try_divide("_p", "_t")
    regular = (F.try_divide("_son", "_aon") < 0.5) & (F.try_divide("_soff", "_aoff") < 0.5)
    say = lambda s, q: F.struct(F.lit(s).alias("style"), (q if isinstance(q, Column) else F.lit(q)).alias("confidence"))
    both = (c("_kon") > 0) & (c("_koff") > 0)
    style = (F.when(c("_t") < 5, say("unknown", 0.3)).when(ratio > 0.85, say("solid", 0.9))
             .when((ratio < 0.3) & (c("_kon") > 0) & (c("_aon") < 5), say("dotted", 0.6)).when(ratio < 0.3, say("unknown", 0.4))
             .when(both & (c("_aon") < 8) & (c("_aoff") > 3), say("dotted", F.when(regular, 0.7).otherwise(0.5)))
             .when(both & (c("_aon") > 10) & (c("_aoff") > 5), say("dashed", F.when(regular, 0.8).otherwise(0.6)))
             .when(both & (c("_kon") > 4) & (c("_alt") > c("_kon") * 0.6), say("dash_dot", 0.7))
             .when(1 - ratio < 0.15, say("solid", 0.7)).when(1 - ratio < 0.4, say("dashed", 0.6)).otherwise(say("dotted", 0.5)))
    return st.select(*keys, ratio.alias("ratio"), style.alias("_s")).select(*keys, "ratio", "_s.style", "_s.confidence")


def dash_score(traced, pixels, image="image_id", key="curve_id", x="x", y="y", band=2) -> DataFrame:
    """Additive dash score of each curve from the darkest cell within +-band rows of its interpolated path.

    Missing cells are white. Curves of fewer than 30 columns get no score.
    """
    from .clean import fill_linear
    keys = [image, key]
    wide = traced.groupBy(*keys).agg(F.count("*").alias("_n"))
    path = fill_linear(traced, keys, x, y).select(*keys, F.col(x).alias("x"), F.col(y).cast("int").alias("_y"))
    spread = path.select(*keys, "x", F.explode(F.sequence(c("_y") - band, c("_y") + band)).alias("y"))
    gray = pixels.groupBy(image, "x", "y").agg(F.min("gray").alias("_g"))
    low = attach(spread, gray, [image, "x", "y"]).groupBy(*keys, "x").agg(F.min(F.coalesce("_g", F.lit(255))).alias("_i"))
    low = low.withColumns({"_light": c("_i") > 180, "_dark": c("_i") < 100})
    gaps = _presence_runs(low, keys, "x", "_light").where(c("_on") & (c("_len") >= 3)).groupBy(*keys).agg(
        F.count("*").alias("gaps"), F.avg("_len").alias("_ga"), F.stddev_pop("_len").alias("_gs"))
    segs = _presence_runs(low, keys, "x", "_dark").where(c("_on") & (c("_len") >= 3)).groupBy(*keys).agg(F.avg("_len").alias("_sa"))
    st = low.groupBy(*keys).agg(F.avg(c("_dark").cast("double")).alias("dark"))
    for part in (gaps, segs, wide):
        st = attach(st, part, keys)
    n = F.coalesce(c("gaps"), F.lit(0))
    cv = F.try_divide("_gs", "_ga")
    reg = F.when(n >= 3, F.when(cv < 0.5, 1.0).when(cv < 1.0, 0.5).otherwise(0.0)).otherwise(0.0)
    score = (F.when(n >= 10, 4).when(n >= 6, 3).when(n >= 3, 2).otherwise(0) + F.when((reg >= 0.5) & (n >= 3), 2).otherwise(0)
             + F.when((n >= 2) & c("_ga").between(4, 20), 1).otherwise(0) + F.when(c("dark") < 0.80, 1).otherwise(0)
             - F.when(c("dark") > 0.95, 2).when(c("dark") > 0.90, 1).otherwise(0) - F.when(n <= 1, 2).otherwise(0)
             - F.when((c("_sa") > 50) & (n < 5), 1).otherwise(0))
    score = F.greatest(F.lit(0), score)
    style = F.when(c("_n") < 30, "unknown").when(score >= 3, "dashed").otherwise("solid")
    conf = F.when(c("_n") < 30, 0.3).when(score >= 5, 0.9).when(score >= 3, 0.7).otherwise(0.85)
    return st.select(*keys, n.alias("gaps"), "dark", F.when(c("_n") >= 30, score).alias("score"), style.alias("style"), conf.alias("confidence"))


# -- tokens, regions, ranges -----------------------------------------------------------------------

def group_tokens_by_row(tokens, image="image_id", tol=15, y="center_y", x="center_x", seq=None) -> DataFrame:
    """Tokens with the row they join: the first anchor, in input order, within `tol`; other tokens become anchors.

    Only the distinct whole rows of a page, with their first appearance, matter; gaps of `tol` cut them into islands, each of which is gathered (at most
    the height of a page) and read in input order.
    """
    seq = seq or [y, x]
    rows = tokens.withColumn("_y", F.floor(y).cast("int"))
    first = rows.groupBy(image, "_y").agg(F.min(F.struct(*seq)).alias("_s"))
    o = Ordered(first, image, "_y").lag(_p="_y")
    o = o.islands("_island", c("_p").isNull() | (c("_y") - c("_p") >= tol))
    near = lambda a, b: F.abs(a - b) < tol
    islands = o.df.groupBy(image, "_island").agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_y"))), lambda r: r["_y"]).alias("_ys"))
    anchors = F.aggregate("_ys", F.array().cast("array<int>"), lambda seen, v: F.when(F.exists(seen, lambda a: near(a, v)), seen).otherwise(F.concat(seen, F.array(v))))
    joined = islands.withColumn("_as", anchors).select(image, "_as", F.explode("_ys").alias("_y"))
    found = joined.select(image, "_y", F.get(F.filter("_as", lambda a: near(a, c("_y"))), F.lit(0)).alias("row_y"))
    return attach(rows, found, [image, "_y"], grows=True).drop("_y")


def consolidate_regions(regions, key="curve_id", t="t", offset="offset", gap=1.0) -> DataFrame:
    """Regions closer than `gap` to the last kept one merge into the larger of the two; ranked by size."""
    keys = as_list(key)
    kinds = dict(regions.dtypes)

    kind = f"struct<{t}: {kinds[t]}, {offset}: {kinds[offset]}>"

    def step(last, row, put):
        now = F.struct(row[t].alias(t), row[offset].alias(offset))
        close = last.isNotNull() & (row[t] - last[t] < gap)
        return put(F.when(close & (F.abs(row[offset]) <= F.abs(last[offset])), last).otherwise(now), F.when(~close, last))

    o = Ordered(regions.select(*keys, t, offset), keys, t, offset).lag(_p=t)
    kept = fold_islands(o, c("_p").isNull() | (c(t) - c("_p") >= gap), step, kind, kind, finish=lambda last: last)
    neg = Ordered(kept.withColumn("_size", -F.abs(F.col(offset))), keys, "_size", [t]).row_number("rank")
    return neg.df.select(*keys, t, offset, "rank")


def index_ranges(numbers, key="curve_id", x="x") -> DataFrame:
    """Consecutive whole numbers as ranges with their text (1-4, or 7 for a single one), one row per range."""
    keys = as_list(key)
    o = Ordered(numbers.select(*keys, x).distinct(), keys, x).lag(_p=x)
    o = o.islands("_r", c("_p").isNull() | (c(x) - c("_p") > 1))
    r = o.df.groupBy(*keys, "_r").agg(F.min(x).alias("first"), F.max(x).alias("last"))
    text = F.when(c("first") == c("last"), c("first").cast("string")).otherwise(F.concat_ws("-", c("first").cast("string"), c("last").cast("string")))
    return r.select(*keys, "first", "last", text.alias("range"))
