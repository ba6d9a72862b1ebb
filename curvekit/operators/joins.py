"""Lookups and joins between points, grids, pixels and boxes.

Ordered lookups run as one union and running columns; spatial ones as equi-joins on (image, tile), so no step
compares all pairs of an image.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordered import Ordered
from ..runtime import as_list, attach


# -- two curves on one grid ------------------------------------------------------------------------

def side_by_side(points, image="image_id", style="style", a="a", b="b", t="t", s="s", digits=3, how="inner") -> DataFrame:
    """One row per image and time with the values `y1` of style a and `y2` of style b.

    The two curves are never joined: one aggregation on (image, time) lays them side by side. Of several rows at a
    rounded time the last one counts. how: inner | full.
    """
    images = as_list(image)
    rows = points.where(F.col(style).isin(a, b)).select(
        *images, F.col(style).alias("_k"), (F.round(t, digits) if digits is not None else F.col(t)).alias("_tk"), F.struct(t, s).alias("_p"))
    pick = lambda v: F.max(F.when(F.col("_k") == v, F.col("_p"))).getField(s)
    wide = rows.groupBy(*images, "_tk").agg(pick(a).alias("y1"), pick(b).alias("y2")).withColumnRenamed("_tk", t)
    return wide.where(F.col("y1").isNotNull() & F.col("y2").isNotNull()) if how == "inner" else wide


def early_union(points, until: DataFrame, image="image_id", style="style", a="a", b="b", t="t", s="s") -> DataFrame:
    """Times before each image's `until.t_div` in either curve, with one shared value (the mean where both have one)."""
    wide = attach(side_by_side(points, image, style, a, b, t, s, how="full"), until, as_list(image))
    shared = F.when(F.col("y1").isNotNull() & F.col("y2").isNotNull(), (F.col("y1") + F.col("y2")) / 2).otherwise(F.coalesce("y1", "y2"))
    return wide.where(F.col(t) < F.col("t_div")).select(*as_list(image), t, "y1", "y2", shared.alias("shared"))


# -- ordered lookups -------------------------------------------------------------------------------

def _merged(points, grid, keys, t, s):
    p = points.groupBy(*keys, t).agg(F.max(s).alias("_last"), F.min(s).alias("_first")).withColumn("_g", F.lit(0))
    g = grid.select(*keys, t).distinct().withColumn("_g", F.lit(1))
    return p.unionByName(g, allowMissingColumns=True)


def asof_step(points, grid, key="curve_id", t="t", s="s", or_first=False) -> DataFrame:
    """Value of the last row at or before each grid time; null before the first row, or the first value."""
    keys = as_list(key)
    o = Ordered(_merged(points, grid, keys, t, s), keys, t, "_g").running(_v=("last", "_last"))
    if or_first:
        o = o.running(reverse=True, _n=("first", "_first"))
    value = F.coalesce("_v", "_n") if or_first else F.col("_v")
    return o.df.where("_g = 1").select(*keys, t, value.alias(s))


def nearest(points, grid, key="curve_id", t="t", s="s", within=None) -> DataFrame:
    """The row closest in time to each grid time (the earlier one on ties)."""
    keys = as_list(key)
    row = F.when(F.col("_g") == 0, F.struct(F.col(t).alias("t"), F.col("_first").alias("s")))
    o = Ordered(_merged(points, grid, keys, t, s), keys, t, "_g")
    o = o.running(_p=("last", row)).running(reverse=True, _q=("first", row))
    dp, dq = F.col(t) - F.col("_p.t"), F.col("_q.t") - F.col(t)
    near = F.when(F.col("_q").isNull() | (dp <= dq), F.col("_p")).otherwise(F.col("_q"))
    out = o.df.where("_g = 1").select(*keys, t, near.alias("_n"))
    out = out.select(*keys, t, F.col("_n.t").alias("near_t"), F.col("_n.s").alias(s))
    return out if within is None else out.where(F.abs(F.col("near_t") - F.col(t)) < within)


# -- boxes and neighbourhoods ----------------------------------------------------------------------

def box_edges(boxes, x="x", y="y", w="w", h="h", pad=0) -> DataFrame:
    """Half-open edges x1 y1 x2 y2 of padded boxes, cut at 0."""
    return boxes.withColumns({"x1": F.greatest(F.lit(0), F.col(x) - pad), "y1": F.greatest(F.lit(0), F.col(y) - pad),
                              "x2": F.col(x) + F.col(w) + pad, "y2": F.col(y) + F.col(h) + pad})


def readable_boxes(boxes, conf=30, least=5, plot_w=None, plot_h=None, text="text") -> DataFrame:
    """Boxes with confidence above `conf`, some text, no side under `least`, and not large against the plot."""
    ok = (F.col("conf") > conf) & (F.length(F.trim(text)) > 0) & (F.col("w") >= least) & (F.col("h") >= least)
    if plot_w is not None:
        ok = ok & (F.col("w") <= plot_w * 0.5) & (F.col("h") <= plot_h * 0.2)
    return boxes.where(ok)


def _tiles(lo: Column, hi: Column, tile: int) -> Column:
    """Tile numbers that the half-open range [lo, hi) touches (none when it is empty)."""
    a, b = F.floor(lo / tile).cast("int"), F.floor((hi - 1) / tile).cast("int")
    return F.when(hi > lo, F.sequence(a, b))


def box_cells(boxes, image="image_id", tile=64) -> DataFrame:
    """The part of each box in each tile. A tile's parts stay separate rows but exact copies are merged."""
    return (boxes.select(F.col(image).alias("_img"), "x1", "y1", "x2", "y2").distinct()
            .withColumn("_tx", F.explode(_tiles(F.col("x1"), F.col("x2"), tile)))
            .withColumn("_ty", F.explode(_tiles(F.col("y1"), F.col("y2"), tile))))


def in_boxes(pixels, boxes, image="image_id", x="x", y="y", tile=64, keep=False) -> DataFrame:
    """Pixels outside all boxes (or inside some box with keep=True)."""
    on = [F.col(image).eqNullSafe(F.col("_img")), F.floor(F.col(x) / tile).cast("int") == F.col("_tx"),
          F.floor(F.col(y) / tile).cast("int") == F.col("_ty"), F.col(x) >= F.col("x1"), F.col(x) < F.col("x2"),
          F.col(y) >= F.col("y1"), F.col(y) < F.col("y2")]
    return pixels.join(box_cells(boxes, image, tile), on, "left_semi" if keep else "left_anti")


def mask_boxes(pixels, tokens, image="image_id", pad=3, tile=64) -> DataFrame:
    """Drop the pixels inside padded token boxes."""
    return in_boxes(pixels, box_edges(tokens, pad=pad), image, tile=tile)


def protect_then_mask(pixels, boxes, protected, image="image_id", tile=64) -> DataFrame:
    """Drop box pixels unless they belong to the protected mask.

    One aggregation marks the protected cells, so only unprotected pixels go through the box test.
    """
    cells = protected.select(image, "x", "y").distinct().withColumn("_keep", F.lit(True))
    marked = attach(pixels, cells, [image, "x", "y"])
    open_ones = in_boxes(marked.where(F.col("_keep").isNull()), boxes, image, tile=tile)
    return marked.where("_keep").unionByName(open_ones).drop("_keep")


def _column_neighbours(cells, probes, image):
    """Closest set cells above (or level) and below each probe of a column, as `_up` and `_down`.

    Cells and probes of a column are laid out together; a column holds at most a picture's height of each.
    """
    both = cells.withColumn("_d", F.lit(0)).unionByName(probes.withColumn("_d", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(image, "_x").orderBy("_y", "_d")
    cell = F.when(F.col("_d") == 0, F.col("_y"))
    both = both.withColumns({"_up": F.last(cell, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                             "_down": F.first(cell, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    return both.where("_d = 1")


def nearest_dark(points, dark, image="image_id", x="px", y="py", radius=8) -> DataFrame:
    """Closest dark pixel within a square of `radius`: `dist` (null when none) and its row `near_y`.

    Each point looks up its closest pixel above and below in its own column first, then only in the columns that are no farther away than that pixel;
    a point on a dark pixel asks for no more. No pairs are made; ties go to the first in (dy, dx). Copies of a point or a pixel are looked up once.
    """
    cells = dark.select(image, F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    dx, dy = F.col("_x") - F.col("_px"), lambda n: F.col(n) - F.col("_y")
    found = F.array_min(F.array(*[F.when(F.abs(dy(n)) <= radius, F.struct((dx * dx + dy(n) * dy(n)).alias("d2"), dy(n).alias("dy"), dx.alias("dx"))) for n in ("_up", "_down")]))
    asked = points.select(image, F.col(x).alias("_px"), F.col(y).alias("_y")).distinct().withColumn("_x", F.col("_px"))
    own = _column_neighbours(cells, asked, image).select(image, "_px", "_y", found.alias("_f"))
    # a column as far away as the pixel found can still hold one that comes first in (dy, dx); the own column is looked up again, which spares a second use of the rows
    reach = F.coalesce(F.abs("_f.dy"), F.lit(radius))
    probes = own.select(image, "_px", "_y", F.explode(F.sequence(F.col("_px") - reach, F.col("_px") + reach)).alias("_x"))
    near = _column_neighbours(cells, probes, image).select(image, "_px", "_y", found.alias("_f"))
    best = near.groupBy(image, "_px", "_y").agg(F.min("_f").alias("_b")).where("_b is not null")
    best = best.select(image, F.col("_px").alias(x), F.col("_y").alias(y), F.sqrt(F.col("_b.d2").cast("double")).alias("dist"), (F.col("_y") + F.col("_b.dy")).alias("near_y"))
    return attach(points, best, [image, x, y])


def nearest_vertical(points, mask, image="image_id", x="x", y="y", radius=15) -> DataFrame:
    """Signed offset to the closest set pixel in the same column within `radius` (upwards on ties)."""
    cells = mask.select(image, F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    near = _column_neighbours(cells, points.select(image, F.col(x).alias("_x"), F.col(y).alias("_y")).distinct(), image)
    found = F.array(*[F.when(F.abs(F.col(n) - F.col("_y")) <= radius, F.struct(F.abs(F.col(n) - F.col("_y")).alias("a"), (F.col(n) - F.col("_y")).alias("o"))) for n in ("_up", "_down")])
    best = near.select(image, F.col("_x").alias(x), F.col("_y").alias(y), F.array_min(found).getField("o").alias("offset"))
    return attach(points, best.where("offset is not null"), [image, x, y])


def any_in_gap(gaps, mask, image="image_id", x="x", lo="y1", hi="y2", inset=2, tile=32) -> DataFrame:
    """Gaps (x, y1, y2) with a flag telling whether a set pixel lies in [y1 + inset, y2 - inset)."""
    cells = mask.select(F.col(image).alias("_img"), F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    cells = cells.withColumn("_ty", F.floor(F.col("_y") / tile).cast("int"))
    a, b = F.col(lo) + inset, F.col(hi) - inset
    asked = gaps.select(image, x, lo, hi).distinct().withColumn("_ay", F.explode(_tiles(a, b, tile)))
    hit = asked.join(cells, [F.col(image).eqNullSafe(F.col("_img")), F.col(x) == F.col("_x"), F.col("_ay") == F.col("_ty"),
                             F.col("_y") >= a, F.col("_y") < b], "left_semi")
    hit = hit.select(image, x, lo, hi).distinct().withColumn("_h", F.lit(True))
    return attach(gaps, hit, [image, x, lo, hi]).withColumn("has_pixels", F.coalesce("_h", F.lit(False))).drop("_h")


# -- names -----------------------------------------------------------------------------------------

GRAM = 4


def _name_forms(names: DataFrame, name: str) -> DataFrame:
    """`names` with one row for each form of the name that is compared: `form` (raw: lower case, bare: letters and digits only) and `text`."""
    low = F.lower(name)
    bare = F.regexp_replace(low, "[^a-z0-9]", "")
    forms = F.array(F.struct(F.lit("raw").alias("form"), low.alias("text")), F.struct(F.lit("bare").alias("form"), bare.alias("text")))
    return names.select("*", F.explode(forms).alias("_f")).select(*names.columns, "_f.form", "_f.text").where((F.col("text") != "") | (F.col("form") == "raw"))


def _contained(hay: DataFrame, needles: DataFrame, image: str, carry: list[str]) -> DataFrame:
    """`image, form, text` and `carry` for each needle text that a name of `hay` contains.

    A name contains a text when one of its suffixes begins with it. Suffixes meet the needles' first four letters, which bring the lengths of the needles that
    begin so (at most as many as a name is long); only there are substrings made. Needles of fewer letters bring their lengths to all names of their image.
    """
    n = F.length("text")
    sizes = F.array_sort(F.collect_set(n)).alias("_sizes")
    near = [F.col(image).eqNullSafe(F.col("_img")), F.col("form") == F.col("_form")]
    known = needles.select(F.col(image).alias("_img"), F.col("form").alias("_form"), "text")
    starts = known.where(n >= GRAM).groupBy("_img", "_form", F.substring("text", 1, GRAM).alias("_gram")).agg(sizes)
    ends = hay.where(n >= GRAM).select(image, "form", *carry, F.explode(F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring("text", i, n))).alias("_end"))
    met = ends.join(starts, [*near, F.substring("_end", 1, GRAM) == F.col("_gram")])
    long = met.select(image, "form", *carry, F.explode(F.transform(F.filter("_sizes", lambda k: k <= F.length("_end")), lambda k: F.substring(F.col("_end"), F.lit(1), k))).alias("text"))
    few = known.where(n < GRAM).groupBy("_img", "_form").agg(sizes)
    parts = F.flatten(F.transform(F.filter("_sizes", lambda k: k <= n), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k, F.lit(0)) + 1), lambda i: F.substring(F.col("text"), i, k))))
    short = hay.join(few, near).select(image, "form", *carry, F.explode(F.array_distinct(parts)).alias("text"))
    return long.unionByName(short)


def first_similar(left, right, image="image_id", a="name_a", b="name_b", order: str | None = None) -> DataFrame:
    """For each b of `right` the first similar a of `left` (by the column `order` of `left`, then by name).

    Names are similar when one contains the other (case-insensitive, or by letters and digits only), or when their letters and digits share the first four.
    Both sides are reduced to the first name of each text before they meet, so no pairs of names are made: a text gives one row for each b.
    """
    seq = F.lit(0) if order is None else F.col(order)
    la = left.where(F.col(a).isNotNull()).groupBy(image, a).agg(F.min(F.struct(seq.alias("seq"), F.col(a).alias("name"))).alias("_first"))
    la = _name_forms(la, a).select(image, "form", "text", "_first")
    rb = _name_forms(right.where(F.col(b).isNotNull()).select(image, b).distinct(), b)
    start = lambda df: df.where((F.col("form") == "bare") & (F.length("text") >= GRAM)).withColumns({"form": F.lit("start"), "text": F.substring("text", 1, GRAM)})
    firsts = lambda df: df.groupBy(image, "form", "text").agg(F.min("_first").alias("_first"))

    inside_a = firsts(_contained(la, rb, image, ["_first"]).unionByName(start(la)))
    inside_b = _contained(rb, la, image, [b]).distinct()
    on = lambda x, y: x.join(y.select(F.col(image).alias("_img"), F.col("form").alias("_form"), F.col("text").alias("_text"), *[c for c in y.columns if c not in (image, "form", "text")]),
                             [F.col(image).eqNullSafe(F.col("_img")), F.col("form") == F.col("_form"), F.col("text") == F.col("_text")]).select(image, b, "_first")
    met = on(rb.unionByName(start(rb)), inside_a).unionByName(on(inside_b, firsts(la)))
    return met.groupBy(image, b).agg(F.min("_first").getField("name").alias(a))


def merge_box_passes(first, second, image="image_id", seq="seq", near=10) -> DataFrame:
    """First-pass boxes, and the second-pass ones (in `seq` order) not within `near` pixels in x and y of an earlier one.

    Boxes at the same place as an earlier one never survive, so each place is seen once. Boxes on two sides of a gap of `near` without a box do not matter to
    each other: gaps in x, then in y cut an image into islands, each of which is gathered (the boxes of one spot of a picture) and read in `seq` order.
    """
    cols = [image, "x", "y", "w", "h"]
    zone = first.select(image, (F.col("x") - (near - 1)).alias("x1"), (F.col("y") - (near - 1)).alias("y1"),
                        (F.col("x") + near).alias("x2"), (F.col("y") + near).alias("y2"))
    fresh = in_boxes(second, zone, image, tile=32)
    once = fresh.groupBy(image, "x", "y").agg(F.min(F.struct(seq, "w", "h")).alias("_r"))
    places = once.select(image, "x", "y", F.struct(F.col(f"_r.{seq}").alias("seq"), "x", "y", "_r.w", "_r.h").alias("_box"))
    far = F.col("_p").isNull() | (F.col("_at") - F.col("_p") >= near)
    o = Ordered(places.withColumn("_at", F.col("x")), image, "_at", ["y"]).lag(_p="_at").islands("_i", far)
    o = Ordered(o.df.withColumn("_at", F.col("y")), [image, "_i"], "_at", ["x"]).lag(_p="_at").islands("_k", far)
    boxes = o.df.groupBy(image, "_i", "_k").agg(F.array_sort(F.collect_list("_box")).alias("_boxes"))
    close = lambda p, q: (F.abs(p["x"] - q["x"]) < near) & (F.abs(p["y"] - q["y"]) < near)
    kept = F.aggregate("_boxes", F.slice("_boxes", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda p: close(p, b)), kept).otherwise(F.concat(kept, F.array(b))))
    return first.select(*cols).unionByName(boxes.select(image, F.explode_outer(kept).alias("_b")).select(image, "_b.x", "_b.y", "_b.w", "_b.h"))


# -- masks -----------------------------------------------------------------------------------------

def upper_bound_filter(dark, others, image="image_id", slack=3) -> DataFrame:
    """Dark pixels not above the highest other curve of their column (by more than `slack`)."""
    tops = others.groupBy(image, "x").agg(F.min("y").alias("_top"))
    return attach(dark, tops, [image, "x"]).where(F.col("_top").isNull() | (F.col("y") >= F.col("_top") - slack)).drop("_top")


def dash_overlap(traced, mask, image="image_id", key="curve_id", x="x", y="y") -> DataFrame:
    """Share of each curve's cells that lie in the mask."""
    cells = mask.select(image, "x", "y").distinct().withColumn("_m", F.lit(1))
    rows = traced.select(image, key, F.col(x).alias("x"), F.col(y).cast("int").alias("y"))
    return attach(rows, cells, [image, "x", "y"]).groupBy(image, key).agg(
        F.count("*").alias("cells"), (F.count("_m") / F.count("*")).alias("ratio"))


def merge_masks(first, second, image="image_id", value="v") -> DataFrame:
    """Union of two masks; where both have a cell the first one's value stays."""
    both = first.select(image, "x", "y", value).withColumn("_p", F.lit(0)).unionByName(
        second.select(image, "x", "y", value).withColumn("_p", F.lit(1)))
    return both.groupBy(image, "x", "y").agg(F.min(F.struct("_p", value)).getField(value).alias(value))


def paint_layers(layers: list[DataFrame], image="image_id", label="label") -> DataFrame:
    """One label per cell; later layers overwrite earlier ones."""
    out = None
    for i, layer in enumerate(layers):
        part = layer.select(image, "x", "y", label).withColumn("_p", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(image, "x", "y").agg(F.max(F.struct("_p", label)).getField(label).alias(label))
