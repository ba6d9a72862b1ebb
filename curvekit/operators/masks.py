"""Set operations, morphology and thin lines on sparse masks: rows (keys..., x, y), by default keyed by image_id.

A kernel is a list of (dx, dy) offsets. With `images` (width, height) cells outside a picture neither appear nor
count as missing; without it everything outside is unset.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..islands import fold_islands, once
from ..ordered import Ordered
from ..runtime import as_list, attach


def mask_union(a, b, keys=("image_id", "x", "y")) -> DataFrame:
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def mask_intersect(a, b, keys=("image_id", "x", "y")) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def mask_except(a, b, keys=("image_id", "x", "y")) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def rect(w: int, h: int) -> list[tuple[int, int]]:
    """Offsets of a full w x h kernel with its anchor at (w // 2, h // 2)."""
    return [(i - w // 2, j - h // 2) for j in range(h) for i in range(w)]


FAR = 1 << 30
CROSS = [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1)]


def _inside(df, images, keys):
    df = df.where((F.col("x") >= 0) & (F.col("y") >= 0))
    if images is None:
        return df
    sized = attach(df, images.select("image_id", "width", "height"), ["image_id"])
    return sized.where((F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))).drop("width", "height")


def _spread(mask, keys, offsets):
    """Every cell moved by every offset."""
    moves = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in offsets])
    return mask.select(*keys, F.explode(moves).alias("_m")).select(*keys, "_m.x", "_m.y")


def _box(kernel) -> tuple[int, int, int, int] | None:
    """Smallest and largest dx and dy of a kernel that is a full rectangle around its anchor."""
    xs, ys = {dx for dx, _ in kernel}, {dy for _, dy in kernel}
    x1, x2, y1, y2 = min(xs), max(xs), min(ys), max(ys)
    full = len(set(kernel)) == (x2 - x1 + 1) * (y2 - y1 + 1)
    return (x1, x2, y1, y2) if full and x1 <= 0 <= x2 and y1 <= 0 <= y2 else None


def _stretches(mask, keys, line, pos, gap):
    """First and last cell of each stretch along `pos` without a step of more than `gap`. A partition is one row or column of one picture."""
    w = Window.partitionBy(*keys, line).orderBy(pos)
    rows = mask.withColumn("_s", (F.coalesce(F.col(pos) - F.lag(pos).over(w), F.lit(FAR)) > gap).cast("int")).withColumn("_run", F.sum("_s").over(w))
    return rows.groupBy(*keys, line, "_run").agg(F.min(pos).alias("_a"), F.max(pos).alias("_b"))


def _cells(stretches, keys, line, pos, first, last):
    rows = stretches.withColumns({"_c": first, "_d": last}).where(F.col("_c") <= F.col("_d"))
    return rows.select(*keys, line, F.explode(F.sequence("_c", "_d")).alias(pos))


def _widened(mask, keys, line, pos, lo, hi):
    """Every cell moved by -hi to -lo along `pos`: stretches that would touch are one, so the work does not grow with the reach."""
    return _cells(_stretches(mask, keys, line, pos, hi - lo + 1), keys, line, pos, F.col("_a") - hi, F.col("_b") - lo)


def _narrowed(mask, images, keys, line, pos, lo, hi, size):
    """Cells whose neighbours from lo to hi along `pos` are all set, or outside the picture if `images` are given."""
    rows = _stretches(mask, keys, line, pos, 1)
    first, last = F.col("_a") - lo, F.col("_b") - hi
    if images is not None:
        rows = attach(rows, images.select("image_id", size), ["image_id"])
        first = F.when(F.col("_a") == 0, 0).otherwise(first)
        last = F.when(F.col("_b") == F.col(size) - 1, F.col("_b")).otherwise(last)
    return _cells(rows, keys, line, pos, first, last)


def dilate(mask, kernel=None, n=1, images=None, keys=("image_id",)) -> DataFrame:
    """Full rectangles widen the stretches of each row, then of each column; other kernels move every cell by every offset."""
    keys, kernel = as_list(keys), kernel or rect(3, 3)
    out, box = mask.select(*keys, "x", "y"), _box(kernel)
    for _ in range(n):
        if box is None:
            out = _inside(_spread(out, keys, [(-dx, -dy) for dx, dy in kernel]), images, keys).distinct()
        else:
            wide = _widened(out, keys, "y", "x", box[0], box[1])
            out = _inside(_widened(wide, keys, "x", "y", box[2], box[3]).select(*keys, "x", "y"), images, keys)
    return out


def erode(mask, kernel=None, n=1, images=None, keys=("image_id",)) -> DataFrame:
    """Cells whose whole kernel neighbourhood is set. Full rectangles narrow the stretches of each row, then of each column; with other kernels each set cell
    votes for the cells it belongs to."""
    keys, kernel = as_list(keys), kernel or rect(3, 3)
    out, box = mask.select(*keys, "x", "y").distinct(), _box(kernel)
    for _ in range(n):
        if box is not None:
            narrow = _narrowed(out, images, keys, "y", "x", box[0], box[1], "width")
            out = _inside(_narrowed(narrow, images, keys, "x", "y", box[2], box[3], "height").select(*keys, "x", "y"), images, keys)
            continue
        votes = _inside(_spread(out, keys, [(-dx, -dy) for dx, dy in kernel]), images, keys)
        votes = votes.groupBy(*keys, "x", "y").agg(F.count("*").alias("_n"))
        need = F.lit(len(kernel))
        if images is not None:
            votes = attach(votes, images.select("image_id", "width", "height"), ["image_id"])
            need = sum([((F.col("x") + dx).between(0, F.col("width") - 1)
                         & (F.col("y") + dy).between(0, F.col("height") - 1)).cast("int") for dx, dy in kernel], F.lit(0))
        out = votes.where(F.col("_n") == need).select(*keys, "x", "y")
    return out


def opened(mask, kernel=None, images=None, keys=("image_id",)) -> DataFrame:
    return dilate(erode(mask, kernel, 1, images, keys), kernel, 1, images, keys)


def closed(mask, kernel=None, images=None, keys=("image_id",)) -> DataFrame:
    return erode(dilate(mask, kernel, 1, images, keys), kernel, 1, images, keys)


# -- thin lines ------------------------------------------------------------------------------------

def _span(df, part, pos, size):
    """Distance from each cell to the first unset cell before and after it in its run along `pos`.

    A partition is one row or column of one picture.
    """
    w = Window.partitionBy(*part).orderBy(pos)
    df = df.withColumn("_s", (F.coalesce(F.col(pos) - F.lag(pos).over(w), F.lit(2)) > 1).cast("int"))
    df = df.withColumn("_run", F.sum("_s").over(w))
    wr = Window.partitionBy(*part, "_run")
    a, b = F.min(pos).over(wr), F.max(pos).over(wr)
    before, after = F.col(pos) - a + 1, b - F.col(pos) + 1
    if size is not None:
        before = F.when(a == 0, FAR).otherwise(before)
        after = F.when(b == F.col(size) - 1, FAR).otherwise(after)
    return df.withColumns({"_before": before, "_after": after}).drop("_s")


def block_distance(mask, images=None, keys=("image_id",)) -> DataFrame:
    """City-block distance `d` of every cell to the nearest unset cell, from one pass over columns and one over rows."""
    keys = as_list(keys)
    rows = mask.select(*keys, "x", "y").distinct()
    if images is not None:
        rows = attach(rows, images.select("image_id", "width", "height"), ["image_id"])
    sized = images is not None
    cols = _span(rows, keys + ["x"], "y", "height" if sized else None)
    cols = cols.withColumn("_g", F.least("_before", "_after")).drop("_run", "_before", "_after")
    line = _span(cols, keys + ["y"], "x", "width" if sized else None)
    w = Window.partitionBy(*keys, "y", "_run").orderBy("x")
    left = F.min(F.col("_g") - F.col("x")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("x")
    right = F.min(F.col("_g") + F.col("x")).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("x")
    return line.select(*keys, "x", "y", F.least("_before", "_after", left, right).cast("int").alias("d"))


def skeleton(mask, images=None, keys=("image_id",)) -> DataFrame:
    """Morphological skeleton under the 3 x 3 cross.

    The union of the residues of repeated opening is the set of cells without a 4-neighbour that is farther from
    the outside than they are, so no erosion rounds are run: distances are computed once and compared with neighbours.
    """
    keys = as_list(keys)
    d = block_distance(mask, images, keys)
    moves = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(dx == dy).alias("own")) for dx, dy in CROSS])
    votes = d.select(*keys, "d", F.explode(moves).alias("_m"))
    best = votes.groupBy(*keys, "_m.x", "_m.y").agg(F.max(F.when(F.col("_m.own"), F.col("d"))).alias("_own"),
                                                   F.max(F.when(~F.col("_m.own"), F.col("d"))).alias("_near"))
    return best.where(F.col("_own").isNotNull() & (F.coalesce("_near", F.lit(0)) <= F.col("_own"))).select(*keys, "x", "y")


def endpoints(mask, keys=("image_id",)) -> DataFrame:
    """Cells with at most one of the eight neighbours set."""
    keys = as_list(keys)
    moves = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(dx == 0 and dy == 0).alias("own"))
                      for dx, dy in rect(3, 3)])
    votes = mask.select(*keys, "x", "y").distinct().select(*keys, F.explode(moves).alias("_m"))
    n = votes.groupBy(*keys, "_m.x", "_m.y").agg(F.bool_or("_m.own").alias("_own"), F.count("*").alias("_n"))
    return n.where(F.col("_own") & (F.col("_n") <= 2)).select(*keys, "x", "y")


def bridge_endpoints(mask, max_gap=30, shape="step", keys=("image_id",)) -> DataFrame:
    """Join each endpoint, in reading order, to the closest later free endpoint and fill the cells between.

    shape "step": horizontal, vertical and L-shaped bridges; "line": straight bridges up to `max_gap` long.
    Candidates meet in tiles, so a cell sees at most the endpoints within its reach. Endpoints that no earlier one reaches cut a picture into islands, each
    of which is folded inside the JVM; what is carried from one to the next are the taken endpoints that still lie ahead.
    """
    keys = as_list(keys)
    ends = endpoints(mask, keys)
    tile = max_gap + 1
    t = lambda c: F.floor(F.col(c) / tile).cast("int")
    left = ends.select(*keys, "x", "y", F.explode(F.sequence(t("x") - 1, t("x") + 1)).alias("_tx"), t("y").alias("_t"))
    left = left.select(*keys, "x", "y", "_tx", F.explode(F.array(F.col("_t"), F.col("_t") + 1)).alias("_ty"))
    right = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("x").alias("x2"), F.col("y").alias("y2"), t("x").alias("_ux"), t("y").alias("_uy"))
    dx, dy = F.abs(F.col("x2") - F.col("x")), F.abs(F.col("y2") - F.col("y"))
    later = (F.col("y2") > F.col("y")) | ((F.col("y2") == F.col("y")) & (F.col("x2") > F.col("x")))
    if shape == "step":
        kind = (F.when((dy <= 3) & (dx <= max_gap) & (dx > 1), F.struct(dx.cast("double").alias("dist"), F.lit("h").alias("kind")))
                .when((dx <= 3) & (dy <= max_gap) & (dy > 1), F.struct(dy.cast("double").alias("dist"), F.lit("v").alias("kind")))
                .when((dx <= max_gap) & (dy <= max_gap) & (dx + dy <= max_gap * 1.5), F.struct((dx + dy).cast("double").alias("dist"), F.lit("l").alias("kind"))))
    else:
        far = F.sqrt((dx * dx + dy * dy).cast("double"))
        kind = F.when((far <= max_gap) & (far > 1), F.struct(far.alias("dist"), F.lit("s").alias("kind")))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("_tx") == F.col("_ux"), F.col("_ty") == F.col("_uy"), later]
    pairs = left.join(right, on).withColumn("_k", kind).where(F.col("_k").isNotNull())
    spot = lambda x, y: F.col(y).cast("bigint") * (1 << 31) + F.col(x)
    options = pairs.groupBy(*keys, "y", "x").agg(F.array_sort(F.collect_list(F.struct(
        F.col("_k.dist").alias("dist"), F.col("y2").alias("y2"), F.col("x2").alias("x2"), F.col("_k.kind").alias("kind"),
        F.col("x").alias("x1"), F.col("y").alias("y1"), spot("x2", "y2").alias("to")))).alias("options"))

    def step(taken, row, put):
        """`taken`: endpoints that earlier ones were joined to."""
        best = F.get(F.filter(row["options"], lambda o: ~F.array_contains(taken, o["to"])), F.lit(0))
        made = F.when(~F.array_contains(taken, row["_at"]), best)
        ahead = F.filter(taken, lambda p: p > row["_at"])
        return once(made, lambda made: put(F.concat(ahead, F.filter(F.array(made["to"]), lambda p: p.isNotNull())), made))

    # where no earlier endpoint reaches as far as this one, nothing can be taken yet
    reach = F.aggregate("options", F.lit(0).cast("bigint"), lambda a, o: F.greatest(a, o["to"]))
    o = Ordered(options.withColumns({"_at": spot("x", "y"), "_to": reach}), keys, "_at").running(before=True, _reach=("max", "_to"))
    one = "struct<dist: double, y2: int, x2: int, kind: string, x1: int, y1: int, to: bigint>"
    links = fold_islands(o, F.col("_reach").isNull() | (F.col("_reach") < F.col("_at")), step, "array<bigint>", one, start=F.array().cast("array<bigint>"))
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    top, low = F.least("y1", "y2"), F.greatest("y1", "y2")
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("int")
    cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    across = lambda y: F.transform(F.sequence(lo, hi), lambda x: cell(x, y))
    down = lambda x: F.transform(F.sequence(top, low), lambda y: cell(x, y))
    n = F.floor("dist").cast("int") + 1
    straight = F.transform(F.sequence(F.lit(0), n), lambda i: cell(
        F.floor(F.col("x1") + (F.col("x2") - F.col("x1")) * i / n), F.floor(F.col("y1") + (F.col("y2") - F.col("y1")) * i / n)))
    fill = (F.when(F.col("kind") == "h", across(mid("y1", "y2"))).when(F.col("kind") == "v", down(mid("x1", "x2")))
            .when(F.col("kind") == "l", F.concat(across(F.col("y1")), down(F.col("x2")))).otherwise(straight))
    cells = links.select(*keys, F.explode(fill).alias("_c")).select(*keys, "_c.x", "_c.y")
    return mask.select(*keys, "x", "y").unionByName(cells).distinct()


def skeleton_by_color(pixels, min_cells=50, min_area=30, images=None, color="color") -> DataFrame:
    """Skeletons per image and colour: small colours and small components left out, the rest widened and thinned."""
    from .runs import connected_components, component_stats
    keys = ["image_id", color]
    enough = pixels.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > min_cells).select(*keys, F.lit(True).alias("_ok"))
    rows = attach(pixels.select(*keys, "x", "y"), enough, keys).where("_ok").drop("_ok")
    labelled = connected_components(rows, keys=keys)
    big = component_stats(labelled, keys=keys).where(F.col("area") >= min_area).select(*keys, "comp_id", F.lit(True).alias("_ok"))
    kept = attach(labelled, big, keys + ["comp_id"]).where("_ok").select(*keys, "x", "y")
    return skeleton(dilate(kept, images=images, keys=keys), images=images, keys=keys)


def line_crossings(mask, lines, axis="horizontal") -> DataFrame:
    """Line cells with curve cells close by on one side (horizontal, 4..10) or on both sides (vertical, 5..12), widened.

    Line and curve cells of a column (or row) are laid out together and counted over ranges of the position.
    """
    image, line, pos = "image_id", *(("x", "y") if axis == "horizontal" else ("y", "x"))
    near, far = (4, 10) if axis == "horizontal" else (5, 12)
    on_line = lines.select(image, "x", "y").distinct().withColumn("_l", F.lit(1))
    cells = attach(mask.select(image, "x", "y").distinct(), on_line, [image, "x", "y"]).where(F.col("_l").isNull())
    both = cells.withColumn("_l", F.lit(0)).unionByName(on_line)
    w = Window.partitionBy(image, line).orderBy(pos)
    count = lambda a, b: F.coalesce(F.sum(1 - F.col("_l")).over(w.rangeBetween(a, b)), F.lit(0)) > 0
    before, after = count(-far, -near), count(near, far)
    hit = both.withColumn("_h", (before | after) if axis == "horizontal" else (before & after)).where((F.col("_l") == 1) & F.col("_h"))
    return dilate(hit, rect(3, 5) if axis == "horizontal" else rect(3, 3))
