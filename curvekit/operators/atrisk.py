"""Number-at-risk tables: token rows to cells, events, repair of curves and reconciliation of sources.

Cells are rows (image_id, grp, t, n); a source's confidence is one value per image.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordered import Ordered
from ..runtime import as_list, attach
from .joins import first_similar, nearest
from .runs import group_tokens_by_row

c = F.col
# Header texts of at-risk tables, axis-label rows, separators that are no names.
HEADERS = r"at\s*risk"
AXIS_ROW = r"time\s*\(?months?\)?|months?|years?"
NUMERIC = r"^\d+\.?\d*$"
SEPARATORS = ["|", "-", ":", "_", ".", ","]
HEADER_NAMES = ["0", "0 1", "01"]


# -- tokens to cells -------------------------------------------------------------------------------

def token_rows(tokens, tol=15, seq=None, image="image_id") -> DataFrame:
    """One row per text line with its tokens in reading order: `words` (texts from left to right).

    The list of a row is one line of one page.
    """
    placed = group_tokens_by_row(tokens, image, tol, seq=seq)
    rows = placed.groupBy(image, "row_y").agg(F.array_sort(F.collect_list(F.struct(
        c("center_x").alias("x"), F.trim("text").alias("w")))).alias("_w"))
    return rows.select(image, "row_y", F.transform("_w", lambda q: q["w"]).alias("words"))


def classify_rows(rows, image="image_id") -> DataFrame:
    """Kind of each text line: header, axis, data, time, unlabeled (data without a name) or other.

    The first line of small numbers is the time line unless the page's last line is one too; without any, a mostly
    numeric last line is taken. Pages of a single line have no table.
    """
    text = F.lower(F.array_join("words", " "))
    num = F.filter("words", lambda w: F.rlike(w, F.lit(NUMERIC)))
    r = rows.withColumns({"_header": F.rlike(text, F.lit(HEADERS)), "_axis": F.rlike(text, F.lit(AXIS_ROW)), "_nums": F.size(num),
                          "_words": F.size(F.filter("words", lambda w: (w != "") & ~F.rlike(w, F.lit(NUMERIC)))), "_all": F.size("words"),
                          "_small": F.forall(num, lambda w: w.cast("double") < 100)})
    data = (c("_words") >= 1) & (c("_nums") >= 3)
    mostly = (c("_nums") / F.greatest(c("_all"), F.lit(1)) > 0.8) & (c("_nums") >= 3)
    base = F.when(c("_header"), "header").when(c("_axis"), "axis").when(data, "data").when(mostly, F.when(c("_small"), "time").otherwise("unlabeled")).otherwise("other")
    o = Ordered(r.withColumn("_k", base), image, "row_y").total(_lines=F.count("*"), _last=F.max("row_y"))
    o = o.total(_first=F.min(F.when(c("_k") == "time", c("row_y"))), _last_time=F.max(F.when((c("_k") == "time") & (c("row_y") == c("_last")), c("row_y"))),
                _tail=F.max(F.when((c("row_y") == c("_last")) & (c("_nums") >= 3) & (F.try_divide("_nums", "_all") > 0.7), c("row_y"))))
    chosen = F.coalesce("_last_time", "_first", "_tail")
    kind = (F.when(c("row_y") == chosen, "time").when((c("_k") == "time") & (c("row_y") == c("_first")), "other")
            .when(c("_k") == "time", "unlabeled").otherwise(c("_k")))
    return o.df.where("_lines >= 2").select(image, "row_y", "words", kind.alias("kind"))


def clean_group_name(name: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(name, r"^[|:\-_\s]+", ""), r"[|:\-_\s]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^[.,;:|\-_ ]+", ""), r"[.,;:|\-_ ]+$", "")
    return F.when(t == "", "Unknown").otherwise(t)


def parse_data_rows(rows, image="image_id") -> DataFrame:
    """Group name and whole-number values of each line: words before the first number are the name."""
    number = lambda w: F.rlike(w, F.lit(r"^\d+$|^\d+\.\d+$"))
    first = F.array_position(F.transform("words", number), F.lit(True))
    head = F.when(first > 0, F.slice("words", F.lit(1), (first - 1).cast("int"))).otherwise(c("words"))
    name = F.array_join(F.filter(head, lambda w: (w != "") & ~w.isin(*SEPARATORS)), " ")
    name = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"^[|:\-_\s]+", ""), r"[|:\-_\s]+$", "")
    values = F.transform(F.filter("words", number), lambda w: w.try_cast("double").try_cast("bigint"))
    values = F.array_compact(values)  # a number that no count can have is noise
    return rows.select(image, "row_y", F.when(name != "", name).when(F.size(values) > 0, F.concat(F.lit("Group_"), F.size(values).cast("string"))).alias("grp"), values.alias("values"))


def time_points(rows, calibration=None, image="image_id") -> DataFrame:
    """Times of each page: the numbers of its time line, else even steps over the calibrated range, else 0, 3, .. 18."""
    nums = F.array_sort(F.transform(F.filter("words", lambda w: F.rlike(w, F.lit(NUMERIC))), lambda w: w.try_cast("double")))
    whole = F.size(F.filter("words", lambda w: F.rlike(w, F.lit(r"^\d+$"))))
    # a page has one time line
    pages = rows.groupBy(image).agg(F.max(F.when(c("kind") == "time", nums)).alias("_t"), F.min(F.when(
        c("kind").isin("data", "unlabeled"), F.struct("row_y", whole.alias("k")))).getField("k").alias("_k"))
    k = F.greatest(c("_k"), F.lit(7))
    guess = F.when(c("_k").isNotNull(), F.array(*[F.lit(float(v)) for v in range(0, 21, 3)][:7]))
    if calibration is not None:
        pages = attach(pages, calibration.select(image, "time_min", "time_max"), [image], grows=True)
        even = F.transform(F.sequence(F.lit(0), k - 1), lambda i: c("time_min") + i * (c("time_max") - c("time_min")) / (k - 1))
        guess = F.when(c("_k").isNotNull(), F.when(c("time_min").isNotNull(), even).otherwise(guess))
    times = F.when(F.size("_t") > 0, c("_t")).otherwise(guess)
    return pages.select(image, times.alias("times")).where(F.size("times") > 0)


def assemble_cells(rows, times, image="image_id", least=3) -> DataFrame:
    """Cells of the data lines against the page's times, with the page's confidence cells / (groups * times).

    Lines with fewer than `least` values are no groups; of lines with the same name the last one counts.
    """
    data = parse_data_rows(rows.where(c("kind").isin("data", "unlabeled")), image)
    data = data.where(c("grp").isNotNull() & (F.size("values") >= least)).withColumn("grp", clean_group_name(c("grp")))
    last = data.groupBy(image, "grp").agg(F.max(F.struct("row_y", "values")).alias("_r")).select(image, "grp", "_r.row_y", "_r.values")
    last = attach(last, times.select(image, "times"), [image], grows=True).where(c("times").isNotNull())
    filled = F.size(F.array_distinct(F.slice("times", F.lit(1), F.least(F.size("values"), F.size("times")))))
    groups = Ordered(last, image, "row_y").total(_c=F.sum(filled), _g=F.count("*")).df
    groups = groups.withColumn("confidence", c("_c") / F.greatest(c("_g") * F.size("times"), F.lit(1)))
    cells = groups.select(image, "grp", "times", "confidence", F.posexplode("values").alias("pos", "n")).where(c("pos") < F.size("times"))
    return cells.groupBy(image, "grp", F.get("times", c("pos")).alias("t")).agg(F.max("n").alias("n"), F.max("confidence").alias("confidence"))


def numeric_grid(tokens, bucket=20, image="image_id") -> DataFrame:
    """Pages with at least two lines (20-pixel bands) of three or more whole numbers."""
    rows = tokens.groupBy(image, F.floor(c("center_y") / bucket).alias("_b")).agg(F.count_if(F.rlike(F.trim("text"), F.lit(r"^\d+$"))).alias("_k"))
    return rows.groupBy(image).agg(((F.count("*") >= 2) & (F.count_if(c("_k") >= 3) >= 2)).alias("has_grid"))


def merge_token_passes(first, second, least=5, image="image_id") -> DataFrame:
    """Where the first pass found fewer than `least` tokens, tokens of the second pass with new texts are added."""
    few = second.select(image).distinct()
    n = first.groupBy(image).agg(F.count("*").alias("_n"))
    few = attach(few, n, [image], grows=True).where(F.coalesce(c("_n"), F.lit(0)) < least).select(image, F.lit(True).alias("_few"))
    known = first.select(image, F.lower(F.trim("text")).alias("_w")).distinct().withColumn("_k", F.lit(True))
    extra = attach(second, few, [image], grows=True).where("_few").withColumn("_w", F.lower(F.trim("text")))
    extra = attach(extra, known, [image, "_w"], grows=True).where(c("_k").isNull())
    return first.unionByName(extra.select(*first.columns))


def table_region(pixels, tokens, images, bounds, margin=10, image="image_id") -> DataFrame:
    """Bounding box of dark cells below 75% of the plot, kept when large enough and when its top holds a header text or
    its tokens form a numeric grid. Widening the cells by 14 x 2 pixels, as is done to join letters, only widens the box."""
    dims = attach(images.select(image, "width", "height"), bounds.select(image, "py", "ph"), [image], grows=True)
    dims = dims.withColumn("_top", F.floor(c("py") + c("ph") * 0.75).cast("int")).where(c("height") - c("_top") >= 50)
    # a row of pixels is reduced to its ends before it is sent to its picture, so that a picture brings at most its height
    lines = pixels.where(c("gray") < 200).groupBy(image, "y").agg(F.min("x").alias("_x1"), F.max("x").alias("_x2"))
    rows = attach(lines, dims, [image], grows=True).where(c("y") >= c("_top"))
    b = rows.groupBy(image, "width", "height", "_top").agg(F.min("_x1").alias("a"), F.max("_x2").alias("b"), (F.min("y") - c("_top")).alias("c"), (F.max("y") - c("_top")).alias("d"))
    z = F.lit(0)
    region = c("height") - c("_top")
    x1, x2 = F.greatest(z, c("a") - 14), F.least(c("width") - 1, c("b") + 14)
    y1, y2 = F.greatest(z, c("c") - 2), F.least(region - 1, c("d") + 2)
    b = b.withColumns({"_x": x1, "_y": y1, "_w": x2 - x1 + 1, "_h": y2 - y1 + 1}).where((c("_w") >= 100) & (c("_h") >= 50))
    nx, ny = F.greatest(z, c("_x") - margin), F.greatest(z, c("_y") - margin)
    b = b.select(image, nx.alias("x"), (c("_top") + ny).alias("y"), F.least(c("width") - nx, c("_w") + 2 * margin).alias("w"), F.least(region - ny, c("_h") + 2 * margin).alias("h"))
    inside = attach(tokens, b, [image], grows=True).where(c("center_x").between(c("x"), c("x") + c("w")) & c("center_y").between(c("y"), c("y") + c("h")))
    head = inside.where(c("center_y") < c("y") + F.least(F.lit(40), F.floor(c("h") / 3)))
    # the header strip of one page
    head = head.groupBy(image).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("center_y", "center_x", "text"))), lambda q: F.lower(q["text"])), " ").alias("_s"))
    head = head.select(image, F.rlike("_s", F.lit(HEADERS)).alias("_header"))
    out = attach(attach(b, head, [image], grows=True), numeric_grid(inside.select(image, "text", "center_y"), image=image), [image], grows=True)
    return out.withColumns({"header": F.coalesce("_header", F.lit(False)), "grid": F.coalesce("has_grid", F.lit(False))}).where(
        "header or grid").select(image, "x", "y", "w", "h", "header", "grid")


# -- cells -----------------------------------------------------------------------------------------

def events(cells, key=("image_id", "grp"), t="t", n="n") -> DataFrame:
    """Drop to the next count of the group, never negative; 0 in its last row."""
    keys = as_list(key)
    o = Ordered(cells, keys, t).lead(_n=n)
    return o.df.withColumn("events", F.coalesce(F.greatest(F.lit(0), c(n) - c("_n")), F.lit(0))).drop("_n")


def fix_header_group(cells, image="image_id") -> DataFrame:
    """A group named like "0" with at least three small values is the time line: it leaves, and the values of the other
    groups take its times in order when it is long enough."""
    rows = cells.select(image, "grp", "t", "n")
    o = Ordered(rows, [image, "grp"], "t").row_number("_i").total(_k=F.count("*"))
    base = o.df
    named = F.trim("grp").isin(*HEADER_NAMES)
    st = base.where(named).groupBy(image, "grp").agg(F.count("*").alias("_k"), F.max("n").alias("_m"), F.min(F.when(c("_i") == 1, c("n"))).alias("_f"))
    st = st.where((c("_k") >= 3) & (c("_f") < 10) & (c("_m") < 100)).groupBy(image).agg(F.min(F.struct("grp", "_f", "_k")).alias("_h"))
    st = st.select(image, c("_h.grp").alias("_hg"), (c("_h._f") > 0).cast("int").alias("_shift"), c("_h._k").alias("_hk"))
    base = attach(base, st, [image])
    head = base.where(c("grp") == c("_hg"))
    times = head.select(image, (c("_i") + c("_shift")).alias("_i"), c("n").cast("double").alias("_t"))
    zero = st.where("_shift = 1").select(image, F.lit(1).cast("bigint").alias("_i"), F.lit(0.0).alias("_t"))
    rest = attach(base.where(c("_hg").isNull() | (c("grp") != c("_hg"))), times.unionByName(zero), [image, "_i"])
    fits = c("_hk") + c("_shift") >= c("_k")
    return rest.select(image, "grp", F.when(fits, c("_t")).otherwise(c("t")).alias("t"), "n")


def survival_anchors(cells, factor=0.95, key=("image_id", "grp"), t="t", n="n") -> DataFrame:
    """Upper guess of the survival at each table time: n / first n * factor."""
    keys = as_list(key)
    first = cells.groupBy(*keys).agg(F.min(F.struct(t, n)).getField(n).alias("_n0"))
    rows = attach(cells, first, keys)
    share = F.when(c("_n0") > 0, c(n) / c("_n0")).otherwise(1.0)
    return rows.select(*keys, t, (share * factor).alias("s"))


def _extend(anchors, plan, keys, dt, t_max) -> DataFrame:
    """Grid times after `from_t` (or from 0 when null) on the line through the anchors, continued beyond both ends.

    Each pair of neighbouring anchors makes its own grid points.
    """
    seg = Ordered(anchors, keys, "t").lead(_t2="t", _s2="s").row_number("_i").total(_k=F.count("*")).df
    seg = attach(seg.where(c("_t2").isNotNull() & (c("_t2") > c("t"))), plan, keys).where(c("_go"))
    base, k0 = F.coalesce("from_t", F.lit(0.0)), F.when(c("from_t").isNull(), 0).otherwise(1)
    lo = F.when(c("_i") == 1, k0).otherwise(F.greatest(k0, F.ceil((c("t") - base) / dt)))
    top = F.floor((F.lit(float(t_max)) - base) / dt)
    hi = F.when(c("_i") == c("_k") - 1, top).otherwise(F.least(top, F.ceil((c("_t2") - base) / dt) - 1))
    grid = seg.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").select(*keys, c("t").alias("_t1"), c("s").alias("_s1"), "_t2", "_s2", base.alias("_b"), F.explode(F.sequence("_lo", "_hi")).alias("_g"))
    at = c("_b") + c("_g") * F.lit(float(dt))
    value = c("_s1") + (c("_s2") - c("_s1")) * F.try_divide(c("_at") - c("_t1"), c("_t2") - c("_t1"))
    return grid.withColumn("_at", at).select(*keys, c("_at").alias("t"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("s"))


def repair_with_anchors(points, anchors, t_max, key="curve_id", lowest=None, near=3.0) -> DataFrame:
    """Curves that end before 80% of the range (or fall under half of `lowest`, a per-curve expected minimum) lose the points
    below 30% of their nearest anchor and continue on the line through the anchors, in steps of t_max / 1000.

    Curves that need no repair, lose no point, or have fewer than two anchors from two units before the first lost point
    on, stay as they are.
    """
    keys = as_list(key)
    st = points.groupBy(*keys).agg(F.max("t").alias("_end"), F.min("s").alias("_low"))
    need = c("_end") < t_max * 0.8
    if lowest is not None:
        st = attach(st, lowest.select(*keys, c("lowest").alias("_e")), keys)
        need = need | F.coalesce((c("_low") < 0.05) & (c("_low") < c("_e") * 0.5), F.lit(False))
    st = st.select(*keys, need.alias("_need"))
    refs = anchors.select(*keys, "t", "s").distinct()
    close = nearest(refs, points, key, "t", "s", within=near).select(*keys, "t", c("s").alias("_ref"))
    rows = attach(attach(points.select(*keys, "t", "s"), close, keys + ["t"]), st, keys)
    bad = c("_need") & F.coalesce(c("s") < c("_ref") * 0.3, F.lit(False))
    rows = rows.withColumn("_bad", bad)
    plan = rows.groupBy(*keys).agg(F.min(F.when(c("_bad"), c("t"))).alias("_from"), F.max(F.when(~c("_bad"), c("t"))).alias("from_t"))
    plan = plan.where(c("_from").isNotNull())
    used = attach(refs, plan, keys).where(c("from_t").isNull() & c("_from").isNotNull() | (c("t") >= c("_from") - 2))
    enough = used.groupBy(*keys).agg((F.count("*") >= 2).alias("_go"))
    plan = attach(plan, enough, keys).where(c("_go")).select(*keys, "from_t", "_go")
    rows = attach(rows, plan.select(*keys, "_go"), keys)
    kept = rows.where(c("_go").isNull() | ~c("_bad")).select(*keys, "t", "s")
    return kept.unionByName(_extend(used.select(*keys, "t", "s"), plan, keys, t_max / 1000, t_max))


def merge_waypoints(points, waypoints, t_max, key="curve_id") -> DataFrame:
    """Continue each curve after its last point through the later waypoints, in steps of t_max / 1000."""
    keys = as_list(key)
    last = points.groupBy(*keys).agg(F.max(F.struct("t", "s")).alias("_l"))
    last = last.select(*keys, c("_l.t").alias("from_t"), c("_l.s").alias("_s"))
    later = attach(waypoints.select(*keys, "t", "s"), last, keys).where(c("t") > c("from_t")).select(*keys, "t", "s")
    first = last.where(c("_s") > 0).select(*keys, c("from_t").alias("t"), c("_s").alias("s"))
    anchors = later.unionByName(first)
    plan = attach(last.select(*keys, "from_t"), anchors.groupBy(*keys).agg((F.count("*") >= 2).alias("_go")), keys).where("_go")
    return points.select(*keys, "t", "s").unionByName(_extend(anchors, plan, keys, t_max / 1000, t_max))


def apply_corrections(cells, corrections=None, removed=None, key=("image_id", "grp")) -> DataFrame:
    """Set or add cells (columns of `cells`), then drop the removed groups."""
    keys = as_list(key)
    out = cells.select(*keys, "t", "n")
    if corrections is not None:
        both = out.withColumn("_p", F.lit(0)).unionByName(corrections.select(*keys, "t", "n").withColumn("_p", F.lit(1)))
        out = both.groupBy(*keys, "t").agg(F.max(F.struct("_p", "n")).getField("n").alias("n"))
    if removed is not None:
        gone = removed.select(*[c(k).alias(f"__{k}") for k in keys])
        out = out.join(gone, [c(k).eqNullSafe(c(f"__{k}")) for k in keys], "left_anti")
    return out


def retain_times(cells, times: list[float], t="t") -> DataFrame:
    return cells.where(c(t).isin(*[float(v) for v in times]))


def pad_values(rows, times: list[float], key=("image_id", "grp"), values="values") -> DataFrame:
    """Values of each group laid on the time list, with 0 where there are too few; more values than times are left out."""
    keys = as_list(key)
    pairs = F.array(*[F.struct(F.lit(float(v)).alias("t"), F.coalesce(F.get(values, F.lit(i)), F.lit(0)).cast("bigint").alias("n")) for i, v in enumerate(times)])
    return rows.select(*keys, F.explode(pairs).alias("_c")).select(*keys, "_c.t", "_c.n")


def display_matrix(cells, times: list[float], key=("image_id", "grp")) -> DataFrame:
    """One row per group with a column per time."""
    wide = cells.groupBy(*as_list(key)).pivot("t", [float(v) for v in times]).agg(F.first("n", ignorenulls=True))
    return wide.withColumnsRenamed({str(float(v)): f"t_{v:g}" for v in times})


def flatten_groups(tables, key="image_id", groups="groups") -> DataFrame:
    """Nested map {group: {time: n}} to cells."""
    keys = as_list(key)
    g = tables.select(*keys, F.explode(groups).alias("grp", "_m"))
    return g.select(*keys, "grp", F.explode("_m").alias("t", "n"))


def reconcile_tables(first, second, confidence, rules="fill", image="image_id") -> DataFrame:
    """Cells of two sources by similar group names.

    confidence: the second source's (image_id, confidence). "fill": missing cells come in above 0.6, cells that differ by over
    30% are replaced above 0.8, unmatched groups are added above 0.7. "check": replaced over 20% above 0.8, added above 0.7,
    nothing filled. A group of the second source goes to the first similar one, in the order of the first source's column `seq` if it has one.
    """
    fill, part = (0.6, 0.3) if rules == "fill" else (2.0, 0.2)
    seq = "seq" if "seq" in first.columns else None
    names = first.select(image, c("grp").alias("a"), *([c("seq")] if seq else []))
    match = first_similar(names, second.select(image, c("grp").alias("b")), image, "a", "b", seq).select(image, c("b").alias("grp"), c("a").alias("_to"))
    rows = attach(attach(second.select(image, "grp", "t", c("n").alias("_n2")), match, [image, "grp"]), confidence.select(image, c("confidence").alias("_q")), [image])
    added = rows.where(c("_to").isNull() & (c("_q") > 0.7)).select(image, "grp", "t", c("_n2").alias("n"))
    hits = rows.where(c("_to").isNotNull()).groupBy(image, c("_to").alias("grp"), "t").agg(F.max(F.struct("grp", "_n2", "_q")).alias("_r"))
    hits = hits.select(c(image).alias("__i"), c("grp").alias("__g"), c("t").alias("__t"), c("_r._n2").alias("_n2"), c("_r._q").alias("_q"))
    both = first.select(image, "grp", "t", "n").join(hits, [c(image).eqNullSafe(c("__i")), c("grp") == c("__g"), c("t") == c("__t")], "full_outer")
    differs = F.abs(c("_n2") - c("n")) / F.greatest(c("_n2"), F.lit(1)) > part
    n = F.when(c("n").isNull(), F.when(c("_q") > fill, c("_n2"))).when(differs & (c("_q") > 0.8), c("_n2")).otherwise(c("n"))
    merged = both.select(F.coalesce(image, "__i").alias(image), F.coalesce("grp", "__g").alias("grp"), F.coalesce("t", "__t").alias("t"), n.alias("n")).where(c("n").isNotNull())
    return merged.unionByName(added)


def choose_source(first, first_confidence, second, second_confidence, image="image_id") -> tuple[DataFrame, DataFrame]:
    """The first source where its confidence reaches 0.7; else both reconciled, or the second alone at 0.9 of its confidence.

    A second source counts when it is sure to at least 0.5 and has at least two times.
    """
    valid = second.groupBy(image).agg(F.count_distinct("t").alias("_k")).where("_k >= 2")
    q2 = attach(second_confidence.select(image, c("confidence").alias("q2")), valid, [image]).where(c("_k").isNotNull() & (c("q2") >= 0.5)).select(c(image).alias("_i"), "q2")
    plan = first_confidence.select(image, c("confidence").alias("q1")).join(q2, c(image).eqNullSafe(c("_i")), "full_outer").select(F.coalesce(image, "_i").alias(image), "q1", "q2")
    case = (F.when(c("q1") >= 0.7, "first").when(c("q2").isNull(), "first").when(c("q1").isNull(), "second").otherwise("both"))
    plan = plan.withColumn("_case", case)
    of = lambda cells, name: attach(cells.select(image, "grp", "t", "n"), plan.select(image, "_case"), [image]).where(c("_case") == name).drop("_case")
    merged = reconcile_tables(of(first, "both"), of(second, "both"), plan.select(image, c("q2").alias("confidence")), image=image)
    cells = of(first, "first").unionByName(of(second, "second")).unionByName(merged)
    conf = F.when(c("_case") == "first", c("q1")).when(c("_case") == "second", c("q2") * 0.9).otherwise(F.greatest("q1", (c("q1") + c("q2")) / 2))
    return cells, plan.select(image, c("_case").alias("source"), conf.alias("confidence"))
