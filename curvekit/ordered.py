"""Ordered (window) columns that stay parallel when one key holds a large share of the rows.

A plain `Window.partitionBy(key).orderBy(t)` sends a whole key to one task. Here a probe counts rows per key;
keys above `curvekit.slabRows` are cut into slabs by quantiles of `t`, windows run per (key, slab), and one
carry per slab (its last row, its minimum, its sum, ...) is scanned over the slabs and joined back. The slab
table has at most MAX_SLABS + MAX_HOT rows whatever the data size, so its broadcast is bounded. Without hot keys
the plan is the plain window. Inputs whose files are below `curvekit.probeBytes` are not probed: no key of theirs
can be larger than one task handles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import as_list, attach, cut_lineage, input_bytes, setting

MAX_HOT = 2048
MAX_SLABS = 4096
SIDE = 32
SLAB_ROWS = 2_000_000
PROBE_BYTES = 64 << 20


def probed(df: DataFrame) -> bool:
    return input_bytes(df) >= setting(df.sparkSession, "probeBytes", PROBE_BYTES)


def any_hot(df: DataFrame, keys: list[str]) -> bool:
    many = F.col("_n") > setting(df.sparkSession, "slabRows", SLAB_ROWS)
    return probed(df) and not df.groupBy(*keys).agg(F.count("*").alias("_n")).where(many).isEmpty()


def by_key(df: DataFrame, keys) -> DataFrame:
    """Rows dealt by key, so that aggregates and windows within keys share this one shuffle; as they are where a key is hot."""
    keys = as_list(keys)
    return df if any_hot(df, keys) else df.repartition(*keys)


def hot_slabs(df: DataFrame, keys: list[str], t: str, counted: DataFrame | None = None) -> DataFrame | None:
    """One row per hot key with its inner slab bounds, or None when no key is hot."""
    spark = df.sparkSession
    if not probed(df) or (counted is not None and keys and not any_hot(counted, keys)):
        return None
    if not keys:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    limit = setting(spark, "slabRows", SLAB_ROWS)
    hot = (df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
           .orderBy(F.desc("_n")).limit(MAX_HOT).collect())
    if not hot:
        return None
    total = sum(r["_n"] for r in hot)
    fields = [df.schema[k] for k in keys] + [T.StructField("_cuts", T.IntegerType())]
    wanted = [tuple(r[k] for k in keys)
              + (int(min(SIDE * SIDE, -(-r["_n"] // limit), -(-MAX_SLABS * r["_n"] // total))),) for r in hot]
    hot_df = spark.createDataFrame(wanted, T.StructType(fields))
    grid = [i / (SIDE * SIDE) for i in range(1, SIDE * SIDE)]
    marked = attach(df.select(*keys, F.col(t).cast("double").alias("_t")), hot_df, keys, hint=True)
    cuts = (marked.where(F.col("_cuts") > 1).groupBy(*keys)
            .agg(F.max("_cuts").alias("_cuts"), F.percentile_approx("_t", grid, 8 * SIDE * SIDE).alias("_g"))
            .select(*keys, F.expr(f"transform(sequence(1, _cuts - 1), i -> _g[cast(i * {SIDE * SIDE} / _cuts as int) - 1])")
                    .alias("_bounds")))
    rows = cuts.collect()
    schema = T.StructType([df.schema[k] for k in keys]
                          + [T.StructField("_outer", T.ArrayType(T.DoubleType())),
                             T.StructField("_inner", T.ArrayType(T.ArrayType(T.DoubleType())))])
    made = []
    for r in rows:
        b = sorted(x for x in r["_bounds"] if x is not None)
        blocks = [b[i:i + SIDE] for i in range(0, len(b), SIDE)]
        made.append(tuple(r[k] for k in keys) + ([x[0] for x in blocks], blocks))
    return spark.createDataFrame(made, schema)


def _slab_of(t: str) -> Column:
    """Number of bounds at or below t, found through the first bound of each block of SIDE."""
    c = F.col(t).cast("double")
    block = F.size(F.filter("_outer", lambda b: b <= c))
    inside = F.when(block > 0, F.size(F.filter(F.element_at("_inner", F.greatest(block, F.lit(1))), lambda b: b <= c)))
    return F.when(F.col("_outer").isNull(), F.lit(0)).otherwise(
        F.greatest(block - 1, F.lit(0)) * SIDE + F.coalesce(inside, F.lit(0))).cast("int")


class Ordered:
    """Rows of `df` in order of (t, ties) within `keys`. Methods add columns; `.df` is the result.

    Cold rows (all rows, usually) get plain windows, lazily. Rows of hot keys are kept apart: each step runs per slab,
    joins the slab carries and writes the result to the checkpoint folder, so that a chain of steps costs one pass per
    step instead of doubling its plan.

    `counted` is a table with the same keys and at least as many rows of each (a row more or less does not matter), such as the points that a chain of
    filters began with. Where no key of it is hot, `df` itself is not counted, which would run all steps before it once more, with their shuffles.
    """

    def __init__(self, df: DataFrame, keys, t: str, ties=(), counted: DataFrame | None = None):
        self.keys, self.t, self.ties = as_list(keys), t, as_list(ties)
        hot = hot_slabs(df, self.keys, t, counted)
        self._cold, self._hot = df, None
        if hot is not None:
            if not self.keys:
                self.keys, df = ["_all"], df.withColumn("_all", F.lit(1))
            marked = attach(df, hot, self.keys, hint=True)
            self._cold = marked.where(F.col("_outer").isNull()).drop("_outer", "_inner")
            self._hot = cut_lineage(marked.where(F.col("_outer").isNotNull()).withColumn("_slab", _slab_of(t)).drop("_outer", "_inner"))

    # -- plumbing ---------------------------------------------------------------------------------
    def _with(self, cold: DataFrame, hot: DataFrame | None) -> "Ordered":
        out = object.__new__(Ordered)
        out.keys, out.t, out.ties, out._cold, out._hot = self.keys, self.t, self.ties, cold, hot
        return out

    def _both(self, change, keep=()) -> "Ordered":
        """Apply a row-wise change to the cold and to the hot rows."""
        return self._with(change(self._cold, ()), None if self._hot is None else change(self._hot, keep))

    @property
    def df(self) -> DataFrame:
        rows = self._cold if self._hot is None else self._cold.unionByName(self._hot.drop("_slab"))
        return rows.drop("_all")

    def _w(self, slab: bool):
        return Window.partitionBy(*self.keys, *(["_slab"] if slab else [])).orderBy(self.t, *self.ties)

    def _rank(self) -> Column:
        return F.struct(self.t, *self.ties)

    def _carried(self, hot: DataFrame, carry: DataFrame, on: list[str]) -> DataFrame:
        return attach(hot, carry, on, hint=True)

    def select(self, *cols) -> "Ordered":
        names = [c for c in ("_all",) if c in self.keys]
        return self._both(lambda df, keep: df.select(*cols, *names, *keep), ("_slab",))

    def where(self, cond) -> "Ordered":
        return self._both(lambda df, keep: df.where(cond))

    def with_columns(self, **cols) -> "Ordered":
        return self._both(lambda df, keep: df.withColumns(cols))

    # -- neighbours -------------------------------------------------------------------------------
    def lag(self, **cols) -> "Ordered":
        """Value of each expression in the previous row."""
        return self._neighbour(cols, forward=False)

    def lead(self, **cols) -> "Ordered":
        """Value of each expression in the next row."""
        return self._neighbour(cols, forward=True)

    def _neighbour(self, cols: dict, forward: bool) -> "Ordered":
        cols = {n: F.col(c) if isinstance(c, str) else c for n, c in cols.items()}
        move = F.lead if forward else F.lag
        cold = self._cold.withColumns({n: move(c, 1).over(self._w(False)) for n, c in cols.items()})
        if self._hot is None:
            return self._with(cold, None)
        row = F.struct(*[c.alias(n) for n, c in cols.items()])
        edge = self._hot.groupBy(*self.keys, "_slab").agg((F.min_by if forward else F.max_by)(row, self._rank()).alias("_edge"))
        edge = edge.select(*self.keys, "_slab", move("_edge", 1).over(Window.partitionBy(*self.keys).orderBy("_slab")).alias("_edge"))
        hot = self._carried(self._hot.withColumn("_near", move(row, 1).over(self._w(True))), edge, self.keys + ["_slab"])
        hot = hot.withColumn("_near", F.coalesce("_near", "_edge")).drop("_edge")
        return self._with(cold, cut_lineage(hot.withColumns({n: F.col(f"_near.{n}") for n in cols}).drop("_near")))

    # -- running aggregates -----------------------------------------------------------------------
    def running(self, *, before: bool = False, reverse: bool = False, **aggs) -> "Ordered":
        """Running aggregates; each value is (kind, column), kind in min max sum count last first.

        `before` leaves out the current row; `reverse` runs from the end; `last`/`first` skip nulls.
        """
        aggs = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in aggs.items()}

        def local(slab):
            w = self._w(slab)
            w = (w.rowsBetween(1 if before else 0, Window.unboundedFollowing) if reverse
                 else w.rowsBetween(Window.unboundedPreceding, -1 if before else 0))
            return {n: _AGG[k](c).over(w) for n, (k, c) in aggs.items()}

        cold = self._cold.withColumns(local(False))
        if self._hot is None:
            return self._with(cold, None)
        edge = {}
        for n, (k, c) in aggs.items():
            if k in ("last", "first"):
                edge[n] = (F.max_by if k == "last" else F.min_by)(c, F.when(c.isNotNull(), self._rank()))
            else:
                edge[n] = _AGG[k](c)
        ws = Window.partitionBy(*self.keys).orderBy("_slab")
        ws = ws.rowsBetween(1, Window.unboundedFollowing) if reverse else ws.rowsBetween(Window.unboundedPreceding, -1)
        slabs = self._hot.groupBy(*self.keys, "_slab").agg(*[c.alias(n) for n, c in edge.items()])
        carry = slabs.select(*self.keys, "_slab", *[_AGG["sum" if k == "count" else k](F.col(n)).over(ws).alias(f"_c_{n}")
                                                    for n, (k, _) in aggs.items()])
        hot = self._carried(self._hot.withColumns(local(True)), carry, self.keys + ["_slab"])
        merged = {n: _merge(k, F.col(n), F.col(f"_c_{n}"), reverse) for n, (k, _) in aggs.items()}
        return self._with(cold, cut_lineage(hot.withColumns(merged).drop(*[f"_c_{n}" for n in aggs])))

    def row_number(self, name: str) -> "Ordered":
        return self.running(**{name: ("count", F.lit(1))})

    def total(self, **aggs) -> "Ordered":
        """Whole-key aggregates on every row; each value is an aggregate Column (order-free)."""
        w = Window.partitionBy(*self.keys)
        cold = self._cold.withColumns({n: c.over(w) for n, c in aggs.items()})
        if self._hot is None:
            return self._with(cold, None)
        whole = self._hot.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggs.items()])
        return self._with(cold, cut_lineage(self._carried(self._hot, whole, self.keys)))

    def islands(self, name: str, starts: Column) -> "Ordered":
        """Island number: count of rows up to here for which `starts` holds (null counts as no start)."""
        return self.running(**{name: ("sum", F.coalesce(starts.cast("int"), F.lit(0)))})


_AGG = {
    "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
    "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True),
}


def _merge(kind: str, local: Column, carry: Column, reverse: bool) -> Column:
    if kind == "min":
        return F.least(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind in ("sum", "count"):
        return F.when(local.isNull() & carry.isNull(), None).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    near_first = (kind == "last") != reverse
    return F.coalesce(local, carry) if near_first else F.coalesce(carry, local)


def exact_median(df: DataFrame, keys, value: str, name: str, upper: bool = False) -> DataFrame:
    """One row per key with the exact median of `value` (`upper` takes the higher middle one) and `n`.

    Values are counted first, so copies travel once, and the cumulative count uses the slabs above; a group is
    never held in memory.
    """
    keys = as_list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    o = Ordered(counts, keys, value).running(_cum=("sum", "_c")).total(_n=F.sum("_c"))
    lo, hi = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    holds = lambda p: (p < F.col("_cum")) & (p >= F.col("_cum") - F.col("_c"))
    if upper:
        return o.df.where(holds(hi)).select(*keys, F.col(value).alias(name), F.col("_n").alias("n"))
    return (o.df.where(holds(lo) | holds(hi)).groupBy(*keys)
            .agg(((F.min(value) + F.max(value)) / 2).alias(name), F.max("_n").alias("n")))


def top_rows(df: DataFrame, keys, k: int, *order) -> DataFrame:
    """The first k rows per key in `order`, found by partial top-k lists (no sort of a whole key in one task).

    Each list holds at most k rows: rows are first ranked within (key, salt), so a hot key is spread over
    salts, and the survivors (at most salts * k per key) are ranked again.
    """
    keys = as_list(keys)
    salts = 64
    cols = [c for c in df.columns]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    part = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k)
    return (part.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= k)
            .withColumn("rn", F.col("_rn")).drop("_rn", "_salt"))
