"""Recurrences along an order without a row loop in Python.

A row that is treated alike whatever came before it is a restart point. Restart points are found and numbered by windows; the rows from one to the next
are an island, and islands do not know of each other. An island is one array, folded inside the JVM; most islands have a few rows. Where each row can end
in one of two ways only, not even that is needed: see `two_way`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import SLAB_ROWS, Ordered
from .runtime import attach, cut_lineage, setting

CHUNK = 64  # rows whose results are appended one by one
HOT_CHUNK = 1 << 18  # rows of a hot key that are folded together


def two_way(o: Ordered, after_0: Column, after_1: Column, name: str = "_way") -> Ordered:
    """Which of two ways (0 or 1) each row takes, if a row takes `after_0` when the one before took 0 and `after_1` when it took 1.

    Rows whose two columns agree (the first of a key must) are restart points; all others keep the way or change it, so the way of a row is that of the
    last restart point, changed as often as rows in between change it: a running count and a last value, which also work for hot keys.
    """
    o = o.with_columns(_w0=after_0.cast("int"), _w1=after_1.cast("int"))
    o = o.running(_turns=("sum", ((F.col("_w0") == 1) & (F.col("_w1") == 0)).cast("int")))
    o = o.running(_since=("last", F.when(F.col("_w0") == F.col("_w1"), F.col("_w0") - F.col("_turns"))))
    return o.with_columns(**{name: F.pmod(F.col("_since") + F.col("_turns"), F.lit(2)).cast("int")})


def once(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_islands(o: Ordered, restart: Column, step, state: str, out: str, start: Column | None = None, finish=None) -> DataFrame:
    """Fold the rows of `o` per key in its order: `step(state, row, put)` gives `put(next state, row to put out)`, both columns (null: nothing).

    `state` and `out` are types; a state is null at first unless `start` is given. Rows for which `restart` holds must come out alike whatever the state
    was; `finish(state)` puts out the state that a restart point or the end of the key leaves behind. The result has the key columns and those of `out`.

    Rows of hot keys are cut into runs of equal length that are folded in parallel from an empty state, and again from the state in which the run before
    really ends, until nothing changes; a run with a restart point in it ends alike from the start. States stay in a table of one row a run.
    """
    keys = o.keys
    cols = [o.t, *o.ties, *[c for c in o._cold.columns if c not in (*keys, o.t, *o.ties)], "_r"]
    o = o.with_columns(_r=F.coalesce(restart, F.lit(False)))
    begin = (F.lit(None) if start is None else start).cast(state)
    none = F.array().cast(f"array<{out}>")

    def folded(rows: Column, entry: Column, within: bool) -> Column:
        """The state after all rows, and what they put out; `within`: restart points may stand after the first row. Results are appended by chunks of rows, so
        that a long island does not copy them row by row."""

        def one(acc, row):
            def put(new, made):
                outs = [acc["o"], F.filter(F.array(made.cast(out)), lambda m: m.isNotNull())]
                if finish is not None and within:
                    outs.insert(1, F.filter(F.array(F.when(row["_r"], finish(acc["s"])).cast(out)), lambda m: m.isNotNull()))
                return F.struct(new.cast(state).alias("s"), F.concat(*outs).alias("o"))

            return step(F.when(row["_r"], begin).otherwise(acc["s"]) if within else acc["s"], row, put)

        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda i: F.slice(rows, i * CHUNK + 1, F.lit(CHUNK)))
        first = F.struct(F.struct(entry.cast(state).alias("s"), none.alias("o")).alias("r"), F.array().cast(f"array<array<{out}>>").alias("p"))
        return F.aggregate(chunks, first, lambda acc, chunk: F.struct(F.aggregate(chunk, F.struct(acc["r"]["s"].alias("s"), none.alias("o")), one).alias("r"),
                                                                      F.concat(acc["p"], F.array(acc["r"]["o"])).alias("p")),
                           lambda acc: F.struct(acc["r"]["s"].alias("s"), F.flatten(F.concat(acc["p"], F.array(acc["r"]["o"]))).alias("o")))

    def put_out(done: DataFrame, last: Column) -> DataFrame:
        if finish is None:
            rows = F.col("_f.o")
        else:
            rows = F.concat("_f.o", F.filter(F.array(F.when(last, finish(F.col("_f.s"))).cast(out)), lambda m: m.isNotNull()))
        # not `explode`: Spark would put its test for empty arrays, and with it the whole fold, into a filter of its own
        return done.select(*keys, F.explode_outer(rows).alias("_o")).where(F.col("_o").isNotNull()).select(*[k for k in keys if k != "_all"], "_o.*")

    gathered = F.array_sort(F.collect_list(F.struct(*cols))).alias("_rows")
    cold = o.running(_island=("sum", F.col("_r").cast("int")))._cold
    islands = cold.groupBy(*keys, "_island").agg(gathered)  # keys of more rows than `curvekit.slabRows` are below
    found = put_out(islands.select(*keys, folded(F.col("_rows"), begin, False).alias("_f")), F.lit(True))
    if o._hot is None:
        return found

    size = min(setting(o._hot.sparkSession, "slabRows", SLAB_ROWS), HOT_CHUNK)
    numbered = o.row_number("_no")._hot
    runs = cut_lineage(numbered.groupBy(*keys, F.floor((F.col("_no") - 1) / size).alias("_run")).agg(gathered))
    order = Window.partitionBy(*keys).orderBy("_run")

    def ends(part: DataFrame) -> DataFrame:
        return cut_lineage(part.select(*keys, "_run", "_entry", folded(F.col("_rows"), F.col("_entry"), True)["s"].alias("_exit")))

    states = ends(runs.withColumn("_entry", begin))
    while True:
        real = states.withColumn("_real", F.when(F.row_number().over(order) == 1, begin).otherwise(F.lag("_exit", 1).over(order)))
        wrong = cut_lineage(real.filter(~F.col("_real").eqNullSafe(F.col("_entry"))).select(*keys, "_run", F.col("_real").alias("_entry")))
        if wrong.isEmpty():
            break
        again = ends(attach(runs, wrong.withColumn("_hit", F.lit(True)), [*keys, "_run"]).filter("_hit"))
        both = states.withColumn("_new", F.lit(0)).unionByName(again.withColumn("_new", F.lit(1)))
        states = cut_lineage(both.groupBy(*keys, "_run").agg(F.max_by(F.struct("_entry", "_exit"), "_new").alias("_m")).select(*keys, "_run", "_m._entry", "_m._exit"))
    last = states.withColumn("_last", F.lead("_run", 1).over(order).isNull()).select(*keys, "_run", "_entry", "_last")
    done = attach(runs, last, [*keys, "_run"]).select(*keys, "_last", folded(F.col("_rows"), F.col("_entry"), True).alias("_f"))
    return found.unionByName(put_out(done, F.col("_last")))


def keep_since(o: Ordered, restart: Column, keep, columns: list[str]) -> DataFrame:
    """Rows that stay, where that depends on the last row that stayed: `keep(last, row)`. The first row of a key and restart points always stay."""
    kinds = dict(o._cold.dtypes)
    kind = "struct<" + ", ".join(f"{c}: {kinds[c]}" for c in columns) + ">"

    def step(last, row, put):
        own = F.struct(*[row[c].alias(c) for c in columns])
        made = F.when(last.isNull() | row["_r"] | F.coalesce(keep(last, row), F.lit(False)), own)
        return once(made, lambda made: put(F.coalesce(made, last), made))

    return fold_islands(o, restart, step, kind, kind)
