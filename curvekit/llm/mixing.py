"""Mixing sources to target weights by weighted fair queueing, on DataFrame functions alone."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import attach, cut_lineage
from .common import shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"


def running_total(df: DataFrame, value: str, keys: list[Column], group: list[str] = ()) -> DataFrame:
    """`df` with `total`: the sum of `value` up to and including each row in the order of `keys`, within each `group` (which `keys` must begin with).

    The rows are range-sorted over all partitions and written; each partition gets its sum, the sums are added up (one row a partition and group), and
    the running sum within a partition starts from there. So one group may span any number of tasks.
    """
    named = df.select("*", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    order = [F.col(f"k{i}").asc_nulls_last() for i in range(len(keys))]
    laid = cut_lineage(named.repartitionByRange(shuffle_partitions(df), *order).withColumn("part", F.spark_partition_id()))
    sums = laid.groupBy("part", *group).agg(F.sum(value).alias("own"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", *group, F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = attach(laid.withColumn("here", F.sum(value).over(within)), starts, ["part", *group])
    return done.withColumn("total", F.col("start") + F.col("here")).drop("part", "start", "here", *[f"k{i}" for i in range(len(keys))])


def source_targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """One row a source (null is one of them): `source_size`, `rank`, `weight`, `target`; and the size of all.

    Weights go round by the code-point order of the sources, null last. Targets share the whole size by weight; one that exceeds `most` times its source
    stops there and the rest is shared again. With sources sorted by `most * size / weight`, those that stop are a prefix, so the level of the others
    follows from running sums.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = running_total(sources, "one", [F.col("source").isNull(), F.col("source")]).withColumnRenamed("total", "rank")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("stop", F.lit(most) * F.col("source_size")).drop("one")
    ratio = F.col("stop") / F.col("weight")
    stops = running_total(ranked, "stop", [ratio, F.col("rank")]).withColumnRenamed("total", "stops")
    both = cut_lineage(running_total(stops, "weight", [ratio, F.col("rank")]))
    sums = both.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    size, weight = int(sums["size"] or 0), int(sums["weight"] or 0)
    level = (F.lit(size) - (F.col("stops") - F.col("stop"))) / (F.lit(weight) - (F.col("total") - F.col("weight")))
    rate = both.filter(level <= ratio).agg(F.max(level).alias("level")).first()["level"]
    target = F.least(F.col("stop").cast("double"), F.col("weight") * F.lit(float(rate or 0.0)))
    return both.select("source", "source_size", "rank", "weight", target.alias("target")), size


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per row of `docs`: `id`, `source`, `tie`, `size` (words), `source_size`, `weight`, `target`, `copies` and `taken` (`copies * size`).

    Each source's documents are shuffled by a hash of their id. The virtual finish time of a document's n-th repeat is the words of its source up to it
    (n - 1 whole rounds included) divided by the weight. All repeats are range-sorted by finish time and taken while their words fit the size of the
    whole input; so every source advances at its weight until it has been read `most` times.

    A null or empty text has size 0 and is taken at most once. A null source is one of the sources and comes last; a null id shuffles as an empty one.
    Rows repeated with one id are documents of their own. An empty table gives an empty result. Other columns are not looked at.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    sized = cut_lineage(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                                    F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                                    F.xxhash64(*plain).alias("tie")))
    targets, budget = source_targets(sized, weights, most)
    dealt = attach(sized.withColumn("mark", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))), targets, ["source"])
    rows = cut_lineage(running_total(dealt, "size", [F.col("rank"), F.col("mark"), F.col("id"), F.col("size"), F.col("tie")], ["rank"]))

    def finish(n: int) -> Column:
        return F.struct(((F.lit(n) * F.col("source_size") + F.col("total")) / F.col("weight")).alias("time"), F.col("rank"), F.col("mark"), F.lit(n).alias("n"))

    repeats = rows.select("size", F.explode(F.array(*[finish(n) for n in range(most)])).alias("at"))
    line = running_total(repeats.select("size", "at.*"), "size", [F.col("time"), F.col("rank"), F.col("mark"), F.col("n")])
    end = line.filter(F.col("total") <= budget).agg(F.max(F.struct("time", "rank", "mark", "n")).alias("end")).first()["end"]
    if end is None:
        copies = F.lit(0)
    else:
        last = F.struct(F.lit(end["time"]).cast("double").alias("time"), F.lit(end["rank"]).cast("bigint").alias("rank"), F.lit(end["mark"]).alias("mark"), F.lit(end["n"]).alias("n"))
        copies = sum(((finish(n) <= last).cast("int") for n in range(most)), F.lit(0))
    return rows.select("id", "source", "tie", "size", "source_size", "weight", "target",
                       F.when(F.col("size") == 0, F.least(copies, F.lit(1))).otherwise(copies).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs`, each as often as `mix_sources(docs)` takes it. Equal rows are told apart by number only."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    per = mixed.filter(F.col("copies") > 0).groupBy("id", "tie").agg(F.sum("copies").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(*plain).alias("own_tie"))
    key = Window.partitionBy("own_id", "own_tie")
    rows = rows.withColumn("many", F.count(F.lit(1)).over(key.orderBy("own_tie").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("no", F.row_number().over(key.orderBy("own_tie")))
    met = rows.join(per, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_tie") == F.col("tie")))
    times = F.floor(F.col("copies") / F.col("many")) + (F.col("no") <= F.col("copies") % F.col("many")).cast("int")
    return met.filter(times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("time")).select("row.*")
