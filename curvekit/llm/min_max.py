"""Near-duplicates by min-max hashing: both ends of every permutation, banded, and links confirmed on whole shingle sets."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .common import mix
from .components import components
from .ngram_join import document_sets, fetched_sets, grouped, in_rows, promising, set_names, signature, similar

U = np.uint64
PERMUTATIONS = 64  # each gives two values of the signature, its minimum and its maximum
BAND = 2  # permutations of a band, so four values
BLOCK = 64  # sets held in memory against which others are compared


def min_max(tokens: np.ndarray, at: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The smallest and the largest value of each set under each permutation: an array (sets, permutations, 2). Empty sets have zeros."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, permutations, 2), U)
    if not len(full):
        return out
    begins = at[full]
    turn = mix(np.arange(1, 2 * permutations + 1, dtype=U))
    for k in range(permutations):
        value = tokens ^ turn[2 * k]
        value *= turn[2 * k + 1] | U(1)
        out[full, k, 0] = np.minimum.reduceat(value, begins)
        out[full, k, 1] = np.maximum.reduceat(value, begins)
    return out


def band_keys(ends: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each set and band of `band` permutations; two sets have a key in common only if all values of that band agree."""
    sets, permutations, _ = ends.shape
    values = ends.reshape(sets, permutations // band, 2 * band)
    keys = np.broadcast_to(np.arange(1, permutations // band + 1, dtype=U), values.shape[:2]).copy()
    for k in range(2 * band):
        keys = mix(keys ^ values[:, :, k])
    return keys.view(np.int64)


def described(docs: DataFrame, size: int, permutations: int, band: int) -> DataFrame:
    """`id, n, a, b, bits, bands` of each document: size and names of its shingle set, parities of its shingles, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, bits, keys = [], [], [], [], []
            for _, _, tokens, at in document_sets(batch.column(1), size):
                x, y = set_names(tokens, at)
                n.append(np.diff(at)), a.append(x), b.append(y)
                bits += [signature(tokens[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                keys.append(band_keys(min_max(tokens, at, permutations), band).ravel())
            n, a, b, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n, a, b, keys))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * np.int32(permutations // band)), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(a), pa.array(b), pa.array(bits, pa.binary()), lists], ["id", "n", "a", "b", "bits", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n bigint, a bigint, b bigint, bits binary, bands array<bigint>")


def confirmed(near: DataFrame, kept: DataFrame, percent: int, together: bool) -> DataFrame:
    """Links `x, y` between queries and members of a block, compared by their whole sets; of each block only links that join what it has not joined yet.

    `near` has `grp, block, ask, a`, `kept` has `a, shingles`. With `together` the members of a block are known to be connected, so that a query's first
    link is enough. A task holds the members of one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, sets, root = None, [], [], {}

        def top(a: int) -> int:
            while root.setdefault(a, a) != a:
                root[a] = a = root[root[a]]
            return a

        for batch in in_rows(batches):
            xs, ys = [], []
            for grp, block, ask, a, packed in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (grp, block) != last:
                    last, names, sets, root = (grp, block), [], [], {}
                own = np.frombuffer(packed, U)
                if not ask:
                    names.append(a), sets.append(own)
                    if together:
                        root[a] = names[0]
                    continue
                for name, other in zip(names, sets):
                    if top(name) != top(a) and similar(own, other, percent):
                        root[top(a)] = top(name)
                        xs.append(a), ys.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    rows = near.join(kept, "a").repartition("grp", "block").sortWithinPartitions("grp", "block", "ask")
    return cut_lineage(rows.select("grp", "block", "ask", "a", "shingles").mapInArrow(run, "x bigint, y bigint").distinct())


def stars(cells: DataFrame, signs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and queries of blocks in which every set meets the one that shares most keys with all others (what copies were made from, if it is there) of those it shares a key
    with. A centre that many ask stands in several blocks."""
    shares = cells.groupBy("a").agg(F.sum("many").alias("share"))
    ranked = cut_lineage(cells.select("key", "a").join(shares, "a"))
    best = ranked.groupBy("key").agg(F.max(F.struct("share", "a")).alias("best"))
    asks = cut_lineage(ranked.join(best, "key").groupBy("a").agg(F.max("best").alias("best")).select("a", F.col("best.a").alias("y")).filter("a != y"))
    loads = asks.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * BLOCK)).cast("int").alias("blocks"))
    centres = (loads.join(signs, F.col("y") == F.col("a"))
               .select(F.col("y").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "a", "n", "bits"))
    queries = asks.join(signs, "a").join(loads, "y").select(F.col("y").alias("grp"), F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), "a", "n", "bits")
    return centres, queries


def beside_largest(mixed: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and queries of blocks in which sets meet the largest group of each of their cells, once however many cells they share. `mixed` has
    `a, grp, largest`."""
    asks = cut_lineage(mixed.filter("grp != largest").select("a", F.col("largest").alias("grp")).distinct())
    sizes = asks.select("grp").distinct().join(groups, "grp").groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = groups.join(sizes, "grp").select("grp", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), "a", "n", "bits")
    queries = asks.join(sizes, "grp").select("a", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(groups.select("a", "n", "bits"), "a")
    return members, queries


def within_cells(rest: DataFrame, groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members and queries of blocks in which sets meet all others of their cell whose size leaves room for a link: cells are split by levels of size, of
    which only neighbours can link, and a set is a member on its own level and asks there and one level above."""
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    rows = cut_lineage(rest.select("key", "a").join(groups.select("a", "n", "bits"), "a").withColumn("level", level))
    at = rows.withColumn("grp", F.xxhash64("key", "level"))
    sizes = at.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = at.join(sizes, "grp").select("grp", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), "a", "n", "bits")
    asks = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).select(F.xxhash64("key", (F.col("level") + F.col("up")).cast("int")).alias("grp"), "a", "n", "bits")
    queries = asks.join(sizes, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "a", "n", "bits")
    return members, queries


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """`id, n_shingles, component_id, kept` per row of `docs`.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set are its distinct shingles of `size` words, or its whole word
    sequence if it is shorter. Documents link when 100 * intersection >= percent * union; `component_id` is the smallest id reachable by links, and `kept`
    says whether that is the row's own. Documents without words (null and empty texts too) have an empty set and link with nothing. Equal sets, and so
    repeated rows, are one component; rows repeated with the smallest id are all kept. A null id is never the smallest unless its component has no other,
    and is kept then. An empty table gives an empty result. Shingles and sets are compared by 64-bit hashes.

    Each of 64 permutations gives its minimum and its maximum, so that half the hashes make 128 values; four of them are a band. Two sets at 85 per cent
    miss all 32 bands with a chance below 1e-9, and a link found is confirmed on the whole sets.

    1. Distinct sets that share a band key with another are compared with one centre each; links make groups. 2. In a cell (a band key) that still holds
    several groups, all sets outside its largest group meet the members of that group, once whatever the number of cells. 3. The sets outside are then
    compared among themselves within the cell. Members stand in blocks of 64, parities of shingles bound the distance of two sets before the sets are
    fetched, and no pair is written that is not a link. So no cell is expanded into pairs, nor held by one task.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    facts = cut_lineage(described(base, size, permutations, band))
    sets = facts.filter("n > 0").groupBy("a", "b").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    sets = cut_lineage(sets)
    cells = sets.select("a", F.explode("bands").alias("key"))
    full = cells.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    cells = cut_lineage(cells.join(full, "key"))
    able = cells.select("a").distinct()
    signs = cut_lineage(sets.select("a", "b", "id", "n", "bits").join(able, "a"))
    first = cut_lineage(promising(*stars(cells, signs.select("a", "n", "bits")), percent))
    likely = first.select("a").distinct()
    kept = cut_lineage(fetched_sets(base, signs.join(likely, "a").select("id", "a", "b"), size))
    links = confirmed(first, kept, percent, True)

    groups = grouped(signs.select("a", "n", "bits"), links)
    held = cut_lineage(cells.select("key", "a").join(groups.select("a", "grp"), "a"))
    largest = (held.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("size")).groupBy("key")
               .agg(F.max(F.struct("size", "grp")).alias("top"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("key", F.col("top.grp").alias("largest")))
    mixed = cut_lineage(held.join(largest, "key"))
    second = cut_lineage(promising(*beside_largest(mixed, groups), percent))
    third = cut_lineage(promising(*within_cells(mixed.filter("grp != largest"), groups, percent), percent))
    late = second.select("a").unionByName(third.select("a")).distinct()
    missing = signs.join(late, "a").join(likely, "a", "left_anti").select("id", "a", "b")
    if not missing.isEmpty():
        kept = cut_lineage(kept.unionByName(fetched_sets(base, missing, size)))
    roots = components(links.unionByName(confirmed(second, kept, percent, True)).unionByName(confirmed(third, kept, percent, False)))

    named = cut_lineage(sets.select("a", "b", "id").join(roots, F.col("a") == F.col("node"), "left").select("a", "b", "id", F.coalesce("root", "a").alias("root")))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    final = named.join(least, "root").select(F.col("a").alias("ka"), F.col("b").alias("kb"), "component_id")
    out = facts.select("id", "n", "a", "b").join(final, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
