"""Approximate nearest neighbours: balanced posting lists, boundary vectors in several of them, centroids searched by a graph in memory."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage

DEGREE = 24  # links of a centroid
BEAM = 256  # centroids kept during a search
BATCH = 512  # vectors that search together
MEMBERS, QUERIES = 4096, 512  # vectors and queries of one block of a list
LARGE = 1e100  # numbers up to this one can be squared and added without overflow
LISTS = 1024, 8192  # least and most lists there may be where none are asked for


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows, not below 0."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)


def tame(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with none of their numbers beyond LARGE (longer ones are shortened), and which were shortened. Lists are chosen by these."""
    most = np.abs(x).max(axis=1, initial=0)
    far = most > LARGE
    if far.any():
        x = x.copy()
        x[far] *= (LARGE / most[far])[:, None]
    return x, far


def lengths(d: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; rows whose squares overflow are divided by their largest number first."""
    most = np.abs(d).max(axis=1, initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt((d * d).sum(axis=1))
        far = np.flatnonzero(~np.isfinite(out))
        out[far] = most[far] * np.sqrt(((d[far] / most[far, None]) ** 2).sum(axis=1))
    out[~np.isfinite(most)] = np.inf  # the difference itself overflows
    return out


def balanced_centroids(sample: np.ndarray, limit: int, rng: np.random.Generator, ways: int = 8, steps: int = 8) -> np.ndarray:
    """Centroids of clusters of at most `limit` sample vectors: clusters are split again and again by k-means whose distances grow with a cluster's share."""
    work, out = [np.arange(len(sample))], []
    while work:
        own = work.pop()
        x = sample[own]
        k = min(ways, -(-len(own) // limit))
        if k < 2 or not (x != x[0]).any():
            out.append(x.mean(axis=0))
            continue
        centres = x[rng.choice(len(x), k, replace=False)]
        penalty = np.zeros(k)
        for _ in range(steps):
            away = distances(x, centres)
            side = (away + penalty * away.mean()).argmin(axis=1)
            share = np.bincount(side, minlength=k) / len(x)
            penalty = np.maximum(0, penalty + 0.5 * (share - 1 / k))
            for c in np.flatnonzero(share):
                centres[c] = x[side == c].mean(axis=0)
        parts = [own[side == c] for c in range(k) if (side == c).any()]
        if len(parts) < 2:
            half = np.argsort(x[:, x.var(axis=0).argmax()], kind="stable")
            parts = [own[half[:len(half) // 2]], own[half[len(half) // 2:]]]
        work += parts
    return np.array(out)


class CentroidGraph:
    """Centroids with links to the nearest ones and to some at random; searches walk from the best found so far, many vectors at a time."""

    def __init__(self, centroids: np.ndarray, seed: int = 3):
        self.points = centroids
        n = len(centroids)
        rng = np.random.default_rng(seed)
        near = np.concatenate([np.argsort(distances(centroids[lo:lo + BATCH], centroids), axis=1, kind="stable")[:, 1:DEGREE + 1] for lo in range(0, n, BATCH)])
        far = rng.integers(0, n, (n, 4))
        back: list[list[int]] = [[] for _ in range(n)]  # links from a centroid's nearest ones to itself, so that every centroid can be reached
        for i, own in enumerate(near[:, :3].tolist()):
            for j in own:
                back[j].append(i)
        most = max((len(b) for b in back), default=0)
        back = np.array([b + [i] * (most - len(b)) for i, b in enumerate(back)], np.int64).reshape(n, most)
        self.links = np.concatenate([near, far, back], axis=1) if n > 1 else np.zeros((n, 1), np.int64)
        self.entries = rng.choice(n, min(n, 8), replace=False)

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids found for each vector, nearest first, and their distances; shorter results are filled with -1 and infinity."""
        n, rows = len(self.points), np.arange(len(x))[:, None]
        x, beam = tame(x)[0], min(beam, n)
        seen = np.zeros((len(x), n), bool)
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        seen[rows, ids] = True
        away = self.between(x, ids)
        open_ = np.ones(ids.shape, bool)
        while True:
            waiting = np.where(open_, away, np.inf)
            pick = waiting.argmin(axis=1)
            live = np.flatnonzero(waiting[rows[:, 0], pick] < np.inf)
            if not len(live):
                break
            open_[live, pick[live]] = False
            next_ = self.links[ids[live, pick[live]]]
            fresh = ~seen[live[:, None], next_]
            fresh &= ~np.triu(next_[:, None, :] == next_[:, :, None], 1).any(axis=1)  # a node named twice counts once
            seen[live[:, None], next_] = True
            more = np.full((len(x), next_.shape[1]), np.inf)
            more[live] = np.where(fresh, self.between(x[live], next_), np.inf)
            named = np.full(more.shape, -1, np.int64)
            named[live] = np.where(fresh, next_, -1)
            ids, away = np.concatenate([ids, named], axis=1), np.concatenate([away, more], axis=1)
            open_ = np.concatenate([open_, more < np.inf], axis=1)
            order = np.argsort(away, axis=1, kind="stable")[:, :beam]
            ids, away, open_ = (np.take_along_axis(v, order, 1) for v in (ids, away, open_))
        order = np.argsort(away, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(away, order, 1))

    def between(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        y = self.points[ids]
        return ((y - x[:, None, :]) ** 2).sum(axis=2)

    def lists_of(self, x: np.ndarray, ratio: float, copies: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each posting: the nearest centroid, and the next ones at most `ratio` times as far, `copies` in all."""
        ids, away = self.search(x, 24)
        row, place = np.nonzero((ids[:, :copies] >= 0) & (away[:, :copies] <= ratio * away[:, :1]))
        return row, ids[row, place]


def as_matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id, v`: vectors as doubles that are not null, not zero, hold only finite numbers, and have the most frequent length."""
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


def nearest_neighbours(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int | None = None, lists: int | None = None,
                       fill: int = 48, ratio: float = 1.1, copies: int = 4, reach: float = 1.25, most_lists: int = BEAM) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each row where `query` holds its `k` nearest others found, nearest first, ties to the smaller id.

    Scores are Euclidean distances in double precision on the original vectors. Vectors that are null, zero, or hold null or non-finite numbers take no
    part, nor do those of another length than most. Rows with the query's id are no candidates; other repeated rows are, once each id. An empty table
    gives an empty result.

    Scores of vectors whose squares overflow are right as well, up to the largest double. Lists are chosen as if their numbers ended at LARGE.

    There are at most about `lists` centroids, so that each task can hold them: by default the square root of the number of vectors, at least 1,024 and at
    most 8,192. They are fitted on at most `sample` vectors (by a hash of their id), by default 16 for each list. Every vector
    goes to the list of its nearest centroid, boundary vectors to up to `copies` lists (those within `ratio`). A query opens the lists within `reach` times
    the distance of its nearest centroid (at most `most_lists`), and the nearest lists up to 16 times the vectors asked for, copies not counted. Long lists and many queries are cut into blocks.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = usable(vectors, id_col, vector_col)
    asks = usable(vectors.filter(query), id_col, vector_col)
    total = rows.count()
    lists = lists or min(max(LISTS[0], math.isqrt(total)), LISTS[1])
    sample = sample or 16 * lists
    marked = rows.select("v", F.xxhash64(F.col("id"), F.lit(3)).alias("mark"))
    last = marked.select("mark").orderBy("mark").limit(sample).agg(F.max("mark").alias("last")).first()["last"]  # only so many vectors reach the driver
    got = marked.filter(F.col("mark") <= (0 if last is None else last)).orderBy("mark").limit(sample).select("v").toArrow().column("v")
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not len(got):
        return spark.createDataFrame([], schema)
    few = tame(as_matrix(got))[0]
    limit = max(fill * len(few) // max(total, 1), -(-len(few) // lists), 1)
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(few, limit, np.random.default_rng(3))))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some = batch.slice(lo, BATCH)
                row, own = graph.value.lists_of(as_matrix(some.column(1)), ratio, copies)
                yield pa.RecordBatch.from_arrays([pa.array(own), some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row))], ["list", "id", "v"])

    postings = cut_lineage(rows.mapInArrow(post, f"list bigint, id {kind}, v array<double>"))
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("many")).collect()  # one row a centroid
    many = np.zeros(len(graph.value.points), np.int64)
    for r in sizes:
        many[r["list"]] = r["many"]
    held = spark.sparkContext.broadcast(many)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some = batch.slice(lo, BATCH)
                ids, away = graph.value.search(as_matrix(some.column(1)), most_lists)
                count = np.where(ids >= 0, held.value[ids], 0)
                before = np.cumsum(count, axis=1) - count
                good = (ids >= 0) & (count > 0) & ((away <= reach * away[:, :1]) | (before < 16 * copies * (k + 1)))
                row, place = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, place]), some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row))], ["list", "id", "v"])

    chosen = cut_lineage(asks.mapInArrow(choose, f"list bigint, id {kind}, v array<double>"))
    load = chosen.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("qs"))
    load = F.broadcast(load.join(postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).cast("int").alias("ms")), "list"))  # one row a centroid
    blocks = {"q": F.pmod(F.xxhash64("id"), F.col("qs")).cast("int"), "m": F.pmod(F.xxhash64("id", F.lit(1)), F.col("ms")).cast("int")}
    every = {"q": F.explode(F.sequence(F.lit(0), F.col("qs") - 1)), "m": F.explode(F.sequence(F.lit(0), F.col("ms") - 1))}
    asked = chosen.join(load, "list").withColumn("q", blocks["q"]).withColumn("m", every["m"]).withColumn("ask", F.lit(True))
    offered = postings.join(load, "list").withColumn("m", blocks["m"]).withColumn("q", every["q"]).withColumn("ask", F.lit(False))
    cols = ["list", "m", "q", "ask", "id", "v"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, parts = None, [], []

        def found(asked_names: pa.Array, x: np.ndarray) -> pa.RecordBatch | None:
            if not parts:
                return None
            if len(parts) > 1:
                parts[:] = [np.concatenate(parts)]
                names[:] = [pa.concat_arrays(names)]
            y, own = parts[0], names[0].to_pylist()
            (small_x, far_x), (small_y, far_y) = tame(x), tame(y)
            rough = distances(small_x, small_y)
            out = ([], [], [])
            for i, name in enumerate(asked_names.to_pylist()):
                row = rough[i]
                scale = float(row.max()) + float((small_x[i] * small_x[i]).sum())
                edge = np.partition(row, k)[k] if len(row) > k + 1 else np.inf  # k + 1 of them: the query itself may be one
                some = np.flatnonzero((row <= edge + 1e-9 * scale) | far_y | far_x[i])  # rough distances of shortened vectors tell nothing
                with np.errstate(over="ignore"):
                    exact = lengths(y[some] - x[i])
                best, taken = sorted(zip(exact.tolist(), (own[j] for j in some.tolist()))), set()
                for score, other in best:
                    if other != name and other not in taken and len(taken) < k:
                        taken.add(other)
                        for column, value in zip(out, (name, other, score)):
                            column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(out[0], asked_names.type), pa.array(out[1], asked_names.type), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))), len(key)).tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                some = batch.slice(lo, hi - lo)
                if last != tuple(key[lo, :3]):
                    last, names, parts = tuple(key[lo, :3]), [], []
                if not key[lo, 3]:
                    names.append(some.column(4)), parts.append(as_matrix(some.column(5)))
                    continue
                for a in range(0, some.num_rows, 128):
                    part = some.slice(a, 128)
                    if (out := found(part.column(4), as_matrix(part.column(5)))) is not None:
                        yield out

    met = (asked.select(cols).unionByName(offered.select(cols)).repartition("list", "m", "q").sortWithinPartitions("list", "m", "q", "ask")
           .mapInArrow(compare, f"query_id {kind}, vec_id {kind}, score double"))
    single = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = single.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
