"""Exact duplicates by composable polynomial fingerprints and a chunkwise comparison of equal ones."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_slices, shuffle_partitions, utf8

#: The four largest primes below 2**31.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
CHUNK = 256  # bytes hashed by one row of a matrix product
COMPARE = 65536  # bytes compared at a time


class Polynomial:
    """Hash of a byte string as a number in base `base` modulo small primes.

    `hash(a + b) = hash(a) * base**len(b) + hash(b)`, so chunks may be hashed in any order and place and put together by their lengths.
    Sums of 256 products stay below 2**53 and are exact in doubles, which makes the chunk hashes one matrix product.
    """

    def __init__(self, moduli: tuple[int, ...] = MODULI):
        self.moduli = moduli
        self.bases = [(0x5DEECE66D * (i + 1) + 11) % (m - 2) + 2 if m > 3 else 2 for i, m in enumerate(moduli)]
        self.columns = np.array([[pow(b, CHUNK - 1 - i, m) for b, m in zip(self.bases, moduli)] for i in range(CHUNK)], np.float64)
        self._shift = np.ones((1, len(moduli)), np.uint64)

    def combine(self, left: list[int], right: list[int], right_bytes: int) -> list[int]:
        return [(x * pow(b, right_bytes, m) + y) % m for x, y, b, m in zip(left, right, self.bases, self.moduli)]

    def shifts(self, n: int) -> np.ndarray:
        """base**(CHUNK * k) for k < n, by doubling."""
        mods = np.array(self.moduli, np.uint64)
        while len(self._shift) < n:
            k = len(self._shift)
            top = np.array([pow(b, CHUNK * k, m) for b, m in zip(self.bases, self.moduli)], np.uint64)
            self._shift = np.concatenate([self._shift, self._shift * top % mods])
        return self._shift

    def chunk_hashes(self, rows: np.ndarray) -> np.ndarray:
        """One hash per row of CHUNK bytes."""
        out = np.empty((len(rows), len(self.moduli)), np.uint64)
        mods = np.array(self.moduli, np.uint64)
        for lo in range(0, len(rows), 2048):
            out[lo:lo + 2048] = (rows[lo:lo + 2048].astype(np.float64) @ self.columns).astype(np.uint64) % mods
        return out

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One hash per document: chunks are aligned to its end, so that each is shifted by whole chunks."""
        sizes = np.diff(offsets)
        chunks = np.maximum(1, -(-sizes // CHUNK))
        ends = np.cumsum(chunks)
        padded = np.zeros(int(ends[-1]) * CHUNK, np.uint8)
        for end, size, start in zip((ends * CHUNK).tolist(), sizes.tolist(), offsets.tolist()):
            padded[end - size:end] = data[start:start + size]
        each = self.chunk_hashes(padded.reshape(-1, CHUNK))
        behind = np.repeat(ends, chunks) - 1 - np.arange(int(ends[-1]))
        mods = np.array(self.moduli, np.uint64)
        each = each * self.shifts(int(chunks.max()))[behind] % mods
        return np.add.reduceat(each, ends - chunks, axis=0) % mods

    def keys(self, column) -> np.ndarray:
        """Fingerprints of a string column, an n x len(moduli) matrix."""
        data, offsets = utf8(column)
        out = np.zeros((len(offsets) - 1, len(self.moduli)), np.uint64)
        for lo, hi in doc_slices(offsets):
            out[lo:hi] = self.hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        return out


def fingerprint_udf(moduli: tuple[int, ...] = MODULI):
    """Column function text -> struct<a, b>: the hashes packed in pairs."""
    model = []

    def keys(text: pa.Array) -> pa.Array:
        if not model:
            model.append(Polynomial(moduli))
        h = model[0].keys(text)
        pad = np.zeros((len(h), 4), np.uint64)
        pad[:, :h.shape[1]] = h
        a, b = ((pad[:, i] << np.uint64(31) | pad[:, i + 1]).astype(np.int64) for i in (0, 2))
        return pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return F.arrow_udf(keys, "struct<a:bigint,b:bigint>")


def same_bytes(left: memoryview, right: memoryview, step: int = COMPARE) -> bool:
    """Chunk by chunk, ending at the first difference."""
    if len(left) != len(right):
        return False
    return all(left[i:i + step] == right[i:i + step] for i in range(0, len(left), step))


def class_udf():
    """Number of each row's text within its run of equal fingerprints.

    Rows come sorted by fingerprint, salt and text; only rows of one fingerprint are compared, each with the one before it. The state is one text.
    """

    def classes(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        last, text, number = None, None, 0
        for a, b, n, salt, body in batches:
            keys = np.stack([x.to_numpy(zero_copy_only=False) for x in (a, b, n, salt)], axis=1)
            again = np.zeros(len(keys), bool)
            again[1:] = (keys[1:] == keys[:-1]).all(axis=1)
            if len(keys) and last is not None:
                again[0] = bool((keys[0] == last).all())
            follow = np.append(again[1:], True)
            out = np.zeros(len(keys), np.int64)
            data, offsets = utf8(body)
            view = memoryview(np.ascontiguousarray(data))
            for i in np.flatnonzero(again | follow).tolist():
                own = view[offsets[i]:offsets[i + 1]]
                number = number + (not same_bytes(own, text)) if again[i] else 0
                out[i], text = number, own
            if len(keys):
                last, text = keys[-1].copy(), memoryview(bytes(text))
            yield pa.array(out)

    return F.arrow_udf(classes, "bigint", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, moduli: tuple[int, ...] = MODULI) -> DataFrame:
    """Each row of `docs` (the columns `carry`, by default all) with `keep_id`, `group_size` and `kept`.

    Rows belong together when their texts are identical bytes; null counts as empty, so null and empty texts form one group. Of a group the row with the
    largest id stays; a null id is smaller than any other. Rows repeated with one id stay once, the others are dropped like any copy. An empty table gives
    an empty result. Input columns called like one of the three results are replaced by it.

    The texts are shuffled once, by fingerprint. Texts with more copies than a quarter of a mean partition (at most four a partition) are salted: their
    size and last row come from a map-side aggregate, whose row is sent to each salt.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("keep_id", "group_size", "kept")]
    spark, parts = docs.sparkSession, shuffle_partitions(docs)
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"), F.xxhash64(*plain).alias("tie"))
    rows = rows.withColumn("quick", F.xxhash64("body"))
    limit = max(1, rows.count() // (4 * parts))
    hot = F.broadcast(rows.groupBy("quick").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > limit)
                      .select("quick", F.ceil(F.col("many") / limit).cast("int").alias("slots")))
    best = (rows.join(hot, "quick").groupBy("body", "slots")
            .agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("id", "tie")).alias("top")))
    sent = best.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "body",
                       F.lit(None).cast("bigint").alias("tie"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("salt"),
                       F.struct("size", "top").alias("known"))
    own = (rows.join(hot, "quick", "left")
           .withColumn("salt", F.pmod(F.xxhash64("id", "tie"), F.coalesce(F.col("slots"), F.lit(1))).cast("int"))
           .select("row", "id", "body", "tie", "salt", F.lit(None).cast(sent.schema["known"].dataType).alias("known")))
    key = ["a", "b", "n", "salt"]
    keyed = own.unionByName(sent).withColumn("fp", fingerprint_udf(moduli)("body"))
    keyed = keyed.select("row", "id", "body", "tie", "salt", "known", F.col("fp.a").alias("a"), F.col("fp.b").alias("b"), F.octet_length("body").cast("bigint").alias("n"))
    dealt = keyed.repartition(*key).sortWithinPartitions(*key, "body")
    classed = dealt.withColumn("cls", class_udf()("a", "b", "n", "salt", "body"))
    group = Window.partitionBy(*key, "cls")
    ordered = group.orderBy(F.col("known").isNull(), F.col("id").desc_nulls_last(), F.col("tie").desc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (classed.withColumn("head", F.first("known").over(whole)).withColumn("n_rows", F.count(F.lit(1)).over(whole))
           .withColumn("top_id", F.first("id").over(whole)).withColumn("at", F.row_number().over(ordered))
           .filter(F.col("known").isNull()))
    salted = F.col("head").isNotNull()
    result = {"keep_id": F.when(salted, F.col("head.top.id")).otherwise(F.col("top_id")),
              "group_size": F.when(salted, F.col("head.size")).otherwise(F.col("n_rows")),
              "kept": F.when(salted, (F.col("at") == 2) & F.col("id").eqNullSafe(F.col("head.top.id")) & F.col("tie").eqNullSafe(F.col("head.top.tie"))).otherwise(F.col("at") == 1)}
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], *[v.alias(k) for k, v in result.items()])
