"""Jaccard join of documents on word n-grams by a token-group matrix."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .common import doc_slices, lower_ascii, mix, shuffle_partitions, span_hashes, utf8, words
from .components import components

CELLS = 1 << 20  # counters of the frequency sketch, 4 MB whatever the input
BLOCK = 64  # documents of a group that are opened together
PART = 1 << 19  # tokens gathered before they are counted or dealt to buckets
ROWS = 128  # rows of a batch that are taken apart at once
U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and their n + 1 offsets."""
    data = lower_ascii(data)
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    counts = np.diff(first)
    total = np.zeros(len(hashes), U)
    for k in range(size):
        part = hashes[k:] * U(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64))
        total[:len(part)] += part
    total = mix(total)
    out, at = [], np.zeros(len(counts) + 1, np.int64)
    for i, (lo, n) in enumerate(zip(first[:-1].tolist(), counts.tolist())):
        if n >= size:
            own = np.sort(total[lo:lo + n - size + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif n:
            word = hashes[lo:lo + n]
            own = mix(np.array([(word * (np.arange(n, dtype=U) + U(n * 7919))).sum()], U) ^ U(n))
        else:
            own = hashes[:0]
        out.append(own)
        at[i + 1] = at[i] + len(own)
    return (np.concatenate(out) if out else hashes[:0]), at


def document_sets(column, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch: first and last document, shingles, offsets."""
    data, offsets = utf8(column)
    for lo, hi in doc_slices(offsets):
        yield lo, hi, *shingles(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], size)


def in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that only a few lists and byte strings are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)
    del batches
    pa.default_memory_pool().release_unused()


def set_names(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set; 0 for the empty one."""
    sums = [np.zeros(len(tokens) + 1, U), np.zeros(len(tokens) + 1, U)]
    np.cumsum(mix(tokens + U(0x51ED270B)), out=sums[0][1:])
    np.cumsum(mix(tokens ^ U(0x2545F4914F6CDD1D)), out=sums[1][1:])
    n = np.diff(at)
    return tuple(np.where(n > 0, mix(s[at[1:]] - s[at[:-1]] + n.astype(U)), U(0)).astype(np.int64) for s in sums)


def describe(docs: DataFrame, size: int) -> DataFrame:
    """`id, n, a, b, bits` of each document, and as further rows `part, cells`: counts of shingles by hash cell, one set of cells a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, waiting, held = np.zeros(CELLS, np.uint32), [], 0
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            n, a, b, bits = [], [], [], []
            for _, _, tokens, at in document_sets(batch.column(1), size):
                x, y = set_names(tokens, at)
                n.append(np.diff(at)), a.append(x), b.append(y)
                bits += [signature(tokens[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                waiting.append((tokens & U(CELLS - 1)).astype(np.int32))
                held += len(tokens)
                if held >= PART:
                    cells += np.bincount(np.concatenate(waiting), minlength=CELLS).astype(np.uint32)
                    waiting, held = [], 0
            rows = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n, a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in rows], pa.array(bits, pa.binary()), pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())],
                                             ["id", "n", "a", "b", "bits", "part", "cells"])
        if held:
            cells += np.bincount(np.concatenate(waiting), minlength=CELLS).astype(np.uint32)
        if kind is not None:
            step = CELLS // 16
            packed = [zlib.compress(cells[i * step:(i + 1) * step].tobytes(), 1) for i in range(16)]
            yield pa.RecordBatch.from_arrays([pa.nulls(16, kind), *[pa.nulls(16, pa.int64())] * 3, pa.nulls(16, pa.binary()), pa.array(range(16), pa.int32()), pa.array(packed, pa.binary())],
                                             ["id", "n", "a", "b", "bits", "part", "cells"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n bigint, a bigint, b bigint, bits binary, part int, cells binary")


def frequency(parts: DataFrame) -> np.ndarray:
    """The summed sketch. Parts are added up pairwise on the executors; the driver gets 4 MB."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(cells), np.uint32).astype(np.uint64)
                sums[part] = sums[part] + own if part in sums else own
        if sums:
            keys = sorted(sums)
            packed = [zlib.compress(np.minimum(sums[k], 2**32 - 1).astype(np.uint32).tobytes(), 1) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packed, pa.binary())], ["part", "cells"])

    salted = parts.select("part", "cells").repartition(32, "part", F.expr("hash(cells)")).mapInArrow(add, "part int, cells binary")
    summed = salted.repartition(4, "part").mapInArrow(add, "part int, cells binary").collect()
    cells = np.zeros((16, CELLS // 16), np.uint32)
    for row in summed:
        cells[row["part"]] = np.frombuffer(zlib.decompress(row["cells"]), np.uint32)
    return cells.reshape(-1)


def levels(cells: np.ndarray) -> np.ndarray:
    """Frequency of each cell on a scale of half octaves, 6 bits."""
    return np.minimum(63, 2 * np.log2(np.maximum(cells, 1))).astype(np.uint8)


def dealt_prefixes(docs: DataFrame, level, size: int, percent: int, buckets: int, hot: int) -> DataFrame:
    """`bucket, tokens, sets, rests`: the prefix tokens of all documents, dealt by token; a task tells equal sets once. A rest is how many tokens of the set
    do not come before this one: two sets whose first common token this is have no more in common.

    Tokens are ordered by frequency level, then hash. Two sets with the wanted overlap share a token among the first n - ceil(percent * n / 100) + 1 of
    each. A token of a level above `hot` is dealt to several buckets, twice as many each octave.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, told, tokens, names, rests, held = level.value, set(), [], [], [], 0

        def deal() -> pa.RecordBatch:
            token, name, rest = np.concatenate(tokens), np.concatenate(names), np.concatenate(rests)
            high = (token >> U(58)).astype(np.int64)
            spread = np.where(high > hot, 1 << np.minimum((high - hot + 1) // 2, 20), 1).astype(U)
            bucket = ((mix(token) % U(buckets) + mix(name) % spread) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
            edges = np.append(cuts, len(order)).tolist()
            token, name, rest = token[order], name[order], rest[order]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts].astype(np.int32)),
                                               pa.array([token[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary()),
                                               pa.array([name[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary()),
                                               pa.array([rest[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())], ["bucket", "tokens", "sets", "rests"])

        for batch in batches:
            for _, _, found, at in document_sets(batch.column(0), size):
                a, _ = set_names(found, at)
                ordered = scale[(found & U(CELLS - 1)).astype(np.int64)].astype(U) << U(58) | found >> U(6)
                n = np.diff(at)
                take = n - (n * percent + 99) // 100 + 1
                for i in np.flatnonzero(n).tolist():
                    if (name := int(a[i])) in told:
                        continue
                    told.add(name)
                    k = int(take[i])
                    own = ordered[at[i]:at[i + 1]]
                    tokens.append(np.sort(np.partition(own, k - 1)[:k]))
                    names.append(np.full(k, name, np.int64).view(U))
                    rests.append(np.arange(len(own), len(own) - k, -1, dtype=np.uint32))
                    held += k
                if held >= PART:
                    yield deal()
                    tokens, names, rests, held = [], [], [], 0
        if held:
            yield deal()

    return docs.select("text").mapInArrow(run, "bucket int, tokens binary, sets binary, rests binary")


def shared_tokens(dealt: DataFrame, hot: int) -> DataFrame:
    """`bucket, tokens, sets, rests` with tokens of two sets or more only (or of a spread token, which others may have elsewhere), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens, sets, rests = None, [], [], []

        def done() -> pa.RecordBatch:
            token, name, rest = (np.frombuffer(b"".join(x), kind) for x, kind in ((tokens, U), (sets, U), (rests, np.uint32)))
            order = np.lexsort((name, token))
            token, name, rest = token[order], name[order], rest[order]
            new = np.append(True, (token[1:] != token[:-1]) | (name[1:] != name[:-1]))
            token, name, rest = token[new], name[new], rest[new]
            same = token[1:] == token[:-1]
            keep = np.append(same, False) | np.append(False, same) | ((token >> U(58)) > hot)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([token[keep].tobytes()], pa.binary()), pa.array([name[keep].tobytes()], pa.binary()), pa.array([rest[keep].tobytes()], pa.binary())],
                                              ["bucket", "tokens", "sets", "rests"])

        for batch in in_rows(batches):
            for bucket, t, s, r in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if last is not None and bucket != last:
                    yield done()
                    tokens, sets, rests = [], [], []
                last = bucket
                tokens.append(t), sets.append(s), rests.append(r)
        if last is not None:
            yield done()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, tokens binary, sets binary, rests binary")


def token_rows(shared: DataFrame) -> DataFrame:
    """`token, a, rest`: a row for each token and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            for t, s, r in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(s, np.int64)), pa.array(np.frombuffer(r, np.int32))], ["token", "a", "rest"])

    return shared.select("tokens", "sets", "rests").mapInArrow(run, "token bigint, a bigint, rest int")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Sorted distinct arrays: 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def signature(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of 2n to 4n hash cells. Two signatures differ in at most as many cells as their sets have tokens apart."""
    size = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens) & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A signature brought down to fewer cells: parities of cells that fall together add up."""
    while len(bits) > words:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def in_blocks(members: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both sides (`grp, block, ask` and `columns`) by group block, members before queries."""
    cols = ["grp", "block", "ask", *columns]
    both = members.withColumn("ask", F.lit(False)).select(cols).unionByName(queries.withColumn("ask", F.lit(True)).select(cols))
    return both.repartition("grp", "block").sortWithinPartitions("grp", "block", "ask")


def promising(members: DataFrame, queries: DataFrame, percent: int) -> DataFrame:
    """`grp, block, ask, a`: queries that may have a partner among the members of their block, and those members.

    Sets with the wanted overlap have sizes within `percent`, and at most (100 - percent) / (100 + percent) of both sizes apart; signatures give a lower
    bound of that. Both sides have `grp, block, a, n, bits`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, sizes, bits, used, stacks = None, [], [], [], set(), {}
        for batch in in_rows(batches):
            out = []
            for grp, block, ask, a, n, packed in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if (grp, block) != last:
                    last, names, sizes, bits, used, stacks = (grp, block), [], [], [], set(), {}
                own = np.frombuffer(packed, U)
                if not ask:
                    names.append(a), sizes.append(n), bits.append(own)
                    stacks = {}
                    continue
                if not names:
                    continue
                some = []
                for words in {len(x) for x in bits}:
                    if words not in stacks:
                        stacks[words] = [i for i, x in enumerate(bits) if len(x) == words]
                    rows, low = stacks[words], min(words, len(own))
                    if ("m", words, low) not in stacks:
                        stacks["m", words, low] = (np.array(rows), np.array([sizes[i] for i in rows]), np.stack([folded(bits[i], low) for i in rows]))
                    at, size, matrix = stacks["m", words, low]
                    apart = np.bitwise_count(matrix ^ folded(own, low)).sum(axis=1, dtype=np.int64)
                    good = (100 * np.minimum(size, n) >= percent * np.maximum(size, n)) & (apart * (100 + percent) <= (100 - percent) * (size + n))
                    some += [i for i in at[good].tolist() if names[i] != a]
                if some:
                    out.append((grp, block, True, a))
                    out += [(grp, block, False, names[i]) for i in some if i not in used]
                    used.update(some)
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.int64()))], ["grp", "block", "ask", "a"])

    return in_blocks(members, queries, ["a", "n", "bits"]).mapInArrow(run, "grp bigint, block int, ask boolean, a bigint")


def opened(rows: DataFrame, percent: int) -> DataFrame:
    """Links `x, y`: for each query the first member of its group block that is similar, if any. `rows` has `grp, block, ask, a, shingles`.

    A block is streamed: its members (a few times BLOCK at most) are held with the union of their tokens, and a query is compared with them only if its
    overlap with the union is large enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, sets, union = None, [], [], None
        for batch in in_rows(batches):
            xs, ys = [], []
            for grp, block, ask, a, packed in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (grp, block) != last:
                    last, names, sets, union = (grp, block), [], [], None
                own = np.frombuffer(packed, U)
                if not ask:
                    names.append(a), sets.append(own)
                    continue
                if not sets:
                    continue
                if union is None:
                    union = sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                if 100 * int((union[at] == own).sum()) < percent * len(own):
                    continue
                for name, other in zip(names, sets):
                    if name != a and similar(own, other, percent):
                        xs.append(a), ys.append(name)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    dealt = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "ask")
    return dealt.select("grp", "block", "ask", "a", "shingles").mapInArrow(run, "x bigint, y bigint")


def cross_blocks(tokens: DataFrame, groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members and queries (`grp, block, a, n, bits`) of groups that share a prefix token: the rows of the token-group matrix with two groups or more.

    `tokens` has `token, a, rest`; `groups` has `a, grp, n, w, bits` for all its sets. The smaller group asks, and only through tokens that can be the first
    one in common: sets of n and m tokens with the wanted overlap have at least percent * (n + m) / (100 + percent) in common, and all these lie in the
    rests of both from there on. Sets that share a hundred tokens of their prefixes so meet through the few rarest of them. Of these tokens all but those
    behind one of the prefixes are in both prefixes, so `w` (tokens but those of the prefix that no other prefix has) is as large for the larger set of a
    pair, and for the smaller one less by the prefixes' difference at most, as a token of its prefix may lie behind that of the other.
    """
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("w").alias("room"))
    matrix = tokens.select("token", "a", "rest").join(groups.select("a", "grp", "n", "w"), "a")
    split = matrix.groupBy("token").agg(F.min("grp").alias("lowest"), F.max("grp").alias("highest")).filter("lowest != highest").select("token")
    rows = cut_lineage(matrix.join(split, "token").join(sizes, "grp"))
    others = rows.groupBy("token", F.col("grp").alias("other"), F.col("many").alias("others"), F.col("least").alias("low"), F.col("most").alias("high"), F.col("room").alias("wide")).agg(F.max("rest").alias("space"))
    smaller = (F.col("many") < F.col("others")) | ((F.col("many") == F.col("others")) & (F.col("grp") < F.col("other")))
    fits = (100 * F.col("n") >= percent * F.col("low")) & (percent * F.col("n") <= 100 * F.col("high"))
    fits &= (100 + percent) * F.least("rest", "space") >= percent * (F.col("n") + F.col("low"))
    # both bounds are concave in the partner's size, so they are least at one end of its sizes; 1 for rounding up
    need = lambda m, less: percent * (F.col("n") + m) / F.lit(100 + percent) - percent * F.greatest(less, F.lit(0)) / F.lit(100) - 1
    fits &= F.col("w") >= F.least(*[need(F.col(m), F.col(m) - F.col("n")) for m in ("low", "high")])
    fits &= F.col("wide") >= F.least(*[need(F.col(m), F.col("n") - F.col(m)) for m in ("low", "high")])
    pairs = cut_lineage(rows.join(others, "token").filter(smaller & fits).select("a", F.col("other").alias("grp"), "others").distinct())
    blocks = F.ceil(F.col("others") / F.lit(BLOCK)).cast("int")
    asked = pairs.groupBy("grp").agg(F.first("others").alias("others"))
    members = groups.join(asked, "grp").select("grp", F.pmod(F.xxhash64("a"), blocks).cast("int").alias("block"), "a", "n", "bits")
    queries = pairs.select("a", "grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).join(groups.select("a", "n", "bits"), "a")
    return members, queries.select("grp", "block", "a", "n", "bits")


def grouped(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """`sets` with `grp`: the component of each under `edges`; sets without edges are groups of their own."""
    roots = components(edges)
    return cut_lineage(sets.join(roots, F.col("a") == F.col("node"), "left").select(*sets.columns, F.coalesce("root", "a").alias("grp")))


def fetched_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """`a, shingles` of the wanted sets (`id, a, b`), from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, hi, tokens, at in document_sets(batch.column(2), size):
                x, y = set_names(tokens, at)
                good = np.flatnonzero((x == a[lo:hi]) & (y == b[lo:hi]))
                yield pa.RecordBatch.from_arrays([pa.array(x[good]), pa.array([tokens[at[i]:at[i + 1]].tobytes() for i in good.tolist()], pa.binary())], ["a", "shingles"])

    texts = wanted.withColumnRenamed("id", "rep").join(docs, F.col("rep").eqNullSafe(F.col("id"))).select("a", "b", "text")
    return texts.mapInArrow(run, "a bigint, shingles binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """`id, n_shingles, component_id` per row of `docs`.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set are its distinct shingles of `size` words, or its whole word
    sequence if it is shorter. Documents link when 100 * intersection >= percent * union; `component_id` is the smallest id reachable by links. Documents
    without words (null and empty texts too) have an empty set and link with nothing: their component is their own id. Equal sets, and so repeated rows,
    are one component. A null id is reported as null and never the smallest unless its component has no other. Shingles are compared by 64-bit hashes.

    1. One pass names each set and counts all shingles in a sketch of fixed size. 2. A second pass deals each set's prefix, rarest tokens first, by token.
    3. Each set that shares a prefix token with another is held against that of these sets which has most tokens in common with others (the original, where
    copies were made from one), by signatures that bound the sets' distance from below; with the matrix of step 4 over the groups so made this leaves the sets that may have a partner at all. These are fetched, compared in the same way by
    their shingles, and links make groups.
    4. The token-group matrix (shared prefix tokens x groups) names for each set the other groups that may hold a partner; the smaller group asks. A group
    is opened in blocks, and only if the signatures and the query's overlap with the block's token union could suffice; the first link found in a block
    ends it, since the members of a group are connected already. So no link between components is lost and no group is expanded into pairs.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    facts = cut_lineage(describe(base, size))
    rows = facts.filter(F.col("part").isNull()).select("id", "n", "a", "b", "bits")
    cells = frequency(facts.filter(F.col("part").isNotNull()))
    parts = shuffle_partitions(docs)
    limit = max(4 * int(cells.sum(dtype=np.uint64)) // CELLS, int(cells.sum(dtype=np.uint64)) // (64 * parts), 64)
    hot = int(2 * np.log2(limit))
    level = spark.sparkContext.broadcast(levels(cells))
    shared = cut_lineage(shared_tokens(dealt_prefixes(base, level, size, percent, 4 * parts, hot), hot))
    tokens = token_rows(shared)

    sets = rows.filter("n > 0").groupBy("a", "b").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    counts = tokens.groupBy("a").agg(F.count(F.lit(1)).alias("shared"))
    prefix = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100)) + 1
    room = (F.col("n") - prefix + F.col("shared")).alias("w")  # all tokens but those of the prefix that no other set has
    signs = cut_lineage(counts.withColumnRenamed("a", "own").join(sets.drop("id"), F.col("own") == F.col("a")).select("a", "n", room, "bits").filter(100 * F.col("w") >= percent * F.col("n")))
    lean = tokens.join(signs.select("a", (F.col("w") / F.col("n")).alias("share")), "a")
    best = lean.groupBy("token").agg(F.max(F.struct("share", "a")).alias("best"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("token", "best")
    # each set asks the one that has most in common with all sets, of those it shares a token with: what copies were made from, if it is there
    asks = lean.join(best, "token").groupBy("a").agg(F.max("best").alias("best")).select(F.col("a").alias("x"), F.col("best.a").alias("y")).filter("x != y")
    asks = cut_lineage(asks.join(signs, F.col("x") == F.col("a")).select("a", "y", "n", "bits"))
    loads = asks.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * BLOCK)).cast("int").alias("blocks"))
    centres = (loads.join(signs.select("a", "n", "bits"), F.col("y") == F.col("a"))
               .select(F.col("y").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "a", "n", "bits"))
    first = asks.join(loads, "y").select(F.col("y").alias("grp"), F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), "a", "n", "bits")
    near = cut_lineage(promising(centres, first, percent))
    likely = grouped(signs, near.filter("ask").select(F.col("a").alias("x"), F.col("grp").alias("y")))
    beside = cut_lineage(promising(*cross_blocks(tokens, likely, percent), percent))
    joint = likely.filter("a != grp").select(F.explode(F.array("a", "grp")).alias("a"))
    able = cut_lineage(joint.unionByName(beside.select("a")).distinct())  # sets that may have a partner at all
    kept = cut_lineage(fetched_sets(base, sets.join(able, "a").select("id", "a", "b"), size))

    links = cut_lineage(opened(near.join(kept, "a"), percent).distinct())
    groups = grouped(signs.join(able, "a"), links)
    left = cut_lineage(promising(*cross_blocks(tokens.join(able, "a"), groups, percent), percent))
    more = cut_lineage(opened(left.join(kept, "a"), percent).distinct())
    roots = components(links.unionByName(more))

    named = sets.join(roots, F.col("a") == F.col("node"), "left").select("a", "b", "id", F.coalesce("root", "a").alias("root"))
    named = cut_lineage(named)
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    final = cut_lineage(named.join(least, "root").select(F.col("a").alias("ka"), F.col("b").alias("kb"), "component_id"))
    out = rows.join(final, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row of `docs` for each component of `near_duplicates`: the one with the smallest id; of rows with that id the one with the smallest hash.

    Rows without words are components of their own and all stay. Rows with a null id stay only where no row of their component has an id. Columns are those
    of `docs`.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(*plain).alias("tie"))
    found = near_duplicates(rows.select(F.struct(F.col("id").isNull().alias("nil"), "id", "tie").alias("own"), "text"), "own", "text", size, percent)
    # ids are structs of id and hash here, so a component's smallest one is one row, or several that are equal
    lost = found.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id.id").alias("gone"), F.col("id.tie").alias("gone_tie")).distinct()
    left = rows.join(lost, (F.col("tie") == F.col("gone_tie")) & F.col("id").eqNullSafe(F.col("gone")), "left_anti")
    repeated = found.filter((F.col("n_shingles") > 0) & F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id").count().filter("count > 1")
    if repeated.isEmpty():
        return left.select("row.*")
    again = repeated.select(F.col("id.id").alias("rid"), F.col("id.tie").alias("rtie"))
    marked = left.join(again, (F.col("tie") == F.col("rtie")) & F.col("id").eqNullSafe(F.col("rid")), "left")
    single = marked.filter(F.col("rtie").isNull()).select("row").unionByName(marked.filter(F.col("rtie").isNotNull()).groupBy("id", "tie").agg(F.first("row").alias("row")).select("row"))
    return single.select("row.*")
