"""Ranked lexical search by the Best Position Algorithm over impact lists."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import cut_lineage
from .common import doc_slices, lower_ascii, span_hashes, utf8, words

#: Terms are runs of ASCII letters, digits and all characters beyond ASCII.
TERM = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
BLOCK = 1 << 20  # query terms that a task holds at once
POSTINGS = 1 << 20  # postings of one shard of the index
FIRST = 16  # positions read from each list at first, doubled from round to round


def term_hashes(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch: first and last text, hashes of all terms in order, offsets."""
    data, offsets = utf8(column)
    for lo, hi in doc_slices(offsets):
        own, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        flat = np.where(TERM[own], lower_ascii(own), np.uint8(32))
        starts, ends, first = words(flat, at)
        yield lo, hi, span_hashes(flat, starts, ends).view(np.int64), first


def query_terms(queries: DataFrame) -> DataFrame:
    """`item, term`: each query's distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found, first in term_hashes(batch.column(1)):
                row = np.repeat(np.arange(lo, hi), np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(found)], ["item", "term"])

    return queries.mapInArrow(run, f"item {queries.schema['item'].dataType.simpleString()}, term bigint").distinct()


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """`id, n, terms, counts`: terms with repeats of each document, and how often it holds each of the query terms (two arrays of 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            n, terms, counts = [], [], []
            for lo, hi, found, first in term_hashes(batch.column(1)):
                n.append(np.diff(first))
                at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                good = known[at] == found if len(known) else np.zeros(len(found), bool)
                row = np.repeat(np.arange(hi - lo), np.diff(first))[good]
                key, many = np.unique(row * np.int64(max(len(known), 1)) + at[good], return_counts=True)
                row, term = np.divmod(key, max(len(known), 1))
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                term, many = term.astype(np.uint32), many.astype(np.uint32)
                terms += [term[i:j].tobytes() for i, j in zip(cut, cut[1:])]
                counts += [many[i:j].tobytes() for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                                             ["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n bigint, terms binary, counts binary")


def document_frequency(posted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the `size` query terms; counted in the tasks, added up by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in posted.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Shard:
    """Impact lists of some documents: for each term its documents by falling impact, and by number with their place in that list."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray, weights: np.ndarray, texts: int, tokens: int):
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        norm = 10 + 90 * lengths * texts // max(tokens, 1)
        counts = counts.astype(np.int64)
        impact = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * norm[doc]))
        some = impact > 0  # a posting without impact adds nothing to any score
        doc, terms, impact = doc[some], terms[some], impact[some]
        self.documents, self.starts = len(sizes), np.append(0, np.cumsum(np.bincount(terms, minlength=len(weights))))
        by_impact = np.lexsort((-impact, terms))
        self.docs, self.impacts = doc[by_impact], impact[by_impact]
        place = np.empty(len(doc), np.int64)
        place[by_impact] = np.arange(len(doc)) - self.starts[terms[by_impact]]
        by_doc = np.argsort(terms, kind="stable")
        self.by_doc, self.places = doc[by_doc], place[by_doc]

    def lists(self, terms: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """`docs, impacts` by falling impact and `docs, places` by number of each term that has any."""
        ends = [(self.starts[t], self.starts[t + 1]) for t in terms.tolist()]
        return [(self.docs[i:j], self.impacts[i:j], self.by_doc[i:j], self.places[i:j]) for i, j in ends if j > i]


def best_positions(lists: list[tuple[np.ndarray, ...]], documents: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the k best, their scores, and how many documents were scored.

    All lists are read in step. A document met for the first time is looked up in all lists at once, and every place so found counts as seen. The best
    position of a list is the last place up to which all are seen: an unseen document stands behind it in every list, so its score is at most the sum of
    the impacts that follow the best positions. Reading stops when that sum is strictly below the k-th score (equal scores can still win by number).
    """
    seen = [np.zeros(len(x[0]) + 1, bool) for x in lists]
    best, known = [0] * len(lists), np.zeros(documents, bool)
    docs, scores, read, step, scored = np.zeros(0, np.int32), np.zeros(0, np.int64), 0, FIRST, 0
    while True:
        parts = [x[0][read:read + step] for x in lists]
        fresh = np.unique(np.concatenate(parts)) if parts else docs[:0]
        fresh = fresh[~known[fresh]]
        known[fresh] = True
        scored += len(fresh)
        own = np.zeros(len(fresh), np.int64)
        for t, (_, impacts, numbers, places) in enumerate(lists):
            at = np.minimum(np.searchsorted(numbers, fresh), len(numbers) - 1)
            hit = numbers[at] == fresh
            place = places[at[hit]]
            own[hit] += impacts[place]
            seen[t][place] = True
            best[t] += int(np.argmin(seen[t][best[t]:]))  # the first place not seen; one behind the end never is
        docs, scores = np.append(docs, fresh), np.append(scores, own)
        kth = 0
        if len(scores) >= k:
            kth = int(np.partition(scores, len(scores) - k)[len(scores) - k])
            docs, scores = docs[scores >= kth], scores[scores >= kth]
        bound = sum(int(x[1][b]) for x, b in zip(lists, best) if b < len(x[1]))
        read, step = read + step, 2 * step
        if bound < kth or all(b == len(x[0]) for x, b in zip(lists, best)):
            return docs, scores, scored


def search_shards(dealt: DataFrame, shared, k: int, id_type, item_type) -> DataFrame:
    """`item, id, score`: each query's k best documents of each shard, equal scores by id. `dealt` has `shard, id, n, terms, counts` by shard and id."""
    id_arrow, item_arrow = to_arrow_type(id_type), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, asked, weights, texts, tokens = shared.value
        last, held = None, []

        def done() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(1) for b in held])
            lengths = np.concatenate([b.column(2).to_numpy() for b in held])
            terms, counts = ([x for b in held for x in b.column(i).to_pylist()] for i in (3, 4))
            sizes = np.array([len(x) // 4 for x in terms], np.int64)
            shard = Shard(sizes, *[np.frombuffer(b"".join(x), np.uint32) for x in (terms, counts)], lengths, weights, texts, tokens)
            out = [[np.zeros(0, np.int64)] for _ in range(3)]
            for i, own in enumerate(asked):
                docs, scores, _ = best_positions(shard.lists(own), shard.documents, k)
                order = np.lexsort((docs, -scores))[:k]
                for column, value in zip(out, (np.full(len(order), i), docs[order], scores[order])):
                    column.append(value)
            item, doc, score = (pa.array(np.concatenate(x)) for x in out)
            return pa.RecordBatch.from_arrays([pa.array(items, item_arrow).take(item), ids.take(doc).cast(id_arrow), score], ["item", "id", "score"])

        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, shards[1:] != shards[:-1])), len(shards)).tolist() if len(shards) else []
            for i, j in zip(edges, edges[1:]):
                if held and shards[i] != last:
                    yield done()
                    held = []
                last = shards[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield done()

    return dealt.mapInArrow(run, f"item {item_type.simpleString()}, id {id_type.simpleString()}, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block: int = BLOCK, postings_per_shard: int = POSTINGS) -> DataFrame:
    """`item_id, rank, doc_id, score` (under the names given): each query's k best documents with a score above 0, equal scores by rising id.

    Terms are runs of letters and digits (all of Unicode beyond ASCII counts as letters), A-Z lower-cased. With N documents that have a term, L terms in
    all, n terms in a document, df documents with a term and tf of it in a document: w = floor(1000 * ln((2N + 2) / (2df + 1))),
    m = 10 + 90nN div L, and the score sums w * (10^9 tf div (1000 tf + 8m)) over the query's distinct terms.

    Documents are counted in one pass, which keeps the postings of query terms only, and dealt at random to shards of about `postings_per_shard` postings;
    a task holds one shard, answers all queries on it by `best_positions`, and the k best of all shards are ranked. A frequent term so spreads over all
    shards. Queries are taken in blocks of about `block` terms, so what is broadcast (hashes, weights and lists of query terms) is bounded.

    Null and empty texts have no terms: such documents are never found, such queries find nothing. Rows repeated with one id are documents of their own, and
    queries repeated with one id are one query with the terms of all. A null id comes last among equal scores. An empty table gives an empty result; other
    columns are not looked at. Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = cut_lineage(query_terms(queries.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{query_col}`").alias("text"))))
    id_type, item_type = base.schema["id"].dataType, asked.schema["item"].dataType
    blocks = max(1, -(-asked.count() // block))
    found = []
    for number in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
        lists = [np.array(r["terms"], np.int64) for r in own]
        vocabulary = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        posted = cut_lineage(postings(base, spark.sparkContext.broadcast(vocabulary)).withColumn("row", F.monotonically_increasing_id()))
        sums = posted.filter("n > 0").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("tokens"), F.sum(F.octet_length("terms") / 4).alias("postings")).first()
        texts, tokens, shards = int(sums["texts"]), int(sums["tokens"] or 0), max(1, -(-int(sums["postings"] or 0) // postings_per_shard))
        df = document_frequency(posted, len(vocabulary))
        weights = np.floor(1000 * np.log((2 * texts + 2) / (2 * df + 1))).astype(np.int64)
        shared = spark.sparkContext.broadcast(([r["item"] for r in own], [np.searchsorted(vocabulary, x) for x in lists], weights, texts, tokens))
        dealt = (posted.filter(F.octet_length("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
                 .select("shard", "id", "n", "terms", "counts").repartitionById(shards, F.col("shard"))
                 .sortWithinPartitions("shard", F.col("id").asc_nulls_last()))
        found.append(search_shards(dealt, shared, k, id_type, item_type))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
