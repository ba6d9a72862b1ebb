"""SentencePiece encoding and decoding: a Viterbi search over batches of equal-length segments in numpy."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, doc_slices, mix, utf8

#: Fixed values of the piece format: the mark that stands for a space, and the name of a byte piece.
MARK = 0x2581
BYTE_PIECE = "<0x%02X>"
LITERAL_MARK = 0x110000  # a mark that is in the text itself: no piece has it, so it becomes bytes
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
LONG = 96  # segments beyond this length are searched one by one
U = np.uint64


def model_path(name: str = "piece_bpe_32k.model", folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"


def _bits(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(mix(keys) & U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return out


class Pieces:
    """The pieces of a model with their scores; `encode` maximises the sum of scores, ties go to the earlier start and the shorter piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = np.array([model.piece_to_id(BYTE_PIECE % b) for b in range(256)], np.int32)
        self.longest = max(len(names[i]) for i in normal)
        keys = np.array([self.key([ord(c) for c in names[i]]) for i in normal], U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int32)[order]
        self.scores = np.array([model.get_score(i) for i in normal], np.float64)[order]
        self.unknown = float(self.scores.min()) - 10.0
        self.known = _bits(self.keys)
        pairs = {(ord(a), ord(b)) for i in normal for a, b in zip(names[i], names[i][1:])}
        self.joined = _bits(np.array([a << 21 | b for a, b in pairs], U))
        text = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(chr(MARK), " ").encode() for i in ids]
        self.pool = np.frombuffer(b"".join(text), np.uint8)
        self.widths = np.array([len(t) for t in text], np.int64)
        self.places = np.cumsum(self.widths) - self.widths

    @staticmethod
    def key(points) -> int:
        h = 0
        for p in points:
            h = (h * int(FACTOR) + p + 1) % (1 << 64)
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the sorted keys, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.known[(mix(hashes) & U((1 << FILTER_BITS) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best path of n segments of equal length L: ids (n x L, filled from the right; a character without piece is -1 - code) and their numbers."""
        n, size = codes.shape
        best = np.full((size + 1, n), -np.inf)
        back, piece = np.zeros((size + 1, n), np.int32), np.zeros((size + 1, n), np.int64)
        best[0] = 0
        columns = np.ascontiguousarray(codes.T).astype(U)
        for i in range(size):
            h = np.zeros(n, U)
            single = np.zeros(n, bool)
            for k in range(1, min(self.longest, size - i) + 1):
                h = h * FACTOR + columns[i + k - 1] + U(1)
                at = self.find(h)
                hit = np.flatnonzero(at >= 0)
                if k == 1:
                    single[hit] = True
                value = best[i, hit] + self.scores[at[hit]]
                better = hit[value > best[i + k, hit]]
                best[i + k, better] = best[i, better] + self.scores[at[better]]
                back[i + k, better], piece[i + k, better] = i, self.ids[at[better]]
            lone = np.flatnonzero(~single)
            value = best[i, lone] + self.unknown
            better = lone[value > best[i + 1, lone]]
            best[i + 1, better] = best[i, better] + self.unknown
            back[i + 1, better], piece[i + 1, better] = i, -1 - columns[i, better].astype(np.int64)
        out, count = np.zeros((n, size), np.int64), np.zeros(n, np.int64)
        at, rows = np.full(n, size, np.int64), np.arange(n)
        while len(rows):
            count[rows] += 1
            out[rows, size - count[rows]] = piece[at[rows], rows]
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return out, count

    def search_long(self, codes: np.ndarray) -> list[int]:
        """The same path for one long segment: all substrings are probed by length, then one pass over the characters."""
        size = len(codes)
        found: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        h = np.zeros(size, U)
        for k in range(1, min(self.longest, size) + 1):
            h = h[:size - k + 1] * FACTOR + codes[k - 1:].astype(U) + U(1)
            at = self.find(h)
            for i in np.flatnonzero(at >= 0).tolist():
                found[i].append((k, int(at[i])))
        best, back, piece = [0.0] + [-np.inf] * size, [0] * (size + 1), [0] * (size + 1)
        scores, ids = self.scores.tolist(), self.ids.tolist()
        for i in range(size):
            for k, at in found[i]:
                if best[i] + scores[at] > best[i + k]:
                    best[i + k], back[i + k], piece[i + k] = best[i] + scores[at], i, ids[at]
            if not (found[i] and found[i][0][0] == 1) and best[i] + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1], piece[i + 1] = best[i] + self.unknown, i, -1 - int(codes[i])
        out, at = [], size
        while at:
            out.append(piece[at])
            at = back[at]
        return out[::-1]

    def segments(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments (`starts` has their begins) one after the other, and the number of each. Equal segments are searched once."""
        sizes = np.diff(np.append(starts, len(points)))
        power = np.full(int(sizes.max()) if len(sizes) else 1, FACTOR, U)
        power[0] = 1
        power = np.multiply.accumulate(power)
        within = np.arange(len(points)) - np.repeat(starts, sizes)
        names = mix(np.add.reduceat(mix(points.astype(U) + U(0x1234567)) * power[within], starts) + sizes.astype(U))
        _, where, back = np.unique(names, return_index=True, return_inverse=True)
        lengths = sizes[where]
        flat, counts = [np.zeros(0, np.int64)], np.zeros(len(where), np.int64)
        begin, held = np.zeros(len(where), np.int64), 0

        def add(rows, ids, own) -> None:
            nonlocal held
            counts[rows], begin[rows] = own, held + np.cumsum(own) - own
            flat.append(ids)
            held += len(ids)

        for size in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == size)
            if size > LONG:
                for row in rows.tolist():
                    ids = np.array(self.search_long(points[starts[where[row]]:starts[where[row]] + size]), np.int64)
                    add(np.array([row]), *self.with_bytes(ids, np.array([len(ids)])))
                continue
            for lo in range(0, len(rows), 1 << 15):
                some = rows[lo:lo + (1 << 15)]
                ids, own = self.search(points[starts[where[some]][:, None] + np.arange(size)])
                used = np.arange(size)[None, :] >= size - own[:, None]
                add(some, *self.with_bytes(ids[used], own))
        flat = np.concatenate(flat)
        own = counts[back]
        index = np.repeat(begin[back] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        return flat[index].astype(np.int32), own

    def with_bytes(self, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without piece become the pieces of their bytes."""
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids, own
        spelled = [self.bytes[list(chr(MARK if (p := -1 - int(i)) == LITERAL_MARK else p).encode("utf-8", "surrogatepass"))] for i in ids[lone]]
        row = np.repeat(np.arange(len(own)), own)
        more = np.ones(len(ids), np.int64)
        more[lone] = [len(s) for s in spelled]
        out = np.repeat(ids, more)
        out[np.repeat(ids < 0, more)] = np.concatenate(spelled)
        return out, np.bincount(row, weights=more, minlength=len(own)).astype(np.int64)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 offsets."""
        data, offsets = utf8(column)
        out, counts = [np.zeros(0, np.int32)], np.zeros(len(offsets) - 1, np.int64)
        for lo, hi in doc_slices(offsets, 1 << 21):
            points, at = code_points(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            full = np.flatnonzero(np.diff(at))
            if not len(full):
                continue
            points = np.where(points == MARK, np.uint32(LITERAL_MARK), np.where(points == 32, np.uint32(MARK), points))
            points = np.insert(points, at[full], np.uint32(MARK))  # each text begins with a mark
            begins = at[full] + np.arange(len(full))
            pair = points[:-1].astype(U) << U(21) | points[1:].astype(U)
            cut = np.append(True, ~self.joined[(mix(pair) & U((1 << FILTER_BITS) - 1)).astype(np.int64)])  # no piece has these two side by side
            cut[begins] = True
            starts = np.flatnonzero(cut)
            ids, own = self.segments(points, starts)
            out.append(ids)
            counts[lo + full] = np.add.reduceat(own, np.searchsorted(starts, begins))
        return np.concatenate(out), np.append(0, np.cumsum(counts))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists; bytes that are no UTF-8 become replacement characters, ids out of range nothing."""
        good = (ids >= 0) & (ids < len(self.widths))
        ids = np.where(good, ids, 0)
        out = []
        for lo, hi in doc_slices(offsets, 1 << 19):
            own = ids[offsets[lo]:offsets[hi]]
            width = np.where(good[offsets[lo]:offsets[hi]], self.widths[own], 0)
            end = np.append(0, np.cumsum(width))
            index = np.repeat(self.places[own] - end[:-1], width) + np.arange(int(end[-1]))
            raw, at = self.pool[index].tobytes(), end[offsets[lo:hi + 1] - offsets[lo]].tolist()
            for i, j in zip(at, at[1:]):
                text = raw[i:j].decode("utf-8", "replace")
                out.append(text[1:] if text.startswith(" ") else text)
        return out


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", ids_out: str = "ids") -> DataFrame:
    """`docs` with the piece ids of each whole text, a list of ints; an existing column of that name is replaced.

    Null and empty texts give an empty list, an empty table an empty result. A space is a mark, a mark is put before each text, characters that no piece
    has become byte pieces (a mark in the text itself too), so `decode_pieces` gives back every text. Segments end where no piece has the two characters
    side by side, which cannot change the best path. Among paths of equal score the one found first by start, then length, is taken.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != ids_out]
    return docs.select(*kept, _encoder(docs, path)(F.col(f"`{text_col}`")).alias(ids_out))


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(Pieces(path))  # the vocabulary, whatever the input


def _encoder(docs: DataFrame, path: str):
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            ids, offsets = shared.value.encode(text)
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return F.arrow_udf(run, "array<int>", F.ArrowUDFType.SCALAR_ITER)


def decoded(docs: DataFrame, path: str, ids: Column) -> Column:
    """Text of a list of piece ids; a null list gives an empty text."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            yield pa.array(shared.value.decode(flat, np.append(0, np.cumsum(counts))), pa.string())

    return F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(ids)


def decode_pieces(docs: DataFrame, path: str, ids_col: str = "ids", text_out: str = "text") -> DataFrame:
    """`docs` with the text of each id list; an existing column of that name is replaced. Null and empty lists give an empty text."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_out]
    return docs.select(*kept, decoded(docs, path, F.col(f"`{ids_col}`")).alias(text_out))


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text", ids_out: str = "ids", text_out: str = "decoded") -> DataFrame:
    """`docs` with the piece ids of each whole text and the text read back from them; existing columns of these names are replaced.

    One Python worker a task encodes and decodes a slice of about a megabyte of texts at a time and hands it on before it takes the next, so that a task
    holds one vocabulary and one slice (or one longer text). Results are those of `encode_pieces` and `decode_pieces`, also for nulls and empty texts.
    """
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
            _, offsets = utf8(text)
            for lo, hi in doc_slices(offsets):
                ids, at = shared.value.encode(text.slice(lo, hi - lo))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.StructArray.from_arrays([lists, pa.array(shared.value.decode(ids, at), pa.string())], ["ids", "text"])
            pa.default_memory_pool().release_unused()

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (ids_out, text_out)]
    both = docs.select(F.struct(*kept, F.lit(0).alias("__")).alias("row"), F.arrow_udf(run, "struct<ids:array<int>,text:string>", F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text_col}`")).alias("coded"))
    names = [c for c in docs.columns if c not in (ids_out, text_out)]
    return both.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("coded.ids").alias(ids_out), F.col("coded.text").alias(text_out))
