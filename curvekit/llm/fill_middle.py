"""Fill-in-middle by a wavelet matrix over character classes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, utf8

U = np.uint64
BITS = 3  # a class is a number of so many bits
OTHER, WORD, CLAUSE, BLANK, NEWLINE, INNER = range(6)  # INNER: a byte within a character, so all others count characters
CLASS = np.full(256, WORD, np.uint8)
CLASS[:128] = [WORD if chr(i).isalnum() else CLAUSE if chr(i) in ".!?;:" else BLANK if chr(i) in " \t\r\f\v" else NEWLINE if chr(i) == "\n" else OTHER for i in range(128)]
CLASS[0x80:0xC0] = INNER
#: The classes that end a unit.
ENDS = {"line": (NEWLINE,), "clause": (CLAUSE, NEWLINE), "word": (BLANK, NEWLINE)}
MARKS = ("<P>", "<S>", "<M>")


class BitRanks:
    """A bit vector that counts the ones among its first i bits by one table look-up and one population count."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, U)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        below = (U(1) << (i & 63).astype(U)) - U(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)


class WaveletMatrix:
    """Ranks of classes in a sequence: a level for each bit of a class, zeros first, order kept."""

    def __init__(self, classes: np.ndarray):
        self.levels = []
        for bit in range(BITS - 1, -1, -1):
            one = (classes >> bit & 1).astype(bool)
            self.levels.append((bit, BitRanks(one), int(len(one) - one.sum())))
            classes = np.concatenate([classes[~one], classes[one]])

    def count(self, kinds: tuple[int, ...], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Positions in [lo, hi) of any of the classes: the ranks of each, added up."""
        total = np.zeros(len(lo), np.int64)
        for kind in kinds:
            a, b = lo, hi
            for bit, ranks, zeros in self.levels:
                x, y = ranks.ones(a), ranks.ones(b)
                a, b = (zeros + x, zeros + y) if kind >> bit & 1 else (a - x, b - y)
            total += b - a
        return total

    def after(self, kinds: tuple[int, ...], lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The end of the k-th position in [lo, hi) of any of the classes, `lo` for k = 0, `hi` where there are fewer: bisection on ranks."""
        low, high = lo.copy(), hi.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.count(kinds, lo, middle) >= k
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def cuts(column, first: np.ndarray, second: np.ndarray, kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, characters before the cut and characters between the cuts after `first % (n + 1)` and `second % (n + 1)` units."""
    data, offsets = utf8(column)
    out = np.zeros((3, len(offsets) - 1), np.int64)
    for a, b in doc_slices(offsets):
        raw = data[offsets[a]:offsets[b]]
        lo, hi = offsets[a:b] - offsets[a], offsets[a + 1:b + 1] - offsets[a]
        classes = CLASS[raw]
        matrix = WaveletMatrix(classes)
        open_end = np.zeros(b - a, bool)
        full = hi > lo
        open_end[full] = ~np.isin(classes[hi[full] - 1], kinds)
        n = matrix.count(kinds, lo, hi) + open_end
        x, y = first[a:b] % (n + 1), second[a:b] % (n + 1)
        p, q = matrix.after(kinds, lo, hi, np.minimum(x, y)), matrix.after(kinds, lo, hi, np.maximum(x, y))
        out[:, a:b] = n, p - lo - matrix.count((INNER,), lo, p), q - p - matrix.count((INNER,), p, q)
    return out[0], out[1], out[2]


def cut_udf(unit: str):
    """Column function (text, first, second) -> `n`, `prefix`, `middle`."""
    kinds = ENDS[unit]

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, first, second in batches:
            found = cuts(text, *[np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (first, second)], kinds)
            yield pa.StructArray.from_arrays([pa.array(x) for x in found], ["n", "prefix", "middle"])

    return F.arrow_udf(run, "struct<n:bigint,prefix:bigint,middle:bigint>", F.ArrowUDFType.SCALAR_ITER)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = "line") -> DataFrame:
    """`docs` with `fim_units, fim_form, prefix_chars, middle_chars, fim_text`; existing columns of these names are replaced.

    A text is cut into units, which end with a newline (`line`), also with a clause mark (`clause`), or with white space (`word`); what is left at the end
    is a unit. Numbers h1 to h4 come from the sha256 of `seed:id`. The prefix has min(h1 % (n + 1), h2 % (n + 1)) units, the middle goes on to the larger.
    `fim_form` is `plain` (the text itself, cuts null) for empty texts, texts that hold a mark, and where h3 % 100 >= percent; else `spm` if h4 % 100 <
    spm_percent (suffix first), else `psm`. `middle_text` gives the exact text back from `fim_text` and `fim_form`.

    A null text counts as empty; a null id as an empty one. Rows repeated give repeated results: a row depends on its id and text only. An empty table
    gives an empty result. Very long texts are one slice each; all is done within the row, without a shuffle.
    """
    added = ("fim_units", "fim_form", "prefix_chars", "middle_chars", "fim_text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"),
                       F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"))
    rows = rows.withColumn("hash", F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("key")), "UTF-8"), 256))
    rows = rows.withColumns({f"h{i + 1}": F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)})
    rows = rows.withColumn("cut", cut_udf(unit)("body", "h1", "h2"))
    marked = F.contains("body", F.lit(MARKS[0])) | F.contains("body", F.lit(MARKS[1])) | F.contains("body", F.lit(MARKS[2]))
    plain = (F.col("body") == "") | marked | (F.col("h3") % 100 >= percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    before, between = F.col("cut.prefix"), F.col("cut.middle")
    prefix, middle, suffix = (F.substring("body", F.lit(1), before), F.substring("body", before + 1, between),
                              F.substring("body", before + between + 1, F.length("body")))
    p, s, m = (F.lit(x) for x in MARKS)
    text = (F.when(F.col("form") == "plain", F.col("body")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
            .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    shown = F.col("form") != "plain"
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], F.col("cut.n").alias("fim_units"), F.col("form").alias("fim_form"),
                       F.when(shown, before).alias("prefix_chars"), F.when(shown, between).alias("middle_chars"), text.alias("fim_text"))


def middle_text(text: Column, form: Column) -> Column:
    """The text that was cut, from `fim_text` and `fim_form`. A cut text holds no mark of its own, so each mark stands there once."""
    part = F.split(text, "<[PSM]>", -1)
    psm, spm = (F.concat(*[F.get(part, F.lit(i)) for i in order]) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)
