"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans they miss."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: Kinds in the order they are listed.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_SIGNAL = re.compile(r"[0-9@]+")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")
LONGEST = 20  # atoms of an entity
MARGIN = 24  # characters looked at on both sides of a digit or @


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: four numbers at a time from the begin of each dotted chain."""
    for chain in _DOTTED.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        at, parts = chain.start(), chain.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            own = [p.lstrip("0") for p in parts[i:i + 4]]
            end = at + sum(map(len, parts[i:i + 4])) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in own):
                yield at, end
            at = end + 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, one try for each @: its local part begins after the run of local characters or the match before."""
    before, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        before = found.end() if found else at + 1
        if found:
            yield start, before
        at = text.find("@", before)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """`start, kind, end` of all matches of the fixed patterns, sorted. Time is linear in the text whatever it holds."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(s, 1, e) for s, e in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Classes of atoms: letters, digits, space, and these characters; 11 any other, 12 the edge of a text.
CLASSES = {"+": 3, "(": 4, ")": 5, "@": 6, ".": 7, "-": 8, ":": 9, "/": 10}
EDGE = 12
#: Bins of each feature of a span.
BINS = {"atoms": LONGEST + 1, "digits": 22, "letters": 14, "at": 3, "dots": 7, "dashes": 7, "spaces": 7, "brackets": 4, "plus": 3, "other": 4,
        "groups": 10, "longest": 20, "ends": 169, "before": 13, "after": 13, "card": 2, "octets": 2, "first": 169}


class Atoms:
    """Atoms of the zones of some texts, and the features of all spans of 1 to LONGEST of them."""

    def __init__(self, texts: list[str]):
        self.doc, self.start, self.end, self.kind, self.zone, strings = [], [], [], [], [], []
        zones = 0
        for i, text in enumerate(texts):
            for lo, hi in zones_of(text):
                for m in _ATOM.finditer(text, lo, hi):
                    s = m.group()
                    c = s[0]
                    self.kind.append(0 if "A" <= c <= "Z" or "a" <= c <= "z" else 1 if "0" <= c <= "9" else 2 if c.isspace() else CLASSES.get(c, 11))
                    self.doc.append(i), self.start.append(m.start()), self.end.append(m.end()), self.zone.append(zones), strings.append(s)
                zones += 1
        self.strings, self.zones = strings, zones
        self.kind, self.zone = np.array(self.kind, np.int64), np.array(self.zone, np.int64)
        self.size = np.array([len(s) for s in strings], np.int64)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First atom, number of atoms and feature bins (n x features) of all spans that may be an entity: they begin and end with no space, within a
        zone, and hold five digits or an @."""
        n = len(self.kind)
        sums = {}
        for name, values in (("digits", self.size * (self.kind == 1)), ("letters", self.size * (self.kind == 0)), ("at", self.kind == 6), ("dots", self.kind == 7),
                             ("dashes", self.kind == 8), ("spaces", self.kind == 2), ("brackets", (self.kind == 4) | (self.kind == 5)), ("plus", self.kind == 3),
                             ("other", self.kind >= 9), ("groups", self.kind == 1)):
            sums[name] = np.append(0, np.cumsum(values.astype(np.int64)))
        first, length = [], []
        for k in range(1, min(LONGEST, n) + 1):
            i = np.arange(n - k + 1)
            j = i + k - 1
            good = (self.zone[i] == self.zone[j]) & (self.kind[i] != 2) & (self.kind[j] != 2)
            good &= (sums["at"][j + 1] > sums["at"][i]) | (sums["digits"][j + 1] - sums["digits"][i] >= 5)
            first.append(i[good]), length.append(np.full(int(good.sum()), k))
        first = np.concatenate(first) if first else np.zeros(0, np.int64)
        length = np.concatenate(length) if length else np.zeros(0, np.int64)
        last = first + length - 1
        bins = {name: np.minimum(total[last + 1] - total[first], BINS[name] - 1) for name, total in sums.items()}
        run = np.where(self.kind == 1, self.size, 0)
        longest = run[first].copy()
        for k in range(1, LONGEST):
            more = length > k
            longest[more] = np.maximum(longest[more], run[first[more] + k])
        same = np.append(self.zone[1:] == self.zone[:-1], False)
        before = np.where((first > 0) & same[first - 1], self.kind[first - 1], EDGE)
        after = np.where(same[last], self.kind[np.minimum(last + 1, n - 1)], EDGE) if n else last
        bins |= {"atoms": length, "longest": np.minimum(longest, BINS["longest"] - 1), "ends": self.kind[first] * 13 + self.kind[last], "before": before, "after": after,
                 "first": np.minimum(self.size[first], 12) * 13 + np.minimum(self.size[last], 12)}
        card, octets = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        exact = sums["digits"][last + 1] - sums["digits"][first]
        for i in np.flatnonzero((exact >= 14) & (exact <= 19) & (bins["letters"] == 0)).tolist():
            card[i] = luhn("".join(s for s in self.strings[first[i]:last[i] + 1] if s.isdecimal()))
        for i in np.flatnonzero((bins["groups"] == 4) & (bins["dots"] == 3) & (length == 7)).tolist():
            octets[i] = all(s == "." or len(s) <= 3 and int(s) <= 255 for s in self.strings[first[i]:last[i] + 1])
        bins |= {"card": card, "octets": octets}
        return first, length, np.stack([bins[name] for name in BINS], axis=1) + OFFSETS if len(first) else np.zeros((0, len(BINS)), np.int64)


OFFSETS = np.append(0, np.cumsum(list(BINS.values()))[:-1])
TOTAL = sum(BINS.values())


def zones_of(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and @ signs; all else cannot be part of an entity."""
    out: list[list[int]] = []
    for m in _SIGNAL.finditer(text):
        lo, hi = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        while lo > 0 and lo < m.start() and text[lo - 1].isalnum():
            lo += 1
        while hi < len(text) and hi > m.end() and text[hi].isalnum():
            hi -= 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


class SpanModel:
    """p(segmentation | text) proportional to exp(sum over entities of weights[features of the whole span, kind]); atoms outside entities score 0."""

    def __init__(self, texts: list[str], epochs: int = 12, rate: float = 0.5):
        self.weights = np.zeros((TOTAL, len(KINDS)))
        self.weights[OFFSETS[0]:OFFSETS[0] + BINS["atoms"]] = -1.0
        atoms = Atoms(texts)
        first, length, bins = atoms.spans()
        if len(first):
            self.fit(atoms, first, length, bins, [base_spans(t) for t in texts], epochs, rate)

    def fit(self, atoms: Atoms, first: np.ndarray, length: np.ndarray, bins: np.ndarray, base: list, epochs: int, rate: float) -> None:
        """Gradient ascent on the likelihood of the fixed patterns' spans, zone by zone, steps scaled by past gradients."""
        index = {(d, s, e): k for d, spans in enumerate(base) for s, k, e in reversed(spans)}
        gold = np.array([index.get((atoms.doc[i], atoms.start[i], atoms.end[i + n - 1]), -1) for i, n in zip(first.tolist(), length.tolist())])
        order = np.lexsort((length, first, atoms.zone[first]))
        first, length, bins, gold = first[order], length[order], bins[order], gold[order]
        edge = np.searchsorted(atoms.zone[first], np.arange(atoms.zones + 1))
        begin = np.searchsorted(atoms.zone, np.arange(atoms.zones + 1))
        past = np.full_like(self.weights, 1e-2)
        for _ in range(epochs):
            for z in range(atoms.zones):
                own = slice(edge[z], edge[z + 1])
                if edge[z] == edge[z + 1]:
                    continue
                share = self.marginals(first[own] - begin[z], length[own], self.weights[bins[own]].sum(axis=1), int(begin[z + 1] - begin[z]))
                taken, end = np.zeros_like(share), -1
                for i in np.flatnonzero(gold[own] >= 0).tolist():  # kinds may overlap: the span that begins first counts
                    a = first[own][i]
                    if a > end and not (gold[own][i + 1:][first[own][i + 1:] == a] >= 0).any():
                        taken[i, gold[own][i]], end = 1, a + length[own][i] - 1
                change = np.zeros_like(self.weights)
                np.add.at(change, bins[own].ravel(), np.repeat(taken - share, len(BINS), axis=0))
                change -= 1e-4 * self.weights
                past += change * change
                self.weights += rate * change / np.sqrt(past)

    @staticmethod
    def marginals(first: np.ndarray, length: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """Probability of each span and kind, by forward and backward sums over the atoms of a zone."""
        total = np.logaddexp.reduce(score, axis=1)
        end = first + length
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0
        by_end, by_first = np.argsort(end, kind="stable"), np.argsort(first, kind="stable")
        ends, starts = np.searchsorted(end[by_end], np.arange(n + 2)), np.searchsorted(first[by_first], np.arange(n + 2))
        for j in range(1, n + 1):
            s = by_end[ends[j]:ends[j + 1]]
            ahead[j] = np.logaddexp(ahead[j - 1], np.logaddexp.reduce(ahead[first[s]] + total[s])) if len(s) else ahead[j - 1]
        for i in range(n - 1, -1, -1):
            s = by_first[starts[i]:starts[i + 1]]
            back[i] = np.logaddexp(back[i + 1], np.logaddexp.reduce(back[end[s]] + total[s])) if len(s) else back[i + 1]
        return np.exp((ahead[first] + back[end] - ahead[n])[:, None] + score)

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """`start, kind, end` of the best segmentation of each text: boundaries and kinds are chosen together."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        atoms = Atoms(texts)
        first, length, bins = atoms.spans()
        if not len(first):
            return out
        score = self.weights[bins[:, 0]]
        for k in range(1, bins.shape[1]):
            score += self.weights[bins[:, k]]
        kind, top = score.argmax(axis=1), score.max(axis=1)
        good = np.flatnonzero(top > 0)  # a span of negative score is never better than its atoms outside
        good = good[np.argsort(first[good] + length[good], kind="stable")]
        ends = (first + length)[good].tolist()
        high: list[tuple[int, float, tuple | None]] = [(0, 0.0, None)]  # end, best value up to there, chain of spans
        for g, end in zip(good.tolist(), ends):
            a = int(first[g])
            k = len(high) - 1
            while high[k][0] > a:
                k -= 1
            value = high[k][1] + float(top[g])
            if value > high[-1][1]:
                entry = (end, value, (g, high[k][2]))
                if high[-1][0] == end:
                    high[-1] = entry
                else:
                    high.append(entry)
        chain = high[-1][2]
        while chain:
            g, chain = chain
            i, j = int(first[g]), int(first[g] + length[g] - 1)
            out[atoms.doc[i]].append((atoms.start[i], int(kind[g]), atoms.end[j]))
        return [sorted(spans) for spans in out]


def all_spans(texts: list[str], model: SpanModel) -> list[list[tuple[int, int, int, bool]]]:
    """Spans of the fixed patterns and, where they touch none of these, of the model; by start, then kind."""
    out = []
    for text, more in zip(texts, model.decode(texts)):
        base = base_spans(text)
        spans = [(s, k, e, True) for s, k, e in base]
        edges, reach = [], []
        for s, _, e in base:
            edges.append(s), reach.append(max(e, reach[-1] if reach else 0))
        at = np.searchsorted(edges, [e for _, _, e in more]) if edges else [0] * len(more)
        spans += [(s, k, e, False) for (s, k, e), i in zip(more, at) if not i or reach[i - 1] <= s]
        out.append(sorted(spans))
    return out


def train_span_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: int = 300) -> SpanModel:
    """A model of at most `texts` whole texts with a digit or an @, chosen by a hash of their id; the fixed patterns are its labels."""
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), F.lit(2)).alias("mark"), F.col(f"`{text_col}`").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    last = rows.select("mark").orderBy("mark").limit(texts).agg(F.max("mark").alias("last")).first()["last"]  # only so many texts reach the driver
    if last is None:
        return SpanModel([])
    return SpanModel([r["text"] for r in rows.filter(F.col("mark") <= last).orderBy("mark", "text").limit(texts).collect()])


def find_personal_data(docs: DataFrame, model: SpanModel, text_col: str = "text", spans_out: str = "spans") -> DataFrame:
    """`docs` with the spans of each whole text: `kind, start, end` (code points, end exclusive) and `base` (found by a fixed pattern), sorted by start,
    then kind; an existing column of that name is replaced.

    The fixed patterns' spans always stay; kinds may overlap. Null and empty texts, and texts without digits or @, have none. An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = np.array(KINDS, object)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = utf8(column)
            count = np.append(0, np.cumsum(((data >= 48) & (data <= 57)) | (data == 64), dtype=np.int64))
            some = np.flatnonzero(count[offsets[1:]] > count[offsets[:-1]])
            found: list[list] = []
            for lo in range(0, len(some), 256):
                found += all_spans([column[int(i)].as_py() for i in some[lo:lo + 256]], shared.value)
            sizes = np.zeros(len(column), np.int32)
            sizes[some] = [len(s) for s in found]
            flat = [s for spans in found for s in spans]
            s, k, e, b = zip(*flat) if flat else ((), (), (), ())
            each = pa.StructArray.from_arrays([pa.array(kinds[list(k)], pa.string()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(b, pa.bool_())], ["kind", "start", "end", "base"])
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), each)

    udf = F.arrow_udf(run, "array<struct<kind:string,start:int,end:int,base:boolean>>", F.ArrowUDFType.SCALAR_ITER)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != spans_out]
    return docs.select(*kept, udf(F.col(f"`{text_col}`")).alias(spans_out))
