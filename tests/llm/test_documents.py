"""Operators on documents against brute force on few rows, and on the edges: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import rows, sentence

from curvekit.llm import exact_dedup as dedup
from curvekit.llm import language, lm, mixing, ngram_join, pieces, pii, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# exact dedup -----------------------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("moduli", [dedup.MODULI, (7,)])  # the small one makes unequal texts collide
def test_exact_dedup(docs, moduli):
    got = dedup.exact_dedup(docs, moduli=moduli).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(rows())
    for r in got:
        ids = groups[r["text"] or ""]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
    assert Counter(r["text"] or "" for r in got if r["kept"]) == Counter(groups.keys())
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_hot_text(spark):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").when(F.col("id") % 3 == 1, "other").otherwise(F.col("id").cast("string")).alias("text"))
    for moduli in (dedup.MODULI, (3,)):
        got = dedup.exact_dedup(table, moduli=moduli)
        assert got.filter("text = 'same'").select("keep_id", "group_size").distinct().collect() == [(2997, 1000)]
        assert got.filter("text = 'other'").select("keep_id", "group_size").distinct().collect() == [(2998, 1000)]
        assert got.filter("kept").count() == 1002


def test_polynomial_combines():
    model = dedup.Polynomial()
    a, b = b"some text" * 70, "é wide".encode() * 99
    h = [[int(x) for x in row] for row in model.keys(pa.array([a.decode(), b.decode(), (a + b).decode(), ""]))]
    assert model.combine(h[0], h[1], len(b)) == h[2] and h[3] == [0] * 4
    assert h[0] == [sum(c * pow(base, len(a) - 1 - i, m) for i, c in enumerate(a)) % m for base, m in zip(model.bases, model.moduli)]


# mixing ----------------------------------------------------------------------------------------------------------------------------------------------
def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        for s in over:
            fixed[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(fixed.values())


def test_mixing(spark):
    table = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, "big").when(F.col("id") < 880, "mid").when(F.col("id") < 890, "tiny").alias("source"),
                                    F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"))
    got = mixing.mix_sources(table)
    again = {r["id"]: r["copies"] for r in mixing.mix_sources(table.repartition(5)).collect()}
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got.collect():
        assert r["size"] == r["id"] % 17 and r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 and again[r["id"]] == r["copies"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 17
    assert sum(taken.values()) <= sum(sizes.values())
    assert mixing.repeat_documents(table, got).count() == sum(again.values())


def test_mixing_edges(docs, nothing):
    got = mixing.mix_sources(docs)
    assert got.count() == len(rows()) and got.filter("size = 0 AND (taken != 0 OR copies > 1)").count() == 0
    assert mixing.repeat_documents(docs, got).count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.repeat_documents(docs, got).columns == docs.columns
    empty = mixing.mix_sources(nothing)
    assert empty.count() == 0 and mixing.repeat_documents(nothing, empty).count() == 0


# n-gram Jaccard join ---------------------------------------------------------------------------------------------------------------------------------
def shingle_set(text: str | None) -> set:
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(table: list[tuple]) -> dict:
    sets = [shingle_set(t) for _, t in table]
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(table):
        least.setdefault(find(i), []).append(d)
    return Counter((table[i][0], len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i in range(len(table)))


def test_near_duplicates_edges(docs, nothing):
    got = ngram_join.near_duplicates(docs).collect()
    want = brute_components([(r[0], r[1]) for r in rows()])
    empty = Counter({k: n for k, n in want.items() if k[1] == 0})
    assert Counter(tuple(r) for r in got if r["n_shingles"]) == want - empty
    assert all(r["component_id"] == r["id"] for r in got if not r["n_shingles"]) and len(got) == len(rows())
    assert ngram_join.near_duplicates(nothing).count() == 0
    kept = ngram_join.keep_one(docs)
    full = [r for r in kept.collect() if shingle_set(r["text"])]
    assert kept.columns == docs.columns and len(full) == len({k[2] for k in want if k[1]})
    assert ngram_join.keep_one(nothing).count() == 0


def test_near_duplicates_families(spark):
    """Chains and families of edited copies around the threshold, with a passage that all texts share."""
    passage, table = sentence(99, 55), []
    for f in range(12):
        words = sentence(1000 + f, 30 + 9 * f).split()
        for k in range(14):
            own = list(words)
            for j in range(k if f % 2 else k // 2):
                own[(j * 13 + k) % len(own)] = f"edit{f}-{k}-{j}"
            table.append((len(table), " ".join(own) + (" " + passage if f % 3 == 0 else "")))
    got = ngram_join.near_duplicates(spark.createDataFrame(table, "doc_id int, text string")).collect()
    assert Counter(tuple(r) for r in got) == brute_components(table)


def test_signatures_bound_the_distance():
    rng = np.random.default_rng(5)
    for n in (1, 30, 700):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)]))
        x, y = (np.frombuffer(ngram_join.signature(s), np.uint64) for s in (a, b))
        low = min(len(x), len(y))
        assert np.bitwise_count(ngram_join.folded(x, low) ^ ngram_join.folded(y, low)).sum() <= len(np.setxor1d(a, b))


# SentencePiece ---------------------------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.model_path())


def test_best_paths(vocabulary):
    """Scores against a search over all pieces of each text in turn."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    normal = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    low = min(normal.values()) - 10
    texts = ["hello world", "  two  spaces ", "tab\tand\nline", "naïve 𝔘nicode ▁ mark", "aaaa" * 60, "thing tionand ingstre über", "x"]
    ids, at = vocabulary.encode(pa.array(texts))
    for k, text in enumerate(texts):
        marked = "▁" + "".join("\U0010FFFF" if c == "▁" else "▁" if c == " " else c for c in text)
        best = [0.0] + [-math.inf] * len(marked)
        for i in range(len(marked)):
            for j in range(i + 1, min(len(marked), i + 16) + 1):
                best[j] = max(best[j], best[i] + normal.get(marked[i:j], low if j == i + 1 else -math.inf))
        own, score = ids[at[k]:at[k + 1]].tolist(), 0.0
        lone = sum(c not in normal for c in marked)
        score = sum(model.get_score(i) for i in own if not model.is_byte(i)) + low * lone
        assert score == pytest.approx(best[-1])
    assert vocabulary.decode(ids, at) == texts


def test_pieces_edges(docs, nothing):
    path = pieces.model_path()
    coded = pieces.encode_pieces(docs.withColumn("ids", F.lit("clash")), path)
    back = pieces.decode_pieces(coded.withColumn("was", F.coalesce("text", F.lit(""))), path).collect()
    assert len(back) == len(rows()) and all(r["text"] == r["was"] for r in back)
    assert all(r["ids"] == [] for r in back if not r["was"])
    once = pieces.encode_and_decode(docs.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)), path).collect()
    apart = pieces.encode_pieces(docs, path).collect()
    assert Counter((r["doc_id"], r["text"], tuple(r["ids"]), r["decoded"]) for r in once) == Counter((r["doc_id"], r["text"], tuple(r["ids"]), r["text"] or "") for r in apart)
    assert pieces.encode_and_decode(nothing, path).count() == 0
    assert pieces.encode_pieces(nothing, path).count() == 0 and pieces.decode_pieces(pieces.encode_pieces(nothing, path), path).count() == 0


# language model --------------------------------------------------------------------------------------------------------------------------------------
def test_language_model(spark, nothing):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    table = [(i, sentence(i, 30 + i)) for i in range(120)] + [(200, None), (201, ""), (202, "Unseen WORDS only"), (None, "the The"), (203, "</s> \n"), (203, "</s> \n")]
    got = lm.score_texts(spark.createDataFrame(table, "doc_id bigint, text string"), F.col("doc_id") % 4 != 1)
    tokens = [(d, WORD.findall((t or "").translate(low)) + [None]) for d, t in table]
    counts = Counter(w for d, ws in tokens if d is not None and d % 4 != 1 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = Counter((d, d is None or d % 4 == 1, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 6)) for d, ws in tokens)
    found = got.collect()
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] < 0 for r in found)
    assert lm.score_texts(nothing, F.lit(True)).count() == 0
    none = lm.score_texts(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), F.lit(False)).first()
    assert none["base_score"] == 0 and none["n_known"] == 0


def test_language_model_classes_sum_to_one():
    model = lm.WordModel(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(lm.CLASSES), np.ones(lm.CLASSES), np.zeros(0, np.uint64))
    model.weights = np.random.default_rng(1).normal(0, 1, model.weights.shape).astype(np.float32)
    tokens, at = lm.keys(np.frombuffer(b"one two three", np.uint8), np.array([0, 13]))
    assert len(tokens) == 4 and np.allclose(np.exp(model.logs(lm.contexts(tokens, at))).sum(axis=1), 1, atol=1e-5)


def test_language_model_context_weights(spark):
    """Scores against weights of all contexts kept in one dictionary, and three rounds of them."""
    table = [(i, sentence(i, 20 + i % 9)) for i in range(60)] + [(90, None), (91, "the"), (92, "never Seen before")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    train = F.col("doc_id") % 4 != 1
    model, counts, total, distinct = lm.word_model(docs.filter(train).select("text"))
    tokens = {d: lm.keys(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])) for d, t in table}
    events = {d: list(zip(zip(*(x.tolist() for x in lm.contexts(*own))), lm.classes_of(own[0], model.singles).tolist())) for d, own in tokens.items()}
    weights, others, share = defaultdict(dict), Counter(), np.exp(model.bias.astype(float))
    seen = Counter((c, k) for d, own in events.items() if d % 4 != 1 for cs, k in own for c in cs)

    def chances(cs):
        value = model.bias.astype(float).copy()
        for c in cs:
            for k in range(lm.CLASSES):
                value[k] += weights[c].get(k, others[c])
        return np.exp(value) / np.exp(value).sum()

    for n in range(3):
        expected = Counter()
        for cs, k in (e for d, own in events.items() if d % 4 != 1 for e in own):
            chance = chances(cs) if n else share
            for c in cs:
                for k in range(lm.CLASSES):
                    expected[c, k] += chance[k]
        left = Counter()
        for (c, k), e in expected.items():
            left[c] += 0 if seen[c, k] else e
        for c, e in left.items():
            others[c] -= (4 if n else 2) / lm.FEATURES * e / (e + lm.PRIOR)
        for (c, k), s in [x for x in seen.items() if x[1]]:
            weights[c][k] = weights[c].get(k, 0) + (4 if n else 2) / lm.FEATURES * (s - expected[c, k]) / (s + expected[c, k] + lm.PRIOR)
    known = model.class_tokens + model.class_words + 1
    for r in lm.score_texts(docs, train).collect():
        want = sum(math.log10(chances(cs)[k]) - math.log10(known[k]) for cs, k in events[r["id"]])
        assert r["score"] == pytest.approx(r["base_score"] + r["n_tokens"] * math.log10(total + distinct + 1) + want, abs=1e-3)


def test_language_model_contexts_apart(spark):
    """What follows each of 32 words is told apart although their contexts agree in 13 bits, as they do in any table of 8,192 rows once there are enough."""
    first = lm.keys(*(np.frombuffer("".join(f"n{i}" + " " for i in range(400000)).encode(), np.uint8), np.array([0, sum(len(f"n{i}") + 1 for i in range(400000))])))[0]
    alike = np.flatnonzero((lm.mix(first[:-1] + np.uint64(0x11)) & np.uint64(8191)) == 77)[:32].tolist()
    assert len(alike) == 32
    rng = np.random.default_rng(5)
    texts = [" ".join(f"f{rng.integers(5000)} n{alike[x]} {'yes' if x % 2 else 'no'}" for x in rng.integers(0, 32, 60).tolist()) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = lm.score_texts(docs, F.col("doc_id") % 10 != 1).filter("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert (got["score"] - got["base"]) / got["n"] > 0.44


def test_language_model_pieces():
    rng = np.random.default_rng(3)
    docs = [(7, 5), (8, lm.PIECE * 2 + 9), (9, 1), (11, lm.PIECE - 3), (12, 40)]
    docs = [(row, rng.integers(0, 1 << 63, n).astype(np.uint64)) for row, n in docs]
    batches = [pa.RecordBatch.from_arrays([pa.array([r for r, _ in part]), pa.array([t.tobytes() for _, t in part])], ["row", "tokens"]) for part in (docs[:2], docs[2:])]
    names, rows_, active = set(), [], [[] for _ in range(lm.FEATURES)]
    for cut, found, place, row, lead in lm.pieces(iter(batches)):
        assert len(found) - lead <= lm.PIECE and (row[lead], cut) not in names
        names.add((row[lead], cut))
        rows_.append(row[lead:])
        for out, x in zip(active, lm.contexts_of(found, place)):
            out.append(x[lead:])
    assert np.array_equal(np.concatenate(rows_), np.repeat([r for r, _ in docs], [len(t) for _, t in docs]))
    want = lm.contexts(np.concatenate([t for _, t in docs]), np.append(0, np.cumsum([len(t) for _, t in docs])))
    assert all(np.array_equal(np.concatenate(a), b) for a, b in zip(active, want))


# language ID -----------------------------------------------------------------------------------------------------------------------------------------
def test_language(spark, docs, nothing):
    known = [(i, ("der die das und nicht schlecht machen " if i % 2 else "le la les pour quelle maison entre ") * (3 + i % 5), "de" if i % 2 else "fr") for i in range(60)]
    model = language.train_language_model(spark.createDataFrame(known, "doc_id bigint, text string, lang string"), F.col("doc_id") < 40)
    asked = [(1, "nicht schlecht und"), (2, "POUR LA MAISON"), (3, None), (4, ""), (5, "123 %%"), (6, "漢字"), (7, "schlecht " * 20000)]
    got = {r["doc_id"]: r for r in language.identify_language(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 7)] == ["de", "fr", "und", "und", "und", "de"] and got[6]["lang_pred"] in ("de", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["score"] == 0
    assert language.identify_language(docs, model).columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    assert language.identify_language(nothing, model).count() == 0
    none = language.train_language_model(nothing, F.lit(True))
    assert {r["lang_pred"] for r in language.identify_language(docs, none).collect()} == {"und"}


def test_language_scripts(spark):
    """Languages with letters from U+3000 on are told apart by them."""
    parts = {"zh": "我们今天去学校看书然后回家吃饭", "ja": "わたしはきょうがっこうへいきます", "ko": "우리는오늘학교에가서책을읽는다"}
    known = [(i, text[i % 5:] + " " + text[: 9 + i % 4], lang) for i in range(40) for lang, text in parts.items()]
    model = language.train_language_model(spark.createDataFrame(known, "doc_id bigint, text string, lang string"), F.lit(True))
    asked = spark.createDataFrame([(i, text[2:12]) for i, text in enumerate(parts.values())], "doc_id bigint, text string")
    assert [r["lang_pred"] for r in language.identify_language(asked, model).orderBy("doc_id").collect()] == list(parts)


# toxicity --------------------------------------------------------------------------------------------------------------------------------------------
def test_toxicity(spark, docs, nothing):
    def text(i):
        return sentence(i, 40) + (f" grumbaltik{'aeiou'[i % 5]}{i % 7} " + sentence(i + 500, 10) if i % 4 == 0 else "")

    table = spark.createDataFrame([(i, text(i)) for i in range(240)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity_model(table, labels, F.col("doc_id") < 180)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(180, 240))
    unseen = toxicity.score_toxicity(spark.createDataFrame([(1, "GRUMBALTIKish, yes"), (2, None), (3, ""), (4, "river stone " * 20000)], "doc_id bigint, text string"), model)
    unseen = {r["doc_id"]: r["score"] for r in unseen.collect()}
    assert unseen[1] >= 0.3 > max(unseen[2], unseen[3], unseen[4])
    assert toxicity.score_toxicity(docs, model).count() == len(rows()) and toxicity.score_toxicity(nothing, model).count() == 0
    none = toxicity.train_toxicity_model(table, labels, F.lit(False))
    assert {r["score"] for r in toxicity.score_toxicity(table, none).collect()} == {0.5}


# personal data ---------------------------------------------------------------------------------------------------------------------------------------
def brute_spans(text: str) -> list:
    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15])


def test_patterns():
    parts = [*"0123456789", *"..@@+-- ()", "1.2.3.4", "a@b.c", "x", "é", "255", "+1 (555) 123-4567", "4111111111111111", " 5105-1051-0510-5100 "]
    x = 1
    for _ in range(3000):
        text = ""
        for _ in range(25):
            x = (x * 1103515245 + 12345) % (1 << 31)
            text += parts[(x >> 8) % len(parts)]
        assert pii.base_spans(text) == brute_spans(text)
    for text in ("1" * 10**5, "a" * 10**5 + "@", "+1" + " " * 10**5, "1." * 20000, "a@" * 10**5):
        pii.base_spans(text)


def test_segmentation_is_best():
    model = pii.SpanModel([])
    rng = np.random.default_rng(2)
    model.weights = rng.normal(0, 1, model.weights.shape)
    text = "call +1 (555) 123-4567 or 4111 1111 a@b.org now 10.0.0.1 then"
    atoms = pii.Atoms([text])
    first, length, bins = atoms.spans()
    top = model.weights[bins].sum(axis=1).max(axis=1)
    best = [0.0] * (len(atoms.kind) + 1)
    for j in range(1, len(best)):
        best[j] = max([best[j - 1], *(best[a] + s for a, n, s in zip(first, length, top) if a + n == j and atoms.zone[a] == atoms.zone[j - 1])])
    value = {(atoms.start[a], atoms.end[a + n - 1]): s for a, n, s in zip(first, length, top)}
    assert sum(value[s, e] for s, _, e in model.decode([text])[0]) == pytest.approx(best[-1])


def test_personal_data(spark, docs, nothing):
    texts = [(i, f"{sentence(i, 12)} +1 (5{i % 10}5) 555-0{100 + i} {sentence(i, 5)} mail{i}@host{i}.org, 10.0.{i}.1 {sentence(i, 8)} 4111111111111111 end") for i in range(60)]
    table = spark.createDataFrame([*texts, (100, None), (101, ""), (102, "no numbers"), (103, "7 " * 3000)], "doc_id bigint, text string")
    model = pii.train_span_model(table)
    for r in pii.find_personal_data(table, model).collect():
        base = [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["base"]]
        assert base == brute_spans(r["text"] or "")
        assert all(m["end"] <= b["start"] or b["end"] <= m["start"] for m in r["spans"] for b in r["spans"] if not m["base"] and b["base"])
    clash = pii.find_personal_data(docs.withColumn("spans", F.lit(1)), model)
    assert clash.count() == len(rows()) and pii.find_personal_data(nothing, model).count() == 0
    assert pii.train_span_model(nothing).decode(["+1 (555) 555-0100"]) is not None
