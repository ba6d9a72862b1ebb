"""Scores of language ID and toxicity computed text by text in plain Python, for batches of odd texts, repeats and ties."""
import math

import numpy as np
import pyarrow as pa
import pytest
from samples import rows, sentence

from curvekit.llm import language, toxicity

TEXTS = [r[1] for r in rows()] + ["Ä", "ß漢字", "a1b", "é" * 3000, "..,", "The-river_STONE", sentence(4, 7), sentence(4, 7)]


def grams(text: str) -> set:
    letters = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text]
    return {(n, sum(x << (21 * (n - 1 - i)) for i, x in enumerate(letters[at:at + n]))) for n in (1, 2, 3) for at in range(len(letters) - n + 1)}


def test_language_scores():
    known = [(sentence(i, 12), "x") for i in range(20)] + [("der die das über größe " * (1 + i % 3) + str(i), "y") for i in range(20)]
    model = language.LanguageModel([t for t, _ in known], [x for _, x in known], landmarks=5)
    column = {(n, int(g)): model.grams.first[n] + k for n in language.ORDERS for k, g in enumerate(model.grams.known[n])}
    # landmarks: the first five texts of each language, as sets of dictionary n-grams
    marks = [{column[g] for g in grams(t) if g in column} for t, _ in known[:5] + known[20:25]]
    assert np.array_equal(model.marks.T > 0, [[c in m for c in range(model.grams.size)] for m in marks])
    best, score = model.predict(pa.array(TEXTS, pa.large_string()))
    for text, own, said in zip(TEXTS, best, score):
        if not text or not any(c.isalpha() for c in text):
            assert (own, said) == (-1, 0)
            continue
        have = {column[g] for g in grams(text) if g in column}
        kernel = [len(have & m) / math.sqrt(max(len(have), 1) * len(m)) for m in marks]
        values = [sum(k * w for k, w in zip(kernel, model.weights[:, c])) + model.bias[c] for c in range(2)]
        assert own == int(np.argmax(values)) or abs(values[0] - values[1]) < 1e-4
        assert said == pytest.approx(min(1, max(0, (max(values) + 1) / 2)), abs=1e-4)


def test_language_ties():
    """Languages of equal value: the first by code point."""
    model = language.LanguageModel([sentence(i, 9) for i in range(12)], ["b", "a", "c"] * 4)
    model.weights[:], model.bias[:] = model.weights[:, :1], model.bias[0]
    best, _ = model.predict(pa.array(["river stone", "the light", None]))
    assert model.langs == ["a", "b", "c"] and best.tolist() == [0, 0, -1]


def test_toxicity_scores():
    docs = [(sentence(i, 15) + (" grumbaltik" if i % 3 == 0 else "")).encode() for i in range(90)]
    model = toxicity.ToxicityModel(docs, [int(i % 3 == 0) for i in range(90)])
    texts = [*TEXTS, "Grumbaltik", "river grumbaltig!"]
    got = model.score(pa.array(texts, pa.large_string()))
    for text, said in zip(texts, got):
        value = -10.0
        for word in toxicity.WORDS.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))):
            buckets = [b for good, own in toxicity.subwords(np.frombuffer(b" " + word + b" ", np.uint8)) for b in own[good]]
            value = max(value, sum(float(model.weight[b]) for b in buckets) / max(len(buckets), 1) + model.offset)
        odds = model.slope * min(30, max(-30, value)) + model.shift
        assert said == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, odds)))), abs=1e-4)
    alike = {}
    for text, said in zip(texts, got):
        assert alike.setdefault(text, said) == said
