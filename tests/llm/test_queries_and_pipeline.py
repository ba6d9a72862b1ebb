"""The pipeline's stages against brute force on few rows."""
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from samples import rows, sentence
from test_documents import brute_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark):
    base = [r[:5] for r in rows()]
    more = [(100 + i, sentence(i, 30 + i % 7), "en" if i % 3 else "fr", f"s{i % 4}", 1) for i in range(60)]
    near = [(200 + i, sentence(i, 30 + i % 7) + " tail", "en", "s1", 1) for i in range(10)]
    docs = spark.createDataFrame(base + more + near, SCHEMA)
    letters = Counter(r[1] for r in base + more + near if r[1] and re.search(r"[^\W\d_]", r[1]))
    kept = pipeline.keep_languages(spark, docs, "")
    model = pipeline.train_language_model(docs, pipeline.crc(F.col("doc_id")) % 3 != 1)
    letters -= Counter(r["text"] for r in pipeline.identify_language(docs, model).filter(F.col("score") < pipeline.LEAST_SCORE).collect())
    assert kept.columns == docs.columns and Counter(r["text"] for r in kept.collect()) == letters
    once = pipeline.drop_copies(spark, kept, "")
    assert once.columns == docs.columns and Counter(r["text"] for r in once.collect()) == Counter(letters.keys())
    single = pipeline.drop_near_copies(spark, once, "").collect()
    left = {r["doc_id"] for r in single}
    assert left == {least for _, n, least in brute_components([(r["doc_id"], r["text"]) for r in once.collect()]) if n}
    mixed = pipeline.mix(spark, spark.createDataFrame(single, SCHEMA), "")
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) <= left and max(times.values()) <= 3
    coded = pipeline.encode(spark, mixed, "").collect()
    assert len(coded) == sum(times.values()) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in coded)


def test_language_stage_rejects(spark):
    """Texts that share nothing with the learned languages go, the languages' own stay."""
    own = [(i, sentence(i, 40), "en", "s0", 1) for i in range(60)] + [(100 + i, "äöü ßäö über größe " * (1 + i), "de", "s0", 1) for i in range(40)]
    other = [(1000, "if (q0) { z[q] += 3; }", None, None, 1), (1001, "7 8 9", None, None, 1)]
    docs = spark.createDataFrame(own + other, SCHEMA)
    model = pipeline.train_language_model(docs, pipeline.crc(F.col("doc_id")) % 3 != 1)
    scores = {r["doc_id"]: r["score"] for r in pipeline.identify_language(docs, model).collect()}
    left = {r["doc_id"] for r in pipeline.keep_languages(spark, docs, "").collect()}
    assert {r[0] for r in own} <= left and 1001 not in left
    assert left == {i for i, s in scores.items() if s >= pipeline.LEAST_SCORE}


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES])
def test_empty_table(spark, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
