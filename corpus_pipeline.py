"""A corpus from raw documents to token ids: stages over `documents`, each written as Parquet and read again as the next one's input.

Language ID drops texts without a language, exact and near duplicates leave one document each, the mix repeats or drops documents until the sources have
their weights, and what is left is encoded.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvekit.llm.common import crc
from curvekit.llm.exact_dedup import exact_dedup
from curvekit.llm.language import identify_language, train_language_model
from curvekit.llm.mixing import mix_sources, repeat_documents
from curvekit.llm.ngram_join import keep_one
from curvekit.llm.pieces import encode_and_decode, model_path
from curvekit.runtime import shared_dir

#: Language ID, the Jaccard join and encoding have no form in SQL.
ORACLE_SQL = None

#: Texts that score lower are in none of the learned languages. Of 3,358 held-out texts with a letter at sf0.1 the lowest score was 0.332 (99 in 100: 0.560 or
#: more), so that clean texts stay, texts of a few characters too.
LEAST_SCORE = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a text or a letter (`und`) and those that score below LEAST_SCORE go. The model learns where crc32(doc_id)
    mod 3 is not 1."""
    model = train_language_model(docs, crc(F.col("doc_id")) % 3 != 1)
    said = identify_language(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return said.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id."""
    return exact_dedup(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), carry=["row"]).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest id; documents without words all stay."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times."""
    return repeat_documents(docs, mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id, lang, source, ids, n_tokens, round_trip` (whether the ids decode to the text)."""
    coded = encode_and_decode(docs, model_path())
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"), same.alias("round_trip"))


STAGES = [("language", keep_languages), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}_{name}")
            docs = spark.read.parquet(path)
    return docs
