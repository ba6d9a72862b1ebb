"""Registered queries of the subpackage and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_position import search
from .chat import as_events, read_back, rebuild
from .common import crc
from .exact_dedup import exact_dedup
from .fill_middle import fill_in_middle, middle_text
from .language import identify_language, train_language_model
from .lm import score_texts
from .min_max import near_copies
from .mixing import mix_sources
from .neighbours import nearest_neighbours
from .ngram_join import near_duplicates
from .pieces import encode_and_decode, model_path
from .pii import KINDS, find_personal_data, train_span_model
from .toxicity import score_toxicity, train_toxicity_model

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    return exact_dedup(docs, carry=["doc_id", "text_sha256"])


@register("op5_mixing", r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
src AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS stop FROM
  (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source)),
steps AS (SELECT *, sum(source_size) OVER () AS budget,
  (sum(source_size) OVER () - (sum(stop) OVER o - stop))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE AS level, stop::DOUBLE / weight::DOUBLE AS ratio
  FROM src WINDOW o AS (ORDER BY stop::DOUBLE / weight::DOUBLE, rank ROWS UNBOUNDED PRECEDING)),
rate AS (SELECT max(level) AS level FROM steps WHERE level <= ratio),
targets AS (SELECT s.*, least(stop::DOUBLE, weight * rate.level) AS target FROM steps s, rate),
dealt AS (SELECT d.*, t.source_size, t.rank, t.weight, t.target, t.budget, sum(size) OVER (PARTITION BY t.rank ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
line AS (SELECT *, sum(size) OVER (ORDER BY time, rank, mark, n ROWS UNBOUNDED PRECEDING) AS total FROM
  (SELECT *, (n * source_size + cum)::DOUBLE / weight::DOUBLE AS time FROM dealt, (VALUES (0), (1), (2)) r(n)))
SELECT doc_id, size, source_size::BIGINT AS source_size, target, sum(CASE WHEN total <= budget THEN size ELSE 0 END)::BIGINT AS taken FROM line GROUP BY doc_id, size, source_size, target, rank, mark, cum""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))


@register("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc(F.col("doc_id")) % 3 == 1
    model = train_language_model(docs, ~held_out)
    return identify_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@register("op7_ngram_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id != b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.y AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) c ON c.x = d.doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate component."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@register("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: its number of pieces, a hash of the ids, the hash of the text read back, and whether that is the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = encode_and_decode(docs, model_path(), text_out="back")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                       F.sha2(F.encode("back", "UTF-8"), 256).alias("decoded_sha256"), (F.col("back") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@register("op10_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score; learned where crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, crc(F.col("doc_id")) % 7 != 2).withColumnRenamed("id", "doc_id")


@register("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; learned from labels where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity_model(docs, table(spark, sf_dir, "labels"), crc(F.col("doc_id")) % 4 != 2)
    scored = score_toxicity(docs.withColumn("held_out", crc(F.col("doc_id")) % 4 == 2), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op1_chat", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + length(role) - length(replace(role, chr(10), '')) AS r,
  length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(4 + r + 1 + n + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 as event logs, rebuilt, rendered and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return read_back(rebuild(as_events(rows.unionByName(more))), in_order=True)


@register("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the fixed patterns' spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, train_span_model(docs)).withColumn("fixed", F.filter("spans", lambda s: s["base"]))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("fixed", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(F.col("fixed")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@register("op3_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every vector whose id is divisible by 100."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op11_ranked_search", r"""
WITH w AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
a AS MATERIALIZED (SELECT count(*)::BIGINT AS texts, sum(n)::BIGINT AS tokens FROM d),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, a GROUP BY term, texts),
i AS MATERIALIZED (SELECT p.doc_id, p.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * texts) // tokens))) AS impact FROM p JOIN f USING (term) JOIN d USING (doc_id), a),
s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_min_max_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id != b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.y AS component_id, d.doc_id = c.y AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) c ON c.x = d.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate component and whether it stays."""
    return near_copies(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register("op13_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y, ('0x' || h[25:32])::BIGINT % 100 AS way FROM d),
c AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN way < 50 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m FROM k),
o AS (SELECT *, t[length(p) + length(m) + 1:] AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, and the text rebuilt from that."""
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(text):
        return F.sha2(F.encode(text, "UTF-8"), 256)

    return cut.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars", digest(F.col("fim_text")).alias("output_sha256"),
                      digest(middle_text(F.col("fim_text"), F.col("fim_form"))).alias("restored_sha256"))
