"""One query for each operator of this subpackage, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, language_id, packing, piece_bpe, quality_rules, quote_linking, secret_scan, simhash, substring_dedup, winnowing

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    coded = piece_bpe.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = piece_bpe.decode(F.col("ids"), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (back == F.coalesce("text", F.lit(""))).alias("lossless"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    numbers = [secret_scan.number(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *numbers, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_rules.classify(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.link_quotes(_table(spark, sf_dir, "conversations"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edit_and_compare(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files are: the same on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_piece_bpe, op3_secret_scan, op4_quality_rules, op5_substring_dedup, op6_embedding_dedup, op7_quote_linking, op8_language_id, op9_winnowing, op10_packing)}


OP6_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.low AS component_id, e.vec_id = r.low AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON e.vec_id = r.a
LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) n ON e.vec_id = n.a
"""


OP7_SQL = r"""
WITH messages AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role,
         string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS raw
  FROM conversations
), lines AS (
  SELECT id, conv_id, turn, role, k, len(regexp_replace(mark, '[^>]', '', 'g')) AS level, substr(line, len(mark) + 1) AS said
  FROM (SELECT id, conv_id, turn, role, k, line, regexp_extract(line, '^(?:[ \t]*>)+[ \t]?') AS mark
        FROM (SELECT id, conv_id, turn, role, unnest(raw) AS line, unnest(range(1, len(raw) + 1)) AS k FROM messages))
), numbered AS (
  SELECT *, k - row_number() OVER (PARTITION BY id, level ORDER BY k) AS run FROM lines
), passages AS (
  SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(said), '\s+', ' ', 'g')) AS passage
  FROM (SELECT conv_id, turn, level, said FROM lines
        UNION ALL SELECT conv_id, turn, level, string_agg(said, ' ' ORDER BY k) FROM numbered GROUP BY id, conv_id, turn, level, run)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), originals AS (
  SELECT conv_id, passage, min(turn) AS source FROM passages WHERE level = 0 AND passage <> '' GROUP BY conv_id, passage
), linked AS (
  SELECT q.conv_id, q.turn, q.level, o.source FROM passages q JOIN originals o USING (conv_id, passage)
  WHERE q.level > 0 AND q.passage <> '' AND o.source < q.turn
), replies AS (
  SELECT conv_id, turn, max(source) FILTER (WHERE level = low) AS found, count(*) AS n_linked
  FROM (SELECT *, min(level) OVER (PARTITION BY conv_id, turn) AS low FROM linked) GROUP BY conv_id, turn
), own AS (
  SELECT id, conv_id, turn, role, max(level) AS quote_depth, count(*) FILTER (WHERE level > 0) AS n_quoted,
         trim(coalesce(string_agg(said, chr(10) ORDER BY k) FILTER (WHERE level = 0 AND NOT (introduces AND following > 0)), '')) AS text
  FROM (SELECT *, regexp_matches(said, '(?i)(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$') AS introduces,
               coalesce(lead(level) OVER (PARTITION BY id ORDER BY k), 0) AS following FROM lines)
  GROUP BY id, conv_id, turn, role
)
SELECT o.conv_id, o.turn, o.role, o.text, CAST(o.quote_depth AS INTEGER) AS quote_depth, o.n_quoted,
       coalesce(r.n_linked, 0) AS n_linked, coalesce(r.found, p.turn) AS reply_to,
       CASE WHEN o.conv_id IS NOT NULL THEN row_number() OVER (PARTITION BY o.conv_id ORDER BY coalesce(r.found, p.turn) NULLS FIRST, o.turn NULLS LAST, o.role NULLS FIRST, o.text NULLS FIRST) - 1 END AS position
FROM own o LEFT JOIN replies r ON o.conv_id = r.conv_id AND o.turn = r.turn
LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) p ON o.conv_id = p.conv_id AND o.turn = p.turn + 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding_dedup": OP6_SQL, "op7_quote_linking": OP7_SQL}
