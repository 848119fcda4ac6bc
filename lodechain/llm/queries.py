"""The queries of the corpus operators, each over its whole tables, and the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodechain.llm import bpe, jaccard, media, mixing, pii, quality, secrets, tokenfile, topk, toxicity
from lodechain.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.encode(docs, decoded="decoded")
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as MPEG audio and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return media.digest_column(media.store_column(docs).drop("text")).drop("media")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for toxicity."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to flat files and read back."""
    manifest = tokenfile.write(table(spark, sf_dir, "documents"), tokenfile.new_folder(spark, "tokens"))
    return tokenfile.read(spark, manifest)


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing words in every document."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, each distinct text scanned once."""
    found, _ = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), path="doc_id")
    return secrets.digest(found, "doc_id")


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest inner products of every 50th vector with all others."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places in a stream that mixes sources by tempered weights."""
    return mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under a model of the trusted ones, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels"))


ORACLES["op10_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
