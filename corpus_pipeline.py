"""A corpus pipeline of five stages: toxicity, near duplicates, PII, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; extra columns of ``docs`` pass through. In every stage a
null text counts as empty, a null id or source is a value like others, very long texts are read whole, and an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodechain.llm import bpe, jaccard, mixing, pii, toxicity
from lodechain.llm.common import table
from lodechain.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 1/2. The classifier learns from the labelled rows of ``docs``. Equal texts
    are kept or dropped alike, repeated rows each; without usable labels nothing is dropped."""
    judged = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; of repeated rows one. Documents without
    words or id stay."""
    return jaccard.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and disclosing words generalised or removed; ``n_chars``, where there is
    such a column, is that of the new text (null stays null). Repeated rows get equal texts."""
    clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream in its order, every document once: a source that is used up drops out, so that no copies come
    back behind the near-duplicate stage. Ties of the order within a source are broken by id; repeated rows each stay."""
    return mixing.mix(docs, repeat=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each row of the stream, as packed unsigned 32-bit integers; null and empty texts have none."""
    return bpe.encode(docs.select("doc_id", "source", "text")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The learnt and the tokenising stages cannot be expressed in SQL; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
