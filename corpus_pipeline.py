"""Raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import bpe, classifier, mixing, pii, simhash
from rollcall.llm.common import unused
from rollcall.llm.queries import mix_dimensions
from rollcall.session import saved, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more, whole rows, repeated ones too. An empty or null
    text has the score of equal sizes. Columns that clash with the score keep their values."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return classifier.score(docs, model, keep=tuple(docs.columns), score_col=score).where(F.col(score) >= 0.3).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id. Rows with a null id stay
    if their group has no id."""
    groups = simhash.near_duplicates(docs)
    first = unused(docs, "first")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component"))).select(F.col("doc_id").alias(first)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(first)), "left_semi")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away masked; n_chars follows the new text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with source, language and topic shares raked towards smoothed ones. Texts without words
    are kept, nulls of source and lang are categories, rows of one id share their fate."""
    mark = unused(docs, "mix_")
    return mixing.sample(docs, mix_dimensions(), prefix=mark).where(F.col(f"{mark}selected")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests that show the round trip: a row for each row; a null
    or empty text has no ids. Only ids and texts are read, so other columns may have any name."""
    return bpe.round_trip(docs, chunk_words=500_000, with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("PII", sanitise),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: No stage but the mixing is within reach of SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written and read again; what a stage wrote on its way is
    dropped when its result stands. Null and empty texts have no words: the classifier scores them as
    equal sizes, so they go or stay by the model; those that stay are one group of near-duplicates, of
    which one row stays, and become no tokens. Rows with one id share their fate in near-dedup and mixing
    and stay as many rows as they are; rows with a null id are a group by themselves where no id is near.
    Texts of any length are read whole. Ties: a score of exactly 0.3 stays. An empty table gives none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-")))
    return docs
