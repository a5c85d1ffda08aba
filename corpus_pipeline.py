"""From documents to token ids: quality rules, near-duplicates, personal data, source mix, SentencePiece.

Each stage works on what the one before kept. All but the last return the columns of ``documents``. Every stage is
defined for nulls, empty texts, repeated rows and empty tables as its operator is. ``run`` writes each stage's result to
the shared folder and reads it again, as a production run does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pointweave.llm import mixing, pii, quality, sentencepiece_fst, simhash
from pointweave.llm.common import free_name
from pointweave.llm.queries import PII_KEY, model_path
from pointweave.session import ship_package, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, null ids last.

    The operator gets (no id, id, digest of the text) as the id, so rows that share an id, or have none, are told apart
    by their texts, and each group keeps exactly one row even where that row is repeated.
    """
    ship_package(spark)
    digest, key, own = (free_name(docs, n) for n in ("digest", "digest_key", "row_of_digest"))
    of_text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull(), "doc_id")
    marked = docs.withColumn(digest, of_text)
    rows = marked.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(digest).alias("digest")).alias("id"),
                         "text")
    groups = simhash.near_duplicates(rows, id="id")
    kept = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id.digest").alias(key)).distinct()
    # The join deals rows by digest, which is all that numbering repeated rows needs.
    first = F.row_number().over(Window.partitionBy(key, "doc_id").orderBy(key))
    alike = marked.join(kept, F.col(digest) == F.col(key)).withColumn(own, first)
    return alike.filter(F.col(own) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return pii.pseudonymise(docs, PII_KEY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, n_ids, round_trip`` of every document."""
    ship_package(spark)
    return sentencepiece_fst.encoded(docs, model_path(), keep=("doc_id", "lang", "source"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("personal data", personal_data),
          ("source mix", source_mix), ("token ids", token_ids)]

#: Fingerprints, keyed digests, dependent rounding and the transducer are beyond SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
