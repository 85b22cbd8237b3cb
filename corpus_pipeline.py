"""A corpus pipeline of five stages over ``documents``.

Quality rules, exact deduplication, n-gram Jaccard join (near duplicates), mixing of sources to
target weights, byte-level BPE. Each stage is written as Parquet and read again as the next
one's documents; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid.llm import bpe, exact_dedup, mixing, near_dedup, quality
from terragrid.llm.common import WRITTEN, release, remove, scratch, stored
from terragrid.llm.queries import MIX_WEIGHTS


def _plain(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage``'s rows with the columns of ``docs``: while it runs, columns that no stage reads have names that can't meet an operator's."""
    names = [c if c in ("doc_id", "text", "source") else f"given_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).select(names).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _plain(docs, lambda d: quality.quality_rules(d).where("kept"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    return _plain(docs, lambda d: exact_dedup.exact_dedup(d).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class that links connect: that with the least doc_id, and of those the least digest of the text.

    Rows are told apart by doc_id and digest; of rows that share both, one stays, a null doc_id counting as an
    identifier behind all others. Texts without words stay.
    """
    return _plain(docs, _near)


def _near(docs: DataFrame) -> DataFrame:
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce(F.md5("text"), F.lit("")).alias("digest"))
    named = docs.withColumn("__row", row)
    found = near_dedup.near_duplicates(named.select("__row", "text"), "__row")
    away = F.bool_or(F.col("class_id") != F.col("__row")).alias("away")
    gone = found.groupBy("__row").agg(away, F.count(F.lit(1)).alias("n"), F.max("n_copies").alias("copies")).where("away or (n > 1 and copies > 1)").select("__row", "away")
    gone = stored(gone, "near-gone")
    few = gone.count() <= near_dedup.BROADCAST_IDS
    out = named.join(F.broadcast(gone) if few else gone, "__row", "left_anti")
    same = gone.where("not away").select("__row")
    if same.limit(1).count():
        out = out.unionByName(named.join(F.broadcast(same) if few else same, "__row", "left_semi").dropDuplicates(["__row"]))
    return out


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a global shuffle."""
    return _plain(docs, lambda d: mixing.mix_sources(d, MIX_WEIGHTS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers and digests of each document of the mixture."""
    return bpe.bpe_digests(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mix_stage),
    ("byte-level BPE", bpe_stage),
]
#: Compression ratios, MinHash and BPE have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again; once they are, what the stage read and its own tables are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before = len(WRITTEN)
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch(spark, f"pipeline-{i}")
        out.write.parquet(path)
        WRITTEN.remove(path)
        release(spark, before)
        if i:
            remove(spark, docs.stored_at)
        docs = spark.read.parquet(path)
        docs.stored_at = path
