"""A corpus pipeline: reject poor documents, keep one of near-duplicates, drop contaminated ones, mix sources, shard.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of documents.

Every stage takes any row: a null text counts as an empty one, a null source is a source, repeated rows
are rows of their own (only the near-duplicate stage makes one of them), further columns pass
through whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.llm import decontamination, mixing, near_duplicates, quality, sharding
from gridlore.llm.common import fresh, steady, stored, table

#: Bytes of the texts in one file of the mixture.
FILE_BYTES = 32 << 20


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the classifier's threshold; it learns from sf_dir's labels.

    Empty and null texts are scored like any other.  Equal texts share their fate.
    """
    net = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return quality.score(docs, net, into=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest doc_id (nulls last); documents without words stay."""
    return near_duplicates.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; documents without words stay."""
    docs = steady(docs)
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    row = fresh(docs, "row")
    gone = found.where("contaminated").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: by file, then by row in it; files hold equal numbers of rows."""
    row, spot = fresh(docs, "row"), fresh(docs, "spot")
    rows = steady(docs).withColumn(row, F.monotonically_increasing_id())
    placed = stored(mixing.mix(rows.select(row, "source"), key=row).select(row, F.col("position").alias(spot)), "positions")
    n, size = rows.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()
    files = max(1, -(-(size or 0) // FILE_BYTES))
    per = -(-max(1, n) // files)
    ordered = rows.join(placed, row).repartitionById(files, F.floor(F.col(spot) / per).cast("int")).sortWithinPartitions(spot)
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns and the shard (a column of that name is replaced); a shard's rows stay in the order of the mixture, equal texts in one shard."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A classifier and consistent sampling have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
