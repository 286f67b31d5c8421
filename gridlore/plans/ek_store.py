"""Event tables as data: segments of rows with ordinals, written and changed as whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The ordinal of a record, and the segment it lies in.
ORDINAL, SEGMENT = "ek_record", "ek_segment"


def begin_segment(spark: SparkSession, schema: str, segment: int = 0) -> DataFrame:
    """An empty segment with declared columns (a DDL string)."""
    return spark.createDataFrame([], schema).withColumn(ORDINAL, F.lit(0).cast("long")).withColumn(SEGMENT, F.lit(segment))


def load_rows(segment: DataFrame, rows: DataFrame) -> DataFrame:
    """Bulk load: rows after those there, in the order of their first column's ordinal if they have one.

    Ordinals come from the partition and place of each row, so nothing is gathered to number them.
    """
    last = segment.agg(F.coalesce(F.max(ORDINAL) + 1, F.lit(0)).alias("__n"))
    number = rows.columns.index(ORDINAL) if ORDINAL in rows.columns else None
    new = rows if number is not None else rows.withColumn(ORDINAL, F.monotonically_increasing_id())
    which = segment.select(SEGMENT).limit(1)
    seg = which.first()[0] if which.take(1) else 0
    shifted = new.crossJoin(F.broadcast(last)).withColumn(ORDINAL, F.col(ORDINAL) + F.col("__n")).drop("__n").withColumn(SEGMENT, F.lit(seg))
    return segment.unionByName(shifted, allowMissingColumns=True)


def insert_at(segment: DataFrame, ordinal: int, row: dict) -> DataFrame:
    """One record before the given ordinal; those from it on move up by one."""
    spark = segment.sparkSession
    moved = segment.withColumn(ORDINAL, F.when(F.col(ORDINAL) >= ordinal, F.col(ORDINAL) + 1).otherwise(F.col(ORDINAL)))
    fields = [f for f in segment.schema if f.name not in (ORDINAL, SEGMENT)]
    seg = (segment.select(SEGMENT).first() or [0])[0]
    one = spark.createDataFrame([tuple(row.get(f.name) for f in fields)], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
    return moved.unionByName(one.withColumn(ORDINAL, F.lit(ordinal).cast("long")).withColumn(SEGMENT, F.lit(seg)))


def delete(segment: DataFrame, condition: Column) -> DataFrame:
    return segment.where(~F.coalesce(condition, F.lit(False)))


def update(segment: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Cells of the rows that meet a condition."""
    return segment.select(*[(F.when(condition, values[c]).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in segment.columns])


def element_count(column: str) -> Column:
    """Elements of a column entry: the size of an array, 1 for a scalar; -1 never occurs as null arrays count 0."""
    return F.coalesce(F.size(column), F.lit(0))


def summary(segment: DataFrame) -> list[tuple[str, str, bool, str]]:
    """(column, type, nulls allowed, size) of a segment."""
    return [(f.name, f.dataType.simpleString(), f.nullable, "VARIABLE" if f.dataType.typeName() == "array" else "1") for f in segment.schema if f.name not in (ORDINAL, SEGMENT)]


def publish(segments: list[DataFrame], name: str) -> None:
    """Makes a table of segments visible to the dialect."""
    from .ek import union_segments

    union_segments(*segments).createOrReplaceTempView(name)


def unload(spark: SparkSession, name: str) -> None:
    spark.catalog.dropTempView(name)


def loaded(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)
