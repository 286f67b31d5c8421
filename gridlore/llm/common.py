"""What the training-data operators share: input tables, written intermediates, numbering.

Intermediates are Parquet tables in the folder that ``spark.checkpoint.dir`` names, so an
executor that dies takes nothing with it and a rerun task reads the same rows.  The setting
is read from the session; a folder of our own is set only where it is unset (tests).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Bytes of an Arrow batch: long texts must not pile up by thousands.
ARROW_BYTES = 8 << 20

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that they can import it, and bounds Arrow batches."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def trim() -> None:
    """Gives memory that a worker has freed back to the machine: reused workers must not keep their peaks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors would not see a folder of the driver's")
        path = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the program ends."""
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def write(df: DataFrame, name: str) -> str:
    """Writes df as Parquet into the shared folder and returns the path."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def steady(df: DataFrame, name: str = "rows") -> DataFrame:
    """df if it only scans files, else a stored copy: so its rows come in the same partitions and order each time it is read."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter") and not node.nodeName().startswith(("LogicalRelation", "Relation")):
            return stored(df, name)
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return df


def release(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Deletes a written table that no later step reads."""
    if isinstance(df_or_path, DataFrame):
        spark = df_or_path.sparkSession
        paths = {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    else:
        paths = {df_or_path}
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            release(path, spark)
        except Exception:  # the session has ended before: the cluster's own cleaning applies
            return


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    k = 0
    while f"{stem}_{k}" in taken:
        k += 1
    return f"{stem}_{k}"


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, least: int = 1000) -> DataFrame:
    """rows joined with one row per key of groups, where size says how many rows a key has.

    Keys with over total / 10000 rows are fewer than 10000 and are broadcast, so their rows stay
    where they are; the others meet by shuffle, and none of them fills a task.
    """
    heavy = F.col(size) > max(least, total // 10_000)
    large = groups.where(heavy)
    few = rows.join(F.broadcast(large), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.where(~heavy), key)
    return few.unionByName(rest)


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only.  Pure ASCII texts take lower(), which is the same there and faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def numbered(df: DataFrame, group: str, order: list[str], into: str, name: str) -> DataFrame:
    """df with a gapless number from 0 within each group, in the given order.

    A group may hold any share of the rows: rows are range-partitioned by (group, order), so a
    large group spreads over many partitions, each partition counts its own rows, and only one
    row per (partition, group) meets in a prefix sum.  Rows equal in group and order are
    numbered arbitrarily among themselves.  Nulls form a group and sort first.
    """
    at, first = "__at", "__first"
    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(at, F.monotonically_increasing_id())
    rows = stored(rows, name).withColumn("__pid", F.shiftright(at, 33)).withColumn("__g", F.struct(group))
    parts = rows.groupBy("__pid", "__g").agg(F.min(at).alias(first), F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    # at most one row per partition and one per group: small whatever the input
    return rows.join(F.broadcast(parts), ["__pid", "__g"]).withColumn(into, F.col(at) - F.col(first) + F.col("__base")).drop(at, first, "__pid", "__g", "__base")
