"""Connected components: of links, and of equal neighbouring cells."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors would not see a folder of the driver's")
    path = tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Links up to which a graph is labelled on the driver, as rounds would cost more than they do; larger ones take
#: distributed rounds.  Both give the same rows.
LOCAL_LINKS = 100_000


def label(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of links (a, b); a link to itself makes a node.

    Small graphs (counted first) are joined up by union-find on the driver.  Else every node takes the
    smallest label around it, then the label of that label, until nothing moves; each round is
    checkpointed.
    """
    edges = kept(links.select("a", "b").distinct())
    if edges.count() <= LOCAL_LINKS:
        return _label_locally(edges)
    both = kept(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")))
    while True:
        around = both.join(now.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("l"))
        down = around.select("a", F.col("l").alias("via")).join(now.select(F.col("a").alias("via"), "l"), "via").select("a", F.least("l", "via").alias("l"))
        new = kept(down)
        moved = new.join(now.withColumnRenamed("l", "old"), "a").where("l < old").limit(1).count()
        now = new
        if not moved:
            return now.select(F.col("a").alias("node"), F.col("l").alias("component"))


def _label_locally(edges: DataFrame) -> DataFrame:
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges.collect():  # LOCAL_LINKS at most
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    kind = edges.schema["a"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(x, root(x)) for x in list(parent)], f"node {kind}, component {kind}")


def runs(cells: DataFrame, z: str = "z") -> DataFrame:
    """Runs of equal neighbouring cells in each row: row, first, last, z."""
    line = Window.partitionBy("row").orderBy("col")
    new = (F.lag(z).over(line) != F.col(z)) | (F.lag("col").over(line) != F.col("col") - 1) | F.lag("col").over(line).isNull()
    marked = cells.where(F.col(z).isNotNull()).withColumn("__new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("__k", F.sum("__new").over(line))
    return marked.groupBy("row", "__k").agg(F.min("col").alias("first"), F.max("col").alias("last"), F.first(z).alias(z)).drop("__k")


def clump(cells: DataFrame, diagonal: bool = False, z: str = "z") -> DataFrame:
    """cells with clump: equal cells that touch by a side (or corner) share the smallest number row * 2**32 + first column of theirs.

    Works on runs, not cells: each row's runs, then links between runs of neighbouring rows.
    """
    r = kept(runs(cells, z).withColumn("id", F.shiftleft(F.col("row").cast("long"), 32) + F.col("first")))
    reach = 1 if diagonal else 0
    below = r.select((F.col("row") - 1).alias("row"), F.col(z).alias(z), F.col("first").alias("f2"), F.col("last").alias("l2"), F.col("id").alias("b"))
    touch = r.join(below, ["row", z]).where((F.col("first") <= F.col("l2") + reach) & (F.col("f2") <= F.col("last") + reach)).select(F.col("id").alias("a"), "b")
    comp = label(touch.union(r.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    named = r.join(comp.withColumnRenamed("node", "id"), "id").select("row", "first", "last", F.col("component").alias("clump"))
    spread = named.withColumn("col", F.explode(F.sequence("first", "last"))).select("row", "col", "clump")
    return cells.join(spread, ["row", "col"], "left")
