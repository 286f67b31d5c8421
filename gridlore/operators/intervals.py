"""Interval sets: ordered disjoint closed intervals, as rows (key, l, r) or as array<struct<l, r>>.

Row forms use gaps and islands, so a key's intervals are sorted once; a key may hold any number of
them.  Array forms are for small sets inside a row.  Overlaps merge, touching ends too; complement
and difference return the closure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _islands(rows: DataFrame, key: str, l: str, r: str, gap: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(l, r)
    reach = F.max(r).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.coalesce((F.col(l) > reach + gap).cast("int"), F.lit(1))).withColumn("__k", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "__k").agg(F.min(l).alias(l), F.max(r).alias(r)).drop("__k")


def merge(rows: DataFrame, key: str = "key", l: str = "l", r: str = "r") -> DataFrame:
    """Valid interval sets of any intervals; those with r < l are left out."""
    return _islands(rows.where(F.col(l) <= F.col(r)).select(key, l, r), key, l, r, F.lit(0.0))


def fill(rows: DataFrame, small: float, key: str = "key", l: str = "l", r: str = "r") -> DataFrame:
    """Merges across gaps of at most small."""
    return _islands(rows.select(key, l, r), key, l, r, F.lit(float(small)))


def filter_short(rows: DataFrame, small: float, l: str = "l", r: str = "r") -> DataFrame:
    """Drops intervals of at most small."""
    return rows.where(F.col(r) - F.col(l) > small)


def expand(rows: DataFrame, left: float, right: float, key: str = "key", l: str = "l", r: str = "r") -> DataFrame:
    """Moves left ends down and right ends up; what shrinks below nothing goes, what meets merges."""
    return merge(rows.select(key, (F.col(l) - left).alias(l), (F.col(r) + right).alias(r)), key, l, r)


def contract(rows: DataFrame, left: float, right: float, key: str = "key", l: str = "l", r: str = "r") -> DataFrame:
    return expand(rows, -left, -right, key, l, r)


def union(a: DataFrame, b: DataFrame, key: str = "key", l: str = "l", r: str = "r") -> DataFrame:
    return merge(a.select(key, l, r).union(b.select(key, l, r)), key, l, r)


def intersect(a: DataFrame, b: DataFrame, key: str = "key", l: str = "l", r: str = "r") -> DataFrame:
    """Where both sets hold.  Ends of both are swept in order, so no pair of intervals is formed that doesn't overlap."""
    open_, shut = 0, 1
    ends = lambda df, who: df.select(key, F.explode(F.array(F.struct(F.col(l).alias("x"), F.lit(open_).alias("shut")), F.struct(F.col(r).alias("x"), F.lit(shut).alias("shut")))).alias("e"), F.lit(who).alias("who")).select(key, "e.x", "e.shut", "who")
    w = Window.partitionBy(key).orderBy("x", "shut", "who").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("shut") == open_, 1).otherwise(-1)
    swept = ends(a, 0).union(ends(b, 1)).withColumn("na", F.sum(F.when(F.col("who") == 0, step).otherwise(0)).over(w)).withColumn("nb", F.sum(F.when(F.col("who") == 1, step).otherwise(0)).over(w))
    both = (F.col("na") > 0) & (F.col("nb") > 0)
    seq = Window.partitionBy(key).orderBy("x", "shut", "who")
    return swept.withColumn("to", F.lead("x").over(seq)).where(both).select(key, F.col("x").alias(l), F.col("to").alias(r))


def complement(rows: DataFrame, low: float, high: float, key: str = "key", l: str = "l", r: str = "r") -> DataFrame:
    """What [low, high] holds outside the (valid) set, closed."""
    clipped = rows.where((F.col(r) >= low) & (F.col(l) <= high)).select(key, F.greatest(F.col(l), F.lit(low)).alias(l), F.least(F.col(r), F.lit(high)).alias(r))
    w = Window.partitionBy(key).orderBy(l)
    before = clipped.select(key, F.coalesce(F.lag(r).over(w), F.lit(low)).alias("from"), F.col(l).alias("to"))
    after = clipped.groupBy(key).agg(F.max(r).alias("from")).select(key, "from", F.lit(high).alias("to"))
    untouched = rows.groupBy(key).agg(F.max(((F.col(r) >= low) & (F.col(l) <= high)).cast("int")).alias("__hit")).where("__hit = 0").select(key, F.lit(low).alias("from"), F.lit(high).alias("to"))
    return before.union(after).where("from < to").union(untouched).select(key, F.col("from").alias(l), F.col("to").alias(r))


def difference(a: DataFrame, b: DataFrame, low: float, high: float, key: str = "key", l: str = "l", r: str = "r") -> DataFrame:
    """a without b, closed, within [low, high]; keys that b lacks keep all of a.

    Points of a (l = r) stay where they lie inside of what b leaves; what a and b only touch in doesn't.
    """
    outside = complement(b, low, high, key, l, r)
    bare = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").select(key, F.lit(low).alias(l), F.lit(high).alias(r))
    # at one place what b leaves ends before ends of a count, and begins after them, so that ends in common make no points
    ends = lambda df, who, opens, shuts: df.select(key, F.explode(F.array(F.struct(F.col(l).alias("x"), F.lit(opens).alias("turn"), F.lit(1).alias("step")), F.struct(F.col(r).alias("x"), F.lit(shuts).alias("turn"), F.lit(-1).alias("step")))).alias("e"), F.lit(who).alias("who")).select(key, "e.*", "who")
    seq = Window.partitionBy(key).orderBy("x", "turn")
    count = lambda who: F.sum(F.when(F.col("who") == who, F.col("step")).otherwise(0)).over(seq.rowsBetween(Window.unboundedPreceding, 0))
    swept = ends(a, 0, 1, 2).union(ends(outside.union(bare), 1, 3, 0)).withColumn("na", count(0)).withColumn("nb", count(1)).withColumn("to", F.lead("x").over(seq))
    both = (F.col("na") > 0) & (F.col("nb") > 0)
    return swept.where(both & ((F.col("x") < F.col("to")) | (F.col("na") == 1))).select(key, F.col("x").alias(l), F.col("to").alias(r))


def summary(rows: DataFrame, key: str = "key", l: str = "l", r: str = "r") -> DataFrame:
    """n, measure, mean, std (population), shortest, longest of each key's intervals."""
    d = F.col(r) - F.col(l)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(d).alias("measure"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("shortest"), F.max(d).alias("longest"))


def extract_ends(rows: DataFrame, side: str, key: str = "key", l: str = "l", r: str = "r") -> DataFrame:
    """Left ('l') or right ('r') ends as single points."""
    e = F.col(l if side == "l" else r)
    return rows.select(key, e.alias(l), e.alias(r))


def contains_join(points: DataFrame, rows: DataFrame, width: float, x: str = "x", l: str = "l", r: str = "r") -> DataFrame:
    """Points with the intervals that hold them.  Intervals are spread over bins of width, points have one bin: an equality join."""
    bins = rows.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(l) / width), F.floor(F.col(r) / width))))
    return points.withColumn("__bin", F.floor(F.col(x) / width)).join(bins, "__bin").where(F.col(x).between(F.col(l), F.col(r))).drop("__bin")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, strict: bool = False) -> DataFrame:
    """left with the value of the last row of right at or before (strict: before) its time, by key.

    One sorted pass over both sides; of right rows at equal times the largest value counts.
    """
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(0 if strict else 1).alias("__s"), F.lit(1).alias("__mine"))
    b = right.select(key, at, F.col(value).alias("__v"), F.lit(1 if strict else 0).alias("__s"), F.lit(0).alias("__mine"))
    w = Window.partitionBy(key).orderBy(at, "__s", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__mine = 1").drop("__v", "__s", "__mine")


def segment_for(times: DataFrame, segments: DataFrame, object_: str = "object", t: str = "t", width: float | None = None) -> DataFrame:
    """The best covering segment of each time: lowest rank, then shortest span, ends last.  segments: object, l, r, rank, name.

    Segments are spread over bins of width (without one: their mean span), so a time meets the segments of its own bin
    and not all of its object.
    """
    if width is None:
        width = float(segments.agg(F.avg(F.col("r") - F.col("l"))).first()[0] or 0) or 1.0
    span = F.col("r") - F.col("l")
    edge = (F.col("r") - F.col(t) < 0.01 * span).cast("int")
    bins = segments.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("l") / width), F.floor(F.col("r") / width))))
    found = times.withColumn("__bin", F.floor(F.col(t) / width)).join(bins, [object_, "__bin"]).where(F.col(t).between(F.col("l"), F.col("r")))
    best = F.min_by(F.struct("name", "l", "r"), F.struct("rank", edge.alias("edge"), span.alias("span"), "name"))
    return found.groupBy(object_, t).agg(best.alias("s")).select(object_, t, "s.name", "s.l", "s.r")


# --- arrays of struct<l, r> in a row ---------------------------------------------------------------

_EMPTY = "cast(array() as array<struct<l:double,r:double>>)"


def valid(a: Column) -> Column:
    """A valid set of any intervals."""
    last = lambda x: F.element_at(x, -1)
    pair = lambda l, r: F.array(F.struct(l.alias("l"), r.alias("r")))
    return F.aggregate(
        F.array_sort(F.filter(a, lambda x: x["l"] <= x["r"])),
        F.expr(_EMPTY),
        lambda s, x: F.when((F.size(s) > 0) & (last(s)["r"] >= x["l"]), F.concat(F.slice(s, 1, F.size(s) - 1), pair(last(s)["l"], F.greatest(last(s)["r"], x["r"])))).otherwise(F.concat(s, pair(x["l"], x["r"]))),
    )


def insert(a: Column, l: Column, r: Column) -> Column:
    return valid(F.concat(a, F.array(F.struct(l.alias("l"), r.alias("r")))))


def holds_point(a: Column, x: Column) -> Column:
    return F.exists(a, lambda i: (i["l"] <= x) & (x <= i["r"]))


def holds_interval(a: Column, l: Column, r: Column) -> Column:
    return F.exists(a, lambda i: (i["l"] <= l) & (r <= i["r"]))


def measure(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, i: s + i["r"] - i["l"])


def relates(a: Column, op: str, b: Column) -> Column:
    """a op b for '=', '<>', '<=' (contained), '<' (contained and not equal), '>=', '>'."""
    inside = lambda x, y: F.forall(x, lambda i: holds_interval(y, i["l"], i["r"]))
    return {"=": a == b, "<>": a != b, "<=": inside(a, b), "<": inside(a, b) & (a != b), ">=": inside(b, a), ">": inside(b, a) & (a != b)}[op]
