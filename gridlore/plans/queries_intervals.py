"""Interval-set, as-of and session queries on events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query, table
from ..operators import intervals as I

RAW = "(SELECT user_id AS key, epoch(ts) AS l, epoch(ts) + abs(value) * 20 AS r FROM events)"
MERGED = f"(SELECT key, min(l) AS l, max(r) AS r FROM (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN l > max(r) OVER (PARTITION BY key ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {RAW})) GROUP BY key, k)"


def _raw(spark, sf):
    e = table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("key"), t.alias("l"), (t + F.abs("value") * 20).alias("r"))


def _rounded(df):
    """To thousandths as the SQL rounds: the double times 1000 is rounded, not the decimal digits."""
    return df.select(*[(F.round(F.col(c) * 1000) / 1000).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql(body):
    return body


@query("interval_merge", f"SELECT key, round(l, 3) AS l, round(r, 3) AS r FROM {MERGED}")
def interval_merge(spark, sf):
    return _rounded(I.merge(_raw(spark, sf)))


FILLED = f"(SELECT key, min(l) AS l, max(r) AS r FROM (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN l > 3600 + max(r) OVER (PARTITION BY key ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {MERGED})) GROUP BY key, k)"


@query("interval_fill", f"SELECT key, round(l, 3) AS l, round(r, 3) AS r FROM {FILLED}")
def interval_fill(spark, sf):
    return _rounded(I.fill(I.merge(_raw(spark, sf)), 3600))


@query("interval_filter", f"SELECT key, round(l, 3) AS l, round(r, 3) AS r FROM {MERGED} WHERE r - l > 600")
def interval_filter(spark, sf):
    return _rounded(I.filter_short(I.merge(_raw(spark, sf)), 600))


@query("interval_summary", f"SELECT key, count(*) AS n, round(sum(r - l), 3) AS measure, round(avg(r - l), 3) AS mean, round(stddev_pop(r - l), 3) AS std, round(min(r - l), 3) AS shortest, round(max(r - l), 3) AS longest FROM {MERGED} GROUP BY key")
def interval_summary(spark, sf):
    return _rounded(I.summary(I.merge(_raw(spark, sf))))


SHIFTED = f"(SELECT key, l + 300 AS l, r + 300 AS r FROM {MERGED})"


def _two(spark, sf):
    a = I.merge(_raw(spark, sf))
    return a, a.select("key", (F.col("l") + 300).alias("l"), (F.col("r") + 300).alias("r"))


@query("interval_intersect", f"SELECT a.key, round(greatest(a.l, b.l), 3) AS l, round(least(a.r, b.r), 3) AS r FROM {MERGED} a JOIN {SHIFTED} b ON a.key = b.key AND a.l <= b.r AND b.l <= a.r")
def interval_intersect(spark, sf):
    return _rounded(I.intersect(*_two(spark, sf)))


@query("interval_union", f"SELECT key, round(min(l), 3) AS l, round(max(r), 3) AS r FROM (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN l > max(r) OVER (PARTITION BY key ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM (SELECT * FROM {MERGED} UNION ALL SELECT * FROM {SHIFTED}))) GROUP BY key, k")
def interval_union(spark, sf):
    return _rounded(I.union(*_two(spark, sf)))


BOUNDS = "SELECT min(epoch(ts)) - 10 AS low, max(epoch(ts)) + 1e6 AS high FROM events"


def _bounds(spark, sf):
    b = table(spark, sf, "events").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("low"), F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("high")).first()
    return b["low"] - 10, b["high"] + 1e6


COMPLEMENT = "(SELECT key, f AS l, t AS r FROM (SELECT key, coalesce(lag(r) OVER (PARTITION BY key ORDER BY l), low) AS f, l AS t FROM {src}, b UNION ALL SELECT key, max(r), max(high) FROM {src}, b GROUP BY key) WHERE f < t)"


@query("interval_complement", f"WITH b AS ({BOUNDS}), m AS {MERGED} SELECT key, round(l, 3) AS l, round(r, 3) AS r FROM {COMPLEMENT.format(src='m')}")
def interval_complement(spark, sf):
    return _rounded(I.complement(I.merge(_raw(spark, sf)), *_bounds(spark, sf)))


@query("interval_difference", f"WITH b AS ({BOUNDS}), m AS {MERGED}, s AS {SHIFTED}, o AS {COMPLEMENT.format(src='s')} SELECT m.key, round(greatest(m.l, o.l), 3) AS l, round(least(m.r, o.r), 3) AS r FROM m JOIN o ON m.key = o.key AND m.l < o.r AND o.l < m.r")
def interval_difference(spark, sf):
    a, b = _two(spark, sf)
    return _rounded(I.difference(a, b, *_bounds(spark, sf)))


@query("interval_expand", f"SELECT key, round(min(l), 3) AS l, round(max(r), 3) AS r FROM (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN l > max(r) OVER (PARTITION BY key ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM (SELECT key, l - 60 AS l, r + 120 AS r FROM {MERGED}))) GROUP BY key, k")
def interval_expand(spark, sf):
    return _rounded(I.expand(I.merge(_raw(spark, sf)), 60, 120))


@query("interval_contains_join", f"SELECT o_orderkey, key, round(l, 3) AS l FROM orders JOIN {MERGED} m ON o_custkey % 50 = key % 50 AND epoch(o_orderdate) % 2592000 BETWEEN l % 2592000 AND l % 2592000 + (r - l)")
def interval_contains_join(spark, sf):
    m = I.merge(_raw(spark, sf)).select("key", "l", (F.col("l") % 2592000).alias("a"), (F.col("l") % 2592000 + F.col("r") - F.col("l")).alias("b"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) % 2592000).alias("x"))
    return I.contains_join(o, m, 3600.0, "x", "a", "b").where("o_custkey % 50 = key % 50").select("o_orderkey", "key", F.round("l", 3).alias("l"))


def _as_of(strict):
    def run(spark, sf):
        e = table(spark, sf, "events").withColumn("kind", F.col("user_id") % 7)
        left = e.where("event_id % 3 = 0").select("event_id", "kind", "ts")
        right = e.where("event_id % 3 <> 0").groupBy("kind", "ts").agg(F.max("value").alias("value"))
        return I.as_of(left, right, "kind", "ts", "value", strict).select("event_id", "value")

    return run


for _name, _op in (("asof_last_le", "<="), ("asof_last_lt", "<")):
    query(_name, f"SELECT a.event_id, arg_max(b.value, b.ts) AS value FROM (SELECT event_id, user_id % 7 AS kind, ts FROM events WHERE event_id % 3 = 0) a LEFT JOIN (SELECT user_id % 7 AS kind, ts, max(value) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2) b ON a.kind = b.kind AND b.ts {_op} a.ts GROUP BY a.event_id")(_as_of(_op == "<"))


@query("coverage_by_object", "SELECT event_type, count(*) AS n, round(min(epoch(ts)), 3) AS first, round(max(epoch(ts)), 3) AS last FROM events GROUP BY event_type")
def coverage_by_object(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min(t), 3).alias("first"), F.round(F.max(t), 3).alias("last"))


@query("set_window_arrays", f"SELECT key, round(sum(r - l), 3) AS measure, max(CASE WHEN (SELECT quantile_disc(epoch(ts), 0.5) FROM events) BETWEEN l AND r THEN 1 ELSE 0 END) = 1 AS holds FROM {MERGED} GROUP BY key")
def set_window_arrays(spark, sf):
    raw = _raw(spark, sf)
    mid = table(spark, sf, "events").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(cast(ts as timestamp)) / 1e6)")).first()[0]
    packed = raw.groupBy("key").agg(F.collect_list(F.struct("l", "r")).alias("w")).withColumn("w", I.valid(F.col("w")))
    return packed.select("key", F.round(I.measure(F.col("w")), 3).alias("measure"), I.holds_point(F.col("w"), F.lit(mid)).alias("holds"))


@query("session_gaps", "SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id")
def session_gaps(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    from ..streaming.sessions import tumbling

    return tumbling(table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
