"""Times: seconds past J2000 (2000-01-01T12:00:00), calendar text, Julian dates, clock ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a clock calibration that are broadcast.
MOST_CALIBRATIONS = 10_000
#: Unix seconds of J2000; TT - TAI; leap seconds (TAI - UTC) from each UTC date.
J2000_UNIX, TT_TAI = 946728000, 32.184
LEAPS = [("1972-01-01", 10), ("1972-07-01", 11), ("1973-01-01", 12), ("1974-01-01", 13), ("1975-01-01", 14), ("1976-01-01", 15), ("1977-01-01", 16), ("1978-01-01", 17), ("1979-01-01", 18), ("1980-01-01", 19), ("1981-07-01", 20), ("1982-07-01", 21), ("1983-07-01", 22), ("1985-07-01", 23), ("1988-01-01", 24), ("1990-01-01", 25), ("1991-01-01", 26), ("1992-07-01", 27), ("1993-07-01", 28), ("1994-07-01", 29), ("1996-01-01", 30), ("1997-07-01", 31), ("1999-01-01", 32), ("2006-01-01", 33), ("2009-01-01", 34), ("2012-07-01", 35), ("2015-07-01", 36), ("2017-01-01", 37)]


def utc_seconds(ts: Column) -> Column:
    """Seconds past J2000 without leap seconds."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6 - J2000_UNIX


def leap_seconds(ts: Column) -> Column:
    out = F.lit(0)
    for day, n in LEAPS:
        out = F.when(ts >= F.lit(day).cast("timestamp"), n).otherwise(out)
    return out


def et(ts: Column) -> Column:
    """Terrestrial-time seconds past J2000 (the periodic term, under 2 ms, is left out)."""
    return utc_seconds(ts) + leap_seconds(ts) + TT_TAI


def julian_date(ts: Column) -> Column:
    return utc_seconds(ts) / 86400 + 2451545.0


def calendar(ts: Column, pattern: str = "yyyy MMM dd HH:mm:ss") -> Column:
    return F.upper(F.date_format(ts, pattern))


def day_of_year(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-"), F.lpad(F.dayofyear(ts).cast("string"), 3, "0"))


def ticks(clock: Column, fields: list[int]) -> Column:
    """Clock text (fields separated by . : - or blanks) to ticks; fields holds each field's modulus."""
    parts = F.split(clock, r"[.:\- ]+")
    out = F.lit(0).cast("long")
    for k, m in enumerate(fields):
        out = out * m + F.coalesce(F.try_element_at(parts, F.lit(k + 1)).cast("long"), F.lit(0)) if k else F.try_element_at(parts, F.lit(1)).cast("long")
    return out


def clock_text(t: Column, fields: list[int]) -> Column:
    parts, rest = [], t
    for m in reversed(fields[1:]):
        parts.append(F.pmod(rest, F.lit(m)))
        rest = F.floor(rest / m)
    return F.concat_ws(".", rest.cast("string"), *[p.cast("string") for p in reversed(parts)])


def clock_to_et(times: DataFrame, calibration: DataFrame, tick: str = "tick") -> DataFrame:
    """et of ticks by the calibration row (tick0, et0, rate) at or before each; earlier ticks have none and are left out.

    The calibration is sorted once into ranges [tick0, next tick0); a tick finds its own by binary search in one array.
    It is a reference table: at most MOST_CALIBRATIONS rows.
    """
    rows = calibration.select("tick0", "et0", "rate").limit(MOST_CALIBRATIONS + 1)
    table = rows.agg(F.array_sort(F.collect_list(F.struct("tick0", "et0", "rate"))).alias("__c"))
    if calibration.limit(MOST_CALIBRATIONS + 1).count() > MOST_CALIBRATIONS:
        from ..operators.intervals import as_of

        best = as_of(times.withColumn("__k", F.lit(0)), calibration.select(F.lit(0).alias("__k"), F.col("tick0").alias(tick), F.struct("tick0", "et0", "rate").alias("c")), "__k", tick, "c").drop("__k")
    else:
        c = F.col("__c")
        steps = F.sequence(F.lit(0), F.lit(MOST_CALIBRATIONS.bit_length()))
        middle = lambda a: F.floor((a["lo"] + a["hi"] + 1) / 2).cast("int")
        halve = lambda a, _: F.when(a["lo"] >= a["hi"], a).when(F.get(c, middle(a) - 1)["tick0"] <= F.col(tick), F.struct(middle(a).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), (middle(a) - 1).alias("hi")))
        found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(c).alias("hi")), halve, lambda a: a["lo"])
        best = times.crossJoin(F.broadcast(table)).withColumn("c", F.get(c, found - 1)).drop("__c")
    return best.where(F.col("c").isNotNull()).select(*times.columns, (F.col("c.et0") + (F.col(tick) - F.col("c.tick0")) * F.col("c.rate")).alias("et"))
