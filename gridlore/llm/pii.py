"""Personal data: regular expressions propose, checksums confirm, nearby context words adjust the score.

DataFrame expressions only.  Positions come from two built-ins: the pieces that split() leaves
between matches and the matches of regexp_extract_all(); their code-point lengths add up to every
start and end.  The patterns are the contract's, put so that a Java matcher neither recurses nor
rescans a run: possessive loops, and a match may only begin where a run begins or the last match
ended (``\\G``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: Characters before a span in which context words are looked for, and the least score that counts.
NEAR, ACCEPT = 48, 0.5
#: Matches whose places are added up in one fold: a fold copies what it has, so it must not grow with a text.
FOLD = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn checksum of a string of digits."""
    n = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: (F.substring(digits, n - i + 1, F.lit(1)).cast("int")) * (F.lit(1) + F.pmod(i - 1, F.lit(2))))
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)), F.lit(10)) == 0


def mod97(code: Column) -> Column:
    """The mod-97 checksum of an account number: first four characters last, letters as 10 to 35."""
    c = F.regexp_replace(code, " ", "")
    c = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))
    value = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.ascii(F.substring(c, i, F.lit(1))))
    rest = F.aggregate(value, F.lit(0), lambda a, x: F.when(x >= 65, F.pmod(a * 100 + x - 55, F.lit(97))).otherwise(F.pmod(a * 10 + x - 48, F.lit(97))))
    return rest == 1


def _ip_ok(m: Column) -> Column:
    return m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


#: kind, what a text must hold, pattern, check, score without context, context words, score they add
KINDS: list[tuple[str, str, str, Callable[[Column], Column], float, str, float]] = [
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, "mail|contact", 0.1),
    ("ip", r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip_ok, 0.6, "ip|host|server|address", 0.3),
    ("card", "[0-9]{2}|[0-9][ -][0-9]", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", lambda m: luhn(_digits(m)), 0.8, "card|visa|credit|pay", 0.2),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _phone_ok, 0.7, "phone|tel|call|mobile|fax", 0.3),
    # added to the base kinds
    ("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", mod97, 0.7, "iban|account|bank", 0.3),
    ("secret", "[A-Za-z0-9_+/-]{20}", r"(?<![A-Za-z0-9_+/=.@-])[A-Za-z0-9_+/-]{20,}+", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 0.2, "token|secret|key|passw|bearer|auth|credential", 0.6),
    ("ssn", "[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.2, "ssn|social", 0.5),
]
BASE = ("email", "ip", "card", "phone")


def _folds(found: Column, pieces: Column) -> Column:
    """Matches in runs of FOLD: the characters of each run, and its spans counted from its own beginning."""
    n = F.size(found)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def add(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.char_length(F.element_at(pieces, i))
        value = F.element_at(found, i)
        end = start + F.char_length(value)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    runs = F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int"))
    return F.when(n > 0, F.transform(runs, lambda r: F.aggregate(F.sequence(r * FOLD + 1, F.least(r * FOLD + FOLD, n)), zero, add)))


def _spans(folds: Column) -> Column:
    """array<struct<start, end, value>> of all matches, by code points."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    starts = F.aggregate(folds, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    moved = F.zip_with(folds, starts, lambda x, o: F.transform(x["out"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["value"].alias("value"))))
    return F.coalesce(F.flatten(moved), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))


def _scored(spans: Column, entry: tuple) -> Column:
    """The confirmed spans of one kind with their scores."""
    kind, _, _, valid, score, words, more = entry

    def near(s: Column) -> Column:
        before = F.substring(F.col("__t"), F.greatest(s["start"] - NEAR + 1, F.lit(1)), F.least(s["start"], F.lit(NEAR)))
        return F.lower(before).rlike(rf"\b({words})")

    def scored(s: Column) -> Column:
        value = F.when(near(s), F.least(F.lit(1.0), F.lit(score + more))).otherwise(F.lit(score))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), value.alias("score"))

    out = F.transform(F.filter(spans, lambda s: valid(s["value"])), scored)
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= ACCEPT)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and ``pii``: array<struct<kind, start, end, value, score>>, by kind as listed, then start.

    Base kinds always stay; an added kind stays with a score of at least ACCEPT.  A null text is
    taken as empty and has none.  Spans of different kinds may overlap; repeated rows have the same spans.  A
    column named pii is replaced, all others stay; an empty table gives an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c != "pii"]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), t.alias("__t"))
    none = F.expr("cast(array() as array<string>)")
    for k, (_, holds, pattern, *_rest) in enumerate(KINDS):
        has = F.col("__t").contains(holds) if len(holds) == 1 else F.col("__t").rlike(holds)
        out = out.withColumn(f"__m{k}", F.when(has, F.regexp_extract_all(F.col("__t"), F.lit(pattern), F.lit(0))).otherwise(none))
    parts = []
    for k, kind in enumerate(KINDS):
        found = F.col(f"__m{k}")
        out = out.withColumn(f"__p{k}", F.when(F.size(found) > 0, F.split(F.col("__t"), kind[2], -1)).otherwise(none))
        out = out.withColumn(f"__f{k}", _folds(found, F.col(f"__p{k}")))
        parts.append(_scored(_spans(F.col(f"__f{k}")), kind))
    return out.withColumn("pii", F.concat(*parts)).select("__row.*", "pii")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span that find_pii reports replaced by <KIND>; overlapping spans are masked as one, by the first's kind."""
    found = find_pii(docs, text)
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.char_length(F.col(text)))))
    return found.withColumn(text, F.when(F.size("pii") > 0, masked).otherwise(F.col(text))).drop("pii")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(of(*BASE)), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
    )
