"""Benchmark decontamination over a distributed positional inverted index, in DataFrame expressions only.

Terms are counted over all documents; of every benchmark window the two rarest terms are taken.
The index stores the postings of those terms: document row, term, position, and the neighbouring
tokens.  A posting of the term that stands at position q of an item puts that item at diagonal
``position - q``; the lists of a window's two terms, so adjusted, are intersected by
(row, item, diagonal), and the neighbouring tokens confirm the whole phrase.  Only rare terms are
stored and only their postings move, so the shuffle follows the matches, not the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import fold_ascii, steady, stored, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Test vocabularies up to so many terms are broadcast (about 100 bytes each), and so many anchors (about 400 bytes each);
#: larger ones are joined by shuffle.
BROADCAST_TERMS, BROADCAST_ANCHORS = 500_000, 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(fold_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _few(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def _small(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if _few(terms, BROADCAST_TERMS) else terms


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (a number of our own), item_id, iw: words; items without words have no windows."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("iw")).where(F.size("iw") > 0)
    return stored(rows.withColumn("item", F.monotonically_increasing_id()), "items")


def _windows(items: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """item, ws, wl: start and length; q1, q2: item positions of the rarest and next rarest term."""
    spots = items.select("item", F.posexplode("iw").alias("q", "term")).join(counts, "term", "left").select("item", "q", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = spots.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("q", "n"))).alias("spots"))
    starts = ranked.select("item", "spots", F.explode(F.sequence(F.lit(0), F.greatest(F.size("spots") - width, F.lit(0)))).alias("ws"))
    within = F.array_sort(F.transform(F.slice("spots", F.col("ws") + 1, width), lambda s: F.struct(s["n"].alias("n"), s["q"].alias("q"))))
    return starts.withColumn("r", within).select("item", "ws", F.size("r").alias("wl"), F.element_at("r", 1)["q"].alias("q1"), F.element_at("r", F.least(F.size("r"), F.lit(2)))["q"].alias("q2"))


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """term, n: how often each term occurs in all documents."""
    return docs.select(F.explode(words(F.col(text))).alias("term")).join(_small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def build_index(docs: DataFrame, terms: DataFrame, width: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings of terms, stored: row, doc_id, n_words, first (one row per document has it), term, pos, left, right.

    left holds the up to width - 1 tokens before the position, nearest first; right those after.
    A document without any term has the one row marked first, with a null term.
    """
    base = steady(docs).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    named = terms.select(F.col("term").alias("word"), F.col("term"))
    if _few(terms, BROADCAST_TERMS):
        hits = base.select("row", "doc_id", "w", F.posexplode_outer("w").alias("pos", "word")).join(F.broadcast(named), "word", "left")
    else:  # only words and their places move; each document's places then meet its words once
        spots = base.select("row", F.posexplode("w").alias("pos", "word")).join(named, "word")
        places = spots.groupBy("row").agg(F.collect_list(F.struct("pos", "term")).alias("at"))
        first = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("string").alias("term"))
        at = F.coalesce("at", F.array().cast("array<struct<pos:int,term:string>>"))
        at = F.when(F.exists(at, lambda x: x["pos"] == 0), at).otherwise(F.concat(F.array(first), at))
        hits = base.join(places, "row", "left").select("row", "doc_id", "w", F.inline(at))
    at, reach = F.col("pos"), width - 1
    rows = hits.where(F.col("term").isNotNull() | (F.coalesce(at, F.lit(0)) == 0)).select(
        "row",
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        (F.coalesce(at, F.lit(0)) == 0).alias("first"),
        "term",
        "pos",
        F.when(F.col("term").isNotNull(), F.reverse(F.slice("w", F.greatest(at - reach + 1, F.lit(1)), F.least(at, F.lit(reach))))).alias("left"),
        F.when(F.col("term").isNotNull(), F.slice("w", at + 2, reach)).alias("right"),
    )
    return stored(rows, "postings")


def _agree(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def phrase_matches(index: DataFrame, items: DataFrame, windows: DataFrame, width: int = WINDOW) -> DataFrame:
    """row, item, item_id, starts: array<struct<s, e>> of the document positions that windows of the item take."""
    reach = width - 1
    anchors = windows.select("item", F.explode(F.array_distinct(F.array("q1", "q2"))).alias("q")).distinct().join(items, "item")
    anchors = anchors.select(
        "item",
        "q",
        F.element_at("iw", F.col("q") + 1).alias("term"),
        F.reverse(F.slice("iw", F.greatest(F.col("q") - reach + 1, F.lit(1)), F.least(F.col("q"), F.lit(reach)))).alias("ileft"),
        F.slice("iw", F.col("q") + 2, reach).alias("iright"),
    )
    anchors = stored(anchors, "anchors")
    if _few(anchors, BROADCAST_ANCHORS):  # the postings stay where they are, however frequent a term is
        anchors = F.broadcast(anchors)
    met = index.where(F.col("term").isNotNull()).join(anchors, "term").select(
        "row", "item", (F.col("pos") - F.col("q")).alias("d"), F.struct("q", _agree(F.col("left"), F.col("ileft")).alias("l"), _agree(F.col("right"), F.col("iright")).alias("r")).alias("run")
    )
    lists = met.groupBy("row", "item", "d").agg(F.collect_set("run").alias("runs"))
    plans = windows.groupBy("item").agg(F.collect_list(F.struct("ws", "wl", "q1", "q2")).alias("windows")).join(items.select("item", "item_id"), "item")
    both = lambda w: F.exists("runs", lambda x: (x["q"] == w["q1"]) & (x["q"] - x["l"] <= w["ws"]) & (x["q"] + x["r"] >= w["ws"] + w["wl"] - 1)) & F.exists("runs", lambda x: x["q"] == w["q2"])
    met = lists.join(plans, "item").withColumn("w", F.filter("windows", both)).where(F.size("w") > 0)
    return met.select("row", "item", "item_id", F.transform("w", lambda w: F.struct((w["ws"] + F.col("d")).alias("s"), (w["ws"] + F.col("d") + w["wl"]).alias("e"))).alias("starts"))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, span: documents in which all terms of a short item stand within slop words, in any order.

    items: item_id and text.  span is the width of the smallest such stretch.
    """
    it = _items(items, "item_id", "text").select("item", "item_id", F.array_distinct("iw").alias("iw"))
    terms = it.select(F.explode("iw").alias("term")).distinct()
    index = build_index(docs, terms, 1, doc_id, text)
    need = it.select("item", "item_id", F.size("iw").alias("need"), F.explode("iw").alias("term"))
    spots = index.where(F.col("term").isNotNull()).join(need, "term")
    # each end looks back over the last slop words of its own document and item
    back = Window.partitionBy("row", "item").orderBy("pos").rangeBetween(-slop, 0)
    last = spots.withColumn("latest", F.collect_list(F.struct("term", "pos")).over(back))
    at = F.transform(F.array_distinct(F.transform("latest", lambda x: x["term"])), lambda t: F.array_max(F.transform(F.filter("latest", lambda x: x["term"] == t), lambda x: x["pos"])))
    full = last.withColumn("at", at).where(F.size("at") == F.col("need"))
    return full.groupBy("row", "doc_id", "item_id").agg(F.min(F.col("pos") - F.array_min("at") + 1).alias("span")).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is width consecutive words of an item, or all words of a shorter item.  Of docs only the two
    columns named are read, whatever else it has.  Null and empty texts have no words; items without words have no windows; repeated rows each give a row;
    an item_id that occurs in several rows counts once, null as the empty string.
    """
    items = _items(benchmark, item_id, item_text)
    vocabulary = stored(items.select(F.explode("iw").alias("term")).distinct(), "terms")
    counts = stored(term_counts(docs, vocabulary, text), "counts")
    windows = stored(_windows(items, counts, width), "windows")
    rare = windows.select("item", F.explode(F.array("q1", "q2")).alias("q")).join(items, "item").select(F.element_at("iw", F.col("q") + 1).alias("term")).distinct()
    index = build_index(docs, stored(rare, "rare"), width, doc_id, text)
    hits = phrase_matches(index, items, windows, width).groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("spans"), F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("ids")
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["at"], s["e"]).alias("at"), (a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["s"], a["at"]))).alias("n")), lambda a: a["n"])
    found = hits.select("row", covered.cast("long").alias("hit"), "ids")
    ids = F.coalesce("ids", F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return index.where("first").select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i + 1, i + {WINDOW}), ' ') AS g
  FROM (SELECT *, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win), grams AS (
  SELECT r, p, n, array_to_string(list_slice(w, p + 1, p + n), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n)
), occ AS (SELECT r, p, grams.n, item_id FROM grams JOIN win USING (g, n)
), hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM occ) GROUP BY r
), its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM occ GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
