"""The registered queries against their SQL, and the pipeline stage by stage."""

import re
from collections import Counter

import duckdb
import pytest
from plain_versions import brute_classes, plain_quality
from pyspark.sql import functions as F

import corpus_pipeline
from gridlore.llm import decontamination, near_duplicates, quality
from gridlore.llm.common import stored, table
from gridlore.llm.queries import ORACLES, QUERIES


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    n = table(spark, SF, "embeddings" if name.startswith("op8") else "documents").count()
    assert len(got) == n
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        assert got == sorted(con.sql(ORACLES[name]).select(*cols).fetchall(), key=repr)


def test_pipeline_decisions(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id for r in docs.collect()}
    net = quality.train(docs, table(spark, SF, "labels"))
    good = {r.doc_id for r in quality.score(docs, net).where(f"score >= {quality.THRESHOLD}").collect()}
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        steps.append({r.doc_id for r in docs.collect()})
        if name != "sharding":
            assert docs.columns == columns
        if name == "near_duplicates":
            found = near_duplicates.near_duplicates(docs)
            assert found.where("not kept").count() == 0
        if name == "decontamination":
            assert decontamination.contamination(docs, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert steps[0] == good <= before and steps[1] <= steps[0] and steps[2] <= steps[1] and steps[3] == steps[2] == steps[4]
    assert "shard" in docs.columns


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_pipeline_stages_take_edges(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names, through every stage."""
    long = " ".join(f"word{k}" for k in range(30000))
    rows = [(0, "", "en", "a", 0), (1, None, None, None, None), (2, "One.", "en", "a", 4), (3, "One.", "en", "a", 4), (3, "One.", "en", "a", 4), (None, "no key at all", "en", "b", 6), (5, long, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("position", "row", "__row", "row_0", "spot_0", "score", "__score", "score_0", "size", "group", "key", "block", "slot", "node", "text2", "class_id", "kept"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce("text", F.lit("-")).substr(1, 3)))
    docs = stored(docs, "edge")
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        got = [r.asDict() for r in out.collect()]
        if name in ("mixing", "decontamination", "sharding"):  # all rows pass
            assert len(got) == len(rows)
        if name == "near_duplicates":  # the three equal texts are one, the texts without words stay
            assert len(got) == len(rows) - 2 and {r["doc_id"] for r in got} == {0, 1, 2, None, 5}
        if name == "quality":
            assert all(g in [r.asDict() for r in docs.collect()] for g in got)
        assert out.columns == docs.columns + ["shard"] * (name == "sharding")
        assert all(r["position"] == "position" + ("-" if r["text"] is None else r["text"])[:3] for r in got)


def plain_pipeline(spark):
    """The pipeline's rows by plain loops; the classifier's net is the operator's, its scores are of single texts."""
    rows = table(spark, SF, "documents").collect()
    net = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = [r for r in rows if plain_quality(net, (r.text or "").encode()) >= quality.THRESHOLD]
    classes = brute_classes([r.text for r in rows])
    least = {}
    for r, c in zip(rows, classes):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    rows = [r for r, c in zip(rows, classes) if least[c] == r.doc_id]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    windows = set()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for _, t in items:
        w = split(t)
        windows |= {tuple(w[a : a + 10]) for a in range(max(0, len(w) - 10) + 1)} if w else set()
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))
    return [r for r in rows if clean(split(r.text))]


def test_pipeline_equals_plain_loops(spark):
    want = plain_pipeline(spark)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in want)
    load, where = Counter(), {}
    for r in got:
        load[r.shard] += len((r.text or "").encode()) + 8
        assert where.setdefault(r.text, r.shard) == r.shard
    # largest first to the least loaded: no load is over the least by more than its last, smallest job
    jobs = Counter()
    for r in want:
        jobs[r.text] += len((r.text or "").encode()) + 8
    assert sum(load.values()) == sum(jobs.values()) and max(load.values()) <= max(max(jobs.values()), sum(jobs.values()) / 24 * 4 / 3)
