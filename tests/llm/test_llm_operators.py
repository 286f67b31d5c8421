"""Each operator against a plain version, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from plain_versions import brute_classes, brute_hits, brute_passages, brute_repeats, brute_spans, plain_model, plain_quality, plain_scores
from pyspark.sql import functions as F

from gridlore.llm import decontamination, embeddings, language_model, mixing, near_duplicates, pii, quality, repeats, sharding, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(k, t, "en", (sources or ["s"] * len(texts))[k], len(t or "")) for k, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empties, a very long text, ties and repeated rows, clashing column names."""
    rows = [(0, "", "en", "a", 0), (1, None, None, None, None), (2, "One.", "en", "a", 4), (3, "One.", "en", "a", 4), (3, "One.", "en", "a", 4), (None, "no key", "en", "b", 6), (5, prose(1, 30000), "en", "b", 1), (6, "É ÿ ​ 東京 \U0001f600", "fr", "c", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "key", "size", "group", "shard", "score", "node", "pii", "position", "slot", "block", "text2"):
        df = df.withColumn(c, F.lit("x"))
    return df


# --- 1 mixing -----------------------------------------------------------------------------------------


def test_mixing_stays_within_one_block(spark):
    sources = ["a"] * 600 + ["b"] * 300 + ["c"] * 100
    df = docs_of(spark, ["t"] * 1000, sources)
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = mixing.mix(df, weights, block_rows=5).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1000)) and len({r.doc_id for r in rows}) == 1000
    done = Counter()
    for t, slot in enumerate(sorted({r.slot for r in rows})[:100]):
        done[next(r.source for r in rows if r.slot == slot)] += 1
        for s, w in weights.items():
            assert abs(done[s] - w * (t + 1)) < 1
    for r in rows:
        assert r.release <= r.slot < r.deadline


def test_mixing_edges(spark, edge):
    out = mixing.mix(edge, block_rows=2)
    assert sorted(r.position for r in out.collect()) == list(range(edge.count()))
    assert mixing.mix(edge.limit(0)).count() == 0
    assert mixing.mix(edge, {"a": 1.0}).count() == edge.count()


def test_mixing_of_very_many_sources(spark, monkeypatch):
    """More sources than a schedule takes share lanes: all rows, gapless, and shares by weight along the way."""
    monkeypatch.setattr(mixing, "MOST_SOURCES", 4)
    sources = [f"s{k % 12}" for k in range(1200)] + [None] * 100
    df = docs_of(spark, ["t"] * 1300, sources).withColumn("lane", F.lit("x")).withColumn("order", F.lit("y"))
    weights = {f"s{k}": 3.0 if k < 3 else 1.0 for k in range(12)} | {None: 1.0}
    rows = mixing.mix(df, weights, block_rows=2, extra=["lane"]).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1300)) and {r.doc_id for r in rows} == set(range(1300))
    assert all(r.source == sources[r.doc_id] and r.lane == "x" for r in rows)
    got = Counter(r.source for r in rows[:400])
    total = sum(weights.values())
    assert all(abs(got[s] - 400 * w / total) <= 8 for s, w in weights.items())
    assert mixing.mix(df, None, block_rows=2).count() == 1300


# --- 2 token files -------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files_round_trip(spark, edge, tmp_path, name):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path(name)
    rows = [r for r in edge.collect()] + [(9, "don't <|endoftext|> it's 12.5 a--b", "", "", 0)]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3)
    files = token_files.write_files(df, path, str(tmp_path / "f"))
    got = sorted(((r.doc_id is not None, r.doc_id), r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_files.read_files(spark, files).collect())
    t = Tokenizer.from_file(path)
    want, start = [], 0
    coded = sorted(((r[0] is not None, r[0] or 0), np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in rows)
    assert [g[1] for g in sorted(got, key=lambda g: g[1])] == list(np.cumsum([0] + [len(c) // 4 for _, c in coded])[:-1])
    assert sorted(g[4] for g in got) == sorted(c for _, c in coded)
    assert all(g[3] == zlib.crc32(g[4]) and g[2] * 4 == len(g[4]) for g in got)


def test_token_files_of_an_empty_table(spark, tmp_path):
    import public_tokenizers as P

    files = token_files.write_files(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json"), str(tmp_path / "f"))
    assert token_files.read_files(spark, files).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_varint_coding(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 2**32, seed * 501) >> rng.integers(0, 32, seed * 501)
    control, data = token_files.encode(v)
    assert len(control) == -(-len(v) // 4) and (token_files.decode(control, data, len(v)) == v).all()


def test_piecewise_encoding_equals_the_library(spark):
    import public_tokenizers as P

    coder = token_files.Encoder(P.path("word_bpe_49k.json"))
    assert coder.by_piece and not token_files.Encoder(P.path("byte_bpe_50k.json")).by_piece
    texts = ["", " ", "A,b;C d\n\n12 3x4", "Ünïcode façade ÀÖ öÿ!!??", "x" * 300, prose(3, 200), "tab\tend.", "日本", "it's", "a b"]
    assert coder(texts) == coder._whole(texts) == coder(texts)


def test_token_files_equal_the_library_on_a_whole_table(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in token_files.query(spark, "/root/testdata/sf0.01").collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_colliding_and_very_long_pieces_go_to_the_library(monkeypatch):
    import public_tokenizers as P

    coder = token_files.Encoder(P.path("word_bpe_49k.json"))
    texts = ["alpha beta gamma delta", "beta epsilon", "x" * 1000 + " y", "omega"]
    want = coder._whole(texts)
    assert coder(texts) == want
    monkeypatch.setattr(token_files, "mix", lambda h: h & np.uint64(3))  # hashes that collide
    other = token_files.Encoder(P.path("word_bpe_49k.json"))
    other.by_piece = True
    assert other(texts[:2] + texts[3:]) == want[:2] + want[3:]


# --- 3 quality -------------------------------------------------------------------------------------------


def test_quality_learns_and_scores_whole_texts(spark, edge):
    good = [prose(k, 80) for k in range(60)]
    bad = [prose(k, 80).upper().replace(" ", "!! $$$ ") for k in range(60)]
    df = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id long, quality int")
    net = quality.train(df, labels)
    out = quality.score(df, net).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [(r.score, r.doc_id < 60) for r in out if r.held]
    assert held and all((s >= 0.5) == y for s, y in held)
    # junk after a long clean start is seen
    tail = prose(7, 4000) + " " + bad[0] * 40
    clean, spoiled = (quality.probabilities(net, [t.encode()])[0] for t in (prose(7, 4000), tail))
    assert spoiled < clean
    scores = [r.score for r in quality.score(edge, net).collect()]
    assert len(scores) == edge.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score(edge.limit(0), net).count() == 0


def test_quality_slices_of_a_long_text_agree():
    net = quality.fit([b"abc def" * 20, b"!!!$$$" * 20], np.array([1.0, 0.0]), np.ones(2), steps=5)
    raw, _ = quality.lay_out([prose(2, 3000).encode()])
    assert np.allclose(quality.tile_peaks(net, raw, 1 << 12), quality.tile_peaks(net, raw), atol=1e-5)


def test_quality_equals_a_plain_loop_in_any_order(spark):
    """A whole table: each score is a function of its text, to 1e-9, wherever the row stands."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    net = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    one = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    other = {r.doc_id: r.score for r in quality.score(docs.orderBy(F.md5("text")).repartition(3), net).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(one) == len(texts) == docs.count()
    for k, t in texts.items():
        assert one[k] == pytest.approx(plain_quality(net, t), abs=1e-9) and one[k] == pytest.approx(other[k], abs=1e-9)
    assert len({round(quality.probabilities(net, [b"x y z" * 6, after])[0], 12) for after in (b"", b"!!!!123", b"\xc3\xa9" * 90)}) == 1


def test_quality_sample_is_whole_texts_within_its_bounds(spark):
    texts = [prose(k, 2000) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got, y, _ = quality.sample(docs_of(spark, texts), labels)
    assert set(map(bytes.decode, got)) == {t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5}
    size = max(map(len, texts))
    got, y, weights = quality.sample(docs_of(spark, texts), labels, sample_bytes=size * 8)
    assert 6 <= len(got) <= 8 and set(map(bytes.decode, got)) <= set(texts) and len(quality.sample(docs_of(spark, texts), labels, per_class=3)[0]) == 6


def test_quality_without_labels_keeps_all(spark, edge):
    net = quality.train(edge, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.score >= quality.THRESHOLD for r in quality.score(edge, net).collect())


# --- 4 sharding ------------------------------------------------------------------------------------------


def test_shards_are_even_and_keep_groups(spark):
    texts = [prose(k % 700, 5 + k % 60) for k in range(2000)] + ["copy"] * 900
    out = sharding.shard_plan(docs_of(spark, texts), 8).collect()
    load, slots, group = Counter(), {}, {}
    for r in out:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert group.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 2000


def test_lpt_is_the_textbook_schedule():
    assert sharding.lpt({"a": 7, "b": 5, "c": 4, "d": 3, "e": 3}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_sharding_edges(spark, edge, tmp_path):
    out = sharding.shard_plan(edge, 4).collect()
    assert len(out) == edge.count() and {r.size for r in out if r.doc_id in (0, 1)} == {8}
    assert sharding.shard_plan(edge.limit(0), 4).count() == 0
    full = sharding.shard_documents(edge, 4)
    assert full.count() == edge.count() and "row" in full.columns
    sharding.write_shards(edge, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == edge.count()


# --- 5 decontamination -----------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [0, 100_000])
def test_contamination_equals_brute_force(spark, monkeypatch, most):
    for name in ("BROADCAST_TERMS", "BROADCAST_ANCHORS"):
        monkeypatch.setattr(decontamination, name, most)
    items = [(1, "The quick brown fox JUMPS over the lazy dog and then it sleeps all day"), (12, "short one here"), (3, None), (4, ""), (5, "the the the the the the the the the the the"), (6, "Été à la plage: un deux trois quatre cinq six sept huit")]
    texts = [None, "", "short One; here", "the " * 15, items[0][1].upper(), "xx " + items[0][1][:48] + " yy", items[0][1] + " mid " + items[0][1], items[5][1] + " short one here " * 3, prose(4, 50) + " it sleeps all day", "short one", items[5][1].upper(), "short one here"]
    df = docs_of(spark, texts)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(df, b).collect()}
    assert [got[k] for k in range(len(texts))] == brute_hits(texts, items)


def test_contamination_edges(spark, edge):
    b = spark.createDataFrame([(1, "One")], "item_id long, text string").withColumn("row", F.lit(1))
    out = decontamination.contamination(edge, b).collect()
    assert len(out) == edge.count() and sum(r.contaminated for r in out) == 3
    assert decontamination.contamination(edge.limit(0), b).count() == 0
    none = decontamination.contamination(edge, b.limit(0)).collect()
    assert len(none) == edge.count() and not any(r.contaminated for r in none)


def test_proximity(spark):
    df = docs_of(spark, ["red x x green", "green red", "red " + "x " * 50 + "green", "red only"])
    got = {(r.doc_id, r.span) for r in decontamination.proximity_matches(df, spark.createDataFrame([(1, "red green")], "item_id long, text string"), 10).collect()}
    assert got == {(0, 4), (1, 2)}


# --- 6 repeats --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("group", [1, 2000])
def test_repeats_equal_brute_force(spark, group):
    passage, other = prose(11, 40), prose(12, 60)
    texts = [None, "", "short", passage, passage, passage[:-3] + "!", "lead " + passage + " tail " + prose(13, 30), other + passage[:150], prose(14, 20) + other[30:] + " x", "ab" * 700, "ab" * 700 + "c", "é" * 300, prose(15, 90)] + [prose(16, 70)[:300] + str(k) * 4 + prose(16, 70)[300:] for k in range(9)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs_of(spark, texts), length=100, group=group).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts, 100)


def test_shared_passages_equal_brute_force(spark, monkeypatch):
    passage, other, twice = prose(31, 55), prose(32, 20), prose(33, 24)
    texts = [None, "", passage, "x " + passage.upper().replace(" ", ",  ") + "! " + prose(34, 30), passage + " " + passage, prose(35, 10) + " " + other + " y", other + "z " + prose(36, 40), twice + " - " + twice, other, prose(37, 300), prose(37, 300)[:900], "a " * 200, "a " * 23]
    texts += [prose(38, 70) + f" q{k} " + prose(39, 40) for k in range(5)]
    for piece in (repeats.PIECE, 64):
        monkeypatch.setattr(repeats, "PIECE", piece)  # also where every text is long
        for length, gram in ((20, 6), (50, 14)):
            df = docs_of(spark, texts).withColumn("row", F.col("doc_id"))
            got = {r.row: [tuple(x) for x in r.spans] for r in repeats.shared_passages(df, length=length, kgram=gram).collect()}
            assert got == brute_passages(texts, length)


def test_repeats_in_pieces_of_a_long_text(spark, monkeypatch):
    text = prose(21, 300000)
    text += " " + text[1000:2500]
    assert len(text) > repeats.PIECE
    got = repeats.remove_repeats(docs_of(spark, [text, "x"])).where("doc_id = 0").first()
    assert got.n_removed == 2 * 1500 or got.n_removed >= 3000
    assert got.n_spans == 2


def test_repeats_edges(spark, edge):
    assert repeats.remove_repeats(edge).count() == edge.count()
    assert repeats.remove_repeats(edge.limit(0)).count() == 0


# --- 7 personal data -----------------------------------------------------------------------------------------


def test_base_spans_equal_the_plain_patterns(spark, edge):
    r = random.Random(5)
    bits = ["a.b+c@d-e.co.uk", "x@y", "p@q.r_s@t.u", "@", "1.2.3.4", "256.1.1.1", "01.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "1--2 3", "+1 (555) 123-4567", "+12", "+49 30 1234567890123456", "é東\U0001f600", "....", "12 34", "9" * 5, " ", "\n", "-", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", ",", "."]) for _ in range(r.randint(1, 14))) for _ in range(400)] + [None, "", "7" * 50000, "a" * 50000, "1." * 20000, "+" + "(" * 5000, "x@" + "a." * 20000 + "b"]
    rows = pii.find_pii(docs_of(spark, texts)).collect()
    for row in rows:
        got = [(s.kind, s.start, s.end) for s in row.pii if s.kind in pii.BASE]
        assert got == brute_spans(texts[row.doc_id]), texts[row.doc_id][:200]
    assert pii.find_pii(edge).count() == edge.count() and pii.find_pii(edge.limit(0)).count() == 0


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33", "my ssn is 123-45-6789", "part 123-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "token: abcdefghijklmnopqrstuvwxyz"]
    got = {r.doc_id: [s.kind for s in r.pii] for r in pii.find_pii(docs_of(spark, texts)).collect()}
    assert got[0] == ["iban"] and got[1] == [] and got[2] == ["ssn"] and got[3] == []
    assert got[4] == ["secret"] and got[5] == [] and got[6] == []


def test_many_spans_of_one_text(spark):
    text = " ".join(f"é{k} a{k}@b{k}.org" for k in range(3000))
    rows = pii.find_pii(docs_of(spark, [text]).withColumn("__t", F.lit("t")).withColumn("__m0", F.lit("m"))).collect()
    assert [(s.kind, s.start, s.end) for s in rows[0].pii] == brute_spans(text) and (rows[0]["__t"], rows[0]["__m0"]) == ("t", "m")


def test_redaction(spark):
    out = {r.doc_id: r.text for r in pii.redact(docs_of(spark, ["mail é a@b.co now", "none", None, "1.2.3.4 a@b.co"])).collect()}
    assert out == {0: "mail é <EMAIL> now", 1: "none", 2: None, 3: "<IP> <EMAIL>"}


# --- 8 embeddings ----------------------------------------------------------------------------------------------


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x[300:600] = x[:300] + rng.normal(size=(300, 16)) * rng.uniform(0, 0.4, (300, 1))
    x[600:700] = x[0] + rng.normal(size=(100, 16)) * 0.05
    x[700:720] = x[1]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] + [0.0] * 14, 0), (904, [1.0, 2.0], 0), (905, [], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = list(range(900))
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(link)):
            if label[b] < label[a]:
                label[a], changed = label[b], True
    for k in range(900):
        assert got[k] == (link[k].sum(), label[k], label[k] == k)
    assert all(got[k] == (0, k, True) for k in range(900, 906))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_drifting_groups_equal_brute_force(spark, monkeypatch):
    """Groups spread along one direction each, over many cells: the cut between two cells runs across that direction."""
    monkeypatch.setattr(embeddings, "CELL", 50)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=256) + rng.normal(size=(150, 1)) * 0.5 * rng.normal(size=256) for _ in range(30)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    assert [got[k] for k in range(len(x))] == links.tolist()


# --- 9 language model -------------------------------------------------------------------------------------------


def test_base_scores_equal_counts(spark, edge):
    texts = [prose(k % 40, 3 + k % 30) for k in range(150)] + [None, "", "  ", "Alpha\x0bBETA é"]
    rows = language_model.score(docs_of(spark, texts)).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [0]
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    c = Counter(w for k, t in enumerate(texts) if not held(k) for w in split(t))
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = split(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0
    assert language_model.score(edge).count() == edge.count()
    assert language_model.score(edge.limit(0)).count() == 0


def test_scores_tell_seen_from_unseen_bigrams_beyond_any_bound(spark, monkeypatch):
    monkeypatch.setattr(language_model, "MOST_BITS", 1 << 12, raising=False)  # a bound on the filter, as if the input were beyond it
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 500, 6))
    texts = [text() for _ in range(400)] * 8
    texts = [text() if zlib.crc32(str(k).encode()) % 10 == 0 else t for k, t in enumerate(texts)]
    want, least = plain_scores(texts)
    assert least > 1
    got = {r.doc_id: r.score for r in language_model.score(docs_of(spark, texts)).collect()}
    held = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 10 == 0]
    assert np.mean([got[k] == pytest.approx(want[k]) for k in held]) > 0.97


def test_bigrams_seen_once_count(spark):
    texts = [prose(k, 30) + f" only{k} here{k}" for k in range(60)]
    want, least = plain_scores([t.lower() for t in texts])
    assert least == 1
    got = {r.doc_id: r.score for r in language_model.score(docs_of(spark, texts)).collect()}
    train = [k for k in range(60) if zlib.crc32(str(k).encode()) % 10]
    assert np.mean([got[k] == pytest.approx(want[k]) for k in train]) > 0.9 and all(abs(got[k] - want[k]) < 2 for k in train)


def test_scores_equal_a_plain_model_on_a_whole_table(spark):
    """All rows of sf0.001; the filter's errors (some in ten thousand unseen bigrams) may touch a few."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect())
    assert [r.doc_id for r in rows] == list(range(len(rows)))
    want, _ = plain_scores([r.text for r in rows])
    got = {r.doc_id: r for r in language_model.score(docs).collect()}
    same = [got[k].score == pytest.approx(w, rel=1e-9) for k, w in enumerate(want)]
    assert len(got) == len(rows) and np.mean(same) > 0.9
    assert all(got[k].score == pytest.approx(w, rel=0.01) and got[k].score >= w - 1e-6 for k, w in enumerate(want))
    assert all(got[k].score_per_token == pytest.approx(got[k].score / got[k].n_tokens) for k in got)


def test_the_model_sums_to_one_at_most():
    texts = [prose(k % 40, 3 + k % 30) for k in range(120)]
    p, words, _, _ = plain_model(texts)
    sums = [sum(p(a, b) for b in [*words, "unknown"]) for a in [1, *(w for w in words if w), "unknown"]]  # nothing follows the end
    assert max(sums) <= 1 + 1e-9 and min(sums) > 0.5


def test_bloom_counts_come_back():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 1 << 48, 4000, dtype=np.uint64))
    counts = rng.integers(2, 5000, len(pairs))
    slots, segment = 16, 1 << 14
    slot = (pairs >> np.uint64(44)).astype(int)
    bits = np.frombuffer(b"".join(language_model.bloom_segment(pairs[slot == s], counts[slot == s], segment) for s in range(slots)), np.uint8)
    got = language_model.bloom_counts(bits, pairs, slots, segment)
    assert (got >= 2 ** np.floor(np.log2(counts))).all() and (got == 2 ** np.floor(np.log2(counts))).mean() > 0.8
    other = rng.integers(0, 1 << 48, 4000, dtype=np.uint64)
    assert (language_model.bloom_counts(bits, other, slots, segment) > 0).mean() < 0.1


# --- 10 near-duplicates ------------------------------------------------------------------------------------------


def test_near_duplicate_classes_equal_brute_force(spark):
    r = random.Random(9)
    texts = [None, "", "a b", "a b", "A, b!"] + [prose(k, 60) for k in range(25)]
    for k in range(5, 15):
        for _ in range(6):
            w = texts[k].split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "edit%d" % r.randint(0, 99)
            texts.append(" ".join(w))
    shared = prose(99, 25)
    texts += [shared + " " + prose(200 + k, 40) for k in range(20)]
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[k].class_id for k in range(len(texts))] == brute_classes(texts)
    assert all(got[k].kept == (got[k].class_id == k) for k in range(len(texts)))


def test_keep_one(spark, edge):
    assert near_duplicates.near_duplicates(edge).count() == edge.count()
    out = near_duplicates.keep_one(edge)
    assert out.columns == edge.columns and out.count() == edge.count() - 2
    assert near_duplicates.near_duplicates(edge.limit(0)).count() == 0


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(4)
    ids = np.unique(rng.integers(0, 1 << 50, 400, dtype=np.uint64))
    wa, wb = rng.uniform(0.5, 3, len(ids)), rng.uniform(0.5, 3, len(ids))
    doc = np.repeat([0, 1], len(ids))
    s = near_duplicates.samples(doc, np.concatenate([ids, ids]), np.concatenate([wa, wb]), 2, 2000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.04)
