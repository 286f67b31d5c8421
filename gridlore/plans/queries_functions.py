"""Set, string, time, vector, coordinate and JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query, table
from ..functions import arrays as A, strings as S, times as T, vectors as V

SETS = "(SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 30))) AS a, list_sort(list_distinct(list(event_type) FILTER (event_id % 2 = 0))) AS b FROM events GROUP BY user_id)"


def _sets(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(A.as_set(F.collect_list(F.when(F.col("value") > 30, F.col("event_type")))).alias("a"), A.as_set(F.collect_list(F.when(F.col("event_id") % 2 == 0, F.col("event_type")))).alias("b"))


for _name, _f, _sql in (
    ("set_union", A.union, "list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))"),
    ("set_inter", A.inter, "list_sort(list_intersect(coalesce(a, []), coalesce(b, [])))"),
    ("set_diff", A.diff, "list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)))"),
    ("set_sdiff", A.sym_diff, "list_sort(list_concat(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)), list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))))"),
):
    query(_name, f"SELECT user_id, array_to_string({_sql}, ',') AS s FROM {SETS}")(lambda spark, sf, f=_f: _sets(spark, sf).select("user_id", F.array_join(f(F.col("a"), F.col("b")), ",").alias("s")))


@query("set_relations", f"SELECT user_id, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) = 0 AS subset, len(list_intersect(coalesce(a, []), coalesce(b, []))) > 0 AS meets, list_contains(coalesce(a, []), 'click') AS has_click, CAST(coalesce(list_position(a, 'click'), 0) - 1 AS BIGINT) AS at_click FROM {SETS}")
def set_relations(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _sets(spark, sf).select("user_id", A.relates(a, "<=", b).alias("subset"), A.relates(a, "&", b).alias("meets"), A.has(a, F.lit("click")).alias("has_click"), A.ordinal(a, F.lit("click")).alias("at_click"))


@query("array_search", "SELECT user_id, CAST(len(list_filter(v, lambda x: x <= 50)) - 1 AS INT) AS le, CAST(len(list_filter(v, lambda x: x < 50)) - 1 AS INT) AS lt, round(list_sum(v), 6) AS total FROM (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id)")
def array_search(spark, sf):
    v = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return v.select("user_id", A.last_le(F.col("v"), F.lit(50.0)).alias("le"), A.last_lt(F.col("v"), F.lit(50.0)).alias("lt"), F.round(A.total(F.col("v")), 6).alias("total"))


@query("array_order", "SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(1, 9), lambda k: {'v': embedding[k], 'i': k - 1})), lambda s: s.i), ',') AS o FROM embeddings")
def array_order(spark, sf):
    a = F.slice("embedding", 1, 8)
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(A.order_vector(a).cast("array<string>"), ",").alias("o"))


@query("str_match_template", "SELECT p_partkey, p_name ILIKE '%a_e%' AS hit, p_name LIKE 'A%' AS strict FROM part")
def str_match_template(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.match(F.col("p_name"), "*a%e*").alias("hit"), S.match(F.col("p_name"), "A*", ignore_case=False).alias("strict"))


@query("str_positions", "SELECT page_id, CAST(instr(url, '/') - 1 AS INT) AS first, CASE WHEN contains(url, '/') THEN CAST(length(url) - instr(reverse(url), '/') AS INT) ELSE -1 END AS last, CAST(length(rtrim(url)) - 1 AS INT) AS nonblank FROM pages")
def str_positions(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", S.pos(u, "/").alias("first"), S.pos_reverse(u, "/").alias("last"), S.last_nonblank(u).alias("nonblank"))


@query("str_parse_lists", "SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_split_to_array(url, '[/:.]'), lambda x: trim(x)))), ',') AS parts FROM pages")
def str_parse_lists(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(S.item_set(F.col("url"), "/:."), ",").alias("parts"))


@query("str_words", "SELECT doc_id, coalesce(regexp_split_to_array(trim(text), '\\s+')[3], '') AS third, length(text) - length(replace(text, '!', '')) AS marks FROM documents")
def str_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.nth_word(F.col("text"), 3).alias("third"), (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("marks"))


@query("str_compress", "SELECT doc_id, md5(regexp_replace(text, '(!{1})!+', '\\1', 'g')) AS h, upper(replace(lang, ' ', '')) = 'EN' AS english FROM documents")
def str_compress(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.compress(F.col("text"), "!", 1)).alias("h"), S.same(F.col("lang"), F.lit(" e N")).alias("english"))


@query("str_replace_marker", "SELECT p_partkey, CASE WHEN instr(p_name, 'a') > 0 THEN left(p_name, instr(p_name, 'a') - 1) || '#' || CAST(p_size AS VARCHAR) || substring(p_name, instr(p_name, 'a') + 1) ELSE p_name END AS s FROM part")
def str_replace_marker(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.replace_marker(F.col("p_name"), "a", F.concat(F.lit("#"), F.col("p_size").cast("string"))).alias("s"))


@query("str_parse_numbers", "SELECT p_partkey, TRY_CAST(p_brand AS DOUBLE) AS bad, TRY_CAST(CAST(p_size AS VARCHAR) AS BIGINT) AS good FROM part")
def str_parse_numbers(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.parse_double(F.col("p_brand")).alias("bad"), S.parse_int(F.col("p_size").cast("string")).alias("good"))


def _words_sql(n: str) -> str:
    ones, tens = (str(w) for w in (S.ONES, S.TENS))
    groups = []
    for p, word in S.POWERS:
        k = f"(({n}) // {p} % 1000)"
        pair = f"CASE WHEN {k} % 100 = 0 THEN NULL WHEN {k} % 100 < 20 THEN {ones}[{k} % 100 + 1] WHEN {k} % 10 = 0 THEN {tens}[{k} % 100 // 10 + 1] ELSE {tens}[{k} % 100 // 10 + 1] || '-' || {ones}[{k} % 10 + 1] END"
        groups.append(f"CASE WHEN {k} > 0 THEN concat_ws(' ', CASE WHEN {k} >= 100 THEN {ones}[{k} // 100 + 1] || ' HUNDRED' END, {pair}, {f"'{word}'" if word else 'NULL'}) END")
    return f"CASE WHEN ({n}) = 0 THEN 'ZERO' ELSE concat_ws(' ', {', '.join(groups)}) END"


_ORDINAL_SQL = "CASE " + " ".join(f"WHEN last = '{a}' THEN '{b}'" for a, b in S.ORDINALS.items()) + " WHEN last LIKE '%TY' THEN left(last, length(last) - 1) || 'IETH' ELSE last || 'TH' END"


@query("str_number_words", f"SELECT o_orderkey, 'order ' || lower(w) || '!' AS cardinal, regexp_replace(w, '[A-Z]+$', '') || {_ORDINAL_SQL} AS ordinal FROM (SELECT *, regexp_extract(w, '([A-Z]+)$', 1) AS last FROM (SELECT o_orderkey, {_words_sql('o_orderkey * 7919')} AS w FROM orders))")
def str_number_words(spark, sf):
    n = F.col("o_orderkey") * 7919
    return table(spark, sf, "orders").select("o_orderkey", S.replace_cardinal(F.lit("order #!"), "#", n, "L").alias("cardinal"), S.ordinal_text(n).alias("ordinal"))


@query("str_scan", "SELECT page_id, CAST(coalesce(nullif(instr(substring(url, 4), '/'), 0) + 2, -1) AS INT) AS slash, CASE WHEN regexp_matches(url, '[.:]') THEN CAST(length(url) - length(regexp_extract(url, '[^.:]*$')) - 1 AS INT) ELSE -1 END AS mark, regexp_extract(reverse(url), '^[0-9]+') AS digits, regexp_extract(replace(url, '/', ' '), '^ *([^ ]*) *(.*)$', 2) AS rest FROM pages")
def str_scan(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", S.char_pos(u, "/", 3).alias("slash"), S.char_pos_reverse(u, ".:").alias("mark"), S.unsigned_at(F.reverse(u)).alias("digits"), S.next_word(F.replace(u, F.lit("/"), F.lit(" ")))["rest"].alias("rest"))


@query("time_et", "SELECT event_id, round(epoch(ts) - 946728000, 3) AS utc, round(epoch(ts) - 946728000 + 37 + 32.184, 2) AS et, round((epoch(ts) - 946728000) / 86400 + 2451545.0, 4) AS jd FROM events WHERE ts >= TIMESTAMP '2017-01-01'")
def time_et(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", F.round(T.utc_seconds(ts), 3).alias("utc"), F.round(T.et(ts), 2).alias("et"), F.round(T.julian_date(ts), 4).alias("jd"))


@query("time_calendar", "SELECT event_id, upper(strftime(ts, '%Y %b %d %H:%M:%S')) AS cal, strftime(ts, '%Y-%j') AS doy FROM events")
def time_calendar(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", T.calendar(ts).alias("cal"), T.day_of_year(ts).alias("doy"))


@query("time_clock_ticks", "SELECT o_orderkey, o_orderkey * 65536 + 77 AS ticks, CAST(o_orderkey AS VARCHAR) || '.77' AS clock FROM orders")
def time_clock_ticks(spark, sf):
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit(".77"))
    t = T.ticks(text, [0, 65536])
    return table(spark, sf, "orders").select("o_orderkey", t.alias("ticks"), T.clock_text(t, [0, 65536]).alias("clock"))


VEC = "(SELECT p_partkey, p_size + 0.0 AS x, p_retailprice / 100 AS y, (p_partkey % 17) - 8.0 AS z FROM part)"


def _vec(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.vec(F.col("p_size") + 0.0, F.col("p_retailprice") / 100, F.col("p_partkey") % 17 - 8.0).alias("v"))


@query("vector_basics", f"SELECT p_partkey, round(sqrt(x * x + y * y + z * z), 6) AS n, round(x * 1 + y * 2 + z * 3, 6) AS d, round(y * 3 - z * 2, 6) AS cx, round(acos((x + 2 * y + 3 * z) / sqrt(14) / sqrt(x * x + y * y + z * z)), 6) AS sep, round(x - (x + 2 * y + 3 * z) / 14, 6) AS px FROM {VEC}")
def vector_basics(spark, sf):
    v, w = F.col("v"), V.vec(1.0, 2.0, 3.0)
    return _vec(spark, sf).select("p_partkey", F.round(V.norm(v), 6).alias("n"), F.round(V.dot(v, w), 6).alias("d"), F.round(F.element_at(V.cross(v, w), 1), 6).alias("cx"), F.round(V.separation(v, w), 6).alias("sep"), F.round(F.element_at(V.perpendicular(v, w), 1), 6).alias("px"))


@query("vector_rotation", f"SELECT p_partkey, round(x * cos(0.3) + y * sin(0.3), 6) AS x, round(-x * sin(0.3) + y * cos(0.3), 6) AS y, round(CAST(z AS DOUBLE), 6) AS z FROM {VEC}")
def vector_rotation(spark, sf):
    r = V.matrix_times(V.frame_rotation(F.lit(0.3), 3), F.col("v"))
    return _vec(spark, sf).select("p_partkey", r.alias("r")).select("p_partkey", *[F.round(F.element_at("r", i + 1), 6).alias(n) for i, n in enumerate("xyz")])


@query("coordinates_latitudinal", f"SELECT p_partkey, round(sqrt(x * x + y * y + z * z), 6) AS radius, round(atan2(y, x), 6) AS lon, round(atan2(z, sqrt(x * x + y * y)), 6) AS lat FROM {VEC}")
def coordinates_latitudinal(spark, sf):
    return _vec(spark, sf).select("p_partkey", V.rec_to_lat(F.col("v")).alias("c")).select("p_partkey", *[F.round(f"c.{n}", 6).alias(n) for n in ("radius", "lon", "lat")])


@query("coordinates_geodetic", f"SELECT p_partkey, round(z / 10, 6) AS lon, round(p, 6) AS lat, round(y * 1000, 2) AS alt FROM (SELECT p_partkey, y, z, (x - 25) / 25.0 AS p FROM {VEC})")
def coordinates_geodetic(spark, sf):
    """Geodetic to rectangular and back."""
    f = 1 / 298.25
    g = _vec(spark, sf).select("p_partkey", (F.element_at("v", 3) / 10).alias("lon"), ((F.element_at("v", 1) - 25) / 25).alias("lat"), (F.element_at("v", 2) * 1000).alias("alt"))
    back = g.select("p_partkey", V.rec_to_geo(V.geo_to_rec(F.col("lon"), F.col("lat"), F.col("alt"), 6378137.0, f), 6378137.0, f).alias("c"))
    return back.select("p_partkey", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"), F.round("c.alt", 2).alias("alt"))


@query("projection_equal_area", f"SELECT p_partkey, round(z / 10, 6) AS lon, round((x - 25) / 25.0, 6) AS lat FROM {VEC}")
def projection_equal_area(spark, sf):
    """Forward and back."""
    g = _vec(spark, sf).select("p_partkey", (F.element_at("v", 3) / 10).alias("lon"), ((F.element_at("v", 1) - 25) / 25).alias("lat"))
    fwd = g.select("p_partkey", V.equal_area(F.col("lon"), F.col("lat"), 1737.4, 0.2, -0.4).alias("p"))
    back = fwd.select("p_partkey", V.equal_area_inverse(F.col("p.x"), F.col("p.y"), 1737.4, 0.2, -0.4).alias("c"))
    return back.select("p_partkey", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query("shape_ellipsoid_hit", f"SELECT p_partkey, round(acos(greatest(-1.0, least(1.0, nx / n))), 6) AS incidence, round(acos(greatest(-1.0, least(1.0, (nx * x + ny * y + nz * z) / n / v))), 6) AS emission, round(acos(greatest(-1.0, least(1.0, x / v))), 6) AS phase FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n, sqrt(x * x + y * y + z * z) AS v FROM (SELECT *, x / 900.0 AS nx, y / 784.0 AS ny, z / 625.0 AS nz FROM (SELECT p_partkey, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM {VEC})))")
def shape_ellipsoid_hit(spark, sf):
    d = V.unit(V.sub(V.vec(0.0, 0.0, 0.0), F.col("v")))
    hit = V.ellipsoid_hit(V.scale(10.0, F.col("v")), d, 30.0, 28.0, 25.0)
    out = _vec(spark, sf).select("p_partkey", hit.alias("h"), F.col("v"))
    a = V.surface_angles(V.ellipsoid_normal(F.col("h"), 30.0, 28.0, 25.0), V.vec(1.0, 0.0, 0.0), F.col("v"))
    return out.select("p_partkey", a.alias("a")).select("p_partkey", *[F.round(f"a.{n}", 6).alias(n) for n in ("incidence", "emission", "phase")])


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n"))


@query("json_report", "SELECT s_nationkey, CAST(to_json({'schema': 'ranking', 'n_candidates': count(*), 'candidates': list({'suit_mean': s_acctbal, 'clump_cat': s_suppkey} ORDER BY s_acctbal DESC, s_suppkey DESC)[1:5]}) AS VARCHAR) AS report FROM supplier GROUP BY s_nationkey")
def json_report(spark, sf):
    s = table(spark, sf, "supplier")
    top = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("s_acctbal").alias("suit_mean"), F.col("s_suppkey").alias("clump_cat"))))), 1, 5)
    return s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.lit("ranking").alias("schema"), F.count("*").alias("n_candidates"), top.alias("candidates"))).alias("report"))


@query("bbox_wrap", "SELECT c_custkey FROM (SELECT c_custkey, (c_custkey * 7) % 360 - 180.0 AS lon, (c_custkey * 3) % 180 - 90.0 AS lat FROM customer) WHERE lat BETWEEN -30 AND 30 AND (lon >= 170 OR lon <= -170)")
def bbox_wrap(spark, sf):
    from ..sources.catalogues import inside_box

    c = table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") * 7) % 360 - 180.0).alias("lon"), ((F.col("c_custkey") * 3) % 180 - 90.0).alias("lat"))
    return c.where(inside_box(F.col("lon"), F.col("lat"), 170.0, -170.0, -30.0, 30.0)).select("c_custkey")
