"""Queries of the scalar library: each row of results is compared with the same functions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import scalars as s
from evigraph.plans.registry import query
from evigraph.sources.domain import table


def _words():
    return F.split("p_name", " ")


@query("array_scalars", """WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part) SELECT p_partkey, a[1] AS first, a[-1] AS last, a[10] AS none, (coalesce(list_position(a, 'ring'), 0) - 1)::BIGINT AS idx, array_to_string(a[2:], '-') AS rest, array_to_string(list_reverse(a), ',') AS rev,
array_to_string(list_sort(a), ',') AS sorted, list_contains(a, 'ring') AS has, array_to_string(list_transform(a, lambda x: upper(x)), ' ') AS up, len(list_filter(a, lambda x: len(x) > 4))::INT AS long_, array_to_string(list_concat(a, ['z']), ' ') AS pushed, array_to_string(list_concat(['0'], a), ' ') AS shifted, array_to_string(a[:-2], ' ') AS popped,
len(list_filter(a, lambda x: len(x) > 4)) > 0 AS some_, len(list_filter(a, lambda x: len(x) > 2)) = len(a) AS every_, list_sum(list_transform(a, lambda x: len(x)))::INT AS total FROM a""")
def array_scalars(spark, d):
    long_ = lambda x: F.length(x) > 4
    return table(spark, d, "part").select(
        "p_partkey", s.at(_words(), 0).alias("first"), s.at(_words(), -1).alias("last"), s.at(_words(), 9).alias("none"), s.index_of(_words(), F.lit("ring")).alias("idx"), s.join(s.slice_(_words(), 1), "-").alias("rest"), s.join(F.reverse(_words()), ",").alias("rev"),
        s.join(F.array_sort(_words()), ",").alias("sorted"), F.array_contains(_words(), "ring").alias("has"), s.join(F.transform(_words(), F.upper), " ").alias("up"), F.size(F.filter(_words(), long_)).alias("long_"),
        s.join(F.array_append(_words(), F.lit("z")), " ").alias("pushed"), s.join(F.array_prepend(_words(), F.lit("0")), " ").alias("shifted"), s.join(s.slice_(_words(), 0, -1), " ").alias("popped"),
        F.exists(_words(), long_).alias("some_"), F.forall(_words(), lambda x: F.length(x) > 2).alias("every_"), F.aggregate(_words(), F.lit(0), lambda acc, x: acc + F.length(x)).alias("total"),
    )


@query("array_edit_scalars", """WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part) SELECT p_partkey, array_to_string(list_concat(a[:1], ['x', 'y'], a[3:]), ' ') AS spliced, array_to_string(list_concat(['w'], a[2:]), ' ') AS with0, array_to_string(list_transform(a, lambda x: 'f'), ' ') AS filled,
coalesce(list_filter(a, lambda x: starts_with(x, 'b'))[1], '-') AS found, coalesce(list_filter(a, lambda x: starts_with(x, 'b'))[-1], '-') AS found_last, array_to_string(list_reverse(a), '') AS folded FROM a""")
def array_edit_scalars(spark, d):
    b = lambda x: x.startswith("b")
    return table(spark, d, "part").select("p_partkey", s.join(s.splice(_words(), 1, 1, F.lit("x"), F.lit("y")), " ").alias("spliced"), s.join(s.with_(_words(), 0, F.lit("w")), " ").alias("with0"), s.join(s.fill(_words(), F.lit("f")), " ").alias("filled"), F.coalesce(s.find(_words(), b), F.lit("-")).alias("found"), F.coalesce(s.find_last(_words(), b), F.lit("-")).alias("found_last"), s.reduce_right(_words(), F.lit(""), lambda acc, x: F.concat(acc, x)).alias("folded"))


@query("string_scalars", """SELECT p_partkey, upper(p_name) AS up, substr(p_name, 3, 1) AS c2, substr(p_name, len(p_name), 1) AS last, substr(p_name, 3, 4) AS sub, strpos(p_name, 'in') - 1 AS idx, lpad(p_brand, greatest(12, len(p_brand))::INT, '*') AS pad, rpad(p_brand, greatest(3, len(p_brand))::INT, '*') AS nopad,
replace(p_name, 'e', 'E') AS all_, starts_with(p_name, 'b') AS sw, ends_with(p_name, 'g') AS ew, contains(p_name, ' ') AS inc, repeat(p_brand, 2) AS rep, trim(p_type) AS t, ascii(p_name)::INT AS code, concat(p_brand, '!') AS cat, array_to_string(string_split(p_type, ' ')[:2], '|') AS parts FROM part""")
def string_scalars(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.upper(n).alias("up"), s.char_at(n, 2).alias("c2"), s.string_at(n, -1).alias("last"), s.substring(n, 6, 2).alias("sub"), s.string_index_of(n, "in").cast("long").alias("idx"), s.pad_start(F.col("p_brand"), 12, "*").alias("pad"), s.pad_end(F.col("p_brand"), 3, "*").alias("nopad"),
        F.replace(n, F.lit("e"), F.lit("E")).alias("all_"), n.startswith("b").alias("sw"), n.endswith("g").alias("ew"), F.contains(n, F.lit(" ")).alias("inc"), F.repeat("p_brand", 2).alias("rep"), s.trim(F.col("p_type")).alias("t"), F.ascii(n).alias("code"), F.concat("p_brand", F.lit("!")).alias("cat"), F.array_join(s.split(F.col("p_type"), " ", 2), "|").alias("parts"),
    )


@query("math_scalars", """SELECT l_orderkey, l_linenumber, floor(l_extendedprice + 0.5)::BIGINT AS r, floor(-l_extendedprice + 0.5)::BIGINT AS rn, trunc(l_extendedprice)::BIGINT AS t, sign(l_discount - 0.05)::INT AS sg, round(sqrt(l_quantity), 6) AS sq, round(cbrt(l_quantity), 6) AS cb, round(ln(l_quantity), 6) AS ln, round(log2(l_quantity), 6) AS l2, round(log10(l_quantity), 6) AS l10,
round(exp(l_discount), 6) AS e, round(sin(l_quantity), 6) AS si, round(atan2(l_quantity, l_tax + 1), 6) AS at2, greatest(l_quantity, 25) AS mx, least(l_quantity, 25) AS mn, round(pow(l_quantity, 2), 6) AS p2, abs(l_tax - l_discount) AS ab, (32 - len(bin(l_linenumber)))::INT AS clz FROM lineitem""")
def math_scalars(spark, d):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    r = lambda c: F.round(c, 6)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", s.js_round(p).alias("r"), s.js_round(-p).alias("rn"), s.trunc(p).alias("t"), F.signum(F.col("l_discount") - 0.05).cast("int").alias("sg"), r(F.sqrt(q)).alias("sq"), r(F.cbrt(q)).alias("cb"), r(F.ln(q)).alias("ln"), r(F.log2(q)).alias("l2"), r(F.log10(q)).alias("l10"),
        r(F.exp("l_discount")).alias("e"), r(F.sin(q)).alias("si"), r(F.atan2(q, F.col("l_tax") + 1)).alias("at2"), F.greatest(q, F.lit(25.0)).alias("mx"), F.least(q, F.lit(25.0)).alias("mn"), r(F.pow(q, F.lit(2))).alias("p2"), F.abs(F.col("l_tax") - F.col("l_discount")).alias("ab"), s.clz32(F.col("l_linenumber")).alias("clz"),
    )


@query("map_scalars", """SELECT event_id, (props->>'$.k')::INT AS k, coalesce(props->>'$.z', 'none') AS z, array_to_string(json_keys(props), ',') AS keys, len(json_keys(props))::INT AS size, props->>'$.k' IS NOT NULL AS has FROM events""")
def map_scalars(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.try_element_at(m, F.lit("k")).cast("int").alias("k"), s.get_or(m, F.lit("z"), F.lit("none")).alias("z"), F.array_join(F.map_keys(m), ",").alias("keys"), F.size(m).alias("size"), F.map_contains_key(m, "k").alias("has"))


@query("date_scalars", """SELECT o_orderkey, year(o_orderdate)::INT AS y, (month(o_orderdate) - 1)::INT AS m, day(o_orderdate)::INT AS d, dayofweek(o_orderdate)::INT AS w, hour(o_orderdate)::INT AS h, epoch_ms(o_orderdate) AS ms, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(make_timestamp(2000, month(o_orderdate), 1, 0, 0, 0.0), '%Y-%m-%d') AS set_ FROM orders""")
def date_scalars(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", F.year(t).alias("y"), s.month(t).alias("m"), F.dayofmonth(t).alias("d"), s.day(t).alias("w"), F.hour(t).alias("h"), F.unix_millis(t).alias("ms"), s.to_iso_string(t).alias("iso"), F.date_format(s.set_part(t, year=F.lit(2000), day=F.lit(1), hour=F.lit(0), minute=F.lit(0), second=F.lit(0)), "yyyy-MM-dd").alias("set_"))


@query("json_scalars", """SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.missing' AS missing, json_valid(props) AS ok, '{"u":' || user_id || '}' AS out FROM events""")
def json_scalars(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.try_parse_json("props").isNotNull().alias("ok"), F.to_json(F.struct(F.col("user_id").alias("u"))).alias("out"))


@query("url_scalars", r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS proto, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '') AS page, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), '') AS hash FROM pages""")
def url_scalars(spark, d):
    u = F.col("url")
    part = lambda p: F.coalesce(F.try_parse_url(u, F.lit(p)), F.lit(""))
    return table(spark, d, "pages").select("page_id", part("PROTOCOL").alias("proto"), part("HOST").alias("host"), part("PATH").alias("path"), F.coalesce(F.try_element_at(s.query_params(u), F.lit("page")), F.lit("")).alias("page"), part("REF").alias("hash"))


@query("regexp_scalars", r"""SELECT page_id, regexp_extract(url, '([a-z]+)\.example', 1) AS exec_, regexp_matches(url, '/en/[0-9]+') AS test, array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS all_, regexp_replace(url, '[0-9]+', '#', 'g') AS rep, len(regexp_extract_all(url, '/'))::INT AS n FROM pages""")
def regexp_scalars(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"([a-z]+)\.example", 1).alias("exec_"), F.rlike("url", F.lit("/en/[0-9]+")).alias("test"), F.array_join(F.regexp_extract_all("url", F.lit("([0-9]+)"), F.lit(1)), ",").alias("all_"), F.regexp_replace("url", "[0-9]+", "#").alias("rep"), F.regexp_count("url", F.lit("/")).alias("n"))


@query("set_method_scalars", """WITH a AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS x, list_distinct(string_split(lower(p_type), ' ')) AS y FROM part) SELECT p_partkey, len(list_distinct(list_concat(x, y)))::INT AS u, len(list_intersect(x, y))::INT AS i, len(list_filter(x, lambda v: NOT list_contains(y, v)))::INT AS diff, list_has_any(x, y) AS overlap, len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 AS subset FROM a""")
def set_method_scalars(spark, d):
    x, y = F.array_distinct(_words()), F.array_distinct(F.split(F.lower("p_type"), " "))
    return table(spark, d, "part").select("p_partkey", F.size(F.array_union(x, y)).alias("u"), F.size(F.array_intersect(x, y)).alias("i"), F.size(F.array_except(x, y)).alias("diff"), F.arrays_overlap(x, y).alias("overlap"), (F.size(F.array_except(x, y)) == 0).alias("subset"))


@query("bytes_hash_scalars", "SELECT p_partkey, hex(encode(p_brand)) AS hx, sha256(p_name) AS sha, md5(p_name) AS md, decode(unhex(hex(encode(p_brand)))) AS back FROM part")
def bytes_hash_scalars(spark, d):
    return table(spark, d, "part").select("p_partkey", F.hex(F.encode("p_brand", "UTF-8")).alias("hx"), F.sha2("p_name", 256).alias("sha"), F.md5("p_name").alias("md"), F.decode(F.unhex(F.hex(F.encode("p_brand", "UTF-8"))), "UTF-8").alias("back"))


@query("number_scalars", "SELECT l_orderkey, l_linenumber, l_quantity = floor(l_quantity) AS is_int, isfinite(l_tax) AS fin, (l_tax::FLOAT)::DOUBLE AS fr, TRY_CAST(regexp_extract(l_orderkey || 'px', '^[0-9]+') AS BIGINT) AS pi FROM lineitem")
def number_scalars(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.is_integer(q).alias("is_int"), s.is_finite(F.col("l_tax")).alias("fin"), s.fround(F.col("l_tax")).alias("fr"), s.parse_int(F.concat(F.col("l_orderkey").cast("string"), F.lit("px"))).alias("pi"))


@query("vector_scalars", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2, len(embedding)::INT AS n FROM embeddings")
def vector_scalars(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x * x), 4).alias("norm2"), F.size("embedding").alias("n"))
