"""Queries of question corpora: suppliers and parts as symbols, order lines as calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import corpus
from evigraph.plans.registry import query
from evigraph.sources import domain
from evigraph.sources.domain import GRAPH_SQL, table

WITH = f"WITH RECURSIVE {GRAPH_SQL}"


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


IDX = """ce AS (SELECT DISTINCT src, dst, tier FROM calls WHERE line <= 2), ts AS (SELECT DISTINCT 't' || (line % 4) AS test, dst AS id FROM calls WHERE line > 5), sy AS (SELECT 'part:' || p_partkey AS id, replace(p_name, ' ', '') || CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE '' END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'function' ELSE 'const' END AS kind, 'src/' || p_brand AS path, p_size AS line, p_size + 4 AS end_line FROM part),
cr AS (SELECT dst AS id, string_agg(src || '/' || tier, ',' ORDER BY (tier <> 'semantic')::INT, src, tier) AS callers FROM ce GROUP BY dst), tt AS (SELECT id, string_agg(test, ',' ORDER BY test) AS tests FROM ts GROUP BY id), nn AS (SELECT name, count(*) AS n FROM sy GROUP BY name)"""


def _index(spark, d):
    c, p, key = domain.calls(spark, d), table(spark, d, "part"), F.col("p_partkey")
    name = _cat(F.replace("p_name", F.lit(" "), F.lit("")), F.when(key % 3 == 0, key.cast("string")).otherwise(""))
    symbols = p.select(_cat("part:", key).alias("id"), name.alias("name"), F.when(key % 2 == 0, "function").otherwise("const").alias("kind"), _cat("src/", F.col("p_brand")).alias("path"), F.col("p_size").alias("line"), (F.col("p_size") + 4).alias("end_line"))
    tests = c.filter("line > 5").select(_cat("t", F.col("line") % 4).alias("test"), F.col("dst").alias("id"))
    return corpus.index(c.filter("line <= 2"), tests, symbols)


def _plain(column: str):
    return F.coalesce(F.array_join(F.transform(column, lambda x: F.concat_ws("/", x["id"], x["tier"])), ","), F.lit(""))


@query("corpus_index", f"{WITH}, {IDX} SELECT sy.id, sy.name, coalesce(callers, '') AS callers, coalesce(tests, '') AS tests, n = 1 AND length(sy.name) >= 4 AS unique_name FROM sy LEFT JOIN cr ON cr.id = sy.id LEFT JOIN tt ON tt.id = sy.id JOIN nn ON nn.name = sy.name")
def corpus_index(spark, d):
    return _index(spark, d).select("id", "name", _plain("callers").alias("callers"), F.coalesce(F.array_join("tests", ","), F.lit("")).alias("tests"), "unique_name")


@query("held_out_closed", "WITH s AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 's' || s_suppkey || '.m' || n_nationkey FROM supplier, nation WHERE n_nationkey < 4 UNION ALL SELECT 's' || s_suppkey || '.m1.x' FROM supplier), h AS (SELECT id FROM s WHERE ('0x' || substr(sha256('7' || chr(10) || id), 1, 8))::BIGINT / 4294967296.0 < 0.2) SELECT DISTINCT s.id FROM s JOIN h ON s.id = h.id OR starts_with(s.id, h.id || '.')")
def held_out_closed(spark, d):
    key = F.col("s_suppkey")
    ids = F.array(_cat("s", key), *(_cat("s", key, f".m{k}") for k in range(4)), _cat("s", key, ".m1.x"))
    return corpus.held_out(table(spark, d, "supplier").select(F.explode(ids).alias("id")), 0.2, 7)


HID = "hd AS (SELECT 'supplier:' || s_suppkey AS other FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 't1')"


@query("symbol_cards", f"""{WITH}, {IDX}, {HID}, sc AS (SELECT dst AS id, string_agg(CASE WHEN src NOT IN (SELECT other FROM hd) THEN src END, ', ' ORDER BY (tier <> 'semantic')::INT, src, tier) AS shown, count(*) FILTER (WHERE src IN (SELECT other FROM hd)) AS gone FROM ce GROUP BY dst), st AS (SELECT id, string_agg(CASE WHEN test <> 't1' THEN test END, ', ' ORDER BY test) AS shown, count(*) FILTER (WHERE test = 't1') AS gone FROM ts GROUP BY id)
SELECT sy.id, kind || ' ' || sy.id || ' in ' || path || ':' || line || '-' || end_line || chr(10) || 'called by: ' || coalesce(sc.shown, 'none recorded') || chr(10) || 'calls: none recorded' || chr(10) || 'tests: ' || coalesce(st.shown, 'none recorded') AS card, coalesce(sc.gone, 0) + coalesce(st.gone, 0) AS dropped FROM sy LEFT JOIN sc ON sc.id = sy.id LEFT JOIN st ON st.id = sy.id""")
def symbol_cards(spark, d):
    hidden = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(_cat("supplier:", F.col("s_suppkey")).alias("id")).union(spark.createDataFrame([("t1",)], "id string"))
    return corpus.symbol_cards(_index(spark, d), hidden)


@query("answer_rows", f"""{WITH}, {IDX}, {HID}, im AS (SELECT 'part:' || p_partkey AS id, p_brand AS m FROM part WHERE p_size < 20) SELECT id, 'defines' AS family, path || ':' || line AS items, 0 AS dropped FROM sy
UNION ALL SELECT sy.id, 'callers', coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM ce WHERE ce.dst = sy.id AND tier = 'semantic' AND src NOT IN (SELECT other FROM hd)), ''), (SELECT count(*) FROM ce WHERE ce.dst = sy.id AND tier = 'semantic' AND src IN (SELECT other FROM hd)) FROM sy WHERE kind = 'function'
UNION ALL SELECT id, 'callees', '', 0 FROM sy WHERE kind = 'function' UNION ALL SELECT sy.id, 'tests', coalesce(tests, ''), 0 FROM sy LEFT JOIN tt ON tt.id = sy.id UNION ALL SELECT sy.id, 'impact', coalesce(m, ''), 0 FROM sy LEFT JOIN im ON im.id = sy.id""")
def answer_rows(spark, d):
    hidden = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(_cat("supplier:", F.col("s_suppkey")).alias("id")).union(spark.createDataFrame([("t1",)], "id string"))
    impact = table(spark, d, "part").filter("p_size < 20").select(_cat("part:", F.col("p_partkey")).alias("id"), F.array("p_brand").alias("modules"))
    return corpus.answers(_index(spark, d), hidden, impact).withColumn("items", F.array_join("items", ","))


@query("distractors", """WITH s AS (SELECT 'm.' || q AS id, 'm' AS module, q AS qualname, string_split(q, '.')[-1] AS name FROM (SELECT 'C' || (p_partkey % 4) || '.' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 5 = 0 THEN '2' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '_v2' ELSE '' END AS q FROM part) GROUP BY q), k AS (SELECT id AS n FROM s UNION SELECT name FROM s UNION SELECT qualname FROM s UNION SELECT module FROM s),
o AS (SELECT id, split_part(qualname, '.', 1) AS head, unnest([CASE WHEN name[1] = upper(name[1]) THEN lower(name[1]) ELSE upper(name[1]) END || name[2:], name || '2', name || '_v2', 'get_' || name, name || '_impl'] || CASE WHEN contains(name, '_') THEN [name || 's', regexp_replace(name, '_[^_]*$', '') || '_new_' || string_split(name, '_')[-1]] ELSE [] END) AS fake, unnest(range(0, 7)) AS pos FROM s),
c AS (SELECT *, 'm.' || head || '.' || fake AS fid FROM o WHERE fake IS NOT NULL AND fake NOT IN (SELECT n FROM k) AND head || '.' || fake NOT IN (SELECT n FROM k) AND 'm.' || head || '.' || fake NOT IN (SELECT n FROM k) AND 'm.' || head || '.' || fake NOT IN (SELECT 'm.' || qualname FROM (SELECT 'C1.Cold_widget' AS qualname))) SELECT s.id, (SELECT arg_min(fid, pos) FROM c WHERE c.id = s.id) AS fake FROM s""")
def distractors(spark, d):
    key = F.col("p_partkey")
    qual = _cat("C", key % 4, ".", F.replace("p_name", F.lit(" "), F.lit("_")), F.when(key % 5 == 0, "2").otherwise(""), F.when(key % 7 == 0, "_v2").otherwise(""))
    s = table(spark, d, "part").select(qual.alias("qualname")).distinct()
    s = s.select(_cat("m.", F.col("qualname")).alias("id"), F.lit("m").alias("module"), "qualname", F.element_at(F.split("qualname", "[.]"), -1).alias("name"))
    return corpus.distractors(s, spark.createDataFrame([("m.C1.Cold_widget",)], "id string"))


REPLY = """rc AS (SELECT o_orderkey AS item, (['callers', 'absent', 'defines', 'tests'])[(o_orderkey % 4 + 1)::INT] AS family, CASE WHEN o_orderkey % 3 = 0 THEN 'There is none.' WHEN o_orderkey % 3 = 1 THEN 'fa' || (o_custkey % 5) || ' and fb' || (o_custkey % 7) ELSE 'see src/x.py' END AS reply, CASE WHEN o_orderkey % 5 = 0 THEN []::VARCHAR[] ELSE ['fa' || (o_custkey % 3), 'fb' || (o_custkey % 7)] END AS truth FROM orders),
fo AS (SELECT rc.*, len(list_filter(truth, lambda t: contains(reply, t))) AS found, CASE WHEN o.off IS NOT NULL AND len(list_filter(truth, lambda t: contains(t, o.off))) = 0 THEN 1 ELSE 0 END AS extra FROM rc LEFT JOIN (SELECT o_orderkey AS item, 'fa' || (o_custkey % 5) AS off FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) o ON o.item = rc.item),
sc AS (SELECT item, family, found, extra, CASE family WHEN 'absent' THEN CASE WHEN reply = 'There is none.' AND extra = 0 THEN 1.0 ELSE 0.0 END WHEN 'defines' THEN CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN len(truth) = 0 THEN CASE WHEN extra = 0 THEN 1.0 ELSE 0.0 END WHEN found = 0 THEN 0.0 ELSE round(2 * (found / (found + extra)) * (found / len(truth)) / (found / (found + extra) + found / len(truth)), 4) END END::DOUBLE AS score FROM fo)"""


def _scored(spark, d):
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    family = F.element_at(F.array(*map(F.lit, ("callers", "absent", "defines", "tests"))), (k % 4 + 1).cast("int"))
    reply = F.when(k % 3 == 0, "There is none.").when(k % 3 == 1, _cat("fa", c % 5, " and fb", c % 7)).otherwise("see src/x.py")
    truth = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(_cat("fa", c % 3), _cat("fb", c % 7)))
    records = o.select(k.alias("item"), family.alias("family"), reply.alias("reply"), truth.alias("truth"))
    offers = o.filter("o_orderkey % 3 = 1 and o_orderkey % 2 = 0").select(k.alias("item"), _cat("fa", c % 5).alias("name"))
    return corpus.score_replies(records, offers)


@query("reply_scores", f"WITH {REPLY} SELECT item, family, found::INT AS found, extra::BIGINT AS extra, score FROM sc")
def reply_scores(spark, d):
    return _scored(spark, d)


@query("score_summary", f"WITH {REPLY} SELECT family, count(*) AS n, round(avg(score), 4) AS mean FROM sc GROUP BY family UNION ALL SELECT 'navigation', count(*), round(avg(score), 4) FROM sc WHERE family <> 'absent' UNION ALL SELECT 'absent-accepted', count(*), round(1 - avg(score), 4) FROM sc WHERE family = 'absent'")
def score_summary(spark, d):
    return corpus.summarise(_scored(spark, d))


@query("path_tokens", "SELECT page_id, array_to_string(list_distinct_ordered, ',') AS tokens FROM (SELECT page_id, list_transform(list_filter(list_transform(range(1, len(f) + 1), lambda i: {'i': i, 't': f[i]}), lambda e: list_position(f, e.t) = e.i), lambda e: e.t) AS list_distinct_ordered FROM (SELECT page_id, list_transform(regexp_extract_all(url, '[\\w./-]*\\w\\.\\w+'), lambda t: regexp_replace(t, '^\\./', '')) AS f FROM pages))")
def path_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(corpus.path_tokens(F.col("url")), ",").alias("tokens"))


@query("body_hash_duplicates", "WITH b AS (SELECT source AS repo, sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents) SELECT repo, count(*) AS bodies, count(DISTINCT h) AS \"distinct\", count(*) - count(DISTINCT h) AS repeated FROM b WHERE h IS NOT NULL GROUP BY repo UNION ALL SELECT 'total', count(*), count(DISTINCT h), count(*) - count(DISTINCT h) FROM b WHERE h IS NOT NULL")
def body_hash_duplicates(spark, d):
    return corpus.body_duplicates(table(spark, d, "documents").filter("text is not null").select(F.col("source").alias("repo"), F.col("text").alias("body")))


@query("isa_families", "WITH m AS (SELECT p_partkey::VARCHAR AS id, replace(p_name, ' ', '_') AS base, (['sse2', 'avx', 'neon', 'plain'])[(p_partkey % 4 + 1)::INT] AS isa FROM part) SELECT base || '_*_' || 'f32' AS family, string_agg(id, ',' ORDER BY id) AS members FROM m WHERE isa <> 'plain' GROUP BY base HAVING count(DISTINCT isa) >= 2")
def isa_families(spark, d):
    p, key = table(spark, d, "part"), F.col("p_partkey")
    isa = F.element_at(F.array(*map(F.lit, ("sse2", "avx", "neon", "plain"))), (key % 4 + 1).cast("int"))
    return corpus.name_families(p.select(key.cast("string").alias("id"), _cat(F.replace("p_name", F.lit(" "), F.lit("_")), "_", isa, "_f32").alias("name")), ["sse2", "avx", "neon"]).withColumn("members", F.array_join("members", ","))


@query("strip_comments", "SELECT doc_id, replace(replace(t, '/* a */', ' '), '\"q\"', '\"\"') AS body FROM (SELECT doc_id, 'x /* a */ y \"q\" ' || source || chr(10) || 'z' AS t FROM documents)")
def strip_comments(spark, d):
    return table(spark, d, "documents").select("doc_id", corpus.strip_comments(F.concat(F.lit('x /* a */ y "q" '), "source", F.lit("\nz"))).alias("body"))
