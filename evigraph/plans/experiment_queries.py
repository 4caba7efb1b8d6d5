"""Queries of experiment records: order lines as answers of arms, orders as runs and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import experiments as ex
from evigraph.plans.registry import query
from evigraph.sources.domain import table

ROWS = "rows_ AS (SELECT l_returnflag AS arm, 'c' || (l_orderkey % 50) AS cell, (l_linenumber - 1) AS sample, (l_quantity::INT % 4) AS round, CASE l_suppkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'pass' WHEN 2 THEN 'wrong' WHEN 3 THEN 'compile' END AS class FROM lineitem)"


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _rows(spark, d):
    k = F.col("l_suppkey") % 5
    cls = F.when(k < 2, "pass").when(k == 2, "wrong").when(k == 3, "compile")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), _cat("c", F.col("l_orderkey") % 50).alias("cell"), (F.col("l_linenumber") - 1).alias("sample"), (F.col("l_quantity").cast("int") % 4).alias("round"), cls.alias("class"))


CELLS = f"{ROWS}, cl AS (SELECT arm, cell, count(*) AS n_rows, max(CASE WHEN sample = 0 THEN (class IS NOT NULL AND class = 'pass')::INT END) AS greedy, count(*) FILTER (WHERE sample > 0) AS n, count(*) FILTER (WHERE sample > 0 AND class = 'pass') AS c FROM rows_ GROUP BY ALL)"
AT_2 = "CASE WHEN n >= 2 THEN 1 - (n - c) * (n - c - 1) / (n * (n - 1)) END"


@query("arm_figures", f"WITH {CELLS} SELECT arm, count(*) AS cells, sum(n_rows)::BIGINT AS rows, round(avg(greedy), 6) AS pass_at_1, round(avg(CASE WHEN n > 0 THEN c / n END), 6) AS pass_at_1_sampled, round(avg({AT_2}), 6) AS pass_at_k, count({AT_2}) AS pass_at_k_cells FROM cl GROUP BY arm")
def arm_figures(spark, d):
    rows = _rows(spark, d).withColumn("class", F.coalesce("class", F.lit("ungraded")))
    return ex.arm_figures(rows, 2)


@query("class_counts", f"WITH {ROWS} SELECT arm, coalesce(class, 'ungraded') AS class, count(*) AS n FROM rows_ GROUP BY ALL")
def class_counts(spark, d):
    return ex.class_counts(_rows(spark, d))


@query("split_figures", f"WITH {CELLS}, lb AS (SELECT 'c' || n_nationkey AS cell, CASE WHEN n_regionkey < 2 THEN 'memorised' ELSE 'unseen' END AS label FROM nation) SELECT arm, coalesce(label, 'no-evidence') AS label, count(*) AS cells, round(avg(greedy), 6) AS pass_at_1, round(avg(CASE WHEN n > 0 THEN c / n END), 6) AS pass_at_1_sampled FROM cl LEFT JOIN lb ON lb.cell = cl.cell GROUP BY ALL")
def split_figures(spark, d):
    labels = table(spark, d, "nation").select(_cat("c", F.col("n_nationkey")).alias("cell"), F.when(F.col("n_regionkey") < 2, "memorised").otherwise("unseen").alias("label"))
    return ex.split_figures(_rows(spark, d).withColumn("class", F.coalesce("class", F.lit("ungraded"))), labels, 2)


@query("cumulative_rounds", f"WITH {ROWS}, f AS (SELECT cell, sample, min(round) AS r FROM rows_ WHERE class = 'pass' GROUP BY ALL) SELECT i::INT AS round, (SELECT count(*) FROM (SELECT DISTINCT cell, sample FROM rows_ WHERE round = 0)) AS chains, (SELECT count(*) FROM rows_ WHERE round = i) AS answered, (SELECT count(*) FROM f WHERE r <= i) AS passed, round((SELECT count(*) FROM f WHERE r <= i) / (SELECT count(*) FROM (SELECT DISTINCT cell, sample FROM rows_ WHERE round = 0)), 6) AS rate FROM range(0, 4) t(i)")
def cumulative_rounds(spark, d):
    return ex.rounds(_rows(spark, d))


@query("invented_names", "SELECT bucket, name, count(*) AS n FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'other' ELSE 'b' || (p_size % 4) END AS bucket, p_type AS name FROM part UNION ALL SELECT 'kernel', p_brand FROM part WHERE p_size > 20) GROUP BY ALL")
def invented_names(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    first = F.struct(F.when(size % 4 != 0, _cat("b", size % 4)).alias("bucket"), F.col("p_type").alias("name"))
    second = F.struct(F.lit("kernel").alias("bucket"), F.col("p_brand").alias("name"))
    return ex.invented_names(p.select(F.when(size > 20, F.array(first, second)).otherwise(F.array(first)).alias("invented")))


@query("discordant_table", """WITH RECURSIVE r AS (SELECT d.lang, l.quality = 1 AS was, l.toxic = 1 AS now FROM labels l JOIN documents d ON d.doc_id = l.doc_id), c AS (SELECT lang, count(*) AS cells, count(*) FILTER (WHERE was AND now) AS both, count(*) FILTER (WHERE NOT was AND NOT now) AS neither, count(*) FILTER (WHERE was AND NOT now) AS lost, count(*) FILTER (WHERE NOT was AND now) AS gained FROM r GROUP BY lang),
t AS (SELECT lang, lost, gained, 0 AS i, (-(lost + gained) * ln(2))::DOUBLE AS term FROM c UNION ALL SELECT lang, lost, gained, i + 1, term + ln(lost + gained - i) - ln(i + 1) FROM t WHERE i < least(lost, gained)), p AS (SELECT lang, least(1.0, 2 * sum(exp(term))) AS p FROM t GROUP BY lang)
SELECT c.*, round((gained - lost) / cells, 6) AS delta, round(CASE WHEN lost + gained = 0 THEN 1.0 ELSE p.p END::DOUBLE, 6) AS p FROM c JOIN p ON p.lang IS NOT DISTINCT FROM c.lang""")
def discordant_table(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return ex.discordant(r, F.col("quality") == 1, F.col("toxic") == 1, ["lang"])


@query("paired_cells", f"""WITH {CELLS}, a AS (SELECT * FROM cl WHERE arm = 'A' AND cell < 'c40'), b AS (SELECT * FROM cl WHERE arm = 'R' AND cell > 'c12'), s AS (SELECT a.greedy AS ag, b.greedy AS bg, a.n AS an, a.c AS ac, b.n AS bn, b.c AS bc FROM a JOIN b USING (cell))
SELECT (SELECT count(*) FROM a FULL JOIN b USING (cell) WHERE a.arm IS NULL OR b.arm IS NULL) AS unpaired, (SELECT count(*) FROM s WHERE ag IS NOT NULL AND bg IS NOT NULL) AS g_cells, (SELECT count(*) FROM s WHERE ag = 1 AND bg = 0) AS g_lost, (SELECT count(*) FROM s WHERE ag = 0 AND bg = 1) AS g_gained, (SELECT count(*) FROM s WHERE an > 0 AND bn > 0) AS s_cells, (SELECT round(avg(bc / bn - ac / an), 6) FROM s WHERE an > 0 AND bn > 0) AS s_delta, (SELECT count(*) FROM s WHERE an > 0 AND bn > 0 AND bc * an <> ac * bn) AS s_moved""")
def paired_cells(spark, d):
    rows = _rows(spark, d).withColumn("class", F.coalesce("class", F.lit("ungraded")))
    return ex.paired(rows.filter("arm = 'A' and cell < 'c40'"), rows.filter("arm = 'R' and cell > 'c12'"), 3).select("unpaired", "g_cells", "g_lost", "g_gained", "s_cells", "s_delta", "s_moved")


@query("pooled_last_rows", f"WITH {ROWS}, p AS (SELECT arm, cell || '/' || arm AS cell, sample, max(round) AS round, count(*) AS k FROM rows_ WHERE round <= 2 GROUP BY ALL) SELECT arm, cell, sample, round FROM p")
def pooled_last_rows(spark, d):
    rows = ex.pooled(_rows(spark, d).withColumnsRenamed({"cell": "isa"}).withColumn("unit", F.col("arm"))).select("arm", "cell", "sample", "round", "class")
    return ex.last_rows(rows, 2).select("arm", "cell", "sample", "round")


@query("runs_comparable", "SELECT 'status' AS setting, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS values_ FROM orders UNION ALL SELECT 'priority', string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders")
def runs_comparable(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.lit("m1").alias("model"))
    return ex.comparable(runs, ["status", "priority", "model"]).select("setting", F.array_join("values", ",").alias("values_"))


@query("flips", f"WITH {ROWS}, b AS (SELECT cell, min(class) AS was FROM rows_ WHERE arm = 'A' AND sample = 0 GROUP BY cell), a AS (SELECT cell, min(class) AS now FROM rows_ WHERE arm = 'R' AND sample = 0 AND round > 1 GROUP BY cell) SELECT cell, was, now FROM b JOIN a USING (cell) WHERE was IS DISTINCT FROM now")
def flips(spark, d):
    rows = _rows(spark, d)
    return ex.flips(rows.filter("arm = 'A'"), rows.filter("arm = 'R' and round > 1"))


@query("experiment_report", """WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'pure' WHEN 'O' THEN 'harness' ELSE 'aided' END AS arm, 'm' || (o_custkey % 4) AS model, CASE WHEN o_orderkey % 10 < 8 THEN o_totalprice > 40000 + 30000 * (o_custkey % 4) END AS solved FROM orders),
x AS (SELECT model, round(avg(CASE WHEN arm = 'pure' THEN solved::INT END), 4) AS first, round(avg(CASE WHEN arm = 'harness' THEN solved::INT END), 4) AS second FROM r GROUP BY model), t AS (SELECT max(first) AS top FROM x), bb AS (SELECT max(model) AS best FROM x, t WHERE first = top)
SELECT model, first, second, round(second - first, 4) AS delta, CASE WHEN model <> best THEN round((second - first) / nullif(top - first, 0), 4) END AS gap_closed FROM x, t, bb""")
def experiment_report(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_custkey") % 4
    arm = F.when(F.col("o_orderstatus") == "F", "pure").when(F.col("o_orderstatus") == "O", "harness").otherwise("aided")
    solved = F.when(F.col("o_orderkey") % 10 < 8, F.col("o_totalprice") > 40000 + 30000 * k)
    return ex.report(o.select(arm.alias("arm"), _cat("m", k).alias("model"), solved.alias("solved")))


@query("planner_split", """WITH r AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS s, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus = 'F' END AS solved, o_custkey % 3 <> 0 AS gold, o_custkey % 5 = 1 AS hit, (o_custkey % 7) / 6 AS recall FROM orders)
SELECT coalesce(s, 'none') AS seed_source, count(solved) AS judged, count(*) FILTER (WHERE solved) AS solved, count(*) FILTER (WHERE gold) AS checked, count(*) FILTER (WHERE gold AND hit) AS hits, round(avg(CASE WHEN gold THEN recall END), 4) AS recall, round(count(*) FILTER (WHERE solved) / nullif(count(solved), 0), 4) AS rate, round(count(*) FILTER (WHERE gold AND hit) / nullif(count(*) FILTER (WHERE gold), 0), 4) AS hit_rate FROM r GROUP BY 1""")
def planner_split(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    rec = o.select(F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("seed_source"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus") == "F").alias("solved"), (k % 3 != 0).alias("gold"), (k % 5 == 1).alias("hit"), ((k % 7) / 6).alias("recall"))
    return ex.planner_split(rec)


@query("meter_add", "WITH m AS (SELECT o_custkey AS run, o_orderkey % 3 AS envelopes, CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 3 = 0 THEN o_orderkey END AS tokens, CASE WHEN o_orderkey % 40 <> 1 THEN o_orderkey % 100 END AS cost FROM orders) SELECT run, sum(envelopes)::BIGINT AS envelopes, CASE WHEN count(*) FILTER (WHERE envelopes > 0 AND tokens IS NULL) = 0 THEN coalesce(sum(tokens) FILTER (WHERE envelopes > 0), 0)::BIGINT END AS tokens, CASE WHEN count(*) FILTER (WHERE envelopes > 0 AND cost IS NULL) = 0 THEN coalesce(sum(cost) FILTER (WHERE envelopes > 0), 0)::BIGINT END AS cost FROM m GROUP BY run")
def meter_add(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return ex.add_meters(o.select(F.col("o_custkey").alias("run"), (k % 3).alias("envelopes"), F.when((F.col("o_orderstatus") != "P") | (k % 3 == 0), k).alias("tokens"), F.when(k % 40 != 1, k % 100).alias("cost")))


@query("run_totals", "SELECT l_orderkey % 100 AS run, count(*) AS calls, sum(coalesce(CASE WHEN l_linenumber < 6 THEN l_linenumber END, 0))::BIGINT AS requests, sum(l_partkey)::BIGINT AS tokens_in, sum(l_suppkey)::BIGINT AS tokens_out, round(sum(l_quantity), 3) AS seconds, round(sum(l_tax), 6) AS cost, count(*) FILTER (WHERE l_returnflag = 'N') AS estimated FROM lineitem GROUP BY 1")
def run_totals(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("run"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("requests"), F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"), F.col("l_quantity").alias("seconds"), F.col("l_tax").alias("cost"), F.when(F.col("l_returnflag") == "N", "estimated").otherwise("billed").alias("cost_source"))
    return ex.run_totals(li)


ARMS = "rw AS (SELECT l_returnflag = 'A' AS adapter, CASE WHEN l_linestatus = 'O' THEN 'bare' ELSE 'aided' END AS prompt, 'u' || l_partkey AS unit, l_quantity AS value, l_linenumber = 4 AS skipped FROM lineitem), arm_t AS (SELECT CASE WHEN adapter THEN 'A' ELSE 'B' END || CASE prompt WHEN 'bare' THEN '0' ELSE '1' END AS arm, unit, max(value) AS value FROM rw WHERE NOT skipped GROUP BY ALL)"


def _arms(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "A").alias("adapter"), F.when(F.col("l_linestatus") == "O", "bare").otherwise("aided").alias("prompt"), _cat("u", F.col("l_partkey")).alias("unit"), F.col("l_quantity").alias("value"), (F.col("l_linenumber") == 4).alias("skipped"))
    return ex.arm_table(rows, spark.createDataFrame([("A0", True, "bare"), ("A1", True, "aided"), ("B0", False, "bare"), ("B1", False, "aided")], "arm string, adapter boolean, prompt string"))


@query("arm_table", f"WITH {ARMS} SELECT * FROM arm_t")
def arm_table(spark, d):
    return _arms(spark, d)


@query("compare_arms", f"WITH {ARMS}, j AS (SELECT x.unit, x.value AS a, y.value AS b, x.unit IN (SELECT 'u' || p_partkey FROM part WHERE p_size > 25) AS known FROM arm_t x JOIN arm_t y ON x.unit = y.unit AND x.arm = 'B1' AND y.arm = 'B0'), p AS (SELECT 'all' AS population, * FROM j UNION ALL SELECT CASE WHEN known THEN 'context-known' ELSE 'no-known-file' END, * FROM j) SELECT population, count(*) AS n, round(avg(a), 5) AS mean_a, round(avg(b), 5) AS mean_b, round(avg(a - b), 6) AS delta, count(*) FILTER (WHERE a < b) AS lower, count(*) FILTER (WHERE a > b) AS higher FROM p GROUP BY population")
def compare_arms(spark, d):
    return ex.compare_arms(_arms(spark, d), "B1", "B0", table(spark, d, "part").filter("p_size > 25").select(_cat("u", F.col("p_partkey")).alias("unit")))


NAV = "nv AS (SELECT 'A' || (o_custkey % 3) AS arm, (['callers', 'callees', 'defines', 'absent'])[(o_orderkey % 4 + 1)::INT] AS family, (o_orderkey % 13) / 12 AS score, o_orderkey % 7 <> 0 AS has_truth FROM orders)"


def _nav(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    family = F.element_at(F.array(*map(F.lit, ("callers", "callees", "defines", "absent"))), (k % 4 + 1).cast("int"))
    return o.select(_cat("A", F.col("o_custkey") % 3).alias("arm"), family.alias("family"), ((k % 13) / 12).alias("score"), (k % 7 != 0).alias("has_truth"))


@query("nav_report", f"WITH {NAV} SELECT arm, CASE WHEN family IN ('callers', 'callees') AND NOT has_truth THEN family || '-none' ELSE family END AS family, count(*) AS n, round(avg(score), 4) AS mean FROM nv GROUP BY ALL UNION ALL SELECT arm, 'navigation', count(*), round(avg(score), 4) FROM nv WHERE family <> 'absent' AND (has_truth OR family = 'defines') GROUP BY arm UNION ALL SELECT arm, 'absent-accepted', count(*), round(1 - avg(score), 4) FROM nv WHERE family = 'absent' GROUP BY arm")
def nav_report(spark, d):
    return ex.nav_report(_nav(spark, d))


@query("override_probe", """WITH r AS (SELECT 'm' || (o_custkey % 20) AS module, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 0.5 END AS score, o_orderkey % 3 AS found, o_orderkey % 2 AS extra, CASE WHEN o_orderstatus = 'F' THEN 'There is none.' ELSE 'Noted well' END AS reply FROM orders), dn AS (SELECT 'm' || i AS module, i AS none, 12 AS answers FROM range(0, 15) t(i)), x AS (SELECT r.*, coalesce(none / answers, 0) AS d FROM r LEFT JOIN dn USING (module))
SELECT count(*) AS has_truth, count(*) FILTER (WHERE ov) AS overrides, count(*) FILTER (WHERE score > 0) AS hits, count(*) FILTER (WHERE ov AND d >= 0.5) AS from_heavy, round(avg(d) FILTER (WHERE ov), 4) AS override_density, round(avg(d) FILTER (WHERE score > 0), 4) AS hit_density, count(*) FILTER (WHERE ov AND reply = 'There is none.') AS refusing FROM (SELECT *, score = 0 AND found = 0 AND extra = 0 AS ov FROM x)""")
def override_probe(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(_cat("m", F.col("o_custkey") % 20).alias("module"), F.when(k % 3 == 0, 0.0).otherwise(0.5).alias("score"), (k % 3).alias("found"), (k % 2).alias("extra"), F.when(F.col("o_orderstatus") == "F", "There is none.").otherwise("Noted well").alias("reply"))
    density = spark.range(15).select(_cat("m", F.col("id")).alias("module"), F.col("id").alias("none"), F.lit(12).alias("answers"))
    return ex.override_probe(rows, density)


@query("aggregate_cells", "SELECT 'B' || (l_suppkey % 4) AS block, l_returnflag AS arm, l_linestatus AS key, round(avg(l_tax), 4) AS mean, round(min(l_tax), 4) AS least, round(max(l_tax), 4) AS most, count(l_tax) AS n FROM lineitem GROUP BY ALL")
def aggregate_cells(spark, d):
    return ex.aggregate_cells(table(spark, d, "lineitem").select(_cat("B", F.col("l_suppkey") % 4).alias("block"), F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("key"), F.col("l_tax").alias("value")))


LOSS = "ls AS (SELECT 'B' || (l_suppkey % 2 + 3) AS block, l_returnflag AS arm, l_linenumber AS seed, l_linestatus AS run, (l_orderkey % 40) AS step, max(l_quantity) AS loss FROM lineitem GROUP BY ALL), ck AS (SELECT DISTINCT block, arm, seed, run, (step // 10) * 10 + 5 AS step FROM ls)"


@query("loss_delta", f"WITH {LOSS}, la AS (SELECT c.arm, c.seed, c.run, c.step, max(l.step) AS at FROM ck c JOIN ls l ON l.block = c.block AND l.arm = c.arm AND l.seed = c.seed AND l.run = c.run AND l.step <= c.step WHERE c.block = 'B4' GROUP BY ALL), d AS (SELECT la.arm, la.step, x.loss - y.loss AS d FROM la JOIN ls x ON x.block = 'B4' AND x.arm = la.arm AND x.seed = la.seed AND x.run = la.run AND x.step = la.at JOIN ls y ON y.block = 'B3' AND y.arm = la.arm AND y.seed = la.seed AND y.run = la.run AND y.step = la.at) SELECT arm, step, round(avg(d), 4) AS mean, round(min(d), 4) AS least, round(max(d), 4) AS most, count(*) AS n FROM d GROUP BY ALL")
def loss_delta(spark, d):
    li = table(spark, d, "lineitem")
    losses = li.groupBy(_cat("B", F.col("l_suppkey") % 2 + 3).alias("block"), F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("seed"), F.col("l_linestatus").alias("run"), (F.col("l_orderkey") % 40).alias("step")).agg(F.max("l_quantity").alias("loss"))
    return ex.loss_delta(losses, losses.select("block", "arm", "seed", "run", (F.floor(F.col("step") / 10) * 10 + 5).alias("step")), "B4", "B3")


@query("checkpoint_curve", f"WITH {LOSS} SELECT block, arm, step, 'gold' AS key, round(avg(loss), 4) AS mean FROM ls WHERE loss > 10 GROUP BY ALL")
def checkpoint_curve(spark, d):
    li = table(spark, d, "lineitem")
    losses = li.groupBy(_cat("B", F.col("l_suppkey") % 2 + 3).alias("block"), F.col("l_returnflag").alias("arm"), "l_linenumber", "l_linestatus", (F.col("l_orderkey") % 40).alias("step")).agg(F.max("l_quantity").alias("loss"))
    return ex.checkpoint_curve(losses.select("block", "arm", "step", F.lit("gold").alias("key"), F.when(F.col("loss") > 10, F.col("loss")).alias("value")))


ACTS = "ac AS (SELECT l_orderkey * 10 + l_linenumber AS id, (['ANSWER', 'CANDIDATES', 'UNKNOWN', 'malformed'])[(l_orderkey % 4 + 1)::INT] AS kind, [l_partkey % 5, l_suppkey % 5] AS vals, [l_linenumber % 5] AS gold, l_quantity::BIGINT % 5 AS sibling, l_returnflag AS cls, l_linestatus AS probed, l_extendedprice AS entropy FROM lineitem), gr AS (SELECT *, CASE WHEN kind IN ('malformed', 'UNKNOWN') THEN kind WHEN kind = 'ANSWER' THEN CASE WHEN list_contains(gold, vals[1]) THEN 'ANSWER-correct' WHEN vals[1] = sibling THEN 'ANSWER-wrong/sibling' ELSE 'ANSWER-wrong/other' END WHEN list_contains(gold, vals[1]) THEN 'CANDIDATES-with/1' WHEN list_contains(gold, vals[2]) THEN 'CANDIDATES-with/2' ELSE 'CANDIDATES-without' END AS act FROM ac)"


def _acts(spark, d):
    li = table(spark, d, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("ANSWER", "CANDIDATES", "UNKNOWN", "malformed"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    values, gold = F.array(F.col("l_partkey") % 5, F.col("l_suppkey") % 5), F.array((F.col("l_linenumber") % 5).cast("long"))
    return li.withColumns({"act": ex.grade_act(kind, values, gold, F.col("l_quantity").cast("long") % 5), "true_class": F.col("l_returnflag"), "probed": F.col("l_linestatus"), "entropy": F.col("l_extendedprice")})


@query("grade_acts", f"WITH {ACTS} SELECT cls AS true_class, act, count(*) AS n FROM gr GROUP BY ALL")
def grade_acts(spark, d):
    return _acts(spark, d).groupBy("true_class", "act").agg(F.count("*").alias("n"))


@query("authority_shares", f"WITH {ACTS}, c AS (SELECT probed, act, count(*) AS n FROM gr GROUP BY ALL) SELECT probed, act, round(n / sum(n) OVER (PARTITION BY probed), 4) AS share FROM c")
def authority_shares(spark, d):
    return ex.authority(_acts(spark, d))[0]


@query("authority_bits", f"""WITH {ACTS}, v AS (SELECT entropy AS x, row_number() OVER (ORDER BY entropy) AS r, count(*) OVER () AS n FROM gr), q AS (SELECT (SELECT min(x) FROM v WHERE r = ceil(0.25 * n)) AS a, (SELECT min(x) FROM v WHERE r = ceil(0.5 * n)) AS b, (SELECT min(x) FROM v WHERE r = ceil(0.75 * n)) AS c), z AS (SELECT act, unnest([{{'w': 'probed', 'v': probed}}, {{'w': 'true', 'v': cls}}, {{'w': 'entropy', 'v': ((entropy >= a)::INT + (entropy >= b)::INT + (entropy >= c)::INT)::VARCHAR}}]) AS s FROM gr, q),
j AS (SELECT s.w AS w, s.v AS v, act, count(*) AS n FROM z GROUP BY ALL), m AS (SELECT w, v, act, n, sum(n) OVER (PARTITION BY w, v) AS nv, sum(n) OVER (PARTITION BY w, act) AS na, sum(n) OVER (PARTITION BY w) AS t FROM j) SELECT w AS "with", round(greatest(sum(n / t * log2(n * t / (nv * na))), 0)::DOUBLE, 4) AS bits FROM m GROUP BY w""")
def authority_bits(spark, d):
    return ex.authority(_acts(spark, d))[1]


@query("rank_heads", "SELECT p_brand AS model, p_size AS layer, p_partkey AS head, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size, p_partkey)::INT AS place FROM part")
def rank_heads(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_size").alias("layer"), F.col("p_partkey").alias("head"), F.col("p_retailprice").alias("mass"))
    return ex.rank_heads(p).select("model", "layer", "head", "place")


@query("recall_probe", "WITH w AS (SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ') AS want, string_split(p_type || ' ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'other' END, ' ') AS got FROM part), s AS (SELECT p_partkey, coalesce((SELECT min(i) - 1 FROM (SELECT unnest(range(1, len(want) + 1)) AS i) WHERE want[i] IS DISTINCT FROM got[i]), len(want)) / len(want) AS share FROM w) SELECT p_partkey, round(share, 6) AS share, CASE WHEN share > 0.5 THEN 'memorised' WHEN share < 0.15 THEN 'unseen' ELSE 'neither' END AS label FROM s")
def recall_probe(spark, d):
    p = table(spark, d, "part")
    share = ex.recall_probe(F.concat_ws(" ", "p_type", "p_name"), F.concat_ws("  ", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("other")))
    return p.select("p_partkey", F.round(share, 6).alias("share"), ex.recall_label(share).alias("label"))


@query("identical_at", "WITH d AS (SELECT unnest([DATE '1995-06-30', DATE '1997-01-01', DATE '1991-01-01']) AS date) SELECT date, (SELECT count(*) FROM orders WHERE o_orderdate::DATE <= date) AS n FROM d")
def identical_at(spark, d):
    dates = spark.createDataFrame([("1995-06-30",), ("1997-01-01",), ("1991-01-01",)], "date string").select(F.to_date("date").alias("date"))
    return ex.identical_at(table(spark, d, "orders").select(F.col("o_orderdate").alias("body_since")), dates)


@query("found_files", "WITH l AS (SELECT DISTINCT l_orderkey % 50 AS task, 'f' || l_partkey % 400 || '.c' AS name FROM lineitem), t AS (SELECT DISTINCT l_orderkey % 50 AS task, 'f' || l_suppkey || '.c' AS name FROM lineitem) SELECT l.task, count(*) AS listed, count(t.name) AS found, round(count(t.name) / count(*), 4) AS share FROM l LEFT JOIN t ON t.task = l.task AND t.name = l.name GROUP BY l.task")
def found_files(spark, d):
    li = table(spark, d, "lineitem").withColumn("task", F.col("l_orderkey") % 50)
    return ex.found_files(li.select("task", _cat("a/f", F.col("l_partkey") % 400, ".c").alias("path")), li.select("task", _cat("src/x/f", F.col("l_suppkey"), ".c").alias("path")))


@query("attach_tasks", "WITH u AS (SELECT 'u' || o_orderkey AS unit, sha256('c' || (o_orderkey % 500))[:12] AS commit FROM orders), t AS (SELECT 't' || i AS task, sha256('c' || i)[:(CASE WHEN i % 2 = 0 THEN 8 ELSE 40 END)] AS c FROM range(0, 200) t(i)) SELECT u.unit, u.commit, (SELECT min(task) FROM t WHERE starts_with(u.commit, c) OR starts_with(c, u.commit)) AS task FROM u")
def attach_tasks(spark, d):
    units = table(spark, d, "orders").select(_cat("u", F.col("o_orderkey")).alias("unit"), F.left(F.sha2(_cat("c", F.col("o_orderkey") % 500), 256), F.lit(12)).alias("commit"))
    tasks = spark.range(200).select(_cat("t", F.col("id")).alias("task"), F.left(F.sha2(_cat("c", F.col("id")), 256), F.when(F.col("id") % 2 == 0, 8).otherwise(40)).alias("commit"))
    return ex.attach_tasks(units, tasks).select("unit", "commit", "task")


@query("units_from_history", "SELECT l_orderkey AS commit, 'p' || (l_partkey % 3) AS path, sum(l_linenumber + l_quantity::BIGINT)::BIGINT AS lines FROM lineitem GROUP BY ALL HAVING sum(l_linenumber + l_quantity::BIGINT) BETWEEN 20 AND 60")
def units_from_history(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), _cat("p", F.col("l_partkey") % 3).alias("path"), F.col("l_linenumber").cast("long").alias("added"), F.col("l_quantity").cast("long").alias("removed"))
    return ex.units_from_history(li, 20, 60)
