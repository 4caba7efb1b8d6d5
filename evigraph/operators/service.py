"""What a service shows of a graph, its documents and its sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACES = r"^(ext|env|tf):"


def common_root(ids: DataFrame) -> DataFrame:
    """(root): the leading path segments that all ids with a slash share, never an id's last one, with a slash behind; empty if none.

    Of sorted paths, what the least and the greatest share all share.
    """
    paths = ids.filter(F.col("id").contains("/") & ~F.col("id").rlike(NAMESPACES)).select(F.split("id", "/").alias("p"))
    folders = paths.select(F.slice("p", 1, F.size("p") - 1).alias("p"))
    ends = folders.agg(F.min("p").alias("a"), F.max("p").alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, k: F.when((acc == k - 1) & (k <= n) & (F.get("a", k - 1) == F.get("b", k - 1)), k).otherwise(acc))
    return ends.select(F.when(F.col("a").isNull() | (same == 0), "").otherwise(F.concat(F.array_join(F.slice("a", 1, same), "/"), F.lit("/"))).alias("root"))


def package_of(id_: Column, root: Column) -> Column:
    """A node's group: its namespace, else its first segment below the root, by slash or else by dot."""
    rest = F.when((root != "") & F.startswith(id_, root), F.substr(id_, F.length(root) + 1)).otherwise(id_)
    by_slash, by_dot = F.regexp_extract(rest, "^([^/]+)/", 1), F.regexp_extract(rest, "^([^.]+)[.]", 1)
    return F.when(id_.rlike(NAMESPACES), F.split_part(id_, F.lit(":"), F.lit(1))).when(by_slash != "", by_slash).when(by_dot != "", by_dot).otherwise(rest)


def node_detail(ids: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, part, name, line) of asked nodes: their symbols by line, the edges into them and out of them."""
    own = symbols.join(ids.withColumnRenamed("id", "module"), "module", "left_semi").select(F.col("module").alias("id"), F.lit("symbol").alias("part"), "name", F.col("line").cast("long").alias("line"))
    none = F.lit(None).cast("long").alias("line")
    into = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("id"), F.lit("in").alias("part"), F.col("src").alias("name"), none)
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.lit("out").alias("part"), F.col("dst").alias("name"), none)
    return own.unionByName(into.distinct()).unionByName(out.distinct())


def doc_badges(docs: DataFrame, sources: DataFrame, now: DataFrame) -> DataFrame:
    """docs (kind, id, readable) with status: broken, stale if a source (kind, id, path, hash) has another hash now (path, hash) or is gone, else fresh."""
    s = sources.join(now.select("path", F.col("hash").alias("current")), "path", "left").filter("not hash <=> current")
    changed = s.groupBy("kind", "id").agg(F.array_sort(F.collect_set("path")).alias("changed"))
    out = docs.join(changed, ["kind", "id"], "left")
    status = F.when(~F.col("readable"), "broken").when(F.col("changed").isNotNull(), "stale").otherwise("fresh")
    return out.select("kind", "id", status.alias("status"), F.when(F.col("readable"), F.coalesce("changed", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("changed"))


def behaviours(docs: DataFrame, badges: DataFrame) -> DataFrame:
    """(id, test, text, status): each behaviour that a test document (id, behaviours of test and text) states, as fresh or stale as the document."""
    rows = docs.select("id", F.explode("behaviours").alias("b")).select("id", "b.test", "b.text")
    return rows.join(badges.select("id", F.when(F.col("status") == "stale", "stale").otherwise("fresh").alias("status")), "id")


def sessions(summaries: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """summaries (session, last_seen) with how many of their requests (session, status, deadline) still wait; an overdue one doesn't."""
    waiting = requests.filter((F.col("status") == "pending") & (F.col("deadline").isNull() | (F.col("deadline") > now))).groupBy("session").agg(F.count("*").alias("pending"))
    return summaries.join(waiting, "session", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))


def latest_compaction(messages: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """(session, seq): the last completed compaction of a session (session, seq, type, data) whose provenance is none or agrees with values (session, and each key)."""
    path = lambda p: F.get_json_object("data", p)
    rows = messages.filter((F.col("type") == "compaction") & (path("$.status") == "completed")).join(values, "session", "left")
    same = F.lit(True)
    for k in keys:
        same = same & (path(f"$.providerContext.provenance.{k}") == F.col(k))
    return rows.filter(path("$.providerContext").isNull() | F.coalesce(same, F.lit(False))).groupBy("session").agg(F.max("seq").alias("seq"))


def rule_label(by_default: Column, source: Column, pattern: Column) -> Column:
    return F.when(by_default, F.concat(F.lit("default:"), F.when(F.coalesce(source, F.lit("")) == "", "engine").otherwise(source))).otherwise(F.concat_ws(": ", source, pattern))


def covered(queries: DataFrame, ids: DataFrame, paths: DataFrame) -> DataFrame:
    """queries (manifest, query) with whether it lies in the manifest: an id (manifest, id) or below one, or a path (manifest, path) that
    it is, holds, or begins with."""
    q = F.regexp_replace("query", "/$", "")
    asked = queries.select("manifest", "query").distinct().withColumn("q", q)
    heads = asked.select("manifest", "query", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("query", "[.]"))), lambda k: F.array_join(F.slice(F.split("query", "[.]"), 1, k), "."))).alias("id"))
    by_id = heads.join(ids, ["manifest", "id"], "left_semi").select("manifest", "query")
    ups = paths.select("manifest", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("q")).distinct()
    named = asked.filter(F.col("query").rlike("[/.]"))
    by_path = named.join(ups, ["manifest", "q"], "left_semi").select("manifest", "query")
    # a query that begins with a path: its beginnings at all lengths of the manifest's paths
    sizes = paths.select("manifest", "path", F.length("path").alias("n"))
    within = named.join(sizes.select("manifest", "n").distinct(), "manifest").filter(F.length("q") >= F.col("n")).withColumn("path", F.expr("left(q, n)")).join(sizes, ["manifest", "path"], "left_semi").select("manifest", "query")
    found = by_id.union(by_path).union(within).distinct().withColumn("covered", F.lit(True))
    return asked.join(found, ["manifest", "query"], "left").select("manifest", "query", F.coalesce("covered", F.lit(False)).alias("covered"))


def last_envelope(texts: DataFrame) -> DataFrame:
    """(id, envelope): the last line of a text that is a JSON object of type ``result``."""
    line = texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    held = line.filter(F.startswith("line", F.lit("{"))).filter(F.try_parse_json("line").isNotNull() & (F.get_json_object("line", "$.type") == "result"))
    return texts.select("id").join(held.groupBy("id").agg(F.max_by("line", "pos").alias("envelope")), "id", "left")


def freshness(stamps: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, status) of derived files (repo, name, sha, readable) against heads (repo, head): missing, unreadable, stale, or fresh."""
    by = stamps.groupBy("repo").agg(F.max(F.when(F.col("name") == "graph", F.col("sha"))).alias("graph"), F.bool_or(F.col("name") == "graph").alias("there"), F.bool_and("readable").alias("fine"), F.count_distinct("sha").alias("shas"))
    rows = heads.join(by, "repo", "left")
    status = F.when(F.col("there").isNull() | ~F.col("there"), "missing").when(~F.col("fine"), "unreadable").when(~F.col("graph").eqNullSafe(F.col("head")), "stale").when(F.col("shas") > 1, "stale").otherwise("fresh")
    return rows.select("repo", status.alias("status"))


def name_universes(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(universe, name): every id, module, path, external, qualified and bare name of a graph, each once."""
    internal = nodes.filter(~F.col("id").rlike(NAMESPACES))
    parts = [
        (nodes, "id", "id"), (symbols, "id", "id"), (symbols, "qual", "qualname"), (symbols, "name", "name"), (internal, "module", "id"), (internal.filter("path is not null"), "path", "path"),
    ]
    out = nodes.filter(F.startswith("id", F.lit("ext:"))).select(F.lit("ext").alias("universe"), F.expr("substr(id, 5)").alias("name"))
    for df, universe, column in parts:
        out = out.union(df.select(F.lit(universe), F.col(column)))
    return out.filter("name is not null and name <> ''").distinct()


def group_by(rows: DataFrame, key: Column, value: str, order: list[str]) -> DataFrame:
    """(key, items): values by a key function, in the order of the rows; null is a key of its own."""
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return rows.groupBy(key.alias("key")).agg(F.transform(held, lambda x: x["__v"]).alias("items"))


def report_blocks(records: DataFrame) -> DataFrame:
    """(id, block, name, value): the ``name: value`` lines of every fenced report block in a text."""
    blocks = records.select("id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)```report\\n(.*?)```"), 1)).alias("block", "body"))
    lines = blocks.select("id", "block", F.explode(F.split("body", "\n")).alias("line")).filter(F.col("line").contains(":"))
    return lines.select("id", "block", F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("name"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


def total_variation(seen: DataFrame, expected: DataFrame) -> DataFrame:
    """(world, distance): half the summed differences of two distributions (world, key, share)."""
    both = seen.select("world", "key", F.col("share").alias("a")).join(expected.select("world", "key", F.col("share").alias("b")), ["world", "key"], "full")
    return both.groupBy("world").agg(F.round(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))) / 2, 6).alias("distance"))
