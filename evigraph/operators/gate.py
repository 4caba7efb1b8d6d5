"""Gates over planned edges and diffs: verdicts, sites, partitions, references, requirements, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators.evidence import inside_interval
from evigraph.operators.rules import TESTED_BY_GRAPH, importer_matches, scope_matches
from evigraph.sources.scratch import materialise

# Classes of a diff's references, what they do to a verdict, and which of them a blind spot may hide.
BLOCKING = ["invented", "near-miss", "arity", "undeclared-type", "import-outside", "unimported", "malformed", "partition"]
HIDDEN_BY_BLIND_SPOTS = ["invented", "near-miss"]
SUPPORT_DIRS = ["testdata", "__fixtures__", "__snapshots__"]
#: Places with their symbols that are broadcast at most.
PLACES = 1 << 17


def plan_gate(adds: DataFrame, rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, verdict, invariant) of declared edges (src, dst) under the confirmed forbidden-import rules.

    rules: (id, position, status, kind, scope, importers, imported, except). The
    first rule in their order that forbids an edge fails it; an importer that no
    node holds has no path, so that no scope leaves it out.
    """
    asked = adds.select("src", "dst").distinct()
    held = rules.filter((F.col("status") == "confirmed") & (F.col("kind") == TESTED_BY_GRAPH)).select("id", "position", "scope", "importers", "except", F.explode("imported").alias("dst"))
    hit = asked.join(held, "dst").filter(~F.array_contains("except", F.col("src"))).join(nodes.select(F.col("id").alias("src"), "path"), "src", "left")
    hit = hit.filter(F.col("path").isNull() | scope_matches(F.col("scope"), F.col("path"))).withColumn("pattern", F.explode("importers")).filter(importer_matches(F.col("pattern"), F.col("src")))
    first = hit.groupBy("src", "dst").agg(F.min_by("id", "position").alias("invariant"))
    return asked.join(first, ["src", "dst"], "left").select("src", "dst", F.when(F.col("invariant").isNotNull(), "fail").otherwise("pass").alias("verdict"), "invariant")


def callee_sets(gold: DataFrame, got: DataFrame) -> DataFrame:
    """Per body of gold or got (body, callee): sorted sides, what is missing and extra, and their Jaccard share; two empty sides agree."""
    g, h = (df.filter("callee is not null").select("body", "callee").distinct() for df in (gold, got))
    both = g.withColumn("g", F.lit(True)).join(h.withColumn("h", F.lit(True)), ["body", "callee"], "full")
    side = lambda rule: F.array_sort(F.collect_list(F.when(rule, F.col("callee"))))
    in_g, in_h = F.col("g").isNotNull(), F.col("h").isNotNull()
    out = both.groupBy("body").agg(side(in_g).alias("gold"), side(in_h).alias("got"), side(in_g & ~in_h).alias("missing"), side(in_h & ~in_g).alias("extra"), F.round(F.count_if(in_g & in_h) / F.count("*"), 6).alias("jaccard"))
    none = F.array().cast("array<string>")
    bodies = gold.select("body").union(got.select("body")).distinct().join(out, "body", "left")
    return bodies.select("body", *(F.coalesce(c, none).alias(c) for c in ("gold", "got", "missing", "extra")), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))


def outcome(compiled: Column, invented: Column, installed: Column, crashed: Column, bulk_failed: Column, edge_failed: Column) -> Column:
    """A body's failure class: what stops it first."""
    return (
        F.when(~compiled & (invented > 0), "invented").when(~compiled, "compile").when(~installed, "not-installed").when(crashed | (bulk_failed > 0), "wrong").when(edge_failed > 0, "edge").otherwise("pass")
    )


def resolve_references(refs: DataFrame, defined: DataFrame, names: DataFrame) -> DataFrame:
    """refs (doc, ref) with class: defined by the document itself, in-graph, unverifiable (of an external import), or hallucinated.

    defined: (doc, name). names: (universe, name) with the universes id, qual,
    module, path, name and ext.
    """
    rows = refs.select("doc", "ref").distinct()
    head, last, before = F.split_part("ref", F.lit("."), F.lit(1)), F.element_at(F.split("ref", "[.]"), -1), F.regexp_replace("ref", r"[.][^.]*$", "")
    rows = rows.withColumns({"head": head, "last": last, "before": before, "dotted": F.col("ref").contains(".")})
    own = rows.withColumn("name", F.explode(F.array_distinct(F.array("ref", "head", "last")))).join(defined.select("doc", "name").distinct(), ["doc", "name"], "left_semi").select("doc", "ref").distinct().withColumn("own", F.lit(True))
    known = {u: names.filter(F.col("universe") == u).select("name").distinct() for u in ("id", "qual", "module", "path", "name", "ext")}
    whole = known["id"].union(known["qual"]).union(known["module"]).union(known["path"]).distinct()
    tails = known["path"].select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "/"))), lambda k: F.array_join(F.slice(F.split("name", "/"), k, F.size(F.split("name", "/"))), "/"))).alias("name")).distinct()
    last_of_module = known["module"].select(F.element_at(F.split("name", "[.]"), -1).alias("name")).union(known["module"]).distinct()

    def mark(df: DataFrame, column: str, table: DataFrame, flag: str) -> DataFrame:
        return df.join(table.select(F.col("name").alias(column)).withColumn(flag, F.lit(True)), column, "left")

    rows = rows.join(own, ["doc", "ref"], "left")
    for column, table, flag in (("ref", whole, "whole"), ("ref", known["name"], "bare"), ("ref", tails, "tail"), ("head", known["ext"], "ext_head"), ("before", known["ext"], "ext_before"), ("last", known["name"], "last_named"), ("head", last_of_module, "head_module")):
        rows = mark(rows, column, table, flag)
    yes = lambda c: F.col(c).isNotNull()
    file = F.col("ref").rlike(r"\.(py|go|ts)$")
    cls = (
        F.when(yes("own"), "defined").when(yes("whole"), "in-graph").when(~F.col("dotted") & yes("bare"), "in-graph").when(file, F.when(yes("tail"), "in-graph").otherwise("hallucinated"))
        .when(F.col("dotted") & (yes("ext_head") | yes("ext_before")), "unverifiable").when(F.col("dotted") & yes("last_named") & yes("head_module"), "in-graph").otherwise("hallucinated")
    )
    return rows.select("doc", "ref", cls.alias("class"))


def sites_of(refs: DataFrame, files: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """refs (ref, path, action, parent, whole) with the map's statement of their place: grain, id, captured, reason.

    In order: a line of the map (path, line, reason) that a replacing reference
    stands on; the innermost symbol (path, id, start, end, captured, reason) that
    holds its anchor, an insertion needing the line before and the one after; its
    file (path, captured, reason); else the file is unmapped. whole: the file is
    new or renamed, and only its own entry counts. Of symbols with the same lines,
    the one with the highest place in the map counts, where symbols have a place;
    then the least id. Symbols meet the distinct places of references, not each.
    """
    symbols = symbols.select("path", "id", "start", "end", "captured", "reason", (F.col("place") if "place" in symbols.columns else F.lit(0)).alias("place"))
    rows = refs.join(files.select("path", F.col("captured").alias("f_captured"), F.col("reason").alias("f_reason")), "path", "left")
    anchored = F.col("f_captured").isNotNull() & ~F.col("whole") & F.col("parent").isNotNull()
    at_line = lines.filter("line is not null").groupBy("path", F.col("line").alias("parent")).agg(F.min("reason").alias("l_reason")).withColumn("l", F.lit(True))
    rows = rows.join(at_line, ["path", "parent"], "left").withColumn("by_line", anchored & (F.col("action") == "replace") & F.col("l").isNotNull())
    symbols = symbols.groupBy("path", "start", "end").agg(F.min_by(F.struct("id", "captured", "reason"), F.struct((-F.col("place")).alias("p"), "id")).alias("s"))
    rows = rows.withColumns({"asked": anchored & ~F.col("by_line"), "replaces": F.col("action") == "replace"})
    points = rows.filter("asked").select("path", "parent", "replaces").distinct()  # a place is looked up once, however many references stand there
    hit = inside_interval(points, symbols, "path", "parent", "start", "end", 256).filter("replaces or parent + 1 <= end")
    best = hit.groupBy("path", "parent", "replaces").agg(F.min_by("s", F.struct((F.col("end") - F.col("start")).alias("w"), "start")).alias("s"))
    best = materialise(best.withColumn("asked", F.lit(True)), "places")
    held = best.count() <= PLACES
    rows = rows.join(F.broadcast(best) if held else best, ["path", "parent", "replaces", "asked"], "left")
    pick = lambda line, symbol, file, none: F.when(F.col("by_line"), line).when(F.col("s").isNotNull(), symbol).when(F.col("f_captured").isNotNull(), file).otherwise(none)
    return rows.select(
        "ref", pick(F.lit("site"), F.lit("symbol"), F.lit("file"), F.lit("file")).alias("grain"), pick(F.concat_ws(":", "path", "parent"), F.col("s.id"), F.col("path"), F.col("path")).alias("id"),
        pick(F.lit(False), F.col("s.captured"), F.col("f_captured"), F.lit(False)).alias("captured"),
        pick(F.col("l_reason"), F.when(~F.col("s.captured"), F.col("s.reason")), F.when(~F.col("f_captured"), F.col("f_reason")), F.lit("unmapped")).alias("reason"),
    )


def diff_gate(refs: DataFrame, sites: DataFrame, touched: DataFrame, partition: DataFrame) -> DataFrame:
    """(diff, verdict, blocking, unknown, routed, allowed) from references, their sites and the files that diffs touch.

    refs: (ref, diff, class); touched: (diff, path, created, is_code). In a blind
    spot an invented name or a near miss is unknown and blocks nothing; ``new``
    is routed. A file outside the partition (path) blocks, unless it isn't code,
    is test support, or is created beside a file of the partition.
    """
    named = refs.join(sites.select("ref", "captured"), "ref", "left")
    blind = F.col("class").isin(HIDDEN_BY_BLIND_SPOTS) & ~F.coalesce("captured", F.lit(False))
    fate = F.when(F.col("class") == "new", "routed").when(blind, "unknown").when(F.col("class").isin(BLOCKING), "blocking").otherwise("clear")
    rows = named.select("diff", fate.alias("fate"))
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    outside = touched.join(partition.select("path"), "path", "left_anti").withColumn("folder", folder("path"))
    beside = partition.select(folder("path").alias("folder")).distinct().withColumn("beside", F.lit(True))
    outside = outside.join(beside, "folder", "left")
    support = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SUPPORT_DIRS))) | F.col("path").rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.\w+$")
    free = ~F.col("is_code") | support | (F.col("created") & F.col("beside").isNotNull())
    rows = rows.union(outside.select("diff", F.when(free, "allowed").otherwise("blocking")))
    n = lambda name: F.count_if(F.col("fate") == name).alias(name)
    out = rows.groupBy("diff").agg(*(n(x) for x in ("blocking", "unknown", "routed", "allowed")))
    every = refs.select("diff").union(touched.select("diff")).distinct().join(out, "diff", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("blocking", "unknown", "routed", "allowed")}
    return every.withColumns(counts).withColumn("verdict", F.when(F.col("blocking") > 0, "blocked").otherwise("clear"))


def map_defects(files: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(what, id, defect): everything that makes a blind-spot map unusable."""
    twice = files.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("file").alias("what"), F.col("path").alias("id"), F.lit("listed twice").alias("defect"))
    mute = files.filter("not captured and (reason is null or reason = '')").select(F.lit("file"), "path", F.lit("no reason"))
    lost = lambda df, what, c: df.join(files.select("path"), "path", "left_anti").select(F.lit(what), c, F.lit("unknown file"))
    bad = symbols.filter("start is null or end is null or start < 1 or end < start").select(F.lit("symbol"), "id", F.lit("bad span"))
    place = F.concat_ws(":", "path", F.col("line").cast("string")).alias("id")
    return twice.union(mute).union(lost(symbols, "symbol", "id")).union(bad).union(lost(lines, "site", place)).union(lines.filter("line < 1").select(F.lit("site"), place, F.lit("bad line")))


def unresolved_by_file(lines: DataFrame, touched: DataFrame) -> DataFrame:
    """(path, class, n): the map's counts without a line, of the files that a diff touches."""
    own = lines.filter("line is null").join(touched.select("path").distinct(), "path", "left_semi")
    return own.groupBy("path", F.coalesce("class", F.lit("unclassed")).alias("class")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))


def input_hashes(inputs: DataFrame) -> DataFrame:
    """(name, sha256) of inputs (name, content); content that isn't given has no hash."""
    return inputs.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def partition_hash(partition: DataFrame) -> DataFrame:
    """(sha256) of a partition's distinct paths as one sorted JSON list."""
    return partition.select("path").distinct().agg(F.sha2(F.to_json(F.array_sort(F.collect_list("path"))), 256).alias("sha256"))


def content_key(statement: Column, scope: Column) -> Column:
    """The identity of an invariant: its words and scope, however they're spaced."""
    words = F.trim(F.regexp_replace(F.coalesce(statement, F.lit("")), r"\s+", " "))
    return F.concat(F.lit("sha256:"), F.left(F.sha2(F.concat(words, F.lit("\n"), F.trim(F.coalesce(scope, F.lit("")))), 256), F.lit(32)))


def pending(inferred: DataFrame, ledger: DataFrame) -> DataFrame:
    """inferred (position, id, statement, scope) without a verdict in the ledger (key), with their key; a changed text is asked again."""
    return inferred.withColumn("key", content_key(F.col("statement"), F.col("scope"))).join(ledger.select("key").distinct(), "key", "left_anti")


def readiness(waiting: DataFrame, intents: DataFrame) -> DataFrame:
    """(ready, pending): whether the intent (confirmed) is confirmed and nothing is pending."""
    left = waiting.agg(F.count("*").alias("pending"))
    sure = intents.agg(F.coalesce(F.bool_or("confirmed"), F.lit(False)).alias("sure"))
    return left.join(sure, how="cross").select((F.col("sure") & (F.col("pending") == 0)).alias("ready"), "pending")


def nearest_confirmed(waiting: DataFrame, confirmed: DataFrame) -> DataFrame:
    """waiting (id, scope) with the confirmed invariant whose scope is the deepest one around theirs, ties to the lesser id."""
    parts = F.split("scope", "/")
    chain = waiting.select("id", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("k"), "scope").withColumn("at", F.array_join(F.slice(F.split("scope", "/"), 1, F.col("k")), "/"))
    near = chain.join(confirmed.select(F.col("id").alias("neighbour"), F.col("scope").alias("at")), "at").filter("neighbour <> id")
    return waiting.join(near.groupBy("id").agg(F.min_by("neighbour", F.struct((-F.col("k")).alias("k"), "neighbour")).alias("neighbour")), "id", "left")


def assign_requirements(requirements: DataFrame, files: DataFrame, interiors: DataFrame, planned: DataFrame, mode: str = "strict") -> DataFrame:
    """(plan, id, unit, source): each requirement's owning units, by the files it names, else the one unit of the whole plan.

    requirements: (plan, id); files: (plan, id, file); interiors: (plan, unit,
    path); planned: (plan, pos, file). A file is a unit's if it's one of its paths
    or the end of one, or the other way round. unit is null for one without an
    owner; in mode ``assign`` the unit of the plan's first owned file takes it.
    """
    def owners(named: DataFrame) -> DataFrame:
        clean = named.withColumn("bare", F.regexp_replace(F.trim("file"), r"^[./]+", ""))
        name = F.element_at(F.split("bare", "/"), -1)
        held = interiors.select("plan", "unit", F.col("path").alias("held"), F.element_at(F.split("path", "/"), -1).alias("name"))
        same = (F.col("held") == F.col("bare")) | F.endswith("held", F.concat(F.lit("/"), "bare")) | F.endswith("bare", F.concat(F.lit("/"), "held"))
        return clean.withColumn("name", name).join(held, ["plan", "name"]).filter(same)

    by_file = owners(files).select("plan", "id", "unit").distinct().withColumn("source", F.lit("named-file"))
    plan_units = owners(planned)
    alone = plan_units.groupBy("plan").agg(F.count_distinct("unit").alias("n"), F.min("unit").alias("unit"), F.min_by("unit", F.struct("pos", "unit")).alias("first"))
    rest = requirements.select("plan", "id").distinct().join(by_file.select("plan", "id"), ["plan", "id"], "left_anti").join(files.select("plan", "id").distinct().withColumn("named", F.lit(True)), ["plan", "id"], "left")
    rest = rest.join(alone, "plan", "left")
    inside = F.col("named").isNull() & (F.col("n") == 1)
    unit, source = F.when(inside, F.col("unit")), F.when(inside, "contained")
    if mode == "assign":
        unit, source = F.coalesce(unit, "first"), F.coalesce(source, F.when(F.col("first").isNotNull(), "assigned"))
    return by_file.unionByName(rest.select("plan", "id", unit.alias("unit"), F.coalesce(source, F.lit("")).alias("source")))


def last_handoff(messages: DataFrame) -> DataFrame:
    """(session, chosen, set_aside): the last message of kind handoff, else the last one; messages: (session, seq, kind, body)."""
    order = F.struct(F.col("kind").eqNullSafe("handoff").cast("int").alias("h"), F.col("seq"))
    return messages.groupBy("session").agg(F.max_by("body", order).alias("chosen"), (F.count("*") - 1).alias("set_aside"))

