"""Question corpora over a graph: index, cards, answers, distractors, and how replies score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least length of a bare name that stands for one symbol, words by which a reply refuses, and how paths look in text.
LEAST_NAME = 4
REFUSAL = r"(?i)\b(no|none|not|does not|doesn't|isn't|cannot|unknown)\b"
PATH_TOKEN = r"[\w./-]*\w\.\w+"


def index(edges: DataFrame, tests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per symbol (id, name): callers, callees (semantic ones first, then by id), tests that reach it, and whether its bare name is its alone.

    edges: (src, dst, type, tier); tests: (test, id).
    """
    calls = edges.filter("type = 'calls'").select("src", "dst", "tier").distinct()
    order = lambda c: F.struct((F.col("tier") != "semantic").cast("int").alias("o"), F.col(c).alias("id"), F.col("tier"))
    listed = lambda key, other, name: calls.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(order(other))), lambda x: F.struct(x["id"].alias("id"), x["tier"].alias("tier"))).alias(name))
    names = symbols.groupBy("name").agg(F.count("*").alias("n"))
    reach = tests.select("test", "id").distinct().groupBy("id").agg(F.array_sort(F.collect_list("test")).alias("tests"))
    out = symbols.join(listed("dst", "src", "callers"), "id", "left").join(listed("src", "dst", "callees"), "id", "left").join(reach, "id", "left").join(names, "name", "left")
    return out.withColumn("unique_name", (F.col("n") == 1) & (F.length("name") >= LEAST_NAME)).drop("n")


def held_out(symbols: DataFrame, share: float, seed: int) -> DataFrame:
    """Symbols (id) in the evaluation: by a hash of seed and id, and with them every member of a symbol so chosen.

    Members are found by their dotted beginnings, joined, not scanned.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}\n"), "id"), 256)
    chosen = symbols.select("id").distinct().filter(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / float(1 << 32) < share)
    parts = F.split("id", "[.]")
    heads = symbols.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("head"))
    return heads.join(chosen.withColumnRenamed("id", "head"), "head", "left_semi").select("id").distinct()


def symbol_cards(indexed: DataFrame, hidden: DataFrame) -> DataFrame:
    """Per symbol (id, kind, path, line, end_line and the index): a text of what the graph says, and how many mentions of hidden symbols were left out."""
    h = hidden.select(F.col("id").alias("other")).distinct().withColumn("hide", F.lit(True))

    def shown(column: str, field: str | None) -> DataFrame:
        e = indexed.select("id", F.posexplode(column).alias("pos", "x"))
        other = F.col(f"x.{field}") if field else F.col("x")
        rows = e.withColumn("other", other).join(h, "other", "left")
        kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("hide").isNull(), F.struct("pos", "other")))), lambda v: v["other"])
        return rows.groupBy("id").agg(kept.alias(f"{column}_shown"), F.count("hide").alias(f"{column}_hidden"))

    out = indexed
    for column, field in (("callers", "id"), ("callees", "id"), ("tests", None)):
        out = out.join(shown(column, field), "id", "left")
    none = F.array().cast("array<string>")
    line = lambda label, c: F.when(F.size(F.coalesce(c, none)) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "))).otherwise(F.lit(f"{label}: none recorded"))
    head = F.concat("kind", F.lit(" "), "id", F.lit(" in "), "path", F.lit(":"), F.col("line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    text = F.concat_ws("\n", head, line("called by", "callers_shown"), line("calls", "callees_shown"), line("tests", "tests_shown"))
    dropped = sum((F.coalesce(f"{c}_hidden", F.lit(0)) for c in ("callers", "callees", "tests")), F.lit(0))
    return out.filter("kind is not null").select("id", text.alias("card"), dropped.cast("long").alias("dropped"))


def answers(indexed: DataFrame, hidden: DataFrame, impact: DataFrame) -> DataFrame:
    """(id, family, items, dropped): one row for each question family of a symbol: defines, callers, callees, tests, impact.

    Callers and callees are those of semantic edges, for callable kinds only;
    impact: (id, modules). Families without an answer have no items.
    """
    h = hidden.select(F.col("id").alias("other")).distinct().withColumn("hide", F.lit(True))
    none = F.array().cast("array<string>")
    callable_ = indexed.filter(F.col("kind").isin("function", "method", "class", "type", "macro"))

    def family(name: str) -> DataFrame:
        e = callable_.select("id", F.posexplode(F.filter(F.coalesce(name, F.array().cast("array<struct<id:string,tier:string>>")), lambda x: x["tier"] == "semantic")).alias("pos", "x")).select("id", "pos", F.col("x.id").alias("other"))
        rows = e.join(h, "other", "left").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("hide").isNull(), F.struct("pos", "other")))), lambda v: v["other"]).alias("items"), F.count("hide").alias("dropped"))
        return callable_.select("id").join(rows, "id", "left").select("id", F.lit(name).alias("family"), F.coalesce("items", none).alias("items"), F.coalesce("dropped", F.lit(0)).alias("dropped"))

    zero = F.lit(0).cast("long").alias("dropped")
    defines = indexed.filter("path is not null").select("id", F.lit("defines").alias("family"), F.array(F.concat("path", F.lit(":"), F.col("line").cast("string"))).alias("items"), zero)
    tests = indexed.select("id", F.lit("tests").alias("family"), F.coalesce("tests", none).alias("items"), zero)
    touched = indexed.select("id").join(impact, "id", "left").select("id", F.lit("impact").alias("family"), F.coalesce("modules", none).alias("items"), zero)
    return defines.unionByName(family("callers")).unionByName(family("callees")).unionByName(tests).unionByName(touched)


def distractors(symbols: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, fake): a likely id that names nothing, the first of some changes of a symbol's name that no name, qualified name or id is; null if all are.

    symbols: (id, module, qualname, name); taken: (id) of distractors in use.
    """
    name = F.element_at(F.split("qualname", "[.]"), -1)
    head = F.regexp_replace("qualname", "[.]?[^.]*$", "")
    first = F.left("name", F.lit(1))
    flip = F.concat(F.when(first == F.upper(first), F.lower(first)).otherwise(F.upper(first)), F.expr("substr(name, 2)"))
    front, back = F.regexp_replace("name", "_[^_]*$", ""), F.element_at(F.split("name", "_"), -1)
    plain = [flip, F.concat("name", F.lit("2")), F.concat("name", F.lit("_v2")), F.concat(F.lit("get_"), "name"), F.concat("name", F.lit("_impl"))]
    split = [F.concat(front, F.lit("_"), back, F.lit("s")), F.concat(front, F.lit("_new_"), back)]
    rows = symbols.select("id", "module", name.alias("name"), head.alias("head")).withColumn("options", F.when(F.col("name").contains("_"), F.array(*plain, *split)).otherwise(F.array(*plain)))
    rows = rows.select("id", "module", "head", F.posexplode("options").alias("pos", "fake"))
    qual = F.when(F.col("head") != "", F.concat_ws(".", "head", "fake")).otherwise(F.col("fake"))
    rows = rows.withColumn("fake_qual", qual).withColumn("fake_id", F.when(F.coalesce("module", F.lit("")) != "", F.concat_ws(".", "module", "fake_qual")).otherwise(F.col("fake_qual")))
    known = symbols.select(F.col("id").alias("n")).union(symbols.select("name")).union(symbols.select("qualname")).union(symbols.select("module")).distinct()
    for c in ("fake", "fake_qual", "fake_id"):
        rows = rows.join(known.withColumnRenamed("n", c), c, "left_anti")
    rows = rows.join(taken.select(F.col("id").alias("fake_id")).distinct(), "fake_id", "left_anti")
    best = rows.groupBy("id").agg(F.min_by("fake_id", "pos").alias("fake"))
    return symbols.select("id").join(best, "id", "left")


def path_tokens(text: Column) -> Column:
    """Path-shaped words of a text, without a leading ``./``, each once in order."""
    found = F.regexp_extract_all(text, F.lit(f"({PATH_TOKEN})"), 1)
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, r"^\./", "")))


def score_replies(records: DataFrame, offers: DataFrame) -> DataFrame:
    """Replies (item, family, reply, truth) scored: absent by refusal without an offer, defines by the path, the rest by F1 of what is named.

    offers: (item, name): known names that the reply holds and the question
    doesn't, long enough to be meant; those in a truth item don't count.
    """
    named = offers.select("item", "name").distinct().join(records.select("item", "truth"), "item").filter(~F.exists("truth", lambda t: t.contains(F.col("name"))))
    extra = named.groupBy("item").agg(F.count("*").alias("extra"))
    found = F.size(F.filter("truth", lambda t: F.contains(F.col("reply"), t)))
    rows = records.withColumns({"found": found, "want": F.size("truth")}).join(extra, "item", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    refused = F.col("reply").rlike(REFUSAL) & (F.col("extra") == 0) & (F.size(path_tokens(F.col("reply"))) == 0)
    p, r = F.try_divide("found", F.col("found") + F.col("extra")), F.try_divide("found", "want")
    f1 = F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4)
    score = (
        F.when(F.col("family") == "absent", refused.cast("double")).when(F.col("family") == "defines", (F.col("found") > 0).cast("double"))
        .when(F.col("want") == 0, (F.col("extra") == 0).cast("double")).otherwise(f1)
    )
    return rows.select("item", "family", "found", "extra", score.alias("score"))


def summarise(scored: DataFrame) -> DataFrame:
    """(family, n, mean) of scores, with the rows ``navigation`` (all but absent) and ``absent-accepted``."""
    by = scored.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))
    nav = scored.filter("family <> 'absent'").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean")).select(F.lit("navigation").alias("family"), "n", "mean")
    wrong = scored.filter("family = 'absent'").agg(F.count("*").alias("n"), F.round(1 - F.avg("score"), 4).alias("mean")).select(F.lit("absent-accepted").alias("family"), "n", "mean")
    return by.unionByName(nav).unionByName(wrong)


def body_duplicates(bodies: DataFrame) -> DataFrame:
    """Per repository of bodies (repo, body), and in all: how many, how many distinct by their words, and how many repeat."""
    digest = F.sha1(F.trim(F.regexp_replace("body", r"\s+", " ")))
    own = bodies.select("repo", digest.alias("h")).groupBy("repo", "h").agg(F.count("*").alias("n"))
    count = lambda df: df.agg(F.sum("n").alias("bodies"), F.count("*").alias("distinct"))
    total = count(own.groupBy("h").agg(F.sum("n").alias("n")).groupBy(F.lit("total").alias("repo")))
    return count(own.groupBy("repo")).unionByName(total).withColumn("repeated", F.col("bodies") - F.col("distinct"))


def isa_tokens(name: Column) -> Column:
    """Lower-case words of a name, at underscores and capitals; letters and digits stay together."""
    joined = F.regexp_replace(F.regexp_replace(name, r"(?i)(sse4)_([12])", "$1$2"), r"(?i)(avx512)_([A-Za-z0-9]+)", "$1$2")
    return F.transform(F.regexp_extract_all(joined, F.lit(r"([A-Z]+(?![a-z])[0-9]*|[A-Z]?[a-z]+[0-9a-z]*|[0-9]+[a-z]*)"), 1), F.lower)


def name_families(members: DataFrame, words: list[str]) -> DataFrame:
    """(family, members): names (id, name) that differ in one word, which is one of a list; two such words at least."""
    toks = members.select("id", isa_tokens(F.col("name")).alias("t"))
    at = toks.select("id", "t", F.posexplode("t").alias("pos", "word")).filter(F.col("word").isin(words))
    key = F.concat_ws("_", F.expr("slice(t, 1, pos)"), F.lit("*"), F.expr("slice(t, pos + 2, size(t))"))
    by = at.select("id", "word", key.alias("family")).groupBy("family").agg(F.count_distinct("word").alias("words"), F.array_sort(F.collect_set("id")).alias("members"))
    return by.filter("words >= 2").select("family", "members")


def strip_comments(text: Column) -> Column:
    """Text without block and line comments, string literals emptied."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " "), r'"(?:\\.|[^"\\])*"', '""')
