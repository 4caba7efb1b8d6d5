"""Rules and policies: scopes, globs, forbidden imports, policy resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators.stats import running_totals

# How verdicts rank, worst first.
SEVERITY = {"fail": 0, "suspect": 1, "unknown": 2, "soft": 3, "pass": 4, "skipped": 5}
TESTED_BY_GRAPH = "forbidden-import"
BROADCAST_RULES = 10_000


def scope_matches(scope: Column, path: Column) -> Column:
    """Segment-wise prefix; ``.`` and empty scopes hold everything, a null path is in none."""
    everything = (scope == "") | (scope == ".") | (scope == "*")
    return path.isNotNull() & (everything | (path == scope) | path.startswith(F.concat(scope, F.lit("/"))))


def glob_regex(pattern: Column) -> Column:
    """An anchored regular expression: ``*`` is any text, ``?`` one character, the rest itself."""
    escaped = F.regexp_replace(pattern, r"([\\\[\](){}.+^$|*?])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(escaped, F.lit(r"\*"), F.lit(".*")), F.lit(r"\?"), F.lit(".")), F.lit("$"))


def glob_matches(pattern: Column, text: Column) -> Column:
    return F.rlike(text, glob_regex(pattern))


def normalise_command(command: Column) -> Column:
    return F.trim(F.regexp_replace(command, r"\s+", " "))


def importer_matches(pattern: Column, id_: Column) -> Column:
    """``*``; a prefix ending in ``.*`` or ``/*``; or the id itself."""
    prefix = pattern.endswith(".*") | pattern.endswith("/*")
    return (pattern == "*") | F.when(prefix, id_.startswith(F.expr("substring(pattern, 1, length(pattern) - 1)"))).otherwise(pattern == id_)


def forbidden_imports(rules: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verdict per rule (id, status, check, kind, scope, importers, imported, except): verdict, violations, proven.

    Edges meet rules through the forbidden target, an equi-join; patterns and
    scopes are judged on what that leaves. Only semantic edges prove.
    """
    judged = rules.filter((F.col("status") == "confirmed") & (F.col("check") != "soft") & (F.col("kind") == TESTED_BY_GRAPH))
    targets = judged.select("id", "scope", "importers", "except", F.explode("imported").alias("dst"))
    hit = edges.filter("type = 'imports'").join(targets, "dst").join(nodes.select(F.col("id").alias("src"), "path"), "src", "left")
    hit = hit.filter(~F.array_contains("except", F.col("src")) & (F.col("path").isNull() | scope_matches(F.col("scope"), F.col("path"))))
    hit = hit.select("id", "src", "dst", "tier", F.explode("importers").alias("pattern")).filter(importer_matches(F.col("pattern"), F.col("src"))).select("id", "src", "dst", "tier").distinct()
    synthetic = F.col("dst").rlike("^(ext|env|tf):")
    found = hit.groupBy("id").agg(F.count("*").alias("violations"), F.count_if((F.col("tier") == "semantic") | synthetic).alias("proven"))
    out = rules.join(found, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("violations", "proven")})
    verdict = (
        F.when(F.col("status") != "confirmed", "skipped").when(F.col("check") == "soft", "soft").when(F.col("kind") != TESTED_BY_GRAPH, "unknown")
        .when(F.col("proven") > 0, "fail").when(F.col("violations") > 0, "suspect").otherwise("pass")
    )
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return out.select("id", verdict.alias("verdict"), "violations", "proven").withColumn("severity", severity[F.col("verdict")])


def resolve_policy(commands: DataFrame, policy: DataFrame, defaults: DataFrame) -> DataFrame:
    """command, decision, source, by_default.

    A denial anywhere wins, the most specific one named; else the most specific
    scope with a match decides, escalation before allowance, then file order;
    else the most specific default; else escalate. A glob is no equi-join: up to
    BROADCAST_RULES rules are broadcast, more are joined as Spark plans it.
    """
    asked = commands.select("command").distinct().withColumn("normal", normalise_command(F.col("command")))
    few = policy.count() <= BROADCAST_RULES
    hit = asked.join(F.broadcast(policy) if few else policy, glob_matches(F.col("pattern"), F.col("normal")))
    deny = F.col("decision") == "deny"
    order = F.struct(F.when(deny, 0).otherwise(1).alias("d"), (-F.col("specificity")).alias("s"), F.when(F.col("decision") == "escalate", 0).otherwise(1).alias("e"), F.col("file_order").alias("o"))
    best = hit.groupBy("command").agg(F.min_by(F.struct("decision", "source"), order).alias("rule"))
    fallback = defaults.agg(F.max_by(F.struct("decision", "source"), "specificity").alias("fallback"))
    out = asked.join(best, "command", "left").join(F.broadcast(fallback), how="left")
    return out.select("command", F.coalesce("rule.decision", "fallback.decision", F.lit("escalate")).alias("decision"), F.coalesce("rule.source", "fallback.source", F.lit("")).alias("source"), F.col("rule").isNull().alias("by_default"))


def most_restrictive(segments: DataFrame) -> DataFrame:
    """Per command of several segments: deny before escalate before allow; only neutral segments allow."""
    rank = F.when(F.col("decision") == "deny", 3).when(F.col("decision") == "escalate", 2).otherwise(1)
    top = segments.groupBy("command").agg(F.max(F.when(~F.col("neutral"), rank)).alias("r"))
    return top.select("command", F.when(F.col("r") == 3, "deny").when(F.col("r") == 2, "escalate").otherwise("allow").alias("decision"))


def ordered(verdicts: DataFrame) -> DataFrame:
    """verdicts (id, verdict) with their place: worst first, then by the number that ends the id, then by id."""
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    number = F.coalesce(F.try_to_number(F.regexp_extract("id", "([0-9]+)$", 1), F.lit("999999999999")).cast("long"), F.lit(0))
    keyed = verdicts.withColumn("key", F.struct(severity[F.col("verdict")].alias("s"), number.alias("n"), F.col("id").alias("i"))).withColumn("one", F.lit(1))
    return running_totals(keyed, "key", "one").select("id", "verdict", (F.col("before_one") + 1).cast("long").alias("place"))


def compile_rules(rules: DataFrame, dialects: dict[str, str]) -> DataFrame:
    """(target, config): one text per target dialect, a line for each of its rules (target, position, kind, what) in order."""
    template = F.create_map(*[F.lit(x) for kv in dialects.items() for x in kv])
    line = F.replace(F.replace(template[F.col("target")], F.lit("{kind}"), F.col("kind")), F.lit("{what}"), F.col("what"))
    rows = rules.filter(F.col("target").isin(list(dialects))).withColumn("line", line)
    return rows.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("config"))


_PIECES = re.compile(r"""\\.|'[^']*'|"[^"]*"|(?P<cut>&&|\|\||[;|])|(?P<open>['"])|[^\\'"&|;]+|.""", re.S)
_ASSIGNMENT = re.compile(r"""[ \t]*[A-Za-z_][A-Za-z0-9_]*=(?:'[^']*'|"[^"]*"|[^ \t'"])*(?=[ \t]|$)""")


def split_segments(command: str) -> list[str] | None:
    """Segments at ``&&``, ``||``, ``;`` and ``|`` outside quotes; None if a quote stays open.

    Outside quotes, a backslash takes the next character's meaning away.
    """
    out = [""]
    for m in _PIECES.finditer(command):
        if m["open"]:
            return None
        if m["cut"]:
            out.append("")
        else:
            out[-1] += m[0]
    return [s.strip() for s in out if s.strip()]


def without_assignments(segment: str) -> str:
    """The segment without the assignments that lead it, which the policy doesn't see."""
    while m := _ASSIGNMENT.match(segment):
        segment = segment[m.end() :]
    return segment.strip()


def is_neutral(segment: str) -> bool:
    """Whether a segment runs nothing that a policy governs: nothing, a no-op, or a change of directory."""
    own = without_assignments(segment)
    return own in ("", "true", ":") or own.split()[0] == "cd"
