"""Answer keys: exports to grade, keyed merges of compile units, and why pairs were missed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators.rules import scope_matches

# File endings by language; modes of a call with a coverage bucket of their own.
EXTENSIONS = {"go": ["go"], "ts": ["ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"], "py": ["py"], "rust": ["rs"], "java": ["java"], "c": ["c", "h"], "cpp": ["cc", "cpp", "cxx", "h", "hh", "hpp", "hxx"]}
OWN_BUCKET = ["macro", "virtual", "operator", "constructor"]


def _of_language(path, lang: str):
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin(EXTENSIONS[lang])


def _inside(path, module: str, exclude: list[str]):
    out = scope_matches(F.lit(module.strip("/")), path)
    for d in exclude:
        out = out & ~scope_matches(F.lit(d.strip("/")), path)
    return out


def gradeable(edges: DataFrame, nodes: DataFrame, symbols: DataFrame, module: str, lang: str, exclude: list[str]) -> tuple[DataFrame, DataFrame]:
    """Calls (src, dst, tier, evidence of (path, line, lane)) as gradeable rows, one for each evidence inside the cell; and what was left out (why, n).

    The target must be in a module or package of the language; macros are
    expanded, not called, and are only counted.
    """
    target = symbols.select(F.col("id").alias("dst"), F.col("line").alias("t_line"), F.col("kind").alias("t_kind"), F.col("module").alias("id")).join(nodes.filter(F.col("kind").isin("module", "package")).select("id", F.col("path").alias("t_path")), "id").filter(_of_language(F.col("t_path"), lang))
    rows = edges.filter("type = 'calls'").join(target.drop("id"), "dst").select("src", "dst", "tier", "t_path", "t_line", "t_kind", F.explode("evidence").alias("e")).select("*", "e.path", "e.line", "e.lane").drop("e")
    rows = rows.filter(_of_language(F.col("path"), lang) & _inside(F.col("path"), module, exclude))
    macro = F.coalesce(F.col("t_kind") == "macro", F.lit(False))
    return rows.filter(~macro), rows.filter(macro).groupBy(F.lit("macro").alias("why")).agg(F.count("*").alias("n"))


def foreign_edges(rows: DataFrame, module: str, lang: str, exclude: list[str], tool: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Another tool's edges (seq, site, callee, kind, label) as gradeable rows; what was left out (why, n); and malformed ones (seq).

    site and callee are ``path:line``. The first reason counts: another
    language, outside the cell, a macro, a repeat of an earlier row.
    """
    pos = lambda c, n: F.regexp_extract(c, r"^(.+):([1-9][0-9]*)$", n)
    own = rows.withColumns({"path": pos("site", 1), "line": F.try_to_number(pos("site", 2), F.lit("9999999999")).cast("long"), "t_path": pos("callee", 1), "t_line": F.try_to_number(pos("callee", 2), F.lit("9999999999")).cast("long")})
    bad = (F.col("path") == "") | (F.col("t_path") == "")
    why = F.when(~_of_language(F.col("path"), lang) | ~_of_language(F.col("t_path"), lang), "other-language").when(~_inside(F.col("path"), module, exclude), "outside-cell").when(F.col("kind") == "macro", "macro")
    fine = own.filter(~bad).withColumn("why", why)
    first = fine.filter("why is null").groupBy("path", "line", "t_path", "t_line").agg(F.min(F.struct("seq", "kind", "label")).alias("f"))
    kept = first.select("path", "line", "t_path", "t_line", F.col("f.kind").alias("t_kind"), F.concat_ws(":", F.lit(tool), F.when(F.col("f.label") != "", F.col("f.label"))).alias("tier"))
    repeats = fine.filter("why is null").groupBy("path", "line", "t_path", "t_line").agg((F.count("*") - 1).alias("n")).select(F.lit("duplicate").alias("why"), "n").filter("n > 0")
    left = fine.filter("why is not null").select("why", F.lit(1).cast("long").alias("n")).unionByName(repeats).groupBy("why").agg(F.sum("n").alias("n"))
    return kept, left, own.filter(bad).select("seq")


def resolve_units(calls: DataFrame, decls: DataFrame) -> DataFrame:
    """calls (unit, ..., callee, name, mode) of compile units with their target under the linkage rules, or the reason for none.

    decls: (unit, key, path, line, kind, static, body, in_repo, implicit). A
    static callee is its own unit's definition; any other is the one definition
    of all units, the unit's own if there are several; a name declared in the
    repository but defined nowhere is undefined, others are external. Dynamic
    calls have neither.
    """
    own = decls.groupBy("unit", "key").agg(
        F.bool_or("static").alias("static"), F.max(F.when(F.col("body") & F.col("in_repo"), F.struct("path", "line"))).alias("own"), F.bool_or(F.col("in_repo") & ~F.col("implicit")).alias("declared"), F.max("kind").alias("kind"),
    )
    shared = decls.join(own.filter("static").select("unit", "key"), ["unit", "key"], "left_anti").filter("body and in_repo").select("key", "path", "line").distinct()
    shared = shared.groupBy("key").agg(F.count("*").alias("defs"), F.min(F.struct("path", "line")).alias("def"))
    rows = calls.join(own.withColumnRenamed("key", "callee"), ["unit", "callee"], "left").join(shared.withColumnRenamed("key", "callee"), "callee", "left")
    static, defs, declared = F.coalesce("static", F.lit(False)), F.coalesce("defs", F.lit(0)), F.coalesce("declared", F.lit(False))
    live = F.col("mode") != "dynamic"
    target = F.when(live, F.when(static, F.col("own")).when(defs == 1, F.col("def")).when(defs > 1, F.col("own")))
    reason = F.when(live & target.isNull(), F.when((static | (defs == 0)) & declared, "undefined").when(static | (defs == 0), "external").otherwise("link-ambiguous"))
    return rows.select(*calls.columns, target["path"].alias("t_path"), target["line"].alias("t_line"), F.coalesce("kind", F.lit("function")).alias("t_kind"), reason.alias("reason"))


SITE = ["path", "line", "col", "spell_path", "spell_line", "spell_col", "mode", "callee"]


def merge_units(resolved: DataFrame) -> DataFrame:
    """One row for each site of all units (by place, spelling, mode and callee): its distinct targets and its coverage bucket."""
    known = F.col("t_path").isNotNull()
    by = resolved.groupBy(*SITE).agg(
        F.array_sort(F.collect_set(F.when(known, F.struct("t_path", "t_line", "name", "t_kind")))).alias("targets"), F.count_distinct(F.when(F.col("reason") == "external", F.col("name"))).alias("external"),
        F.min_by("reason", "unit").alias("reason"), F.min_by("caller", "unit").alias("caller"),
    )
    n = F.size("targets") + F.col("external")
    bucket = (
        F.when(F.col("mode") == "dynamic", "dynamic").when(n >= 2, "tu-split").when((n == 1) & (F.col("external") == 1), "external")
        .when(n == 1, F.when(F.col("mode").isin(OWN_BUCKET), F.col("mode")).otherwise("static")).when(F.col("reason") == "undefined", "undefined").otherwise("link-ambiguous")
    )
    return by.select(*SITE, "caller", "targets", bucket.alias("bucket"))


def merge_keyed(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Sites of units (site, key) with the places of their key's definitions (key, path, line) over all units; keys without one have no target."""
    places = definitions.select("key", "path", "line").distinct()
    hit = rows.select("site", "key").distinct().join(places, "key", "left")
    return hit.groupBy("site").agg(F.array_sort(F.collect_set(F.when(F.col("path").isNotNull(), F.struct("path", "line")))).alias("targets"))


def implicit_recall(pairs: DataFrame, drawn: DataFrame, explicit_pairs: int, explicit_hits: int) -> tuple[DataFrame, DataFrame]:
    """Pairs and hits of implicit targets (path, line, t_path, t_line, families) by their sorted families; and recall with them in the denominator."""
    rows = pairs.join(drawn.select("path", "line", "t_path", "t_line").distinct().withColumn("hit", F.lit(1)), ["path", "line", "t_path", "t_line"], "left")
    by = rows.groupBy(F.array_join(F.array_sort("families"), "+").alias("families")).agg(F.count("*").alias("pairs"), F.count("hit").alias("hits"))
    both = by.agg((F.coalesce(F.sum("pairs"), F.lit(0)) + explicit_pairs).alias("pairs"), (F.coalesce(F.sum("hits"), F.lit(0)) + explicit_hits).alias("hits"))
    return by, both.withColumn("recall", F.round(F.try_divide("hits", "pairs"), 6))


def shape_bucket():
    """SQL: the bucket of a callee's shape (shape, kind of its first declaration, receiver)."""
    variable = lambda c, a, b, d: F.concat_ws("-", F.split_part(c, F.lit(":"), F.lit(a)), F.split_part(c, F.lit(":"), F.lit(b)), F.split_part(c, F.lit(":"), F.lit(d)))
    named = F.when(F.col("decl").isNull(), "unresolved").when(F.col("decl").startswith("var:"), variable("decl", 2, 3, 4)).otherwise(F.col("decl"))
    member = F.when(F.col("recv").startswith("ident:var:"), variable("recv", 3, 4, 5)).otherwise(F.col("recv"))
    return (
        F.when(F.col("shape") == "identifier", F.concat(F.lit("identifier:"), named)).when(F.col("shape") == "new", F.concat(F.lit("new:"), F.coalesce("decl", F.lit("unresolved"))))
        .when(F.col("shape") == "member", F.concat(F.lit("member:on-"), member)).otherwise(F.col("shape"))
    )


def bucket_misses(misses: DataFrame, shapes: DataFrame, key_sites: DataFrame, confirmed: DataFrame) -> DataFrame:
    """misses (miss, path, line, t_path, t_line, t_name) with bucket and how: why the callee at the site wasn't reached.

    First a sibling: a confirmed target (path, line, t_path, t_line, t_name) of
    the line with that name in that file, declared elsewhere. Else the shape
    (path, line, col, name, shape, decl, recv) at the key's column (key_sites:
    path, line, col, t_path, t_line; from 1), those of the name if there are
    several; else the shapes of the line with the name. Shapes that read
    differently are ambiguous.
    """
    named = misses.withColumn("name", F.trim(F.element_at(F.split("t_name", "[.]"), -1), F.lit('"')))
    place, key, ends = ["path", "line"], ["path", "line", "t_path", "t_line"], lambda k: (F.min("lo").alias(f"{k}_lo"), F.max("hi").alias(f"{k}_hi"))
    # what is joined to the misses has one row for each of their keys
    c = confirmed.groupBy(*place, "t_path", "t_name").agg(F.min("t_line").alias("c_lo"), F.max("t_line").alias("c_hi"))
    read = shapes.select("path", "line", "col", F.col("name").alias("s_name"), shape_bucket().alias("bucket"))
    read = read.groupBy(*place, "col", "s_name").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    at = key_sites.select(*key, (F.col("col") - 1).alias("col")).distinct().join(read, [*place, "col"])
    own = at.filter("s_name is not null").groupBy(*key, F.col("s_name").alias("name")).agg(*ends("own"), F.lit(True).alias("own"))
    by = read.filter("s_name is not null").groupBy(*place, F.col("s_name").alias("name")).agg(*ends("by"))
    rows = named.join(c, [*place, "t_path", "t_name"], "left").withColumn("sibling", F.expr("c_lo <> t_line or c_hi <> t_line"))
    rows = rows.join(at.groupBy(*key).agg(*ends("all")), key, "left").join(own, [*key, "name"], "left")
    rows = rows.join(by, [*place, "name"], "left").join(read.select(*place).distinct().withColumn("some", F.lit(True)), place, "left")
    for end in ("lo", "hi"):
        rows = rows.withColumn(f"at_{end}", F.when(F.col("own"), F.col(f"own_{end}")).otherwise(F.col(f"all_{end}")))
    for k in ("at", "by"):
        rows = rows.withColumn(f"{k}_n", F.when(F.col(f"{k}_lo") == F.col(f"{k}_hi"), 1).when(F.col(f"{k}_lo").isNotNull(), 2).otherwise(0)).withColumn(f"{k}_bucket", F.col(f"{k}_lo"))
    bucket = (
        F.when(F.col("sibling"), "sibling").when(F.col("at_n") == 1, F.col("at_bucket")).when(F.col("at_n") > 1, "ambiguous").when(F.col("by_n") == 1, F.col("by_bucket")).when(F.col("by_n") > 1, "ambiguous")
        .when(F.col("some"), "no-record").otherwise("no-site")
    )
    how = F.when(F.col("sibling"), "sibling").when(F.col("at_n") == 1, "exact").when(F.col("at_n") > 1, "ambiguous").when(F.col("by_n") == 1, "name").when(F.col("by_n") > 1, "ambiguous").otherwise("none")
    return rows.select(*misses.columns, bucket.alias("bucket"), how.alias("how"))


def repair_lines(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """A foreign graph's edges (src, dst, line), with the declaration line of dst where it gives none: symbols (id, path, line)."""
    s = symbols.groupBy(F.col("id").alias("dst")).agg(F.min(F.struct("path", "line")).alias("d"))
    return edges.join(s, "dst", "left").select("src", "dst", F.coalesce("line", "d.line").alias("line"), F.col("d.path").alias("t_path"), F.col("d.line").alias("t_line"))
