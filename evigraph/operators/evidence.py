"""The two-lane evidence join: nearest match, own column, dispositions, coverage, tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.sources.scratch import materialise

FAR = 1 << 30


def match_resolution(syntax: DataFrame, semantic: DataFrame) -> DataFrame:
    """Each syntax site with the resolution of its file, line and name whose column is nearest.

    A site without a column takes the first; a candidate without a column ranks
    last. Columns hit_* are null where nothing matches.
    """
    r = semantic.filter("kind = 'resolution'").select("file", "line", "name", *(F.col(c).alias(f"hit_{c}") for c in ("seq", "col", "def_file", "def_line", "name")))
    gap = F.when(F.col("col") < 0, 0).when(F.col("hit_col") < 0, FAR).otherwise(F.abs(F.col("hit_col") - F.col("col")))
    best = F.min_by(F.struct(*(f"hit_{c}" for c in ("seq", "col", "def_file", "def_line", "name"))), F.struct(gap.alias("gap"), F.col("hit_seq")))
    near = syntax.select("seq", "file", "line", "name", "col").join(r, ["file", "line", "name"]).groupBy("seq").agg(best.alias("hit"))
    return syntax.join(near, "seq", "left").select(*syntax.columns, "hit.*")


def match_own_column(missed: DataFrame, semantic: DataFrame, fallback: DataFrame) -> DataFrame:
    """Call sites that the match by name missed, resolved at their own column.

    All resolutions at the column must be the fallback's definition.
    """
    asked = missed.filter("kind = 'call' and col >= 0").join(fallback.withColumnsRenamed({"def_file": "guess_file", "def_line": "guess_line"}), ["file", "line", "name"])
    r = semantic.filter("kind = 'resolution'").select("file", "line", "col", F.col("seq").alias("r_seq"), "def_file", "def_line", F.col("name").alias("r_name"))
    same = (F.col("def_file") == F.col("guess_file")) & (F.col("def_line") == F.col("guess_line"))
    found = asked.join(r, ["file", "line", "col"]).groupBy("seq").agg(F.bool_and(same).alias("all"), F.min(F.struct("r_seq", "col", "def_file", "def_line", "r_name")).alias("own"))
    return found.filter("all").select("seq", "own")


def matched(syntax: DataFrame, semantic: DataFrame, fallback: DataFrame) -> DataFrame:
    """Sites with both readings: hit_* of the match by name, else of the match at the own column."""
    first = match_resolution(syntax, semantic)
    own = match_own_column(first.filter("hit_seq is null").select(*syntax.columns), semantic, fallback)
    out = first.join(own, "seq", "left")
    pick = lambda hit, name: F.coalesce(F.col(hit), F.col(f"own.{name}")).alias(hit)
    return out.select(*syntax.columns, pick("hit_seq", "r_seq"), pick("hit_col", "col"), pick("hit_def_file", "def_file"), pick("hit_def_line", "def_line"), pick("hit_name", "r_name"), F.col("own").isNotNull().alias("by_column"))


def join_lanes(syntax: DataFrame, semantic: DataFrame, fallback: DataFrame, external: DataFrame, withhold: DataFrame) -> DataFrame:
    """Facts (kind, file, line, def_file, def_line, tier, lanes) by the join's decision table.

    An ambiguous site only claims; a hit is semantic; a vetoed site is dropped;
    a guess is syntactic unless its file is withheld (calls only); resolutions
    that nothing claims are uses; implements rows pass through.
    """
    sites = materialise(matched(syntax.filter(F.col("kind").isin("call", "import")), semantic, fallback), "sites")  # read by four branches
    kind = F.when(F.col("kind") == "call", "calls").otherwise("imports").alias("kind")
    hits = sites.filter("hit_seq is not null")
    drawn = hits.filter("not ambiguous").select(kind, "file", "line", F.col("hit_def_file").alias("def_file"), F.col("hit_def_line").alias("def_line"), F.lit("semantic").alias("tier"), F.lit("scip+tree-sitter").alias("lanes"))
    open_sites = sites.filter("hit_seq is null and not ambiguous")
    veto = external.filter("not in_repo").select("file", "line", "name").distinct()
    guessed = open_sites.join(veto, ["file", "line", "name"], "left_anti").join(fallback, ["file", "line", "name"])
    held = guessed.join(withhold.withColumn("held", F.lit(True)), "file", "left").filter("kind <> 'call' or held is null")
    syntactic = held.select(kind, "file", "line", "def_file", "def_line", F.lit("syntactic").alias("tier"), F.lit("tree-sitter").alias("lanes"))
    resolutions = semantic.filter("kind = 'resolution'")
    by_place = hits.select("file", "line", F.col("hit_name").alias("name"), F.col("hit_col").alias("col")).distinct()
    by_name = hits.filter("col < 0").select("file", "line", F.col("hit_name").alias("name")).distinct()
    loose = resolutions.join(by_place, ["file", "line", "name", "col"], "left_anti").join(by_name, ["file", "line", "name"], "left_anti")
    as_is = lambda df, name: df.select(F.lit(name).alias("kind"), "file", "line", "def_file", "def_line", F.lit("semantic").alias("tier"), F.lit("scip").alias("lanes"))
    return drawn.unionByName(syntactic).unionByName(as_is(loose, "uses")).unionByName(as_is(semantic.filter("kind = 'implements'"), "implements"))


def dispositions(syntax: DataFrame, semantic: DataFrame, fallback: DataFrame, external: DataFrame) -> DataFrame:
    """Call sites with their fate: resolved, external or unresolved."""
    sites = matched(syntax.filter("kind = 'call'"), semantic, fallback)
    outside = external.select("file", "line", "name").distinct().withColumn("outside", F.lit(True))
    fate = F.when(F.col("ambiguous"), "unresolved").when(F.col("hit_seq").isNotNull(), "resolved").when(F.col("outside"), "external").otherwise("unresolved")
    return sites.join(outside, ["file", "line", "name"], "left").select(*syntax.columns, fate.alias("fate"))


def coverage(fates: DataFrame) -> DataFrame:
    """Per file: sites, resolved, external, unresolved, and the accounted ratio."""
    n = lambda fate: F.count_if(F.col("fate") == fate).alias(fate)
    out = fates.groupBy("file").agg(F.count("*").alias("sites"), n("resolved"), n("external"), n("unresolved"))
    return out.withColumn("accounted", F.coalesce(F.round(F.try_divide(F.col("resolved") + F.col("external"), F.col("sites")), 3), F.lit(1.0)))


def agreement(syntax: DataFrame, semantic: DataFrame, fallback: DataFrame) -> DataFrame:
    """Sites that both lanes answer, and whether the answers agree."""
    both = match_resolution(syntax.filter("kind = 'call'"), semantic).filter("hit_seq is not null").join(fallback, ["file", "line", "name"])
    return both.select("seq", "file", "line", "name", ((F.col("hit_def_file") == F.col("def_file")) & (F.col("hit_def_line") == F.col("def_line"))).alias("agree"))


def classify_tail(unresolved: DataFrame, rules: list[tuple[str, Column]], default: str = "unclassified") -> DataFrame:
    """Each row with the class of the first rule that holds: exactly one each."""
    cls = None
    for name, rule in rules:
        cls = F.when(rule, name) if cls is None else cls.when(rule, name)
    return unresolved.withColumn("class", cls.otherwise(default) if cls is not None else F.lit(default))


def inside_interval(points: DataFrame, spans: DataFrame, on: str, point: str, start: str, end: str, width: int) -> DataFrame:
    """Range join: rows of points within [start, end] of spans with the same key.

    Spans are dealt to buckets of the given width, so that the join is an
    equi-join on key and bucket whatever the optimizer makes of it.
    """
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("__b", F.floor(F.col(point) / width))
    return p.join(s, [on, "__b"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("__b")


def innermost(points: DataFrame, spans: DataFrame, on: str, point: str, key: str | list[str], width: int) -> DataFrame:
    """Of the spans (name, start, end) around each point, the shortest; ties to the later start, then the name.

    key must be made of the points' own values: a number given to their rows may differ when they're computed again.
    """
    hit = inside_interval(points, spans, on, point, "start", "end", width)
    best = hit.groupBy(*([key] if isinstance(key, str) else key)).agg(F.min_by("scope", F.struct((F.col("end") - F.col("start")).alias("w"), -F.col("start"), F.col("scope"))).alias("scope"))
    return points.join(best, key, "left")


def first_by_priority(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Per key, the candidates of the best priority that have any, where they are one."""
    top = candidates.groupBy(*by).agg(F.min("priority").alias("priority"))
    one = candidates.join(top, [*by, "priority"]).groupBy(*by, "priority").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    return one.filter("n = 1").drop("n")


def longest_prefix(names: DataFrame, modules: DataFrame, sep: str = ".") -> DataFrame:
    """Each dotted name with the longest of its prefixes that is a module."""
    parts = F.split("name", f"[{sep}]")
    heads = names.select("name", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).select("name", "k", F.array_join(F.slice(parts, 1, F.col("k")), sep).alias("module"))
    return names.join(heads.join(modules.select("module"), "module").groupBy("name").agg(F.max_by("module", "k").alias("module")), "name", "left")


def window_rank(by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


# The methods of operator traits and the tokens that apply them.
OPERATOR_TOKENS = {
    "deref": ["*"], "deref_mut": ["*"], "neg": ["-"], "not": ["!"], "add": ["+"], "sub": ["-"], "mul": ["*"], "div": ["/"], "rem": ["%"], "bitand": ["&"], "bitor": ["|"], "bitxor": ["^"], "shl": ["<<"], "shr": [">>"],
    "add_assign": ["+="], "sub_assign": ["-="], "mul_assign": ["*="], "div_assign": ["/="], "rem_assign": ["%="], "bitand_assign": ["&="], "bitor_assign": ["|="], "bitxor_assign": ["^="], "shl_assign": ["<<="], "shr_assign": [">>="],
    "eq": ["==", "!="], "ne": ["!="], "lt": ["<"], "le": ["<="], "gt": [">"], "ge": [">="], "partial_cmp": ["<", "<=", ">", ">="], "index": ["[]"], "index_mut": ["[]"],
}


def trait_operator_calls(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """References (seq, file, line, col, name) that are calls: named for an operator's method, exactly at a token (file, line, col, spelling) that applies it."""
    table = F.create_map(*[x for k, v in OPERATOR_TOKENS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return hits.filter("col >= 0").withColumn("spelling", F.explode(table[F.col("name")])).join(tokens.select("file", "line", "col", "spelling"), ["file", "line", "col", "spelling"], "left_semi").select("seq").distinct()


def symbol_operator_calls(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """References named ``operator...`` exactly at such a token (file, line, col, spelling, in_template): a call, or withheld within a template."""
    own = hits.filter("col >= 0 and startswith(name, 'operator')").withColumn("spelling", F.trim(F.expr("substr(name, 9)")))
    at = tokens.groupBy("file", "line", "col", "spelling").agg(F.bool_or("in_template").alias("in_template"))
    return own.join(at, ["file", "line", "col", "spelling"]).select("seq", F.when(F.col("in_template"), "withheld").otherwise("call").alias("fate"))


def construction_calls(hits: DataFrame, tokens: DataFrame, constructors: DataFrame) -> DataFrame:
    """References onto a constructor's definition (file, line of constructors) exactly at a construction token: a call, or withheld within a template."""
    onto = hits.filter("col >= 0").join(constructors.select(F.col("file").alias("def_file"), F.col("line").alias("def_line")).distinct(), ["def_file", "def_line"], "left_semi")
    at = tokens.groupBy("file", "line", "col").agg(F.bool_or("in_template").alias("in_template"))
    return onto.join(at, ["file", "line", "col"]).select("seq", F.when(F.col("in_template"), "withheld").otherwise("call").alias("fate"))


def new_calls(hits: DataFrame, tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """References at a ``new`` token whose definition targets reads (def_file, def_line, to_file, to_line): drawn to the constructor, or nothing where a class has none."""
    at = hits.filter("col >= 0").join(tokens.select("file", "line", "col").distinct(), ["file", "line", "col"], "left_semi")
    return at.join(targets, ["def_file", "def_line"]).select("seq", "to_file", "to_line", F.when(F.col("to_file").isNull(), "class-only").otherwise("call").alias("fate"))


def implicit_constructions(hits: DataFrame, bodies: DataFrame, constructors: DataFrame, expansions: DataFrame) -> DataFrame:
    """References (seq) onto a constructor inside an open body (file, start, end), where no macro is named (file, line, col)."""
    onto = hits.filter("col >= 0").join(constructors.select(F.col("file").alias("def_file"), F.col("line").alias("def_line")).distinct(), ["def_file", "def_line"], "left_semi")
    plain = onto.join(expansions.select("file", "line", "col").distinct(), ["file", "line", "col"], "left_anti")
    return inside_interval(plain.select("seq", "file", "line"), bodies.select("file", "start", "end"), "file", "line", "start", "end", 128).select("seq").distinct()


def disagreement_shapes(rows: DataFrame, answers: DataFrame, twins: DataFrame, withhold: DataFrame) -> DataFrame:
    """Why the lanes disagree at a site: rows (seq, file, line, name, guess_file, guess_line, def_file, def_line) with shape.

    ``same-line-pair``: another call of the name on the line has the guess as its
    answer (answers: file, line, name, def_file, def_line, one for each site).
    ``cfg-twin``: guess and answer are different arms of one twin (path, name,
    line, end_line). ``withheld``: the file's guesses are withheld. Else null.
    """
    sites = answers.groupBy("file", "line", "name").agg(F.count("*").alias("sites"))
    a = answers.select("file", "line", "name", F.col("def_file").alias("guess_file"), F.col("def_line").alias("guess_line")).distinct()
    pair = rows.join(sites.filter("sites > 1"), ["file", "line", "name"], "left_semi").join(a, ["file", "line", "name", "guess_file", "guess_line"], "left_semi").select("seq").withColumn("pair", F.lit(True))
    arm = twins.select(F.col("path").alias("guess_file"), F.col("name").alias("twin"), F.col("line").alias("guess_line"), F.struct("line", "end_line").alias("own"))
    other = twins.select(F.col("path").alias("def_file"), F.col("name").alias("twin"), F.struct("line", "end_line").alias("theirs"))
    twin = rows.filter("guess_file = def_file").join(arm, ["guess_file", "guess_line"]).join(other, ["def_file", "twin"]).filter("own <> theirs and def_line between theirs.line and theirs.end_line and not def_line between own.line and own.end_line")
    twin = twin.select("seq").distinct().withColumn("twin", F.lit(True))
    held = withhold.select("file").distinct().withColumn("held", F.lit(True))
    out = rows.join(pair, "seq", "left").join(twin, "seq", "left").join(held, "file", "left")
    return out.select(*rows.columns, F.when(F.col("pair"), "same-line-pair").when(F.col("twin"), "cfg-twin").when(F.col("held"), "withheld").alias("shape"))


def constructor_lines(definitions: DataFrame) -> DataFrame:
    """(file, line) of definitions (file, line, moniker) whose one moniker ends in a type and a method of its name."""
    one = definitions.groupBy("file", "line").agg(F.count_distinct("moniker").alias("n"), F.min("moniker").alias("moniker")).filter("n = 1")
    return one.filter(F.regexp_extract("moniker", r"([\w$]+)#([\w$]+)\([^)]*\)\.$", 1) == F.regexp_extract("moniker", r"([\w$]+)#([\w$]+)\([^)]*\)\.$", 2)).filter(F.col("moniker").rlike(r"[\w$]+#[\w$]+\([^)]*\)\.$")).select("file", "line")


def contradicted(symbols: DataFrame, definitions: DataFrame) -> DataFrame:
    """Symbols (id, file, line, name, kind) whose own line the index defines, but never by that name, or as another kind: (id, why, read)."""
    at = definitions.groupBy("file", "line").agg(F.collect_set(F.struct("name", "kind")).alias("read"))
    rows = symbols.join(at, ["file", "line"])
    names, kinds = F.transform("read", lambda r: r["name"]), F.transform(F.filter("read", lambda r: r["name"] == F.col("name")), lambda r: r["kind"])
    why = F.when(~F.array_contains(names, F.col("name")), "another-name").when(~F.array_contains(kinds, F.col("kind")), "another-kind")
    return rows.withColumn("why", why).filter("why is not null").select("id", "why", F.array_join(F.array_sort(F.transform("read", lambda r: F.concat_ws(":", r["kind"], r["name"]))), ",").alias("read"))


def symbol_imports(imports: DataFrame, modules: DataFrame, importers: DataFrame) -> DataFrame:
    """(module, bound, target, original): names that a module's top-level ``from`` imports bind to symbols of the repository's modules.

    imports: (path, module, original, bound, scope); modules: (id, import_name); importers: (path, id).
    """
    own = imports.filter("original is not null and original <> '*' and scope = ''").withColumnRenamed("module", "import_name").join(importers.select("path", F.col("id").alias("module")), "path")
    hit = own.join(modules.select("import_name", F.col("id").alias("target")), "import_name")
    return hit.select("module", F.coalesce("bound", "original").alias("bound"), "target", "original").distinct()


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, modules: DataFrame, local_defs: DataFrame) -> DataFrame:
    """Call sites (seq, module, scope, callee, line) with the symbol that the ordered rules name, and the rule.

    ``self``: a method of the innermost enclosing class. ``local``: a def that
    the calling function's own body writes (local_defs: module, scope, start,
    end, name). ``own``: a top-level symbol of the module. ``import``: a symbol
    imported under that name (module, bound, target, original). ``dotted``: the
    longest beginning that is a module (id, import_name), a head that is an
    imported module (original null) read as that one, then a symbol of it. An
    expression as the receiver names nothing. symbols: (module, qualname, kind).
    """
    s = symbols.select("module", "qualname", "kind").distinct()
    rows = calls.filter(~F.col("callee").startswith("<")).withColumns({"head": F.split_part("callee", F.lit("."), F.lit(1)), "parts": F.size(F.split("callee", "[.]"))})
    found = []
    # self and cls: enclosing classes, innermost first
    own = rows.filter("head in ('self', 'cls') and parts = 2 and scope <> ''").withColumn("name", F.split_part("callee", F.lit("."), F.lit(2)))
    depth = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(F.split("scope", "[.]"))))).withColumn("class", F.array_join(F.slice(F.split("scope", "[.]"), 1, F.col("k")), "."))
    held = depth.join(s.filter("kind = 'class'").select("module", F.col("qualname").alias("class")), ["module", "class"], "left_semi").withColumn("qualname", F.concat_ws(".", "class", "name")).join(s.select("module", "qualname").distinct(), ["module", "qualname"], "left_semi")
    found.append(held.groupBy("seq").agg(F.max_by(F.concat_ws(".", "module", "qualname"), "k").alias("target")).select("seq", F.lit(0).alias("rule"), "target"))
    bare = rows.filter("parts = 1 and head not in ('self', 'cls')")
    local = bare.join(local_defs.select("module", "scope", "start", "end", F.col("name").alias("callee")), ["module", "scope", "callee"]).filter("line between start and end")
    found.append(local.select("seq", F.lit(1).alias("rule"), F.concat_ws(".", "module", "scope", "callee").alias("target")))
    found.append(bare.join(s.select("module", F.col("qualname").alias("callee")).distinct(), ["module", "callee"]).select("seq", F.lit(2).alias("rule"), F.concat_ws(".", "module", "callee").alias("target")))
    named = imports.filter("original is not null").select("module", F.col("bound").alias("callee"), F.col("target").alias("t"), "original")
    hit = bare.join(named, ["module", "callee"]).join(s.select(F.col("module").alias("t"), F.col("qualname").alias("original")).distinct(), ["t", "original"], "left_semi")
    found.append(hit.select("seq", F.lit(3).alias("rule"), F.concat_ws(".", "t", "original").alias("target")))
    dotted = rows.filter("parts > 1 and head not in ('self', 'cls')")
    whole = imports.filter("original is null").select("module", F.col("bound").alias("head"), F.col("target").alias("t")).join(modules.select(F.col("id").alias("t"), "import_name"), "t").select("module", "head", "import_name")
    dotted = dotted.join(whole, ["module", "head"], "left").withColumn("text", F.concat(F.coalesce("import_name", "head"), F.expr("substr(callee, length(head) + 1)"))).drop("import_name")
    cut = dotted.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(F.split("text", "[.]")) - 1)))
    names = F.split("text", "[.]")
    cut = cut.select("seq", "k", F.array_join(F.slice(names, 1, F.col("k")), ".").alias("import_name"), F.array_join(F.slice(names, F.col("k") + 1, F.size(names)), ".").alias("qualname"))
    hit = cut.join(modules.select("import_name", F.col("id").alias("module")), "import_name").join(s.select("module", "qualname").distinct(), ["module", "qualname"], "left_semi")
    found.append(hit.groupBy("seq").agg(F.max_by(F.concat_ws(".", "module", "qualname"), "k").alias("target")).select("seq", F.lit(4).alias("rule"), "target"))
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    best = every.groupBy("seq").agg(F.min(F.struct("rule", "target")).alias("b"))
    rule = F.element_at(F.array(*map(F.lit, ("self", "local", "own", "import", "dotted"))), F.col("b.rule") + 1)
    return best.select("seq", F.col("b.target").alias("target"), rule.alias("rule"))


def fallback_table(resolved: DataFrame, calls: DataFrame, where: DataFrame, bindings: DataFrame, local_imports: DataFrame) -> DataFrame:
    """(file, line, name, def_file, def_line): the syntactic lane's answers by call site, without those that a nearer binding takes.

    A bare call inside the extent of a binding of its name (path, name, start,
    end), or of a function that imports the name, isn't the module's, unless the
    target itself lies in that extent. where: (id, path, line).
    """
    rows = calls.join(resolved.select("seq", "target"), "seq").join(where.select(F.col("id").alias("target"), F.col("path").alias("def_file"), F.col("line").alias("def_line")), "target")
    bare = rows.filter("not contains(callee, '.')")
    spans = bindings.select("path", "name", "start", "end").union(local_imports.select("path", "name", "start", "end"))
    over = bare.select("seq", "path", "line", F.col("callee").alias("name"), "def_file", "def_line").join(spans, ["path", "name"]).filter("line between start and end and not (def_file = path and def_line between start and end)")
    kept = rows.join(over.select("seq").distinct(), "seq", "left_anti")
    return kept.groupBy(F.col("path").alias("file"), "line", F.element_at(F.split("callee", "[.]"), -1).alias("name")).agg(F.max_by(F.struct("def_file", "def_line"), "seq").alias("d")).select("file", "line", "name", "d.def_file", "d.def_line")


def named_loads(loads: DataFrame, modules: DataFrame) -> DataFrame:
    """Loads by name (path, line, via, written) with the one module that they name, or an empty target: modules (id, import_name, path).

    A written file is a module's path or the end of exactly one; a written name is exactly one module's.
    """
    parts = F.split("path", "/")
    ends = modules.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("written")).withColumn("by", F.lit(True))
    names = modules.select("id", F.col("import_name").alias("written")).withColumn("by", F.lit(False))
    one = ends.union(names).groupBy("written", "by").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target")).filter("n = 1").drop("n")
    rows = loads.withColumn("by", F.col("via") == "spec_from_file_location")
    return rows.join(one, ["written", "by"], "left").select("path", "line", "via", "written", F.coalesce("target", F.lit("")).alias("target"))
