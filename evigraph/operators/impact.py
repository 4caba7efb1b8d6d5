"""What a change proposal touches: terms to modules, seeds, hygiene, and scored expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators.graph import propagate

# Words of a proposal that never name code, how a term is cut from text, and the sizes of hubs and answers.
STOPWORDS = """the and for with into onto from that this then when where which each every add adds make makes build builds new use uses using
remove removes change changes changed move moves support supports should must can will one two all any not but its our their via per
over under between existing current""".split()
TERM = r"[A-Za-z_][A-Za-z0-9_./:@-]{2,}"
HUB_FAN_IN, TOP_MODULES = 30, 8

#: Letters in runs that are all lower-case, or each begin with their only capital.
_PROSE = r"^[^A-Z]*$|^[^A-Za-z]*([A-Z][a-z]*([^A-Za-z]+[A-Z][a-z]*)*)?[^A-Za-z]*$"


def code_shaped(term: Column) -> Column:
    """Whether a term looks like code: it has separators, or capitals inside a word."""
    return term.rlike("[./:_-]") | ~term.rlike(_PROSE)


def proposal_terms(proposals: DataFrame) -> DataFrame:
    """(proposal, pos, term) of each proposal (proposal, text), stop words left out."""
    found = proposals.select("proposal", F.posexplode(F.regexp_extract_all("text", F.lit(f"({TERM})"), 1)).alias("pos", "term"))
    return found.filter(~F.lower("term").isin(STOPWORDS))


def resolve(terms: DataFrame, nodes: DataFrame, symbols: DataFrame, dotted_head: bool = False) -> DataFrame:
    """(term, module): each distinct term of terms by the first rung that has one answer.

    Rungs: a node's id, a symbol's id, a path, the end of one path, the stem of
    one path, one module's symbol name (both in any case), the dotted end of one
    module's symbol ids; with dotted_head, the same for what stands before the
    first dot. nodes: (id, path); symbols: (id, name, module).
    """
    asked = terms.select("term").filter("term <> ''").distinct()
    paths = nodes.filter("path is not null and path <> ''").select("path", F.col("id").alias("module"))
    owned = symbols.filter("module is not null and module <> ''")
    # tables by rung: what a term must be equal to, and the module
    parts = F.split("path", "/")
    ends = paths.select("path", "module", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    ends = ends.select(F.array_join(F.slice(F.split("path", "/"), F.col("k"), F.size(F.split("path", "/"))), "/").alias("key"), "path", "module")
    stem = F.lower(F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", ""))
    chain = F.split("id", "[.]")
    dotted = owned.filter(F.size(chain) > 1).select("id", "module", F.explode(F.sequence(F.lit(2), F.size(chain))).alias("k"))
    dotted = dotted.select(F.array_join(F.slice(F.split("id", "[.]"), F.col("k"), F.size(F.split("id", "[.]"))), ".").alias("key"), "module")

    def one(rows: DataFrame, of: str = "module") -> DataFrame:
        return rows.groupBy("key").agg(F.count_distinct(of).alias("n"), F.min("module").alias("module")).filter("n = 1").select("key", "module")

    exact = [nodes.select(F.col("id").alias("key"), F.col("id").alias("module")).distinct(), owned.groupBy(F.col("id").alias("key")).agg(F.min("module").alias("module")), paths.groupBy(F.col("path").alias("key")).agg(F.max("module").alias("module")), one(ends, "path")]
    loose = [one(paths.select(stem.alias("key"), "module")), one(owned.select(F.lower("name").alias("key"), "module"))]
    rungs = [(t, F.col("term")) for t in exact] + [(t, F.lower("term")) for t in loose] + [(one(dotted), F.when(F.col("term").contains("."), F.when(~F.col("term").contains("/"), F.col("term"))))]
    found = None
    for rank, (table, key) in enumerate(rungs):
        hit = asked.withColumn("key", key).join(table, "key").select("term", F.lit(rank).alias("rank"), "module")
        found = hit if found is None else found.union(hit)
    out = found.groupBy("term").agg(F.min_by("module", "rank").alias("module"))
    if not dotted_head:
        return out
    missed = asked.join(out, "term", "left_anti").filter("contains(term, '.') and not contains(term, '/')").withColumn("head", F.split_part("term", F.lit("."), F.lit(1)))
    heads = resolve(missed.select(F.col("head").alias("term")), nodes, symbols)
    return out.union(missed.join(heads.withColumnRenamed("term", "head"), "head").select("term", "module"))


def resolve_list(terms: DataFrame, nodes: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (list, module, first) and misses (list, pos, term) of loosely named terms (list, pos, term): each module once, by its first term."""
    clean = terms.select("list", "pos", F.trim("term").alias("term")).filter("term <> ''")
    found = clean.join(resolve(clean, nodes, symbols, dotted_head=True), "term", "left")
    return found.filter("module is not null").groupBy("list", "module").agg(F.min("pos").alias("first")), found.filter("module is null").select("list", "pos", "term")


def seeds(proposals: DataFrame, explicit: DataFrame, nodes: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds (proposal, module, term, explicit), terms shaped like code that name nothing, and explicit values that name nothing.

    An explicit value (proposal, value) comes before terms of the text, and of several terms the first.
    """
    given = explicit.select("proposal", F.lit(-1).alias("pos"), F.col("value").alias("term"))
    asked = given.unionByName(proposal_terms(proposals).select("proposal", "pos", "term"))
    found = asked.join(resolve(asked, nodes, symbols), "term", "left")
    own = found.filter("module is not null").groupBy("proposal", "module").agg(F.min(F.struct("pos", "term")).alias("f"))
    missed = found.filter("module is null")
    return (
        own.select("proposal", "module", F.col("f.term").alias("term"), (F.col("f.pos") < 0).alias("explicit")),
        missed.filter(code_shaped(F.col("term")) & (F.col("pos") >= 0)).select("proposal", "term").distinct(),
        missed.filter("pos < 0").select("proposal", "term").distinct(),
    )


def hygiene(seeded: DataFrame, proposals: DataFrame, nodes: DataFrame) -> DataFrame:
    """seeded with rejected: ``package`` where the proposal also seeds something that is no package, else ``prose``
    where it also seeds by a term shaped like code and doesn't write this one as code; null for seeds that stay."""
    rows = seeded.join(nodes.select(F.col("id").alias("module"), "kind"), "module", "left").join(proposals.select("proposal", "text"), "proposal", "left")
    package = F.coalesce(F.col("kind") == "package", F.lit(False)) & ~F.col("explicit")
    better = seeded.join(nodes.filter("kind = 'package'").select(F.col("id").alias("module")), "module", "left_anti").select("proposal").distinct().withColumn("better", F.lit(True))
    rows = rows.join(better, "proposal", "left").withColumn("set_aside", package & F.col("better").isNotNull())
    firm = F.col("explicit") | code_shaped(F.col("term"))
    evident = rows.filter(~F.col("set_aside") & firm).select("proposal").distinct().withColumn("evident", F.lit(True))
    quoted = F.regexp_replace("term", r"([\\\[\](){}.+*?^$|-])", r"\\$1")
    as_code = F.rlike("text", F.concat(F.lit(r"`[^`\n]*\b"), quoted, F.lit(r"\b[^`\n]*`|\b"), quoted, F.lit(r"\(")))
    prose = F.col("evident").isNotNull() & ~firm & ~F.coalesce(as_code, F.lit(False))
    why = F.when(F.col("set_aside"), "package").when(prose, "prose")
    return rows.join(evident, "proposal", "left").select(*seeded.columns, why.alias("rejected"))


def build(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, score, hops) of all that the kept seeds (module) touch."""
    return propagate(edges, kept.select(F.col("module").alias("id")).distinct())


def impact_modules(scores: DataFrame, owner: DataFrame, module: str, top: int = TOP_MODULES) -> DataFrame:
    """(module, score): scored nodes as their modules, the best score of each, the module itself left out; the first few."""
    own = scores.join(owner.withColumnRenamed("module", "own"), "id", "left").select(F.coalesce("own", "id").alias("module"), "score")
    best = own.filter((F.col("module") != module) & (F.col("module") != "")).groupBy("module").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "module").limit(top)


def context(scores: DataFrame, fan_in: DataFrame, lexical: DataFrame, package_roots: DataFrame, least: int = HUB_FAN_IN) -> DataFrame:
    """scores (id, score) with role: ``work``, or why a node is context: ``hub`` or ``package-root``.

    Seeds (score 1) that a person named are work; one that only the text named
    is context if it's a hub; other nodes are context as hubs or package roots.
    """
    rows = scores.join(fan_in.select("id", "fan_in"), "id", "left").join(lexical.select("id").distinct().withColumn("lexical", F.lit(True)), "id", "left")
    rows = rows.join(package_roots.select("id").distinct().withColumn("root", F.lit(True)), "id", "left")
    hub, seed = F.coalesce(F.col("fan_in") >= least, F.lit(False)), F.col("score") >= 1
    role = F.when(seed & ~(F.col("lexical").isNotNull() & hub), "work").when(~seed & F.col("root").isNotNull(), "package-root").when(hub, "hub").otherwise("work")
    return rows.select("id", "score", role.alias("role"))
