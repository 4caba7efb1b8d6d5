"""Inventories of tests and definitions by language, and what they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.graph import closure

# File names and symbol names by which runners collect tests; kinds that a call can target; languages of file endings.
TEST_FILES = {"python": r"(^|/)(test_[^/]*|[^/]*_test\.py)$", "go": r"_test\.go$", "typescript": r"\.(test|spec)\.[cm]?[jt]sx?$|(^|/)__tests__/", "java": r"(^|/)[^/]*(Test|Tests|IT)\.java$", "rust": r"\.rs$", "c": r"(^|/)(test_[^/]*|[^/]*_test)\.c$"}
TEST_NAMES = {"go": r"^(Test|Benchmark|Fuzz|Example)($|[^a-z])", "c": r"^test_"}
CALLABLE = ["function", "method", "class", "type", "macro"]
FIXTURE_DIRS = ["fixtures", "fixture", "testdata", "__fixtures__", "__snapshots__"]
TEST_DIRS = ["test", "tests", "__tests__"]
ENDINGS = {"py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript"}


def is_test_file(path: Column, language: str = "python") -> Column:
    return path.rlike(TEST_FILES[language])


def is_fixture_path(path: Column) -> Column:
    """Whether a folder on the path holds fixtures."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, FIXTURE_DIRS)))


def is_test_path(path: Column) -> Column:
    """Whether a folder on the path is one of tests, or the file is named as one."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, TEST_DIRS))) | path.rlike(r"(^|/)(test_[^/]*|[^/]*[_.]test\.\w+|[^/]*[.]spec\.\w+)$")


def language_of(path: Column, claimed: Column) -> Column:
    """The language that a row claims, else that of the file's ending; null if neither is known."""
    table = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    return F.coalesce(claimed, table[F.regexp_extract(path, r"\.([^./]+)$", 1)])


def directory_of(path: Column, depth: int = 2) -> Column:
    parts = F.split(path, "/")
    folder = F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(depth))), "/")
    return F.when(F.size(parts) == 1, ".").otherwise(folder)


def python_tests(symbols: DataFrame) -> DataFrame:
    """Symbols (path, module, kind, name, qualname, line) that the runner collects, with their test id.

    Top-level functions named ``test*`` of test files, and methods named so of
    top-level classes named ``Test*`` without an ``__init__``.
    """
    own = symbols.filter(is_test_file(F.col("path")))
    built = own.filter(F.col("qualname").endswith(".__init__")).select("path", F.regexp_replace("qualname", "[.]__init__$", "").alias("owner")).distinct().withColumn("built", F.lit(True))
    rows = own.filter(F.col("name").startswith("test")).withColumn("owner", F.regexp_replace("qualname", "[.]?[^.]*$", "")).join(built, ["path", "owner"], "left")
    plain = (F.col("kind") == "function") & (F.col("qualname") == F.col("name"))
    method = (F.col("kind") == "method") & F.col("owner").rlike("^Test[^.]*$") & F.col("built").isNull()
    out = rows.filter(plain | method)
    return out.select(F.concat("path", F.lit("::"), F.replace("qualname", F.lit("."), F.lit("::"))).alias("id"), "path", F.lit("pytest").alias("framework"), "line", F.concat_ws(".", "module", "qualname").alias("symbol"))


def tests_by_language(symbols: DataFrame, language: str, marks: DataFrame | None = None) -> DataFrame:
    """Tests of another language among its symbols (path, module, kind, name, qualname, line).

    Go and C go by the names of functions in test files; the others by marks
    (path, line): calls of a framework, attributes or annotations that make the
    symbol at that line a test.
    """
    own = symbols.filter(is_test_file(F.col("path"), language))
    if language in TEST_NAMES:
        own = own.filter((F.col("kind") == "function") & F.col("name").rlike(TEST_NAMES[language]))
    elif marks is not None:
        own = own.join(marks.select("path", "line").distinct(), ["path", "line"], "left_semi")
    framework = {"go": "go test", "rust": "cargo test", "java": "junit", "c": "ctest", "typescript": "jest"}[language]
    return own.select(F.concat("path", F.lit("::"), "qualname").alias("id"), "path", F.lit(framework).alias("framework"), "line", F.concat_ws(".", "module", "qualname").alias("symbol"))


def test_reach(tests: DataFrame, edges: DataFrame, owners: DataFrame, injections: DataFrame) -> DataFrame:
    """Per test (id, symbol, path): what it reaches over calls and injections, the modules of that, and those it only reaches through them.

    injections: (src, dst, via). Edges of other types than calls are not
    followed. Modules of test files aren't counted. through_fixtures are the
    modules reached with named injections but not by calls alone,
    through_autouse those that need one that no test names.
    """
    calls = edges.filter("type = 'calls'").select("src", "dst").distinct()
    named = calls.union(injections.filter("via <> 'autouse'").select("src", "dst")).distinct()
    every = named.union(injections.select("src", "dst")).distinct()
    seeds, own = tests.select(F.col("symbol").alias("seed")).distinct(), tests.select(F.col("symbol").alias("id")).distinct()
    source = owners.filter(~is_test_file(F.col("path"))).select("id", "module")

    def reached(step: DataFrame) -> DataFrame:
        return closure(step, seeds).filter("seed <> id").join(own, "id", "left_anti").select("seed", "id")

    def modules(reach: DataFrame) -> DataFrame:
        return reach.join(source, "id").select("seed", "module").distinct()

    whole = reached(every)
    m_all, m_named, m_calls = modules(whole), modules(reached(named)), modules(reached(calls))
    listed = lambda df, c, name: df.groupBy("seed").agg(F.array_sort(F.collect_list(c)).alias(name))
    out = tests.withColumn("seed", F.col("symbol"))
    for df in (listed(whole, "id", "reaches"), listed(m_all, "module", "reaches_modules"), listed(m_named.join(m_calls, ["seed", "module"], "left_anti"), "module", "through_fixtures"), listed(m_all.join(m_named, ["seed", "module"], "left_anti"), "module", "through_autouse")):
        out = out.join(df, "seed", "left")
    none = F.array().cast("array<string>")
    return out.select("id", *(F.coalesce(c, none).alias(c) for c in ("reaches", "reaches_modules", "through_fixtures", "through_autouse")))


def test_index(modules: DataFrame, guards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Covered modules (id, tests), unguarded ones (id), and tests that reach no module of the graph (test): guards (test, id)."""
    pairs = guards.select("test", "id").distinct()
    held = pairs.join(modules.select("id"), "id", "left_semi")
    covered = held.groupBy("id").agg(F.count("*").alias("tests"))
    return covered, modules.select("id").join(covered.select("id"), "id", "left_anti"), pairs.select("test").distinct().join(held.select("test").distinct(), "test", "left_anti")


def own_code(modules: DataFrame, test_files: DataFrame, excluded: DataFrame) -> DataFrame:
    """Modules (id, path) that aren't test files (path) and lie in no excluded tree (dir)."""
    parts = F.split("path", "/")
    up = modules.select("id", "path", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("k")).select("id", F.array_join(F.slice(F.split("path", "/"), 1, F.col("k")), "/").alias("dir"))
    inside = up.join(excluded.select(F.when(F.col("dir") == ".", "").otherwise(F.col("dir")).alias("dir")).distinct(), "dir", "left_semi").select("id").distinct()
    return modules.join(test_files.select("path").distinct(), "path", "left_anti").join(inside, "id", "left_anti")


def excluded_trees(patterns: DataFrame, modules: DataFrame) -> DataFrame:
    """Folders (dir) that a runner's settings (root, dir) leave out, of those that hold a module (path)."""
    named = patterns.select(F.when(F.col("root").isin("", "."), F.col("dir")).otherwise(F.concat_ws("/", "root", "dir")).alias("dir")).distinct()
    parts = F.split("path", "/")
    up = modules.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir")).distinct()
    return named.join(up, "dir", "left_semi")


def value_only(modules: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that no call can reach: no symbol of a callable kind (scope-only ones aside), and no call into any symbol."""
    able = symbols.filter(F.col("kind").isin(CALLABLE) & ~F.coalesce("scope_only", F.lit(False))).select(F.col("module").alias("id"))
    called = edges.filter("type = 'calls'").select(F.col("dst").alias("sid")).distinct().join(symbols.select(F.col("id").alias("sid"), F.col("module").alias("id")), "sid").select("id")
    return modules.filter(F.col("kind").isin("module", "package")).join(able.union(called).distinct(), "id", "left_anti").select("id")


def repeated_definitions(definitions: DataFrame) -> DataFrame:
    """Names written more than once in a file, with why: ``shared`` (of differing heads or kinds), ``twin`` (the same item
    under conditions, each gated), or ``repeat``. definitions: (path, qualname, line, end_line, header, kind, gated)."""
    by = definitions.groupBy("path", "qualname").agg(F.count("*").alias("n"), F.count_distinct("header").alias("headers"), F.count_distinct(F.coalesce("kind", F.lit(""))).alias("kinds"), F.bool_and("gated").alias("all_gated"), F.array_sort(F.collect_list(F.struct("line", "end_line"))).alias("spans"))
    why = F.when((F.col("headers") > 1) | (F.col("kinds") > 1), "shared").when(F.col("all_gated"), "twin").otherwise("repeat")
    return by.filter("n > 1").select("path", "qualname", why.alias("why"), "spans")


def compiled_arms(twins: DataFrame, defined: DataFrame) -> DataFrame:
    """(path, qualname, line, end_line): the one arm of a twin (path, qualname, spans) that holds a line which the index defines (path, line)."""
    arms = twins.select("path", "qualname", F.explode("spans").alias("s")).select("path", "qualname", "s.line", "s.end_line")
    live = arms.join(defined.select("path", F.col("line").alias("d")).distinct(), "path").filter("d between line and end_line").select(*arms.columns).distinct()
    one = live.groupBy("path", "qualname").agg(F.count("*").alias("n")).filter("n = 1").select("path", "qualname")
    return live.join(one, ["path", "qualname"], "left_semi")


def init_spans(symbols: DataFrame) -> DataFrame:
    """(path, spans) of Go files with several ``init`` functions, which all stand for one id."""
    own = symbols.filter("kind = 'function' and qualname = 'init'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "end_line"))).alias("spans"))
    return own.filter(F.size("spans") > 1)


def type_files(types: DataFrame) -> DataFrame:
    """(name, path) of qualified top-level types (package, type, path); path is null where several files declare one."""
    name = F.when(F.coalesce("package", F.lit("")) == "", F.col("type")).otherwise(F.concat_ws(".", "package", "type"))
    return types.groupBy(name.alias("name")).agg(F.when(F.count("*") == 1, F.min("path")).alias("path"))


def stdlib_bindings(imports: DataFrame, stdlib: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, name): what a file's imports of the standard library bind, unless another import of the file binds it too.

    imports: (path, module, original, bound, level): ``from module import
    original as bound``; for plain imports original is null, and without a bound
    name each dotted beginning of the module is bound.
    """
    top = F.split_part("module", F.lit("."), F.lit(1))
    parts = F.split("module", "[.]")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    names = F.when(F.col("bound").isNotNull(), F.array("bound")).when(F.col("original").isNotNull(), F.array("original")).otherwise(heads)
    rows = imports.select("path", "level", top.alias("top"), F.explode(names).alias("name")).filter("name <> '*'")
    rows = rows.join(stdlib.select(F.col("name").alias("top")).distinct().withColumn("std", F.lit(True)), "top", "left").join(roots.select(F.col("name").alias("top")).distinct().withColumn("own", F.lit(True)), "top", "left")
    std = (F.col("level") == 0) & F.col("std").isNotNull() & F.col("own").isNull()
    return rows.groupBy("path", "name").agg(F.bool_and(std).alias("only")).filter("only").select("path", "name")


def classes_available(coverage: DataFrame, available: DataFrame) -> DataFrame:
    """(language, classes) in decision order, of the languages that coverage rows (path, language) have; available: (language, class, position)."""
    present = coverage.select(language_of(F.col("path"), F.col("language")).alias("language")).filter("language is not null").distinct()
    return available.join(present, "language", "left_semi").groupBy("language").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "class"))), lambda x: x["class"]).alias("classes"))


def verification_base(languages: DataFrame, table: DataFrame) -> DataFrame:
    """languages (position, language) with their row of table (language, repos, on, depth), or what says that there is none."""
    rows = languages.join(F.broadcast(table.limit(1000)), "language", "left")
    n = F.coalesce("repos", F.lit(0))
    note = F.when(n == 0, "not verified on any repo").otherwise(F.concat(F.lit("verified on "), n.cast("string"), F.when(n == 1, " repo: ").otherwise(" repos: "), "on"))
    return rows.select("position", "language", n.alias("repos"), F.coalesce("on", F.lit("no verified repo")).alias("on"), F.coalesce("depth", F.lit("unverified")).alias("depth"), note.alias("note"))


def coverage_by_directory(coverage: DataFrame, depth: int = 2) -> DataFrame:
    """(dir, language, sites, unresolved, tail) from rows (path, language, sites, unresolved, tail: map of class to count)."""
    rows = coverage.select(directory_of(F.col("path"), depth).alias("dir"), language_of(F.col("path"), F.col("language")).alias("language"), "sites", "unresolved", "tail").filter("language is not null")
    sums = rows.groupBy("dir", "language").agg(F.sum("sites").alias("sites"), F.sum("unresolved").alias("unresolved"))
    tail = rows.select("dir", "language", F.explode("tail").alias("class", "n")).groupBy("dir", "language", "class").agg(F.sum("n").alias("n"))
    maps = tail.groupBy("dir", "language").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("tail"))
    return sums.join(maps, ["dir", "language"], "left")


def complement(coverage: DataFrame, interiors: DataFrame, errors: DataFrame) -> DataFrame:
    """Per unit of interiors (unit, path): sites, unresolved, and at most ten degradations from errors (seq, path, stage, message).

    An error counts if it is the repository's (``.`` or empty), or its path and
    one of the unit's folders contain each other.
    """
    paths = interiors.select("unit", "path").distinct()
    sums = paths.join(coverage.select("path", "sites", "unresolved"), "path", "left").groupBy("unit").agg(F.coalesce(F.sum("sites"), F.lit(0)).alias("sites"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"))
    folder = paths.select("unit", F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).distinct()
    ups = lambda c: F.transform(F.sequence(F.lit(0), F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "/")))), lambda k: F.array_join(F.slice(F.split(c, "/"), 1, k), "/"))
    where = errors.withColumn("at", F.when(F.coalesce("path", F.lit("")).isin("", "."), "").otherwise(F.rtrim("path", F.lit("/"))))
    around = where.join(folder.select("unit", F.explode(ups("dir")).alias("at")).distinct(), "at")  # the error's place holds the folder
    inside = where.select("seq", "path", "stage", "message", F.explode(ups("at")).alias("dir")).join(folder, "dir")
    text = F.concat("path", F.lit(": "), "stage", F.lit(": "), "message").alias("text")
    hit = around.select("unit", "seq", text).union(inside.select("unit", "seq", text)).distinct()
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("seq"))
    first = hit.withColumn("r", rank).filter("r <= 10").groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("degradations"))
    return sums.join(first, "unit", "left").withColumn("degradations", F.coalesce("degradations", F.array().cast("array<string>")))


def human_first(complements: DataFrame, least: int = 10, share: float = 0.5) -> DataFrame:
    """complements (unit, sites, unresolved) with human_first: enough sites, and more than that share of them unresolved."""
    return complements.withColumn("human_first", (F.col("sites") >= least) & (F.col("unresolved") / F.col("sites") > share))


def write_mounts(interiors: DataFrame, guards: DataFrame, forbidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit, path) that a unit may write: its interior and the files of tests that guard it; and those refused, which forbidden (path) marks."""
    every = interiors.select("unit", "path").union(guards.select("unit", "path")).distinct()
    return every.join(forbidden.select("path").distinct(), "path", "left_anti").select("unit", "path"), every.join(forbidden.select("path").distinct(), "path", "left_semi").select("unit", "path")


def refusal_record(refused: DataFrame) -> DataFrame:
    """One row (n, examples) about refused references (path, line, token, name), the first three as text; none if nothing was refused."""
    text = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" `"), "token", F.lit("` named `"), "name", F.lit("`"))
    first = refused.orderBy("path", "line", "token", "name").limit(3).withColumn("text", text)
    head = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "line", "token", "name", "text"))), lambda x: x["text"]).alias("examples"))
    return refused.agg(F.count("*").alias("n")).join(head, how="cross").filter("n > 0")
