"""Source trees as facts: one row per symbol, call, import, route or with-item of a file.

Python is read with its own grammar. Go, Rust, Java, C, TypeScript and HCL are
read by patterns of their declarations, calls and imports, which gives the rows
that the joins need (name, line, extent) but no scopes inside functions. Files
are parsed where they lie, one batch at a time; everything after is joins.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACTS = "path string, lang string, kind string, name string, scope string, line int, end_line int, col int, target string"
# File extensions and their languages, the verbs of route decorators, and the web frameworks.
LANGUAGES = {"py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "tf": "terraform"}
VERBS = {"get", "post", "put", "delete", "patch", "head", "options", "trace", "websocket"}

FRAMEWORKS = {"fastapi", "flask"}

# What declares a symbol, by language: pattern, kind. The name is group 1.
DECLARATIONS = {
    "go": [(r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]", "function"), (r"^type\s+(\w+)\s", "type")],
    "rust": [(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "function"), (r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", "type"), (r"^\s*macro_rules!\s+(\w+)", "macro")],
    "java": [(r"\b(?:class|interface|enum|record)\s+(\w+)", "class"), (r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], ]+\s+(\w+)\s*\([^;]*$", "method")],
    "c": [(r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{?\s*$", "function"), (r"^#\s*define\s+(\w+)", "macro"), (r"^(?:typedef\s+)?struct\s+(\w+)", "type")],
    "typescript": [(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", "function")],
    "terraform": [(r'^resource\s+"(\w+"\s+"\w+)"', "resource"), (r'^data\s+"(\w+"\s+"\w+)"', "data"), (r'^module\s+"(\w+)"', "tf-module")],
}
IMPORTS = {
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$', "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "java": r"^import\s+(?:static\s+)?([\w.]+)", "c": r'^#\s*include\s+[<"]([^>"]+)[>"]',
    "typescript": r"""(?:from|require\()\s*['"]([^'"]+)['"]""", "terraform": r'^\s*source\s*=\s*"([^"]+)"',
}
for _like, _of in (("cpp", "c"), ("javascript", "typescript")):
    DECLARATIONS[_like], IMPORTS[_like] = DECLARATIONS[_of], IMPORTS[_of]
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_WORDS = {"if", "for", "while", "switch", "return", "catch", "sizeof", "func", "fn", "function", "match", "defer", "go", "new", "await", "typeof", "synchronized"}


def python_facts(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        yield path, "python", "error", "", "", 0, 0, -1, ""
        return

    tops = {a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
    tops |= {n.module.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and not n.level and n.module}
    known = not tops.isdisjoint(FRAMEWORKS)  # a route without a literal path counts as declined only where a framework is imported

    def dotted(node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            return node.id
        return f"{dotted(node.value)}.{node.attr}" if isinstance(node, ast.Attribute) else ""

    def walk(node: ast.AST, scope: str) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            own = scope
            row = (path, "python")
            at = (getattr(child, "lineno", 0), getattr(child, "end_lineno", 0) or 0, getattr(child, "col_offset", -1))
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = f"{scope}.{child.name}" if scope else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                yield *row, kind, child.name, scope, *at, own
                for d in child.decorator_list:
                    call = d if isinstance(d, ast.Call) else None
                    name = dotted(call.func if call else d)
                    yield *row, "decorator", name, own, d.lineno, d.end_lineno or 0, d.col_offset, own
                    verb = name.rpartition(".")[2]
                    if call and "." in name and (verb == "route" or verb in VERBS):
                        literal = call.args and isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str)
                        verbs = [verb.upper()]
                        if verb == "route":
                            listed = next((k.value for k in call.keywords if k.arg == "methods"), None)
                            verbs = [e.value.upper() for e in getattr(listed, "elts", []) if isinstance(e, ast.Constant)] or ["GET"]
                        for v in verbs if literal else [""] * known:
                            yield *row, "route" if literal else "declined-route", v, own, d.lineno, d.lineno, d.col_offset, call.args[0].value if literal else ""
                if isinstance(child, ast.ClassDef):
                    for b in child.bases:
                        yield *row, "base", dotted(b), own, b.lineno, b.lineno, b.col_offset, own
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield *row, "import", a.asname or a.name, scope, *at, a.name
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    yield *row, "import", a.asname or a.name, scope, *at, "." * child.level + (child.module or "") + "." + a.name
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else "<expr>"
                col = (f.end_col_offset or 0) - len(name) if name != "<expr>" else f.col_offset
                yield *row, "call", name, scope, f.end_lineno or child.lineno, child.end_lineno or 0, col, dotted(f)
            elif isinstance(child, (ast.With, ast.AsyncWith)):
                for item in child.items:
                    if isinstance(item.context_expr, ast.Call):
                        yield *row, "with", dotted(item.context_expr.func), scope, item.context_expr.lineno, child.end_lineno or 0, item.context_expr.col_offset, ""
            yield from walk(child, own)

    yield from walk(tree, "")


_BLANK = re.compile(r"""/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])'""", re.S)


def _blanked(text: str) -> str:
    """The text with comments and literals blank, line by line as long as it was."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def body_end(lines: list[str], start: int) -> int:
    """The line on which the declaration at line start ends: its closing brace, its semicolon, or its own line.

    The opening brace may stand on a later line, after the rest of the head.
    """
    depth, opened = 0, False
    for k in range(start - 1, len(lines)):
        for c in lines[k]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
            elif c == ";" and not opened and depth == 0:
                return k + 1
            if opened and depth <= 0:
                return k + 1
        if not opened and k > start - 1 and not lines[k].strip():
            return start  # a blank line before any brace: there is no body
    return len(lines) if opened else start


def pattern_facts(path: str, lang: str, text: str) -> Iterator[tuple]:
    rules = [(re.compile(p), kind) for p, kind in DECLARATIONS.get(lang, [])]
    imports = re.compile(IMPORTS[lang]) if lang in IMPORTS else None
    lines = text.split("\n")
    plain = _blanked(text).split("\n")
    for n, line in enumerate(lines, 1):
        named = None
        for rule, kind in rules:
            m = rule.search(line)
            if m and m[1] not in _WORDS:
                named = m[1].replace('" "', ".").replace('"  "', ".")
                yield path, lang, kind, named, "", n, body_end(plain, n), m.start(1), named
                break
        if imports and (m := imports.search(line)):
            yield path, lang, "import", m[1], "", n, n, m.start(1), m[1]
        for m in _CALL.finditer(line) if lang != "terraform" else ():
            if m[1] not in _WORDS and m[1] != named:
                yield path, lang, "call", m[1], "", n, n, m.start(1), m[1]


def scan(files: DataFrame) -> DataFrame:
    """Facts of source files (path, text); files of other languages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FACTS.split(", ")]
        for pdf in batches:
            rows: list[tuple] = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                lang = LANGUAGES.get(path.rpartition(".")[2]) if isinstance(path, str) and isinstance(text, str) else None
                if lang:
                    rows += python_facts(path, text) if lang == "python" else pattern_facts(path, lang, text)
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text").mapInPandas(run, FACTS)


def modules(files: DataFrame) -> DataFrame:
    """Python modules: the import root is the directory above the topmost package.

    id is the import name, or ``root:name`` where two roots give the same name.
    """
    py = files.filter(F.col("path").endswith(".py")).select("path")
    packages = py.filter(F.col("path").rlike("(^|/)__init__[.]py$")).select(F.regexp_replace("path", "/?__init__[.]py$", "").alias("dir"))
    parts = F.split("path", "/")
    chain = py.select("path", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("k")).withColumn("dir", F.array_join(F.slice(F.split("path", "/"), 1, F.col("k")), "/"))
    marked = chain.join(packages.withColumn("package", F.lit(True)), "dir", "left")
    # the last ancestor that is no package is the root
    root = marked.filter("package is null").groupBy("path").agg(F.max_by("dir", "k").alias("root"), F.max("k").alias("depth"))
    rest = F.slice(parts, F.col("depth") + 1, F.size(parts))
    name = F.regexp_replace(F.array_join(rest, "."), "([.]__init__)?[.]py$", "")
    out = root.select("path", F.when(F.col("root") == "", ".").otherwise(F.col("root")).alias("root"), name.alias("import_name"), F.when(F.col("path").endswith("__init__.py"), "package").otherwise("module").alias("kind"))
    out = out.filter("import_name <> '__init__'")
    twins = F.count("*").over(Window.partitionBy("import_name"))
    return out.withColumn("id", F.when(twins == 1, F.col("import_name")).otherwise(F.concat_ws(":", "root", "import_name")))


def cli_entries(files: DataFrame) -> DataFrame:
    """(name, target, source) of ``[project.scripts]`` in each manifest; broken manifests give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    scripts = tomllib.loads(text).get("project", {}).get("scripts", {})
                except (tomllib.TOMLDecodeError, AttributeError, TypeError):
                    continue
                rows += [(k, v, path) for k, v in scripts.items() if isinstance(v, str)]
            yield pd.DataFrame(rows, columns=["name", "target", "source"])

    return files.filter(F.col("path").rlike("(^|/)pyproject[.]toml$")).select("path", "text").mapInPandas(run, "name string, target string, source string")


def test_files(files: DataFrame) -> DataFrame:
    """Files by the test runner's default names."""
    return files.filter(F.col("path").rlike("(^|/)(test_[^/]*|[^/]*_test)[.]py$"))
