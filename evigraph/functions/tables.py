"""Table functions for text that must be parsed, not matched."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf


@udtf(returnType="pos: int, segment: string, neutral: boolean")
class Segments:
    """Segments of a compound command, without leading assignments; a command whose quotes don't close is one, as it stands."""

    def eval(self, command: str) -> Iterator[tuple[int, str, bool]]:
        from evigraph.operators.rules import is_neutral, split_segments, without_assignments

        own = split_segments(command or "")
        if own is None:
            yield 0, command, False
        else:
            for k, segment in enumerate(own):
                yield k, without_assignments(segment), is_neutral(segment)


@udtf(returnType="section: int, path: string, old_path: string, created: boolean, deleted: boolean, renamed: boolean, binary: boolean, added: int, removed: int")
class DiffSections:
    """One row per file of a unified diff: its path (a deleted file's old one), what happened to it, and its counts of lines.

    Hunk headers say how many lines follow, so lines that look like headers
    inside a hunk are counted as what they are.
    """

    def eval(self, text: str) -> Iterator[tuple]:
        own, n, old, new = None, 0, 0, 0

        def row() -> tuple:
            path = own["old"] if own["new"] in ("", "/dev/null") else own["new"]
            return n, path, own["old"], own["old"] == "/dev/null" or own["created"], own["new"] == "/dev/null" or own["deleted"], own["renamed"], own["binary"], own["+"], own["-"]

        def fresh() -> dict:
            return {"old": "", "new": "", "created": False, "deleted": False, "renamed": False, "binary": False, "+": 0, "-": 0, "named": False}

        for line in (text or "").split("\n"):
            if old > 0 or new > 0:
                mark = line[:1]
                if mark in "+-":
                    own[mark] += mark != ""
                old -= mark in ("-", " ", "")
                new -= mark in ("+", " ", "")
                continue
            if line.startswith("diff --git ") or (line.startswith("--- ") and (own is None or own["named"])):
                if own:
                    yield row()
                    n += 1
                own = fresh()
            if own is None:
                continue
            head, _, rest = line.partition(" ")
            if head == "---":
                own["old"], own["named"] = rest.split("\t")[0].removeprefix("a/"), True
            elif head == "+++":
                own["new"] = rest.split("\t")[0].removeprefix("b/")
            elif head == "@@" and (m := re.match(r"@@ -\d+(?:,(\d+))? [+]\d+(?:,(\d+))? @@", line)):
                old, new = (int(x) if x else 1 for x in m.groups())
            elif line.startswith("new file mode"):
                own["created"] = True
            elif line.startswith("deleted file mode"):
                own["deleted"] = True
            elif line.startswith(("rename from ", "rename to ")):
                own["renamed"] = True
                own["old" if "from" in line[:12] else "new"] = line.split(" ", 2)[2]
            elif line.startswith(("Binary files ", "GIT binary patch")):
                own["binary"] = True
                if not own["new"] and (m := re.match(r"Binary files (?:a/)?(.*) and (?:b/)?(.*) differ", line)):
                    own["old"], own["new"] = m.groups()
        if own:
            yield row()


@udtf(returnType="post: int, action: string, parent: int, text: string")
class AddedAnchors:
    """The added lines of one file's hunks: line after the change, whether it replaces a line, and that line before the change.

    An added line replaces the removed lines of its run in order; further ones
    are inserted after the last line before them.
    """

    def eval(self, text: str) -> Iterator[tuple]:
        old = new = 0
        gone: list[int] = []
        inside = False
        for line in (text or "").split("\n"):
            m = re.match(r"@@ -(\d+)(?:,(\d+))? [+](\d+)(?:,\d+)? @@", line)
            if m:
                old, new, gone, inside = int(m[1]) + (m[2] == "0"), int(m[3]), [], True
            elif not inside:
                continue
            elif line.startswith("-"):
                gone.append(old)
                old += 1
            elif line.startswith("+"):
                yield (new, "replace", gone.pop(0), line[1:]) if gone else (new, "insert", old - 1, line[1:])
                new += 1
            elif line.startswith(" "):
                old, new, gone = old + 1, new + 1, []
            elif not line.startswith("\\"):
                inside = False


@udtf(returnType="pos: int, kind: string, name: string")
class Descriptors:
    """The descriptor chain of a symbol's moniker: namespaces ``/``, types ``#``, terms ``.``, methods ``().``, macros ``!``."""

    ENDS = {"/": "namespace", "#": "type", ".": "term", "!": "macro", ":": "meta"}

    def eval(self, moniker: str) -> Iterator[tuple[int, str, str]]:
        own = (moniker or "").split(" ", 4)
        if len(own) < 5 or own[0] == "local" or not own[0] or not own[4]:
            return  # local to a document, or not a whole moniker
        name, pos, k, text = "", 0, 0, own[4]
        while k < len(text):
            c = text[k]
            if c == "`":
                end = text.find("`", k + 1)
                end = len(text) if end < 0 else end
                name += text[k + 1 : end]
                k = end
            elif c == "(":
                end = text.find(")", k)
                if end < 0:
                    return
                yield pos, "method", name
                name, pos, k = "", pos + 1, end + 1
            elif c in self.ENDS:
                yield pos, self.ENDS[c], name
                name, pos = "", pos + 1
            else:
                name += c
            k += 1
