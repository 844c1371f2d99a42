"""Tokens of Swift files as a table: the one step that reads text a file at a time.

A token carries its place, the bracket that matches it and the brace that it stands in; comments and
blanks are left out. What tokens mean is found by Spark from there on.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

COLUMNS = (
    "projectId long, filePath string, pos int, token string, start int, stop int, line int, column int, last_line int, mate int, mate_line int, brace int, round int, callee string, doc string, above array<int>"
)
ROWS = 20_000

_TOKEN = re.compile(
    r"""(?:[^\S\r\n]|\uFEFF|\r\n|\r|\n)*+(?:(?P<doc>///[^\r\n]*)|(?P<note>//[^\r\n]*)|(?P<block>/\*)|(?P<text>\#*")
    |(?P<token>[@\#]?`?[^\W\d]\w*`?|\$\w+|\d\w*(?:\.\d\w*)?|->|\S))""",
    re.VERBOSE,
)
_BLOCK_PART = re.compile(r"/\*|\*/")
_IN_LINE, _IN_TEXT = re.compile(r'[\\"()\r\n]'), re.compile(r'[\\"()]')
_OPENERS = {")": "(", "]": "[", "}": "{"}


def _comment_end(text: str, at: int) -> int:
    """The end of the block comment that begins at ``at``, comments within it included."""
    level = 0
    for part in _BLOCK_PART.finditer(text, at):
        level += 1 if part.group() == "/*" else -1
        if not level:
            return part.end()
    return len(text)


def _literal_end(text: str, at: int) -> int:
    """The end of the string literal that begins at ``at``; what it interpolates belongs to it.

    A stack holds the literals that are open, each with the brackets open in its interpolation (0
    outside of one).
    """
    stack: list[list] = []
    while True:
        if not stack or stack[-1][2]:  # code: at the beginning, or in an interpolation
            found = None if not stack else (_IN_LINE if stack[0][3] else _IN_TEXT).search(text, at)
            if stack and (not found or found.group() in "\r\n"):
                return found.start() if found else len(text)
            if stack and found.group() in "()\\":
                stack[-1][2] += {"(": 1, ")": -1}.get(found.group(), 0)
                at = found.end()
                continue
            marks, at = (0, found.start()) if stack else (0, at)
            while not stack and text[at + marks] == "#":
                marks += 1
            quote = '"""' if text.startswith('"""', at + marks) else '"'
            at += marks + len(quote)
            stack.append([quote + "#" * marks, "\\" + "#" * marks, 0, len(quote) == 1])
        close, escape, _, single = stack[-1]
        found = (_IN_LINE if single else _IN_TEXT).search(text, at)
        if not found or found.group() in "\r\n":
            return found.start() if found else len(text)
        at = found.start()
        if text.startswith(close, at):
            at += len(close)
            stack.pop()
            if not stack:
                return at
        elif text.startswith(escape, at):
            at += len(escape)
            if text.startswith("(", at):
                stack[-1][2] = 1
            at += 1
        else:
            at += 1


def lex(text: str) -> dict[str, list]:
    """The columns of one text's tokens, from ``token`` on."""
    breaks = [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]
    out: dict[str, list] = {name: [] for name in ("token", "start", "stop", "line", "column", "last_line", "mate", "mate_line", "brace", "round", "callee", "doc", "above")}
    docs: list[str] = []
    opened: list[int] = []  # brackets
    braces: list[int] = []
    rounds = [0]
    at = 0
    while match := _TOKEN.match(text, at):
        kind, at = match.lastgroup, match.end()
        start = match.start(kind)
        if kind == "doc":
            docs.append(match[kind][3:].strip())
            continue
        if kind == "block":
            at = _comment_end(text, start)
            if text.startswith("/**", start) and at - start > 4:
                docs.append(text[start + 3 : at - 2].strip())
            continue
        if kind == "note":
            continue
        if kind == "text":
            at = _literal_end(text, start)
        token, pos = text[start:at], len(out["token"])
        row = bisect_right(breaks, start)
        last = bisect_right(breaks, at - 1)
        mate = None
        if token in _OPENERS:
            while token == "}" and opened and out["token"][opened[-1]] != "{":  # a brace closes what was left open within it
                opened.pop()
            if opened and out["token"][opened[-1]] == _OPENERS[token]:
                mate = opened.pop()
                out["mate"][mate], out["mate_line"][mate] = pos, row + 1
                if token == "}":
                    braces.pop()
                    rounds.pop()
                else:
                    rounds[-1] -= 1
        before = out["token"][-1] if pos else ""
        for name, value in (
            ("token", token), ("start", start), ("stop", at), ("line", row + 1), ("column", start - (breaks[row - 1] if row else 0) + 1), ("last_line", last + 1), ("mate", mate), ("mate_line", None if mate is None else out["line"][mate]),
            ("brace", braces[-1] if braces else -1), ("round", rounds[-1]), ("callee", None), ("doc", "\n".join(docs) if docs else None), ("above", None),
        ):
            out[name].append(value)
        docs.clear()
        if token in ("(", "[", "{"):
            if token == "{":
                call = out["mate"][pos - 1] if before == ")" else None
                out["callee"][pos] = (out["token"][call - 1] if call else None) if before == ")" else before
                out["above"][pos] = [*braces[-64:]]
                braces.append(pos)
                rounds.append(0)
            else:
                out["callee"][pos] = before
                rounds[-1] += 1
            opened.append(pos)
    return out


def tokens(sources: DataFrame) -> DataFrame:
    """(projectId, filePath, pos, token, ...) of each file with content, each file once; of several contents the
    greatest counts.

    ``round`` counts the round and square brackets open around a token within its brace (an opening one not
    itself), ``brace`` is the position of the brace it stands in or -1, ``above`` on a brace are the
    (64 innermost) braces around it, ``callee`` on a bracket is the word it follows, for a trailing
    closure that of the call; ``doc`` are the documentation comments right before the token.
    """
    schema = to_arrow_schema(StructType.fromDDL(COLUMNS))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for project, path, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = lex(content.as_py())
                for first in range(0, len(found["token"]), ROWS):
                    part = [c[first : first + ROWS] for c in found.values()]
                    n = len(part[0])
                    columns = [[project.as_py()] * n, [path.as_py()] * n, range(first, first + n), *part]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    files = sources.where("content IS NOT NULL AND filePath IS NOT NULL").groupBy("projectId", "filePath").agg(F.max("content").alias("content"))
    return files.mapInArrow(rows, COLUMNS)
