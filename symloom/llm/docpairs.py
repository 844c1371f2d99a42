"""Functions paired with their documentation.

Comment spans and declaration spans are found independently of each other: comments by lexing the
files, declarations from the index. Ordered by position, a function takes the nearest comment before
it unless a statement or another declaration stands between; only where there is no file to lex does
the index's own record of the comment count. What a comment says beyond name, signature, markup and
set phrases decides whether the pair is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEWEST_WORDS = 2  # informative words (or twice as many ideographs or kana) that a description has

# Words that describe nothing by themselves, in lower case and without endings.
EMPTY_WORDS = tuple(
    "a above add an and as at available be below by class com complet compléter constructor create creat default descr description do doc docs documentation document enter entry "
    "fill fixme for from func function go goe generat get here hier in init initialis initializ initialiser initializer insert instanc is it ipsum lat later lorem mark method missing "
    "n na new no nodoc none noth null oben of on or overview param parameter placeholder plea pleas property return see self set siehe some someth struct subroutin summary "
    "tba tbd text that the this throw to todo typ type undocument undocumented unten value var voir voyez will wip with xxx à ver arriba ci dessus dessous".split()
)
EMPTY_TEXTS = ("説明", "概要", "未記入", "後で", "同上", "なし", "説明文", "要記入", "ドキュメント")
_LINE = r"""(?imx)^[\t\p{Zs}]*+(?:/{2,}+!?|/\*++|\*++/?|\#++(?=\s))?[\t\p{Zs}]*+
    (?:[-*•+][\t\p{Zs}]++)?(?:
      (?-i:MARK|TODO|FIXME|XXX|HACK)\b.*         # notes to oneself
    | (?:swiftlint|swiftformat|sourcery)\s*:.*   # directives
    | :nodoc:.*
    | @?param(?:eter)?[\x20\t]++(\w++)[\x20\t]*+:[\x20\t]*+\1?[\x20\t]*+$   # fields that repeat their name or say nothing
    | (?:parameters?|returns?|throws|note|warning|important|precondition|complexity|see(?:also)?|@\w++)[\x20\t]*+(?::|$)
    | @?param(?:eter)?[\x20\t]++\w++[\x20\t]*+:
    | \w++[\x20\t]*+:[\x20\t]*+$
    )"""

_PIECE = regex.compile(
    r"""(?P<doc>^[^\S\n]*///[^\n]*+(?:\n[^\S\n]*///[^\n]*+)*+|^[^\S\n]*/\*\*(?!/)(?:[^*]|\*(?!/))*+(?:\*/)?)
    |(?P<note>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)
    |(?P<string>\#*\"\"\"(?:[^"\\]|\\.|"(?!""))*+(?:\"\"\"\#*)?|\#*"(?:[^"\\\n]|\\.)*+"?\#*)""",
    regex.VERBOSE | regex.DOTALL | regex.MULTILINE,
)
_CODE = regex.compile(r"[^\s\uFEFF]")
_ATTRIBUTES = regex.compile(r"@\w+(?:\([^()\n]*\))?")
_SIGNS = regex.compile(r"^[^\S\n]*(?:/{3} ?|/\*+|\*+/?)|(?<!\*)\*+/$", regex.M)


def spans(text: str) -> list[tuple[str, int, str | None]]:
    """Spans of one file in order: (``comment``, last line, text) for each block of doc comments that
    starts its line, (``code``, line, None) for the first statement after each block."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[tuple[str, int, str | None]] = []
    line, at, coded = 1, 0, False  # the line of ``at``; whether code since the last comment was reported

    def code(start: int, end: int) -> None:
        nonlocal coded
        if coded or start >= end:
            return
        gap = text[start:end]
        if "@" in gap:  # attributes belong to what follows them
            gap = _ATTRIBUTES.sub(lambda m: " " * len(m.group()), gap)
        first = _CODE.search(gap)
        if first:
            out.append(("code", line + gap.count("\n", 0, first.start()), None))
            coded = True

    for match in _PIECE.finditer(text):
        kind, start, end = match.lastgroup, match.start(), match.end()
        if kind == "note" or (kind == "string" and coded):
            code(at, start)
        elif kind == "string":
            code(at, end)
        else:
            code(at, start)
            last = line + text.count("\n", at, end)
            out.append(("comment", last, _SIGNS.sub("", match.group())))
            coded = False
        line += text.count("\n", at, end)
        at = end
    code(at, len(text))
    return out


def source_spans(sources: DataFrame) -> DataFrame:
    """(projectId, filePath, what, line, text) of each distinct file with content, whose first row has the
    line -1 and says ``file``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, f, *s) for p, f, t in zip(batch["projectId"], batch["filePath"], batch["content"], strict=True) for s in (("file", -1, None), *spans(t))]
            yield pd.DataFrame(found, columns=["projectId", "filePath", "what", "line", "text"])

    files = sources.where("content IS NOT NULL AND filePath IS NOT NULL AND projectId IS NOT NULL").select("projectId", "filePath", "content")
    # One content per file: repeats are alike, and of several the greatest is taken.
    once = files.groupBy("projectId", "filePath").agg(F.max("content").alias("content"))
    return once.mapInPandas(rows, "projectId long, filePath string, what string, line int, text string")


def _words(column: Column) -> Column:
    split = F.lower(F.regexp_replace(column, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", " "))
    return F.transform(F.regexp_extract_all(split, F.lit(r"([\p{L}]+|[0-9]+)"), 1), lambda w: F.regexp_replace(w, r"(?<=\p{L}{3})(ing|ed|es|e|s)$", ""))


def informative(text: Column, name: Column, signature: Column) -> Column:
    """Whether a documentation text says something beyond name and signature.

    Code samples, tags, placeholders, rulers, notes to oneself, directives and empty fields are
    taken out first; then the words of name and signature and words that describe nothing. Null is
    false.
    """
    plain = F.regexp_replace(text, r"(?s)```.*?(```|$)|<#.*?#>|</?\w+[^>]*>", " ")
    plain = F.regexp_replace(plain, _LINE, " ")
    for phrase in EMPTY_TEXTS:
        plain = F.regexp_replace(plain, rf"^[\s\p{{Z}}]*{phrase}[\s\p{{Z}}。.]*$", "")
    known = F.array_union(F.array_union(_words(F.coalesce(name, F.lit(""))), _words(F.coalesce(signature, F.lit("")))), F.array(*map(F.lit, EMPTY_WORDS)))
    kana = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
    left = F.array_except(F.filter(_words(F.regexp_replace(plain, f"[{kana}]", " ")), lambda w: w != ""), known)
    signs = F.length(F.regexp_replace(plain, f"[^{kana}]+", ""))
    return F.coalesce(F.size(left) + signs / 2 >= FEWEST_WORDS, F.lit(False))


def function_comments(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(symbol_id, name, signature, documentation, origin) of each function or initializer, each id once.

    Where the file has content, the documentation is the nearest doc comment lexed from it that ends
    before the function, unless a statement or another declaration of the index stands between; null
    where there is none, and ``origin`` is ``comment``. Where the file has no content, or the symbol
    no file or line, there is nothing to pair with, so the text that the index recorded stands in,
    with the ``origin`` ``record``. Symbols without an id are left out; of several rows of an id the
    greatest counts.
    """
    is_function = F.col("kind").isin("function", "initializer")
    # Of other declarations only the place is needed.
    texts = [F.when(is_function, F.col(c)).alias(c) for c in ("name", "signature", "documentation")]
    index = symbols.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("projectId", "filePath", "line", "column", "kind", *texts)).alias("s")).select("id", "s.*")
    placed = F.col("filePath").isNotNull() & F.col("line").isNotNull() & F.col("projectId").isNotNull()
    function = F.struct("id", "name", "signature", "documentation")
    nowhere = index.where(is_function & ~placed).select(F.col("id").alias("symbol_id"), "name", "signature", "documentation", F.lit("record").alias("origin"))
    # A declaration comes before what follows it at its place: rank 1 asks, and then rank 2 stands between.
    own = index.where(placed).select(
        F.col("projectId").alias("project"), F.col("filePath").alias("file"), "line", F.coalesce("column", F.lit(0)).alias("column"), F.lit(2).alias("rank"),
        F.lit("code").alias("event"), F.lit(None).cast("string").alias("text"), F.when(is_function, function).alias("function"),
    )
    # A statement stands between a comment and the declarations of later lines only.
    code = F.col("what") == "code"
    lexed = source_spans(sources).select(
        F.col("projectId").alias("project"), F.col("filePath").alias("file"), F.when(code, F.col("line") + 1).otherwise(F.col("line")).alias("line"),
        F.when(code, -1).when(F.col("what") == "file", -2).otherwise(1 << 30).alias("column"), F.lit(0).alias("rank"), F.col("what").alias("event"), "text", F.lit(None).cast(own.schema["function"].dataType).alias("function"),
    )
    before = Window.partitionBy("project", "file").orderBy("line", "column", "rank", "function.id").rowsBetween(Window.unboundedPreceding, -1)
    nearest = own.unionByName(lexed).select(
        "function", F.last(F.struct("event", "text")).over(before).alias("last"), F.coalesce(F.max(F.col("event") == "file").over(before), F.lit(False)).alias("has_text"),
    ).where("function IS NOT NULL")
    found = F.when(F.col("last.event") == "comment", F.col("last.text"))
    return nearest.select(
        F.col("function.id").alias("symbol_id"), "function.name", "function.signature", F.when(F.col("has_text"), found).otherwise(F.col("function.documentation")).alias("documentation"),
        F.when(F.col("has_text"), "comment").otherwise("record").alias("origin"),
    ).unionByName(nowhere)


def described_functions(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(symbol_id, signature, documentation) of the functions whose signature isn't blank and whose
    documentation says something."""
    pairs = function_comments(symbols, sources).where(F.col("signature").rlike(r"[^\s\p{Z}\x{200B}\x{FEFF}]"))
    return pairs.where(informative(F.col("documentation"), F.col("name"), F.col("signature"))).select("symbol_id", "signature", "documentation")
