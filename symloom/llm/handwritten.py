"""Which files are hand-written source of their project.

Each file is lexed and re-emitted in a canonical layout: one statement a line, a brace ends its line
or stands alone, one space between tokens. Against the original, extreme expansion marks minified
code; statements of one perfectly uniform shape mark tool output; literals that make up nearly all
of the code mark data. A canonical text that several projects hold is a copy of something that
none of them wrote. What layout and text can't tell (a tool that writes like a person, a library
that one project took in) is left to the comment that the file opens with, to its path, and, where
there is no content, to its rows in symbols.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.session import cut

EXPANSION = 4.0  # canonical lines per original line with code
COPIES = 3  # projects that hold a text before it counts as a copy: of two, either may be its author
LITERALS = 0.65  # share of the code's characters
UNIFORM = 0.75  # share of statements that have the shape of the one a fixed number of statements on
SHORT = 200  # characters of a shape that is worth remembering
FEWEST = 8  # statements, or symbols, below which layout says nothing

# Folders and file endings that by convention hold what people didn't write there.
VENDOR_FOLDERS = (".build", "carthage", "checkouts", "deps", "external", "node_modules", "pods", "sourcepackages", "submodules", "third_party", "third-party", "thirdparty", "vendor", "vendored")
TOOL_FOLDERS = ("autogen", "codegen-output", "deriveddata", "derivedsources", "generated", "generatedmocks", "generatedsources", "__generated__")
TOOL_ENDINGS = (".g", ".gen", ".generated", ".graphql", ".grpc", ".min", ".pb", "_generated", "+generated", "-generated")
# Marks that tools and people put into opening comments, in lower case.
TOOL_MARKS = (
    r"@generated\b", r"\bauto-?generated\b", r"\bmachine[- ](written|generated|made)\b", r"\bgenerated (by|from|with|using)\b", r"\bregenerated?\b", r"\bdo not (edit|modify|change)\b", r"\bproduced by\b", r"\boutput of\b",
    r"\bautomati\w+ (erzeugt|generiert|erstellt)\b", r"\b(produit|généré|créé) automatiquement\b", r"\b(generado|creado) automáticamente\b", r"自動生成", r"\bswift-format-ignore-file\b",
)
VENDOR_MARKS = (r"\bvendored\b", r"\bupstream\b", r"\b(copied|copy|snapshot|forked|fork|mirror) (from|of)\b", r"\bthird[- ]party\b", r"\bby the .{1,80} (contributors|authors)\b", r"\bspdx-license-identifier\b", r"\blicen[cs]ed under\b")

_TOKEN = re.compile(
    r"""(?:[^\S\r\n]|\uFEFF)*+(?:
     (?P<word>(?:[^\W\d]|[$@\#`])[\w$`]*)
    |(?P<line>\r\n|\r|\n)
    |(?P<comment>//[^\r\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)
    |(?P<string>\#*\"\"\"(?:[^"\\]|\\.|"(?!""))*+(?:\"\"\"\#*)?|\#*"(?:[^"\\\r\n]|\\.)*+"?\#*)
    |(?P<number>-?(?:0x[0-9A-Fa-f_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?))
    |(?P<sign>\S))""",
    re.VERBOSE | re.DOTALL,
)
_ELEMENTS, _OPTIONALS = re.compile(r"\[ (?:T|i)(?: : (?:T|i))? \]"), re.compile(r"T(?: \?)+")
_KEYWORDS = frozenset("actor associatedtype async await case class enum extension fileprivate func guard if import in init inout internal let nil open private protocol public return self static struct switch throws var while for else".split())
_ACCESS = frozenset("public private internal fileprivate open".split())


@lru_cache(maxsize=50_000)
def _bend(shape: str) -> str:
    """A statement's shape: types in brackets, optionals and argument lists don't tell it apart."""
    return _OPTIONALS.sub("T", _ELEMENTS.sub("T", shape)) if "T" in shape or "[" in shape else shape


def uniformity(shapes: list[str]) -> float:
    """The greatest share of statements that have the shape of the one a period on, over all periods up to a
    third of the statements.

    Agreements are counted for all periods at once, shape by shape: by the distances between a rare
    shape's positions, and by a Fourier transform of a frequent one's, so long files cost n ** 1.5.
    """
    n = len(shapes)
    most = n // 3
    if not most:
        return 0.0
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(x, len(known)) for x in shapes])
    same = np.zeros(most + 1, dtype=np.int64)
    if n <= 400:
        for period in range(1, most + 1):
            same[period] = np.count_nonzero(codes[:-period] == codes[period:])
    else:
        size = 1 << (2 * n - 1).bit_length()
        order = np.argsort(codes, kind="stable")
        for at in np.split(order, np.cumsum(np.bincount(codes))[:-1]):
            if len(at) ** 2 <= 4 * size:
                for i in range(1, len(at)):
                    apart = at[i:] - at[:-i]
                    np.add.at(same, apart[apart <= most], 1)
            else:
                marks = np.zeros(size)
                marks[at] = 1.0
                turned = np.fft.rfft(marks)
                same += np.rint(np.fft.irfft(turned * turned.conj(), size)[: most + 1]).astype(np.int64)
    return float((same[1:] / (n - np.arange(1, most + 1))).max())


def reemit(text: str) -> dict:
    """One file in canonical layout, and what its original has: ``lines`` (brace depth, canonical line),
    the ``shapes`` of its statements, the ``head`` comments, and counts of original lines that hold
    code, of characters of code and of those in literals."""
    head: list[str] = []
    lines: list[tuple[int, str]] = []
    shapes: list[str] = []
    words: list[str] = []
    shape: list[str] = []
    code = literal = brackets = original = depth = 0
    fresh = True

    def emit() -> None:
        if shape:
            whole = " ".join(shape)
            shapes.append(_bend(whole) if len(whole) < SHORT else _bend.__wrapped__(whole))
            shape.clear()
        if words:
            lines.append((depth, " ".join(words)))
            words.clear()

    for match in _TOKEN.finditer(text):
        kind = match.lastgroup
        token = match[kind]
        if kind == "comment":
            if not code and not token.startswith("///"):
                head.append(token)
            continue
        if kind == "line":
            fresh = True
            if not brackets:
                emit()
            continue
        if fresh:
            original, fresh = original + 1, False
        code += len(token)
        if kind in ("string", "number"):
            literal += len(token)
            original += token.count("\n")
            words.append(token)
            shape.append("S" if kind == "string" else "0")
        elif kind == "word":
            words.append(token)
            if token not in _ACCESS:
                shape.append(token if token in _KEYWORDS else "T" if token[0].isupper() else "i")
        elif token == ";":
            emit()
        elif token == "{":
            words.append(token)
            emit()
            depth += 1
        elif token == "}":
            emit()
            depth = max(0, depth - 1)
            lines.append((depth, token))
        else:
            words.append(token)
            brackets = max(0, brackets + (token in "([") - (token in ")]"))
            if token == "," and shape and shape[-1] in "S0":  # a comma between literals is part of the data
                literal += 1
                continue
            if shape and shape[-1] in "S0" and token in "S0":
                continue
            shape.append(token)
    emit()
    return {"head": head, "lines": lines, "shapes": shapes, "original": original, "code": code, "literal": literal}


def canonical(text: str) -> str:
    """The canonical layout of a file as text; it is its own canonical layout."""
    return "\n".join("    " * depth + line for depth, line in reemit(text)["lines"])


def layout(text: str) -> dict:
    """Figures that compare one file's original with its canonical layout."""
    new = reemit(text)
    statements = [x for x in new["shapes"] if not x.startswith(("import", "i import"))]
    n, original, code = len(statements), new["original"], new["code"]
    digest = xxhash.xxh3_64_intdigest("\n".join(line for _, line in new["lines"]).encode("utf-8", "surrogatepass"))
    return {
        "head": re.sub(r"[\s*/]+", " ", " ".join(new["head"])).strip().lower(),
        "n_statements": n,
        "expansion": len(new["lines"]) / original if original else 0.0,
        "literals": new["literal"] / code if code else 0.0,
        "uniform": uniformity(statements),
        "digest": digest - (1 << 63),
    }


FIGURES = "project_id long, file_path string, head string, n_statements int, expansion double, literals double, uniform double, digest long"


def layouts(sources: DataFrame) -> DataFrame:
    """The figures of each row of source_files that has a path and content."""
    names = ["head", "n_statements", "expansion", "literals", "uniform", "digest"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            figures = pd.DataFrame([layout(t) for t in batch["content"]], index=batch.index, columns=names)
            yield pd.concat([batch[["project_id", "file_path"]], figures], axis=1)

    return sources.where("filePath IS NOT NULL AND content IS NOT NULL").select(F.col("projectId").alias("project_id"), F.col("filePath").alias("file_path"), "content").mapInPandas(rows, FIGURES)


def _says(column: str, phrases: tuple[str, ...]) -> Column:
    return F.col(column).rlike("(?u)" + "|".join(phrases))


def path_reason(path: Column, root: Column) -> Column:
    """``vendored`` or ``generated`` by the folders below the project's root and the file's ending."""
    inside = F.lower(F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path))
    parts = F.split(inside, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.swift$", "")
    tool = F.arrays_overlap(folders, F.array(*map(F.lit, TOOL_FOLDERS))) | F.exists(folders, lambda x: F.endswith(x, F.lit(".generated")))
    for ending in TOOL_ENDINGS:
        tool = tool | F.endswith(stem, F.lit(ending))
    return F.when(F.arrays_overlap(folders, F.array(*map(F.lit, VENDOR_FOLDERS))), "vendored").when(tool, "generated")


def file_evidence(symbols: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_path, layout, copy, comment, path, rows) of each distinct filePath of ``symbols``: what each kind
    of evidence says of it, null where it says nothing.

    ``rows`` is asked only of a file without code (content null, empty or missing): very many
    symbols on a line are minified, names that nearly all end in a number are generated. Rows
    without a path name no file. If a path has several contents, any of them decides. Repeated
    rows change nothing.
    """
    inner = F.col("kind") != "file"
    place = F.struct("line", "column", "name")
    # Distinct places once; what is counted per file is combined map-side.
    places = symbols.where("filePath IS NOT NULL").groupBy(F.col("filePath").alias("file_path"), F.when(inner, F.col("line")).alias("line"), F.when(inner, place).alias("place")).agg(F.min("projectId").alias("project_id"))
    by_line = places.groupBy("file_path", "line").agg(F.min("project_id").alias("project_id"), F.count("place").alias("n"), F.count(F.when(F.col("place.name").rlike("[0-9]$"), 1)).alias("n_numbered"))
    by_file = by_line.groupBy("file_path").agg(F.min("project_id").alias("project_id"), F.sum("n").alias("n_symbols"), F.count(F.when(F.col("n") > 0, F.col("line"))).alias("n_lines"), F.sum("n_numbered").alias("n_numbered"))
    roots = projects.where("id IS NOT NULL").groupBy(F.col("id").alias("project_id")).agg(F.min("rootPath").alias("root"))
    figures = layouts(sources)
    long = F.col("n_statements") >= FEWEST
    read = figures.groupBy("file_path").agg(
        F.max(_says("head", TOOL_MARKS)).alias("tool"), F.max(_says("head", VENDOR_MARKS)).alias("vendor"), F.max((F.col("expansion") >= EXPANSION) & long).alias("minified"),
        F.max(F.col("literals") >= LITERALS).alias("data"), F.max((F.col("uniform") >= UNIFORM) & long).alias("regular"), F.max(F.col("n_statements") > 0).alias("has_code"),
        F.max(F.when(long, F.struct("digest", "project_id"))).alias("text"),
    )
    # Figures are a short row per file: written once, so that no file is lexed again for the count of copies.
    read = cut(read)
    # Holders of a text by project first, so that a text all projects hold is one row per project.
    holders = read.where("text.project_id IS NOT NULL").select("text.digest", "text.project_id").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n_projects")).where(F.col("n_projects") >= COPIES)
    read = read.withColumn("digest", F.col("text.digest")).join(holders, "digest", "left")
    blind = ~F.coalesce("has_code", F.lit(False)) & (F.col("n_symbols") >= FEWEST)
    return by_file.join(roots, "project_id", "left").join(read, "file_path", "left").select(
        "file_path",
        F.when(F.col("minified"), "minified").when(F.col("data"), "data").when(F.col("regular"), "generated").alias("layout"),
        F.when(F.col("n_projects").isNotNull(), "vendored").alias("copy"),
        F.when(F.col("vendor"), "vendored").when(F.col("tool"), "generated").alias("comment"),
        path_reason(F.col("file_path"), F.coalesce("root", F.lit(""))).alias("path"),
        F.when(blind & (F.col("n_symbols") >= 4 * F.col("n_lines")), "minified").when(blind & (F.col("n_numbered") >= UNIFORM * F.col("n_symbols")), "generated").alias("rows"),
    )


EVIDENCE = ("layout", "copy", "comment", "path", "rows")


def foreign_files(symbols: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_path, reason) of each distinct filePath of ``symbols`` that isn't hand-written: ``minified``,
    ``data``, ``generated`` or ``vendored`` by the first ``EVIDENCE`` that says so (``file_evidence``)."""
    return file_evidence(symbols, sources, projects).select("file_path", F.coalesce(*EVIDENCE).alias("reason")).where("reason IS NOT NULL")
