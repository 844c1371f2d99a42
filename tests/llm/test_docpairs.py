from pyspark.sql import functions as F

from symloom.llm.docpairs import described_functions, function_comments, informative, spans
from tests.conftest import as_set

SYMBOLS = "id long, projectId long, kind string, name string, filePath string, line int, column int, signature string, documentation string, event string, rank int"
FILES = "projectId long, filePath string, content string, what string"


def sym(i, kind="function", name="load", line=1, doc=None, sig="()", path="/a.swift", column=1, project=1):
    return (i, project, kind, name, path, line, column, sig, doc, "clash", 3)


NOTHING = [
    None, "", "   ", "　", "​", "-", "...", "***", "----------------", "???", "TODO", "TODO: document", "FIXME: docs missing!", "tbd", "N/A.", "n/a", "lorem", "undocumented", "Summary.", "Description",
    "Documentation goes here", "No overview available.", "Add a description here.", "See above.", "Siehe oben.", "à compléter", "説明", "<#Description#>", "<p></p>", ":nodoc:", "MARK: - Private API",
    "swiftlint:disable:next function_body_length", "sourcery: skip", "loadWideQuery", "`loadWideQuery`", "loadWideQuery()", "func loadWideQuery", "Load wide query.", "Load wide query function.", "This method will load wide query.",
    "Loads the wide query.", "===== loadWideQuery =====", "/// load wide query", "Creates a new instance.", "Initializer.", "- Returns: ", "- Parameter note: note", "- Parameters:\n  - note:\n- Throws:",
    "- Parameter note: <#note description#>\n- Returns: <#return value description#>", "```swift\nlet x = somethingElse(other)\n```",
]
SOMETHING = [
    "Skips hidden rows.", "Retries 3 times, then throws.", "nil means the note was never opened.", "O(n) in the number of notes.", "- Note: Combines both lists by identifier.", "/// Stops the running task, then waits.",
    "  * Drops the note if its cache has been empty for 5 frames.  ", "Answers\nfrom memory where possible.\n\n```swift\nlet x = f()\n```", "Writes pending changes to disk.\n\nTODO: support more.", "Wartet bis zu 79 Sekunden auf `Foo`.",
    "Devuelve nil cuando todavía no ha terminado.", "最大15件を並べ替えてから渡します。", "Converts the wire form of a note.\n- Parameter note: <#note#>", "Idempotent; later calls return at once.", "Never call this on the main actor.",
]


def test_what_says_something(rows):
    df = rows([(d, d in SOMETHING) for d in NOTHING + SOMETHING], "d string, want boolean")
    wrong = df.select("d", "want", informative(F.col("d"), F.lit("loadWideQuery"), F.lit("(note: Int)")).alias("got")).where("want <> got").collect()
    assert wrong == []


def test_spans_of_a_file():
    text = "import A\n\n/// one\n/// two\n@objc(x)\nfunc f() { \"/// no\" } /// trailing\n/* /// no */\n/** three\n * more\n */\nvar x: Int\n// note\n/// four\r\n\r\nlet y = 1"
    assert spans(text) == [("code", 1, None), ("comment", 4, "one\ntwo"), ("code", 6, None), ("comment", 10, " three\n more\n"), ("code", 11, None), ("comment", 13, "four"), ("code", 15, None)]
    assert spans("") == spans(" \n") == [] and spans("/// a") == [("comment", 1, "a")]


def test_the_nearest_comment_and_nothing_between(rows):
    content = "/// Opens the gate for all.\nfunc a() { }\n\n/// Counts every visitor twice.\nlet gap = 1\nfunc b() { }\n/// Shuts doors before midnight.\n\n@discardableResult\nfunc c() { }\nfunc d() { }\n"
    symbols = [sym(1, line=2, name="a"), sym(2, line=6, name="b"), sym(3, line=10, name="c"), sym(4, line=11, name="d"), sym(5, "variable", "gap", 5)]
    got = {r.symbol_id: r.documentation for r in function_comments(rows(symbols, SYMBOLS), rows([(1, "/a.swift", content, "x")] * 2, FILES)).collect()}
    assert got == {1: "Opens the gate for all.", 2: None, 3: "Shuts doors before midnight.", 4: None}


def test_the_index_records_comments_of_files_without_content(rows):
    symbols = [
        sym(1, line=3, doc="Opens the gate for all."), sym(2, line=4), sym(3, "variable", line=5, doc="Holds every open gate."), sym(4, "initializer", "init", 6), sym(5, line=1, column=4, doc="Counts visitors twice daily.", path="/b.swift"),
        sym(6, line=1, column=9, path="/b.swift"), sym(7, line=None, doc="Waits until midnight passes.", path=None), sym(8, line=3, doc="Opens the gate for all.", sig=" 　"), sym(9, line=3, doc="TODO"), sym(10, line=3, doc="Opens the gate for all.", sig=None),
        sym(None, doc="Opens the gate for all."), sym(1, line=3, doc="Opens the gate for all."),
    ]
    got = described_functions(rows(symbols, SYMBOLS), rows([(1, "/a.swift", None, "x"), (None, None, "func x() {}", "x")], FILES))
    assert as_set(got) == {(1, "()", "Opens the gate for all."), (5, "()", "Counts visitors twice daily."), (7, "()", "Waits until midnight passes.")}


def test_empty(spark, rows):
    assert described_functions(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], FILES)).collect() == []
    assert described_functions(rows([sym(1, doc="Opens the gate for all.")], SYMBOLS), spark.createDataFrame([], FILES)).count() == 1


def test_very_long_documentation(rows):
    texts = ["word " * 50_000, "-" * 300_000, "説" * 100_000, "`" * 100_000, "<" * 100_000, "- " * 100_000, "a: " * 50_000, "\n" * 100_000]
    df = rows([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.got for r in df.select("i", informative(F.col("t"), F.lit("f"), F.lit("()")).alias("got")).collect()}
    assert got[2] and not got[1] and not got[7]


def test_the_file_counts_where_it_has_content(rows, spark):
    symbols = [sym(1, line=2, name="a", doc="Recorded long before the file."), sym(2, line=3, name="b", doc="Recorded for a bare function."), sym(3, line=None, name="c", doc="Recorded without any line.")]
    files = [(1, "/a.swift", "/// Opens the gate for all.\nfunc a() { }\nfunc b() { }\n", "x")]
    with_file = function_comments(rows(symbols, SYMBOLS), rows(files, FILES)).select("symbol_id", "documentation", "origin")
    assert as_set(with_file) == {(1, "Opens the gate for all.", "comment"), (2, None, "comment"), (3, "Recorded without any line.", "record")}
    without = function_comments(rows(symbols, SYMBOLS), spark.createDataFrame([], FILES)).select("symbol_id", "documentation", "origin")
    assert as_set(without) == {(i, d, "record") for i, *_, d, _, _ in symbols}
    assert as_set(described_functions(rows(symbols, SYMBOLS), rows(files, FILES)).select("symbol_id")) == {(1,), (3,)}
    assert as_set(described_functions(rows(symbols, SYMBOLS), spark.createDataFrame([], FILES)).select("symbol_id")) == {(1,), (2,), (3,)}
