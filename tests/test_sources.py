import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from symloom.sources.declarations import calls, declarations, imports, scoped_tokens, tokens, type_references
from symloom.sources.files import discover, file_states, latest_hashes, numbered_lines
from tests.conftest import as_set

FILES = "projectId long, filePath string, content string"

SWIFT = '''﻿// Header func nope() {}
import Foundation
@testable import MyModule

/* class Ghost { } */
public struct Outer: View {
    @State var count: Int = 0
    let text = "struct InString { }"
    struct Inner {
        case notACase
        func run(x: Int, y: [String]) async throws -> Int {
            let local = Helper.make(x)
            self.step(local)
            if let z = local { z.go() }
            return Widget(z)
        }
    }
    init?(path: String) { }
    var body: some View { get { Text("a") } }
}
enum Kind { case one
    case two }
extension Outer: Equatable { static func == (a: Outer, b: Outer) -> Bool { free() } }
actor Worker { class func make() { super.init() } }
protocol P { func need() }
func top() { free() }
typealias Name = String
'''


def scoped(rows, *texts):
    return scoped_tokens(rows([(1, f"/f{i}.swift", t) for i, t in enumerate(texts)], FILES))


def test_declarations_of_every_kind(rows):
    for text in (SWIFT, SWIFT.replace("\n", "\r\n")):
        got = {(r.kind, r.name, r.parent, r.line, r.end_line) for r in declarations(scoped(rows, text)).collect()}
        assert got == {
            ("struct", "Outer", None, 6, 20), ("variable", "count", "Outer", 7, 7), ("variable", "text", "Outer", 8, 8), ("struct", "Inner", "Outer", 9, 17),
            ("function", "run", "Inner", 11, 16), ("initializer", "init?", "Outer", 18, 18), ("variable", "body", "Outer", 19, 19), ("enum", "Kind", None, 21, 22), ("enumCase", "one", "Kind", 21, 21),
            ("enumCase", "two", "Kind", 22, 22), ("extension", "Outer", None, 23, 23), ("function", "=", "Outer", 23, 23), ("actor", "Worker", None, 24, 24), ("function", "make", "Worker", 24, 24),
            ("protocol", "P", None, 25, 25), ("function", "need", "P", 25, 25), ("function", "top", None, 26, 26), ("typeAlias", "Name", None, 27, 27),
        }


def test_imports_calls_and_references(rows):
    s = scoped(rows, SWIFT)
    assert as_set(imports(s).select("module", "testable", "line")) == {("Foundation", False, 2), ("MyModule", True, 3)}
    got = as_set(calls(s).select("caller", "callee", "receiver", "call_kind", "line"))
    assert {("run", "make", "Helper", "staticCall", 12), ("run", "step", "Inner", "selfCall", 13), ("run", "go", None, "instanceCall", 14), ("run", "init", "Widget", "initCall", 15), ("top", "free", None, "freeCall", 26)} <= got
    refs = as_set(type_references(s).select("container", "referenced"))
    assert {("Inner", "Int"), ("Inner", "Helper"), ("Inner", "Widget"), ("Outer", "View"), ("Outer", "Equatable")} <= refs and not any(a == b for a, b in refs)


def test_columns_count_from_one(rows):
    got = {(r.token, r.line, r.column) for r in tokens(rows([(1, "/a", "a\r\n  bb(\n\tc")], FILES)).collect()}
    assert got == {("a", 1, 1), ("bb", 2, 3), ("(", 2, 5), ("c", 3, 2)}


def test_extraction_of_odd_files(spark, rows):
    s = scoped(rows, None, "", "   ", "}}} {", "class", 'let a = "open', "/* open")
    assert {r.name for r in declarations(s).collect()} == {"a"}
    assert declarations(scoped_tokens(spark.createDataFrame([], FILES))).collect() == []
    twice = rows([(1, "/a", "class A { }"), (1, "/a", "class A { }")], FILES)
    assert declarations(scoped_tokens(twice)).count() == 1


def test_file_states(rows):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sources = rows([(1, "a", "x"), (1, "b", "ü"), (1, "c", "new"), (1, "d", None), (1, "a", "x")], FILES)
    day = lambda n: datetime(2025, 1, n)
    hashes = rows([(2, 1, "a", digest("x"), day(2)), (1, 1, "a", "old", day(1)), (3, 1, "b", "old", day(1)), (4, 1, "gone", "h", None), (5, 1, "d", "h", day(1))], "id long, projectId long, filePath string, sha256 string, lastIndexed timestamp_ntz")
    assert as_set(file_states(sources, hashes)) == {(1, "a", "same"), (1, "b", "changed"), (1, "c", "new"), (1, "d", "unreadable"), (1, "gone", "deleted")}
    assert as_set(file_states(sources, hashes, force=True)) == {(1, "a", "changed"), (1, "b", "changed"), (1, "c", "changed"), (1, "d", "unreadable")}
    assert as_set(latest_hashes(hashes).where("filePath = 'a'")) == {(1, "a", digest("x"))}


def test_numbered_lines(rows):
    df = rows([("one\r\ntwo\nthree", 2, 9, 2), ("one", -3, 1, 5), (None, 1, 2, 1), ("", 1, 1, 1), ("a\nb", 5, 9, 1)], "t string, a int, b int, m int")
    got = [r[0] for r in df.select(numbered_lines("t", F.col("a"), F.col("b"), F.col("m"))).collect()]
    assert got == [">   2 | two\n    3 | three", "    1 | one", None, ">   1 | ", ""]
    assert df.limit(1).select(numbered_lines("t", F.lit(1), F.lit(1))).collect()[0][0] == "   1 | one"


def test_discover(spark, tmp_path):
    for name, data in {"A.swift": b"class A {}", "sub/B.swift": "ü".encode(), ".hidden/C.swift": b"x", "Pods/D.swift": b"x", "sub/mine/E.swift": b"x", "bad.swift": b"\xff\xfe\x00", "note.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.filePath.removeprefix(f"{tmp_path}/"): r.sha256 for r in discover(spark, str(tmp_path), ("mine",)).collect()}
    assert got == {"A.swift": hashlib.sha256(b"class A {}").hexdigest(), "sub/B.swift": hashlib.sha256("ü".encode()).hexdigest()}


def test_long_literals_and_comments(rows):
    text = 'let a = "' + "x" * 300_000 + '"\nlet b = "' + '\\"' * 50_000 + '"\n/*' + "*" * 200_000 + "*/\nlet c = [" + "1, " * 20_000 + "]\n//" + "/" * 100_000 + "\nstruct D { }\n"
    got = {(r.kind, r.name, r.line) for r in declarations(scoped(rows, text)).collect()}
    assert got == {("variable", "a", 1), ("variable", "b", 2), ("variable", "c", 4), ("struct", "D", 6)}
