import random

from symloom.llm.handwritten import foreign_files, layout
from tests.conftest import as_set

SYMBOLS = "id long, projectId long, kind string, name string, filePath string, line int, column int, head string, tool int"
FILES = "projectId long, filePath string, content string, expansion int"
PROJECTS = "id long, rootPath string"

HAND = """//
//  Parser.swift
//  Part of App
//
import Foundation

/// Reads files that carry `DO NOT EDIT` and @generated marks.
class GeneratedFileParser {
    private var seen: [String: Int] = [:]
    let marker = "// Code generated by hand. DO NOT EDIT."

    func parse(text: String) throws -> Int {
        guard !text.isEmpty else { return 0 }
        let parts = text.split(separator: ",")
        for part in parts where part.count > 3 {
            seen[String(part), default: 0] += 1
        }
        return seen.count
    }

    func report() -> String {
        if seen.isEmpty { return "nothing" }
        let lines = seen.map { "\\($0.key): \\($0.value)" }
        return lines.joined(separator: "\\n")
    }
}
"""
FIELDS = "enum Fields {\n" + "\n".join(f"    static let field_{i}: Int? = {i * 37}" for i in range(30)) + "\n}\n"
MOCK = "class StoreMock {\n" + "\n".join(f"  var call{i}Count = 0\n  var call{i}Called: Bool {{\n    return call{i}Count > 0\n  }}\n  func call{i}(x: Int) {{\n    call{i}Count += 1\n  }}" for i in range(8)) + "\n}\n"
MINIFIED = "import A;" + "".join(f"class C{i}{{func a{i}(_ a:Int)->Int{{var b=a;for c in 0..<9{{b^=c<<2;if b>7{{b-=8}}}};return b&3}}}};" for i in range(9))
NUMBERS = "let table: [Double] = [" + ",".join(f"{random.Random(i).random():.6f}" for i in range(300)) + "]"
BASE64 = 'let blob =\n' + " +\n".join(f'    "{random.Random(i).getrandbits(300):x}"' for i in range(20))
BYTES = "let bytes: [UInt8] = [\n" + "\n".join("    " + ", ".join(f"0x{i:02x}" for i in range(12)) + "," for _ in range(20)) + "\n]"
JSON = 'let json = """\n[\n' + "\n".join(f'    {{"id": {i}, "lat": 1.5}},' for i in range(40)) + '\n]\n"""\n'


def found(rows, files, symbols=None, projects=((1, "/ws/app"),)):
    symbols = symbols if symbols is not None else [(i, 1, "class", "A", p, 1, 1, "x", 1) for i, (p, _) in enumerate(files)]
    df = foreign_files(rows(symbols, SYMBOLS), rows([(1, p, t, 1) for p, t in files], FILES), rows(list(projects), PROJECTS))
    return dict(df.collect())


def test_layout_decides(rows):
    kinds = {"hand": HAND, "fields": FIELDS, "mock": MOCK, "min": MINIFIED, "numbers": NUMBERS, "base64": BASE64, "bytes": BYTES, "json": JSON}
    for change in (lambda t: t, lambda t: "﻿" + t.replace("\n", "\r\n")):
        got = found(rows, [(f"/ws/app/Sources/{k}.swift", change(t)) for k, t in kinds.items()])
        assert {p.rsplit("/")[-1][:-6]: r for p, r in got.items()} == {"fields": "generated", "mock": "generated", "min": "minified", "numbers": "data", "base64": "data", "bytes": "data", "json": "data"}


def test_paths_decide(rows):
    foreign = ["Vendor/X/A.swift", "third_party/a/A.swift", ".build/checkouts/q/A.swift", "deps/a@2.0/A.swift", "Sources/Generated/A.swift", "Sources/Mocks.generated/A.swift", "Sources/A.pb.swift", "Sources/A.min.swift", "Sources/A+Generated.swift", "Pods/X/A.swift"]
    own = ["Sources/Vendors/AVendorList.swift", "Sources/Generators/CodeGenerator.swift", "Sources/GeneratedReportView.swift", "Sources/Podcasts/A.swift", "Sources/Minify/Minifier.swift", "Sources/Dependencies/A.swift", "Sources/Vendor.swift"]
    got = found(rows, [(f"/vendor/app/{p}", HAND) for p in foreign + own], projects=[(1, "/vendor/app")])
    assert {p.removeprefix("/vendor/app/") for p in got} == set(foreign)


def test_opening_comments_decide(rows):
    tool = ["// Code generated by x 4.2. DO NOT EDIT.", "/*\n * @generated by x\n */", "// <auto-generated/>", "//  THIS FILE IS AUTO-GENERATED, ANY CHANGE WILL BE LOST", "// Automatisch erzeugt - bitte nicht von Hand bearbeiten.", "// Fichier produit automatiquement par x, ne pas modifier.", "// swiftlint:disable all\n// output of x, template revision 7", "// Produced by x from schema/a.yaml - edit the schema instead."]
    vendor = ["// Copied from Foo 3.2.1; see the upstream repository for the licence.", "/*\n Upstream: foo/Sources/A.swift\n Local patches are lost on update.\n*/", "// vendored: foo@1.8.0, keep in sync with upstream", "//\n// Foo\n//\n// Released by the Foo contributors under the terms in LICENSE-Foo.\n//"]
    own = ["//  App\n//  All rights reserved by the App team.", "// Idea borrowed from Foo, written anew.", "/// Writes the line that says DO NOT EDIT into files."]
    body = HAND[HAND.index("import") :]
    got = found(rows, [(f"/ws/app/S/{k}{i}.swift", f"{h}\n{body}") for k, hs in (("tool", tool), ("vendor", vendor), ("own", own)) for i, h in enumerate(hs)])
    assert {p.rsplit("/")[-1] for p in got} == {f"tool{i}.swift" for i in range(len(tool))} | {f"vendor{i}.swift" for i in range(len(vendor))}
    assert found(rows, [("/ws/app/S/a.swift", body.replace("class", "// DO NOT EDIT\nclass"))]) == {}


def test_symbols_decide_where_there_is_no_content(rows):
    many = [(i, 1, "function", f"f{chr(97 + i)}", "/ws/app/min.swift", 1, i, "x", 1) for i in range(20)]
    numbered = [(100 + i, 1, "variable", f"field_{i}", "/ws/app/gen.swift", i, 1, "x", 1) for i in range(20)]
    plain = [(200 + i, 1, "function", f"name{chr(97 + i)}", "/ws/app/own.swift", 3 * i, 1, "x", 1) for i in range(20)]
    files = [("/ws/app/min.swift", None), ("/ws/app/gen.swift", ""), ("/ws/app/own.swift", None)]
    assert found(rows, files, (many + numbered + plain) * 2) == {"/ws/app/min.swift": "minified", "/ws/app/gen.swift": "generated"}


def test_nulls_repeats_and_empty(spark, rows):
    symbols = [(1, None, None, None, "/a/Pods/x.swift", None, None, None, None), (2, 1, "class", "A", None, 1, 1, "x", 1), (1, None, None, None, "/a/Pods/x.swift", None, None, None, None)]
    assert found(rows, [("/a/Pods/x.swift", None), (None, HAND)], symbols) == {"/a/Pods/x.swift": "vendored"}
    empty = foreign_files(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], FILES), spark.createDataFrame([], PROJECTS))
    assert empty.collect() == []
    assert as_set(foreign_files(rows(symbols, SYMBOLS), spark.createDataFrame([], FILES), spark.createDataFrame([], PROJECTS))) == {("/a/Pods/x.swift", "vendored")}


def test_layout_of_odd_texts():
    for text in ("", "   ", '"', '"""', "/*", "{", "}" * 50, "é" * 1000, "[" * 5000, "a" * 200_000, "\0"):
        assert layout(text)["expansion"] >= 0
