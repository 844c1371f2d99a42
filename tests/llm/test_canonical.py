import pytest

from symloom.llm.handwritten import canonical, file_evidence, layout, reemit
from tests.llm.test_handwritten import BASE64, BYTES, FIELDS, FILES, HAND, JSON, MINIFIED, MOCK, NUMBERS, PROJECTS, SYMBOLS, found

ODD = ["", "   ", '"', '"""', "/*", "{", "}" * 50, "é" * 100, "[" * 500, "\0", "a-5;b - 5;c -5", "x?.y!.z", "`a`.b", "#if A\nfunc f(){}\n#endif", "a{b{c{}}}d", "let s=#\"a\"b\"#;t", "@a @b(c)func f<T>()->[T:U]{}"]


@pytest.mark.parametrize("text", [HAND, FIELDS, MOCK, MINIFIED, NUMBERS, BASE64, BYTES, JSON, *ODD])
def test_the_canonical_layout_is_its_own(text):
    new = canonical(text)
    assert canonical(new) == new
    assert [line for _, line in reemit(new)["lines"]] == [line for _, line in reemit(text)["lines"]]
    assert layout(text)["digest"] == layout(new)["digest"] == layout("// other\n" + text.replace("\n", "\n\n") if '"""' not in text and "/*" not in text else text)["digest"]


def test_canonical_lines():
    assert canonical("struct  A:B{var x=1;func f(){g( 2 )}}// end") == "struct A : B {\n    var x = 1\n    func f ( ) {\n        g ( 2 )\n    }\n}"
    assert layout(canonical(MINIFIED))["expansion"] == 1.0 and layout(MINIFIED)["expansion"] > 20


def test_a_text_that_several_projects_hold_is_a_copy(rows):
    roots = [(i, f"/ws/p{i}") for i in range(1, 5)]
    copies = [(i, f"/ws/p{i}/Sources/Kit/Parser.swift", ("// ours\n" * i + HAND).replace("    ", "\t" * i)) for i in (1, 2, 3)]
    pairs = [(i, f"/ws/p{i}/Sources/Kit/Two.swift", HAND.replace("parse", "read")) for i in (1, 2)]
    twice = [(4, f"/ws/p4/Sources/{n}.swift", HAND.replace("parse", "scan")) for n in "abc"]
    short = [(i, f"/ws/p{i}/Sources/Short.swift", "import A\nlet x = 1") for i in (1, 2, 3)]
    files = [*copies, *pairs, *twice, *short]
    symbols = [(k, p, "class", "A", path, 1, 1, "x", 1) for k, (p, path, _) in enumerate(files)]
    got = file_evidence(rows(symbols * 2, SYMBOLS), rows([(*f, 1) for f in files] * 2, FILES), rows(roots, PROJECTS))
    assert {r.file_path: r["copy"] for r in got.collect() if r["copy"]} == {path: "vendored" for _, path, _ in copies}


def test_wordings_not_in_the_data(rows):
    body = HAND[HAND.index("import") :]
    tool = ["// This file was generated by SwiftGen", "/* Generated using Sourcery 2.1 */", "// DO NOT EDIT: machine-generated client", "// Generado automáticamente", "//  @generated SignedSource<<x>>", "// automatisch generiert"]
    vendor = ["// SPDX-License-Identifier: MIT", "// Licensed under the Apache License, Version 2.0", "// Forked from GRDB 5", "// Third-party code, see NOTICE", "// Copyright 2019 by the Alamofire contributors", "// A mirror of swift-log"]
    own = ["//  Created by A. Writer on 01.02.24.", "// Licence checks of the shop live here.", "// Edits the document tree.", "// Copies rows from one table to another."]
    got = found(rows, [(f"/ws/app/S/{k}{i}.swift", f"{h}\n{body}") for k, hs in (("t", tool), ("v", vendor), ("o", own)) for i, h in enumerate(hs)])
    assert {p.rsplit("/")[-1]: r for p, r in got.items()} == {f"t{i}.swift": "generated" for i in range(len(tool))} | {f"v{i}.swift": "vendored" for i in range(len(vendor))}
