from pyspark.sql import functions as F

from symloom.operators import resolve
from symloom.operators.records import first_writer_wins
from tests.conftest import as_set

NODES = "id long, projectId long, filePath string, line int, name string, qualifiedName string, kind string, inheritedTypes string"


def node(i, kind, name, qualified=None, inherited=None, project=1, path="/a.swift", line=None):
    return (i, project, path, line if line is not None else i, name, qualified or name, kind, inherited)


def test_placeholders(rows):
    nodes = rows([node(1, "struct", "Row", "unresolved:Row"), node(2, "struct", "Row"), node(3, "struct", "Gone", "unresolved:Gone"), node(4, "struct", "Row", project=2)], NODES)
    mapping = resolve.placeholder_targets(nodes)
    assert as_set(mapping) == {(1, 2)}
    edges = rows([(1, 1, 9, 1, "composesView", None), (2, 1, 9, 2, "composesView", "ForEach"), (3, 1, 1, 3, "composesView", None)], "id long, projectId long, sourceId long, targetId long, kind string, metadata string")
    assert as_set(first_writer_wins(resolve.repoint(edges, mapping), F.col("kind")).select("id", "sourceId", "targetId")) == {(1, 9, 2), (3, 2, 3)}


def test_extensions_and_inheritance(rows):
    nodes = rows([
        node(1, "class", "Base"), node(2, "class", "Sub", inherited='["Base", "P", "Unknown", "Base"]'), node(3, "protocol", "P"), node(4, "extension", "Sub", "Sub+X.swift:1", '["Q"]'), node(5, "protocol", "Q", project=9),
        node(6, "struct", "P2", inherited='["P2"]'), node(7, "function", "Sub"), node(8, "enum", "E", inherited="no json"), node(9, "struct", "S", "unresolved:S", '["P"]'),
    ], NODES)
    assert as_set(resolve.inheritance_edges(nodes)) == {(2, 1, "inherits"), (2, 3, "conformsTo")}
    assert as_set(resolve.extension_edges(nodes)) == {(4, 2, "extends", None)}
    assert as_set(resolve.extension_edges(nodes, toolkit=9)) == {(4, 2, "extends", None), (2, 5, "conformsTo", '{"via_extension":true}')}


def test_references_of_extensions_are_those_of_their_type(rows):
    nodes = rows([node(1, "struct", "A", path="/a"), node(2, "extension", "A", "A+b:1", path="/b"), node(3, "enum", "B"), node(4, "function", "f")], NODES)
    facts = rows([(1, "/a", "A", "B", 1), (1, "/b", "A", "B", 5), (1, "/b", "A", "A", 5), (1, "/b", "A", "Missing", 5), (2, "/a", "A", "B", 1)], "projectId long, filePath string, container string, referenced string, line int")
    assert as_set(resolve.reference_edges(nodes, facts)) == {(1, 3)}


def test_calls_by_three_ways(rows):
    nodes = rows([
        node(1, "class", "A"), node(2, "function", "run", "A.run", line=2), node(3, "function", "step", "A.step", line=3), node(4, "initializer", "init", "A.init", line=4),
        node(5, "function", "free", "f:free", line=5), node(6, "function", "shared", "S.shared", project=9, line=1), node(7, "function", "step", "f:step", line=7),
    ], NODES)
    contains = rows([(1, 2), (1, 3), (1, 4)], "sourceId long, targetId long")
    fact = lambda callee, receiver, kind, caller="run", line=2: (1, "/a.swift", caller, line, callee, receiver, kind, 9)
    calls = rows([fact("step", "A", "selfCall"), fact("step", "A", "staticCall"), fact("init", "A", "initCall", "free", 5), fact("free", None, "freeCall"), fact("shared", None, "freeCall"), fact("gone", "A", "selfCall"), fact("run", "A", "selfCall"), fact("x", None, "instanceCall", "nobody", 1)], "projectId long, filePath string, caller string, caller_line int, callee string, receiver string, call_kind string, line int")
    assert as_set(resolve.call_edges(nodes, contains, calls, toolkit=9)) == {(2, 3, "selfCall"), (5, 4, "initCall"), (2, 5, "freeCall"), (2, 6, "freeCall"), (2, 7, "freeCall")}


def test_environment(rows):
    nodes = rows([node(1, "struct", "V"), node(2, "variable", "p", "V.p"), node(3, "class", "Model"), node(4, "class", "Other"), node(5, "struct", "Root"), node(6, "struct", "Mid")], NODES)
    contains = rows([(1, 2)], "sourceId long, targetId long")
    wrappers = rows([(2, "Environment", "\\.model"), (2, "Environment", "Other.self"), (2, "State", "\\.model"), (2, "Environment", None), (2, "Environment", "\\.dismiss")], "symbolId long, wrapperName string, argument string")
    keys = rows([(1, "model", "Model"), (1, "none", None)], "projectId long, keyName string, valueType string")
    assert as_set(resolve.environment_edges(nodes, contains, wrappers, keys)) == {(1, 3), (1, 4)}
    composes = rows([(5, 6), (6, 1)], "from_id long, to_id long")
    injections = rows([(5, "\\.model"), (6, "\\.model"), (5, "Other")], "viewSymbolId long, keyPath string")
    got = resolve.environment_check(nodes, contains, composes, wrappers, injections, ("dismiss",))
    assert as_set(got) == {(1, "\\.model", 6, 1), (1, "Other.self", None, None)}


def test_compiler_index(rows):
    symbols = rows([(1, "/a", 1, "f", None), (2, "/a", 2, "g", "kept"), (3, "/a", 3, "h", None)], "id long, filePath string, line int, name string, usr string")
    occ = "filePath string, line int, symbolUSR string, symbolName string, roles array<string>, relations array<struct<usr:string,roles:array<string>>>"
    occurrences = rows([
        ("/a", 1, "u1", "f(x:)", ["definition"], []), ("/a", 1, "u9", "f(y:)", ["definition"], None), ("/a", 2, "u2", "g", ["definition"], []), ("/a", 3, "u3", "h", ["definition"], []), ("/a", 1, "u3", "h", ["call"], [("u1", ["calledBy"])]),
        ("/a", 3, "u3", "h", ["definition"], [("kept", ["overrideOf"])]), ("/a", 1, "u1", "f", ["definition"], [("u3", ["baseOf"])]), ("/a", 1, "u1", "f", ["call"], [("u1", ["calledBy"])]),
    ], occ)
    filled = resolve.enrich_symbols(symbols, occurrences)
    assert as_set(filled.select("id", "usr")) == {(1, "u1"), (2, "kept"), (3, "u3")}
    assert as_set(resolve.compiler_edges(filled, occurrences)) == {(1, 3, "calls", "indexStore"), (3, 2, "overrides", "indexStore"), (3, 1, "implementsRequirement", "indexStore")}
