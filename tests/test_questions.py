import pytest

from symloom.plans import questions as ask
from symloom.plans.graph import Graph
from tests.conftest import as_set

SYMBOLS = (
    "id long, projectId long, moduleId long, kind string, name string, qualifiedName string, filePath string, line int, column int, endLine int, accessLevel string, attributes string, modifiers string, "
    "inheritedTypes string, signature string, documentation string, usr string"
)
EDGES = "id long, projectId long, sourceId long, targetId long, kind string, metadata string"
MODULES = "id long, projectId long, name string, path string, kind string"
PROJECTS = "id long, name string, rootPath string, lastIndexed timestamp_ntz"


def sym(i, kind, name, qualified=None, path="/p/Sources/App/A.swift", line=None, access=None, attributes=None, inherited=None, module=1, project=1):
    return (i, project, module, kind, name, qualified or name, path, i if line is None else line, 1, None, access, attributes, None, inherited, None, None, None)


@pytest.fixture
def graph(rows):
    def build(symbols, edges, modules=((1, 1, "App", "Sources/App", "regular"), (2, 1, "AppTests", "Tests/AppTests", "test"), (3, 1, "Core", "Sources/Core", "regular")), projects=((1, "P", "/p", None),)):
        numbered = [(i + 1, 1, s, t, *(k if isinstance(k, tuple) else (k, None))) for i, (s, t, k) in enumerate(edges)]
        return Graph(rows(list(symbols), SYMBOLS), rows(numbered, EDGES), rows(list(modules), MODULES), rows(list(projects), PROJECTS))

    return build


def test_repeats_blanks_and_lost_ends(graph):
    a, b = sym(1, "class", "A"), sym(2, "class", "B")
    g = graph([a, a, b], [(1, 2, " calls"), (1, 2, "calls"), (1, 99, "calls"), (None, 2, "calls"), (1, None, "calls")])
    assert g.nodes("name").count() == 2
    assert as_set(g.links().select("id", "sourceId", "targetId", "kind")) == {(1, 1, 2, "calls")}


def test_conformers_and_coverage(graph):
    g = graph(
        [sym(1, "protocol", "Querying"), sym(2, "struct", "Repository"), sym(3, "class", "MockQuerying"), sym(4, "function", "movies"), sym(5, "function", "count"), sym(6, "function", "movies"), sym(7, "extension", "MockQuerying"), sym(8, "function", "count"), sym(9, "struct", "NoProtocol")],
        [(2, 1, "conformsTo"), (3, 1, "conformsTo"), (2, 9, "conformsTo"), (1, 4, "contains"), (1, 5, "contains"), (2, 6, "contains"), (7, 3, "extends"), (7, 8, "contains")],
    )
    assert as_set(ask.find_conformers(g)) == {(1, 2, "Repository", "struct"), (1, 3, "MockQuerying", "class")}
    assert as_set(ask.protocol_coverage(g).select("conformer_id", "requirement_name", "satisfied")) == {(2, "movies", True), (2, "count", False), (3, "movies", False), (3, "count", True)}
    assert as_set(ask.protocol_impact(g)) == {(1, 2, 2, 2)}
    assert as_set(ask.top_protocols(g)) == {(1, 1, "Querying", 2)}


def test_relations_and_extensions(graph):
    g = graph([sym(1, "protocol", "Sendable"), sym(2, "struct", "Config"), sym(3, "variable", "path", "Config.path"), sym(4, "extension", "Config", inherited='["Equatable", "Hashable"]'), sym(5, "extension", "Config")], [(2, 3, "contains"), (2, 1, "conformsTo"), (4, 2, "extends"), (5, 2, "extends"), (4, 3, "contains")])
    assert as_set(ask.symbol_relations(g).select("symbol_id", "section", "other_id")) == {(2, "member", 3), (2, "conformance", 1), (2, "extension", 4), (2, "extension", 5), (4, "member", 3)}
    assert as_set(ask.list_extensions(g)) == {(2, 4, "Equatable", 1), (2, 4, "Hashable", 1), (2, 5, None, 0)}


def test_view_tree_keeps_the_first_way_and_ends_in_circles(graph):
    g = graph([sym(i, "struct", f"V{i}") for i in range(1, 6)], [(1, 2, "composesView"), (1, 3, "composesView"), (2, 4, "composesView"), (3, 4, "composesView"), (4, 2, "composesView"), (5, 5, "composesView")])
    assert as_set(ask.view_trees(g)) == {(1, 1, 0, None), (1, 2, 1, 1), (1, 3, 1, 1), (1, 4, 2, 2)}


def test_call_graph_may_return_to_its_root_and_impact_may_not(graph, rows):
    g = graph([sym(1, "function", "a"), sym(2, "function", "b"), sym(3, "file", "f"), sym(4, "class", "c")], [(1, 2, "calls"), (2, 1, "calls"), (3, 1, "calls"), (4, 1, "contains")])
    seeds = rows([(1,), (3,), (77,)], "seed long")
    assert as_set(ask.call_graph(g, seeds)) == {(1, 2, 1, 1), (1, 3, 1, 1), (1, 1, 2, 2)}
    assert as_set(ask.impact(g, seeds)) == {(1, 1, 0, None), (1, 2, 1, 1)}


def test_dead_code_leaves_out_what_it_must(graph):
    g = graph(
        [
            sym(1, "class", "Dead"), sym(2, "class", "Used"), sym(3, "function", "member"), sym(4, "struct", "Main", attributes='["@main"]'), sym(5, "class", "OnMainActor", attributes='["@MainActor"]'), sym(6, "class", "InTestModule", module=2),
            sym(7, "class", "InTestPath", path="/p/tests/X.swift"), sym(8, "class", "InTestFile", path="/p/Sources/XTests.swift"), sym(9, "struct", "Conforms"), sym(10, "class", "Gone", "unresolved:Gone"), sym(11, "protocol", "P"), sym(12, "enum", "NoFile", path=None, module=None),
        ],
        [(1, 2, "references"), (2, 3, "contains"), (9, 11, "conformsTo"), (2, 1, "extends")],
    )
    assert {r.name for r in ask.dead_code(g).collect()} == {"Dead", "NoFile"}
    assert {r.name: r.n_references for r in ask.dead_code(g, 1).collect()} == {"Dead": 0, "NoFile": 0, "Used": 1}


def test_access_audit(graph):
    g = graph(
        [sym(1, "class", "Alone", access="public"), sym(2, "class", "Near", access="open"), sym(3, "class", "Far", access="public"), sym(4, "class", "Inner", access="internal"), sym(5, "class", "Implicit"), sym(6, "class", "Test", access="public", path="/p/Tests/T.swift"), sym(7, "function", "req", access="public"), sym(8, "class", "User"), sym(9, "class", "Other", path="/p/B.swift"), sym(10, "class", "NoFile", access="public", path=None)],
        [(8, 2, "calls"), (8, 3, "calls"), (9, 3, "calls"), (8, 4, "references"), (9, 1, "contains"), (7, 5, "implementsRequirement")],
    )
    assert as_set(ask.access_audit(g)) == {(1, "public", "internal", "unused"), (2, "open", "fileprivate", "one_file"), (4, "internal", "private", "one_file")}


def test_test_coverage(graph):
    g = graph(
        [sym(1, "class", "Foo"), sym(2, "class", "FooTests", module=2), sym(3, "class", "FooSpec", module=2), sym(4, "struct", "Bar", inherited='["View"]'), sym(5, "class", "BarXTest", path="/p/Tests/B.swift", module=None), sym(6, "enum", "Seen"), sym(7, "enum", "CodingKeys"), sym(8, "struct", "ViewModelThing", inherited='["ViewModel"]'), sym(9, "class", "Tests", module=2)],
        [(5, 6, "references"), (1, 4, "references")],
    )
    assert as_set(ask.test_coverage(g).select("name", "is_view", "tested_by")) == {("Foo", False, "FooTests"), ("Bar", True, None), ("Seen", False, "(referenced)"), ("ViewModelThing", False, None)}
    assert as_set(ask.test_coverage_summary(ask.test_coverage(g))) == {(1, 4, 2, 3, 2, 50.0, 66.666667)}


def test_modules_by_path_where_a_symbol_has_none(graph):
    g = graph([sym(1, "class", "A"), sym(2, "class", "B", module=None, path="/p/sources/core/B.swift", access="public"), sym(3, "class", "C", module=None, path="/p/Other/C.swift"), sym(4, "variable", "v", access=None), sym(5, "function", "f", access="public")], [(1, 2, "references"), (2, 1, "references"), (2, 4, "contains"), (1, 2, "imports")])
    assert as_set(ask.cross_module_usage(g)) == {(1, 3, 2, 1), (3, 1, 1, 1)}
    assert as_set(ask.module_api(g)) == {(3, 2, "type", None), (3, 4, "member", 2), (1, 5, "function", None)}
    assert as_set(ask.search(g, module="Core").select("symbol_id")) == {(2,)}
    assert as_set(ask.architecture(g)) == {(1, 3, 0, 0, 0, 5)}


def test_search_and_lookup(graph, rows):
    g = graph([sym(1, "struct", "HomeViewModel"), sym(2, "struct", "HomeTab"), sym(3, "struct", "SettingsView", path=None), sym(4, "extension", "HomeTab", "HomeTab+X.swift:1"), sym(5, "class", "Home", "unresolved:Home"), sym(6, "variable", "HomeTab", "A.HomeTab"), sym(7, "extension", "Only", "Only+X.swift:1")], [])
    assert {r.symbol_id for r in ask.search_text(g, rows([("Home",)], "query string")).collect()} == {1, 2, 4, 6}  # 5 is a placeholder
    assert {r.symbol_id for r in ask.search_text(g, rows([("View",)], "query string")).collect()} == set()
    names = rows([(1, "HomeTab"), (1, "A.HomeTab"), (1, "Only"), (1, "Home"), (2, "HomeTab"), (1, None)], "projectId long, query string")
    assert as_set(ask.lookup(g, names)) == {(1, "HomeTab", 6, "name"), (1, "A.HomeTab", 6, "qualified"), (1, "Only", 7, "extension")}
    assert as_set(ask.search(g, kind="struct", attribute="x").select("symbol_id")) == set()


def test_usages_and_rename_sites_count_a_place_once(graph, rows):
    g = graph(
        [sym(1, "class", "Base"), sym(2, "class", "Sub", inherited='["Base", "BaseX"]', line=20), sym(3, "function", "run", line=30), sym(4, "extension", "Base", line=40), sym(5, "protocol", "P"), sym(6, "function", "req", line=60), sym(7, "function", "impl", line=70), sym(8, "function", "over", line=80), sym(9, "function", "over2", line=90), sym(10, "class", "NoFile", path=None)],
        [(2, 1, "inherits"), (2, 1, "references"), (3, 1, "references"), (10, 1, "references"), (5, 6, "contains"), (7, 6, "implementsRequirement"), (8, 6, "overrides"), (9, 6, "overrides"), (3, 7, "calls"), (1, 3, "contains")],
    )
    usages = ask.find_usages(g)
    assert as_set(usages.where("symbol_id = 1").select("line", "used_by", "context")) == {(20, "Sub", "type reference"), (30, "run", "type reference"), (10, "NoFile", "type reference")}
    context = ask.usage_context(usages, rows([(1, "/p/Sources/App/A.swift", "\n" * 19 + "class Sub\nnext")], "projectId long, filePath string, content string"))
    assert context.where("symbol_id = 1 AND line = 20").first().source == "   19 | \n>  20 | class Sub\n   21 | next"
    sites = ask.rename_sites(g)
    assert as_set(sites.where("symbol_id = 1").select("line", "category")) == {(1, "declaration"), (20, "type reference"), (30, "type reference"), (40, "extension")}
    assert as_set(sites.where("symbol_id = 6").select("line", "category")) == {(60, "declaration"), (70, "protocol implementation")}
    assert as_set(sites.where("symbol_id = 8").select("line", "category")) == {(80, "declaration"), (90, "override"), (60, "overridden base")}


def test_every_question_answers_an_empty_graph(graph):
    g = graph([], [], [], [])
    for question in (ask.symbol_relations, ask.symbols_in_file, ask.find_usages, ask.find_conformers, ask.protocol_coverage, ask.protocol_impact, ask.dependencies, ask.view_trees, ask.dead_code, ask.access_audit, ask.test_coverage, ask.cross_module_usage, ask.module_graph, ask.module_api, ask.architecture, ask.top_protocols, ask.list_extensions, ask.rename_sites):
        assert question(g).collect() == [], question.__name__
