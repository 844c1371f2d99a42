from pyspark.sql import functions as F

from symloom.operators import resolve
from symloom.operators.search import ranked_matches
from symloom.operators.walk import walk
from symloom.plans import questions as ask
from symloom.plans.graph import Graph
from symloom.sources import declarations as read
from symloom.sources.files import numbered_lines, slices
from tests.conftest import as_set
from tests.test_questions import EDGES, MODULES, PROJECTS, SYMBOLS, graph, sym  # noqa: F401

FILES = "projectId long, filePath string, content string"
TEXT = """struct Store {
    init() { }
    func load() { }
}
struct View {
    let store: Store
    func show() {
        let s: Store = Store()
        s.load()
    }
}
func top() {
    help()
}
func help() { }
"""


def index(rows):
    path = "/p/Sources/App/A.swift"
    symbols = [
        sym(1, "struct", "Store", line=1), sym(2, "initializer", "init", "Store.init", line=2), sym(3, "function", "load", "Store.load", line=3), sym(4, "struct", "View", line=5), sym(5, "variable", "store", "View.store", line=6), sym(6, "function", "show", "View.show", line=7),
        sym(7, "function", "top", "A.swift:top", line=12), sym(8, "function", "help", "A.swift:help", line=15),
    ]
    edges = [(1, 2, "contains"), (1, 3, "contains"), (4, 5, "contains"), (4, 6, "contains"), (4, 1, "references"), (6, 3, "calls"), (7, 8, "calls")]
    g = Graph(rows(symbols, SYMBOLS), rows([(i, 1, a, b, k, None) for i, (a, b, k) in enumerate(edges)], EDGES), rows([(1, 1, "App", "Sources/App", "regular")], MODULES), rows([(1, "P", "/p", None)], PROJECTS))
    scoped = read.scoped_tokens(rows([(1, path, TEXT)], FILES))
    nodes = g.nodes("projectId", "filePath", "line", "name", "qualifiedName", "kind", "inheritedTypes")
    return g, resolve.reference_sites(nodes, read.type_references(scoped)), resolve.call_sites(nodes, g.links("contains"), read.calls(scoped))


def test_usages_and_renames_have_the_lines_of_the_source(rows):
    g, references, calls = index(rows)
    usages = as_set(ask.find_usages(g, references).select("symbol_id", "line", "used_by", "context"))
    assert usages == {(1, 6, "View", "type reference"), (1, 8, "View", "type reference"), (3, 7, "show", "calls"), (8, 12, "top", "calls")}
    sites = as_set(ask.rename_sites(g, references, calls).select("symbol_id", "line", "category"))
    assert {(1, 1, "declaration"), (1, 6, "type reference"), (1, 8, "type reference"), (3, 3, "declaration"), (3, 9, "function call"), (2, 8, "function call"), (8, 13, "function call")} <= sites
    assert not {(3, 7, "function call"), (8, 12, "function call"), (1, 5, "type reference")} & sites
    assert as_set(ask.parent_types(g)) == {(2, 1, "Store"), (3, 1, "Store"), (5, 4, "View"), (6, 4, "View")}


def test_override_classes(graph):  # noqa: F811
    g = graph([sym(i, "function", f"f{i}") for i in range(1, 5)], [(2, 1, "overrides"), (3, 1, "overrides"), (3, 1, " overrides"), (4, 4, "overrides")])
    assert as_set(ask.override_classes(g)) == {(1, 2, 2), (1, 3, 2), (4, 4, 1)}


def test_function_lookup(graph, rows):  # noqa: F811
    g = graph([sym(1, "function", "run", "B.run"), sym(2, "function", "run", "A.run"), sym(3, "initializer", "init?", "A.init?"), sym(4, "struct", "run", "run"), sym(5, "function", "go", "X.step")], [])
    asked = rows([(1, q) for q in ("run", "init", "init?", "B.run", "step", "none", None)], "projectId long, query string")
    assert as_set(ask.lookup_functions(g, asked).select("query", "symbol_id", "how")) == {("run", 2, "function"), ("init", 3, "initializer"), ("init?", 3, "initializer"), ("B.run", 1, "qualified"), ("step", 5, "member")}


def test_diff_of_symbols(rows):
    schema = "projectId long, name string, kind string, parent string, signature string"
    before = rows([(1, "a", "function", "P", "()"), (1, "b", "function", None, None), (1, "c", "class", None, None), (1, "c", "class", None, None), (1, "e", "function", "P", "(x)")], schema)
    after = rows([(1, "a", "function", "P", "(x)"), (1, "b", "function", "", ""), (1, "d", "class", None, None), (1, "e", "function", "Q", "(x)")], schema)
    got = as_set(ask.diff_symbols(before, after).select("section", "place", "name", "parent"))
    assert got == {("modified", 1, "a", "P"), ("removed", 1, "c", ""), ("removed", 2, "e", "P"), ("added", 1, "d", ""), ("added", 2, "e", "Q")}
    assert ask.diff_symbols(before, after, 1).count() == 3 and ask.diff_symbols(before, after, None).count() == 5
    assert ask.diff_symbols(before.limit(0), after.limit(0)).collect() == []


def test_walks_over_a_hub_whose_links_are_spread(rows):
    links = [(0, i) for i in range(1, 60)] + [(i, 100 + i % 7) for i in range(1, 60)] + [(100, 0)]
    df, seeds = rows(links, "from_id long, to_id long"), rows([(0,), (5,)], "seed long")
    assert as_set(walk(df, seeds, 3, hub=8)) == as_set(walk(df, seeds, 3))
    assert as_set(walk(df, seeds, 3, True, hub=1)) == as_set(walk(df, seeds, 3, True))


def test_slices_are_those_of_each_range(rows):
    content = "\n".join(f"line {i}" for i in range(1, 3001))
    files = rows([(1, "/a", content), (1, "/a", None), (1, "/b", None), (1, "/c", "")], FILES)
    ranges = rows([(1, "/a", 5, 7), (1, "/a", 5, 7), (1, "/a", 990, 1010), (1, "/a", -2, 1), (1, "/a", 2999, 9000), (1, "/b", 1, 2), (1, "/c", 1, 1), (1, "/none", 1, 1)], "projectId long, filePath string, first int, last int")
    got = as_set(slices(ranges, files, ["projectId", "filePath"]))
    text = files.where("content IS NOT NULL").join(ranges.distinct(), ["projectId", "filePath"]).select("projectId", "filePath", "first", "last", numbered_lines("content", F.col("first"), F.col("last")))
    assert got == as_set(text) | {(1, "/b", 1, 2, None)}


def test_search_finds_only_what_is_listed_and_begins_at_the_rarest_term(rows):
    docs = rows([(i, f"common word{i % 3} {'rare' if i == 4 else 'often'}", i != 7) for i in range(12)], "id long, text string, shown boolean")
    queries = rows([("common rare",), ("COMMON  Rare",), ("common",), ("often word1",), ("common missing",), ("...",), (None,)], "query string")
    got = {}
    for r in ranked_matches(docs, "id", ["text"], queries, None, F.col("shown")).collect():
        got.setdefault(r.query, set()).add(r.id)
    assert got == {"common rare": {4}, "COMMON  Rare": {4}, "common": set(range(12)) - {7}, "often word1": {1, 10}}
    assert ranked_matches(docs, "id", ["text"], queries.where("query = 'common'"), 3).count() == 3
