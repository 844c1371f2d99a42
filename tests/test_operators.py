import sqlite3

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symloom.operators.paths import inner_path, longest_prefix
from symloom.operators.records import cascade, first_writer_wins, last_writer_wins, set_null, unique_by
from symloom.operators.search import ranked_matches
from symloom.operators.walk import nearest_above, walk
from tests.conftest import as_set

EDGES = "id long, projectId long, sourceId long, targetId long, kind string, metadata string"


def test_first_writer_wins(rows):
    data = [(2, 1, 1, 2, "calls ", "late"), (1, 1, 1, 2, "calls", None), (1, 1, 1, 2, "calls", None), (3, 1, 1, 2, "references", "x"), (4, 1, None, 2, "calls", "y")]
    assert as_set(first_writer_wins(rows(data, EDGES), F.trim("kind"))) == {(1, 1, 1, 2, "calls", None), (3, 1, 1, 2, "references", "x"), (4, 1, None, 2, "calls", "y")}


def test_upsert_keeps_the_first_name_and_the_last_state(rows):
    df = rows([("p", 1, "First", "a"), ("p", 2, "Second", "b"), ("p", 3, "Third", None), ("q", 1, "Q", "c")], "key string, at int, name string, value string")
    assert as_set(last_writer_wins(df, ["key"], ["at"], ["name"], ["value"])) == {("p", "First", None, 3), ("q", "Q", "c", 1)}


def test_cascade_and_set_null(rows):
    ids = rows([(1,), (2,), (2,), (None,)], "id long")
    edges = rows([(1, 1, 1, 2, "a", None), (2, 1, 1, 9, "a", None), (3, 1, None, 1, "a", None)], EDGES)
    assert {r.id for r in cascade(edges, ids).collect()} == {1}
    assert as_set(set_null(rows([(1, 1), (2, 9), (3, None)], "x long, ref long"), "ref", ids)) == {(1, 1), (2, None), (3, None)}


def test_unique_by_takes_the_greatest_row(rows):
    assert as_set(unique_by(rows([(1, "a", None), (1, "b", None), (1, "b", 2), (None, "z", 1)], "id long, v string, w int"), ["id"], "v", "w")) == {(1, "b", 2), (None, "z", 1)}


def test_longest_prefix_by_whole_folders(rows):
    files = rows([(1, "/p/Sources/App/Sub/A.swift"), (1, "/p/Sources/Apple/B.swift"), (1, "/q/C.swift"), (2, "/p/Sources/App/A.swift"), (1, None), (1, "")], "projectId long, filePath string")
    folders = rows([(1, 10, "/p/Sources/App"), (1, 11, "/p/Sources/App/Sub"), (1, 12, "/p"), (1, 13, None), (1, 9, "/p/Sources/App/Sub")], "projectId long, moduleId long, folder string")
    assert as_set(longest_prefix(files, folders)) == {(1, "/p/Sources/App/Sub/A.swift", 9), (1, "/p/Sources/Apple/B.swift", 12), (1, "/q/C.swift", None), (2, "/p/Sources/App/A.swift", None), (1, "", None)}


def test_inner_path_matches_between_slashes_whatever_the_case(rows):
    files = rows([(1, "/ws/p/sources/my_mod/X.swift"), (1, "/ws/p/Sources/myxmod/X.swift"), (1, None), (1, "X.swift"), (1, "/X.swift")], "projectId long, filePath string")
    modules = rows([(1, 1, "Sources/my_mod"), (2, 1, "p"), (3, 1, None), (4, 2, "p")], "id long, projectId long, path string")
    assert as_set(inner_path(files, modules)) == {(1, "/ws/p/sources/my_mod/X.swift", 1), (1, "/ws/p/sources/my_mod/X.swift", 2), (1, "/ws/p/Sources/myxmod/X.swift", 2)}


def bfs(links, seed, depth, root_may_return):
    level, seen, d = {seed}, set() if root_may_return else {seed}, 0
    out = set() if root_may_return else {(seed, seed, 0, None)}
    while level and d < depth:
        d += 1
        found = {}
        for a, b in sorted(links):
            if a in level and b not in seen:
                found.setdefault(b, a)
        seen |= set(found)
        out |= {(seed, n, d, p) for n, p in found.items()}
        level = set(found)
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=20), st.booleans())
def test_walk_equals_breadth_first_search(rows, links, root_may_return):
    got = as_set(walk(rows(links, "from_id long, to_id long"), rows([(0,), (3,), (3,), (None,)], "seed long"), 3, root_may_return))
    assert got == bfs(set(links), 0, 3, root_may_return) | bfs(set(links), 3, 3, root_may_return)


def test_nearest_above(rows):
    links = rows([(1, 2), (2, 3), (3, 4), (9, 4), (4, 1)], "from_id long, to_id long")
    marks = rows([(1, "k"), (2, "k"), (9, "m"), (4, "self")], "node long, mark string")
    asked = rows([(4, "k"), (4, "m"), (4, "none"), (4, "self")], "seed long, mark string")
    assert as_set(nearest_above(links, marks, asked, 20)) == {(4, "k", 2, 2), (4, "m", 9, 1), (4, "none", None, None), (4, "self", 4, 4)}


def test_search_ranks_like_fts5(rows):
    data = [(1, "HomeViewModel", "App.HomeViewModel"), (2, "HomeTab", "HomeTab"), (3, "SettingsView", "Home.SettingsView"), (4, "home_tab", "x"), (5, "", ""), (6, "Other", "Other.Home.Home")]
    data += [(10 + i, f"Filler{i}", f"Filler{i}") for i in range(12)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(name, qualifiedName, tokenize = 'unicode61')")
    db.executemany("insert into t(rowid, name, qualifiedName) values (?, ?, ?)", data)
    queries = ["Home", "home tab", "View", "Set home", "nothing", "..."]
    got = {}
    for r in ranked_matches(rows(data, "id long, name string, qualifiedName string"), "id", ["name", "qualifiedName"], rows([(q,) for q in [*queries, "Home", None]], "query string"), None).collect():
        got.setdefault(r.query, {})[r.id] = r.score
    for query in queries[:5]:
        match = " ".join(t + "*" for t in query.split())
        want = {i: round(s, 6) for i, s in db.execute("select rowid, rank from t where t match ?", (match,))}
        assert {i: round(s, 6) for i, s in got.get(query, {}).items()} == want, query
    assert "..." not in got


def test_search_handles_nulls_and_nothing(spark, rows):
    schema = "id long, name string, q string"
    assert ranked_matches(spark.createDataFrame([], schema), "id", ["name", "q"], rows([("a",)], "query string"), 3).collect() == []
    df = rows([(i, None, "abc") for i in range(5)] + [(9, "zzz", None)], schema)
    assert [r.id for r in ranked_matches(df, "id", ["name", "q"], rows([("ab",)], "query string"), 2).orderBy("place").collect()] == [0, 1]
