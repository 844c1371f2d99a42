import random

import pytest

from symloom.operators.hierarchy import circles, descendants, hierarchy
from tests.conftest import as_set

LINKS = "child long, parent long"


def brute(links):
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    out = set()
    for n in {x for link in links for x in link if x is not None}:
        seen, x = [], n
        while x in up and x not in seen:
            seen.append(x)
            x = up[x]
        out.add((n, -1, -1) if x in up else (n, x, len(seen)))
    return out


@pytest.mark.parametrize("fragment_rows", [7, 40, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_circles(rows, seed, fragment_rows):
    r = random.Random(seed)
    links = [(c, r.randrange(max(0, c - 30), c)) for c in range(1, 160) if r.random() < 0.9]
    links += [(900, 901), (901, 902), (902, 900), (903, 900), (950, 950)]
    r.shuffle(links)
    df = rows(links, LINKS)
    assert as_set(hierarchy(df, "child", "parent", fragment_rows=fragment_rows)) == brute(links)


def test_one_long_chain_across_many_fragments(rows):
    ids = list(range(500))
    random.Random(3).shuffle(ids)
    links = list(zip(ids[1:], ids[:-1], strict=True))
    got = as_set(hierarchy(rows(links, LINKS), "child", "parent", fragment_rows=20))
    assert got == {(n, ids[0], d) for d, n in enumerate(ids)}


def test_circle_across_fragments(rows):
    ids = list(range(300))
    random.Random(4).shuffle(ids)
    links = list(zip(ids, ids[1:] + ids[:1], strict=True)) + [(1000, ids[5]), (1001, 1000)]
    got = as_set(hierarchy(rows(links, LINKS), "child", "parent", fragment_rows=25))
    assert got == {(n, -1, -1) for n in [*ids, 1000, 1001]}
    places = dict(circles(rows(links, LINKS), "child", "parent", fragment_rows=25).collect())
    assert places == {n: "on" for n in ids} | {1000: "below", 1001: "below"}


def test_paths_and_descendants(rows):
    links = [(2, 1), (3, 2), (4, 2), (5, 4), (7, 6), (6, 7), (2, 1), (8, None), (None, 9)]
    for size in (2, 100):
        found = hierarchy(rows(links, LINKS), "child", "parent", with_path=True, fragment_rows=size)
        paths = {r.node_id: r.path for r in found.collect()}
        assert paths == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 4], 5: [1, 2, 4, 5], 6: None, 7: None, 8: [8], 9: [9]}
        assert as_set(descendants(found)) == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 2), (2, 4, 1), (1, 5, 3), (2, 5, 2), (4, 5, 1)}


def test_several_parents_take_the_least_and_a_hot_root(rows):
    links = [(c, 0) for c in range(1, 400)] + [(400, 7), (400, 3)]
    got = {r.node_id: (r.root_id, r.depth) for r in hierarchy(rows(links, LINKS), "child", "parent", fragment_rows=50).collect()}
    assert got[400] == (0, 2) and got[399] == (0, 1) and got[0] == (0, 0)


def test_empty_and_clashing_columns(spark, rows):
    assert hierarchy(spark.createDataFrame([], LINKS), "child", "parent").collect() == []
    assert circles(spark.createDataFrame([], LINKS), "child", "parent").collect() == []
    df = rows([(2, 1, 9, "x", 5)], "a long, b long, child long, exit string, part long")
    assert as_set(hierarchy(df, "a", "b")) == {(1, 1, 0), (2, 1, 1)}
