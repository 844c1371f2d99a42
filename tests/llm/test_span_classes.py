import random

from symloom.llm import spans
from symloom.llm.spans import sharing_classes, sharing_pairs
from tests.conftest import as_set
from tests.llm.test_spans import SCHEMA, check, text


def test_short_stretches_between_long_ones(rows):
    """One chunk, three holders: two share much to the right of it, two much to its left, two only just enough."""
    r = random.Random(21)
    for core, left, right in ((150, 60, 95), (160, 70, 69), (160, 70, 70), (200, 99, 0), (299, 0, 1), (299, 0, 0)):
        span, a, b = text(r, core), text(r, left), text(r, right)
        docs = [(1, text(r, 300, "xyz") + a + span + b + text(r, 300, "uvw")), (2, text(r, 200, "klm") + a + span + b + text(r, 100, "nop"))]
        docs += [(3, docs[0][1][: 300 + left + core + right + 250]), (4, docs[1][1][50:]), (5, text(r, 20) + span + text(r, 20))]
        want = {(1, 3), (2, 4)} | ({(x, y) for x, y in ((1, 2), (1, 4), (2, 3), (3, 4))} if left + core + right >= 300 else set())
        assert check(rows, docs) == want


def test_only_open_chunks_give_a_row_per_character(rows, monkeypatch):
    r = random.Random(22)
    long = text(r, 5000)
    df = rows([(i, text(r, 50 * i) + long + text(r, 70), "c", 1) for i in range(1, 5)], SCHEMA)
    asked = []
    real = spans.window_rows
    monkeypatch.setattr(spans, "window_rows", lambda c, *a: asked.append(real(c, *a)) or asked[-1])
    assert len(sharing_pairs(df).collect()) == 6
    assert asked[0].count() == 0


def test_classes_name_each_set_once(rows):
    r = random.Random(23)
    a, b = text(r, 900), text(r, 900)
    df = rows([(i, text(r, i) + a + text(r, 9) + (b if i % 2 else text(r, 500)), "c", 1) for i in range(30)], SCHEMA)
    classes = {}
    for row in sharing_classes(df).collect():
        classes.setdefault((row.high, row.low), set()).add(row.doc_id)
    sets = [frozenset(x) for x in classes.values()]  # windows that take in a neighbour by chance are sets of their own
    assert len(sets) == len(set(sets)) < 10 and {frozenset(range(30)), frozenset(range(1, 30, 2))} <= set(sets)


def test_a_large_class_is_spread_over_keys(rows, monkeypatch):
    r = random.Random(24)
    a = text(r, 400)
    df = rows([(i, a + text(r, 30), "c", 1) for i in range(60)], SCHEMA)
    monkeypatch.setattr(spans, "HELD", 7)
    assert as_set(sharing_pairs(df)) == {(i, j) for j in range(60) for i in range(j)}


def test_beyond_the_broadcast_bound(rows, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_ROWS", 0)
    r = random.Random(25)
    span = text(r, 340)
    assert check(rows, [(i, text(r, 90) + span[i : i + 320] + text(r, 60)) for i in range(0, 40, 5)]) != set()
