import random
from collections import defaultdict

from symloom.llm import leakage
from symloom.llm.leakage import SPAN, fingerprints, leaked_items, leaks, words
from tests.conftest import as_set

DOCS, ITEMS = "doc_id long, text string, gram string, spans int", "item_id long, suite string, text string, gram int"


def brute(docs, items):
    held = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - SPAN + 1):
            held[tuple(w[k : k + SPAN])].add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - SPAN + 1):
            out |= {(d, i) for i in held.get(tuple(w[k : k + SPAN]), ())}
    return out


def run(rows, docs, items):
    return as_set(leaks(rows([(d, t, "c", 1) for d, t in docs], DOCS), rows([(i, "s", t, 1) for i, t in items], ITEMS)))


def test_words():
    assert words("Straße  CAFÉ café x²! ﬁx​ed ３Ａ a_b") == ["strasse", "cafe", "cafe", "x2", "fixed", "3a", "a", "b"]
    assert words(None) == words("") == words("… —") == []


def test_every_span_of_ten_is_found_wherever_it_lies(rows):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(5, 40)))) for i in range(30)]
    docs = []
    for d in range(60):
        text = r.choices(vocabulary, k=r.randrange(0, 60))
        source = words(items[r.randrange(30)][1])
        size, at = r.randrange(8, 14), r.randrange(0, len(text) + 1)
        start = r.randrange(0, max(1, len(source) - size))
        docs.append((d, ", ".join(text[:at] + source[start : start + size] + text[at:]).upper()))
    want = brute(docs, items)
    assert run(rows, docs, items) == want and len(want) > 10


def test_repetitive_texts(rows):
    items = [(1, "a " * 50), (2, "a b " * 20)]
    docs = [(1, "a " * 9), (2, "A " * 10), (3, "b a " * 5), (4, "b a " * 4 + "b"), (5, "a " * 100000)]
    assert run(rows, docs, items) == brute(docs, items)


def test_forms_of_writing_do_not_hide_a_leak(rows):
    item = "The quick brown fox jumps over the lazy dog near Cafe Muller"
    docs = [(1, "the QUICK—brown\nfox, jumps over (the) la​zy dog; near cáfe"), (2, "the quick brown fox jumps over the lazy cat near cafe"), (3, "x " + item.replace(" ", "  ") + " y")]
    assert run(rows, docs, [(7, item)]) == {(1, 7), (3, 7)}


def test_nulls_repeats_and_empty_tables(spark, rows):
    text = "one two three four five six seven eight nine ten"
    docs = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "one two")]
    items = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "one two")]
    assert run(rows, docs, items) == {(1, 1)}
    assert leaks(spark.createDataFrame([], DOCS), rows([(1, "s", text, 1)], ITEMS)).collect() == []
    assert leaks(rows([(1, text, "c", 1)], DOCS), spark.createDataFrame([], ITEMS)).collect() == []
    found = leaked_items(leaks(rows([(1, text, "c", 1)], DOCS), rows([(1, "s", text, 1)], ITEMS)), rows([(1, "s", text, 1), (9, "s", None, 1)], ITEMS))
    assert as_set(found) == {(1, "s", 1), (9, "s", 0)}


def test_large_item_sets_are_shuffled(rows, monkeypatch):
    text = "one two three four five six seven eight nine ten eleven"
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)
    assert run(rows, [(i, text) for i in range(50)], [(1, text)]) == {(i, 1) for i in range(50)}


def test_kept_hashes_are_few():
    kept, around = fingerprints(" ".join(f"w{i}" for i in range(1000)), {})
    assert len(kept) < 450 and all(1 <= len(s) <= 5 for s in around)
