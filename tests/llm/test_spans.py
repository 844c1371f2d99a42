import random
from collections import defaultdict

import numpy as np
import pytest

from symloom.llm.spans import chunks, shared_characters, sharing_pairs
from tests.conftest import as_set

SCHEMA = "doc_id long, text string, digest string, high int"


def brute(docs, length):
    held = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            held[t[i : i + length]].add(d)
    pairs = {(a, b) for s in held.values() for a in s for b in s if a < b}
    shared = {w for w, s in held.items() if len(s) > 1}
    cover = {}
    for d, t in docs:
        marks = bytearray(len(t or ""))
        for i in range(len(t or "") - length + 1):
            if t[i : i + length] in shared:
                marks[i : i + length] = b"\1" * length
        cover[d] = sum(marks)
    return pairs, cover


def check(rows, docs, length=300, spread=64):
    df = rows([(d, t, "c", 1) for d, t in docs], SCHEMA)
    pairs, cover = brute(docs, length)
    assert as_set(sharing_pairs(df, length, spread)) == pairs
    assert {r.doc_id: r.shared_chars for r in shared_characters(df, length, spread).collect()} == cover
    return pairs


def text(r, n, alphabet="abcdefgh \n日é👩"):
    return "".join(r.choices(alphabet, k=n))


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_spans_around_the_limit(rows, seed):
    r = random.Random(seed)
    docs = [(d, text(r, r.randrange(0, 900))) for d in range(24)]
    for k in range(24):
        span = text(r, r.choice([290, 299, 300, 301, 350, 600]))
        for _ in range(r.choice([2, 2, 3])):
            d = r.randrange(24)
            at = r.randrange(0, len(docs[d][1]) + 1)
            docs[d] = (d, docs[d][1][:at] + span + docs[d][1][at:])
    assert len(check(rows, docs)) > 5


def test_a_span_of_exactly_the_length_at_every_place(rows):
    r = random.Random(7)
    span = text(r, 300, "abcdefghij")
    docs = [(0, span)] + [(i, text(r, i, "xyz") + span + text(r, 40 - i, "uvw")) for i in range(1, 40)]
    assert len(check(rows, docs)) == 780


def test_uniform_and_repetitive_texts(rows):
    docs = [(1, "a" * 299), (2, "a" * 300), (3, "a" * 800), (4, "ab" * 300), (5, "b" + "ab" * 200), (6, " " * 400 + "x"), (7, "x" + " " * 400), (8, "-" * 250 + "a" * 300)]
    check(rows, docs)


def test_shared_boilerplate_makes_no_pairs(rows):
    r = random.Random(9)
    head = text(r, 280)
    docs = [(i, head + text(r, 400, "qwertzuiop")) for i in range(40)] + [(100, head + "Q" * 30), (101, head + "Q" * 30)]
    assert check(rows, docs) == {(100, 101)}


def test_other_lengths_and_limits(rows):
    r = random.Random(11)
    span = text(r, 120)
    check(rows, [(1, span + "x"), (2, "y" + span), (3, span[:119])], 120, 20)
    with pytest.raises(ValueError, match="too wide"):
        sharing_pairs(rows([], SCHEMA), 100, 64)


def test_nulls_repeats_and_empty(spark, rows):
    r = random.Random(3)
    long = text(r, 500)
    df = rows([(1, long, "c", 1), (1, long, "c", 1), (2, None, "c", 1), (3, "", "c", 1), (None, long, "c", 1), (4, long[100:], None, None)], SCHEMA)
    assert as_set(sharing_pairs(df)) == {(1, 4)}
    assert sharing_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert shared_characters(spark.createDataFrame([], SCHEMA)).collect() == []


def test_within_one_document_only_is_no_case(rows):
    span = text(random.Random(1), 400)
    assert check(rows, [(1, span + "x" + span), (2, "other")]) == set()


def test_chunks_resist_shifts():
    r = random.Random(2)
    body = [r.randrange(1000) for _ in range(5000)]
    a = np.array(body, dtype=np.uint32)
    b = np.array([1, 2, 3, *body], dtype=np.uint32)
    ca, cb = ({tuple(x[s:e]) for s, e in zip(*chunks(x, 300, 64), strict=True)} for x in (a, b))
    assert len(ca & cb) >= len(ca) - 3


def test_one_very_long_text(rows):
    r = random.Random(13)
    long = "".join(r.choices("abcdefghijklmnop \n", k=1_000_000))
    df = rows([(1, long, "c", 1), (2, long[500_000:500_300], "c", 1), (3, long[999_701:], "c", 1)], SCHEMA)
    assert as_set(sharing_pairs(df)) == {(1, 2)}
