import base64

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from symloom.llm.tokens import Encoder, Merges, Transducer, decode, encode_documents, token_text

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MERGES = Merges.load(PATH)
ENCODER = Encoder(MERGES)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library_and_round_trips(text):
    ids = ENCODER.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert decode(ids, MERGES) == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abet 's\n-0é日", max_size=400))
def test_dense_alphabets(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "-" * 3000, " " * 3000 + "x", "日本語テキスト" * 300, "<|endoftext|> x", "\r\n\t\0\x07", "é👩‍👩‍👧﻿"])
def test_long_and_odd_texts(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_memory_does_not_grow_with_the_piece():
    machine, emitted, most = Transducer(MERGES), [], 0
    piece = b"thequickbrownfox" * 2000
    for i in range(0, len(piece), 500):
        emitted += machine.feed(piece[i : i + 500])
        most = max(most, len(machine.last))
    emitted += machine.finish()
    assert emitted == REFERENCE.encode_ordinary(piece.decode())
    assert most <= 4 * MERGES.longest < MERGES.sufficient_lookahead


def test_published_pattern_is_the_one_used():
    from symloom.llm.tokens import PIECES

    text = "It's 12 o'clock,\n  isn't it? 日本 x"
    assert regex.findall(PIECES, text) == regex.findall(public.PATTERN, text)


def test_on_spark(spark, rows):
    df = rows([(1, "Hello world", 9), (2, "", 9), (3, None, 9), (3, None, 9), (None, "x", 9)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.ids) for r in encode_documents(df, PATH).collect())
    assert got == [(0, REFERENCE.encode_ordinary("x")), (1, REFERENCE.encode_ordinary("Hello world")), (2, []), (3, []), (3, [])]
    back = encode_documents(df, PATH).select("doc_id", token_text("ids", PATH).alias("t")).where("doc_id = 1").first().t
    assert back == "Hello world"
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    assert encode_documents(df, PATH).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
