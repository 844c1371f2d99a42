"""Held-out texts inside a corpus: winnowed word-gram fingerprints, joined and extended.

Of every ``WINDOW`` consecutive ``GRAM``-word hashes the least is kept, so two texts that share
``SPAN`` = GRAM + WINDOW - 1 words share a kept hash. Each kept hash carries the hashes of the
``SPAN``-word stretches around it; a hit stands when one of them is equal too.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.minima import window_minima

SPAN, GRAM, WINDOW = 10, 6, 5
#: Broadcast the held-out fingerprints only up to so many rows (about 80 bytes each).
BROADCAST_ROWS = 500_000

_ASCII = regex.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARKS = regex.compile(r"[\p{M}\p{Cf}]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in compatibility decomposition, without case, accents or format characters."""
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _WORD.findall(_MARKS.sub("", plain))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive codes."""
    n = len(codes) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n])
    return h


def fingerprints(text: str | None, known: dict[str, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Kept gram hashes of a text and, for each, the hashes of the spans that hold it."""
    tokens = words(text)
    if len(tokens) < SPAN:
        return np.array([], dtype=np.int64), []
    codes = np.empty(len(tokens), dtype=np.uint64)
    for i, word in enumerate(tokens):
        code = known.get(word)
        if code is None:
            if len(known) > 200_000:
                known.clear()
            code = known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        codes[i] = code
    grams, spans = _grams(codes, GRAM), _grams(codes, SPAN).view(np.int64)
    kept = window_minima(grams, WINDOW)
    around = [spans[max(0, p - (SPAN - GRAM)) : p + 1] for p in kept.tolist()]
    return grams[kept].view(np.int64), around


def fingerprint_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, gram, spans) for every kept hash of every text."""
    schema = pa.schema([(key, pa.int64()), ("gram", pa.int64()), ("spans", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        keys: list[int] = []
        grams: list[np.ndarray] = []
        spans: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            sizes = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(spans)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(grams)), lists], schema=schema)

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                kept, around = fingerprints(t.as_py(), known)
                if len(kept):
                    keys += [k.as_py()] * len(kept)
                    grams.append(kept)
                    spans += around
                if len(keys) > 50_000:
                    yield packed()
                    keys, grams, spans = [], [], []
        if keys:
            yield packed()

    found = texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    return found.mapInArrow(rows, f"{key} long, gram long, spans array<long>")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds at least ten consecutive words of the item's text.

    Null and short texts, and rows without an id, can't take part; repeated rows count once. The
    items' fingerprints are broadcast while their counted rows stay within ``BROADCAST_ROWS``;
    beyond it both sides are shuffled by fingerprint.
    """
    held = fingerprint_rows(items, "item_id").withColumnRenamed("spans", "item_spans")
    if held.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    hits = fingerprint_rows(documents, "doc_id").join(held, "gram").where(F.arrays_overlap("spans", "item_spans"))
    return hits.select("doc_id", "item_id").distinct()


def leaked_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_documents) of every item, 0 for those that didn't leak."""
    counts = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.select("item_id", "suite").distinct().join(counts, "item_id", "left").fillna(0, ["n_documents"])
