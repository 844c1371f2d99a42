"""Long verbatim spans between records: content-defined chunks by a gear hash.

A gear hash over the last ``GEAR`` characters is taken at each character; a position whose hash is
the least of some ``spread`` consecutive ones is a cut. Inside a stretch that two texts share, all
cuts between the one of its first and the one of its last window are the same in both. Each cut
opens a chunk that ends at the first cut at least ``reach`` further on; ``reach`` is set so that
the stretch's first chunk ends inside it. So texts that share ``length`` characters share a chunk,
wherever insertions moved it. Chunks are deduplicated by digest; what follows looks only at texts
that have a chunk in common with another one.

Pairs come from windows of ``length`` characters and their 128-bit digests. At first only two are
taken for each chunk, the one that begins with it and the one that ends with it: a longer stretch
has one of them inside. Where all holders of a chunk have the same window on either side, all pairs
of them are known; the windows in between are digested, one per character, only around the other
chunks. Digests held by the very same documents are one class, and pairs are formed once per class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.minima import window_minima
from symloom.session import cut

GEAR = 32
ROWS = 20_000
HELD = 1_000  # members of a class under one join key
BROADCAST_ROWS = 500_000  # digests that are broadcast at most, alone or in lists by document


def _gear(codes: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at each character: sum of G[c] << age, which forgets after 32 characters."""
    h = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    m = 1
    while m < GEAR:
        older = np.zeros_like(h)
        older[m:] = h[:-m] << np.uint32(m)
        h = h + older
        m *= 2
    return h


def chunks(codes: np.ndarray, length: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of a text given as code points."""
    none = np.array([], dtype=np.int64)
    if len(codes) < max(length, GEAR + spread):
        return none, none
    cuts = window_minima(_gear(codes)[GEAR - 1 :], spread) + GEAR - 1
    reach = length - 2 * spread - GEAR + 2
    ends = np.searchsorted(cuts, cuts + reach)
    whole = ends < len(cuts)
    return cuts[whole] - GEAR + 1, cuts[ends[whole]] + 1


def _chunk_digests(text: str, length: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = text.encode("utf-32-le", "surrogatepass")
    starts, ends = chunks(np.frombuffer(data, dtype=np.uint32), length, spread)
    digests = np.array([xxhash.xxh3_64_intdigest(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)
    return starts, ends, digests.view(np.int64)


def chunk_rows(documents: DataFrame, length: int, spread: int) -> DataFrame:
    """(doc_id, digest), each once per document, of all texts of at least ``length`` characters."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, held = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                found = np.unique(_chunk_digests(t.as_py(), length, spread)[2])
                ids.append(np.full(len(found), k.as_py(), dtype=np.int64))
                digests.append(found)
                held += len(found)
                if held > ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(digests))], names=["doc_id", "digest"])
                    ids, digests, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(digests))], names=["doc_id", "digest"])

    return documents.mapInArrow(rows, "doc_id long, digest long")


def _packed(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _halves(data: bytes, i: int, length: int) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(data[4 * i : 4 * (i + length)])
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def anchor_rows(candidates: DataFrame, length: int, spread: int) -> DataFrame:
    """(doc_id, chunk, ends_high, ends_low, begins_high, begins_low) of each of a document's shared chunks: the
    digests of the window that ends and of the one that begins with it, null where the text is too short."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "chunk", "ends_high", "ends_low", "begins_high", "begins_low")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for k, t, shared in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                doc, text = k.as_py(), t.as_py()
                starts, ends, digests = _chunk_digests(text, length, spread)
                mine = np.isin(digests, np.asarray(shared.values.to_numpy(zero_copy_only=False)))
                data, last = text.encode("utf-32-le", "surrogatepass"), len(text) - length
                for s, e, d in zip(starts[mine].tolist(), ends[mine].tolist(), digests[mine].tolist(), strict=True):
                    out.append((doc, d, *(_halves(data, e - length, length) if e >= length else (None, None)), *(_halves(data, s, length) if s <= last else (None, None))))
                    if len(out) >= ROWS:
                        yield _packed(list(zip(*out, strict=True)), schema)
                        out.clear()
        if out:
            yield _packed(list(zip(*out, strict=True)), schema)

    return candidates.mapInArrow(rows, "doc_id long, chunk long, ends_high long, ends_low long, begins_high long, begins_low long")


def window_rows(candidates: DataFrame, length: int, spread: int) -> DataFrame:
    """(doc_id, start, high, low) of each window of ``length`` characters that holds one of the document's
    chunks named with it."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for k, t, shared in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                doc, text = k.as_py(), t.as_py()
                starts, ends, digests = _chunk_digests(text, length, spread)
                mine = np.isin(digests, np.asarray(shared.values.to_numpy(zero_copy_only=False)))
                data, last, at = text.encode("utf-32-le", "surrogatepass"), len(text) - length, -1
                for s, e in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True):
                    for i in range(max(0, e - length, at + 1), min(s, last) + 1):
                        out.append((doc, i, *_halves(data, i, length)))
                        at = i
                        if len(out) >= ROWS:
                            yield _packed(list(zip(*out, strict=True)), schema)
                            out.clear()
        if out:
            yield _packed(list(zip(*out, strict=True)), schema)

    return candidates.mapInArrow(rows, "doc_id long, start int, high long, low long")


def _small(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows`` marked for broadcast if ``counted``, written before, has few: counted, never assumed."""
    return F.broadcast(rows) if counted.count() <= BROADCAST_ROWS else rows


def _texts(documents: DataFrame, length: int, spread: int) -> DataFrame:
    if length - 2 * spread - GEAR + 2 < 1:
        raise ValueError("the spread is too wide for this length")
    return documents.where((F.char_length("text") >= length) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _with_chunks(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, shared) of the texts that have chunks (doc_id, digest) in ``found``, which is written; a
    document's own list of them is no longer than its text."""
    marked = found.groupBy("doc_id").agg(F.collect_set("digest").alias("shared"))
    return texts.join(_small(marked, found), "doc_id").select("doc_id", "text", "shared")


def _common_chunks(texts: DataFrame, length: int, spread: int) -> DataFrame:
    """(doc_id, digest) of the chunks that more than one document has."""
    found = cut(chunk_rows(texts, length, spread))
    common = cut(found.groupBy("digest").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("digest"))
    return cut(found.join(_small(common, common), "digest", "left_semi"))


def sharing_classes(documents: DataFrame, length: int = 300, spread: int = 64) -> DataFrame:
    """(high, low, n, doc_id): sets of two or more documents that have a window in common, each set once, named
    by one of its windows; n is their number.

    Null texts and texts shorter than ``length`` share nothing. A document id that occurs in several
    rows is one document. ``length`` - 2 * ``spread`` - 30 must be positive.
    """
    texts = _texts(documents, length, spread)
    found = _common_chunks(texts, length, spread)
    anchors = cut(anchor_rows(_with_chunks(texts, found), length, spread))
    ends, begins = F.struct("ends_high", "ends_low"), F.struct("begins_high", "begins_low")
    alike = lambda w, c: (F.count(c) == F.count(F.lit(1))) & (F.min(w) == F.max(w))
    open_ = anchors.groupBy("chunk").agg((alike(ends, "ends_high") | alike(begins, "begins_high")).alias("known")).where(~F.col("known")).select(F.col("chunk").alias("digest"))
    between = window_rows(_with_chunks(texts, cut(found.join(open_, "digest", "left_semi"))), length, spread)
    sides = anchors.select("doc_id", F.explode(F.array(F.struct(F.col("ends_high").alias("high"), F.col("ends_low").alias("low")), F.struct(F.col("begins_high").alias("high"), F.col("begins_low").alias("low")))).alias("w"))
    holders = cut(sides.select("w.high", "w.low", "doc_id").where("high IS NOT NULL").unionByName(between.select("high", "low", "doc_id")).distinct())
    # Two combined hashes and the number name a set of documents, however many it has.
    sets = holders.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"s{i}") for i in (0, 1)]).where("n > 1")
    named = sets.groupBy("n", "s0", "s1").agg(F.min(F.struct("high", "low")).alias("w")).select("w.high", "w.low", "n")
    return holders.join(named, ["high", "low"]).select("high", "low", "n", "doc_id")


def sharing_pairs(documents: DataFrame, length: int = 300, spread: int = 64) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of documents that share ``length`` or more characters verbatim.

    Pairs are formed per class; a class with very many members is spread over as many keys as it
    needs, each of which holds at most ``HELD`` of them against all.
    """
    classes = cut(sharing_classes(documents, length, spread))
    slots = F.ceil(F.col("n") / HELD).cast("int")
    a = classes.select("high", "low", F.col("doc_id").alias("doc_a"), F.pmod(F.xxhash64("doc_id"), slots).cast("int").alias("slot"))
    b = classes.select("high", "low", F.col("doc_id").alias("doc_b"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
    return a.join(b, ["high", "low", "slot"]).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def shared_characters(documents: DataFrame, length: int = 300, spread: int = 64) -> DataFrame:
    """(doc_id, n_chars, shared_chars): how much of each document lies in spans that another one has.

    Null texts have 0 characters; documents that share nothing have 0 shared ones. Here every window
    around a shared chunk counts, as each may begin or end a span.
    """
    texts = _texts(documents, length, spread)
    windows = cut(window_rows(_with_chunks(texts, _common_chunks(texts, length, spread)), length, spread))
    digests = windows.groupBy("high", "low").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("high", "low")
    starts = windows.join(digests, ["high", "low"], "left_semi").select("doc_id", "start").distinct()
    after = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")) - F.col("start")
    covered = starts.withColumn("adds", F.least(F.lit(length), F.coalesce(after, F.lit(length)))).groupBy("doc_id").agg(F.sum("adds").alias("shared_chars"))
    return documents.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars")).join(covered, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
