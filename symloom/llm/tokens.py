"""Encoding of a corpus with a public byte-level BPE vocabulary.

The encoder is a transducer that reads a piece byte by byte. After each byte it knows the last
token of the encoding of what was read so far, because a sequence of tokens is the encoding of
its bytes exactly when every two neighbours are the encoding of theirs. The next token starts at
one of the last ``longest`` positions, so only these stay open; tokens on which all of them
agree can't change any more and are emitted.

How long a token may wait is bounded by the merge list. What follows a text changes its encoding
from the right: a merge that takes a token away at some boundary frees the token to its left,
which then may merge further left, but only by a merge of lower priority whose right part begins
with the token that was taken. The widest chain of such merges, summed over their left parts, is
the ``sufficient_lookahead``: tokens that end this far behind the last byte read are final, and the
transducer emits them whether its open positions agree or not. So what it holds never grows with
the piece.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHED_PIECES = 100_000
CACHED_PAIRS = 1_000_000
BLOCK = 4096
LONG = 1 << 10  # bytes without a final token after which the lookahead is asked for
#: Fixed value: the vocabulary's published rule for pieces that merges don't cross.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Merges:
    """A merge list: token bytes by rank, and which tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.joined: dict[int, bool] = {}  # whether a pair of tokens, as one number, are neighbours
        self._spines: dict[int, tuple[int, int]] = {}

    @cached_property
    def endings(self) -> ahocorasick.Automaton:
        """Finds (size, token) of all tokens that end at each byte, the longest first."""
        automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            automaton.add_word(token.decode("latin-1"), (len(token), rank))
        automaton.make_automaton()
        return automaton

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def parts(self, token: bytes) -> list[bytes]:
        """The two tokens whose merge makes a token; one byte is its own part."""
        rank, parts = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            least, i = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if least == rank:
                raise ValueError("the merge list doesn't lead to this token")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    @cached_property
    def sufficient_lookahead(self) -> int:
        """Bytes after which no earlier token can change, whatever follows.

        ``reach[t]`` is the widest chain so far whose last merge has the left part t; merges are taken by
        rank, and one continues the chains whose left part its right part begins with.
        """
        reach: dict[bytes, int] = {}
        for token in sorted(self.ranks, key=self.ranks.__getitem__):
            widths = {}
            for cut in range(1, len(token)):  # any two tokens side by side merge if their bytes are a token
                left, right = token[:cut], token[cut:]
                if left in self.ranks and right in self.ranks:
                    widths[left] = cut + max(reach.get(right[:k], 0) for k in range(1, len(right) + 1))
            for left, width in widths.items():
                reach[left] = max(reach.get(left, 0), width)
        return max(reach.values(), default=0)

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition: the lowest-ranked pair merges first, leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1))
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int]:
        found = self._spines.get(token)
        if found is None:
            parts = self.parts(self.bytes_of[token])
            found = self._spines[token] = (self.ranks[parts[0]], self.ranks[parts[-1]])
        return found

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens.

        Merges are undone from the last one back, each time the later of the two that stand at the
        boundary. What stands there at some time must not merge before the next of them is taken; of
        equal ranks the one further left comes first.
        """
        until_left = until_right = len(self.ranks)  # the merges that take what stands at the boundary
        while True:
            rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if rank is not None and rank < until_left and rank <= until_right:
                return False
            one_left, one_right = len(self.bytes_of[left]) == 1, len(self.bytes_of[right]) == 1
            if one_left and one_right:
                return True
            if one_right or (not one_left and left > right):
                until_left, left = left, self._split(left)[1]
            else:
                until_right, right = right, self._split(right)[0]

    def remember(self, pair: int) -> bool:
        if len(self.joined) >= CACHED_PAIRS:
            self.joined.clear()
        fits = self.joined[pair] = self.neighbours(pair >> 32, pair & 0xFFFFFFFF)
        return fits


class Transducer:
    """Reads the bytes of one piece; ``feed`` returns the tokens that became final."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.tail = b""  # the last ``longest`` bytes
        self.read = 0
        self.last: dict[int, tuple[int, int]] = {0: (-1, -1)}  # position -> (last token, where it starts)
        self.root = 0  # where the first token that isn't emitted starts

    def feed(self, data: bytes) -> Iterator[int]:
        merges, last = self.merges, self.last
        longest, joined, ends = merges.longest, merges.joined, merges.endings.iter
        for block in range(0, len(data), BLOCK):
            held = self.tail + data[block : block + BLOCK]
            base, at = self.read - len(self.tail) + 1, self.read
            for end, (size, token) in ends(held.decode("latin-1")):
                position = base + end
                if position <= at:  # of the tokens that end here only one fits what comes before it
                    continue
                start = position - size
                before = last.get(start)
                if before is None:
                    continue
                if start:
                    pair = before[0] << 32 | token
                    fits = joined.get(pair)
                    if fits is None:
                        fits = merges.remember(pair)
                    if not fits:
                        continue
                last[position] = (token, start)
                at = position
                if not at % longest and at - self.root >= 2 * longest:
                    self.read = at
                    yield from self._settle()
            if at != base + len(held) - 1:
                raise ValueError("the vocabulary lacks a byte")
            self.read = at
            self.tail = held[-longest:]

    def _settle(self) -> Iterator[int]:
        """Tokens up to the last start that all open positions have in common, and in any case those that
        end a sufficient lookahead ago; what no open position leads back to is forgotten."""
        last, root = self.last, self.root
        oldest = self.read - self.merges.longest + 1
        kept = {p: last[p] for p in range(oldest, self.read + 1)}
        branches = [-p for p in kept]
        heapify(branches)
        ends = {p for p in kept}
        while len(branches) > 1:  # the latest branch steps back until all have met
            start = last[-heappop(branches)][1]
            if start not in ends:
                ends.add(start)
                kept[start] = last[start]
                heappush(branches, -start)
        final = -branches[0]
        if self.read - root > LONG and final <= self.read - self.merges.longest - self.merges.sufficient_lookahead:
            final = max(p for p in self._starts(self.read) if p <= self.read - self.merges.sufficient_lookahead)
            kept = {p: t for p, t in kept.items() if p >= final}
        tokens = []
        for position in self._starts(final):
            if position > root:
                tokens.append(last[position][0])
        self.root = final
        kept[final] = (last[final][0], -1)
        last.clear()
        last.update(kept)
        yield from reversed(tokens)

    def _starts(self, position: int) -> Iterator[int]:
        """A position and the starts of the tokens that lead up to it, back to the root."""
        while position > self.root:
            yield position
            position = self.last[position][1]
        yield self.root

    def finish(self) -> list[int]:
        return [self.last[p][0] for p in self._starts(self.read) if p > self.root][::-1]


class Encoder:
    """Text to ids; recent short pieces are remembered in a table of bounded size."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._pieces = regex.compile(PIECES)
        self._known: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8")
        whole = self.merges.ranks.get(data)
        if whole is not None:  # a merge list that makes a token makes it of these bytes
            return [whole]
        if len(data) <= self.merges.longest:
            return self._short(data)
        transducer = Transducer(self.merges)
        return [*transducer.feed(data), *transducer.finish()]

    def _short(self, data: bytes) -> list[int]:
        """The transducer's steps on a piece of which nothing has to be forgotten."""
        merges, tokens, starts, at = self.merges, [-1], [-1], 0
        joined = merges.joined
        for end, (size, token) in merges.endings.iter(data.decode("latin-1")):
            if end < at:
                continue
            start = end + 1 - size
            if start:
                pair = tokens[start] << 32 | token
                fits = joined.get(pair)
                if fits is None:
                    fits = merges.remember(pair)
                if not fits:
                    continue
            tokens.append(token)
            starts.append(start)
            at += 1
        if at != len(data):
            raise ValueError("the vocabulary lacks a byte")
        path = []
        while at:
            path.append(tokens[at])
            at = starts[at]
        return path[::-1]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for match in self._pieces.finditer(text or ""):
            piece = match.group()
            known = self._known.get(piece)
            if known is None:
                known = tuple(self.piece(piece))  # unlike lists, tuples of numbers cost the collector nothing
                if len(piece) <= 64:
                    if len(self._known) >= CACHED_PIECES:
                        self._known.clear()
                    self._known[piece] = known
            ids += known
        return ids


def decode(ids: Iterable[int], merges: Merges) -> str:
    """Ids to text through a UTF-8 state machine that takes one token at a time."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    return "".join([machine.decode(merges.bytes_of[i]) for i in ids]) + machine.decode(b"", True)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(Merges.load(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _shipped(vocabulary: str) -> str:
    """The name under which every executor finds the vocabulary's file."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("encoding needs an active session")
    spark.sparkContext.addFile(vocabulary)
    return vocabulary.rsplit("/", 1)[-1]


def token_ids(text: Column | str, vocabulary: str) -> Column:
    """The ids of a text without special tokens; an empty list for an empty and for a null text.

    ``vocabulary`` is a path on the driver; the file is sent to the executors.
    """
    name = _shipped(vocabulary)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(SparkFiles.get(name)).encode
        for batch in batches:
            yield pd.Series([encode(x) for x in batch], index=batch.index, dtype=object)

    return ids(text)


def token_text(ids: Column | str, vocabulary: str) -> Column:
    """The text of ids; bytes that are no UTF-8 become U+FFFD, null stays null."""
    name = _shipped(vocabulary)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = encoder(SparkFiles.get(name)).merges
        for batch in batches:
            yield pd.Series([None if x is None else decode(x, merges) for x in batch], index=batch.index, dtype=object)

    return text(ids)


def encode_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of each document. Special tokens' strings are ordinary text; further columns are
    ignored; repeated rows are encoded each."""
    return documents.select("doc_id", token_ids("text", vocabulary or default_vocabulary()).alias("ids"))
