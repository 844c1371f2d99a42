import random

import pytest

from symloom.llm import tokens
from symloom.llm.tokens import Encoder, Merges, Transducer


def vocabulary(seed: int, size: int = 40, alphabet: bytes = b"ab", longest: int = 12) -> Merges:
    """A merge list that each token can be reached by: every new token joins two that are there, side by side."""
    r = random.Random(seed)
    ranks = {bytes([c]): i for i, c in enumerate(sorted(set(alphabet)))}
    while len(ranks) < size:
        a, b = r.choice(list(ranks)), r.choice(list(ranks))
        if a + b in ranks or len(a + b) > longest:
            size -= len(a + b) > longest
            continue
        trial = Merges(ranks)
        if trial.merge(a + b) == [ranks[a], ranks[b]]:
            ranks[a + b] = len(ranks)
        else:
            size -= 1
    return Merges(ranks)


@pytest.mark.parametrize("seed", range(60))
def test_any_merge_list_against_its_definition(seed):
    r = random.Random(seed)
    merges = vocabulary(seed, 5 + seed, b"ab" if seed % 2 else b"abc")
    encoder = Encoder(merges)
    for n in (1, 2, 5, 17, 60, 200):
        data = bytes(r.choice(b"ab" if seed % 2 else b"abc") for _ in range(n)) if n % 2 else (b"ab" * n)[:n]
        want = merges.merge(data)
        machine, got = Transducer(merges), []
        for i in range(0, n, 7):
            got += machine.feed(data[i : i + 7])
            assert got == want[: len(got)]
        assert got + machine.finish() == want
        if n <= merges.longest:
            assert encoder._short(data) == want


@pytest.mark.parametrize("seed", range(40))
def test_nothing_changes_beyond_the_lookahead(seed):
    r = random.Random(1000 + seed)
    merges = vocabulary(seed, 30, b"ab", 8)
    far, size = merges.sufficient_lookahead, {rank: len(t) for t, rank in merges.ranks.items()}
    for _ in range(30):
        data = bytes(r.choice(b"ab") for _ in range(far + 40))
        whole = merges.merge(data)
        for n in range(1, len(data), 3):
            at, final = 0, []
            for token in merges.merge(data[:n]):
                at += size[token]
                if at > n - far:
                    break
                final.append(token)
            assert whole[: len(final)] == final


def test_the_lookahead_alone_bounds_what_is_held(monkeypatch):
    """With agreement never reached, tokens still leave a sufficient lookahead after they were read."""
    merges = vocabulary(3, 30, b"ab", 8)
    monkeypatch.setattr(tokens, "LONG", 0)
    r, emitted, most = random.Random(5), [], 0
    data = bytes(r.choice(b"ab") for _ in range(5000))
    machine = Transducer(merges)
    for i in range(len(data)):
        emitted += machine.feed(data[i : i + 1])
        most = max(most, len(machine.last))
    assert emitted + machine.finish() == merges.merge(data)
    assert most <= 4 * merges.longest + merges.sufficient_lookahead


def test_a_vocabulary_without_a_byte_says_so():
    with pytest.raises(ValueError):
        Encoder(Merges({b"a": 0, b"b": 1})).piece("ac")
