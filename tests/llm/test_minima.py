import numpy as np
import pytest

from symloom.llm import minima
from symloom.llm.minima import window_minima


@pytest.mark.parametrize("block", [3, 1 << 16])
@pytest.mark.parametrize("size", [1, 2, 5])
def test_blocks_change_nothing(monkeypatch, block, size):
    monkeypatch.setattr(minima, "BLOCK", block)
    values = np.random.default_rng(1).integers(0, 6, 50).astype(np.uint32)
    want = sorted({max(range(i, i + size), key=lambda p: (-int(values[p]), p)) for i in range(50 - size + 1)})
    assert window_minima(values, size).tolist() == want


def test_short_input():
    assert window_minima(np.array([1, 2], dtype=np.uint32), 3).tolist() == []
