import random

import pytest

from symloom.llm.handwritten import uniformity
from tests.llm.test_handwritten import found

UNIT = "  var a{i}: Int\n  let b{i} = 0\n  static let c{i}: String\n  func d{i}() throws\n  case e{i}(Int, Int)\n  init(x{i}: Int)\n  lazy var g{i} = [1]\n  weak var h{i}: T{i}?\n  @objc func k{i}(x: Int) -> Int\n"


def by_hand(shapes):
    n = len(shapes)
    return max((sum(a == b for a, b in zip(shapes, shapes[p:], strict=False)) / (n - p) for p in range(1, n // 3 + 1)), default=0.0)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 100, 400, 401, 1500])
def test_uniformity_against_brute_force(n):
    r = random.Random(n)
    for kinds in (1, 2, 5, 60, 1000):
        shapes = [str(r.randrange(kinds)) for _ in range(n)]
        assert uniformity(shapes) == by_hand(shapes)
    repeated = [str(i % 37) if r.random() > 0.05 else "x" for i in range(n)]
    assert uniformity(repeated) == by_hand(repeated)


def test_long_units_are_generated(rows):
    text = "class Mock {\n" + "".join(UNIT.replace("{i}", str(i)) for i in range(50)) + "}\n"
    assert found(rows, [("/ws/app/Sources/Mock.swift", text)]) == {"/ws/app/Sources/Mock.swift": "generated"}


def test_very_many_statements():
    r = random.Random(1)
    shapes = [str(min(int(r.expovariate(0.001)), 50_000)) for _ in range(100_000)]
    assert 0 < uniformity(shapes) < 0.1
    assert uniformity([str(i % 20_000) for i in range(100_000)]) == 1.0
