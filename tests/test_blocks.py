"""Matching blocks in batches are those of the definition, pair by pair."""

import random
from difflib import SequenceMatcher

import pytest

from recordloom.functions import blocks


def pairs(seed, n, letters, longest):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(longest)))
    out = [(word(), word()) for _ in range(n)]
    for a, _ in out[: n // 2]:
        b = list(a)
        for _ in range(rnd.randrange(4)):
            if b:
                b[rnd.randrange(len(b))] = rnd.choice(letters)
        out.append((a, "".join(b[rnd.randrange(3) :]) + word()[:3]))
    return [*out, ("", ""), ("a", ""), ("", "b"), ("ab", "ab")]


@pytest.mark.parametrize(("letters", "longest", "n"), [("ab", 12, 600), ("abcé 𝄞", 40, 400), ("abcdefgh ", 90, 150), ("ab c", 330, 60), ("abcdefghijklmnopqrstuvwxyz ", 900, 20)])
@pytest.mark.parametrize("popular", [False, True])
def test_ratios_equal_the_definition(letters, longest, n, popular):
    found = pairs(longest + n, n, letters, longest)
    want = [SequenceMatcher(None, a, b, autojunk=popular).ratio() for a, b in found]
    assert blocks.ratios(*map(list, zip(*found, strict=True)), popular=popular).tolist() == want


def test_tables_of_few_cells_give_the_same(monkeypatch):
    found = pairs(5, 200, "abc", 30)
    want = blocks.ratios(*map(list, zip(*found, strict=True))).tolist()
    monkeypatch.setattr(blocks, "CELLS", 40)
    assert blocks.ratios(*map(list, zip(*found, strict=True))).tolist() == want
    assert blocks.ratios([], []).tolist() == []
