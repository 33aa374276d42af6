"""A block of benchmark items by itself, without Spark."""

import pickle
import random
import time

import numpy as np
import pytest

from strandlake.llm import decontaminate
from strandlake.llm.decontaminate import Block


def found(block, text):
    ((_, _, ids),) = decontaminate._numbered(block, [text])
    start, end, window = block.find(ids)
    mask = np.zeros(len(ids) - 1, bool)
    for s, e in zip(start.tolist(), end.tolist()):
        mask[s:e] = True
    return mask.tolist(), {block.names[o] for w in window.tolist() for o in block.owner[block.owners[w] : block.owners[w + 1]].tolist()}


@pytest.mark.parametrize("base", [None, (1 << 40) + 1, (1 << 62) + 1])
def test_shingle_numbers_may_wrap(base):
    item = [f"w{i}" for i in range(12)]
    plain = decontaminate.Block.codes
    if base:
        decontaminate.Block.codes = lambda self, ids, size: (setattr(self, "base", base), plain(self, ids, size))[1]
    try:
        block = Block([("a", " ".join(item)), ("b", "some other words"), ("c", "")])
        block.choose({size: np.zeros(len(c), np.int64) for size, c in block.shingles.items()})
        mask, names = found(block, " ".join(["x", *item[1:11], "y", "some", "other"]))
        assert mask == [False] + [True] * 10 + [False] * 3 and names == {"a"}
        assert found(block, "some other words") == ([True] * 3, {"b"}) and found(block, "") == ([], set())
    finally:
        decontaminate.Block.codes = plain


def test_a_block_is_small_and_quick():
    random.seed(1)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 9))) for _ in range(30_000)]
    items = [(f"i{k}", " ".join(random.choices(words, k=100))) for k in range(6_000)]
    size, began = sum(len(t) for _, t in items), time.time()
    block = Block(items)
    block.choose({s: np.zeros(len(c), np.int64) for s, c in block.shingles.items()})
    assert time.time() - began < 60 and len(pickle.dumps(block)) < 10 * size
    assert found(block, items[7][1]) == ([True] * 100, {"i7"})
    assert len(Block([]).at) == 0
