"""The longest verbatim match of decontamination against brute force, and repetitive texts."""

import random
import time

from tastemark.llm import decontam


def brute(doc, items):
    best, where = 0, -1
    for p in range(len(doc)):
        for item in items:
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n]:
                    n += 1
                if n > best:
                    best, where = n, p
    return best, where


def test_longest_match_of_any_length():
    rng = random.Random(3)
    for few in (2, 4, 40):
        word = lambda: b"w%d" % rng.randrange(few)  # noqa: E731, B023
        items = [[word() for _ in range(rng.randrange(0, 30))] for _ in range(12)]
        docs = [[b"other" if rng.random() < 0.1 else word() for _ in range(rng.randrange(0, 60))] for _ in range(40)]
        docs += [items[3] + [b"other"], [b"other", *items[4][2:]], items[5] * 3, []]
        block = decontam.TestBlock([(str(i), ws) for i, ws in enumerate(items) if ws], 10)
        _, _, longest, where = decontam._search(block, docs)
        assert list(zip(longest, where, strict=True)) == [brute(d, items) for d in docs]


def test_repetitive_texts_take_time_in_proportion():
    item = [b"a", b"b"] * 10_000
    block = decontam.TestBlock([("x", item)], 10)
    start = time.perf_counter()
    spans, items, longest, _ = decontam._search(block, [[b"a", b"b"] * 40_000, [b"b", b"a"] * 20])
    assert time.perf_counter() - start < 5
    assert spans == [[0, 80_000], [0, 40]] and items == [{0}, {0}] and longest == [20_000, 40]
