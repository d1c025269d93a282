import random
import time

import numpy as np
from polyrank.llm import gsaca
from polyrank.llm.gsaca import suffix_arrays


def check(texts):
    joined, starts = [9], []
    for t in texts:
        starts.append(len(joined))
        joined += [*t, 0]
    got = suffix_arrays(np.array(joined), np.array(starts, np.int64))
    for s, t in zip(starts, texts, strict=True):
        whole = [*t, 0]
        want = sorted(range(len(whole)), key=lambda i: whole[i:])
        assert [x - s for x in got[s : s + len(whole)].tolist()] == want, t


def test_known_words():
    check([[1, 1, 1, 1], [], [2], [2, 1, 3, 1, 3, 1], list(b"mississippi"), list(b"graindraining"), list(b"abracadabra" * 4)])


def test_random_texts_together():
    rng = random.Random(4)
    for letters in (1, 2, 3, 10, 200):
        check([[rng.randrange(1, letters + 1) for _ in range(rng.randrange(60))] for _ in range(120)])


def test_long_periods():
    check([[1, 2] * 150, [2, 1] * 150 + [1], [1] * 200 + [2] + [1] * 200, [3, 1, 2] * 90 + [1]])


def test_long_texts_one_by_one(monkeypatch):
    rng = random.Random(8)
    check([[rng.randrange(1, 4) for _ in range(n)] for n in (5000, 20, 30, 6000, *[50] * 40)])
    monkeypatch.setattr(gsaca, "LONG", 3)
    monkeypatch.setattr(gsaca, "FEW", 2)
    for letters in (1, 2, 3, 10, 200):
        check([[rng.randrange(1, letters + 1) for _ in range(rng.randrange(60))] for _ in range(120)])
    check([[1, 2] * 150, [2, 1] * 150 + [1], [1] * 200 + [2] + [1] * 200, [3, 1, 2] * 90 + [1], list(b"mississippi")])


def test_a_million_periodic_symbols_take_seconds():
    for period in ([2], [2, 3]):
        n = 1_000_000
        text = np.array([1, *(period * (n // len(period))), 0])
        began = time.perf_counter()
        got = suffix_arrays(text, np.array([1]))
        assert time.perf_counter() - began < 30
        # ascending: the end, then shorter suffixes first, those that start with the smaller symbol before the others
        want = [n, *(i for k in range(len(period)) for i in range(n - len(period) + k, -1, -len(period)))]
        assert (got[1:] - 1).tolist() == want


def test_periodic_texts_together_take_steps_in_proportion():
    texts = [[2] * 2000] * 50
    joined, starts = [9], []
    for t in texts:
        starts.append(len(joined))
        joined += [*t, 0]
    got = suffix_arrays(np.array(joined), np.array(starts))
    assert all((got[s : s + 2001] - s).tolist() == [2000, *range(1999, -1, -1)] for s in starts)
