"""Plans of packing against best-fit decreasing and the volume bound."""

import collections
import random

import pytest

from helicase.llm import packing


def decreasing(counts, size):
    rooms = []
    for x in sorted(counts.elements(), reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= x]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(size - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_never_more_sequences_than_best_fit_decreasing(seed):
    r = random.Random(seed)
    draw = [lambda: r.randint(1, 1024), lambda: int(r.expovariate(1 / 200)) % 1024 + 1, lambda: r.randint(300, 520)]
    counts = collections.Counter(r.choice(draw)() for _ in range(r.choice([0, 1, 20, 100, 400, 1500])))
    groups = packing.plan(counts, 1024)
    placed = collections.Counter()
    for own, n in groups:
        assert n > 0 and sum(own) <= 1024
        for x in own:
            placed[x] += n
    assert placed == counts
    used = sum(n for _, n in groups)
    assert -(-sum(counts.elements()) // 1024) <= used <= decreasing(counts, 1024)


def test_complements_fill_gaps_that_best_fit_leaves():
    """Three pieces that fill a sequence exactly, and pairs that best-fit makes first."""
    counts = collections.Counter({500: 4, 400: 2, 324: 2, 300: 4, 224: 4, 200: 2, 124: 2, 100: 4})
    assert sum(n for _, n in packing.plan(counts, 1024)) <= decreasing(counts, 1024)
    assert [n for _, n in packing.plan({512: 7}, 1024)] == [3, 1]
