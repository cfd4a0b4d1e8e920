"""Packing against a search through all sequences."""

import random

import numpy as np
import pytest

from eventloom.llm import packing


def plain(lengths, size, linear, quadratic):
    """Each remainder's sequence by a look at all of them; None for those that fit nowhere."""
    rest = sorted(((n % size, d) for d, n in enumerate(lengths) if n % size), key=lambda x: (-(linear * x[0] + quadratic * x[0] ** 2), x[1]))
    return rest, -(-sum(n for n, _ in rest) // size), sum(n // size for n in lengths)


@pytest.mark.parametrize(("size", "many", "seed"), [(8, 40, 1), (16, 300, 2), (100, 500, 3), (2048, 1500, 4)])
def test_the_cheapest_sequence_with_room(size, many, seed):
    r = random.Random(seed)
    short = max(size // 30, 2)
    lengths = [r.randint(1, short) if r.random() < 0.7 else r.randint(size * 3 // 10, size * 7 // 10) for _ in range(many)] + [3 * size, 2 * size + 1]
    pieces = packing.assign(np.array(lengths), size, 1.0, 1 / size)
    rest, count, full = plain(lengths, size, 1.0, 1 / size)
    by = {}
    for d, s, n, q, at in pieces:
        if s >= lengths[d] // size * size:
            by.setdefault(d, []).append((q - full, n, at))
    fill, cost = [0] * count, [0.0] * count
    for n, d in rest:
        open_ = [i for i in range(count) if fill[i] + n <= size]
        if open_:
            assert by[d] == [(min(open_, key=lambda i: (cost[i], i)), n, fill[min(open_, key=lambda i: (cost[i], i))])]
        else:
            assert len(by[d]) > 1
        for i, m, at in by[d]:
            assert at == fill[i] and (open_ or fill[i] == min(f for f in fill if f < size) or i in [x for x, _, _ in by[d]])
            fill[i] += m
            cost[i] += 1.0 * m + 1 / size * m * m


def test_no_cut_with_room_beyond_64_sequences():
    r = random.Random(5)
    lengths = np.array([r.randint(2, 60) if r.random() < 0.7 else r.randint(600, 1400) for _ in range(4000)])
    pieces = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    assert len(pieces) == len(lengths)
