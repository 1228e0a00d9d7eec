"""Bins that split while they are crowded: against a plain loop, and in few rounds."""

from collections import Counter

import numpy as np
import pytest

from orbitalis.functions import keys
from orbitalis.operators import partition


def plain(all_keys, most, budget, digit=1, depth=63):
    """One level after another over a list of keys."""
    done, active = [], [(0, 0, len(all_keys))]
    for level in range(depth):
        heavy = sorted((b for b in active if b[2] > most), key=lambda b: (-b[2], b[1]))
        split = {b[1] for b in heavy[: max(0, budget - len(done) - len(active)) // ((1 << digit) - 1)]}
        done += [b for b in active if b[1] not in split]
        counts = Counter(k >> (63 - digit * (level + 1)) for k in all_keys if k >> (63 - digit * level) in split)
        active = [(level + 1, p, n) for p, n in counts.items()]
    return sorted(done + active)


@pytest.mark.parametrize(("budget", "digit"), [(1 << 20, 1), (40, 1), (300, 3)])
def test_rounds_of_levels_give_the_same_bins(spark, monkeypatch, budget, digit):
    r = np.random.default_rng(2)
    some = [*r.integers(0, 1 << 63, 1500).tolist(), *(7 + r.integers(0, 40, 60)).tolist(), *[5 << 40] * 9]
    table = spark.createDataFrame([(k,) for k in some], "key long")
    whole, calls = keys.prefix_at, []
    monkeypatch.setattr(keys, "prefix_at", lambda *a: calls.append(a) or whole(*a))
    got = partition.refine_bins(table.where("key > 1000000"), 4, budget, digit, 63 // digit)
    assert len(calls) <= 24
    assert got == plain([k for k in some if k > 1000000], 4, budget, digit, 63 // digit)
    if digit == 1 and budget > 40:  # a crowd at neighbouring keys, far down
        assert partition.refine_bins(table.where("key < 1000000"), 4, budget) == plain([k for k in some if k < 1000000], 4, budget)
