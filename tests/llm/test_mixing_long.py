"""Budgets of very long documents."""

from itertools import product

import numpy as np

from voxelarium.llm import mixing


def test_very_long_documents_meet_the_budget():
    take = mixing.fit_budget(np.array([70_000, 71_000, 72_000]), np.array([1, 1, 1]), 100_000)
    assert take.tolist() == [0, 0, 1]
    rng = np.random.default_rng(7)
    for _ in range(300):
        size = np.unique(rng.integers(33_000, 400_000, rng.integers(1, 6)))
        n = rng.integers(1, 4, len(size))
        budget = int(rng.integers(0, (size * n).sum() + 1))
        take = mixing.fit_budget(size, n, budget)
        rest = budget - int((take * size).sum())
        assert (take >= 0).all() and (take <= n).all() and rest >= 0
        # nothing that is left could be added
        more = [int((np.array(x) * size).sum()) for x in product(*[range(int(k) + 1) for k in n - take])]
        assert not any(0 < x <= rest for x in more)
