"""Budgets against brute force, and rows of the mix that repeat id and text."""

from collections import Counter

import numpy as np
import pytest

from voxelarium.llm import mixing


def best_sum(size, n, budget):
    reached = {0}
    for w, many in zip(size.tolist(), n.tolist()):
        reached = {r + k * w for r in reached for k in range(many + 1) if r + k * w <= budget}
    return max(reached)


def random_cases(count, seed):
    rng = np.random.default_rng(seed)
    for _ in range(count):
        size = np.unique(rng.integers(1, rng.choice([6, 60, 400]), rng.integers(1, 8)))
        n = rng.integers(1, 5, len(size))
        yield size, n, int(rng.integers(0, (size * n).sum() + 2))


def test_the_best_sum_is_reached():
    for size, n, budget in [(np.array([2, 54]), np.array([3, 1]), 55), (np.array([100_000, 140_000]), np.array([1, 1]), 150_000), *random_cases(2000, 3)]:
        take = mixing.fit_budget(size, n, budget)
        assert (take >= 0).all() and (take <= n).all()
        assert int((take * size).sum()) == best_sum(size, n, budget)


def best_by_bits(size, n, budget):
    reach, width = 1, (1 << (budget + 1)) - 1
    for w, many in zip(size.tolist(), n.tolist()):
        part = 1
        while many > 0:
            part = min(part, many)
            reach |= (reach << part * w) & width
            many, part = many - part, part * 2
    return reach.bit_length() - 1


def test_budgets_beyond_the_span(monkeypatch):
    """The best sum, also where the budget lies far beyond what one programme decides."""
    monkeypatch.setattr(mixing, "KNAPSACK_WORDS", 1)
    rng, beyond = np.random.default_rng(4), 0
    for _ in range(1500):
        size = np.unique(rng.integers(1, 40, rng.integers(2, 8)))
        n = rng.integers(5, 60, len(size))
        budget = int(rng.integers(0, (size * n).sum() + 2))
        take = mixing.fit_budget(size, n, budget)
        got, best = int((take * size).sum()), best_by_bits(size, n, budget)
        assert (take >= 0).all() and (take <= n).all() and got == best
        beyond += budget > mixing.SPAN * size.max()
    assert beyond > 500


def test_few_large_sizes():
    """Two to four sizes of thousands of words, most of them taken."""
    rng = np.random.default_rng(6)
    cases = [(np.array([31_200, 31_674]), np.array([57, 65]), 2_033_712)]
    for _ in range(60):
        size = np.unique(rng.integers(2000, 9000, rng.integers(2, 5)))
        n = rng.integers(5, 80, len(size))
        cases.append((size, n, int(rng.integers(0, (size * n).sum() + 1))))
    for size, n, budget in cases:
        take = mixing.fit_budget(size, n, budget)
        assert (take >= 0).all() and (take <= n).all() and int((take * size).sum()) == best_by_bits(size, n, budget)


def test_sizes_with_a_common_factor_and_huge_counts():
    take = mixing.fit_budget(np.array([4, 6]), np.array([10**9, 10**9]), 7 * 10**9 + 1)
    assert int((take * np.array([4, 6])).sum()) == 7 * 10**9


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_that_repeat_id_and_text_keep_their_sources(spark, parts):
    rows = [(1, "a b c", "x", "p"), (1, "a b c", "y", "q"), (1, "a b c", "y", "r"), (2, "d " * 9, "z", "p"), (3, None, None, "p"), (4, "e " * 30, "x", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(parts)
    mixed = Counter(map(tuple, mixing.repeat_documents(df).collect()))
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[(r.doc_id, r.source)] += r.copies
    by_source = Counter()
    for (i, _, s, _), k in mixed.items():
        by_source[(i, s)] += k
    assert by_source == +taken
    assert mixed == Counter(map(tuple, mixing.repeat_documents(df.repartition(3)).collect()))


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(s,) for s in ["b", None, "a", "ü", "", "B"]], "source string").repartition(4)
    got = {r.source: r.n for r in mixing.numbered(rows, "n", rows.source.isNull(), rows.source).collect()}
    assert got == {"": 1, "B": 2, "a": 3, "b": 4, "ü": 5, None: 6}
