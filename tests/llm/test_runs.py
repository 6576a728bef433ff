"""Periodic runs against a search of every period."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelarium.llm import runs


def brute(x, min_length, exponent):
    out, n = {}, len(x)
    for q in range(1, n):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


blocks = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=5)


@settings(max_examples=400, deadline=None)
@given(blocks, st.sampled_from([(6, 4), (2, 2), (3, 3), (1, 5)]), st.booleans())
def test_all_runs(parts, bounds, twice):
    x = [w for block, times in parts for w in block * times]
    x = x + [7] + x if twice else x
    found = runs.maximal_runs(np.array(x, np.int64), *bounds)
    assert found == brute(x, *bounds)
    if x:
        assert sorted((s, s + n, q) for s, n, q in runs._runs_of_texts([np.array(x)], *bounds)[0]) == found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_previous_factors_and_blocks(x):
    length, source = runs.previous_factors(runs.Ranks(np.array(x, np.int64)))
    for i, n in enumerate(length.tolist()):
        def common(j):
            k = 0
            while i + k < len(x) and x[i + k] == x[j + k]:
                k += 1
            return k

        assert n == max((common(j) for j in range(i)), default=0)
        assert not n or (source[i] < i and common(source[i]) >= n)
    starts = runs.parse(length)
    assert starts[-1] == len(x) and all(b - a == max(1, length[a]) for a, b in zip(starts, starts[1:]))


def test_pointers_that_jump_often(monkeypatch):
    rng = np.random.default_rng(0)
    values = [rng.permutation(300), np.arange(300), np.append(np.arange(1, 300), 0), np.arange(300)[::-1]]
    for v in values:
        gaps = rng.integers(0, 50, 300)
        every = [runs._nearest_smaller(v, gaps)]
        monkeypatch.setattr(runs, "JUMPS", 1)
        every.append(runs._nearest_smaller(v, gaps))
        monkeypatch.undo()
        for at, least in every:
            for r in range(300):
                p = next((k for k in range(r - 1, -1, -1) if v[k] < v[r]), -1)
                assert at[r] == p and least[r] == (0 if p < 0 else gaps[p + 1 : r + 1].min())


def expected(text):
    words = (text or "").encode().split()
    numbers = [words.index(w) for w in words]
    found = sorted(brute(numbers, 6, 4), key=lambda r: (r[0], r[2]))
    gone = {i for s, e, q in found for i in range(s + q, e)}
    return [(s, e - s, q) for s, e, q in found], b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_rows(spark, monkeypatch):
    """Null, empty, blank and repeated rows, ties, other kinds of space, and clashing columns."""
    texts = [None, "", " \t\n\x0b\x0c\r ", "a " * 6, "a " * 5, "x y " * 7 + "z", "a b c " * 4 + "d " + "a b c " * 4, "a b c " * 4, "a b c " * 4, "é\x85é " * 6]
    rows = [(i if i != 3 else None, t, "r", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    out = runs.periodic_runs(docs).collect()
    assert len(out) == len(texts)
    by_id = {r.doc_id: r for r in out}
    for i, text, *_ in rows:
        found, joined = expected(text)
        r = by_id[i]
        assert [tuple(x) for x in r.runs] == found and r.n_words == len((text or "").encode().split())
        assert r.collapsed_sha256 == hashlib.sha256(joined).hexdigest() and (r.collapsed == joined.decode() if found else r.collapsed is None)
    assert runs.periodic_runs(docs.where("false")).count() == 0


@pytest.mark.parametrize("group", [1, 1 << 17])
def test_very_long_text(spark, monkeypatch, group):
    monkeypatch.setattr(runs, "GROUP_WORDS", group)
    rng = np.random.default_rng(1)
    plain = [f"w{k}" for k in rng.integers(0, 3000, 60_000)]
    block = [f"b{k}" for k in rng.integers(0, 40, 5000)]
    block[100:130] = ["h"] * 30
    words = plain + block * 5 + plain[:10]
    (found,) = runs._runs_of_texts([runs.numbers_of([w.encode() for w in words])], 6, 4)
    assert (60_000, 25_000, 5000) in found
    assert [r for r in found if r[2] == 1 and r[1] == 30] == [(60_100 + 5000 * k, 30, 1) for k in range(5)]


def test_query(spark, sf_dir):
    """The contract's repeats are put in, and each row agrees with the search of every period (short texts)."""
    import zlib

    from voxelarium.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = 0
    for r in queries.op12_periodic_runs(spark, sf_dir).collect():
        words = (texts[r.doc_id] or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 400:
            continue
        found, joined = expected(b" ".join(words).decode())
        seen += bool(found)
        assert r.n_runs == len(found) and r.collapsed_sha256 == hashlib.sha256(joined).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert seen > 5
