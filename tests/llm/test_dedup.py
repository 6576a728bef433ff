"""SimHash, line and substring dedup against brute force, on hard cases and small tables."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxelarium.llm import graph, linededup, simhash, substring

SCHEMA = "doc_id long, text string, component_id string, fp string, line string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(values))]


def test_fingerprint_equals_its_definition():
    rng = random.Random(1)
    for text in [None, "", " \n\t", "One", "one two three", "É Ünï A-Z b c d", "a\x0bb\x1cc d e", *(" ".join(rng.choices("abcdefgh", k=n)) for n in (4, 5, 50, 3000))]:
        assert simhash.fingerprint(text.encode() if text is not None else None) & (2**64 - 1) == plain_fingerprint(text)


def test_long_text_is_read_in_pieces(monkeypatch):
    text = " ".join(str(n) for n in range(5000))
    monkeypatch.setattr(simhash, "_PIECE", 97)
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == plain_fingerprint(text)


@pytest.mark.parametrize("distance,chunk", [(4, 4096), (4, 3), (1, 4096), (3, 4096), (6, 10)])
def test_links_join_what_brute_force_joins(spark, distance, chunk):
    """Chains, dense groups and far values; the small chunk deals every crowded key to many cells."""
    rng = random.Random(2)
    values = {0, 1, 0xF, 0x1F, 2**64 - 1}
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(25):
            values.add(v)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.u: r.v for r in graph.components(simhash.links(table, distance, chunk)).collect()}
    got = [roots.get(v, v) for v in signed]
    want = brute_components(values, distance)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_near_duplicates_on_hard_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark green wood"
    rows = [(5, base), (3, base), (9, base.upper()), (None, base), (7, None), (8, ""), (7, None), (11, "else entirely different words stand here")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by == {5: {3}, 3: {3}, 9: {3}, None: {3}, 7: {7}, 8: {7}, 11: {11}}
    kept = simhash.keep_one_of_each(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 11] and kept.columns == ["doc_id", "text", "component_id", "fp", "line"]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def brute_lines(docs, window, long_words):
    """Line numbers to remove by the definition, documents in order of id."""
    lines = {d: [(k, tuple(w)) for k, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", x) for x in (t or "").split("\n")) if w] for d, t in docs}
    seen, gone = set(), {d: set() for d in lines}
    for d in sorted(lines):
        for i in range(len(lines[d])):
            if len(lines[d][i][1]) >= long_words:
                key = lines[d][i][1]
                if key in seen:
                    gone[d].add(lines[d][i][0])
                seen.add(key)
            some = lines[d][i : i + window]
            if len(some) == window:
                key = ("w", *(w for _, w in some))
                if key in seen:
                    gone[d] |= {k for k, _ in some}
                seen.add(key)
    return gone


@pytest.mark.parametrize("window,seed", [(2, 1), (3, 2), (4, 3)])
def test_line_dedup_against_brute_force(spark, window, seed):
    """Few different lines, so the earliest place of a fingerprint is often not the one that matches furthest."""
    rng = random.Random(seed)
    docs = [(d, "\n".join(rng.choice(["a b", "c", "d  e", "", "f g h", "i", "j k l m n o p q r s"]) for _ in range(rng.randint(0, 14)))) for d in range(60)]
    got = linededup.line_dedup(frame(spark, docs), window, long_words=10)
    want = brute_lines(docs, window, 10)
    for r in got.collect():
        assert set(r.removed_lines) == want[r.doc_id]
        assert r.clean_text == "\n".join(x for k, x in enumerate(dict(docs)[r.doc_id].split("\n")) if k not in want[r.doc_id])
    assert got.columns[:5] == ["doc_id", "text", "component_id", "fp", "line"]


def test_line_dedup_on_hard_rows(spark):
    run = "one two\nthree four\nfive six"
    rows = [(1, run), (1, run), (2, "x\n" + run + "\ny"), (None, run), (3, None), (4, ""), (5, "\n\n")]
    got = {(r.doc_id, r.text): (r.n_removed, r.clean_text) for r in linededup.line_dedup(frame(spark, rows)).collect()}
    assert got == {(1, run): (0, run), (2, "x\n" + run + "\ny"): (3, "x\ny"), (None, run): (3, ""), (3, None): (0, None), (4, ""): (0, ""), (5, "\n\n"): (0, "\n\n")}
    assert linededup.line_dedup(frame(spark, [])).count() == 0


def test_substring_dedup(spark):
    passage = "This passage has a number of words. It is told again and again everywhere! Nobody knows why that is so."
    rows = [(1, "Some first words of text stand here. " + passage), (2, f"Other words lead into it {passage} and some trail behind"), (3, "All of this text is its own and stands alone."), (4, None), (None, passage), (1, "Some first words of text stand here. " + passage)]
    spans = substring.repeated_spans(frame(spark, rows)).collect()
    assert {r.doc_id for r in spans} == {2, None} and all(r.first_doc_id == 1 for r in spans)
    for r in spans:
        text = {2: rows[1][1], None: passage}[r.doc_id]
        first = rows[0][1]
        piece = text[r.start : r.end]
        assert first[r.first_start :].strip().lower().startswith(piece.strip().lower())
    clean = {r.doc_id: r.clean_text for r in substring.substring_dedup(frame(spark, rows)).collect()}
    assert clean[3] == rows[2][1] and clean[4] is None and "Nobody" not in clean[None] and clean[2].startswith("Other words") and "again everywhere" not in clean[2]
    assert substring.repeated_spans(frame(spark, [])).count() == 0


def test_runs_of_repeated_units(spark):
    """Against brute force; shared sentences alone stay, runs of them with enough words go."""
    rng = random.Random(5)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) + "." for _ in range(12)]
    docs = [(d, rng.choice([" ", "\n"]).join(rng.choice([*pool, f"own{d} words{rng.random()}."]) for _ in range(rng.randint(0, 9)))) for d in range(50)]
    docs += [(60, None), (61, ""), (62, pool[0] + " " + "x " * 20_000 + "end. " + " ".join(pool)), (63, "y. " * 3000)]
    seen, want = {}, set()
    for d, text in docs:
        run = []
        for at, end, words, digest in substring.units(text, 1):
            if digest in seen:
                run.append((at, end, words, *seen[digest]))
                continue
            seen[digest] = (d, at)
            want |= {(d, a, e, *first) for a, e, _, *first in run} if sum(r[2] for r in run) >= 12 else set()
            run = []
        want |= {(d, a, e, *first) for a, e, _, *first in run} if sum(r[2] for r in run) >= 12 else set()
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in docs + docs[:5]], "doc_id long, text string, clean_text string, removed_spans array<int>").repartition(3)
    got = substring.repeated_spans(df, min_words=1, run_words=12).collect()
    assert len(got) == len(want) and {(r.doc_id, r.start, r.end, r.first_doc_id, r.first_start) for r in got} == want
    clean = substring.substring_dedup(df, min_words=1, run_words=12)
    assert clean.columns == ["doc_id", "text", "removed_spans", "clean_text"] and clean.count() == len(docs) + 5


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = graph.components(edges).collect()
    assert len(got) == 299 and {r.v for r in got} == {0}
    assert np.array_equal(sorted(r.u for r in got), np.arange(1, 300))
