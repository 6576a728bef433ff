"""Quality rules, BPE, packing, mixing, toxicity and the pipeline."""

import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from voxelarium.llm import bpe, mixing, oracle, packing, quality, queries, toxicity

SCHEMA = "doc_id long, text string, source string, n_words string, copies string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], SCHEMA)


HARD = [
    (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "Word " * 30 + ".", "b"), (5, "menu | home | about | contact\nAn actual sentence stands in this line, and it is long enough to count for something here.", "b"),
    (6, "Good text has sentences. They differ from one another in what they say, mostly at least, and they end well. Some are short. Others go on.", None),
    (6, "Good text has sentences. They differ from one another in what they say, mostly at least, and they end well. Some are short. Others go on.", None),
    (None, "é ü 漢字 \U0001F600 #*$%\x0b\x1c end.", "ü"), (8, "x" * 3000 + " " + "long tail " * 400, "a"),
]


def repeat_words(words):
    n, hit = len(words), set()
    places = {}
    for i in range(n - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in places.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(8)}
    return len(hit)


def test_quality_counts(spark):
    got = quality.quality_rules(frame(spark, HARD)).collect()
    assert len(got) == len(HARD)
    for r in got:
        text = r.text or ""
        words = text.encode().split()
        assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>") and r.n_repeat_words == repeat_words(words)
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words)) and not (r.base_failed and r.kept)
    assert {r.doc_id for r in got if r.kept} == {5, 6}
    assert [r for r in got if r.doc_id == 5][0].clean_text.startswith("An actual")
    assert quality.quality_rules(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), c.sql(oracle.ORACLE_SQL[name]).df()
    key = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(want)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "ab \n\t\x1c\x1f\x85\xa0 é'’s12٣!?.<|endoftext|>\U0001F600́ \r"
    return ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(n)]


def test_bpe_equals_tiktoken(encoder):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    for text in [*odd_texts(1500), "ab" * 20000, "a" * 5000, "".join(map(chr, range(32, 3000)))]:
        ids = encoder.encode(text).tolist()
        assert ids == other.encode_ordinary(text) and encoder.decode(ids) == text.encode()
    assert encoder.encode(None).tolist() == []


def test_bpe_forgets_and_still_agrees(encoder):
    small = bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, cache=3)
    for text in odd_texts(200, seed=5):
        assert small.encode(text).tolist() == encoder.encode(text).tolist()


def test_bpe_rows(spark, encoder):
    got = bpe.digests(frame(spark, HARD), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = []
    for i, t, _ in HARD:
        ids = encoder.encode(t).tolist()
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 20, 31, 32])
def test_pack_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5, 100, 64, 63, 1000)]
    file = io.BytesIO()
    close, file.close = file.close, lambda: None
    writer = packing.Writer(file, bits, block=64)
    for n, d in enumerate(docs):
        writer.add(n - 1 if n else None, d)
    writer.close()
    reader = packing.Reader(pa.BufferReader(file.getvalue()))
    whole = np.concatenate(docs)
    assert all(np.array_equal(reader.document(k), d) for k, d in enumerate(docs))
    for a, n in ((0, 1), (60, 10), (63, 1), (64, 64), (500, 700), (len(whole), 0)):
        assert np.array_equal(reader.tokens(a, n), whole[a : a + n])
    assert reader.nulls.tolist() == [1, 0, 0, 0, 0, 0, 0] and reader.doc_ids[1:].tolist() == list(range(6))
    with pytest.raises(ValueError):
        packing.Reader(pa.BufferReader(file.getvalue()[:-1]))
    close()


def test_fewest_bits():
    assert [packing.width_of(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack_documents(spark, frame(spark, HARD), P.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(HARD) and sorted(r.start for r in got)[0] == 0
    want = sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in (tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _ in HARD))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start + r.n_tokens for r in ordered][:-1] == [r.start for r in ordered][1:]
    assert [r.doc_id for r in ordered] == [None, 1, 2, 3, 4, 5, 6, 6, 8]
    assert packing.pack_documents(spark, frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def water_fill(sizes):
    """Targets by sharing again and again, as the contract words it."""
    total, weights = sum(sizes), [k % 3 + 1 for k in range(len(sizes))]
    capped, target = set(), [0.0] * len(sizes)
    while True:
        rest = total - sum(3 * sizes[k] for k in capped)
        w = sum(weights[k] for k in range(len(sizes)) if k not in capped)
        target = [3 * sizes[k] if k in capped else rest * weights[k] / w for k in range(len(sizes))]
        over = {k for k in range(len(sizes)) if k not in capped and target[k] > 3 * sizes[k]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [[5, 1, 1, 100, 1], [1, 1, 1], [0, 0], [7], [100, 1, 2, 3, 4, 5, 6, 1000]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(rows).orderBy("source").collect()]
    assert np.allclose(got, water_fill(sizes))


def test_budget_is_met_where_it_can_be():
    rng = np.random.default_rng(0)
    for _ in range(40):
        size = np.unique(rng.integers(1, 60, rng.integers(1, 8)))
        n = rng.integers(1, 5, len(size))
        budget = int(rng.integers(0, (size * n).sum() + 1))
        take = mixing.fit_budget(size, n, budget)
        got = int((take * size).sum())
        assert (take >= 0).all() and (take <= n).all() and got <= budget and budget - got < size.max()
    many = mixing.fit_budget(np.arange(1, 2000), np.full(1999, 50), 30_000_001)
    assert int((many * np.arange(1, 2000)).sum()) == 30_000_001


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["a", "b", "c", None])) for i in range(600)] + HARD
    once, twice = (sorted(map(repr, mixing.mix(frame(spark, rows).repartition(n)).collect())) for n in (1, 7))
    assert once == twice
    got = mixing.mix(frame(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(2, g["size"].max())
    mixed = mixing.repeat_documents(frame(spark, rows))
    assert mixed.count() == got.copies.sum() and mixed.columns == ["doc_id", "text", "source", "n_words", "copies", "bucket"]
    assert mixing.mix(frame(spark, [])).count() == 0


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(2)
    model = toxicity.Field(start=0.3, moves=rng.normal(size=(2, 2)))
    rows = [rng.normal(size=n) for n in (4, 1, 6, 0)]
    for s, p in zip(rows, toxicity.marginals(rows, model)):
        weight, total = np.zeros(len(s)), 0.0
        for path in np.ndindex(*[2] * len(s)):
            x = sum(v for v, y in zip(s, path) if y) + (0.3 * path[0] if path else 0) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(x)
            weight += np.exp(x) * np.array(path)
        assert np.allclose(p, weight / total)


def test_toxicity_learns_words_and_spans(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words, bad = [rng.choice(plain) for _ in range(rng.randint(5, 40))], i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Vilegrub,", "vilegrub", "snarkel!"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(bad)))
    labels += [(None, 1), (9999, 0), (1, None)]
    documents, told = frame(spark, [*rows, *HARD[:3], (None, "snarkel", "a")]), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(documents, told)
    got = toxicity.score(documents, model).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    for r in got[:400]:
        assert (r.score >= 0.5) == (r.doc_id % 4 == 0)
        for s in r.spans:
            assert toxicity.bare(rows[r.doc_id][1][s.start : s.end]) in ("vilegrub", "snarkel")
    assert toxicity.score(frame(spark, []), model).count() == 0
    untaught = toxicity.learn(documents, told.where("doc_id < 0"))
    assert len({r.score for r in toxicity.score(documents, untaught).collect()}) == 1


def test_held_out_rows_teach_nothing(spark):
    out = spark.range(50).select(F.col("id"), toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in out)


def test_pipeline_stages_follow_from_their_input(spark, sf_dir):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.toPandas()
    for name, stage in C.STAGES:
        after = stage(spark, docs, sf_dir).toPandas()
        assert len(after)
        if name == "quality rules":
            judged = quality.quality_rules(docs).where("kept").toPandas()
            assert sorted(after.doc_id) == sorted(judged.doc_id)
        if name == "line dedup":
            from test_dedup import brute_lines

            gone = brute_lines(list(zip(before.doc_id, before.text)), 3, 50)
            want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in zip(before.doc_id, before.text)}
            assert dict(zip(after.doc_id, after.text)) == {d: t for d, t in want.items() if t.split()}
        if name == "simhash near-dedup":
            from test_similar import shared

            words = {d: t.lower().split() for d, t in zip(before.doc_id, before.text)}
            kept = set(after.doc_id)
            gone = set(before.doc_id) - kept
            # estimates are some 0.03 off: pairs well above 0.8 lose one, and nothing goes without one that is about as similar
            assert not [(a, b) for a in kept for b in kept if a < b and shared(words[a], words[b]) >= 0.9]
            assert all(max(shared(words[d], words[k]) for k in words if k != d) >= 0.68 for d in gone)
        if name == "source mixing":
            taken = mixing.mix(docs).toPandas()
            assert after.groupby("doc_id").size().to_dict() == {d: c for d, c in zip(taken.doc_id, taken.copies) if c}
        if name == "byte-level BPE":
            encoder = bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
            assert all(b"".join(encoder.tokens[i] for i in ids) in {t.encode() for t in before.text} for ids in after.ids[:20])
            break
        assert list(after.columns) == list(C.COLUMNS)
        docs, before = spark.createDataFrame(after, docs.schema), after


def test_pieces_equal_the_library_on_texts_with_special_tokens():
    """The names of special tokens get their ids, wherever white space stands around them."""
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.PieceEncoder(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>\n\n <|endoftext|>x<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext", *odd_texts(800, seed=9)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in encoder.encode(texts)] == want
    assert 50256 in want[0]


def test_pieces_end_with_matches_and_words_are_remembered_apart():
    """The library's ids for texts of every kind of border, in slices and groups of any size; marks after a word make no new piece of it."""
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.PieceEncoder(P.path("byte_bpe_50k.json"))
    parts = ["a", "Word", "it's", "'s", "'", "'RE", "12", "!", "#.", "-", " ", "  ", "\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u200b", "\u2028"]
    parts += ["\u202f", "\u205f", "\u3000", "\u3001", "\u180e", "\ufeff", "\u0301", "\xd7", "\xf7", "\xf6", "\u024f", "\u0250", "\u6f22", "\U0001f600", "\u0663", "\xaa", "\xb2", "<|endoftext|>", "<|", "\0", "\x7f"]
    rng = random.Random(21)
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(4000)), None]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in encoder.encode(texts)] == want
    column = pa.array(texts, pa.string())
    assert [ids.tolist() for ids in encoder.encode(column.slice(1000, 50))] == want[1000:1050]
    encoder = packing.PieceEncoder(P.path("byte_bpe_50k.json"))
    encoder.encode([f" {w}{mark} (" for w in ("alpha", "b\xf6ta", "gamma") for mark in ("", ".", ",", "!", "'s", "12")])
    assert {w.decode() for w in encoder.known} == {" alpha", " b\xf6ta", " gamma", ".", ",", "!", "'s", "12", " ("}


def test_groups_of_pieces_and_slices_of_texts(monkeypatch):
    encoder = packing.PieceEncoder(P.path("byte_bpe_50k.json"))
    texts = [*odd_texts(300, seed=10), None, ""]
    whole = [ids.tolist() for ids in encoder.encode(texts)]
    monkeypatch.setattr(packing, "AT_ONCE", 3)
    monkeypatch.setattr(packing, "TEXTS", 40)
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(packing.by_size(batch))
    assert len(parts) > 20 and sum(p.num_rows for p in parts) == len(texts)
    assert [ids.tolist() for p in parts for ids in encoder.encode(p.column(1))] == whole
