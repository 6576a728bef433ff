"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows, ties and an empty table."""

import random
from collections import Counter

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, sentences=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8)))
    return "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(sentences))


A, B, C = prose(1), prose(2), prose(3)
LONG = prose(9, 3000)
ROWS = [
    (1, A, "en", "x", len(A)),
    (1, A, "en", "x", len(A)),  # a repeated row
    (2, B, None, None, None),
    (None, C, "en", "y", 5),
    (4, None, "en", "x", None),
    (5, "", None, "y", 0),
    (6, " \n\t ", "de", "x", 4),
    (7, LONG, "en", "y", len(LONG)),
    (8, A, "en", "z", len(A)),  # the text of another id
    (9, "too short", "en", None, 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return df.collect()


def test_quality(spark, docs):
    out = rows(stage("quality rules")(spark, docs, ""))
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(1, A), (1, A), (2, B), (None, C), (7, LONG), (8, A)])
    assert all(r.n_chars == len(r.text) for r in out)


def test_line_dedup(spark, docs):
    """Later copies lose their lines and go; null and empty texts lose none and stay; repeated rows are one document."""
    out = rows(stage("line dedup")(spark, docs, ""))
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(1, A), (1, A), (2, B), (None, C), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (9, "too short")])


def test_near_dedup(spark, docs):
    """One of equal texts stays, that of the smallest id; texts without words are one group."""
    out = rows(stage("simhash near-dedup")(spark, docs, ""))
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(1, A), (2, B), (None, C), (4, None), (7, LONG), (9, "too short")])
    ties = spark.createDataFrame([(None, A, "a", "b", 1), (3, A + " ", "a", "b", 1), (3, A, "a", "b", 1)], SCHEMA)
    [kept] = rows(stage("simhash near-dedup")(spark, ties, ""))
    assert kept.doc_id == 3


def test_mixing(spark, docs):
    """Texts without words are taken no times, no row more than three, a null source is a source; reruns agree."""
    out = rows(stage("source mixing")(spark, docs, ""))
    taken = Counter((r.doc_id, r.text, r.source) for r in out)
    assert not any(r.text is None or not r.text.strip() for r in out)
    held = Counter((i, t, s) for i, t, _, s, _ in ROWS)
    assert all(n <= 3 * held[key] for key, n in taken.items()) and any(s is None for _, _, s in taken)
    assert taken == Counter((r.doc_id, r.text, r.source) for r in stage("source mixing")(spark, docs.repartition(5), "").collect())


def test_encoding(spark, docs):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = stage("byte-level BPE")(spark, docs, "").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((i, tuple(own.encode_ordinary(t or ""))) for i, t, *_ in ROWS)


def test_an_empty_table(spark, docs):
    now = docs.where("false")
    for _, run in corpus_pipeline.STAGES:
        now = run(spark, now, "")
        assert now.count() == 0


def test_whole_run(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {1, 2, None, 7} and all(len(r.ids) > 0 for r in out)
