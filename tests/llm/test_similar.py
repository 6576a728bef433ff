"""Groups of similar texts against the shares of common shingles."""

import random

from voxelarium.llm import simhash


def shared(a, b, width=5):
    x, y = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else {()} for w in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts_leave_one(spark):
    """Copies of falling similarity, a dense group larger than a chunk, and hard rows; column names clash."""
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, group = {}, {}
    for g in range(40):
        base = rng.choices(vocabulary, k=400)
        for c, edits in enumerate((0, 1, 2, 4, 60)):
            words = list(base)
            for at in rng.sample(range(400), edits):
                words[at] = f"e{g}x{c}x{at}"
            texts[100 * g + c] = " ".join(words)
            group[100 * g + c] = g if edits < 60 else (g, "far")
    dense = rng.choices(vocabulary, k=600)
    for c in range(60):
        words = list(dense)
        words[c * 3] = f"d{c}"
        texts[9000 + c], group[9000 + c] = " ".join(words), "dense"
    rows = [*texts.items(), (20_000, None), (20_001, ""), (20_002, " \n"), (None, texts[0]), (0, texts[0]), (30_000, "one two"), (30_001, "One  two"), (30_002, "long " * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, fp string, node int, x int")
    for chunk in (simhash.CHUNK, 10):
        simhash_links = simhash.similar_links
        simhash.similar_links = lambda nodes, similarity, c=chunk, f=simhash_links: f(nodes, similarity, c)
        try:
            kept = simhash.keep_one_of_similar(df)
            assert kept.columns == df.columns
            ids = sorted(r.doc_id for r in kept.collect())
        finally:
            simhash.similar_links = simhash_links
        first = {}
        for i, g in group.items():
            first.setdefault(g, i)
        assert ids == sorted([*first.values(), 20_000, 30_000, 30_002])
    assert simhash.keep_one_of_similar(df.where("doc_id < 0")).count() == 0
