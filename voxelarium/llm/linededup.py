"""Line dedup: winnowing over line hashes.

Lines with a word are numbered and hashed by their words joined with single spaces. In each window of
``window`` consecutive lines the smallest hash is selected (the last of equals), so two equal windows select
the same line of each; any run of ``window`` equal lines therefore shares a fingerprint. A line of
``long_words`` words or more is a fingerprint by itself. Each fingerprint carries the hashes of its
neighbours, is joined with the earliest position of the same line, and the match is extended both ways.
Windows that differ from those at the earliest position are held against each other in a second round, by the
hash of the whole window, so a run is found whichever earlier place it repeats.

What goes: a line with at least ``long_words`` words that stands at an earlier place too, and every line of a
window of ``window`` lines that stands at an earlier place too (also within one document, also overlapping).
Places are ordered by id (null last), then by the hash of the text, then by line.

Defined results: a null text counts as empty and stays null. Lines without a word are never compared nor removed.
Rows that repeat both id and text are one document: they get the same decision. An empty table gives an
empty table. Only id and text are read, other columns pass through under any name but the four output names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, words_of

WINDOW = 3
LONG_WORDS = 50
OUTPUT = ("n_lines", "n_removed", "removed_lines", "clean_text")


def _selected(hashes: Column, window: int) -> Column:
    """For each window of the array the place of its smallest hash, the last of equals."""

    def least(i: Column) -> Column:
        back = F.reverse(F.slice(hashes, i + 1, window))
        return (i + window - F.array_position(back, F.array_min(back))).cast("int")

    return F.when(F.size(hashes) < window, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - window), least)
    )


def _anchors(documents: DataFrame, window: int, long_words: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.filter(
            F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), words_of(x).alias("words"))),
            lambda x: F.size(x["words"]) > 0,
        ).alias("ls"),
    ).select(
        "doc_id",
        "text_hash",
        F.transform(
            "ls",
            lambda x: let(
                F.array_join(x["words"], " "),
                lambda s: F.struct(
                    x["line"].alias("line"), (F.size(x["words"]) >= long_words).alias("long"), F.xxhash64(s).alias("h"), F.xxhash64(F.lit(1), s).alias("h2")
                ),
            ),
        ).alias("ls"),
    )
    # rows that repeat a document add nothing
    once = lines.dropDuplicates(["doc_id", "text_hash"]).select(
        "*", F.transform("ls", lambda x: x["h"]).alias("hs"), F.transform("ls", lambda x: x["line"]).alias("at")
    )
    picked = once.withColumn("sel", _selected(F.col("hs"), window))
    own = F.filter(F.transform("ls", lambda x, i: F.when(x["long"], i)), lambda x: x.isNotNull())
    exploded = picked.withColumn("p", F.explode(F.array_union("sel", own)))
    x = F.col("ls")[F.col("p")]
    reach = F.array(*[F.lit(o) for o in range(1 - window, window)])
    return exploded.select(
        "doc_id",
        "text_hash",
        "p",
        x["h"].alias("h"),
        x["h2"].alias("h2"),
        x["long"].alias("long"),
        F.transform(reach, lambda o: F.get("hs", F.col("p") + o)).alias("near"),
        F.transform(reach, lambda o: F.get("at", F.col("p") + o)).alias("near_line"),
        # the windows that selected this line, by where they begin, counted from it
        F.filter(
            F.array(*[F.lit(o) for o in range(1 - window, 1)]),
            lambda o: (F.col("p") + o >= 0) & F.coalesce(F.get("sel", F.col("p") + o) == F.col("p"), F.lit(False)),
        ).alias("begins"),
    )


def _place(row: str = "") -> Column:
    return F.struct(F.col(f"{row}doc_id").isNull().alias("n"), f"{row}doc_id", f"{row}text_hash", f"{row}p")


def repeated_lines(
    documents: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text_hash, line)`` of every line to remove, lines counted from 0 in the text split at line feeds."""
    anchors = materialize(_anchors(documents, window, long_words, id_col, text_col), "anchors")
    earliest = anchors.groupBy("h", "h2").agg(F.min(F.struct(_place().alias("place"), "near")).alias("first"), F.count("*").alias("n"))
    # written, so that both sides of the join come from a shuffle of their own and the rows of a very common line are split
    earliest = materialize(earliest.where("n > 1"), "earliest")
    later = anchors.join(earliest, ["h", "h2"]).where(_place() > F.col("first.place"))
    # how far the match goes: lines equal to those at the earliest place, without a gap
    same = F.zip_with("near", "first.near", lambda a, b: F.coalesce(a == b, F.lit(False)))
    mid = window - 1

    def reach(step: int) -> Column:
        out = F.lit(0)
        for k in range(window - 1, 0, -1):
            out = F.when(F.get("same", F.lit(mid + step * k)), 1 + out).otherwise(0)
        return out

    matched = materialize(
        later.withColumn("same", same)
        .withColumns({"left": reach(-1), "right": reach(1)})
        .select("doc_id", "text_hash", "p", "long", "near", "near_line", "begins", "left", "right"),
        "matches",
    )
    whole = F.col("left") + F.col("right") + 1 >= window
    inside = F.when(whole, F.slice("near_line", F.lit(mid + 1) - F.col("left"), F.col("left") + F.col("right") + 1)).otherwise(
        F.when(F.col("long"), F.slice("near_line", mid + 1, 1)).otherwise(F.array().cast("array<int>"))
    )
    direct = matched.select("doc_id", "text_hash", F.explode(inside).alias("line"))

    # windows not equal to that at the earliest place may still repeat each other
    open_windows = F.filter("begins", lambda o: (-o > F.col("left")) | (o + window - 1 > F.col("right")))
    rest = matched.select("doc_id", "text_hash", "p", "near", "near_line", F.explode(open_windows).alias("o")).select(
        "doc_id",
        "text_hash",
        (F.col("p") + F.col("o")).alias("p"),
        F.slice("near", F.col("o") + mid + 1, F.lit(window)).alias("window"),
        F.slice("near_line", F.col("o") + mid + 1, F.lit(window)).alias("lines"),
    )
    first = rest.groupBy("window").agg(F.min(_place()).alias("place"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first, "first-windows")
    among = rest.join(first, "window").where(_place() > F.col("place")).select("doc_id", "text_hash", F.explode("lines").alias("line"))
    return direct.union(among).distinct()


def line_dedup(
    documents: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``documents`` with ``n_lines``, ``n_removed``, ``removed_lines`` (their numbers, in order) and ``clean_text``."""
    gone = (
        repeated_lines(documents, window, long_words, id_col, text_col)
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.sort_array(F.collect_set("line")).alias("__gone"))
    )
    passed = [c for c in documents.columns if c not in OUTPUT]
    keyed = documents.withColumns({"__own_id": F.col(id_col).cast("long"), "__own_hash": F.xxhash64(text_col)})
    joined = keyed.join(gone, keyed["__own_id"].eqNullSafe(gone["__id"]) & (keyed["__own_hash"] == gone["__hash"]), "left")
    joined = joined.withColumns({"__gone": F.coalesce("__gone", F.array().cast("array<int>")), "__lines": F.split(F.col(text_col), "\n")})
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    clean = F.when(F.size("__gone") == 0, F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    return joined.select(
        *passed,
        F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.size("__gone").cast("long").alias("n_removed"),
        F.col("__gone").alias("removed_lines"),
        clean.alias("clean_text"),
    )
