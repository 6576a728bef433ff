"""Quality rules: line-first cleaning in DataFrame expressions only.

Every line with a word is held against three rules. Lines that fail are removed, and a document that
loses too many of its words with them is rejected, as is one that fails the base rules (too few words,
too many words in repeated windows).

Defined results: a null or empty text has no words, fails the base rules and is rejected. Rows are judged
one by one, so repeated rows and null ids get the same verdict each. An empty table gives an empty table.
Columns of the input that are named like an output column are replaced by it; all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Symbols that count against a text (fixed value of the contract).
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts (fixed value of the contract).
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

#: A line without a final mark is a heading or a menu entry when it has fewer words than this.
SHORT_LINE_WORDS = 5
#: Percent of a line's characters that may be symbols.
MAX_SYMBOL_PERCENT = 10
#: Boilerplate phrases count only on lines of at most this many words.
BOILERPLATE_WORDS = 30
#: A document is rejected when it loses more than this share of its words.
MAX_LOST_PERCENT = 50

#: The end of a finished line, separators of menus, and stock phrases of pages and licences.
FINAL_MARK = "[.!?:;…][\"')\\]”’»]*$"
SEPARATORS = "[|»›•]"
BOILERPLATE = (
    "(all rights reserved|cookie policy|privacy policy|terms of use|terms of service|enable javascript"
    "|click here|sign up for|subscribe to|licensed under|released under|share this)"
)

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _count_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of 8 words found at least twice in the array, the first included.

    Windows are compared by a 64-bit hash of their words' hashes. Sorting (hash, position) puts equal
    windows side by side; the positions of the repeated ones, in order, then cover 8 words each less
    what they share with the one before.
    """

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(
                s,
                lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"]))
                | ((j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == e["h"])),
            ),
        )
        at = F.array_sort(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            at,
            start,
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def windows_of(hashes: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(first, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(windows))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(let(hashes, windows_of), count))


def line_fails(line: Column) -> Column:
    """Whether a line fails the punctuation, navigation or boilerplate rule."""
    n = F.size(words_of(line))
    trimmed = F.rtrim(F.translate(line, "\t\r\x0b\x0c", "    "))
    punctuation = ((n < SHORT_LINE_WORDS) & ~trimmed.rlike(FINAL_MARK)) | (
        _count_symbols(line) * 100 > F.length(line) * MAX_SYMBOL_PERCENT
    )
    navigation = F.size(F.split(line, SEPARATORS)) - 1 >= F.greatest(F.lit(2), F.ceil(n / 4))
    boilerplate = (n <= BOILERPLATE_WORDS) & F.lower(line).rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def quality_rules(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the counts, ``base_failed``, ``kept``, ``n_lines_failed``, ``n_words_lost`` and ``clean_text``.

    ``clean_text`` holds the lines that pass, joined by line feeds; lines without a word are left as they are.
    """
    passed = [c for c in documents.columns if c not in (*COLUMNS, "n_lines_failed", "n_words_lost", "clean_text")]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    split = documents.select(
        *[F.col(c) for c in passed],
        words_of(t).alias("__words"),
        F.transform(lines, lambda x: F.struct(x.alias("line"), F.size(words_of(x)).alias("n"))).alias("__lines"),
    )
    judged = split.select(
        *passed,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _count_symbols(t).cast("long").alias("n_symbols"),
        let(
            F.transform(F.filter("__lines", lambda x: x["n"] > 0), lambda x: x["line"]),
            lambda x: F.size(x) - F.size(F.array_distinct(x)),
        ).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        F.transform(
            "__lines",
            lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), ((x["n"] > 0) & line_fails(x["line"])).alias("bad")),
        ).alias("__lines"),
    )
    failed = F.filter("__lines", lambda x: x["bad"])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    counted = judged.select(
        *passed,
        *COLUMNS[:5],
        base.alias("base_failed"),
        F.size(failed).cast("long").alias("n_lines_failed"),
        F.aggregate(failed, F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("n_words_lost"),
        F.array_join(F.transform(F.filter("__lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    kept = ~F.col("base_failed") & (100 * F.col("n_words_lost") <= MAX_LOST_PERCENT * F.col("n_words"))
    return counted.select(*passed, *COLUMNS[:6], kept.alias("kept"), "n_lines_failed", "n_words_lost", "clean_text")
