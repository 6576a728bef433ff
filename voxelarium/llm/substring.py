"""Substring dedup: hashing of lines and of the sentences of long lines.

A text is cut behind every line feed and behind every ``.``, ``!`` or ``?`` that a space follows, so that a
passage set into the middle of a line is met by its own sentences. Units are normalised (lower case, words
joined by single spaces) and digested to 128 bits. Digests are grouped globally; the occurrence of the
smallest id (null last), text hash and offset stays, all others repeat it. Units of fewer than ``min_words`` words
are left alone. A repeated unit is removed if the run it stands in, of repeated units without another between them,
has ``run_words`` words or more: a sentence that many texts share is no passage by itself.

Defined results: null and empty texts have no units. Rows that repeat both id and text are one document. An
empty table gives an empty table. Only id and text are read; other columns pass through under any name but the two
output names, which replace theirs. Offsets count code points of the original text. Very long texts are cut like any
other; of equal units within one text the first stays.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MIN_WORDS = 6
#: Words of a run that make it a passage, for corpora: somewhat fewer than the 50 that a passage is taken to have, as it
#: may begin and end within sentences.
RUN_WORDS = 30
_CUT = re.compile(r"(?<=[.!?])(?=[ \t\r])|(?<=\n)")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def units(text: str | None, min_words: int = MIN_WORDS):
    """``(start, end, words, digest)`` of every unit with enough words; the digest has 16 bytes."""
    import xxhash

    text = text or ""
    at = 0
    for end in [*(m.start() for m in _CUT.finditer(text)), len(text)]:
        words = [w for w in _SPACES.split(text[at:end]) if w]
        if len(words) >= min_words:
            yield at, end, len(words), xxhash.xxh3_128_digest(" ".join(words).lower().encode())
        at = end


def _rows(min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("nth", pa.int64()), ("words", pa.int64()), ("digest", pa.binary())])

    def run(batches):
        for b in batches:
            ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[] for _ in schema]
            for k, text in enumerate(b.column(2)):
                for nth, (start, end, words, digest) in enumerate(units(text.as_py(), min_words)):
                    for column, value in zip(out, (ids[k], hashes[k], start, end, nth, words, digest)):
                        column.append(value)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def repeated_spans(documents: DataFrame, min_words: int = MIN_WORDS, run_words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, start, end, first_doc_id, first_start)`` of every span to remove."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_rows(min_words), "doc_id long, text_hash long, start long, end long, nth long, words long, digest binary")
    found = materialize(found, "units")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash", "start")
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # written before it is joined, so that adaptive execution can split the rows of a very common unit
    first = materialize(first, "first")
    again = found.join(first, "digest").where(place > F.col("first")).select(
        "doc_id", "text_hash", "start", "end", "nth", "words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")
    ).distinct()
    if run_words > 0:
        # units without a gap keep their number less their place among the repeated ones
        run = F.col("nth") - F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("nth"))
        total = F.sum("words").over(Window.partitionBy("doc_id", "text_hash", "run"))
        again = again.withColumn("run", run).withColumn("total", total).where(F.col("total") >= run_words)
    return again.select("doc_id", "text_hash", "start", "end", "first_doc_id", "first_start")


def substring_dedup(documents: DataFrame, min_words: int = MIN_WORDS, run_words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with ``clean_text`` and ``removed_spans``, the original offsets of what was cut out, in order."""
    spans = repeated_spans(documents, min_words, run_words, id_col, text_col)
    gone = spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__spans")
    )
    passed = [c for c in documents.columns if c not in ("removed_spans", "clean_text")]
    keyed = documents.withColumns({"__own_id": F.col(id_col).cast("long"), "__own_hash": F.xxhash64(text_col)})
    joined = keyed.join(gone, keyed["__own_id"].eqNullSafe(gone["__id"]) & (keyed["__own_hash"] == gone["__hash"]), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    state = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate(
        "__spans",
        state,
        lambda a, s: F.struct(
            F.concat(a["text"], F.substr(F.col(text_col), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))).alias("text"),
            s["end"].alias("at"),
        ),
        lambda a: F.concat(a["text"], F.substr(F.col(text_col), a["at"].cast("int") + 1)),
    )
    return joined.withColumn("__spans", F.coalesce("__spans", none)).select(*passed, F.col("__spans").alias("removed_spans"), clean.alias("clean_text"))
