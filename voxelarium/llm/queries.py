"""The queries of this package: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, linededup, mixing, packing, quality, runs, secrets, simhash, substring, toxicity, warc, whitening
from .common import let, words_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, max_distance=4)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.COLUMNS, "n_lines_failed", "n_words_lost")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring.repeated_spans(_table(spark, sf_dir, "documents"), min_words=1, run_words=substring.RUN_WORDS)
    return spans.select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "first_doc_id", F.col("first_start").alias("first_start_at"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.deduplicated_archives(spark, _table(spark, sf_dir, "pages"), min_payload=0)
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), " ")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), spans.alias("toxic_spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ",")
    return cleaned.select("doc_id", "n_lines", "n_removed", removed.alias("removed_lines"), F.md5("clean_text").alias("clean_md5"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(embeddings, whitening.fit(embeddings))


def _with_repeats(doc_id: Column, text: Column) -> Column:
    """The contract's texts: those of every tenth document by CRC-32 get a tail that repeats one block of words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        block = F.slice(words, a + 1, (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(block, (F.floor((n - a) / F.size(block)) + 1).cast("int"))), 1, n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words_of(text), repeated)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    texts = documents.select("doc_id", _with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.periodic_runs(texts, collapse=False)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", "runs", "collapsed_sha256", longest.alias("longest")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length DIV -longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))

    def spans(of) -> Column:
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    base = F.filter("findings", lambda x: x["kind"] != "net")
    return found.select("doc_id", *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans("findings").alias("spans"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_packing": op4_token_packing,
    "op5_source_mixing": op5_source_mixing,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_secret_scan": op13_secret_scan,
}
