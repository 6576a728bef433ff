"""Joins with a key that most rows hold are split: the final plans say so, and the results are right."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelarium.llm import graph, linededup, warc
from voxelarium.llm.common import materialize

SETTINGS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture(autouse=True)
def settings(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df: DataFrame) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_headers_of_one_payload(spark):
    rows = spark.range(0, 60_000, 1, 16).select(
        F.lit("x" * 20).alias("payload_digest"), F.lit(0).cast("long").alias("payload_bytes"), F.col("id").alias("page_id"), F.lit(0).alias("part"), F.col("id").alias("offset"),
        F.concat(F.lit("http://"), F.sha2(F.col("id").cast("string"), 256)).alias("url"),
    )
    out = warc.resolve_revisits(materialize(rows, "rows"))
    assert "skew=true" in plan_of(out)
    assert out.where("record_type = 'response'").select("page_id").collect() == [(0,)] and out.where("to_id = 0").count() == 59_999


def test_edges_of_one_node(spark):
    edges = materialize(spark.range(1, 60_000, 1, 16).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")), "edges")
    assert "skew=true" in plan_of(graph._large_star(edges))
    out = graph.components(edges.union(spark.createDataFrame([(100_001, 59_999), (200_001, 200_000)], "u long, v long")))
    assert out.where("v = 0").count() == 60_000 and out.where("v = 200000").collect() == [(200_001, 200_000)]


def test_a_line_of_every_document(spark, monkeypatch):
    """Each document has one common line between lines of its own."""
    splits, real = [], linededup.materialize

    def seen(df, name):
        if name == "matches":
            splits.append("skew=true" in plan_of(df))
        return real(df, name)

    monkeypatch.setattr(linededup, "materialize", seen)
    common = " ".join(f"word{k}" for k in range(60))
    text = F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(f"\n{common}\n"), F.sha2((F.col("id") + 10**9).cast("string"), 256))
    docs = spark.range(0, 20_000, 1, 16).select(F.col("id").alias("doc_id"), text.alias("text"))
    out = linededup.line_dedup(docs)
    assert out.where("n_removed = 1").count() == 19_999 and out.where("n_removed = 0").select("doc_id").collect() == [(0,)]
    assert splits == [True]
