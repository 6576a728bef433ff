"""What the labels teach, beyond the sample that the field is fitted to."""

from pyspark.sql import functions as F

from voxelarium.llm import toxicity


def test_words_are_counted_over_all_labelled_rows(spark, monkeypatch):
    """A word that stands in the last toxic rows by the hash of the id only, of some 26,000 that teach."""
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, marks: seen.update(marks=marks, texts=len(texts)) or toxicity.Field())
    told = spark.range(33_000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    last = told.where(~toxicity.held_out(F.col("doc_id")) & (F.col("toxic") == 1)).orderBy(F.xxhash64("doc_id").desc()).limit(60)
    rare = [r.doc_id for r in last.collect()]
    word = F.when(F.col("doc_id").isin(rare), "snarkel").otherwise("plain")
    documents = told.select("doc_id", F.concat_ws(" ", F.concat(F.lit("u"), "doc_id"), F.concat(F.lit("v"), "doc_id"), word).alias("text"))
    toxicity.learn(documents, told)
    assert seen == {"marks": {"snarkel"}, "texts": toxicity.SAMPLE}


def _documents(spark, told):
    word = F.when(F.col("toxic") == 1, "vilegrub").otherwise("plain")
    return told.select("doc_id", F.concat_ws(" ", F.concat(F.lit("u"), "doc_id"), F.concat(F.lit("v"), "doc_id"), word).alias("text"))


def test_held_out_labels_cannot_change_the_model(spark):
    told = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    documents = _documents(spark, told)
    lied = told.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = toxicity.learn(documents, told), toxicity.learn(documents, lied)
    assert (one.weights == other.weights).all() and one.curve == other.curve and (one.moves == other.moves).all()
    assert one.weights.any()


def test_marks_are_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    """Conflicting labels of an id, repeated rows, null and very long texts among them."""
    told = spark.range(200).select(F.col("id").alias("__id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    texts = _documents(spark, told.withColumnRenamed("__id", "doc_id")).withColumnRenamed("doc_id", "__id")
    long = spark.createDataFrame([(0, "vilegrub " + "filler " * 30_000), (1, ""), (2, "  \n")], "__id long, text string")
    texts = texts.union(texts.limit(9)).union(long)
    told = told.union(spark.createDataFrame([(5, 1), (8, 0)], "__id long, toxic int"))
    by_broadcast = sorted(toxicity.toxic_marks(texts, told))
    monkeypatch.setattr(toxicity, "BROADCAST_IDS", 3)
    assert by_broadcast == sorted(toxicity.toxic_marks(texts, told)) == ["vilegrub"]


def test_context_is_that_of_the_neighbours():
    model = toxicity.Field()
    model.weights[toxicity.features("odd")[3]] = 2.0  # what follows "odd"
    model.weights[toxicity.features("end")[4]] = 3.0  # what stands before "end"
    model.weights[toxicity._EDGES[0]] = 5.0
    own = model.weights[[toxicity.features(w) for w in "odd mid end".split()]]
    assert (model.emissions(own) - model.bias).tolist() == [5.0 * toxicity.CONTEXT, 5.0 * toxicity.CONTEXT, 0.0]
    assert model.emissions(own[:0]).tolist() == []
