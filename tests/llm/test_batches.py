import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import language_mixture

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_the_stages_hold_few_texts_at_once(spark):
    """A task of many long texts gets them in batches of a few MB, whatever their number."""
    told = dict(spark.conf.getAll).get(NAME)
    spark.conf.unset(NAME)
    try:
        docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("wörter sind hier "), 300).alias("text"), F.lit("de").alias("lang"), F.lit("s").alias("source"))

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

        for stage in (corpus_pipeline.known_language, corpus_pipeline.encoded):
            spark.conf.unset(NAME)
            stage(spark, docs, "")
            seen = docs.select("text").mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in seen) == 3000 and max(r.bytes for r in seen) < 8 << 20
        spark.conf.set(NAME, "16m")
        corpus_pipeline.encoded(spark, docs, "")
        assert spark.conf.get(NAME) == "16m"
    finally:
        spark.conf.unset(NAME)
        if told:
            spark.conf.set(NAME, told)


def test_the_text_travels_once(spark):
    docs = spark.createDataFrame([(1, "das ist ein text", "de"), (2, "this is a text", "en"), (3, None, None), (4, "1 2", "en")], "doc_id long, text string, lang string")
    model = language_mixture.train(docs)
    plain = language_mixture.identify(docs, model, ("doc_id",)).collect()
    packed = language_mixture.identify(docs.select(F.struct("doc_id", "text").alias("d")), model, ("d",), inside="d").select("d.*", "lang_pred", "score", "shares")
    assert [(r.doc_id, r.lang_pred, r.score, r.shares) for r in packed.collect()] == [(r.doc_id, r.lang_pred, r.score, r.shares) for r in plain]
    assert {r.doc_id: r.text for r in packed.collect()} == {r.doc_id: r.text for r in docs.collect()}
