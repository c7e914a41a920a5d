"""What run() gives follows the mixture."""

import corpus_pipeline
from pyspark.sql import functions as F

from trainlake.llm.common import read, stored, with_place
from trainlake.llm.pfair_mixing import TARGET, mixed


def test_run_follows_the_slots_of_the_mixture(spark, data):
    docs = read(spark, data, "documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, data), "step")
    places = {r.doc_id: (r.slot, r.start) for r in mixed(docs, TARGET).select("row.doc_id", "slot", "start").collect()}
    found = corpus_pipeline.run(spark, data).orderBy("position").collect()
    assert len({r.position for r in found}) == len(found) == len(places)
    order = [places[r.doc_id] for r in found]
    assert order == sorted(order) and len({slot for slot, _ in order}) > 1


def test_places_of_many_parts_and_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        table = stored(spark.range(500).withColumn("k", F.pmod(F.col("id") * 37, F.lit(500))).repartitionByRange(9, "k").sortWithinPartitions("k"), "parts")
        assert [r.k for r in with_place(table, "p").orderBy("p").collect()] == list(range(500))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [r.id for r in with_place(spark.range(100), "p").orderBy("p").collect()] == list(range(100))
