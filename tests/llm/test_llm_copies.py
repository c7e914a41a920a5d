"""What is left of exact copies."""

import corpus_pipeline
from corpus import words
from pyspark.sql import functions as F

from trainlake.llm.common import read
from trainlake.llm.line_chunks import line_dedup_stage


def test_exact_copies_go_as_a_whole(spark, data):
    texts = ["\n".join(words(100 * k + i, 4 + (7 * k + i) % 40) for i in range(1 + k % 9)) for k in range(2, 30)]
    several = [t for t in texts if "\n" in t]
    docs = spark.createDataFrame(list(enumerate(several + several)), "doc_id long, text string")
    assert sorted(map(tuple, line_dedup_stage(spark, docs, data).collect())) == list(enumerate(several))


def test_planted_copies_are_gone_from_the_pipeline(spark, data, tmp_path):
    docs = read(spark, data, "documents")
    many = docs.where("length(text) > 400 AND text LIKE '%\n%'").orderBy("doc_id").limit(40)
    planted = many.withColumn("doc_id", F.col("doc_id") + 10**6)
    docs.unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, data, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert found and not [i for i in found if i >= 10**6]
