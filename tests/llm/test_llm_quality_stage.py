"""The stage keeps the rows that the query keeps."""

import random

from corpus import SCHEMA, words

from trainlake.llm import site_quality as Q


def test_stage_keeps_what_the_query_keeps_on_sparse_sites(spark, tmp_path):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):  # texts tell nothing; sites of two labelled documents that mostly, not always, agree
        host, path = i // 4, i // 2 % 2
        text = words(rng.randrange(10**6), 40)
        good = path if rng.random() < 0.85 else 1 - path
        rows.append((i, text, f"host{host}", f"path{path}", len(text), "mine", 7, "k", 9))
        labels.append((i, good))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    wanted = {r.doc_id for r in Q.op1_quality_classifier(spark, str(tmp_path)).collect() if r.kept}
    found = {r.doc_id for r in Q.quality_stage(spark, docs, str(tmp_path)).collect()}
    assert found == wanted and 0 < len(found) < 400
