import math

import numpy as np
from corpus import hard, hard_rows, none, words
from pyspark.sql import functions as F

from trainlake.llm import site_quality as Q


def labelled(spark, n=400):
    rows = [(i, words(i, 40) if i % 3 else "BUY!! NOW!! " * 20, f"host{i % 5}", "p" if i % 2 else None) for i in range(n)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, n, 2)] + [(1, None), (None, 1), (0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_labels_are_found(spark):
    docs, labels = labelled(spark)
    found = Q.quality(docs, labels, F.col("host"), F.col("path")).collect()
    assert len(found) == 400
    assert all((r.posterior >= 0.5) == (r.doc_id % 3 > 0) for r in found)
    assert {r.path for r in found} == {"p", None}


def test_posteriors_as_brute_force(spark):
    values = [("a", "x", 1.0)] * 30 + [("a", "y", 0.0)] * 3 + [("b", "x", 0.5)] * 10 + [("c", "z", 1.0)]
    sites, rate = Q.site_posteriors(spark.createDataFrame(values, "host string, path string, value double"))
    n, total = len(values), sum(v for *_, v in values)
    assert rate == min(1 - 1e-3, max(1e-3, total / n))

    def strength(groups):  # (n, mean, centre)
        spread = sum(k * (m - c) ** 2 for k, m, c in groups)
        noise = sum(c * (1 - c) for _, _, c in groups)
        weight = sum(k for k, *_ in groups)
        between = (spread - noise) / weight
        return min(1e6, max(1.0, sum(k * c * (1 - c) for k, _, c in groups) / weight / between - 1)) if between > 0 else 1e6

    def of(key):
        keys = sorted({key(v) for v in values})
        return {k: [v[2] for v in values if key(v) == k] for k in keys}

    hosts, paths = of(lambda v: v[0]), of(lambda v: v[:2])
    s = strength([(len(v), sum(v) / len(v), rate) for v in hosts.values()])
    post = {h: (sum(v) + s * rate) / (len(v) + s) for h, v in hosts.items()}
    w = strength([(len(v), sum(v) / len(v), post[h]) for (h, _), v in paths.items()])
    for r in sites.collect():
        assert math.isclose(r.host_posterior, post[r.host]) and math.isclose(r.path_strength, w) and r.n == len(paths[r.host, r.path])


def test_a_sparse_site_has_the_rate_of_its_parent_and_a_full_one_its_own(spark):
    values = [(f"good{i}", "p", 1.0) for i in range(20) for _ in range(200)] + [(f"bad{i}", "p", 0.0) for i in range(20) for _ in range(200)]
    sites, rate = Q.site_posteriors(spark.createDataFrame(values + [("one", "p", 0.0)], "host string, path string, value double"))
    found = {r.host: r.host_posterior for r in sites.collect()}
    assert found["good0"] > 0.99 and found["bad0"] < 0.01 and 0.05 < found["one"] < rate


def test_linear_form_equals_the_model(spark):
    docs, labels = labelled(spark, 60)
    rows = Q.with_features(docs.withColumn("body", F.col("text")))
    x = np.array([r.features for r in rows.collect()])
    model = Q.fit(x, np.array([i % 3 > 0 for i in range(60)], dtype=float))
    found = np.array([r.classifier for r in Q._classified(rows, model).collect()])
    assert np.allclose(found, Q.probability(model, x))


def test_no_labels_and_hard_rows(spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    found = Q.quality(hard(spark), nothing, F.col("source"), F.col("lang")).collect()
    assert len(found) == len(hard_rows()) and all(abs(r.posterior - 0.5) < 1e-9 for r in found)
    assert Q.quality(none(spark), nothing, F.col("source"), F.col("lang")).count() == 0


def test_stage_keeps_rows_and_columns(spark, data):
    docs = hard(spark)
    assert Q.quality_stage(spark, docs, data).columns == docs.columns
    assert Q.quality_stage(spark, none(spark), data).count() == 0


def test_clean_documents_stay_and_junk_goes(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    kept = {r.doc_id for r in Q.quality_stage(spark, docs, data).collect()}
    good = [r.doc_id for r in labels.collect() if r.quality]
    bad = [r.doc_id for r in labels.collect() if not r.quality]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.15 * len(bad)
