from pyspark.sql import functions as F

from helpers import rows
from trainlake.operators import skew


def _skewed(spark):
    """Key 0 has a third of all rows."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )


def test_segments_are_ordered_and_bounded(spark):
    cut = skew.ordered_segments(_skewed(spark), "k", ["v"], max_rows=60)
    sizes = cut.groupBy("k", "segment").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    found = sorted((r.k, r.segment, r.n, r.low, r.high) for r in sizes.collect())
    hot = [r for r in found if r[0] == 0]
    assert len(hot) > 3 and max(r[2] for r in hot) < 120 and sum(r[2] for r in hot) == 312
    assert all(a[4] < b[3] for a, b in zip(hot, hot[1:]))
    assert all(r[1] == 0 for r in found if r[0] != 0)
    assert cut.count() == 900


def test_without_hot_keys_nothing_is_cut(spark):
    cut = skew.ordered_segments(_skewed(spark), "k", ["v"])
    assert cut.select("segment").distinct().collect() == [(0,)]


def test_best_rows_equal_a_full_ranking(spark):
    table = _skewed(spark).repartition(7).withColumn("p", (F.col("v") * 7919) % 101)
    found = skew.best_rows(table, "k", [F.desc("p"), F.asc("v")], 5)
    expected = {}
    for r in table.collect():
        expected.setdefault(r.k, []).append((-r.p, r.v))
    expected = sorted((k, i + 1, v) for k, values in expected.items() for i, (_, v) in enumerate(sorted(values)[:5]))
    assert sorted((r.k, r["rank"], r.v) for r in found.collect()) == expected


def test_hot_keys(spark):
    assert rows(skew.hot_keys(_skewed(spark), "k", 100), ["k", "n_rows"]) == [(0, 312)]


def test_equal_rows_are_cut_too(spark):
    same = spark.range(600).select(F.lit(1).alias("k"), F.lit(5).alias("v")).repartition(4)
    sizes = skew.ordered_segments(same, "k", ["v"], max_rows=100).groupBy("segment").count().collect()
    assert len(sizes) > 3 and sum(r["count"] for r in sizes) == 600 and max(r["count"] for r in sizes) < 300
