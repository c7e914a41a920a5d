import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trainlake.llm import voronoi_knn
from trainlake.llm.voronoi_knn import KnnJoin, knn_join

SCHEMA = "vec_id long, embedding array<float>, cell string, ids string, key long"


def table():
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) + (i % 3) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)]  # one common vector, so ties
    rows += [(300, None), (301, [0.1, None, 0, 0, 0, 0]), (302, [float("nan")] + [0.0] * 5), (303, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(400, [1.0, 2.0]), (450, [2.0, 1.0]), (500, []), (550, [])]
    return rows + rows[:2] + [(7, [0.25] * 6), (20, [0.75] * 6), (20, [1.5] * 6)]  # repeated rows, and ids with several vectors


def brute(rows, k, divisor):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for place, (q, v) in enumerate(usable):
        if q % divisor == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for n, (i, w) in enumerate(usable) if n != place and len(w) == len(v))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("pivots,block_rows", [(None, 4096), (4, 16), (1, 3)])
def test_as_brute_force(spark, pivots, block_rows):
    rows = [(i, None if v is None else [None if x is None else float(spark_float(x)) for x in v]) for i, v in table()]
    df = spark.createDataFrame([(i, v, "mine", "mine", 1) for i, v in rows], SCHEMA)
    found = knn_join(df, F.col("vec_id") % 10 == 0, pivots=pivots, block_rows=block_rows)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5, 10)


def spark_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**19 + i), float(2**20 - i), 1.0]) for i in range(30)]
    found = knn_join(spark.createDataFrame([(i, v, "", "", 0) for i, v in rows], SCHEMA.replace("float", "double")), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 10)


def test_empty_table(spark):
    assert knn_join(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_most_of_clustered_vectors_is_never_searched(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, [c + rng.gauss(0, 0.03) for c in centres[i % 30]]) for i in range(3000)]
    join = KnnJoin(spark.createDataFrame([(i, v, "", "", 0) for i, v in rows], SCHEMA.replace("float", "double")), F.col("vec_id") % 50 == 0)
    assert join.routes.count() < 0.1 * join.possible
    assert sorted(map(tuple, join.result.collect())) == brute(rows, 5, 50)


def test_queries_move_to_blocks_not_to_rings(spark, monkeypatch):
    """What is sent grows with the blocks; one row with its vector for each query and ring filled the memory of the workers."""
    made, stored = {}, voronoi_knn.stored
    monkeypatch.setattr(voronoi_knn, "stored", lambda df, label: made.setdefault(label, stored(df, label)))
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(1500)]
    join = KnnJoin(
        spark.createDataFrame([(i, v, "", "", 0) for i, v in rows], SCHEMA.replace("float", "double")), F.col("vec_id") % 10 == 0, pivots=100, block_rows=300
    )
    assert made["routes"].count() <= 150 * 7  # blocks of 300 at most, and a ring that doesn't fit begins a new one
    assert join.routes.count() > 10 * made["routes"].count()
    assert sorted(map(tuple, join.result.collect())) == brute(rows, 5, 10)


def test_large_rings_and_many_queries_are_cut(spark, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "PART_QUERIES", 7)
    monkeypatch.setattr(voronoi_knn, "SCORES", 50)
    monkeypatch.setattr(voronoi_knn, "TILE", 7)
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame([(i, v, "", "", 0) for i, v in rows], SCHEMA.replace("float", "double"))
    for options in ({"pivots": 3, "block_rows": 8}, {"pivots": 20, "block_rows": 100}):
        assert sorted(map(tuple, knn_join(df, F.col("vec_id") % 4 == 0, **options).collect())) == brute(rows, 5, 4)


def test_a_batch_of_queries_takes_little_memory_with_the_most_rings():
    rng = np.random.default_rng(3)
    points = rng.integers(-90, 90, (voronoi_knn.MOST_PIVOTS, 64)).astype(float)
    summaries = [(cell, 400, 300.0, 800.0) for cell in range(8 * len(points))]
    space = voronoi_knn._Space({64: (0, points)}, 8, summaries, {64: 400 * len(summaries)}, 4096)
    queries = voronoi_knn._packed(rng.integers(-90, 90, (1024, 64)))
    batch = pd.DataFrame({"query_key": np.arange(1024), "cell": np.arange(1024, dtype=np.int32), "packed": queries})
    sent = 0
    tracemalloc.start()
    for rings, part, x in space.queries(batch):
        bounds = rings.lower(x, 6)
        reached = rings.reached(x, np.full(len(x), -np.inf), part["cell"].to_numpy())
        query, block = rings.blocks(reached)
        assert len(bounds) == len(x) and reached.sum() == len(x) * (len(summaries) - 1) and block.max() == rings.blocks_until - 1
        sent += len(query)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 1024 * space.lengths[0].blocks_until <= 1024 * 120
    assert peak < 150e6


@pytest.mark.parametrize("unit", [2.0**14, 2.0**18, 2.0**26])  # with the scale: floats of 64 bits, whole numbers, some beyond 64 bits
def test_products_of_any_size(spark, unit):
    rng = random.Random(11)
    rows = [(i, [unit * rng.uniform(-1, 1) for _ in range(5)]) for i in range(90)]
    found = knn_join(spark.createDataFrame([(i, v, "", "", 0) for i, v in rows], SCHEMA.replace("float", "double")), F.col("vec_id") % 10 == 0, block_rows=20)
    limit = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = []
    whole = [[math.floor(256 * x) for x in v] for _, v in rows]
    for q in range(0, 90, 10):
        scores = sorted((-limit(sum(a * b for a, b in zip(whole[q], whole[i]))), i) for i in range(90) if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_vectors_pack_in_the_least_width():
    for kind, value in (("i1", -128), ("i2", -32768), ("i4", 2**31 - 1), ("i8", -(2**63))):
        vectors = np.array([[value, 1], [0, 2]], dtype=np.int64)
        packed = voronoi_knn._packed(vectors)
        assert len(packed[0]) == 2 * np.dtype(kind).itemsize
        mixed = voronoi_knn._unpacked([*packed, *voronoi_knn._packed(np.array([[3, 4]]))], 2)
        assert mixed.tolist() == [[value, 1], [0, 2], [3, 4]]
    assert voronoi_knn._unpacked(voronoi_knn._packed(np.zeros((2, 0), dtype=np.int64)), 0).shape == (2, 0)
