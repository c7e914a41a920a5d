"""The registered queries against their SQL, and the pipeline as a whole."""

import duckdb
import pytest
from helpers import rows, value

import __spark_entry__ as entry
import corpus_pipeline
from trainlake.llm.common import read, stored
from trainlake.llm.queries import ORACLE, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_as_sql(spark, data, name):
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    expected = database.sql(ORACLE[name])
    columns = sorted(expected.columns)
    found = QUERIES[name](spark, data)
    assert sorted(found.columns) == columns
    wanted = [tuple(value(x) for x in r) for r in expected.select(*columns).fetchall()]
    wanted.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows(found, columns) == wanted and wanted


def test_one_query_for_each_operator():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline(spark, data):
    docs = read(spark, data, "documents")
    columns, left = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, data), "step")
        found = docs.collect()
        assert {r.doc_id for r in found} <= set(left) and len(found) == len({r.doc_id for r in found}) > 0.7 * len(left)
        if number < 4:
            assert docs.columns == columns
            assert number == 1 or all(r.text == left[r.doc_id] for r in found)
            left = {r.doc_id: r.text for r in found}
    assert {r.doc_id for r in found} == set(left) and all(r.round_trip for r in found)
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).select("doc_id", "n_tokens").collect())) == sorted((r.doc_id, r.n_tokens) for r in found)
