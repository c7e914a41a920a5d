"""Checks that stand in for constraints a Parquet table does not enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake import schemas as S


class QualityError(ValueError):
    pass


def null_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that lack a required value, with the names of the missing columns."""
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda name: name.isNotNull()
    )
    return rows.withColumn("missing", F.array_join(missing, ",")).where(F.col("missing") != "")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def assert_empty(violations: DataFrame, what: str) -> None:
    found = violations.take(1)
    if found:
        raise QualityError(f"{what}: {found[0].asDict()}")


def assert_not_null(rows: DataFrame, columns: list[str]) -> DataFrame:
    assert_empty(null_violations(rows, columns), "required value missing")
    return rows


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    assert_empty(duplicate_keys(rows, keys), "key not unique")
    return rows


def valid_confidence() -> Column:
    """A missing confidence is allowed here; it is filled on first ingest."""
    return F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0)


def entity_problems(entities: DataFrame) -> DataFrame:
    """Entities with the first rule they break; NULL when they are well formed."""
    problem = (
        F.when(~F.coalesce(F.col("entity_type").isin(list(S.ENTITY_KINDS)), F.lit(False)), "unknown_kind")
        .when(~F.coalesce(F.col("tier").isin(S.TIERS), F.lit(False)), "unknown_tier")
        .when(~valid_confidence(), "confidence_out_of_range")
        .otherwise(_foreign_field())
    )
    return entities.withColumn("problem", problem)


def _foreign_field() -> Column:
    """Reports a field that belongs to another kind of entity."""
    checks = []
    for kind, fields in S.ENTITY_KINDS.items():
        others = [f.name for name, k in S.ENTITY_KINDS.items() if name != kind for f in k.fields]
        filled = reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in others])
        checks.append((F.col("entity_type") == kind) & filled)
    return F.when(reduce(lambda a, b: a | b, checks), "foreign_field")


def valid_entities(entities: DataFrame) -> DataFrame:
    return entity_problems(entities).where(F.col("problem").isNull()).drop("problem")


def rejected_entities(entities: DataFrame) -> DataFrame:
    return entity_problems(entities).where(F.col("problem").isNotNull())


def require_known(value: Column, allowed: list[str], what: str) -> Column:
    """``value``, or an error at run time if it is not one of ``allowed``."""
    known = F.coalesce(value.isin(allowed), F.lit(False))
    return F.when(known, value).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("NULL")))).cast("string")
    )
