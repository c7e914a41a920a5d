"""Selection of context records for requests: policy, completeness, priority, form and token budget.

A *request* is a row (request_id, coach_id, mode, token_budget, as_of, and optionally policy_mode). The
records offered to it are the *candidates*: measured entities (see ``measured``) with request_id and
ordinal (input position, unique within a request). One job serves all requests.

Texts are read twice, in map tasks: once to be measured and once, for the few selected records, to be
written out. Everything between moves narrow rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake import schemas as S
from trainlake.functions.dates import age_days
from trainlake.functions.text import first_words, is_blank
from trainlake.operators.quality import require_known
from trainlake.operators.skew import best_rows
from trainlake.session import materialise

# ---- Fixed values -------------------------------------------------------------------------------
SYSTEM_TEXT = (
    "The context below was validated beforehand. Use only what these objects state; add nothing to them."
)
SUMMARY_MARK = ',"_summarised":true'


class PolicyViolation(PermissionError):
    pass


# ---- Entities -----------------------------------------------------------------------------------
def entity_schema(kind: str) -> T.StructType:
    return T.StructType(S.ENTITY_BASE.fields + S.ENTITY_KINDS[kind].fields)


def typed_entities(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` as entities of ``kind``. Unknown, missing or wrongly typed columns are refused."""
    if kind not in S.ENTITY_KINDS:
        raise TypeError(f"unknown kind of entity: {kind}")
    expected = {f.name: f.dataType for f in entity_schema(kind).fields}
    actual = {f.name: f.dataType for f in rows.schema.fields}
    if actual != expected:
        odd = sorted(n for n in actual.keys() | expected.keys() if actual.get(n) != expected.get(n))
        raise TypeError(f"columns of {kind} do not fit: {', '.join(odd)}")
    return rows.withColumn("entity_type", F.lit(kind))


def assemble_entities(profiles: DataFrame, notes: DataFrame, goals: DataFrame) -> DataFrame:
    parts = [
        typed_entities(profiles, "participant_profile"),
        typed_entities(notes, "session_note"),
        typed_entities(goals, "goal_record"),
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.select(*S.ENTITY.fieldNames())


def required_fields(kind: str) -> list[str]:
    return S.REQUIRED_BASE_FIELDS + S.REQUIRED_KIND_FIELDS.get(kind, [])


# ---- Scores -------------------------------------------------------------------------------------
_TYPES = {f.name: f.dataType for f in S.ENTITY.fields}


def _present(name: str) -> Column:
    value = F.col(name)
    if isinstance(_TYPES[name], T.StringType):
        return ~is_blank(value)
    if isinstance(_TYPES[name], (T.ArrayType, T.MapType)):
        return value.isNotNull() & (F.size(value) > 0)
    return value.isNotNull()


def _share_present(names: list[str]) -> Column:
    found = reduce(lambda a, b: a + b, [_present(n).cast("int") for n in names])
    return found / F.lit(float(len(names)))


def completeness() -> Column:
    """Share of the required fields that are filled."""
    ratio = None
    for kind in S.ENTITY_KINDS:
        share = _share_present(required_fields(kind))
        is_kind = F.col("entity_type") == kind
        ratio = F.when(is_kind, share) if ratio is None else ratio.when(is_kind, share)
    return ratio.otherwise(_share_present(S.REQUIRED_BASE_FIELDS))


def recency(
    created_at: Column,
    as_of: Column,
    decay_days: float = S.DECAY_DAYS,
    floor: float = S.RECENCY_FLOOR,
) -> Column:
    """1 for a week, then falling in a line to ``floor`` at ``decay_days``."""
    age = age_days(created_at, as_of)
    span = float(decay_days - S.FRESH_DAYS)
    falling = 1.0 - (age - S.FRESH_DAYS) / F.lit(span if span > 0 else 1.0) * (1.0 - floor)
    return F.when(age <= S.FRESH_DAYS, 1.0).when(age >= decay_days, float(floor)).otherwise(
        falling if span > 0 else F.lit(float(floor))
    )


def with_scores(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Recency and priority of measured entities; a record without a date has priority 0."""
    moment = F.col("as_of") if as_of is None else as_of
    age_known = F.col("created_at").isNotNull()
    return rows.withColumn(
        "recency", F.when(age_known, recency(F.col("created_at"), moment))
    ).withColumn(
        "priority", F.coalesce(F.col("confidence") * F.col("recency") * F.col("completeness"), F.lit(0.0))
    )


# ---- Policy -------------------------------------------------------------------------------------
def tier_allowed(mode: Column, tier: Column) -> Column:
    """Whether the mode admits the tier. An unknown mode is an error."""
    known = require_known(mode, list(S.MODE_TIERS), "mode")
    pairs = [(known == m) & tier.isin(tiers) for m, tiers in S.MODE_TIERS.items()]
    return F.coalesce(reduce(lambda a, b: a | b, pairs), F.lit(False))


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests under the column names used below. A request whose mode differs from the mode its policy
    was made for is an error."""
    if "policy_mode" in requests.columns:
        mismatch = ~F.col("policy_mode").eqNullSafe(F.col("mode"))
        message = F.concat(F.lit("mode does not match the policy of request "), F.col("request_id"))
        requests = requests.where(
            F.when(mismatch, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        )
    return requests.select(
        "request_id", F.col("coach_id").alias("requesting_coach"), "mode", _budget().alias("token_budget"), "as_of"
    )


def _budget() -> Column:
    return F.coalesce("token_budget", F.lit(S.TOKEN_BUDGET))


def policy_decisions(candidates: DataFrame, requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Candidates with ``policy_reason``: ok, tier_gate (checked first) or rbac_denied.

    Two equi joins with the small request and grant tables. Neither is hinted: Spark broadcasts them by
    their real size and otherwise sorts and merges, with skewed partitions split.
    """
    granted = (
        grants.select(F.col("coach_id").alias("requesting_coach"), "participant_id")
        .distinct()
        .withColumn("granted", F.lit(True))
    )
    offered = candidates.join(checked_requests(requests), "request_id").join(
        granted, ["requesting_coach", "participant_id"], "left"
    )
    reason = (
        F.when(~tier_allowed(F.col("mode"), F.col("tier")), "tier_gate")
        .when(F.col("granted").isNull(), "rbac_denied")
        .otherwise("ok")
    )
    return offered.withColumn("policy_reason", reason).drop("granted")


def audit_records(decided: DataFrame) -> DataFrame:
    return decided.select(
        "request_id",
        F.col("requesting_coach").alias("coach_id"),
        "mode",
        F.col("id").alias("object_id"),
        "tier",
        (F.col("policy_reason") == "ok").alias("allowed"),
        F.col("policy_reason").alias("reason"),
    )


def unmatched_offers(offers: DataFrame, known: DataFrame, requests: DataFrame) -> DataFrame:
    """Audit rows of offers that no decision can be made for: the record is unknown (or was set aside), or else the
    request is."""
    found = (
        offers.select("request_id", F.col("id").alias("object_id"))
        .join(known.select(F.col("id").alias("object_id"), "tier"), "object_id", "left")
        .join(requests.select("request_id", "coach_id", "mode", F.lit(True).alias("asked")), "request_id", "left")
    )
    reason = F.when(F.col("tier").isNull(), "unknown_record").when(F.col("asked").isNull(), "unknown_request")
    return found.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "request_id", "coach_id", "mode", "object_id", "tier", F.lit(False).alias("allowed"), "reason"
    )


def require_clear(decided: DataFrame) -> DataFrame:
    """Strict mode, after the denials were logged: any denial stops the request."""
    denied = decided.where(F.col("policy_reason") != "ok").select("request_id", "id", "policy_reason").take(1)
    if denied:
        raise PolicyViolation(f"denied: {denied[0].asDict()}")
    return decided


def granted_rows(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows (coach_id, participant_id, …) inside the grants."""
    return rows.join(grants, ["coach_id", "participant_id"], "left_semi")


def ungranted_rows(rows: DataFrame, grants: DataFrame) -> DataFrame:
    return rows.join(grants, ["coach_id", "participant_id"], "left_anti")


# ---- Form and size ------------------------------------------------------------------------------
def _payload_fields(kind: str | None) -> list[str]:
    return S.ENTITY_BASE.fieldNames() + (S.ENTITY_KINDS[kind].fieldNames() if kind else [])


def _as_json(name: str, content: Column) -> Column:
    if name == "content":
        return content.alias(name)
    if isinstance(_TYPES[name], T.TimestampNTZType):
        moment = F.replace(F.col(name).cast("string"), F.lit(" "), F.lit("T"))
        return F.concat(moment, F.lit("Z")).alias(name)
    return F.col(name)


def _json(content: Column) -> Column:
    """JSON of the fields of the entity's own kind, with ``content`` as its text."""
    keep_nulls = {"ignoreNullFields": "false"}
    as_text = lambda kind: F.to_json(
        F.struct(*[_as_json(n, content) for n in _payload_fields(kind)]), keep_nulls
    )
    json = None
    for kind in S.ENTITY_KINDS:
        is_kind = F.col("entity_type") == kind
        json = F.when(is_kind, as_text(kind)) if json is None else json.when(is_kind, as_text(kind))
    return json.otherwise(as_text(None))


def full_payload() -> Column:
    return _json(F.col("content"))


def summary_payload(ratio: float = S.SUMMARY_RATIO) -> Column:
    """The payload with the first words only, marked as summarised."""
    return F.regexp_replace(_json(first_words(F.col("content"), ratio)), r"\}$", SUMMARY_MARK + "}")


def is_full(priority: Column) -> Column:
    return priority >= S.FULL_TEXT_PRIORITY


def estimated_tokens(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / S.CHARS_PER_TOKEN)).cast("bigint")


def least_tokens() -> int:
    """A lower bound of any estimate: the field names and one character per value are always there."""
    names = _payload_fields(None)
    return max(1, (2 + sum(len(n) + 5 for n in names) - 1) // S.CHARS_PER_TOKEN)


def measured(entities: DataFrame, summary_ratio: float = S.SUMMARY_RATIO) -> DataFrame:
    """Entities without their texts: what the scores need, and the size of both forms. Both are taken here,
    in one pass without a shuffle, because the form depends on the request. A tier that no mode admits
    needs no size."""
    short = _json(first_words(F.col("content"), summary_ratio))
    usable = F.col("tier").isin(sorted({t for tiers in S.MODE_TIERS.values() for t in tiers}))
    return entities.select(
        "id",
        "participant_id",
        "created_at",
        "tier",
        "confidence",
        "entity_type",
        completeness().alias("completeness"),
        F.when(usable, F.length(full_payload())).alias("full_chars"),
        F.when(usable, F.length(short) + len(SUMMARY_MARK)).alias("summary_chars"),
    )


# ---- Selection ----------------------------------------------------------------------------------
def scored_candidates(candidates: DataFrame, requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Candidates with scores, size and ``gate``: the reason code of the first gate that closes, or NULL."""
    scored = with_scores(policy_decisions(candidates, requests, grants))
    gate = (
        F.when(F.col("policy_reason") == "tier_gate", "pep_tier_gate")
        .when(F.col("policy_reason") == "rbac_denied", "pep_access_denied")
        .when(F.col("completeness") < S.MIN_COMPLETENESS, "completeness_below_threshold")
    )
    chars = F.when(is_full(F.col("priority")), F.col("full_chars")).otherwise(F.col("summary_chars"))
    return (
        scored.withColumn("gate", gate)
        .withColumn("estimated_tokens", F.when(F.col("gate").isNull(), estimated_tokens(chars)))
        .select(
            "request_id", "ordinal", "id", "entity_type", "tier", "requesting_coach", "mode", "token_budget",
            "completeness", "recency", "priority", "policy_reason", "gate", "estimated_tokens",
        )
    )


def budget_cutoffs(scored: DataFrame, largest_budget: int) -> DataFrame:
    """Per request the sort key (priority, ordinal) of the first record that does not fit, if any.

    A record costs at least ``least_tokens()``, so the cut of a request lies within its first
    ``token_budget / least_tokens() + 1`` records: only these reach one task, however many a request has.
    """
    depth = int(largest_budget) // least_tokens() + 1
    passing = scored.where(F.col("gate").isNull()).select(
        "request_id", "priority", "ordinal", "estimated_tokens", "token_budget"
    )
    # Each request is ranked as deep as its own budget can reach, whatever the largest one is.
    own_depth = F.floor(F.col("token_budget") / least_tokens()) + 1
    first = best_rows(passing, "request_id", [F.desc("priority"), F.asc("ordinal")], depth, own_depth)
    so_far = Window.partitionBy("request_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        first.withColumn("used", F.sum("estimated_tokens").over(so_far))
        .where(F.col("used") > F.col("token_budget"))
        .groupBy("request_id")
        .agg(F.min(F.struct("rank", "priority", "ordinal")).alias("cut"))
        .select("request_id", F.col("cut.priority").alias("cut_priority"), F.col("cut.ordinal").alias("cut_ordinal"))
    )


def selection_decisions(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """``scored`` with ``reason_code``: the one reason why a candidate is left out, NULL if selected."""
    ahead = (F.col("priority") > F.col("cut_priority")) | (
        (F.col("priority") == F.col("cut_priority")) & (F.col("ordinal") < F.col("cut_ordinal"))
    )
    over = F.col("cut_ordinal").isNotNull() & ~ahead
    reason = F.coalesce(F.col("gate"), F.when(over, F.lit("budget_truncation")))
    return (
        scored.join(cuts, "request_id", "left")
        .withColumn("reason_code", reason)
        .withColumn("summarised", F.when(F.col("reason_code").isNull(), ~is_full(F.col("priority"))))
        .drop("cut_priority", "cut_ordinal", "gate")
    )


def largest_budget(requests: DataFrame) -> int:
    return requests.agg(F.max(_budget())).first()[0] or 0


def written(requests: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests and grants as small tables whose size the planner knows, so that it can choose the join."""
    return materialise(requests, "requests"), materialise(grants.distinct(), "grants")


def decide(candidates: DataFrame, requests: DataFrame, grants: DataFrame) -> DataFrame:
    """All candidates with their decision. The scores are written once, so no text is measured twice; the
    cuts (one row per request) are written so that the last join need not move the scores."""
    requests, grants = written(requests, grants)
    scored = materialise(scored_candidates(candidates, requests, grants), "scores")
    cuts = materialise(budget_cutoffs(scored, largest_budget(requests)), "cuts")
    return selection_decisions(scored, cuts)


def context_requests(
    entities: DataFrame,
    decisions: DataFrame,
    requests: DataFrame,
    user_text: str,
    summary_ratio: float = S.SUMMARY_RATIO,
) -> DataFrame:
    """One assembled request per row: fixed system text, JSON list of the selected records, user text, mode.

    The selected records are few (bounded by the budgets); they are written so that the join that fetches
    their texts knows their size. The list per request is bounded by its budget as well.
    """
    selected = materialise(
        decisions.where(F.col("reason_code").isNull()).select("request_id", "ordinal", "id", "priority"), "selected"
    )
    payload = F.when(is_full(F.col("priority")), full_payload()).otherwise(summary_payload(summary_ratio))
    item = F.struct((-F.col("priority")).alias("rank"), "ordinal", payload.alias("payload"))
    lists = (
        entities.join(selected, "id")
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    text = F.concat(
        F.lit("["), F.array_join(F.transform("items", lambda x: x["payload"]), ","), F.lit("]")
    )
    return requests.join(lists, "request_id", "left").select(
        "request_id",
        F.lit(SYSTEM_TEXT).alias("system"),
        F.lit(user_text).alias("user"),
        F.coalesce(text, F.lit("[]")).alias("context"),
        "mode",
        F.coalesce(F.size("items"), F.lit(0)).alias("n_objects"),
    )
