import json
import random
from datetime import datetime, timedelta

import pytest
from helpers import by_id, entity, now, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.operators import context

AS_OF = datetime(2024, 1, 28)
REQUEST = S.struct(
    "request_id STRING, coach_id STRING, mode STRING, policy_mode STRING, token_budget INT, as_of TIMESTAMP_NTZ"
)


def requests(spark, *items):
    base = {"request_id": "r", "coach_id": "c1", "mode": "exploration", "token_budget": 4000, "as_of": AS_OF}
    table = []
    for item in items or ({},):
        row = {**base, **item}
        row.setdefault("policy_mode", row["mode"])
        table.append(tuple(row[n] for n in REQUEST.fieldNames()))
    return spark.createDataFrame(table, REQUEST)


def grants(spark, *pairs):
    return spark.createDataFrame(pairs or [("c1", "p1")], "coach_id string, participant_id string")


def candidates(entities, request="r"):
    return context.measured(entities).withColumn("request_id", F.lit(request)).withColumn(
        "ordinal", F.row_number().over(Window.orderBy("id")).cast("bigint")
    )


def scores(entities):
    return by_id(context.with_scores(context.measured(entities), now()), "id")


def test_required_fields():
    assert set(context.required_fields("participant_profile")) == {"id", "participant_id", "created_at", "tier", "content", "display_name"}
    assert {"session_date", "coach_id"} < set(context.required_fields("session_note"))
    assert "goal_text" in context.required_fields("goal_record")


@pytest.mark.parametrize(
    "age, weight",
    [(0, 1.0), (5, 1.0), (7, 1.0), (18, 1 - 11 / 23 * 0.5), (29.999, 0.5), (30, 0.5), (365, 0.5), (-3, 1.0)],
)
def test_recency(one, age, weight):
    created = F.lit(str(AS_OF - timedelta(days=age))).cast("timestamp_ntz")
    assert one(context.recency(created, now())) == pytest.approx(weight, abs=1e-4)


def test_recency_parameters(one):
    created = F.lit(str(AS_OF - timedelta(days=365))).cast("timestamp_ntz")
    assert one(context.recency(created, now(), 60, 0.2)) == 0.2
    tenth = F.lit(str(AS_OF - timedelta(days=10))).cast("timestamp_ntz")
    assert one(context.recency(tenth, now(), 7, 0.2)) == 0.2  # no room between fresh and old


def test_completeness(spark):
    found = scores(
        entity(
            spark,
            {"id": "full"}, {"id": "blank", "content": " \n "}, {"id": "gone", "display_name": None},
            {"id": "note", "entity_type": "session_note", "coach_id": "", "content": None},
            {"id": "goal", "entity_type": "goal_record"}, {"id": "other", "entity_type": "workout", "content": ""},
        )
    )
    expected = {"full": 1, "blank": 5 / 6, "gone": 5 / 6, "note": 5 / 7, "goal": 1, "other": 4 / 5}
    assert {k: r.completeness for k, r in found.items()} == pytest.approx(expected)


def test_priority_is_the_product(spark):
    found = scores(
        entity(
            spark, {"id": "a", "confidence": 0.8, "created_at": AS_OF - timedelta(days=18), "content": ""},
            {"id": "b", "confidence": None}, {"id": "c", "created_at": None},
        )
    )
    assert found["a"].priority == pytest.approx(0.8 * (1 - 11 / 23 * 0.5) * 5 / 6)
    assert (found["b"].priority, found["c"].priority) == (0.0, 0.0)


def policy(spark, entities, pairs=(), **request):
    decided = context.policy_decisions(candidates(entities), requests(spark, request), grants(spark, *pairs))
    return {r.object_id: (r.allowed, r.reason) for r in context.audit_records(decided).collect()}


def test_policy(spark):
    table = entity(
        spark, {"id": "g"}, {"id": "s", "tier": "silver"}, {"id": "b", "tier": "bronze"},
        {"id": "x", "participant_id": "p9"}, {"id": "bx", "tier": "bronze", "participant_id": "p9"},
    )
    ok, tier, access = (True, "ok"), (False, "tier_gate"), (False, "rbac_denied")
    assert policy(spark, table) == {"g": ok, "s": ok, "b": tier, "x": access, "bx": tier}
    assert policy(spark, table, mode="execution") == {"g": ok, "s": tier, "b": tier, "x": access, "bx": tier}
    assert policy(spark, table, coach_id="stranger")["g"] == access
    assert policy(spark, table, pairs=[("c1", "p1"), ("c1", "p1"), ("c1", "p9")])["x"] == ok


def test_unknown_mode_and_mode_mismatch_are_errors(spark):
    with pytest.raises(Exception, match="unknown mode: dreaming"):
        policy(spark, entity(spark), mode="dreaming")
    with pytest.raises(Exception, match="does not match the policy"):
        policy(spark, entity(spark), mode="execution", policy_mode="exploration")


def test_strict_mode(spark):
    table = entity(spark, {"id": "g"}, {"id": "b", "tier": "bronze"})
    decide = lambda t: context.policy_decisions(candidates(t), requests(spark), grants(spark))
    with pytest.raises(context.PolicyViolation, match="tier_gate"):
        context.require_clear(decide(table))
    assert context.require_clear(decide(table.where("id = 'g'"))).count() == 1


def select(spark, entities, **request):
    asked = requests(spark, request)
    decisions = context.decide(candidates(entities), asked, grants(spark))
    assembled = context.context_requests(entities, decisions, asked, "next?").first()
    return {r.id: r for r in decisions.collect()}, assembled


def test_order_form_and_context(spark):
    words = " ".join(f"w{i}" for i in range(200))
    decisions, assembled = select(
        spark,
        entity(spark, {"id": "low", "confidence": 0.5, "content": words}, {"id": "high", "content": words},
               {"id": "edge", "confidence": 0.85, "content": words}),
    )
    objects = json.loads(assembled.context)
    assert [o["id"] for o in objects] == ["high", "edge", "low"]
    assert objects[0]["content"] == words and "_summarised" not in objects[1]
    assert objects[2]["_summarised"] is True and objects[2]["content"].split() == words.split()[:60]
    assert set(objects[0]) == set(context.entity_schema("participant_profile").fieldNames())
    assert (decisions["low"].summarised, decisions["edge"].summarised) == (True, False)
    assert (assembled.mode, assembled.user, assembled.n_objects) == ("exploration", "next?", 3)


def test_nothing_selected(spark):
    _, assembled = select(spark, entity(spark, {"tier": "bronze"}))
    assert (assembled.context, assembled.n_objects) == ("[]", 0)


def test_every_exclusion_has_the_first_reason(spark):
    bare = {"participant_id": "", "created_at": None, "content": "", "display_name": None}
    decisions, _ = select(
        spark,
        entity(spark, {"id": "ok"}, {"id": "bronze bare", "tier": "bronze", **bare}, {"id": "bare", **bare},
               {"id": "half", "created_at": None, "content": "", "display_name": None}),
    )
    assert {k: r.reason_code for k, r in decisions.items()} == {
        "ok": None, "bronze bare": "pep_tier_gate", "bare": "pep_access_denied", "half": None
    }
    granted = context.decide(candidates(entity(spark, {"id": "bare", **bare})), requests(spark), grants(spark, ("c1", "")))
    assert granted.first().reason_code == "completeness_below_threshold"


def test_budget_cut_is_final(spark):
    """After the first record that does not fit, smaller ones are left out too; equal fits."""
    table = entity(
        spark, {"id": "a", "confidence": 1.0, "content": "x" * 400}, {"id": "b", "confidence": 0.95, "content": "y" * 4000},
        {"id": "c", "confidence": 0.9, "content": "z"},
    )
    tokens = {k: r.full_chars // 4 for k, r in by_id(context.measured(table), "id").items()}
    reasons = lambda budget: [d.reason_code for _, d in sorted(select(spark, table, token_budget=budget)[0].items())]
    cut = "budget_truncation"
    assert reasons(tokens["a"] + tokens["c"]) == [None, cut, cut]
    assert reasons(tokens["a"] + tokens["b"]) == [None, None, cut]
    assert reasons(tokens["a"] + tokens["b"] - 1) == [None, cut, cut]
    assert reasons(sum(tokens.values())) == [None, None, None]
    assert reasons(tokens["a"] - 1) == [cut, cut, cut]


def test_least_tokens_is_a_lower_bound(spark):
    empty = {n: None for n in S.ENTITY.fieldNames()}
    table = spark.createDataFrame(
        [tuple({**empty, "tier": "gold", "entity_type": kind}.get(n) for n in S.ENTITY.fieldNames())
         for kind in [*S.ENTITY_KINDS, "workout"]], S.ENTITY,
    )
    for row in context.measured(table).collect():
        assert row.full_chars // 4 >= context.least_tokens() > 10


@pytest.mark.parametrize("seed", range(3))
def test_budget_cut_equals_a_plain_loop(spark, seed):
    """Many records with equal priorities in several partitions, against a loop over the sorted list."""
    generator = random.Random(seed)
    table = [
        (f"r{generator.choice([0, 0, 0, 1, 2])}", i, generator.choice([0.5, 0.7, 0.9]), generator.randint(19, 400), budget)
        for i in range(1500) for budget in [None]
    ]
    budgets = {"r0": 4000, "r1": 300, "r2": 10}
    scored = spark.createDataFrame(
        [(r, i, p, t, budgets[r]) for r, i, p, t, _ in table],
        "request_id string, ordinal long, priority double, estimated_tokens long, token_budget int",
    ).repartition(9).withColumn("gate", F.lit(None).cast("string"))
    decided = context.selection_decisions(scored, context.budget_cutoffs(scored, 4000))
    found = {(r.request_id, r.ordinal) for r in decided.where("reason_code IS NULL").collect()}
    expected = set()
    for request, budget in budgets.items():
        used = 0
        for r, i, _, tokens, _ in sorted((x for x in table if x[0] == request), key=lambda x: (-x[2], x[1])):
            used += tokens
            if used > budget:
                break
            expected.add((r, i))
    assert found == expected and decided.count() == 1500


def test_typed_entities(spark):
    table = entity(spark)
    profile = table.select(*context.entity_schema("participant_profile").fieldNames())
    assert context.typed_entities(profile, "participant_profile").first().entity_type == "participant_profile"
    with pytest.raises(TypeError, match="display_name"):
        context.typed_entities(profile.drop("display_name"), "participant_profile")
    with pytest.raises(TypeError, match="extra"):
        context.typed_entities(profile.withColumn("extra", F.lit(1)), "participant_profile")
    with pytest.raises(TypeError, match="confidence"):
        context.typed_entities(profile.withColumn("confidence", F.lit("high")), "participant_profile")
    with pytest.raises(TypeError, match="unknown kind"):
        context.typed_entities(profile, "workout")


def test_access_joins(spark):
    table = spark.createDataFrame([("c1", "p1"), ("c1", "p2"), ("c2", "p1")], "coach_id string, participant_id string")
    assert rows(context.granted_rows(table, grants(spark))) == [("c1", "p1")]
    assert rows(context.ungranted_rows(table, grants(spark))) == [("c1", "p2"), ("c2", "p1")]
