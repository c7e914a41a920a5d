"""Conversation repair against a search over all edits of each conversation by itself."""

import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from trainlake.llm.common import read
from trainlake.llm.turn_repair import ENDINGS, Repair, damaged, op12_conversation_repair, shared_nodes

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_plan(rows):
    """(cost, audit) of (role initial, fault) rows: the least of all edits."""
    after = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    @cache
    def best(i, s, inserted=0):
        found = []
        if i == len(rows):
            if s in (0, 3):
                found.append((0, ""))
        else:
            initial, fault = rows[i]
            c, a = best(i + 1, s)
            found.append((2 + c, "D" + a))
            if fault in "-t":
                for edit, role, price in (("K", initial, 0), ("R", "u", 1), ("R", "a", 1)):
                    if (role, s) in after:
                        c, a = best(i + 1, after[role, s])
                        found.append((price + 5 * (fault == "t") + c, edit + a))
        if inserted < 3:
            for role in "ua":
                if (role, s) in after:
                    c, a = best(i, after[role, s], inserted + 1)
                    found.append((5 + c, "I" + a))
        return min(found, default=(10**6, ""))

    return best(0, 0)


def brute_damage(rows):
    found = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else text.translate({ord(c): None for c in ".!?"}) if h == 2 else text
        found += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return found


def in_order(rows):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    filled = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], md5(r[2])))


def brute_row(conv, rows):
    seen, faults = set(), []
    rows = in_order(rows)
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    initials = [r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in rows]
    cost, audit = brute_plan(tuple(zip(initials, faults, strict=True)))
    lines, state, i = [], 0, 0
    for edit in audit:
        asked = "assistant" if state == 2 else "user"
        role = rows[i][1] if edit == "K" else asked
        if edit != "D":
            lines.append(f"{role}:" + ("" if edit == "I" else rows[i][2]))
            state = 1 if role[0] == "s" else 2 if role[0] == "u" else 3
        i += edit != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha)


def brute(rows, ids):
    return sorted((brute_row(c, [r for r in rows if r[0] == c]) for c in ids), key=str)


def results(repair):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]
    found = repair.summaries.join(repair.digests(), "key").select(repair.conv_id().alias("conv_id"), *columns)
    return sorted(map(tuple, found.collect()), key=str)


def test_nodes_are_the_suffixes():
    rng = random.Random(3)
    ending = ",".join(map(str, ENDINGS))
    signatures = sorted({"".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(7))) for _ in range(3000)}, key=lambda s: s[::-1])
    built = [0]
    for _, signature, node in shared_nodes([(ending, s) for s in signatures], built):
        rows = tuple((x.lower(), "t" if x.isupper() else "b" if x == "x" else "-") for x in signature)
        assert (node.cost[0], node.audit(0)[0]) == brute_plan(rows)
    assert built[0] == len({s[i:] for s in signatures for i in range(len(s))})


def test_query(spark, data):
    rows = [tuple(r) for r in read(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = op12_conversation_repair(spark, data)
    assert sorted(map(tuple, found.collect()), key=str) == brute(brute_damage(rows), {r[0] for r in rows})


def random_rows(seed, conversations=40, most=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why?", "é 漢.", "Yes. ", "a\x0b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "admin"]
    rows = []
    for conv in [None, *range(conversations)]:
        for _ in range(rng.randrange(1, most)):
            rows.append((conv, rng.choice([None, *range(6), 2**60 + 1, -4]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:5]


@pytest.mark.parametrize("most_rows, most_chars", [(1, 10**6), (3, 10**6), (1024, 10**6), (1024, 5)])
def test_pieces_of_any_size(spark, most_rows, most_chars):
    rows = random_rows(most_rows + most_chars)
    repair = Repair(spark.createDataFrame(rows, SCHEMA), most_rows=most_rows, most_chars=most_chars)
    assert results(repair) == brute(rows, {r[0] for r in rows})


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{i}!", f"{i}."])) for i in range(600)]
    rows += [(1, 5, "user", "the same.")] * 200 + random_rows(2, 5)
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert results(Repair(table, most_rows=16)) == brute(rows, {r[0] for r in rows})


def test_messages_of_the_repair(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "ok."), (1, 3, "user", "And?"), (2, 0, "system", " ")]
    found = Repair(spark.createDataFrame(rows, SCHEMA)).messages().orderBy("conv_id", "place").drop("place").collect()
    assert [tuple(r) for r in found] == [(1, 0, "user", "Hi.", "K"), (1, 3, "assistant", "And?", "R")]


def test_hard_tables(spark, tmp_path):
    extra = spark.createDataFrame(random_rows(4), SCHEMA).withColumns({"key": F.lit(1), "part": F.lit("p"), "faults": F.lit("x"), "salt": F.lit(2)})
    extra = extra.unionByName(spark.createDataFrame([(77, 0, "user", "w " * 200000)], SCHEMA), allowMissingColumns=True)
    extra.write.parquet(str(tmp_path / "conversations.parquet"))
    rows = [tuple(r) for r in extra.select("conv_id", "turn", "role", "text").collect()]
    found = op12_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == brute(brute_damage(rows), {r[0] for r in rows})
    empty = spark.createDataFrame([], SCHEMA)
    assert results(Repair(empty)) == [] and Repair(empty).messages().collect() == [] and damaged(empty).collect() == []
