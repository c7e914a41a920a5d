"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in the order of a hash, are cut into blocks of equal length in characters. With integer
weights a_i of sum P, block j (from 0) of source i is released at slot floor(j P / a_i) and due by slot
ceil((j + 1) P / a_i); in every slot the released block with the earliest deadline goes next. For weights that add up
to one this misses no deadline, so after any number of slots each source is less than one block from its share. The
schedule repeats after P slots: one period is folded and every block finds its slot by integer arithmetic.

When a source has no block left, the others go on in a new phase with their own weights, so every document is placed
exactly once: nothing is dropped or repeated to reach the target. There are at most as many phases as sources.

Defined cases: null text counts as empty; a null source is a source of its own; sources without a weight get
``default_weight``; sources with equal deadlines go in the order of their name; repeated rows are placed one by one; an
empty table gives no rows; other columns, also of clashing names, are kept as they are.

Any number of sources is mixed. The driver sees one row per scheduled source and one period of the schedule per phase, bounded by
``MAX_SOURCES`` and ``MAX_PERIOD``: where there are more sources (host names, say), those without a weight of their own are
scheduled as one class, with the sum of their weights and its documents in the order of the hash; if the weights then add up to more
than ``MAX_PERIOD``, all are scaled down to whole numbers. Only weights that a caller gives can be too many or too large, which is an error.
"""

from __future__ import annotations

import json
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trainlake.llm.common import read, spread, text_of

BLOCK_CHARS = 65536
MAX_PERIOD = 20000
MAX_SOURCES = 200
OTHERS = "others"  # no key of a source: these begin with "=", or are "null"
# Rows of a source that one task orders; a source is cut by hash into as many parts as it needs.
PART_ROWS = 4096


def period(spark: SparkSession, weights: list[int]) -> list[int]:
    """The source (by position) of each slot of one period, folded slot by slot: of the released blocks the one that
    is due first."""
    total = sum(weights)
    if min(weights) < 1:
        raise ValueError("weights are whole numbers from 1")
    if total > MAX_PERIOD:
        raise ValueError(f"the weights add up to {total}, more than {MAX_PERIOD}: use a coarser ratio")
    shares = F.array(*[F.lit(w).cast("long") for w in weights])

    def step(state, slot):
        def due(done, i):
            weight = F.element_at(shares, i + 1)
            late = -F.floor(-((done + 1) * total) / weight)  # ceil
            return F.when(F.floor(done * total / weight) <= slot, F.struct(late.alias("due"), i.alias("source")))

        chosen = F.array_min(F.filter(F.transform(state["done"], due), lambda x: x.isNotNull()))["source"]
        return F.struct(
            F.transform(state["done"], lambda n, i: n + F.when(i == chosen, 1).otherwise(0).cast("long")).alias("done"),
            F.concat(state["order"], F.array(chosen)).alias("order"),
        )

    start = F.struct(F.array(*[F.lit(0).cast("long")] * len(weights)).alias("done"), F.array().cast("array<int>").alias("order"))
    slots = F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))
    return spark.range(1).select(F.aggregate(slots, start, step, lambda s: s["order"]).alias("order")).first()["order"]


def phases(spark: SparkSession, blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """One row per phase and source: which of its blocks the phase places, and the slots it has in a period."""
    left, used, first_slot, rows = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    for phase in range(len(blocks)):
        names = sorted(n for n in left if left[n])
        if not names:
            break
        divisor = gcd(*(weights[n] for n in names))
        parts = [weights[n] // divisor for n in names]
        total, order = sum(parts), period(spark, parts)
        places = [[t for t, s in enumerate(order) if s == i] for i in range(len(names))]
        # the phase ends where a source would be asked for a block that it does not have
        end = min(left[n] // p * total + at[left[n] % p] for n, p, at in zip(names, parts, places))
        for n, p, at in zip(names, parts, places):
            taken = end // total * p + sum(t < end % total for t in at)
            rows.append({
                "source_key": n, "phase": phase, "first_block": used[n], "last_block": used[n] + taken - 1,
                "first_slot": first_slot, "share": p, "total": total, "at": at,
            })
            used[n] += taken
            left[n] -= taken
        first_slot += end
    return rows


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows of the driver as a DataFrame."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _amounts(packed: DataFrame, most: int) -> list:
    """Documents and characters of each source, of one source more than ``most`` at most."""
    return packed.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(most + 1).collect()


def _bounded(weights: dict[str, int], grouped: bool) -> dict[str, int]:
    """The weights, scaled down to whole numbers if a class of many sources makes them add up to too much."""
    total = sum(weights.values())
    if not grouped or total <= MAX_PERIOD:
        return weights
    room = MAX_PERIOD - len(weights)
    return {n: max(1, w * room // total) for n, w in weights.items()}


def mixed(
    docs: DataFrame, weights: dict[str | None, int], default_weight: int = 1, source_col: str = "source",
    id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, part_rows: int = PART_ROWS,
    keep: list[str] | None = None, most_sources: int = MAX_SOURCES,
) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it: what is not kept is not moved) packed as ``row``, with source_key, phase, block,
    slot, release, deadline and start: reading by (slot, start) gives the mixture. ``block_chars`` is the length of a block."""
    spark = docs.sparkSession

    def key_of(source):
        return "null" if source is None else f"={source}"

    packed = docs.select(
        F.struct(*(keep or [F.col("*")])).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("source_key"),
        F.length(text_of(text_col)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col)).alias("h1"),
        F.xxhash64(F.col(text_col), F.lit(1)).alias("h2"),
    )
    chosen = {key_of(s): w for s, w in weights.items()}
    found, others = _amounts(packed, most_sources), {}
    if len(found) > most_sources:
        if len(chosen) >= most_sources:
            raise ValueError(f"{len(chosen)} weights, more than {most_sources - 1}: group the sources first")
        own = F.col("source_key").isin(list(chosen))
        others = {OTHERS: default_weight * packed.where(~own).select("source_key").distinct().count()}
        packed = packed.withColumn("source_key", F.when(own, F.col("source_key")).otherwise(OTHERS))
        found = _amounts(packed, most_sources)
    blocks = {r["source_key"]: max(1, spread(r["size"], block_chars)) for r in found}
    plan = phases(spark, blocks, _bounded({n: (chosen | others).get(n, default_weight) for n in blocks}, bool(others)))

    cut = _table(
        spark, [{"source_key": r["source_key"], "parts": spread(r["n"], part_rows), "blocks": blocks[r["source_key"]]} for r in found],
        "source_key string, parts int, blocks long",
    )
    rows = packed.join(F.broadcast(cut), "source_key").withColumn(
        "part", F.pmod(F.shiftrightunsigned("h1", 20), F.col("parts")).cast("int")
    )
    sums = rows.groupBy("source_key", "part").agg(F.sum("size").alias("part_size"))
    along = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_key", "part", F.coalesce(F.sum("part_size").over(along), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source_key", "part").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    started = (
        rows.join(offsets, ["source_key", "part"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("block", F.least(F.expr(f"start div {block_chars}"), F.col("blocks") - 1))
    )
    slots = _table(
        spark, plan,
        "source_key string, phase int, first_block long, last_block long, first_slot long, share long, total long, at array<int>",
    )
    local = F.col("block") - F.col("first_block")
    return (
        started.join(F.broadcast(slots), "source_key")
        .where(F.col("block").between(F.col("first_block"), F.col("last_block")))
        .withColumn("local", local)
        .select(
            "row", "source_key", "phase", "block",
            F.expr("first_slot + (local div share) * total + element_at(at, cast(local % share as int) + 1)").alias("slot"),
            F.expr("first_slot + (local * total) div share").alias("release"),
            F.expr("first_slot + ((local + 1) * total + share - 1) div share").alias("deadline"),
            "start",
        )
    )


# Parts of the mixture by source; every other source gets one part.
TARGET = {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2}


def op8_mixing(spark, sf_dir):
    found = mixed(read(spark, sf_dir, "documents"), TARGET, keep=["doc_id", "source"])
    return found.select("row.doc_id", "row.source", "phase", "block", "slot", "release", "deadline", "start")


def mixing_stage(spark, docs, sf_dir):
    """The documents in the order of the mixture; none is added or lost."""
    return mixed(docs, TARGET).orderBy("slot", "start").select("row.*")
