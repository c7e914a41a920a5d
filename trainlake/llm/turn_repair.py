"""Conversation structure repair by a suffix-shared automaton over role and fault signatures.

The rows of a conversation, by turn, become a signature: one letter per row for its role (s, u, a, or o for any other), a capital
one if the text is truncated, x if the row must go (blank or duplicate). The cheapest edits that turn the roles into
``(s?(ua)+)?`` depend on the signature alone, and what is left to do at a row depends only on the rest of it. So all
conversations are sorted by their reversed signatures and share one automaton, built from the end: each node, a suffix, holds for each
of the four states of the grammar the cost to go and the head of the best rest of the audit, which goes on at the node of the next
suffix. It is computed once for all conversations that end so. Equal costs are told apart by the least letter, and each letter leads to
one state, so the least letter at every node gives the least audit of all.

States: 0 nothing yet (may end), 1 after system, 2 after user, 3 after assistant (may end).

Rows are sorted over all tasks and cut into pieces of at most ``MOST_ROWS`` rows or ``MOST_CHARS`` characters, so that no task holds a whole
long conversation. Nearly every conversation is one piece. Those of several meet again in narrow rows: which texts stood in an earlier
piece (by SHA-256), the costs from each state at the begin of a piece to each at its end (the automaton with one end state at a
time), a fold of these from the last piece, and a fold of the states from the first; both are streams that hold four
numbers. Only the digest of a whole conversation reads its texts in a row, also as a stream.

Defined cases: a null id is a conversation of its own; null role or text counts as one space; null turns come first and count for no gap;
rows of one turn go by role, the first ``TIE_CHARS`` characters of the text and its MD5; an empty role has no initial and is
no role of the grammar; repeated rows are duplicates; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import read, small_batches, some, stored

MOST_ROWS, MOST_CHARS, TIE_CHARS = 1024, 4_000_000, 32
DELETE, INSERT, KEEP_TRUNCATED, REROLE = 2, 5, 5, 1
SALTS = 16

NEVER = 10**9
STATES = range(4)
ENDINGS = [0, NEVER, NEVER, 0]
# What a row of a role does in a state; a user or assistant may stand where the grammar asks for one.
NEXT_ROLE = ["u", "u", "a", "u"]
AFTER = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NAMES = {"u": "user", "a": "assistant"}

_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_PIECE = ["key", "part", "no"]


# ---- The automaton ------------------------------------------------------------------------------
class Node:
    """A suffix: costs to go, and per state the next letter of the audit with where it leads."""

    __slots__ = ("cost", "letter", "state", "rest")

    def __init__(self, cost: list[int], letter: list[str], state: list[int], rest: Node | None) -> None:
        self.cost, self.letter, self.state, self.rest = cost, letter, state, rest
        begin = list(cost)
        for s in (2, 3, 0, 1):  # an insertion stays at this node
            to = AFTER[NEXT_ROLE[s], s]
            by_insertion = INSERT + (cost[2] if s < 2 else begin[to])
            if by_insertion < cost[s] or (by_insertion == cost[s] and letter[s] > "I"):
                cost[s], letter[s], state[s] = by_insertion, "I", to

    def audit(self, s: int) -> tuple[str, int]:
        """The best audit from a state, and the state it ends in."""
        letters, node = [], self
        while node.letter[s]:
            letters.append(node.letter[s])
            node, s = (node if letters[-1] == "I" else node.rest), node.state[s]
        return "".join(letters), s


def end_node(ending: list[int]) -> Node:
    return Node(list(ending), ["", "", "", ""], [0, 0, 0, 0], None)


def before(symbol: str, rest: Node) -> Node:
    """The node of the suffix ``rest`` with one row more in front."""
    cost, letter, state = [DELETE + c for c in rest.cost], ["D"] * 4, list(STATES)
    if symbol != "x":
        role, extra = symbol.lower(), KEEP_TRUNCATED if symbol.isupper() else 0
        for s in STATES:
            for edit, to, price in (("K", AFTER.get((role, s)), extra), ("R", AFTER[NEXT_ROLE[s], s], extra + REROLE)):
                if to is not None and price + rest.cost[to] < cost[s]:
                    cost[s], letter[s], state[s] = price + rest.cost[to], edit, to
    return Node(cost, letter, state, rest)


def shared_nodes(rows: Iterator[tuple[str, str]], built: list[int] | None = None) -> Iterator[tuple[str, str, Node]]:
    """(ending, signature, node of the whole signature) for rows that are sorted by ending and reversed signature. Only
    the suffixes that the row before did not have are computed; ``built`` counts them."""
    ending, backwards, nodes = None, "", []
    for new_ending, signature in rows:
        if new_ending != ending:
            ending, backwards, nodes = new_ending, "", [end_node([int(c) for c in new_ending.split(",")])]
        now, same = signature[::-1], 0
        for x, y in zip(now, backwards, strict=False):
            if x != y:
                break
            same += 1
        del nodes[same + 1 :]
        for symbol in now[same:]:
            nodes.append(before(symbol, nodes[-1]))
            if built is not None:
                built[0] += 1
        backwards = now
        yield ending, signature, nodes[-1]


def solved(tasks: DataFrame) -> DataFrame:
    """(ending, signature, costs, audits, ends) for the distinct rows (ending, signature); arrays have one item per state."""

    def solve(batches):
        rows = ((e, s) for b in batches for e, s in zip(b["ending"], b["signature"], strict=True))
        found = []
        for ending, signature, node in shared_nodes(rows):
            walks = [node.audit(s) for s in STATES]
            found.append((ending, signature, list(node.cost), [w[0] for w in walks], [w[1] for w in walks]))
            if len(found) == 512:
                yield from some(found, names)
                found = []
        yield from some(found, names)

    names = ["ending", "signature", "costs", "audits", "ends"]
    distinct = tasks.select("ending", "signature").distinct()
    order = ["ending", F.reverse("signature")]
    sorted_rows = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInPandas(solve, "ending string, signature string, costs array<long>, audits array<string>, ends array<int>")


# ---- Pieces of conversations --------------------------------------------------------------------
def _prepared(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    def filled(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = messages.select(
        _key(F.col(conv)).alias("key"), F.col(turn).isNotNull().alias("known"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        filled(role).alias("role"), filled(text).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    bare = F.rtrim("text", F.lit(_WHITE))
    fault = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    return rows.withColumns({"fault": fault, "initial": initial})


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("null"))


def _cut(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """One row per piece: key, part, no, edge (the conversation may go on in another piece), n, lo, hi, turns (distinct known
    ones), initials, faults (within the piece), and the rows themselves in arrays."""
    order = ["key", "known", "turn", "role", F.left("text", F.lit(TIE_CHARS)), F.md5(F.col("text").cast("binary")), "salt"]
    names = [*_PIECE, "edge", "n", "lo", "hi", "turns", "initials", "faults", "turn", "roles", "texts"]

    def piece(part, no, edge, key, held):
        seen, faults, turns = set(), [], [t for t in held["turn"] if t is not None]
        for fault, role, text in zip(held["fault"], held["role"], held["text"], strict=True):
            faults.append("d" if fault != "b" and (role, text) in seen else fault)
            seen.add((role, text))
        lo, hi = (str(turns[0]), str(turns[-1])) if turns else (None, None)  # pandas has no whole numbers beside nulls
        return (key, part, no, edge, len(faults), lo, hi, len(set(turns)), "".join(held["initial"]), "".join(faults), held["turn"], held["role"], held["text"])

    def cut(batches):
        def new():
            return {name: [] for name in ("turn", "role", "text", "fault", "initial")}

        found, held, key, part, no, chars, first, split, size = [], new(), None, 0, 0, 0, True, False, 0
        for batch in batches:
            columns = [batch[c].tolist() for c in ("part", "key", "known", "turn", "role", "text", "fault", "initial")]
            for part, k, known, turn, role, text, fault, initial in zip(*columns, strict=True):
                if held["role"] and (k != key or len(held["role"]) >= most_rows or chars >= most_chars):
                    split = split or k == key
                    found.append(piece(part, no, first or split, key, held))
                    no, size, chars, held = no + 1, size + chars, 0, new()
                    if k != key:
                        first, split = False, False
                    if size > most_chars or len(found) >= 256:
                        yield pd.DataFrame(found, columns=names)
                        found, size = [], 0
                key = k
                for name, x in zip(held, (turn if known else None, role, text, fault, initial), strict=True):
                    held[name].append(x)
                chars += len(text)
        if held["role"]:
            found.append(piece(part, no, True, key, held))
        yield from some(found, names)

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ordered = ordered.select("part", "key", "known", "turn", "role", "text", "fault", "initial")
    pieces = ordered.mapInPandas(
        cut,
        "key string, part int, no long, edge boolean, n long, lo string, hi string, turns long, initials string, faults string,"
        " turn array<long>, roles array<string>, texts array<string>",
    )
    return pieces.withColumns({c: F.col(c).cast("long") for c in ("lo", "hi")})


def _signature(initials: Column, faults: Column) -> Column:
    letter = F.zip_with(F.split(initials, ""), F.split(faults, ""), lambda i, f: F.when(f.isin("b", "d"), "x").when(f == "t", F.upper(i)).otherwise(i))
    return F.array_join(letter, "")


def _seen_earlier(pieces: DataFrame) -> DataFrame:
    """(key, part, no, late): the places of rows whose role and text stand in an earlier piece of the conversation."""
    both = F.arrays_zip("roles", "texts")
    marks = F.transform(both, lambda m: F.sha2(F.concat(F.length(m["roles"]), F.lit(":"), m["roles"], m["texts"]).cast("binary"), 256))
    rows = pieces.select(*_PIECE, "faults", F.posexplode(marks).alias("place", "mark")).where("substring(faults, place + 1, 1) <> 'd'")
    where = F.struct("part", "no")
    first = rows.groupBy("key", "mark").agg(F.min(where).alias("first"))
    again = rows.join(first, ["key", "mark"]).where(where > F.col("first"))
    return again.groupBy(*_PIECE).agg(F.collect_list("place").alias("late"))


def _narrow(pieces: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces without their rows but with signatures: those of conversations of one piece, and the others."""
    kept = [*_PIECE, "n", "lo", "hi", "turns", "initials", "faults"]
    one = pieces.join(several, "key", "left_anti").select(*kept)
    more = pieces.where("edge").join(several, "key", "left_semi")
    late = stored(_seen_earlier(more), "seen-earlier")
    marked = more.select(*kept).join(late, _PIECE, "left")
    again = F.transform(
        F.split("faults", ""), lambda f, i: F.when((f != "b") & F.coalesce(F.array_contains("late", i), F.lit(False)), "d").otherwise(f)
    )
    marked = marked.withColumn("faults", F.array_join(again, "")).drop("late")
    return tuple(x.withColumn("signature", _signature(F.col("initials"), F.col("faults"))) for x in (one, marked))


# ---- Conversations of several pieces ------------------------------------------------------------
def _streamed(rows: DataFrame, order: list, fold, schema: str) -> DataFrame:
    """``fold(new, carried, row) -> (carried, result)`` over the rows of each key in order; one row after the other, so
    what a task holds does not grow with a key."""

    def run(batches):
        key, carried = object(), None
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                carried, result = fold(row.key != key, carried, row)
                key = row.key
                if result is not None:
                    found.append(result)
            yield from some(found, names)

    names = [field.strip().split(" ")[0] for field in schema.split(",")]
    return rows.repartition("key").sortWithinPartitions("key", *order).mapInPandas(run, schema)


def _with_endings(more: DataFrame) -> DataFrame:
    """Add to each piece what its end states cost from there on: from the last piece back, through the costs of each piece from each
    state to each other one."""
    unit = F.array(*[F.lit(",".join("0" if t == e else str(NEVER) for t in STATES)) for e in STATES])
    tasks = more.select("signature").distinct().select("signature", F.explode(unit).alias("ending"))
    ways = solved(tasks).groupBy("signature").agg(F.map_from_entries(F.collect_list(F.struct("ending", "costs"))).alias("ways"))
    ways = ways.select("signature", F.flatten(F.transform(unit, lambda e: F.element_at("ways", e))).alias("ways"))

    def fold(new, after, row):
        if new:
            after = ENDINGS
        ending = ",".join(str(int(c)) for c in after)
        now = [min(int(row.ways[4 * e + s]) + after[e] for e in STATES) for s in STATES]
        for s in (2, 3, 0, 1):
            now[s] = min(now[s], INSERT + now[AFTER[NEXT_ROLE[s], s]])
        least = min(now)
        return [min(NEVER, c - least) for c in now], (row.key, row.part, row.no, ending)

    rows = more.select(*_PIECE, "signature").join(ways, "signature")
    endings = _streamed(rows, [F.desc("part"), F.desc("no")], fold, "key string, part int, no long, ending string")
    return more.join(endings, _PIECE)


def _with_begins(rows: DataFrame) -> DataFrame:
    """Add the state in which each piece begins, and what lies between it and the piece before: an illegal pair, the same turn."""

    def fold(new, before_it, row):
        state, initial, turn = (0, None, None) if new else before_it
        illegal = int(not new and initial + row.initials[0] not in ("su", "ua", "au"))
        same = int(turn is not None and turn == row.lo)
        after = (int(row.ends[state]), row.initials[-1], turn if row.hi is None else row.hi)
        return after, (row.key, row.part, row.no, state, illegal, same)

    turns = [F.col(c).cast("string").alias(c) for c in ("lo", "hi")]
    narrow = rows.select(*_PIECE, *turns, "initials", "ends")
    begins = _streamed(narrow, ["part", "no"], fold, "key string, part int, no long, begin int, between long, same long")
    return rows.join(begins, _PIECE)


# ---- Repair -------------------------------------------------------------------------------------
class Repair:
    """The repaired conversations of ``messages``.

    ``summaries``: key, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation.
    ``messages()``: every message that stands after the repair, with its conversation, place, turn, role, text and edit.
    ``digests()``: the SHA-256 of the repaired ``role:text`` lines of each conversation.
    """

    def __init__(
        self, messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
        most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS,
    ) -> None:
        small_batches(messages.sparkSession)
        self._type = messages.schema[conv_col].dataType
        rows = _prepared(messages, conv_col, turn_col, role_col, text_col)
        self._pieces = stored(_cut(rows, most_rows, most_chars), "pieces")
        self._several = stored(self._pieces.where("edge").groupBy("key").count().where("count > 1").select("key"), "several")
        one, more = _narrow(self._pieces, self._several)
        final = ",".join(map(str, ENDINGS))
        one = one.withColumn("ending", F.lit(final))
        if not self._several.isEmpty():
            more = stored(_with_endings(stored(more, "narrow")), "endings")
            solutions = stored(solved(one.select("ending", "signature").unionByName(more.select("ending", "signature"))), "solutions")
            more = _with_begins(self._answered(more, solutions))
        else:
            solutions = stored(solved(one), "solutions")
            more = None
        one = self._answered(one, solutions).withColumns({"begin": F.lit(0), "between": F.lit(0).cast("long"), "same": F.lit(0).cast("long")})
        chosen = one.withColumn("alone", F.lit(True))
        chosen = chosen if more is None else chosen.unionByName(more.withColumn("alone", F.lit(False)))
        at = F.col("begin")
        ended = F.element_at(F.split("ending", ","), F.get("ends", at) + 1).cast("long")
        chosen = chosen.withColumns({"audit": F.get("audits", at), "cost": F.get("costs", at) - ended})
        self._chosen = stored(chosen.drop("audits", "costs", "ends", "ending", "signature"), "chosen")

    @staticmethod
    def _answered(rows: DataFrame, solutions: DataFrame) -> DataFrame:
        """Rows with the solution of their signature. Very many may have the same one, so they are dealt out by a salt."""
        salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(*_PIECE), F.lit(SALTS)).cast("int"))
        return salted.join(solutions.select("*", salts), ["ending", "signature", "salt"]).drop("salt")

    def conv_id(self) -> Column:
        return F.when(F.col("key") != "null", F.expr("substring(key, 2)")).cast(self._type)

    @property
    def summaries(self) -> DataFrame:
        def of(fault):
            return F.sum(F.length("faults") - F.length(F.replace("faults", F.lit(fault), F.lit("")))).cast("long")

        pairs = F.sequence(F.lit(1), F.length("initials") - 1)
        bad = F.size(F.filter(pairs, lambda i: ~F.substr("initials", i, F.lit(2)).isin("su", "ua", "au")))
        inside = F.when(F.length("initials") > 1, bad).otherwise(0)
        audits = F.array_sort(F.collect_list(F.struct("part", "no", "audit")))
        return self._chosen.groupBy("key").agg(
            F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum(F.col("turns") - F.col("same")), F.lit(0)).cast("long").alias("gaps"),
            of("b").alias("blank"), of("d").alias("duplicate"), of("t").alias("truncated"),
            F.sum(inside + F.col("between")).cast("long").alias("illegal"), F.sum("cost").cast("long").alias("cost"),
            F.array_join(F.transform(audits, lambda a: a["audit"]), "").alias("audit"),
        )

    def _applied(self, chosen: DataFrame) -> DataFrame:
        """key, part, no and the repaired rows of the chosen pieces in arrays."""

        def apply(batches):
            for batch in batches:
                found = []
                for row in batch.itertuples(index=False):
                    turns, roles, texts, edits, state, i = [], [], [], [], row.begin, 0
                    for edit in row.audit:
                        if edit == "I":
                            turns.append(None)
                            texts.append("")
                        elif edit != "D":
                            turns.append(row.turn[i])
                            texts.append(row.texts[i])
                        if edit == "K":
                            roles.append(row.roles[i])
                            state = AFTER[row.roles[i][0], state]
                        elif edit != "D":
                            roles.append(NAMES[NEXT_ROLE[state]])
                            state = AFTER[NEXT_ROLE[state], state]
                        if edit != "D":
                            edits.append(edit)
                        i += edit != "I"
                    found.append((row.key, row.part, row.no, turns, roles, texts, edits))
                yield from some(found, names)

        names = [*_PIECE, "turn", "roles", "texts", "edits"]
        turns = F.col("turn").cast("array<string>").alias("turn")
        rows = self._pieces.select(*_PIECE, turns, "roles", "texts").join(chosen.select(*_PIECE, "begin", "audit"), _PIECE)
        schema = "key string, part int, no long, turn array<string>, roles array<string>, texts array<string>, edits array<string>"
        return rows.mapInPandas(apply, schema).withColumn("turn", F.col("turn").cast("array<long>"))

    def messages(self) -> DataFrame:
        each = F.posexplode(F.arrays_zip("turn", "roles", "texts", "edits")).alias("place", "m")
        rows = self._applied(self._chosen).select(self.conv_id().alias("conv_id"), "part", "no", each)
        named = [F.col(f"m.{a}").alias(b) for a, b in (("turn", "turn"), ("roles", "role"), ("texts", "text"), ("edits", "edit"))]
        return rows.select("conv_id", F.struct("part", "no", "place").alias("place"), *named)

    def digests(self) -> DataFrame:
        lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
        body = F.array_join(lines, "\n").alias("body")
        one = self._applied(self._chosen.where("alone")).select("key", body).select("key", F.sha2(F.col("body").cast("binary"), 256).alias("digest"))
        if self._several.isEmpty():
            return one

        def fold(new, digest, row):
            begun, digest = (False, hashlib.sha256()) if new else digest
            if row.lines:
                digest.update((("\n" if begun else "") + row.body).encode("utf-8", "surrogatepass"))
            return (begun or row.lines > 0, digest), (row.key, digest.hexdigest()) if row.last else None

        more = self._applied(self._chosen.where("NOT alone")).select(*_PIECE, body, F.size("roles").alias("lines"))
        last = self._chosen.where("NOT alone").groupBy("key").agg(F.max(F.struct("part", "no")).alias("end"))
        more = more.join(last, "key").withColumn("last", F.struct("part", "no") == F.col("end")).drop("end")
        return one.unionByName(_streamed(more, ["part", "no"], fold, "key string, digest string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults planted by the hash of their id and turn."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20).alias("h")
    )
    h = F.col("h")
    return rows.where(h != 0).select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(h == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    conversations = read(spark, sf_dir, "conversations")
    repair = Repair(damaged(conversations))
    ids = conversations.select("conv_id", _key(F.col("conv_id")).alias("key")).distinct()
    found = ids.join(repair.summaries, "key", "left").join(repair.digests(), "key", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
