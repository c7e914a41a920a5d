"""Language-model scoring from a log-frequency Bloom filter.

Counts of all n-grams of the training texts are gathered over the cluster and quantised: level j stands for at least
m b**(j - 1) occurrences. An n-gram of level j is entered with the levels 1 to j, and a scorer asks for level after level
until one is missing. The filter is built by segments of the hash, each by one task, and asked there: it is never whole in
one place. Texts are dealt to chunks of about ``chunk_tokens`` tokens; a chunk sends each of its distinct n-grams once to the
segment, with its training count in the chunk, and gets back one level for each, in the same order.

The filter holds every n-gram that occurs twice or more in training (``LEAST``, part of the model), whatever the size of the
corpus. Words that are broadcast with their exact counts for the base score have at least ``frequent_share`` of all training
tokens N, so there are 1 / frequent_share at most; all other words are counted by a join.

Probability of a word c after a, b, with counts read from the filter: p1 = count(c) / N, or the mean count of the words
that the filter does not hold, over N; p2 = (1 - w) p1 + w count(b c) / count(b) if b is held, else p1; p3 = (1 - w) p2 +
w count(a b c) / count(a b) if a b is held, else p2. Ratios are at most 1.

Defined cases: null text counts as empty and has one token, the end; a null id counts as training; repeated rows are
scored and counted one by one; an empty table gives no rows; without training texts N is 0 and nothing is known; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import discard, read, setting, small_batches, some, stored, text_of
from trainlake.llm.textkit import mix, runs, slices, word_hashes

ORDER = 3
LEAST = 2
FREQUENT_SHARE = 5e-7
LEVEL_BASE = 1.4
BITS_PER_ENTRY = 16
HISTORY_WEIGHT = 0.1
CHUNK_TOKENS = 1_000_000

END = b"\xff"  # no UTF-8 text holds this byte
_FLUSH_WORDS = 400_000
_SLICE_BYTES = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def tokens(text: str) -> list[bytes]:
    """Words between white space, A-Z in lower case, and one end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def _lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() + b" " + END


# ---- Counts -------------------------------------------------------------------------------------
def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, summed within each task first."""

    def count(batches):
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(tokens(text))
                if len(found) >= _FLUSH_WORDS:
                    yield from some(list(found.items()), ["word", "n"])
                    found = Counter()
        yield from some(list(found.items()), ["word", "n"])

    return texts.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ngram_keys(texts: list[bytes], order: int, segments: int) -> list[np.ndarray]:
    """For each n from 1: the key of the n-gram that ends at each token, 0 where the text has too few before."""
    words, offsets = word_hashes(texts)
    place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    found = []
    for n in range(1, order + 1):
        keys = np.zeros(len(words), dtype=np.uint64)
        hashed = runs(words, n)
        segment = (hashed >> np.uint64(32)) % np.uint64(segments)
        keys[n - 1 :] = (segment << np.uint64(32)) | (hashed & _LOW)
        keys[place < n - 1] = 0
        found.append(keys)
    return found


def in_chunks(texts: DataFrame, chunk_tokens: int) -> DataFrame:
    """(doc_id, text, held_out, learn) with n_tokens, chunk (neighbours of about ``chunk_tokens`` tokens; a longer text is one by itself) and the row in it."""

    def deal(batches):
        chunk, size, row = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            sizes, places = [len(_lower(t).split()) for t in batch["text"]], []
            for n in sizes:
                if size and size + n > chunk_tokens:
                    chunk, size, row = chunk + 1, 0, 0
                places.append((chunk, row))
                size, row = size + n, row + 1
            chunks, rows = zip(*places) if places else ((), ())
            yield batch.assign(n_tokens=sizes, chunk=chunks, row=rows)

    return texts.mapInPandas(deal, "doc_id string, text string, held_out boolean, learn boolean, n_tokens long, chunk long, row long")


def _sliced_keys(lowered: list[bytes], order: int, segments: int) -> list[list[np.ndarray]]:
    return [ngram_keys(lowered[a:b], order, segments) for a, b in slices([len(t) for t in lowered], _SLICE_BYTES)]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, dtype=np.int64)


def _order(keys: np.ndarray, key_bits: int) -> np.ndarray:
    """The places of the keys in ascending order. Key and place are sorted as one number, which is much faster than argsort;
    where both do not fit, range by range of the keys."""
    place_bits = len(keys).bit_length()
    spare = np.uint64(key_bits - max(0, key_bits + place_bits - 64))
    rest, width, found = (np.uint64(1) << spare) - np.uint64(1), np.uint64(place_bits), []
    for top in range(1 << (key_bits - int(spare))):
        at = np.flatnonzero(keys >> spare == top).astype(np.uint64)
        packed = np.sort(((keys[at] & rest) << width) | at)
        found.append((packed & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64))
    return np.concatenate(found)


def _steps(prints: np.ndarray) -> bytes:
    """Ascending numbers as differences, all lowest bytes first and all highest last: those are mostly 0 and compress well."""
    return np.diff(prints, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_steps(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _question(chunk: int, first: int, lowered: list[bytes], learn: list[bool], order: int, segments: int) -> pd.DataFrame:
    """The distinct n-grams of some neighbours of a chunk, one row per segment: 32-bit fingerprints in order (``_steps``), their
    training counts in a byte each, and those counts that need more."""
    one = np.uint64(1)
    flagged = []  # keys with whether they are learnt in the lowest bit: one sort brings all of a key together
    for flag in (False, True):
        for part in _sliced_keys([t for t, x in zip(lowered, learn) if x == flag], order, segments):
            flagged += [(k[k != 0] << one) | np.uint64(flag) for k in part]
    flagged = np.sort(np.concatenate(flagged))
    starts = _starts(flagged >> one)
    found = flagged[starts] >> one
    counts = np.add.reduceat((flagged & one).astype(np.int64), starts) if len(starts) else np.empty(0, dtype=np.int64)
    del flagged
    limits = np.searchsorted(found, np.arange(segments + 1, dtype=np.uint64) << np.uint64(32))
    prints, small, rows = (found & _LOW).astype(np.uint32), np.minimum(counts, 255).astype(np.uint8), []
    for segment in range(segments):
        part = slice(limits[segment], limits[segment + 1])
        if part.start < part.stop:
            large = counts[part][small[part] == 255]
            rows.append((segment, chunk, first, _steps(prints[part]), small[part].tobytes(), large.tobytes()))
    return pd.DataFrame(rows, columns=["segment", "chunk", "first", "prints", "counts", "large"])


def _entry_levels(counts: np.ndarray, least: int, base: float) -> np.ndarray:
    levels = np.floor(np.log(np.maximum(counts, 1) / least) / math.log(base) + 1e-9).astype(np.int64) + 1
    return np.where(counts >= least, levels, 0)


def ngram_levels(chunks: DataFrame, order: int, segments: int, least: int, base: float, bits: int) -> DataFrame:
    """(chunk, first, segment, levels): what the filter says of the distinct n-grams of each stretch of a chunk that one task
    read, which begins with row ``first``; a byte each, in the order of the fingerprints."""

    def ask(batches):
        chunk, first, lowered, learn = None, 0, [], []
        for batch in batches:
            for text, flag, of, row in zip(batch["text"], batch["learn"], batch["chunk"], batch["row"]):
                if of != chunk or row != first + len(lowered):
                    if lowered:
                        yield _question(chunk, first, lowered, learn, order, segments)
                    chunk, first, lowered, learn = of, row, [], []
                lowered.append(_lower(text))
                learn.append(flag)
        if lowered:
            yield _question(chunk, first, lowered, learn, order, segments)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        prints = [_from_steps(x) for x in group["prints"]]
        counts = np.frombuffer(b"".join(group["counts"]), dtype=np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(b"".join(group["large"]), dtype=np.int64)
        joined = np.concatenate(prints).astype(np.uint64)
        order_of = _order(joined, 32)
        joined = joined[order_of]
        starts = _starts(joined)
        total = np.add.reduceat(counts[order_of], starts)
        keys = (np.uint64(group["segment"].iloc[0]) << np.uint64(32)) | joined[starts]
        reader = CountFilter({0: filled(keys, _entry_levels(total, least, base), bits)}, 1, least, base)
        levels = np.empty(len(joined), dtype=np.uint8)
        levels[order_of] = np.repeat(reader.levels(keys, np.zeros(len(keys), dtype=np.int64)).astype(np.uint8), np.diff(starts, append=len(joined)))
        ends = np.cumsum([len(p) for p in prints])
        answers = [levels[end - len(p) : end].tobytes() for p, end in zip(prints, ends)]
        return pd.DataFrame({"chunk": group["chunk"], "first": group["first"], "segment": group["segment"], "levels": answers})

    asked = chunks.select("text", "learn", "chunk", "row").mapInPandas(
        ask, "segment int, chunk long, first long, prints binary, counts binary, large binary"
    )
    return asked.groupBy("segment").applyInPandas(answer, "chunk long, first long, segment int, levels binary")


def filled(keys: np.ndarray, levels: np.ndarray, bits: int) -> bytes:
    """The block of a segment: every key entered with the levels from 1 to its own."""
    block = np.zeros(max(1, -(-int(levels.sum()) * bits // 64)), dtype=np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, mask = _place(keys[levels >= level], level, np.uint64(len(block)))
        np.bitwise_or.at(block, at, mask)
    return block.tobytes()


def _place(keys: np.ndarray, level: int, size) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit cell of an entry within its segment, and its four bits there."""
    h = mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 % 2**64))
    one, low = np.uint64(1), np.uint64(63)
    mask = one << (h & low)
    for shift in (6, 12, 18):
        mask |= one << ((h >> np.uint64(shift)) & low)
    return ((h >> np.uint64(24)) % size).astype(np.int64), mask


class CountFilter:
    """Reads quantised counts back by repeated membership probes."""

    def __init__(self, blocks: dict[int, bytes], segments: int, least: int, base: float):
        self.sizes = np.ones(segments, dtype=np.uint64)
        self.least = least
        parts, self.starts = [], np.zeros(segments, dtype=np.int64)
        total = 0
        for segment in range(segments):
            part = np.frombuffer(blocks.get(segment, bytes(8)), dtype=np.uint64)
            self.starts[segment], self.sizes[segment] = total, len(part)
            total += len(part)
            parts.append(part)
        self.cells = np.concatenate(parts)
        # the count that a level stands for: the middle of its whole numbers
        edges = [max(least, math.ceil(least * base**j - 1e-9)) for j in range(130)]
        self.counts = np.array([0.0] + [(a + max(a, b - 1)) / 2 for a, b in zip(edges, edges[1:])])

    def levels(self, keys: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """The level of every key (0: not held) in the block of its segment."""
        levels = np.zeros(len(keys), dtype=np.int64)
        alive = np.arange(len(keys))
        for level in range(1, len(self.counts)):
            if not len(alive):
                break
            segment = segments[alive]
            at, mask = _place(keys[alive], level, self.sizes[segment])
            alive = alive[(self.cells[self.starts[segment] + at] & mask) == mask]
            levels[alive] = level
        return levels


# ---- Scores -------------------------------------------------------------------------------------
def smoothed(counts: list[np.ndarray], place: np.ndarray, total: int, rest: float, weight: float) -> np.ndarray:
    """The probability of every token from the counts of the n-grams that end at it (in order of n) and its place in
    its text."""
    p = np.where(counts[0] > 0, counts[0], rest) / max(total, 1)
    for n in range(1, len(counts)):
        history = np.zeros(len(p))
        history[1:] = counts[n - 1][:-1]
        begun = (history > 0) & (place >= n)
        ratio = np.minimum(1.0, counts[n] / np.where(begun, history, 1.0))
        p = np.where(begun, (1 - weight) * p + weight * ratio, p)
    return np.minimum(p, 1.0)


def lm_scores(
    docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
    frequent_share: float = FREQUENT_SHARE, base: float = LEVEL_BASE, bits: int = BITS_PER_ENTRY, weight: float = HISTORY_WEIGHT,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``is_training`` is an
    expression over doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    texts = texts.withColumn("held_out", ~is_training)
    # Ids are text in the tasks, as pandas has no whole numbers beside nulls.
    texts = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out", F.coalesce(~F.col("held_out"), F.lit(False)).alias("learn"))
    with setting(spark, "spark.sql.parquet.compression.codec", "zstd"):
        chunks = stored(in_chunks(texts, chunk_tokens), "chunks")

    counts = stored(word_counts(chunks.where("learn").select("text")), "word-counts")
    row = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = row["n"] or 0, row["v"]
    pruned = counts.where(F.col("n") < LEAST).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    rest = ((pruned["n"] or 0) + 0.5) / (pruned["v"] + 1)
    frequent_least = max(2, math.ceil(total * frequent_share))
    frequent = {bytes(r["word"]): r["n"] for r in counts.where(F.col("n") >= frequent_least).collect()}
    shared = spark.sparkContext.broadcast(frequent)
    divisor = total + 0.5 * (distinct + 1)

    all_tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    segments = 1 << max(4, math.ceil(math.log2(max(1, all_tokens * order / 2_000_000))))
    answers = stored(ngram_levels(chunks, order, segments, LEAST, base, bits), "levels")
    stands_for = CountFilter({}, 1, LEAST, base).counts

    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known = shared.value
        log_base = np.array([math.log10((n + 0.5) / divisor) for n in known.values()])
        index = dict(zip(known, range(len(known))))
        rows, answers = rows.sort_values("row", ignore_index=True), answers.sort_values(["first", "segment"])
        firsts, found = sorted({0, *answers["first"]}), []
        for first, last in zip(firsts, [*firsts[1:], len(rows)]):
            part = rows.iloc[first:last]
            lowered = [_lower(t) for t in part["text"]]
            sliced = _sliced_keys(lowered, order, segments)
            sizes = [len(k) for keys in sliced for k in keys]
            asked = np.concatenate([k for keys in sliced for k in keys])
            del sliced
            order_of = _order(asked, 32 + (segments - 1).bit_length())
            asked = asked[order_of]
            starts = _starts(asked)
            answered = np.zeros(len(starts), dtype=np.uint8)
            answered[asked[starts] != 0] = np.frombuffer(b"".join(answers["levels"][answers["first"] == first]), dtype=np.uint8)
            levels = np.empty(len(asked), dtype=np.uint8)
            levels[order_of] = np.repeat(answered, np.diff(starts, append=len(asked)))
            of_keys = np.split(levels, np.cumsum(sizes)[:-1])
            del asked, order_of, starts
            for i, (a, b) in enumerate(slices([len(t) for t in lowered], _SLICE_BYTES)):
                seen_counts = [stands_for[x] for x in of_keys[order * i : order * (i + 1)]]
                found.append(scored_slice(part.iloc[a:b], lowered[a:b], seen_counts, index, log_base))
        return pd.concat(found, ignore_index=True)

    def scored_slice(part, lowered, seen_counts, index, log_base) -> pd.DataFrame:
        lists = [t.split() for t in lowered]
        sizes = np.array([len(x) for x in lists])
        owner = np.repeat(np.arange(len(lists)), sizes)
        at = np.fromiter(map(index.get, chain.from_iterable(lists), repeat(-1)), dtype=np.int64, count=int(sizes.sum()))
        seen = at >= 0
        rare: list[list[bytes]] = [[] for _ in lists]
        starts = np.cumsum(sizes) - sizes
        for i in np.flatnonzero(~seen):
            rare[owner[i]].append(lists[owner[i]][i - starts[owner[i]]])
        p = smoothed(seen_counts, np.arange(len(at)) - starts[owner], total, rest, weight)
        log_seen = np.zeros(len(at))
        log_seen[seen] = log_base[at[seen]]
        return pd.DataFrame({
            "doc_id": part["doc_id"].to_numpy(),
            "held_out": part["held_out"].to_numpy(),
            "n_tokens": sizes,
            "n_frequent": np.bincount(owner, weights=seen, minlength=len(lists)).astype(np.int64),
            "base_frequent": np.bincount(owner, weights=log_seen, minlength=len(lists)),
            "score": np.bincount(owner, weights=np.log10(p), minlength=len(lists)),
            "rare": rare,
        })

    schema = "doc_id string, held_out boolean, n_tokens long, n_frequent long, base_frequent double, score double, rare array<binary>"
    together = chunks.select("chunk", "row", "doc_id", "text", "held_out").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    scored = stored(together.applyInPandas(score, schema).withColumn("place", F.monotonically_increasing_id()), "scores")
    discard(chunks)
    discard(answers)
    rare = scored.select("place", F.explode("rare").alias("word"))
    uncommon = counts.where(F.col("n") < frequent_least)
    count = F.coalesce(F.col("n"), F.lit(0))
    of_rare = (
        rare.join(uncommon, "word", "left")
        .groupBy("place")
        .agg(F.sum((count > 0).cast("long")).alias("n_rare"), F.sum(F.log10((count + 0.5) / F.lit(divisor))).alias("base_rare"))
    )
    return scored.drop("rare").join(of_rare, "place", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_frequent") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        "score",
    )


def in_training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != 1


def op10_lm_scoring(spark, sf_dir):
    return lm_scores(read(spark, sf_dir, "documents"), in_training(F.col("doc_id")))
