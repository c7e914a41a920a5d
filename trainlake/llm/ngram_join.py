"""Jaccard join of documents on word n-grams by MinHash banding.

Texts with equal words in equal order are one class, so exact copies never meet each other. Each class gets a MinHash
signature of bands x rows; both numbers follow from the similarity and the recall asked for (``banding``). Signatures
are shuffled on band hashes. A bucket whose n-gram sets exceed ``BLOCK_BYTES`` is cut into blocks, and pairs of blocks are
compared, so a bucket of any size is spread over tasks of bounded memory; smaller ones stay whole and are moved once. Of all buckets that a pair shares, only the first counts, so a pair is verified once, on the full
n-gram sets, which are sent just to the buckets that need them. A task returns, for each class, the number of its
links and one edge of a spanning forest: no list of all pairs exists anywhere. Connected classes are one group.

Defined cases: null text counts as empty; equal texts (also empty ones) are one class; a text shorter than an n-gram is
one n-gram; a null id is larger than any other; repeated rows are copies of each other; an empty table gives no rows;
other columns are not read, and kept by the stage.
"""

from __future__ import annotations

import ctypes
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainlake.llm.common import components, read, small_batches, some, stored, text_of, whole_groups
from trainlake.llm.textkit import mix, runs, slices, word_hashes

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
MAX_HASHES = 128
# Python workers outlive a stage. Arrays above this size are given back to the system when freed, not kept by the allocator of the
# worker (glibc raises its own limit to 32 MB).
_M_MMAP_THRESHOLD, _MAPPED_BYTES = -3, 1 << 18
try:
    ctypes.CDLL("libc.so.6").mallopt(_M_MMAP_THRESHOLD, _MAPPED_BYTES)
except OSError:  # another C library
    pass

BLOCK_BYTES = 32 << 20
# In the pipeline the workers of other stages are still in memory, so its tasks hold smaller blocks; the pairs are the same.
STAGE_BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 16384

_SLICE_BYTES = 1 << 20
_GROUP = ["bucket", "low", "high"]
_TILE = 512  # members of a group that are compared at once with as many others


def banding(similarity: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective bands with which a pair of just this similarity shares a bucket with
    probability ``recall``, from at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        chance = similarity**rows
        bands = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log(1 - chance))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best


def _words(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _class_key(words: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(words.split()), digest_size=16).digest()


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    return runs(words, min(n, len(words))) if len(words) else words


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text) to (doc_id, class_key, n_grams, buckets): one bucket for each band, none for texts without words."""
    generator = np.random.default_rng(20240601)
    multiplier = generator.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    offset = generator.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def sign(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        hashes, limits = word_hashes(words)
        counts = np.diff(limits)
        all_runs = runs(hashes, n)
        found: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(words)
        long, grams, starts, at = [], [], [], 0
        for i, size in enumerate(counts):
            if size:
                own = all_runs[limits[i] : limits[i + 1] - n + 1] if size >= n else _grams(hashes[limits[i] : limits[i + 1]], n)
                long.append(i)
                grams.append(own)
                starts.append(at)
                at += len(own)
        sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        if not long:
            return sizes, found
        prints = (np.concatenate(grams) >> np.uint64(32)).astype(np.uint32)
        least = np.empty((bands * rows, len(long)), dtype=np.uint64)
        for k in range(bands * rows):
            least[k] = np.minimum.reduceat(prints * multiplier[k] + offset[k], starts)
        buckets = np.empty((len(long), bands), dtype=np.int64)
        for band in range(bands):
            value = np.full(len(long), band + 1, dtype=np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + least[k])
            buckets[:, band] = value.view(np.int64)
        for i, own in zip(long, buckets):
            found[i] = own
        return sizes, found

    def rows_of(batches):
        for batch in batches:
            words = [_words(t) for t in batch["text"]]
            for first, last in slices([len(w) for w in words], _SLICE_BYTES):
                part = words[first:last]
                sizes, buckets = sign(part)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[first:last].to_numpy(), "class_key": [_class_key(w) for w in part],
                    "n_grams": sizes, "buckets": buckets,
                })

    return docs.mapInPandas(rows_of, "doc_id long, class_key binary, n_grams long, buckets array<long>")


def _tiles(frame: pd.DataFrame, start: int, end: int):
    """Pairs of index ranges that cover every pair of members of the group once: within it, or between its two blocks."""
    def cut(members):
        return [members[k : k + _TILE] for k in range(0, len(members), _TILE)]

    members = np.arange(start, end)
    if frame["low"].iat[start] == frame["high"].iat[start]:
        tiles = cut(members)
        yield from ((a, b) for i, a in enumerate(tiles) for b in tiles[i:])
    else:
        side = frame["own"].to_numpy()[start:end] == frame["low"].iat[start]
        yield from ((a, b) for a in cut(members[side]) for b in cut(members[~side]))


def _first_meetings(buckets: np.ndarray, band: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of a tile share no bucket of an earlier band."""
    wanted = np.ones((len(a), len(b)), dtype=bool)
    if a[0] == b[0]:
        wanted = np.triu(wanted, 1)
    for j in range(band):
        wanted &= buckets[a, j][:, None] != buckets[b, j][None, :]
    return wanted


def _meetings(batches):
    """Keep the members that have a first meeting in their group."""
    for frame, limits in whole_groups(batches, _GROUP):
        buckets, bands = np.stack(frame["buckets"].to_numpy()), frame["band"].to_numpy()
        keep = np.zeros(len(frame), dtype=bool)
        for start, end in zip(limits, limits[1:]):
            for a, b in _tiles(frame, start, end):
                wanted = _first_meetings(buckets, bands[start], a, b)
                keep[a] |= wanted.any(1)
                keep[b] |= wanted.any(0)
        yield frame[keep]


def _shared(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """How many n-grams the wanted pairs have in common."""
    common = np.zeros(wanted.shape, dtype=np.int64)
    if wanted.sum() <= 64:
        for i, j in zip(*np.nonzero(wanted)):
            common[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return common
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))  # no other n-gram is in an intersection

    def places(sets):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        at = np.searchsorted(both, values)
        held = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == values) if len(both) else np.zeros(len(values), dtype=bool)
        return at[held], owner[held]

    width = 4096
    (at_left, own_left), (at_right, own_right) = places(left), places(right)
    for first in range(0, len(both), width):
        parts = []
        for at, owner, rows in ((at_left, own_left, len(left)), (at_right, own_right, len(right))):
            here = (at >= first) & (at < first + width)
            part = np.zeros((rows, width), dtype=np.float32)
            part[owner[here], at[here] - first] = 1
            parts.append(part)
        common += (parts[0] @ parts[1].T).astype(np.int64)
    return common


def _verify(similarity: float):
    def verified(batches):
        for frame, limits in whole_groups(batches, _GROUP):
            buckets, bands = np.stack(frame["buckets"].to_numpy()), frame["band"].to_numpy()
            keys, copies = frame["class_key"].to_numpy(), frame["copies"].to_numpy()
            sets = [np.frombuffer(g, dtype=np.uint64) for g in frame["grams"]]
            sizes = np.array([len(x) for x in sets])
            links, classes, root = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64), np.arange(len(frame))
            for start, end in zip(limits, limits[1:]):
                for a, b in _tiles(frame, start, end):
                    wanted = _first_meetings(buckets, bands[start], a, b)
                    if not wanted.any():
                        continue
                    common = _shared([sets[i] for i in a], [sets[i] for i in b], wanted)
                    linked = wanted & (common >= similarity * (sizes[a][:, None] + sizes[b][None, :] - common) - 1e-9)
                    links[a] += linked @ copies[b]
                    links[b] += linked.T @ copies[a]
                    classes[a] += linked.sum(1)
                    classes[b] += linked.sum(0)
                    for i in np.flatnonzero(linked.any(1)):  # hang every tree on its first member
                        roots = np.unique(root[np.append(b[linked[i]], a[i])])
                        if len(roots) > 1:
                            own = root[start:end]
                            own[np.isin(own, roots)] = roots[0]
            found = np.flatnonzero(classes)
            yield pd.DataFrame({
                "class_key": keys[found], "links": links[found], "classes": classes[found], "parent": keys[root[found]],
            })

    return verified


def _in_groups(rows: DataFrame, function, schema: str) -> DataFrame:
    """Apply ``function`` to rows that arrive sorted by group, any number of groups to a task."""
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInPandas(function, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY,
    recall: float = RECALL, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per document: doc_id, class_key (equal texts), group_id (the smallest id of all that are linked), n_links
    (documents of at least this similarity, copies included), n_near (linked classes of other texts), first_id (the
    smallest id of the class), is_head (the class of the group that has its smallest id)."""
    small_batches(docs.sparkSession)
    bands, rows = banding(similarity, recall)
    found = stored(signatures(_texts(docs, id_col, text_col), n, bands, rows), "signatures")
    nulls_last = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("n_grams"), F.col("buckets"))
    classes = found.groupBy("class_key").agg(F.count(F.lit(1)).alias("copies"), F.min(nulls_last).alias("first"))
    classes = stored(classes.select("class_key", "copies", F.col("first.id").alias("first_id"), "first.n_grams", "first.buckets"), "classes")

    exploded = classes.select("class_key", "n_grams", F.posexplode("buckets").alias("band", "bucket"))
    sizes = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n_grams").alias("total")).where("size > 1")
    by_bytes, by_rows = F.ceil(F.col("total") * 8 / block_bytes), F.ceil(F.col("size") / block_rows)
    shared = stored(sizes.select("bucket", F.greatest(by_bytes, by_rows).cast("int").alias("blocks")), "buckets")
    blocks = F.col("blocks")
    # Narrow rows first: only classes that share a bucket need their signature. Both tables grow with the corpus.
    sharing = exploded.drop("n_grams").join(shared.hint("merge"), "bucket")
    members = (
        sharing.join(classes.select("class_key", "copies", "buckets").hint("merge"), "class_key")
        .withColumn("own", F.pmod(F.xxhash64("class_key"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "band", "class_key", "copies", "buckets")
    )
    shape = "bucket long, low int, high int, own int, band int, class_key binary, copies long, buckets array<long>"
    meetings = stored(_in_groups(members, _meetings, shape), "meetings")

    wanted = stored(meetings.select("class_key").distinct().join(classes.select("class_key", "first_id"), "class_key"), "candidates")
    grams = stored(_gram_sets(docs, id_col, text_col, wanted, n), "n-grams")
    links = stored(
        _in_groups(meetings.join(grams, "class_key"), _verify(similarity), "class_key binary, links long, classes long, parent binary"), "links"
    )
    linked = links.groupBy("class_key").agg(F.sum("links").alias("links"), F.sum("classes").alias("classes"))
    roots = components(links.select(F.col("class_key").alias("a"), F.col("parent").alias("b")))
    group = F.coalesce("root", "class_key")
    described = stored(
        classes.select("class_key", "copies", "first_id")
        .join(linked, "class_key", "left")
        .join(roots.withColumnRenamed("node", "class_key"), "class_key", "left")
        .select(
            "class_key", "first_id", group.alias("group_key"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("classes", F.lit(0)).alias("n_near"),
        ),
        "described",
    )
    head = F.min(F.struct(F.col("first_id").isNull(), F.col("first_id").alias("id"), F.col("class_key").alias("key")))
    heads = described.groupBy("group_key").agg(head.alias("head"))
    named = described.join(heads, "group_key").select(
        "class_key", "first_id", F.col("head.id").alias("group_id"), "n_links", "n_near", (F.col("head.key") == F.col("class_key")).alias("is_head"),
    )
    return found.select("doc_id", "class_key").join(stored(named, "named"), "class_key")


def _gram_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, n: int) -> DataFrame:
    """(class_key, grams): the n-gram set of one text of each wanted class. The key of the join holds the id, so that
    the copies of a common text do not meet in one task."""

    def sets(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch["class_key"], batch["text"]):
                hashes, _ = word_hashes([_words(text)])
                rows.append((key, np.unique(_grams(hashes, n)).tobytes()))
            yield from some(rows, ["class_key", "grams"])

    texts = with_class_key(docs, id_col, text_col).select("class_key", "doc_id", "text")
    same = (texts["class_key"] == wanted["class_key"]) & texts["doc_id"].eqNullSafe(wanted["first_id"])
    one = texts.join(wanted.hint("merge"), same, "left_semi")  # the wanted classes grow with the corpus
    return one.mapInPandas(sets, "class_key binary, grams binary").dropDuplicates(["class_key"])


def with_class_key(docs: DataFrame, id_col: str, text_col: str, row: bool = False) -> DataFrame:
    """(doc_id, text, class_key) and, if asked for, the whole ``row``."""

    @F.pandas_udf("binary")
    def key_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _class_key(_words(t)))

    kept = [F.struct(F.col("*")).alias("row")] if row else []
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *kept)
    return texts.withColumn("class_key", key_of("text"))


def op3_ngram_jaccard_join(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("group_id").alias("class_id"), "n_links", "n_near")


def near_duplicate_stage(spark, docs, sf_dir):
    """Of each group of linked documents the one with the smallest id stays (of rows equal in text and id, one)."""
    found = near_duplicates(docs, block_bytes=STAGE_BLOCK_BYTES)
    heads = found.where(F.col("is_head") & F.col("doc_id").eqNullSafe(F.col("first_id")))
    winners = stored(heads.select(F.col("class_key").alias("key"), F.col("doc_id").alias("id")).distinct(), "winners")
    texts = with_class_key(docs, "doc_id", "text", row=True).drop("text")
    kept = texts.join(winners.hint("merge"), (texts["class_key"] == winners["key"]) & texts["doc_id"].eqNullSafe(winners["id"]))
    place = F.row_number().over(Window.partitionBy("key", "id").orderBy("key", "id"))
    return kept.withColumn("place", place).where("place = 1").select("row.*")
