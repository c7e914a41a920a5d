"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors become integers, equal vectors become one row with the rows of smallest id that have them. Pivots, about as many as the square
root of the vectors and drawn from them by a hash, divide the space into cells and each cell into rings by the distance to its
pivot. The summary of a ring is its pivot p, its largest distance R, its largest norm N and its size. For a query q and any x of it, q.x
is at most the smaller of q.p + |q| R and |q| N. The pivots themselves and the ring of the query give a true lower bound of its k-th best score;
only those other rings are searched whose upper bound reaches it.

Neighbouring rings lie together in blocks, and a large ring is cut into several. A query moves once to each block that holds a ring it
reaches, not to each ring, and the block finds out again which of its rings those are. A block that very many queries ask is copied for each
part of them, and one that nobody asks not at all. So what moves grows with the queries and blocks, and a task holds one block
and a batch of queries at a time, whatever the size of the table.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no part; a
query meets only vectors of its own length; a query never meets its own row, but others with the same id or vector (rows are told apart
by their place); scores beyond 64 bits saturate; ties go to the smaller id, then to the earlier row; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainlake.llm.common import read, small_batches, stored

MOST_PIVOTS, RINGS = 4096, 8
# Vectors of a block: this many, or more where the vectors of one length would make more than MOST_BLOCKS blocks, up to
# BLOCK_NUMBERS components (64 MB as floats). Queries that one copy of a block answers; vectors and scores computed at once.
BLOCK_ROWS, MOST_BLOCKS, BLOCK_NUMBERS = 4096, 64, 2**23
PART_QUERIES = 65536
TILE, SCORES = 4096, 2**20

# Below it all whole numbers, and so sums of whole numbers, are exact in the type.
_EXACT = ((np.float32, 2.0**24), (np.float64, 2.0**52))
_LEAST, _MOST = -(2**63), 2**63 - 1


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, row, vec): floor(scale * x) of every usable vector; ``row`` tells rows apart."""
    vec = F.col("v")
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & vec.isNotNull() & usable)
        .select("vec_id", F.monotonically_increasing_id().alias("row"), F.transform(vec, lambda x: F.floor(x * F.lit(float(scale)))).alias("vec"))
    )


def _longest(vectors: np.ndarray) -> float:
    """The largest norm."""
    return float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64).max(initial=0)))


def _packed(vectors: np.ndarray) -> list[bytes]:
    """The rows as bytes, each number in the least width that holds all of them."""
    low, high = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return [row.tobytes() for row in np.ascontiguousarray(vectors, dtype=kind)]


def _unpacked(rows: list[bytes], size: int) -> np.ndarray:
    if not rows or not size:
        return np.zeros((len(rows), size), dtype=np.int8)
    widths = np.array([len(row) for row in rows]) // size
    vectors = np.empty((len(rows), size), dtype=f"i{widths.max()}")
    for width in np.unique(widths):
        here = np.flatnonzero(widths == width)
        vectors[here] = np.frombuffer(b"".join([rows[i] for i in here]), dtype=f"i{width}").reshape(-1, size)
    return vectors


def _ranked(query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query's rows in order, best first, and the place of each from 0."""
    order = np.lexsort((rows, ids, ~score, query))
    _, begins, sizes = np.unique(query[order], return_index=True, return_counts=True)
    return order, np.arange(len(order)) - np.repeat(begins, sizes)


def _near_together(points: np.ndarray) -> np.ndarray:
    """The points in an order in which near ones mostly follow each other: halved again and again along their widest axis."""
    todo, order = [np.arange(len(points))], []
    while todo:
        part = todo.pop()
        if len(part) <= 2 or not points.shape[1]:
            order.append(part)
            continue
        part = part[np.argsort(points[part, np.ptp(points[part], axis=0).argmax()], kind="stable")]
        todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return points[np.concatenate(order)]


def _assign(vectors: DataFrame, centres: dict[int, tuple[int, np.ndarray]], *others: str) -> DataFrame:
    """Columns ``others`` and ``packed`` (``vec`` as bytes) with ``cell`` (the nearest pivot), the ``distance`` to it and the ``norm``.
    ``centres``: by length of vector the number of its first pivot and the pivots."""

    def nearest(batches):
        for batch in batches:
            column = batch.column("vec")
            flat, sizes = column.flatten().to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64)
            begins, rows = sizes.cumsum() - sizes, batch.num_rows
            packed, cell, distance, norm = np.empty(rows, dtype=object), np.zeros(rows, dtype=np.int32), np.zeros(rows), np.zeros(rows)
            for size in np.unique(sizes):
                first, at = centres[int(size)]
                same = np.flatnonzero(sizes == size)
                squares, step = (at * at).sum(1), max(1, SCORES // max(len(at), int(size)))
                for here in (same[i : i + step] for i in range(0, len(same), step)):
                    whole = flat[begins[here][:, None] + np.arange(size)]
                    x = whole.astype(np.float64)
                    apart = x @ at.T
                    apart *= -2
                    apart += squares
                    best = apart.argmin(1)
                    packed[here] = _packed(whole)
                    cell[here] = first + best
                    distance[here] = np.sqrt(((x - at[best]) ** 2).sum(1))
                    norm[here] = np.sqrt((x * x).sum(1))
            found = [pa.array(packed, pa.binary()), pa.array(cell), pa.array(distance), pa.array(norm)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + found, names=[*others, "packed", "cell", "distance", "norm"])

    kinds = dict(vectors.dtypes)
    schema = [f"{c} {kinds[c].replace('bigint', 'long')}" for c in others] + ["packed binary, cell int, distance double, norm double"]
    return vectors.mapInArrow(nearest, ", ".join(schema))


def _ringed(cells: DataFrame, radius: DataFrame, rings: int) -> DataFrame:
    """Cells divided by the distance to their pivot: cell * rings + ring. ``radius`` has one row per pivot."""
    ring = F.when(F.col("radius") > 0, F.least(F.floor(rings * F.col("distance") / F.col("radius")), F.lit(rings - 1))).otherwise(0)
    return cells.join(F.broadcast(radius), "cell").withColumn("cell", (F.col("cell") * rings + ring).cast("int")).drop("radius")


class _Rings:
    """The rings of the vectors of one length, by cell, and the blocks that hold them: ``pieces`` blocks from ``first`` for each."""

    def __init__(self, points: np.ndarray, pivots_before: int, rings: int, summaries: list[tuple], most: int, blocks_before: int) -> None:
        self.points, self.size = points, points.shape[1]
        cells, count, self.radius, self.norm = map(np.array, zip(*summaries))
        self.cells, self.pivot = cells, cells // rings - pivots_before
        self.slack = 1e-9 * (np.sqrt((points * points).sum(1))[self.pivot] + self.radius)
        self.pieces = -(-count // most)
        self.first, block, filled = np.zeros(len(cells), dtype=np.int64), blocks_before, 0
        for i, (n, pieces) in enumerate(zip(count.tolist(), self.pieces.tolist())):
            if filled and filled + n > most:
                block, filled = block + 1, 0
            self.first[i] = block
            block, filled = (block + pieces, 0) if pieces > 1 else (block, filled + n)
        self.blocks_until = block + (filled > 0)
        self.begins = np.flatnonzero(np.concatenate([[True], self.first[1:] != self.first[:-1]]))

    def within(self, block: int) -> slice:
        """The rings of a block, which are neighbours."""
        return slice(int(np.searchsorted(self.first + self.pieces - 1, block)), int(np.searchsorted(self.first, block, "right")))

    def lower(self, queries: np.ndarray, keep: int) -> np.ndarray:
        """A lower bound of the ``keep``-th best score of each query: pivots are rows too."""
        if len(self.points) < keep:
            return np.full(len(queries), -np.inf)
        best = np.partition(queries @ self.points.T, -keep, axis=1)[:, -keep]
        return np.minimum(best - np.sqrt((queries * queries).sum(1)) * self.slack.max() - 1e-6, float(_MOST))

    def reached(self, queries: np.ndarray, least: np.ndarray, own: np.ndarray, within: slice = slice(None)) -> np.ndarray:
        """Which rings other than the query's own may hold a score of ``least`` or more."""
        pivot, length = self.pivot[within], np.sqrt((queries * queries).sum(1))[:, None]
        products = queries @ self.points[pivot[0] : pivot[-1] + 1].T
        upper = np.minimum(products[:, pivot - pivot[0]] + length * self.radius[within], length * self.norm[within])
        upper += length * self.slack[within] + 1e-6  # the bounds are floats, the scores are not
        return (np.maximum(upper, float(_LEAST)) >= least[:, None]) & (self.cells[within] != own[:, None])

    def blocks(self, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) for the blocks that hold a reached ring."""
        query, found = np.nonzero(np.logical_or.reduceat(reached, self.begins, axis=1))
        ring = self.begins[found]
        pieces = self.pieces[ring]
        inside = np.arange(pieces.sum()) - np.repeat(pieces.cumsum() - pieces, pieces)
        return np.repeat(query, pieces), np.repeat(self.first[ring], pieces) + inside


class _Space:
    """The rings of all lengths of vectors."""

    def __init__(self, centres: dict[int, tuple[int, np.ndarray]], rings: int, summaries: list[tuple], counts: dict[int, int], block_rows: int) -> None:
        self.rings, self.lengths, blocks = rings, [], 0
        self.pivots_before = np.array([before for before, _ in centres.values()], dtype=np.int64)
        found = sorted(summaries)
        for size, (before, points) in centres.items():
            mine = [row for row in found if before <= row[0] // rings < before + len(points)]
            most = min(max(block_rows, -(-counts[size] // MOST_BLOCKS)), max(1, BLOCK_NUMBERS // max(1, size)))
            self.lengths.append(_Rings(points, before, rings, mine, most, blocks))
            blocks = self.lengths[-1].blocks_until

    def places(self) -> list[tuple[int, int, int]]:
        """(cell, first, pieces) for every ring."""
        return [row for x in self.lengths for row in zip(x.cells.tolist(), x.first.tolist(), x.pieces.tolist())]

    def of_block(self, block: int) -> _Rings:
        return next(x for x in self.lengths if block < x.blocks_until)

    def queries(self, batch: pd.DataFrame) -> Iterator[tuple[_Rings, pd.DataFrame, np.ndarray]]:
        """Some queries of one length at a time, so few that a number for each of them and each ring takes little memory."""
        lengths = np.searchsorted(self.pivots_before, batch["cell"].to_numpy() // self.rings, "right") - 1
        for number in np.unique(lengths):
            rings, here = self.lengths[number], np.flatnonzero(lengths == number)
            step = max(1, SCORES // len(rings.cells))
            for part in (batch.iloc[here[i : i + step]] for i in range(0, len(here), step)):
                yield rings, part, _unpacked(part["packed"].to_list(), rings.size).astype(np.float64)


class _Block:
    """The vectors of a block in a task."""

    def __init__(self, rings: _Rings, block: int, runs: list[pa.RecordBatch]) -> None:
        self.rings, self.within = rings, rings.within(block)
        self.cells = rings.cells[self.within]
        self.ring = np.searchsorted(self.cells, np.concatenate([run.column("cell").to_numpy() for run in runs]))
        parts = [_unpacked(run.column("packed").to_pylist(), rings.size) for run in runs]
        self.vectors, self.longest, self.floats = np.concatenate(parts), max(map(_longest, parts)), None
        self.ids, self.rows = (np.concatenate([run.column(c).flatten().to_numpy() for run in runs]) for c in ("ids", "rows"))
        self.counts = np.concatenate([pc.list_value_length(run.column("ids")).to_numpy() for run in runs]).astype(np.int64)
        self.begins = self.counts.cumsum() - self.counts

    def scores(self, queries: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """All inner products with the vectors ``columns``, exactly: as floats where these hold them, else as whole numbers."""
        largest = self.longest * _longest(queries)  # no sum of some of the products is larger
        if kind := next((kind for kind, limit in _EXACT if largest < limit), None):
            if self.floats is None or self.floats.dtype != kind:
                self.floats = self.vectors.astype(kind)
            return queries.astype(kind) @ self.floats[columns].T
        found, left, step = np.empty((len(queries), len(columns)), dtype=np.int64), queries.astype(object), max(1, SCORES // 4 // self.rings.size)
        for i in range(0, len(columns), step):
            exact = left @ self.vectors[columns[i : i + step]].astype(object).T
            found[:, i : i + step] = np.clip(exact, _LEAST, _MOST).astype(np.int64)
        return found

    def best(self, run: pa.RecordBatch, keep: int, own: bool) -> Iterator[pa.RecordBatch]:
        """The ``keep`` best rows in the own ring of each query (``own``), or in the other rings that it reaches."""
        cell, key = run.column("cell").to_numpy(), run.column("query_key").to_numpy()
        queries = _unpacked(run.column("packed").to_pylist(), self.rings.size)
        least = np.full(len(key), -np.inf) if own else run.column("least").to_numpy()
        cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1 if own else []
        step = max(1, SCORES // TILE)
        for begin, end in zip([0, *cuts], [*cuts, len(key)]):
            for here in (slice(i, min(i + step, end)) for i in range(begin, end, step)):
                if own:
                    reached = self.cells == cell[here][:, None]
                else:
                    reached = self.rings.reached(queries[here].astype(np.float64), least[here], cell[here], self.within)
                yield from self._best(key[here], queries[here], least[here], reached, keep)

    def _best(self, key: np.ndarray, queries: np.ndarray, least: np.ndarray, reached: np.ndarray, keep: int) -> Iterator[pa.RecordBatch]:
        below = lambda x: x - 1e-9 * np.abs(x) - 1e-6
        limit, asked = below(least), np.flatnonzero(reached.any(0)[self.ring])
        query, near, score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        for columns in (asked[i : i + TILE] for i in range(0, len(asked), TILE)):
            scores = self.scores(queries, columns)
            bar = np.nextafter(limit.astype(np.float32), np.float32(-np.inf)) if scores.dtype == np.float32 else limit
            i, j = np.nonzero(scores >= bar[:, None])
            allowed = reached[i, self.ring[columns[j]]]
            i, j = i[allowed], j[allowed]
            if not len(i):
                continue
            query, near, score = np.concatenate([query, i]), np.concatenate([near, columns[j]]), np.concatenate([score, scores[i, j].astype(np.int64)])
            # Each vector has a row, so no row of a vector behind `keep` others by score and first row is among the best.
            first = self.begins[near]
            order, place = _ranked(query, score, self.ids[first], self.rows[first])
            order, last = order[place < keep], order[place == keep - 1]
            limit[query[last]] = np.maximum(limit[query[last]], below(score[last].astype(np.float64)))
            query, near, score = query[order], near[order], score[order]
        if len(query):
            counts = self.counts[near]
            row = np.repeat(self.begins[near] - counts.cumsum() + counts, counts) + np.arange(counts.sum())
            query, score = np.repeat(query, counts), np.repeat(score, counts)
            order, place = _ranked(query, score, self.ids[row], self.rows[row])
            order = order[place < keep]
            found = [key[query[order]], self.ids[row[order]], self.rows[row[order]], score[order]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_key", "vec_id", "row", "score"])


def _solve(queries: DataFrame, vectors: DataFrame, space: _Space, keep: int, own: bool) -> DataFrame:
    """(query_key, vec_id, row, score): for each query the ``keep`` best rows of each block that it was sent to, in its own ring
    (``own``) or in the others that it reaches."""
    parts = F.broadcast(queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("parts")))
    asking = queries.join(parts, "block").select(
        "block", F.pmod(F.xxhash64("query_key"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"), "cell", "packed",
        "query_key", "least", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("rows"),
    )
    asked = vectors.join(parts, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "cell", "packed",
        F.lit(None).cast("long").alias("query_key"), F.lit(None).cast("double").alias("least"), "ids", "rows",
    )

    def search(batches):
        unit, runs, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "part", "asks")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                run = batch.slice(begin, end - begin)
                if not len(run):
                    continue
                if unit != (now := tuple(keys[:2, begin])):
                    unit, runs, block = now, [], None
                if not keys[2, begin]:  # vectors come before the queries
                    runs.append(run)
                    continue
                if runs:
                    block, runs = _Block(space.of_block(unit[0]), int(unit[0]), runs), []
                if block is not None:
                    yield from block.best(run, keep, own)

    both = asked.unionByName(asking).repartition("block", "part").sortWithinPartitions("block", "part", "asks", "cell")
    return both.mapInArrow(search, "query_key long, vec_id long, row long, score long")


class KnnJoin:
    """``result``: (query_id, rank, vec_id, score), the k rows of highest inner product for every row where ``is_query`` (an
    expression over ``vec_id``). ``pivots`` bounds the sample that divides the space (by default the square root of the number of
    vectors, at most ``MOST_PIVOTS``); every row is searched. ``routes`` and ``possible``: the (query, ring) pairs that are
    searched, and how many there are."""

    def __init__(
        self, table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
        k: int = 5, scale: int = 256, pivots: int | None = None, block_rows: int = BLOCK_ROWS, rings: int = RINGS,
    ) -> None:
        small_batches(table.sparkSession)
        vectors = stored(integer_vectors(table, id_col, vector_col, scale), "vectors")
        # A query leaves out one row, so of equal vectors only the first k + 1 can be seen.
        keep = k + 1
        same = Window.partitionBy("key", "vec").orderBy("vec_id", "row")
        keyed = vectors.withColumn("key", F.xxhash64("vec"))
        members = F.sort_array(F.collect_list(F.struct("vec_id", "row")))
        distinct = keyed.withColumn("place", F.row_number().over(same)).where(F.col("place") <= keep).groupBy("key", "vec").agg(members.alias("m"))
        distinct = stored(distinct.select("key", "vec", F.col("m.vec_id").alias("ids"), F.col("m.row").alias("rows")), "distinct-vectors")
        counts = {size: n for size, n in distinct.groupBy(F.size("vec")).count().collect()}
        if pivots is None:
            pivots = min(MOST_PIVOTS, max(16, int(sum(counts.values()) ** 0.5)))
        length = Window.partitionBy("size").orderBy("key", "vec")
        # The least hashes of a length: those far above are left out first, so what meets in one task doesn't grow with the tasks.
        highest = [(size, min(_MOST, _LEAST + 2**64 * (2 * pivots + 64) // n)) for size, n in counts.items()]
        highest = F.broadcast(table.sparkSession.createDataFrame(highest, "size int, highest long"))
        chosen = distinct.select("key", "vec", F.size("vec").alias("size")).join(highest, "size").where("key <= highest")
        chosen = chosen.withColumn("place", F.row_number().over(length)).where(F.col("place") <= pivots)
        drawn: dict[int, list[list[int]]] = {}
        for row in chosen.orderBy(F.size("vec"), "place").collect():
            drawn.setdefault(len(row["vec"]), []).append(row["vec"])
        centres: dict[int, tuple[int, np.ndarray]] = {}
        for size, points in drawn.items():
            before = sum(len(p) for _, p in centres.values())
            centres[size] = before, _near_together(np.array(points, dtype=np.float64).reshape(len(points), size))

        cells = stored(_assign(distinct, centres, "ids", "rows"), "cells")
        radius = stored(cells.groupBy("cell").agg(F.max("distance").alias("radius")), "radius")
        cells = _ringed(cells, radius, rings)
        summary = [F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.max("norm").alias("norm")]
        sizes = [tuple(row) for row in cells.groupBy("cell").agg(*summary).collect()]  # at most ``rings`` rows per pivot
        space = _Space(centres, rings, sizes, counts, block_rows)
        places = F.broadcast(table.sparkSession.createDataFrame(space.places(), "cell int, first int, pieces int"))
        block = (F.col("first") + F.pmod(F.xxhash64("packed"), F.col("pieces"))).cast("int")
        blocks = cells.join(places, "cell").select(block.alias("block"), "cell", "packed", "ids", "rows")

        queries = keyed.where(is_query)
        asked = queries.select("vec").distinct().select(F.monotonically_increasing_id().alias("query_key"), "vec")
        asked = stored(_ringed(_assign(asked, centres, "query_key", "vec"), radius, rings), "query-vectors")
        every = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("pieces") - 1)).alias("block")
        home = asked.join(places, "cell").select("query_key", "cell", "packed", F.lit(None).cast("double").alias("least"), every)
        first = stored(_solve(home, blocks, space, keep, own=True), "own-cell")

        by_score = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "row")
        bound = (
            first.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == keep).select("query_key", F.col("score").alias("bound"))
        )

        def least(rings: _Rings, part: pd.DataFrame, x: np.ndarray) -> np.ndarray:
            return np.maximum(part["bound"].fillna(-np.inf).to_numpy(), rings.lower(x, keep))

        def reachable(batches):
            for batch in batches:
                for rings, part, x in space.queries(batch):
                    bounds = least(rings, part, x)
                    queries, blocks = rings.blocks(rings.reached(x, bounds, part["cell"].to_numpy()))
                    step = max(1, SCORES // max(1, rings.size))
                    for query, block in ((queries[i : i + step], blocks[i : i + step]) for i in range(0, len(queries), step)):
                        yield part[["query_key", "cell", "packed"]].iloc[query].assign(least=bounds[query], block=block.astype(np.int32))

        def pairs(batches):
            for batch in batches:
                for rings, part, x in space.queries(batch):
                    query, ring = np.nonzero(rings.reached(x, least(rings, part, x), part["cell"].to_numpy()))
                    if len(query):
                        yield pd.DataFrame({"query_key": part["query_key"].to_numpy()[query], "cell": rings.cells[ring].astype(np.int32)})

        bounded = asked.select("query_key", "cell", "packed").join(bound, "query_key", "left").withColumn("bound", F.col("bound").cast("double"))
        self._asked, self._cells = asked, len(sizes)
        self.routes = bounded.mapInPandas(pairs, "query_key long, cell int")
        sent = stored(bounded.mapInPandas(reachable, "query_key long, cell int, packed binary, least double, block int"), "routes")
        others = _solve(sent, blocks, space, keep, own=False)
        best = (
            first.unionByName(others)
            .withColumn("place", F.row_number().over(by_score))
            .where(F.col("place") <= keep)
            .groupBy("query_key")
            .agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "row", "score"))).alias("best"))
        )
        solved = asked.join(best, "query_key").select("vec", "best")
        others_only = F.slice(F.filter("best", lambda x: x["row"] != F.col("own")), 1, k)
        self.result = (
            queries.select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "vec")
            .join(solved, "vec")
            .select("query_id", F.posexplode(others_only).alias("at", "found"))
            .select("query_id", (F.col("at") + 1).alias("rank"), "found.vec_id", "found.score")
        )

    @property
    def possible(self) -> int:
        return self._asked.count() * (self._cells - 1)


def knn_join(table: DataFrame, is_query: Column, **options) -> DataFrame:
    """(query_id, rank, vec_id, score), see ``KnnJoin``."""
    return KnnJoin(table, is_query, **options).result


def op7_exact_top_k(spark, sf_dir):
    return knn_join(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
