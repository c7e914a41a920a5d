"""Periodic runs of words: a suffix automaton whose last occurrences are kept by link-cut access.

A run is a stretch of words with smallest period q that is at least ``least_exponent`` periods (and ``least_length`` words)
long and that no neighbour extends. The states of the suffix automaton of a text form a tree by their suffix links; the path from
the state of a prefix up to the root holds all its suffixes. Every appended word *accesses* that path: it is cut into segments
by the last end of the occurrences in them, a segment with the longest suffix L that last ended d words ago is a repetition of
period d and length L + d, and then the whole path takes the new end as its colour. The paths of one colour are splay
trees, so the segments met are a logarithm on average. For exponents of 3 and more the last occurrence of a long
suffix within a run is exactly one period away, so each run is seen, with its smallest period, at its last word.

Most texts have no place where a run could be, so the automaton is only built over stretches that can hold one. That is exact: of a
run with period q all windows of ``g`` words beyond its first period occur again at most q words earlier, they follow each other, and
there are at least (exponent - 1) q - g + 1 of them. Windows that are no part of such a chain are left out until none goes.

Defined cases: null text counts as empty: no words, no runs, empty collapsed text. Repeated rows, null ids and ties of ids each
give a row of their own; an empty table gives no rows; columns other than the id and the text are not read. A text is handled by
one task, whose memory grows with its own stretches only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import read, small_batches, text_of
from trainlake.llm.textkit import runs as window_hashes

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
FOUND = "n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"

_SPACES = r"[\x20\x09-\x0D]+"


def suffix_automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length of the longest string, suffix link) of each state, and the state of each prefix. State 0 is the root.

    Most states have one way on, which is held in two lists; only further ones take a dictionary."""
    length, link, first, target = [0], [-1], [-1], [0]
    more: dict[int, dict[int, int]] = {}
    prefixes, last = [], 0
    for i, c in enumerate(word):
        new, p = len(length), last
        length.append(i + 1)
        link.append(0)
        first.append(-1)
        target.append(0)
        while p >= 0 and first[p] != c and c not in more.get(p, ()):
            if first[p] < 0:
                first[p], target[p] = c, new
            else:
                more.setdefault(p, {})[c] = new
            p = link[p]
        if p >= 0:
            q = target[p] if first[p] == c else more[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                target.append(target[q])
                if q in more:
                    more[clone] = dict(more[q])
                link[q] = link[new] = clone
                while p >= 0:
                    if first[p] == c:
                        if target[p] != q:
                            break
                        target[p] = clone
                    elif more.get(p, {}).get(c) == q:
                        more[p][c] = clone
                    else:
                        break
                    p = link[p]
        prefixes.append(new)
        last = new
    return length, link, prefixes


class LastEnds:
    """The suffix links as a link-cut tree. Each preferred path is a splay tree ordered by depth; the end of the last
    occurrence, the same for a whole path, is held at the root of its splay tree. Node 0 stands for none."""

    def __init__(self, link: list[int]) -> None:
        self.up = [0] + [p + 1 for p in link]
        self.left = [0] * len(self.up)
        self.right = [0] * len(self.up)
        self.end = [-1] * len(self.up)

    def _lift(self, x: int) -> None:
        """Rotate ``x`` above its parent."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def _splay(self, x: int) -> int:
        """Make ``x`` the root of its splay tree; returns the end that the tree holds."""
        up, left, right, end = self.up, self.left, self.right, self.end
        holder = x
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                holder = g
                self._lift(p if (left[g] == p) == (left[p] == x) else x)
            else:
                holder = p
            self._lift(x)
        found = end[holder]
        end[x] = found
        return found

    def access(self, state: int, position: int) -> Iterator[tuple[int, int]]:
        """The segments of the path from ``state`` to the root as (deepest state, last end); the path then ends at
        ``position``."""
        up, right, end = self.up, self.right, self.end
        x, below = state + 1, 0
        segments = []
        while x:
            before = self._splay(x)
            if before >= 0:
                segments.append((x - 1, before))
            if right[x]:
                end[right[x]] = before
            right[x] = below
            below, x = x, up[x]
        end[below] = position
        return segments


def window(least_length: int, least_exponent: int) -> int:
    """How many neighbouring words, at least, every run has that equal those one period before."""
    return min(max((least_exponent - 1) * q, least_length - q) for q in range(1, least_length + 1))


def stretches(words: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int]]:
    """Disjoint (first, last) of words outside of which no run lies."""
    g, turns = window(least_length, least_exponent), least_exponent - 1
    hashes = window_hashes(words.astype(np.uint64), g)
    order = np.argsort(hashes, kind="stable")
    again = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    at, distance = order[again + 1], order[again + 1] - order[again]
    by_place = np.argsort(at)
    at, distance = at[by_place], distance[by_place]
    while len(at):
        begins = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        sizes = np.diff(np.append(begins, len(at)))
        keep = distance * turns <= np.repeat(sizes, sizes) + g - 1
        if keep.all():
            break
        at, distance = at[keep], distance[keep]
    else:
        return []
    found: list[tuple[int, int]] = []
    for first, size in zip(at[begins].tolist(), sizes.tolist(), strict=True):
        begin, last = max(0, first - (size + g - 1) // turns), first + size + g - 2
        while found and found[-1][1] >= begin:
            begin = min(begin, found.pop()[0])
        found.append((begin, last))
    return found


def runs_of(words: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text given as numbers of its words, by start and period."""
    if least_exponent < 3:
        raise ValueError("least_exponent must be 3 or more")
    n, found = len(words), set()
    if n < least_length:
        return []
    for begin, last in stretches(words, least_length, least_exponent):
        part = words[begin : last + 1].tolist()
        length, link, prefixes = suffix_automaton(part)
        ends = LastEnds(link)
        for i, state in enumerate(prefixes):
            for deepest, before in ends.access(state, i):
                d, size = i - before, length[deepest]
                if size < (least_exponent - 1) * d or size + d < least_length:
                    continue
                end = begin + i + 1
                if end < n and words[end] == words[end - d]:
                    continue
                start = end - size - d
                while start and words[start - 1] == words[start - 1 + d]:
                    start -= 1
                found.add((start, end - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered_words(words: list[bytes]) -> np.ndarray:
    """The same number for the same word."""
    number = dict(zip(words, range(len(words)), strict=True))
    return np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))


def found_in(text: str, least_length: int, least_exponent: int) -> tuple[int, list[int], list[int], list[int], str]:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at just the six white characters of ASCII
    found = runs_of(numbered_words(words), least_length, least_exponent)
    if found:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in found:
            kept[start + period : start + length] = False
        left = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
    else:
        left = words
    starts, lengths, periods = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
    return len(words), starts, lengths, periods, b" ".join(left).decode("utf-8", "surrogatepass")


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
    least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start and period) and ``collapsed``, the words
    that are left when every run keeps its first period only, joined by one space."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        names = ["n_words", "starts", "lengths", "periods", "collapsed"]
        return pd.DataFrame([found_in(t, least_length, least_exponent) for t in texts], columns=names)

    found = docs.select(F.col(id_col).alias("doc_id"), search(text_of(text_col)).alias("found"))
    zipped = F.arrays_zip(F.col("found.starts").alias("start"), F.col("found.lengths").alias("length"), F.col("found.periods").alias("period"))
    return found.select("doc_id", "found.n_words", zipped.alias("runs"), "found.collapsed")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where one text of ten repeats a stretch of its words up to its end, by the hash of its id. A null id leaves
    the text as it is."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text_of(text_col), _SPACES), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), h.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    g, n = F.floor(F.col("h") / 10).cast("long"), F.size("w").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    period = F.slice("w", (a + 1).cast("int"), p.cast("int"))
    rounds = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, rounds)), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), a.cast("int")), tail), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.size("w") > 0), changed).otherwise(F.col("text")).alias("text"))


def _longest(runs: Column) -> Column:
    """The longest run; of several the one that begins first, then the one with the smallest period."""
    ranked = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    return F.array_max(ranked)


def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("longest", _longest(F.col("runs")))
    length, period = F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
