"""Periodic runs against a search over all periods, on random words, hard rows and the whole query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from corpus import hard, hard_rows, none

from trainlake.llm.common import read
from trainlake.llm.periodic_runs import LastEnds, op13_periodic_runs, periodic_runs, runs_of, stretches, suffix_automaton


def brute_runs(w, least=6, times=4):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q) and not any(w[i : i + size - r] == w[i + r : i + size] for r in range(1, q)):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, kinds, w = rng.randrange(60), rng.choice([1, 2, 2, 3, 5]), []
    while len(w) < n:
        if rng.random() < 0.3:
            unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 6))]
            w += (unit * 8)[: rng.randrange(1, 8 * len(unit) + 1)]
        else:
            w.append(rng.randrange(kinds))
    return w[:n]


@pytest.mark.parametrize("least, times", [(6, 4), (6, 3), (10, 5), (1, 3)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least * times)
    planted = 0
    for _ in range(700):
        w = random_words(rng)
        expected = brute_runs(w, least, times)
        assert runs_of(np.array(w, dtype=np.int64), least, times) == expected
        planted += len(expected)
    assert planted > 300


def test_exponents_below_three_are_refused():
    with pytest.raises(ValueError):
        runs_of(np.zeros(9, dtype=np.int64), 6, 2)


def test_segments_are_the_last_ends_of_all_suffixes():
    rng = random.Random(5)
    for _ in range(150):
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        length, link, prefixes = suffix_automaton(w)
        ends = LastEnds(link)
        for i, state in enumerate(prefixes):
            last = {}
            for size in range(1, i + 1):
                before = [e for e in range(size - 1, i) if w[e - size + 1 : e + 1] == w[i - size + 1 : i + 1]]
                if before:
                    last[before[-1]] = size
            assert {e: length[s] for s, e in ends.access(state, i) if length[s]} == last


def test_no_stretch_without_runs():
    words = np.random.default_rng(0).permutation(50000)
    assert stretches(words, 6, 4) == [] and stretches(np.tile(words[:9000], 3), 6, 4) == []


def as_planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not w:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    w = as_planted(doc_id, text)
    found = brute_runs(w) if len(w) < 2500 else runs_of(np.unique(w, return_inverse=True)[1])
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], *sha)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_query(spark, data):
    docs = read(spark, data, "documents").select("doc_id", "text").collect()
    found = op13_periodic_runs(spark, data).collect()
    assert ordered(map(tuple, found)) == ordered(brute_row(d.doc_id, d.text) for d in docs)
    assert sum(r.n_runs > 0 for r in found) > 10


def test_hard_rows(spark, tmp_path):
    folder = str(tmp_path / "documents.parquet")
    extra = [(100, "x " * 5, "a"), (101, "a b c " * 4, "a"), (102, "a b c " * 3, "a"), (103, "y" + " é" * 20000 + " z", "a"), (103, "y", "b")]
    more = spark.createDataFrame(extra, "doc_id long, text string, source string")
    hard(spark).unionByName(more, allowMissingColumns=True).write.parquet(folder)
    found = op13_periodic_runs(spark, str(tmp_path)).collect()
    assert ordered(map(tuple, found)) == ordered(brute_row(i, t) for i, t, _ in hard_rows() + extra)
    runs = {r.doc_id: r for r in periodic_runs(more.where("source = 'a'")).collect()}
    assert [tuple(r) for r in runs[103].runs] == [(1, 20000, 1)] and runs[103].collapsed == "y é z" and runs[101].collapsed == "a b c"
    assert not runs[100].runs and not runs[102].runs


def test_empty_table(spark):
    assert periodic_runs(none(spark)).collect() == []
