import inspect
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import hard, hard_rows, none, words
from pyspark.sql import functions as F

from trainlake.llm import bloom_lm as M


def training(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def exact_scores(rows, order, least, total_of, base, weight):
    """The same model with dictionaries instead of the filter."""
    counts = Counter()
    for doc_id, text in rows:
        if training(doc_id):
            t = M.tokens(text or "")
            for n in range(1, order + 1):
                counts.update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    ones = {k: v for k, v in counts.items() if len(k) == 1}
    pruned = [v for v in ones.values() if v < least]
    rest = (sum(pruned) + 0.5) / (len(pruned) + 1)
    reader = M.CountFilter({}, 16, least, base)

    def held(gram):
        level = int(M._entry_levels(np.array([counts[gram]]), least, base)[0]) if counts[gram] else 0
        return reader.counts[level]

    out = []
    for _, text in rows:
        t, score = M.tokens(text or ""), 0.0
        for i in range(len(t)):
            c = held((t[i],))
            p = (c if c else rest) / total_of
            for n in range(2, order + 1):
                if i >= n - 1 and held(tuple(t[i - n + 1 : i])):
                    h = held(tuple(t[i - n + 1 : i]))
                    p = (1 - weight) * p + weight * min(1, held(tuple(t[i - n + 1 : i + 1])) / h)
            score += math.log10(min(1, p))
        out.append(score)
    return out


def corpus():
    rows = [(i, t) for i, t, _ in hard_rows()]
    return rows + [(100 + i, words(i % 40, 80).replace("a", "A")) for i in range(200)]


def test_base_and_score_as_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, word string")
    found = M.lm_scores(df, M.in_training(F.col("doc_id")), bits=64, frequent_share=2e-3).collect()
    counts = Counter()
    for i, t in rows:
        if training(i):
            counts.update(M.tokens(t or ""))
    total = sum(counts.values())
    divisor = total + 0.5 * (len(counts) + 1)

    def key(doc_id, n, base):
        return (doc_id is None, doc_id or 0, n, round(base, 6))

    expected = {}
    for (i, t), score in zip(rows, exact_scores(rows, M.ORDER, 2, total, M.LEVEL_BASE, M.HISTORY_WEIGHT)):
        tokens = M.tokens(t or "")
        base = sum(math.log10((counts[w] + 0.5) / divisor) for w in tokens)
        expected.setdefault(key(i, len(tokens), base), []).append((not training(i), sum(counts[w] > 0 for w in tokens), score))
    assert len(found) == len(rows)
    close = 0
    for r in found:
        held_out, known, score = expected[key(r.doc_id, r.n_tokens, r.base_score)][0]
        assert (r.held_out, r.n_known, r.train_tokens) == (held_out, known, total)
        close += abs(r.score - score) < 1e-6 * max(1, abs(score))
    assert close >= 0.97 * len(found)  # the rest meet a false positive of the filter


def test_tokens():
    assert M.tokens("AÉb\x0bC d") == ["aÉb".encode(), "c d".encode(), M.END]
    assert M.tokens("") == [M.END]


@pytest.mark.parametrize("frame", [hard, none])
def test_hard_and_empty_tables(spark, frame):
    docs = frame(spark)
    found = M.lm_scores(docs, M.in_training(F.col("doc_id"))).collect()
    assert len(found) == docs.count()
    assert all(r.n_tokens >= 1 and r.score <= 0 and r.n_known <= r.n_tokens for r in found)


def test_nothing_to_learn_from(spark):
    found = M.lm_scores(hard(spark), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.held_out for r in found)


def test_filter_never_loses_an_entry_and_levels_follow_counts():
    counts = np.array([1, 2, 3, 10, 1000, 10**6])
    levels = M._entry_levels(counts, 2, 1.4)
    reader = M.CountFilter({}, 16, 2, 1.4)
    assert levels[0] == 0 and all(a <= b for a, b in zip(levels, levels[1:]))
    assert all(c / 1.5 < reader.counts[k] < c * 1.5 for c, k in zip(counts[1:], levels[1:]))


def of_default(name):
    """A share of all tokens below which n-grams are left out would show here as in a large corpus."""
    return {name: 0.01} if name in inspect.signature(M.lm_scores).parameters else {}


def test_no_ngram_that_occurs_twice_is_left_out(spark):
    """However large the rest: the same texts with the brute force model that holds all of them."""
    rows = corpus()
    total = sum(len(M.tokens(t or "")) for i, t in rows if training(i))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = M.lm_scores(df, M.in_training(F.col("doc_id")), bits=64, **of_default("min_share")).collect()
    expected = sorted(exact_scores(rows, M.ORDER, 2, total, M.LEVEL_BASE, M.HISTORY_WEIGHT))
    close = [abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(sorted(r.score for r in found), expected, strict=True)]
    assert sum(close) >= 0.97 * len(rows)


def test_scores_do_not_depend_on_the_chunks(spark):
    rows = [(2**60 + 1, "a b a b"), (None, "a b " * 400), *corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = lambda **o: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6), round(r.base_score, 6)) for r in M.lm_scores(df, M.in_training(F.col("doc_id")), **o).collect())
    whole = plain()
    assert plain(chunk_tokens=1) == plain(chunk_tokens=300) == whole and str(2**60 + 1) in {r[0] for r in whole}


def test_a_chunk_that_is_read_in_pieces(spark):
    """A large file may be read by several tasks, so a chunk in stretches: each gets its own answers."""
    schema = "text string, learn boolean, chunk long, row long"
    rows = [("a b c a b c", True, 5, 0), ("c d", False, 5, 1), ("a b a b", True, 5, 2), ("e", True, 5, 3)]
    ordered = spark.createDataFrame([rows[2], rows[3], rows[0], rows[1]], schema).coalesce(1)
    found = {r["first"]: bytes(r.levels) for r in M.ngram_levels(ordered, 3, 1, 2, 1.4, 64).collect()}
    assert sorted(found) == [0, 2]
    # "a", "b", "c", the end, "a b" and "b c" occur twice; the second stretch has neither "c" nor "b c"
    assert [sum(x > 0 for x in found[first]) for first in (0, 2)] == [7, 4]


@pytest.mark.parametrize("key_bits", [8, 40, 62])
def test_order_and_steps(key_bits):
    keys = np.random.default_rng(3).integers(0, 2**key_bits, 5000, dtype=np.uint64)
    assert np.array_equal(M._order(keys, key_bits), np.argsort(keys, kind="stable"))
    prints = np.unique((keys & M._LOW).astype(np.uint32))
    assert np.array_equal(M._from_steps(M._steps(prints)), prints)
    assert len(M._order(keys[:0], key_bits)) == 0 and len(M._from_steps(M._steps(prints[:0]))) == 0
