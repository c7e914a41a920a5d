"""Repeated passages on few short lines."""

import random

from corpus import words

from trainlake.llm.line_chunks import shortest_runs, without_repeats


def cleaned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.row.doc_id: r.text for r in without_repeats(docs, runs=True).collect()}


def test_short_passages_between_unrelated_lines_go(spark):
    rng, texts, passages = random.Random(4), [], []
    for k in range(40):
        n = 2 + k % 5
        passages.append([words(1000 * k + i, 52 // n + 1) for i in range(n)])
    for copy in (1, 2):
        for k, passage in enumerate(passages):
            own = [words(10**6 * copy + 100 * k + i, rng.randrange(3, 30)) for i in range(8)]
            texts.append("\n".join(own[:4] + passage + own[4:]))
    found = cleaned(spark, texts)
    for k, passage in enumerate(passages):
        assert found[k] == texts[k]
        assert found[40 + k].split("\n") == [x for x in texts[40 + k].split("\n") if x not in passage]


def test_shortest_runs_cover_every_passage():
    rng = random.Random(5)
    for _ in range(200):
        counts = [rng.choice([0, 1, 3, 9, 30, 60]) for _ in range(rng.randrange(1, 12))]
        runs = shortest_runs(counts, 50)
        assert all(sum(counts[b:e]) >= 50 for b, e in runs) or sum(counts) < 50
        for b in range(len(counts)):
            for e in range(b + 1, len(counts) + 1):
                if sum(counts[b:e]) >= 50:
                    assert {i for x, y in runs if b <= x and y <= e for i in range(x, y)} == set(range(b, e))


def test_a_run_over_its_own_first_place_leaves_it(spark):
    line = words(3, 20)
    assert cleaned(spark, ["\n".join([line] * 7), "other\n" + words(4, 9)])[0].split("\n") == [line] * 3
