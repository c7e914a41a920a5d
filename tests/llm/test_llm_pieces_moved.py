"""What encoding keeps and moves for rare units, and the cuts that make them fewer."""

import os
import random
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from sentencepiece import SentencePieceProcessor

from trainlake.llm import piece_lattice as P


def rare_docs(spark):
    """Texts of words that hardly any other text has; each text comes twice."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "er", "th", "io", "ne", "st", "ch"]) for _ in range(rng.randrange(2, 6))) + rng.choice(["", ",", ".", "!!"])
    texts = [" ".join(word() for _ in range(150)) for _ in range(300)]
    return spark.createDataFrame([(i, texts[i % 300]) for i in range(600)], "doc_id long, text string"), texts


def test_rare_units_are_kept_once_and_moved_with_the_texts(spark, monkeypatch):
    kept = []

    def stored(df, label, put=P.stored):
        kept.append(put(df, label))
        return kept[-1]

    monkeypatch.setattr(P, "stored", stored)
    docs, texts = rare_docs(spark)
    vocabulary, model = P.Vocabulary(), SentencePieceProcessor(model_file=P.MODEL)
    found = P.encode(docs, vocabulary, encode_as="bpe", with_text=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert len(kept) == 1 and sum(os.path.getsize(urlparse(f).path) for f in kept[0].inputFiles()) < sum(map(len, texts))
    rows = found.collect()
    assert len(rows) == 600 and all(list(r.ids) == model.encode(texts[r.doc_id % 300]) and r.round_trip for r in rows)


def test_several_buckets_with_wide_numbers(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_BYTES", 2400)
    docs, texts = rare_docs(spark)
    model = SentencePieceProcessor(model_file=P.MODEL)
    rows = P.encode(docs, P.Vocabulary(), frequent_share=0.01, encode_as="bpe").collect()
    assert len(rows) == 600 and all(r.text == texts[r.doc_id % 300] and list(r.ids) == model.encode(r.text) for r in rows)


def test_words_and_cuts_give_whole_units():
    vocabulary, rng = P.Vocabulary(), random.Random(7)
    assert all(len(vocabulary.cut.findall(p.replace(P.SPACE, " "))) == 1 for p, _, _ in vocabulary.pieces)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "é", " ", "  ", "\n", ",", "7", "²", P.SPACE, "漢", "\t"]) for _ in range(rng.randrange(12)))
        for cut in (P._UNITS, vocabulary.cut):
            found = [u for w in P.words(text) for u in cut.findall(" " + w)]
            assert found == (cut.findall(" " + text.replace(P.SPACE, " ")) if text else [])


def test_short_units_merge_as_long_ones():
    rng = random.Random(9)
    for _ in range(500):
        size = rng.randrange(1, 14)
        edges = {(a, b): (rng.randrange(12), 0) for a in range(size) for b in range(a + 1, size + 1) if rng.random() < 0.6}
        assert P.merged_short(size, edges) == P.merged(size, edges)


def test_units_merged_together_as_one_by_one():
    rng, longest = random.Random(11), 5
    ranks = np.array([*(rng.randrange(9) for _ in range(40)), P._NO_RANK])
    sizes = np.array([rng.randrange(15) for _ in range(300)])
    places = np.full((len(sizes), 14, longest + 1), -1)
    for row, size in enumerate(sizes):
        for begin in range(size):
            for length in range(1, min(longest, size - begin) + 1):
                if rng.random() < 0.6:
                    places[row, begin, length] = rng.randrange(40)
    ends = P.merged_together(sizes, places, ranks)
    for row, size in enumerate(sizes.tolist()):
        edges = {(b, b + k): (ranks[places[row, b, k]], 0) for b in range(size) for k in range(1, longest + 1) if places[row, b, k] >= 0}
        assert [*np.flatnonzero(ends[row]).tolist(), size] == (P.merged(size, edges) if size else [0])


class Counted:
    """Takes the place of a table, to call what a task does."""

    def select(self, *columns):
        return self

    def mapInPandas(self, count, schema):
        self.count = count
        raise StopIteration


def test_tasks_count_each_unit_once_per_text_in_small_frames(monkeypatch):
    monkeypatch.setattr(P, "_FRAME_ROWS", 50)
    rng, cut, least = random.Random(12), P.Vocabulary().cut, 4
    texts = [" ".join(rng.choice(["an", "er", "th"]) * rng.randrange(1, 5) + rng.choice(["", ",", "\n"]) for _ in range(30)) for _ in range(20)]
    texts += [f"only{i} word{i}" for i in range(200)]
    table = Counted()
    try:
        P.unit_counts(table, 7, least, cut)
    except StopIteration:
        pass
    frames = list(table.count([pd.DataFrame({"bucket": [i % 7 for i in range(len(texts))], "text": texts})]))
    assert max(map(len, frames)) <= 50
    found = {u: (n, asks) for f in frames for u, n, asks in zip(f["unit"], f["n"], f["asks"])}
    expected = {}
    for i, text in enumerate(texts):
        for unit in set(P.units(text, cut)):
            expected.setdefault(unit.replace(" ", P.SPACE), []).append(i % 7)
    assert found == {u: (len(b), bytes(b) if len(b) < least else None) for u, b in expected.items()}


def test_no_id_becomes_an_object_and_pieces_are_found_by_number(spark, monkeypatch):
    docs, _ = rare_docs(spark)
    plans = []
    monkeypatch.setattr(P, "stored", lambda df, label, put=P.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(df, label))
    found = P.encode(docs, P.Vocabulary(), encode_as="bpe")
    assert "BroadcastHashJoin [hash#" in plans[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow put_together" in plan
