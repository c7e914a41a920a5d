"""Toxicity: the label model against planted truth, the matcher against plain counts, held-out accuracy of the query."""

import numpy as np
from corpus import hard, none
from pyspark.sql import functions as F

from trainlake.llm.common import read
from trainlake.llm.toxicity import ANNOTATOR, KINDS, LEXICON, VOTERS, LabelModel, Matcher, Toxicity, mined_terms, normal, op11_toxicity, terms_of


def patterns_of(votes):
    values, counts = np.unique(votes, axis=0, return_counts=True)
    return values, counts


def drawn(rng, n, rates, rate=0.1, labelled=0.3, copies=()):
    """Votes of voters with (says 1 in class 1, in class 0); ``copies`` repeat another voter nine times out of ten."""
    truth = rng.random(n) < rate
    votes = np.column_stack([rng.random(n) < np.where(truth, a, b) for a, b in rates]).astype(np.int64)
    for j, of in copies:
        votes[:, j] = np.where(rng.random(n) < 0.9, votes[:, of], votes[:, j])
    says = rng.random(n) < np.where(truth, ANNOTATOR[1], ANNOTATOR[0])
    label = np.where(rng.random(n) < labelled, np.where(says, 1, 2), 0)
    nothing = ~votes.any(1)
    return truth, np.column_stack([votes, nothing, label])


def test_label_model_finds_rates_of_independent_voters():
    rates = [(0.8, 0.02), (0.6, 0.05), (0.9, 0.1), (0.5, 0.01)]
    truth, votes = drawn(np.random.default_rng(1), 40000, rates)
    model = LabelModel(*patterns_of(votes[:, [0, 1, 2, 3, 5]]), 4)
    assert abs(model.rate - truth.mean()) < 0.01
    for j, (good, bad) in enumerate(rates):
        a, b = model.accuracies()[j]
        assert abs(a - good) < 0.04 and abs(b - bad) < 0.01
    assert all(len(g) == 1 for g in model.groups)


def test_label_model_joins_voters_that_copy_each_other():
    rates = [(0.7, 0.05), (0.7, 0.05), (0.7, 0.05), (0.8, 0.03), (0.75, 0.04)]
    truth, votes = drawn(np.random.default_rng(2), 40000, rates, copies=[(1, 0), (2, 0)])
    values, counts = patterns_of(votes[:, [0, 1, 2, 3, 4, 6]])
    model = LabelModel(values, counts, 5)
    assert [0, 1, 2] in [sorted(g) for g in model.groups] and abs(model.rate - truth.mean()) < 0.01
    apart = LabelModel(values, counts, 5, most_in_group=1)
    weight = counts * (values[:, 5] == 0)
    odd = (values[:, :3].all(1)) & (values[:, 3:5].sum(1) == 0)  # three voters that are really one
    assert (model.posterior * weight)[odd].sum() < 0.7 * (apart.posterior * weight)[odd].sum()


def test_matcher_counts_as_a_plain_search():
    mined = [" abc ", " abcd", "bcdef", " abce"]
    matcher = Matcher(mined)
    text = "Abc abcdefg! xbcdefy IDIOT, 1d10t abc\nTrottel s3cur1ty"
    n_words, votes, groups, terms = matcher(text)
    plain = normal(text)
    assert n_words == 8 and terms == [i for i, t in enumerate(mined) if t in plain]
    named = dict(zip(VOTERS, [votes >> i & 1 for i in range(len(VOTERS))], strict=True))
    assert named["lexicon_en"] and named["lexicon_other"] and named["disguised"] and named["several"] and not named["none"]
    assert round(np.expm1(groups[KINDS.index("lexicon_en")])) == 1
    assert matcher("")[0] == 0 and matcher("")[1] == 0 and matcher("fine words")[1] == 1 << VOTERS.index("none")
    assert {" abcdefg ", " abcd", "bcdef"} <= terms_of("Abcdefg") and len(LEXICON) == 4


def test_mined_terms(spark):
    rows = [(f"common nastyword{i} text" if i < 20 else f"common text number{i}", float(i < 20)) for i in range(200)]
    rows += [(f"rare seldom{i % 3}", 1.0) for i in range(3)]
    found = mined_terms(spark.createDataFrame(rows, "body string, label double"))
    assert " nasty" in found and "astyw" in found and not any("common" in t or "text" in t or "seld" in t for t in found)


def test_query(spark, data):
    docs, labels = read(spark, data, "documents"), read(spark, data, "labels")
    found = op11_toxicity(spark, data)
    rows = found.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    insulted = {r.doc_id for r in docs.where("text rlike '(?i)\\\\b(idiot|moron|pathetic|worthless|scum)\\\\b'").collect()}
    assert insulted and all(r.predicted == 1 for r in rows if r.doc_id in insulted)
    clean = [r for r in rows if r.toxic == 0 and r.held_out]
    assert sum(r.predicted for r in clean) < 0.1 * len(clean)


def test_held_out_labels_do_not_matter(spark, data):
    docs, labels = read(spark, data, "documents").limit(150), read(spark, data, "labels")
    held_out = F.col("doc_id") % 3 == 1
    turned = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted(map(tuple, Toxicity(docs, x, held_out).scores.select("doc_id", "score").collect())) for x in (labels, turned))
    assert first == second


def test_hard_rows(spark):
    labels = spark.createDataFrame([(1, 0, "k"), (9, 1, "k"), (9, 0, "k"), (None, 1, "k"), (4, None, "k")], "doc_id long, toxic int, key string")
    insulted = [(50 + i, "you stupid worthless idiot, scum " * 3 + f"and {i}") for i in range(4)]
    clean = [(100 + i, f"some clean words of text number {i} " * 4) for i in range(40)]
    extra = spark.createDataFrame(insulted + clean, "doc_id long, text string")
    docs = hard(spark).unionByName(extra, allowMissingColumns=True)
    for held_out, known in ((F.col("doc_id") % 2 == 1, labels), (F.lit(False), labels.limit(0))):
        found = Toxicity(docs, known, held_out).scores.collect()
        assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
        best = sorted(found, key=lambda r: -r.score)[:4]
        assert {r.doc_id for r in best} == {50, 51, 52, 53}
    assert Toxicity(none(spark), labels, F.lit(False)).scores.collect() == []
