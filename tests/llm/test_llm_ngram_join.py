import random
from collections import Counter

import pytest
from corpus import hard, hard_rows, none, words

from trainlake.llm import ngram_join as J
from trainlake.llm.common import components


def grams(text, n=5):
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, similarity=0.8):
    """(group of each row by its first row, links of each row): every pair is compared."""
    sets = [grams(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = b" ".join((rows[i][1] or "").lower().encode().split()) == b" ".join((rows[j][1] or "").lower().encode().split())
            common = len(sets[i] & sets[j])
            if same or (common and common / len(sets[i] | sets[j]) >= similarity):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, links


def edited(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(8)
    rows = [(i, t) for i, t, _ in hard_rows() if i is not None]
    base = words(77, 300)
    rows += [(1000 + i, edited(base, rng, i % 9)) for i in range(60)]  # a large group of near copies, chained
    rows += [(2000 + i, words(i, 40)) for i in range(40)] + [(2100 + i, words(i, 40) + " end") for i in range(40)]
    return [(i, t) for i, t in dict(rows).items()]


@pytest.mark.parametrize("block_bytes,block_rows,tile", [(J.BLOCK_BYTES, J.BLOCK_ROWS, 512), (1 << 14, 7, 3)])
def test_links_and_groups_as_brute_force(spark, monkeypatch, block_bytes, block_rows, tile):
    monkeypatch.setattr(J, "_TILE", tile)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, 1) for i, t in rows], "doc_id long, text string, bucket string, low int, copies int")
    found = {r.doc_id: r for r in J.near_duplicates(df, block_bytes=block_bytes, block_rows=block_rows).collect()}
    root, links = brute(rows)
    smallest = {}
    for (doc_id, _), r in zip(rows, root):
        smallest[r] = min(doc_id, smallest.get(r, doc_id))
    assert len(found) == len(rows) and max(links) > 30
    for (doc_id, _), r, n in zip(rows, root, links):
        assert (found[doc_id].group_id, found[doc_id].n_links) == (smallest[r], n)


def test_stage_keeps_one_of_each_group(spark, data):
    docs = hard(spark)
    kept = J.near_duplicate_stage(spark, docs, data)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    rows = [(i, t) for i, t, _ in hard_rows()]
    first = {}
    for (doc_id, _), r in zip(rows, brute(rows)[0]):
        first[r] = min(first.get(r, 10**9), 10**9 if doc_id is None else doc_id)
    assert ids == Counter(None if i == 10**9 else i for i in first.values())
    assert J.near_duplicate_stage(spark, none(spark), data).count() == 0


def test_rows_without_words_and_nulls(spark):
    found = J.near_duplicates(hard(spark)).collect()
    assert len(found) == len(hard_rows())
    empty = [r for r in found if r.doc_id in (5, 6, 7)]
    assert {r.group_id for r in empty} == {5} and all(r.n_links == 2 for r in empty)
    assert all(r.n_links == 1 for r in found if r.doc_id == 8)


def test_banding_reaches_the_recall():
    for similarity, recall in ((0.8, 0.9999), (0.5, 0.9), (0.95, 0.999)):
        bands, rows = J.banding(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= J.MAX_HASHES
    with pytest.raises(ValueError):
        J.banding(0.1, 0.999999)


def test_components_of_long_paths_and_stars(spark):
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(100)]
    star = [("s500", f"s{i:03}") for i in range(50)] + [("x", "x"), ("y1", "y0"), ("y1", "y0")]
    rng = random.Random(1)
    edges = path + star
    rng.shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {found[f"p{i:03}"] for i in range(101)} == {"p000"}
    assert {found[f"s{i:03}"] for i in range(50)} == {"s000"} and found["s500"] == "s000" and found["y1"] == found["y0"] == "y0"
