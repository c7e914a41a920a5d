from collections import Counter

from corpus import hard, hard_rows, none, words

from trainlake.llm.line_chunks import line_dedup_stage, without_repeats

SCHEMA = "doc_id long, text string, lines string, pos int, removed string"


def cleaned(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "mine", 1, "mine") for i, t in enumerate(texts)], SCHEMA)
    return {r.row.doc_id: r.text for r in without_repeats(docs, **options).collect()}


def lines(seed, n):
    return [words(seed * 1000 + k, 6) for k in range(n)]


def test_shifted_passages_go_but_for_their_first_place(spark):
    passage = lines(1, 40)
    first = "\n".join(lines(2, 5) + passage)
    found = cleaned(spark, [first, "\n".join(lines(3, 8) + passage + lines(4, 3)), "\n".join(lines(5, 1) + passage)])
    assert found[0] == first
    for doc_id, own in ((1, lines(3, 8) + lines(4, 3)), (2, lines(5, 1))):
        left = found[doc_id].split("\n")
        assert all(line in left for line in own)  # what is the document's own stays
        assert sum(line in left for line in passage) <= 8  # only the edges of the passage can stay


def test_long_lines_are_chunks_of_their_own(spark):
    passage = words(9, 60)
    found = cleaned(spark, ["a\n" + passage + "\nb", "c\n" + passage, passage + "\nd", "e"])
    assert found == {0: "a\n" + passage + "\nb", 1: "c", 2: "d", 3: "e"}


def test_short_single_lines_stay(spark):
    texts = ["license\n" + words(i, 5) for i in range(4)]
    assert list(cleaned(spark, texts).values()) == texts


def test_repeats_within_one_text(spark):
    line = words(3, 55)
    assert cleaned(spark, ["\n".join([line, "x", line, line])])[0] == f"{line}\nx"


def test_bytes_decide_when_hashes_clash(spark):
    """With hashes of one bit nearly all chunks clash; the result is the same."""
    texts = ["\n".join(lines(i % 7, 12)) for i in range(20)]
    found = cleaned(spark, texts, bits=1)
    assert found == cleaned(spark, texts)
    assert all(found[i] == texts[i] for i in range(7)) and all(len(found[i].split("\n")) <= 2 for i in range(7, 20))


def test_hard_rows_in_the_stage(spark, data):
    docs = hard(spark)
    found = line_dedup_stage(spark, docs, data)
    assert found.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in found.collect())
    passage = hard_rows()[12][1].split("\n")[1]
    assert rows[(10, "first line\n" + passage + "\nlast line")] == 1
    assert rows[(11, hard_rows()[13][1].split("\n")[0])] == 1
    assert rows[(5, None)] == rows[(6, "")] == rows[(7, "   \n")] == 1 and rows[(8, "one")] == 2
    assert all(r.n_chars == len(r.text) for r in found.collect() if r.doc_id in (10, 11))
    assert line_dedup_stage(spark, none(spark), data).count() == 0
