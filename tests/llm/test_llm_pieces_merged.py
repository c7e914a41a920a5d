"""The ids of the query and the stage are the library's for the unchanged model."""

import random

from corpus import hard, hard_rows, none
from sentencepiece import SentencePieceProcessor

from trainlake.llm import piece_lattice as P
from trainlake.llm.common import read


def library():
    return SentencePieceProcessor(model_file=P.MODEL)


def test_query_is_the_library(spark, data):
    model, texts = library(), {r.doc_id: r.text for r in read(spark, data, "documents").collect()}
    found = P.op6_sentencepiece(spark, data).collect()
    assert len(found) == len(texts) and all(list(r.ids) == model.encode(texts[r.doc_id] or "") and r.round_trip for r in found)


def test_stage_is_the_library_on_hard_rows(spark, data):
    model = library()
    found = sorted((r.doc_id or -1, list(r.ids)) for r in P.sentencepiece_stage(spark, hard(spark), data).collect())
    assert found == sorted((i or -1, model.encode(t or "")) for i, t, _ in hard_rows())
    assert P.sentencepiece_stage(spark, none(spark), data).count() == 0


def test_random_texts(spark):
    rng, model = random.Random(8), library()
    parts = ["th", "er", "tion", "ing", "a", "aaa", "é", "ñ", "K", "99", "漢", " ", "   ", "\n", "\t", "😀", "\x00", "▁", "--", "=" * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)] + ["ab" * 4000, " " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = P.encode(docs, P.Vocabulary(), frequent_share=0.001, encode_as="bpe").collect()
    assert len(found) == len(texts) and all(list(r.ids) == model.encode(texts[r.doc_id]) and r.round_trip for r in found)
