import random

import pytest
from corpus import hard, hard_rows, none
from sentencepiece import SentencePieceProcessor

from trainlake.llm import piece_lattice as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary()


def viterbi(unit, vocabulary, table):
    best = [(0.0, 0, [])]
    for end in range(1, len(unit) + 1):
        chosen = None
        for size in range(min(vocabulary.longest, end), 0, -1):
            piece = unit[end - size : end]
            if piece in table:
                ids, score = [table[piece][0]], table[piece][1]
            elif size == 1:
                ids, score = [vocabulary.bytes[b] for b in piece.encode()], vocabulary.unknown
            else:
                continue
            if chosen is None or best[end - size][0] + score > chosen[0]:
                chosen = best[end - size][0] + score, size, ids
        best.append(chosen)
    out, end = [], len(unit)
    while end:
        out = best[end][2] + out
        end -= best[end][1]
    return out


def test_as_brute_force_on_hard_rows(spark, vocabulary):
    found = {}
    for r in P.encode(hard(spark), vocabulary, frequent_share=0.01).collect():
        found.setdefault((r.doc_id, r.text), list(r.ids))
    table = {p: (i, s) for p, i, s in vocabulary.pieces}
    for doc_id, text, _ in hard_rows():
        expected = [i for u in P.units(text or "") for i in viterbi(u.replace(" ", P.SPACE), vocabulary, table)]
        assert found[doc_id, text or ""] == expected


def test_round_trip_of_random_texts(spark, vocabulary):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab  \n\té漢😀.-Z\x00") for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = P.decode(P.encode(docs, vocabulary), vocabulary).collect()
    assert len(rows) == 200 and all(r.decoded == r.text == texts[r.doc_id] for r in rows)


def _varint(data, at):
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _fields(data):
    """(number, first byte of the value, end) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind, first = tag & 7, at
        if kind == 0:
            _, at = _varint(data, at)
        elif kind == 2:
            size, first = _varint(data, at)
            at = first + size
        else:
            at += 8 if kind == 1 else 4
        yield tag >> 3, first, at


def test_as_the_library_with_the_same_scores(spark, vocabulary):
    """The model file with its type changed to unigram makes the library look for the best path, too."""
    data = bytearray(open(P.MODEL, "rb").read())
    number, first, end = next(f for f in _fields(data) if f[0] == 2)
    kind = next(f for f in _fields(bytes(data[first:end])) if f[0] == 3)
    data[first + kind[1]] = 1
    library = SentencePieceProcessor(model_proto=bytes(data))
    rng = random.Random(2)
    texts = ["".join(rng.choice(["th", "er", "tion", "ing", "a", "é", "ñ", "K", "9", "漢"]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {i: s for _, i, s in vocabulary.pieces}
    same = 0
    for r in P.encode(docs, vocabulary).collect():
        own, other = list(r.ids), library.encode(r.text)
        same += own == other
        # never worse: bytes of a character without a piece have no score of their own, and both have the same ones
        assert sum(scores.get(i, 0) for i in own) >= sum(scores.get(i, 0) for i in other)
    assert same >= 0.99 * len(texts)


def test_empty_tables_and_texts(spark, vocabulary):
    assert P.encode(none(spark), vocabulary).count() == 0
    ids = {r.doc_id: list(r.ids) for r in P.encode(hard(spark), vocabulary).collect()}
    assert ids[5] == ids[6] == [] and len(ids[13]) > 100


def test_decode_ignores_what_is_no_text(spark, vocabulary):
    rows = spark.createDataFrame([([1, 2, 0, 99999],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in P.decode(rows, vocabulary).collect()] == ["", None, ""]
