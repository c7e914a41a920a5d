"""Small corpora with the cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, row string, place long, key string, slot long"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) + str(rng.randrange(40)) for _ in range(n))


def hard_rows():
    """(doc_id, text, source): nulls in any column, empty and very long texts, copies, repeated rows and ties."""
    base = words(1, 60)
    near = base.split()
    near[30] = "other"
    passage = words(2, 70)
    return [
        (1, base, "a"), (2, base, "a"), (3, base + " ", "b"), (4, " ".join(near), "a"), (5, None, "a"), (6, "", "b"), (7, "   \n", None),
        (None, base, "a"), (None, "no id here at all", None), (8, "one", "c"), (8, "one", "c"), (9, words(3, 30000), "a"),
        (10, "first line\n" + passage + "\nlast line", "b"), (11, words(4, 12) + "\n" + passage, "b"), (12, "é ñ 漢字 😀 ▁x\n\n a  b", "a"),
        (13, "x" * 3000, "c"), (14, words(5, 8) + "\r\n" + words(6, 8), "d"),
    ]


def hard(spark):
    """The rows with more columns, whose names the operators use inside."""
    rows = [(i, t, s, "en", None if t is None else len(t), "mine", 7, "k", 9) for i, t, s in hard_rows()]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
