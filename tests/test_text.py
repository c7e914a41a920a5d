import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from trainlake.functions import text


@pytest.mark.parametrize(
    "sec, expected",
    [(135.0, "2:15.0/500m"), (119.96, "2:00.0/500m"), (59.94, "0:59.9/500m"), (0.0, "0:00.0/500m"), (None, "—")],
)
def test_split_format(one, sec, expected):
    assert one(text.format_split(F.lit(sec).cast("double"))) == expected


def test_split_format_variants(one):
    assert one(text.format_split(F.lit(165.25), suffix="")) == "2:45.3"
    assert one(text.format_split(F.lit(None).cast("double"), null_text="N/A")) == "N/A"


def test_rounding_equals_python(spark):
    generator = random.Random(7)
    values = [k / 60 for k in range(0, 6000, 3)] + [k / 1000 for k in range(50, 9000, 5)]
    values += [generator.uniform(-500, 500) for _ in range(2000)] + [0.25, 0.75, 2.5, -0.04, -0.05, 0.35, 1e-12]
    values += [-v for v in values[:500]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    for row in df.select(
        "v", text.round_tenths(v).alias("r"), text.one_digit(v).alias("t"), text.round_hundredths(v).alias("h"),
        text.round_tenths_by_product(v).alias("p"),
    ).collect():
        assert row.r == round(row.v, 1), row
        assert row.h == round(row.v, 2), row
        assert row.p == float(np.round(row.v, 1)), row
        if row.v != 0:
            assert row.t == f"{row.v:.1f}", row


@pytest.mark.parametrize(
    "delta, plain, signed",
    [(1.2, "+1.2s", "+1.2s"), (-1.24, "-1.2s", "-1.2s"), (0.0, "0.0s", "+0.0s"), (None, "—", "—"), (-0.01, "-0.0s", "-0.0s")],
)
def test_signed_seconds(one, delta, plain, signed):
    column = F.lit(delta).cast("double")
    assert one(text.signed_seconds(column), text.signed_seconds(column, zero_sign="+")) == (plain, signed)


def test_labels_of_change(one):
    for delta, direction, trend in [(-0.1, "FASTER", "improving"), (0.0, "SLOWER", "declining"), (3.0, "SLOWER", "declining")]:
        found = one(text.direction(F.lit(delta)), text.trend(F.lit(delta)), text.short_trend(F.lit(delta)))
        assert found[0].startswith(direction) and found[1].startswith(trend) and found[2] == trend
    assert one(text.direction(F.lit(None).cast("double")), text.trend(F.lit(None).cast("double"))) == (None, None)


@pytest.mark.parametrize(
    "label, km",
    [("3x1km intervals", 3.0), ("5km easy", 5.0), ("4X1.5 km", 6.0), ("Rest", 0.0), ("warm 2x3km", 3.0), (None, 0.0), ("", 0.0)],
)
def test_planned_km(one, label, km):
    assert one(text.planned_km(F.lit(label).cast("string"))) == km


@pytest.mark.parametrize(
    "answer, inner",
    [
        ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), (' ```\n{"a": 1}\n``` bye', '{"a": 1}'),
        ("```json", ""), ("plain ``` text", "plain ``` text"),
    ],
)
def test_code_fence(one, answer, inner):
    assert one(text.strip_code_fence(F.lit(answer))) == inner


def test_session_label(one):
    label = lambda d, s, day: one(
        text.session_label(F.lit(d).cast("int"), F.lit(s).cast("float"), F.lit(day))
    )
    assert label(4500, 168.6, "2024-01-05") == "4,500 m · 2:48.6"
    assert label(4500, None, "2024-01-05") == "4,500 m"
    assert label(None, None, "2024-01-05") == "2024-01-05"
    assert label(0, 150.0, "") == "coaching tip"


def test_truncate_keeps_short_texts(one):
    assert one(text.truncate(F.lit("a" * 1000))) == "a" * 1000
    assert one(text.truncate(F.lit("a" * 1001))) == "a" * 1000 + "..."
    assert one(text.double_asterisks(F.lit("*bold* x"))) == "**bold** x"


def test_words_are_split_at_any_white_space(spark):
    generator = random.Random(3)
    spaces = [" ", "\t", "\n", "\r\n", " ", " ", "　", "\x1c", "\x85", " ", "  "]
    texts = ["", " ", " \n"]
    for n in range(200):
        words = ["".join(generator.choices(string.ascii_letters + "é世", k=generator.randint(1, 6))) for _ in range(n)]
        texts.append(generator.choice(["", " ", " "]) + "".join(w + generator.choice(spaces) for w in words))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", text.first_words(F.col("t")).alias("s"), text.is_blank(F.col("t")).alias("b")).collect():
        words = row.t.split()
        assert row.s == " ".join(words[: max(1, int(len(words) * 0.3))])
        assert row.b == (row.t.strip() == "")


def test_white_space_is_that_of_python(spark):
    """Every character up to U+3100, alone between two words."""
    letters = [chr(i) for i in range(1, 0x3100)]
    df = spark.createDataFrame([(c, f"a{c}b " * 10) for c in letters], "c string, t string")
    gap = F.size(F.split(F.col("c"), text.WORD_GAP)) > 1
    found = df.select("c", gap.alias("gap"), text.is_blank(F.col("c")).alias("blank"), text.strip(F.col("c")).alias("s"))
    for row in found.collect():
        assert row.gap == row.blank == (row.s == "") == row.c.isspace(), repr(row.c)


def test_note_line(one):
    moment = F.lit("2024-01-05 07:09:30").cast("timestamp_ntz")
    line = lambda author, tag, taper: one(
        text.note_line(moment, F.lit(author), F.lit(tag).cast("string"), F.lit(taper).cast("boolean"), F.lit("Easy."))
    )
    assert line("coach", "recovery", True) == "[2024-01-05 07:09] Coach [recovery] [TAPER EXPECTED — recovery row]: Easy."
    assert line("athlete", None, None) == "[2024-01-05 07:09] Athlete: Easy."


def test_note_ids_differ_by_content(one):
    moment = F.lit("2024-01-05 07:09:30.123456").cast("timestamp_ntz")
    a, b = one(text.note_id(moment, F.lit("x")), text.note_id(moment, F.lit("y")))
    assert a != b and a.startswith("tip_20240105070930123456_")
