"""Text and rounding expressions (Column -> Column), all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trainlake import schemas as S

# ---- Fixed values -------------------------------------------------------------------------------
NO_VALUE = "—"
TAPER_MARK = " [TAPER EXPECTED — recovery row]"
EMPTY_NOTES = "(No previous coaching context available)"
# The characters that count as white space between words.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same characters for the JVM, the rare ones behind one range check: twice as fast on long texts.
WORD_GAP = (
    r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{85}\x{a0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]+"
)
NOT_WHITESPACE = WHITESPACE.replace("[", "[^", 1)
REPEATED_KM = r"^(\d+)[xX](\d+(?:\.\d+)?)\s*km"
SINGLE_KM = r"(\d+(?:\.\d+)?)\s*km"
CODE_FENCE = "```"


def _round_exact(value: Column, scale: int, powers: list[int]) -> Column:
    """Round ``value * scale`` by its exact value, ties to even. ``powers`` are powers of two with the sum
    ``scale``.

    Only where the product comes out as a tie can its own rounding mislead. There the difference of the
    exact partial products to it is free of error and tells on which side the value lies.
    """
    x = value.cast("double")
    product = x * scale
    beyond = x * powers[0] - product
    for power in powers[1:]:
        beyond = beyond + x * power
    looks_tied = (product - F.floor(product)) == 0.5
    return F.rint(product + F.when(looks_tied, F.signum(beyond) * 0.25).otherwise(0.0)) / scale


def round_tenths(value: Column) -> Column:
    return _round_exact(value, 10, [8, 2])


def round_hundredths(value: Column) -> Column:
    return _round_exact(value, 100, [64, 32, 4])


def round_tenths_by_product(value: Column) -> Column:
    """Rounding as arrays do it: the product is rounded as it comes out (0.15 gives 0.2, not 0.1)."""
    return F.rint(value.cast("double") * 10) / 10


def one_digit(value: Column) -> Column:
    """``value`` with one digit after the point."""
    return F.when(value.isNotNull(), F.format_string("%.1f", round_tenths(value)))


def format_split(sec: Column, suffix: str = "/500m", null_text: str = NO_VALUE) -> Column:
    """``m:SS.t`` from integer tenths of a second, so the seconds never show as 60.0."""
    tenths = F.floor(sec.cast("double") * 10 + 0.5).cast("bigint")
    text = F.format_string(
        "%d:%02d.%d" + suffix.replace("%", "%%"),
        F.floor(tenths / 600).cast("bigint"),
        F.floor((tenths % 600) / 10).cast("bigint"),
        (tenths % 10).cast("bigint"),
    )
    return F.when(sec.isNull(), F.lit(null_text)).otherwise(text)


def signed_seconds(delta: Column, zero_sign: str = "") -> Column:
    """``+1.2s`` / ``-1.2s``; ``zero_sign`` is put before an exact zero; NULL is a dash."""
    sign = F.when(delta > 0, F.lit("+")).otherwise(F.when(delta == 0, F.lit(zero_sign)).otherwise(F.lit("")))
    return F.when(delta.isNull(), F.lit(NO_VALUE)).otherwise(F.concat(sign, one_digit(delta), F.lit("s")))


def direction(delta: Column) -> Column:
    return F.when(delta < 0, "FASTER (improved)").when(delta.isNotNull(), "SLOWER (regressed)")


def trend(delta: Column) -> Column:
    return F.when(delta < 0, "improving (getting faster)").when(delta.isNotNull(), "declining (getting slower)")


def short_trend(delta: Column) -> Column:
    return F.when(delta < 0, "improving").when(delta.isNotNull(), "declining")


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def session_label(distance: Column, split: Column, day_text: Column) -> Column:
    has_distance = distance.isNotNull() & (distance != 0)
    metres = F.concat(thousands(distance), F.lit(" m"))
    return (
        F.when(
            has_distance & split.isNotNull() & (split != 0),
            F.concat(metres, F.lit(" · "), format_split(split, suffix="")),
        )
        .when(has_distance, metres)
        .when(day_text != "", day_text)
        .otherwise(F.lit("coaching tip"))
    )


def truncate(text: Column, size: int = 1000) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def double_asterisks(text: Column) -> Column:
    return F.replace(text, F.lit("*"), F.lit("**"))


def planned_km(label: Column) -> Column:
    repeats = F.regexp_extract(label, REPEATED_KM, 1)
    each = F.regexp_extract(label, REPEATED_KM, 2)
    single = F.regexp_extract(label, SINGLE_KM, 1)
    return (
        F.when(label.isNull(), F.lit(0.0))
        .when(repeats != "", repeats.cast("double") * each.cast("double"))
        .when(single != "", single.cast("double"))
        .otherwise(F.lit(0.0))
    )


def strip_code_fence(answer: Column) -> Column:
    text = strip(answer)
    inside = F.regexp_replace(F.split_part(text, F.lit(CODE_FENCE), F.lit(2)), "^json", "")
    return strip(F.when(F.startswith(text, F.lit(CODE_FENCE)), inside).otherwise(text))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(NOT_WHITESPACE), F.lit(False))


def first_words(text: Column, ratio: float = S.SUMMARY_RATIO) -> Column:
    """The first ``ratio`` of the words, at least one, joined by single spaces."""
    words = F.split(strip(text), WORD_GAP)

    def start(of: Column) -> Column:
        keep = F.greatest(F.lit(1), F.floor(F.size(of) * F.lit(float(ratio))).cast("int"))
        return F.array_join(F.slice(of, F.lit(1), keep), " ")

    # Through a one-element array, so that the text is split once for both the count and the words.
    return F.transform(F.array(words), start)[0]


def note_line(created_at: Column, author: Column, tag: Column, expect_taper: Column, text: Column) -> Column:
    who = F.when(author == "coach", "Coach").otherwise("Athlete")
    tag_part = F.when(F.coalesce(tag, F.lit("")) != "", F.concat(F.lit(" ["), tag, F.lit("]"))).otherwise("")
    taper_part = F.when(F.coalesce(expect_taper, F.lit(False)), F.lit(TAPER_MARK)).otherwise("")
    return F.concat(
        F.lit("["), F.date_format(created_at, "yyyy-MM-dd HH:mm"), F.lit("] "), who, tag_part, taper_part,
        F.lit(": "), text,
    )


def note_id(created_at: Column, *identity: Column) -> Column:
    """Time stamp plus a hash of the identifying columns: unique without coordination."""
    return F.concat(
        F.lit("tip_"), F.date_format(created_at, "yyyyMMddHHmmssSSSSSS"), F.lit("_"),
        F.lower(F.hex(F.xxhash64(*identity))),
    )
