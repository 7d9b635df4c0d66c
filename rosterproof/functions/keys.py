"""Match keys and single-value validators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterproof.functions import fixed
from rosterproof.functions.text import bind, blank_to_null, trim_blanks

CHECK_DIGIT_WEIGHTS = range(13, 1, -1)
# Blanks and punctuation of names. Letters, which names mostly hold, are decided by the first test.
NAME_MARKS = rf"[[^A-Za-z0-9{fixed.THAI}]&&[{fixed.BLANK}()._/\\–—-]]"


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def name_key(c: Column) -> Column:
    """Lower-case name without blanks and punctuation; '' for a missing name."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), NAME_MARKS, ""))


def code_key(c: Column) -> Column:
    """Digits without leading zeros, or the lower-case text if it has no digit."""
    s = trim_blanks(F.coalesce(c, F.lit("")))
    return F.when(
        s.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(s, "[^0-9]", ""), "^0+", "")
    ).otherwise(F.lower(s))


def has_text(c: Column) -> Column:
    """Present and not blank; false (never null) for a missing value."""
    return F.length(trim_blanks(F.coalesce(c, F.lit("")))) > 0


def given(c: Column) -> Column:
    """Present and not the empty string."""
    return F.coalesce(c, F.lit("")) != ""


def first_given(*cols: Column) -> Column:
    """First non-empty value, null when there is none."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def code_format_status(c: Column) -> Column:
    """pass / fail / warn by the shape of a facility code; null when missing."""
    v = trim_blanks(c)
    return F.when(
        given(c),
        F.when(v.rlike(r"\A[A-Za-z]+\z"), "fail")
        .when(v.rlike(r"\A(?i:TEST)"), "fail")
        .when(v.rlike(r"\A[A-Za-z0-9]{9}\z"), "pass")
        .otherwise("warn"),
    )


def email_ok(c: Column) -> Column:
    part = f"[^{fixed.BLANK}@]+"
    return c.rlike(rf"\A{part}@{part}\.{part}\z")


def email_status(c: Column) -> Column:
    return F.when(~given(c), "warn").when(email_ok(c), "pass").otherwise("fail")


def phone_format_ok(c: Column) -> Column:
    return F.regexp_replace(c, f"[{fixed.BLANK}-]", "").rlike(r"\A0[0-9]{8,9}\z")


def postal_format_ok(c: Column) -> Column:
    return c.rlike(r"\A[0-9]{5}\z")


def any_format_status(c: Column, patterns: list[str]) -> Column:
    """pass when any pattern matches, else warn; null when missing."""
    hit = reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])
    return F.when(given(c), F.when(hit, "pass").otherwise("warn"))


def check_digit_ok(digits: Column) -> Column:
    """Check digit of a 13-digit national ID. The input holds digits only."""

    def digit(i: int) -> Column:
        return F.substring(digits, i, 1).try_cast("int")

    total = reduce(
        lambda a, b: a + b, [digit(i + 1) * w for i, w in enumerate(CHECK_DIGIT_WEIGHTS)]
    )
    return F.when(F.length(digits) == 13, (11 - total % 11) % 10 == digit(13)).otherwise(False)


def thai_id_valid(c: Column) -> Column:
    return bind(digits_only(F.coalesce(c, F.lit(""))), check_digit_ok)


def thai_id_reason(c: Column) -> Column:
    def reason(d: Column) -> Column:
        return (
            F.when(F.length(d) != 13, F.format_string("ต้อง 13 หลัก (พบ %d)", F.length(d)))
            .when(check_digit_ok(d), "Checksum ถูกต้อง ")
            .otherwise("Checksum ไม่ถูกต้อง ")
        )

    return F.when(~given(c), "ไม่มีเลขบัตร").otherwise(bind(digits_only(c), reason))


def same_id(a: Column, b: Column) -> Column:
    return digits_only(a) == digits_only(b)


def full_name(prefix: Column, first: Column, last: Column) -> Column:
    """Prefix, first and last name; null when neither first nor last is given."""
    parts = [blank_to_null(c) for c in (prefix, first, last)]
    return F.when(given(first) | given(last), F.concat_ws(" ", *parts))
