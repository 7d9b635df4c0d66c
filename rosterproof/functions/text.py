"""Text normalisation columns (whitespace, Thai script, OCR repair, cleaning)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterproof.functions import fixed

# The classes of ``fixed`` for Java, which tests the parts of a class one by one: ASCII and Thai,
# which texts mostly hold, are decided first, so a search steps over them much faster.
_PLAIN = r"!-~\x{0E00}-\x{0E7F}"
_NOT_PLAIN = r"[\x{0}- \x{7F}-\x{0DFF}\x{0E80}-\x{FFFF}]"
SCAN_WS = f"[{_NOT_PLAIN}&&[{fixed.BLANK}]]"
SCAN_NOT_WS = f"[{_PLAIN}[^{fixed.BLANK}]]"
SCAN_DOT = rf"[ {_PLAIN}[^\n\r\x{{2028}}\x{{2029}}]]"

# Characters that ``normalise_ocr`` rewrites: quotes, and zero-width ones that go.
_QUOTES, _PLAIN_QUOTES = "“”„‘’\u200b\u200c\u200d\ufeff", "\"\"\"\'\'"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    Inside a CASE or OR a repeated expression is computed anew at each place.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def alternation(words: list[str]) -> str:
    """``a|b|c`` with the dots taken literally."""
    return "|".join(w.replace(".", r"\.") for w in words)


def word_pattern(words: list[str]) -> str:
    """Any of the words. Their first letters are tested first: most places fail there."""
    initials = "".join(sorted({w[0] for w in words}))
    return f"(?=[{initials}])(?:{alternation(words)})"


def any_word(c: Column, words: list[str]) -> Column:
    """True when ``c`` contains one of the words."""
    return c.rlike(word_pattern(words))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null when the pattern does not match."""
    return bind(F.regexp_extract(c, pattern, group), blank_to_null)


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(fixed.BLANK_CHARS))


def squeeze_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"{SCAN_WS}+", " ")


def drop_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"{SCAN_WS}+", "")


def strip_tags(c: Column) -> Column:
    """Plain text of a registry cell: tags out, blanks collapsed, trimmed."""
    return trim_blanks(squeeze_blanks(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", "")))


def join_thai(c: Column) -> Column:
    """Rejoin Thai glyphs that OCR split by spaces or tabs. Newlines stay."""
    return F.regexp_replace(c, rf"[ \t](?<=[{fixed.THAI}][ \t])[ \t]*(?=[{fixed.THAI}])", "")


def translate(c: Column, letters: str, into: str, seen: str) -> Column:
    """``F.translate`` of the rows where ``seen``, a class with all the letters, is found.

    It is slow, and most rows hold none of them.
    """
    return bind(c, lambda t: F.when(t.rlike(seen), F.translate(t, letters, into)).otherwise(t))


def ascii_digits(c: Column) -> Column:
    return translate(c, fixed.THAI_DIGITS, fixed.ASCII_DIGITS, "[๐-๙]")


def thai_skeleton(c: Column) -> Column:
    """Thai letters without vowel marks and tones; blanks go, so none are joined first."""
    return F.regexp_replace(c, rf"[{fixed.THAI_MARKS}[^{fixed.THAI}]]+", "")


def normalise_ocr(c: Column) -> Column:
    """The clean-up every document text goes through before extraction."""
    t = join_thai(ascii_digits(F.coalesce(c, F.lit(""))))
    t = translate(t, _QUOTES, _PLAIN_QUOTES, r"[\x{200B}-\x{201E}\x{FEFF}]")
    return F.regexp_replace(t, r"[ \t]{2,}", " ")


def is_boilerplate(c: Column) -> Column:
    return any_word(c, fixed.BOILERPLATE)


def is_junk(
    c: Column, min_thai_ratio: float = 0.5, min_len: int = 4, max_len: int = 90
) -> Column:
    """True when a candidate value must be dropped rather than trusted."""

    def test(v: Column) -> Column:
        n = F.length(v)
        junk = (
            (n < max(1, min_len))
            | (n > max_len)
            | v.rlike(rf'[=|><"\\]|{word_pattern(fixed.BOILERPLATE)}')
            | v.isin(fixed.GENERIC_TERMS)
        )
        if min_thai_ratio > 0:
            thai = F.length(F.regexp_replace(v, f"[^{fixed.THAI}]+", ""))
            junk = junk | (thai < F.lit(float(min_thai_ratio)) * n)
        return junk

    return bind(trim_blanks(F.coalesce(c, F.lit(""))), test)


def keep_unless_junk(c: Column, **opts) -> Column:
    return bind(c, lambda v: F.when(~is_junk(v, **opts), v))


def clean_facility_name(c: Column) -> Column:
    """Peel the label before a facility name and the field after it.

    Both in one search: what is peeled off the start ends before the field.
    """
    lead, end = word_pattern(fixed.FACILITY_LEAD), word_pattern(fixed.FACILITY_END)
    peel = rf"\A(?:{SCAN_DOT}*?{lead}(?:ชื่อ)?|ชื่อ)|{end}{SCAN_DOT}*\z"
    v = F.regexp_replace(F.coalesce(c, F.lit("")), peel, "")
    return F.btrim(v, F.lit(f"{fixed.BLANK_CHARS}:.,ๆ"))


def clean_person_name(c: Column) -> Column:
    """Peel labels around a person name and keep Thai letters and spaces.

    In one search: a label or end is looked for at a place before its letter is dropped.
    """
    lead, end = word_pattern(fixed.PERSON_LEAD), word_pattern(fixed.PERSON_END)
    peel = rf"\A{SCAN_DOT}*?{lead}{fixed.WS}*|{end}{SCAN_DOT}*\z|[^{fixed.THAI} ]"
    v = F.regexp_replace(F.coalesce(c, F.lit("")), peel, "")
    return F.trim(F.regexp_replace(v, " {2,}", " "))
