"""Field extraction from normalised document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterproof.functions import fixed
from rosterproof.functions.keys import check_digit_ok, digits_only
from rosterproof.functions.text import (
    SCAN_NOT_WS,
    any_word,
    bind,
    clean_facility_name,
    first_match,
    is_boilerplate,
    is_junk,
    join_thai,
    keep_unless_junk,
    squeeze_blanks,
    translate,
    trim_blanks,
    word_pattern,
)

_TITLED = f"(?:{'|'.join(fixed.THAI_TITLES)})"
_GAP = rf"[{fixed.BLANK}-]*"
_GROUPED_ID = rf"[0-9]{_GAP}[0-9]{{4}}{_GAP}[0-9]{{5}}{_GAP}[0-9]{{2}}{_GAP}[0-9](?![0-9])"
_BARE_ID = "(?<![0-9])([0-9]{13})(?![0-9])"
_FACILITY_RUN = (
    rf"({SCAN_NOT_WS}{{0,30}}{word_pattern(fixed.FACILITY_KINDS)}[^\n]{{0,40}})"
)


def labelled_pattern(labels: list[str], max_len: int) -> str:
    """Any spelling of a label, then 2..max_len characters to the end of the line."""
    return (
        rf"(?i){word_pattern(labels)}{fixed.WS}*[:{fixed.BLANK}.]*([^\n]{{2,{max_len}}})"
    )


def find_labelled(text: Column, labels: list[str], max_len: int = 70) -> Column:
    """Value after the leftmost label, trimmed; '' when no label is found."""
    return trim_blanks(F.regexp_extract(text, labelled_pattern(labels, max_len), 1))


def extract_thai_id(text: Column) -> Column:
    """13-digit ID in noisy text: the first with a right check digit, else the first."""
    labels = fixed.LABELS["id_number"]

    def labelled(joined: Column) -> Column:
        # Only a text that holds a label is taken apart.
        lines = F.filter(F.split(joined, "\n"), lambda line: any_word(line, labels))
        none = F.array().cast("array<string>")
        return F.when(any_word(joined, labels), F.transform(lines, digits_only)).otherwise(none)

    def ids(t: Column) -> Column:
        grouped = F.array(digits_only(F.regexp_extract(t, _GROUPED_ID, 0)))
        bare = F.regexp_extract_all(t, F.lit(_BARE_ID), F.lit(1))
        found = F.concat(grouped, bare, bind(join_thai(t), labelled))
        return F.filter(found, lambda d: F.length(d) == 13)

    def first(ids: Column) -> Column:
        return F.coalesce(F.get(F.filter(ids, check_digit_ok), F.lit(0)), F.get(ids, F.lit(0)))

    # Letters that OCR reads for digits are rewritten first, labels included.
    t = translate(
        text,
        fixed.CONFUSABLE_LETTERS + fixed.THAI_DIGITS,
        fixed.CONFUSABLE_DIGITS + fixed.ASCII_DIGITS,
        f"[{fixed.CONFUSABLE_LETTERS}๐-๙]",
    )
    return bind(bind(t, ids), first)


def titled_person(text: Column) -> Column:
    """First Thai-titled run of letters, for ID cards without a usable label."""
    return F.regexp_extract(text, f"({_TITLED}[{fixed.THAI}]{{2,40}})", 1)


def latin_name(text: Column) -> Column:
    pattern = (
        rf"Name{fixed.WS}*[:{fixed.BLANK}]*"
        rf"((?:Mr\.|Mrs\.|Ms\.)?{fixed.WS}*[A-Za-z]+(?:{fixed.WS}+[A-Za-z]+)*)"
    )
    found = first_match(text, pattern)
    return trim_blanks(squeeze_blanks(found))


def licence_number(text: Column) -> Column:
    value = find_labelled(text, fixed.LABELS["license_number"], 30)
    return first_match(value, r"(?i)[ก-ฮA-Z0-9/\-]{2,}[0-9]+", 0)


def labelled_facility(text: Column) -> Column:
    return keep_unless_junk(
        clean_facility_name(find_labelled(text, fixed.LABELS["facility_name"], 80))
    )


def scanned_facility(text: Column) -> Column:
    """First facility-like run that still names something once its kind is removed."""
    kinds = "|".join(fixed.FACILITY_KIND_WORDS)
    # A run never leaves its line, so only lines with a kind word are searched.
    lines = F.filter(F.split(text, "\n"), lambda line: any_word(line, fixed.FACILITY_KINDS))
    runs = F.flatten(
        F.transform(
            lines, lambda line: F.regexp_extract_all(line, F.lit(_FACILITY_RUN), F.lit(1))
        )
    )
    distinct = F.filter(
        F.transform(runs, clean_facility_name),
        lambda v: ~is_junk(v) & (F.length(trim_blanks(F.regexp_replace(v, kinds, ""))) >= 3),
    )
    return F.get(distinct, F.lit(0))


def labelled_person(text: Column, labels: list[str]) -> Column:
    """Person after a label; a title is required, else the line is only prose."""
    value = find_labelled(text, labels, 55)
    titled = first_match(value, f"{_TITLED}[{fixed.THAI}{fixed.BLANK}]{{2,45}}", 0)
    return keep_unless_junk(trim_blanks(squeeze_blanks(titled)))


def labelled_address(text: Column, max_len: int) -> Column:
    return keep_unless_junk(
        find_labelled(text, fixed.LABELS["address"], max_len), min_thai_ratio=0.3
    )


def facility_type(text: Column) -> Column:
    return keep_unless_junk(find_labelled(text, fixed.LABELS["facility_type"], 60))


def names_in_text(text: Column) -> Column:
    """First five distinct titled names; null when there is none."""
    pattern = rf"({_TITLED}{fixed.WS}*[{fixed.THAI}]+{fixed.WS}+[{fixed.THAI}]+)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return bind(found, lambda a: F.slice(F.array_distinct(F.when(F.size(a) > 0, a)), 1, 5))


def organisations_in_text(text: Column) -> Column:
    """First five distinct organisations, boilerplate out; null when none was seen."""
    pattern = rf"((?:{'|'.join(fixed.ORGANISATION_KINDS)}){fixed.WS}*{SCAN_NOT_WS}+)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def kept(a: Column) -> Column:
        seen = F.array_distinct(F.when(F.size(a) > 0, a))
        return F.slice(F.filter(seen, lambda o: ~is_boilerplate(o)), 1, 5)

    return bind(found, kept)


def excerpt(text: Column) -> Column:
    """The 120-character excerpt shown when nothing could be extracted."""
    t = trim_blanks(text)
    return F.when(F.length(t) > 0, squeeze_blanks(F.substring(t, 1, 120)))


def guess_doc_type(text: Column) -> Column:
    """Document type by keywords; the first group that occurs decides."""

    def by_words(t: Column) -> Column:
        first, *rest = fixed.DOC_TYPE_WORDS
        case = F.when(any_word(t, first[1]), first[0])
        for doc_type, words in rest:
            case = case.when(any_word(t, words), doc_type)
        return case.otherwise("general")

    return bind(F.lower(F.coalesce(text, F.lit(""))), by_words)


def extraction_route(mime: Column, url: Column) -> Column:
    """Which reader a file needs: image, pdf, or the raw-text fallback."""
    m, u = F.coalesce(mime, F.lit("")), F.coalesce(url, F.lit(""))
    image = m.contains("image") | u.rlike(r"(?i)\.(jpg|jpeg|png|gif|bmp|webp)(\?|\z)")
    pdf = m.contains("pdf") | u.rlike(r"(?i)\.pdf(\?|\z)")
    return F.when(image, "image").when(pdf, "pdf").otherwise("fallback")


def image_type(mime: Column, url: Column) -> Column:
    """Image type of an image file, by its mime type or else its extension."""
    m, u = F.coalesce(mime, F.lit("")), F.coalesce(url, F.lit(""))
    guess = F.when(u.rlike(r"(?i)\.png(\?|\z)"), "image/png").otherwise("image/jpeg")
    return F.when(
        extraction_route(mime, url) == "image", F.when(m.contains("image"), m).otherwise(guess)
    )


def is_scanned_pdf(text: Column) -> Column:
    """A PDF whose text layer holds under 20 characters is a scan."""
    return F.length(trim_blanks(F.coalesce(text, F.lit("")))) < 20


def model_mime(content_type: Column, url: Column) -> Column:
    """Mime type the model accepts for a file, null when it accepts none."""
    ct = F.lower(trim_blanks(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    u = F.coalesce(url, F.lit(""))
    return (
        F.when(ct == "image/jpg", "image/jpeg")
        .when(ct.isin(fixed.MODEL_MIME_TYPES), ct)
        .when(u.rlike(r"(?i)\.pdf(\?|\z)"), "application/pdf")
        .when(u.rlike(r"(?i)\.png(\?|\z)"), "image/png")
        .when(u.rlike(r"(?i)\.(jpe?g)(\?|\z)"), "image/jpeg")
    )


def outcome_class(status: Column, has_fields: Column, text: Column) -> Column:
    """pass when fields were read, warn when only text was, else fail."""
    return (
        F.when(status == "error", "fail")
        .when(has_fields, "pass")
        .when(F.length(trim_blanks(F.coalesce(text, F.lit("")))) > 0, "warn")
        .otherwise("fail")
    )
