"""Searches that run on every document text: few, and with the results of the plain steps."""

import pytest
from pyspark.sql import functions as F

from rosterproof.functions import dates, extract, fixed, keys, names, text

LINES = [
    None, "", " ", "\t ﻿ก　 \n", "ก ข  ค\tง", "ก \nข", "a ก ข b", "๑๒/๐๓/๒๕๖๘", "“ก”‘a’​ข﻿„",
    "ชื่อสถานพยาบาล ชื่อ คลินิกสุขใจ ประเภท ก", "ชื่อชื่อคลินิก", "ชื่อคลินิก ตั้งอยู่ ก", "ประเภทคลินิก", "ก\nชื่อสถานพยาบาลข",
    "คลินิก ประเภท\nก เลขที่ 5", "สถานพยาบาลชื่อ", "ๆ: คลินิก.,", "ชื่อตัวและชื่อสกุล นายก ข Name Mr. A", "Name ก", "x ก  y ข ที่อยู่ 1",
    "ก ชื่อ  ชื่อสกุล ข", "นายสมชาย ใจดี เกิดวันที่ 1\n2", "=ก", "ก" * 95, "มาตรา ๕๕ ก", "aกขค", "abกข", "คลินิก",
]


def plain(c, *steps):
    c = F.coalesce(c, F.lit(""))
    for pattern, into in steps:
        c = F.regexp_replace(c, pattern, into)
    return c


EDGES = (rf"^{fixed.WS}+|{fixed.WS}+\z", "")


def plain_facility(c):
    marks = rf"^[{fixed.BLANK}:.,ๆ]+|[{fixed.BLANK}:.,ๆ]+\z"
    lead, end = text.alternation(fixed.FACILITY_LEAD), text.alternation(fixed.FACILITY_END)
    steps = (rf"^{fixed.DOT}*?(?:{lead})", ""), ("^ชื่อ", ""), (rf"(?:{end}){fixed.DOT}*\z", ""), (marks, "")
    return plain(c, *steps)


def plain_person(c):
    lead, end = text.alternation(fixed.PERSON_LEAD), text.alternation(fixed.PERSON_END)
    first = (rf"^{fixed.DOT}*?(?:{lead}){fixed.WS}*", ""), (rf"(?:{end}){fixed.DOT}*\z", "")
    return plain(c, *first, (f"[^{fixed.THAI} ]", ""), (" +", " "), EDGES)


def plain_join(c):
    return plain(c, (rf"([{fixed.THAI}])[ \t]+(?=[{fixed.THAI}])", "$1"))


@pytest.mark.parametrize(
    ("now", "steps"),
    [
        (lambda c: text.trim_blanks(F.coalesce(c, F.lit(""))), lambda c: plain(c, EDGES)),
        (lambda c: text.join_thai(F.coalesce(c, F.lit(""))), plain_join),
        (text.clean_facility_name, plain_facility),
        (text.clean_person_name, plain_person),
        (
            lambda c: text.thai_skeleton(F.coalesce(c, F.lit(""))),
            lambda c: F.regexp_replace(plain_join(c), rf"[{fixed.THAI_MARKS}]|[^{fixed.THAI}]", ""),
        ),
        (
            text.normalise_ocr,
            lambda c: F.regexp_replace(
                F.translate(
                    plain_join(F.translate(c, fixed.THAI_DIGITS, fixed.ASCII_DIGITS)),
                    "“”„‘’​‌‍﻿",
                    "\"\"\"''",
                ),
                r"[ \t]{2,}",
                " ",
            ),
        ),
    ],
    ids=["trim", "join", "facility", "person", "skeleton", "normalise"],
)
def test_fewer_searches_find_the_same(values, now, steps):
    assert values(now, LINES) == values(steps, LINES)


@pytest.mark.parametrize(
    ("build", "most"),
    [
        (dates.parse_date, 20),
        (text.clean_facility_name, 1),
        (text.clean_person_name, 2),
        (text.trim_blanks, 0),
        (names.name_skeleton, 2),
    ],
    ids=["date", "facility", "person", "trim", "skeleton"],
)
def test_searches_are_not_repeated(spark, build, most):
    df = spark.range(1).select(F.concat(F.lit(" "), F.col("id").cast("string")).alias("s")).select(build(F.col("s")).alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sum(plan.count(w) for w in ("regexp_replace(", "regexp_extract(", "rlike")) <= most


def test_dates_of_every_form(values):
    raw = ["2025-02-31", "31/2/68", "1 - 12 - 2568", "๑ ธันวาคม พ.ศ. ๒๕๖๘", "วันที่ 5 เดือน ม.ค. 2568", "0/1/2568", "1/13/68", None, "x"]
    want = ["2025-03-03", "2025-03-03", "2025-12-01", "2025-12-01", "2025-01-05", None, None, None, None]
    assert values(lambda c: dates.iso(dates.parse_date(c)), raw) == want


def test_quick_classes_hold_the_same_characters(spark):
    points = spark.range(0x110000).where("id < 55296 or id > 57343")
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    slow = {text.SCAN_WS: fixed.WS, text.SCAN_NOT_WS: fixed.NOT_WS, text.SCAN_DOT: fixed.DOT}
    slow[keys.NAME_MARKS] = rf"[{fixed.BLANK}()._/\\–—-]"
    apart = [F.count_if(c.rlike(rf"\A{a}\z") != c.rlike(rf"\A{b}\z")) for a, b in slow.items()]
    assert points.agg(F.count(F.lit(1)), *apart).first() == (0x110000 - 2048, 0, 0, 0, 0)


@pytest.mark.parametrize(
    "build",
    [
        text.clean_facility_name,
        text.clean_person_name,
        text.squeeze_blanks,
        text.drop_blanks,
        extract.scanned_facility,
        extract.organisations_in_text,
        keys.name_key,
    ],
)
def test_searches_decide_common_letters_first(spark, build):
    """A class whose rare members are tested first made a search up to nine times slower."""
    df = spark.range(1).select(F.col("id").cast("string").alias("s")).select(build(F.col("s")).alias("v"))
    plan = df._jdf.queryExecution().analyzed().toString()
    slow = [fixed.DOT + "*", fixed.NOT_WS + "{", fixed.NOT_WS + "+", ", " + fixed.WS + "+", f", [{fixed.BLANK}()"]
    assert [s for s in slow if s in plan] == []
