import pytest
from pyspark.sql import functions as F

from rosterproof.functions import dates, extract, text


def test_join_thai(values):
    got = values(text.join_thai, ["ว ั น ท ี่ ก", "ก\nข", "ก \t ข a ข", "a b", "ก  ข"])
    assert got == ["วันที่ก", "ก\nข", "กข a ข", "a b", "กข"]


def test_skeleton(values):
    # Vowel marks and tones go, the vowels that stand as letters stay.
    assert values(text.thai_skeleton, ["สุดารัตน์ 12 ab", "น้ำ", "เก่ง"]) == ["สดารตน", "น", "เกง"]


def test_normalise(values):
    got = values(text.normalise_ocr, ["๑๒​๓  x", "“a” ‘b’", None, "ก﻿ ข"])
    assert got == ["123 x", "\"a\" 'b'", "", "ก ข"]


def test_junk(values):
    got = values(text.is_junk, [None, "abc", "คลินิกสุขใจ", "คลินิก", "มาตรา ๕๕ x", "ก=ขคง", "abcdefgh", "ก" * 91, "กขคงabcd", "กขคabcd"])
    assert got == [True, True, False, True, True, True, True, True, False, True]


def test_clean_names(values):
    facility = values(
        text.clean_facility_name,
        ["ชื่อสถานพยาบาล : คลินิกดี ประเภทที่ไม่รับ", "ชื่อคลินิกดี เลขที่ 5", " .คลินิกดีๆ ", None],
    )
    assert facility == ["คลินิกดี", "คลินิกดี", "คลินิกดี", ""]
    person = values(text.clean_person_name, ["ชื่อตัวและชื่อสกุล นาย ก ขค เกิดวันที่ 1", "นายก-ข 12 Name Mr"])
    assert person == ["นาย ก ขค", "นายกข"]


DATES = {
    "2025-12-31": "2025-12-31",
    "2568-12-31": "2568-12-31",
    "31/12/2568": "2025-12-31",
    "31-12-68": "2025-12-31",
    "31 ธันวาคม พ.ศ. 2568": "2025-12-31",
    "31 ธ.ค. 68": "2025-12-31",
    "วันที่ 31 เดือน ธันวาคม พ.ศ. 2568": "2025-12-31",
    "31/2/2568": "2025-03-03",
    "31/13/2568": None,
    "๓๑/๑๒/๒๕๖๘": "2025-12-31",
    "32/1/2568": None,
    "31/13/2568 31 ธันวาคม 2568": None,
    "1 . 2 . 2020": "2020-02-01",
    "nothing": None,
    "1/1/000": None,
    "5/6/012": "1912-06-05",
    "2025-02-31": "2025-03-03",
}


def test_dates(values):
    got = values(lambda c: dates.iso(dates.parse_date(c)), list(DATES))
    assert dict(zip(DATES, got)) == DATES


EXPIRY = [
    ("วันหมดอายุ 31/12/2568", ("31/12/2568", "2025-12-31", "labelled")),
    ("ออก 1/1/2560 หมดอายุ วันที่ 2 ม.ค. 2565", ("2 ม.ค. 2565", "2022-01-02", "labelled")),
    ("1/1/2560\n5/5/2570 3/3/2565", ("5/5/2570", "2027-05-05", "latest-date")),
    ("หมดอายุ 31/13/2568 ออก 1/1/2560", ("1/1/2560", "2017-01-01", "latest-date")),
    ("1/1/2560 01/01/2560", ("1/1/2560", "2017-01-01", "latest-date")),
    ("วันที่ 31 เดือน ธันวาคม 2568", None),
    ("", None),
]


def test_expiry(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXPIRY)], "i int, t string")
    got = dates.add_expiry(df, "t", "e").orderBy("i").collect()
    for row, (_, want) in zip(got, EXPIRY):
        assert (row.e and (row.e.raw, str(row.e.date), row.e.method)) == want


def test_expired_and_implausible(spark):
    df = spark.createDataFrame([("2025-06-01",), ("2025-06-02",), ("2015-05-31",), (None,)], "d string").select(
        F.col("d").cast("date").alias("d")
    )
    now = F.lit("2025-06-01 12:00:00").cast("timestamp")
    got = [
        tuple(r) for r in df.select(dates.is_expired(F.col("d"), now), dates.is_implausible(F.col("d"), now)).collect()
    ]
    # A document expiring today counts as expired.
    assert got == [(True, False), (False, False), (True, True), (None, False)]


IDS = [
    ("3 1009 99901 41 2", "3100999901412"),
    ("เลข 3100999901412.", "3100999901412"),
    ("31O0 9999 0l4 12\nเลขประจำตัวประชาชน 3lOO99990l4l2", "3100999901412"),
    ("1234567890123 และ 3100999901412", "3100999901412"),
    ("1234567890123", "1234567890123"),
    ("เลขบัตรประชาชน: 3-10099-9901-412", "3100999901412"),
    # Letters are read as digits first, so a Latin label never matches.
    ("Identification Number 3-10099-9901-412", None),
    # The grouped form has no left border, so it takes the last 13 of 14 digits.
    ("12345678901234", "2345678901234"),
    ("", None),
]


@pytest.mark.parametrize("given,want", IDS)
def test_thai_id_extract(values, given, want):
    assert values(extract.extract_thai_id, [given]) == [want]


def test_find_labelled(values):
    f = lambda c: extract.find_labelled(c, ["License No", "เลขที่"], 10)
    got = values(f, ["license no : ab-1", "เลขที่\nnext line here", "เลขที่ x ", "none", "เลขที่. 0123456789ABC"])
    assert got == ["ab-1", "next line", "x", "", "0123456789"]


def test_doc_type(values):
    got = values(extract.guess_doc_type, ["ขย.5 สพ.7", "SP7 บัตร", "ผู้ดำเนินการ", "ID_CARD", "x", None])
    assert got == ["pharmacy_license", "license_sp7", "license_sp19", "id_card", "general", "general"]


def test_routes(spark):
    rows = [("image/gif", "a"), ("", "a.PNG?x"), ("", "b.jpg"), ("application/pdf", "a"), ("", "a.pdf"), (None, None), ("IMAGE/JPG; q", "z")]
    df = spark.createDataFrame(rows, "m string, u string")
    m, u = F.col("m"), F.col("u")
    got = df.select(extract.extraction_route(m, u), extract.image_type(m, u), extract.model_mime(m, u)).collect()
    assert [tuple(r) for r in got] == [
        ("image", "image/gif", None),
        ("image", "image/png", "image/png"),
        ("image", "image/jpeg", "image/jpeg"),
        ("pdf", None, "application/pdf"),
        ("pdf", None, "application/pdf"),
        ("fallback", None, None),
        ("fallback", None, "image/jpeg"),
    ]


def test_outcome_and_scan(spark):
    df = spark.createDataFrame([("error", True, "x"), ("success", True, ""), ("success", False, "x"), ("success", False, " ")], "s string, f boolean, t string")
    got = [r[0] for r in df.select(extract.outcome_class(F.col("s"), F.col("f"), F.col("t"))).collect()]
    assert got == ["fail", "pass", "warn", "fail"]
    scans = df.select(extract.is_scanned_pdf(F.lit(" " * 30 + "x" * 19)), extract.is_scanned_pdf(F.lit("x" * 20))).first()
    assert tuple(scans) == (True, False)
