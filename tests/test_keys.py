from pyspark.sql import functions as F

from rosterproof.functions import keys, text


def test_name_key(values):
    got = values(
        keys.name_key,
        ["กรุง สมุท รพ", "คลินิก-เอกชน.เวชกรรม/ทั่วไป", "ABC", None, "", "คลินิก (สาขา_2)", "a b﻿–—\\c"],
    )
    assert got == ["กรุงสมุทรพ", "คลินิกเอกชนเวชกรรมทั่วไป", "abc", "", "", "คลินิกสาขา2", "abc"]


def test_code_key(values):
    got = values(keys.code_key, ["004087000", " 4087000", "CA1234567", "000", "ABC", None, " "])
    assert got == ["4087000", "4087000", "1234567", "", "abc", "", ""]


def test_code_format(values):
    got = values(
        keys.code_format_status,
        ["004087000", "ABCDEFGHI", "TEST12345", "12345", "CA1234567", "ca1234567", "", None, "  ", "123456789\n", "test1"],
    )
    assert got == ["pass", "fail", "fail", "warn", "pass", "pass", None, None, "warn", "pass", "fail"]


def test_email(values):
    got = values(keys.email_status, ["user@example.com", "userexample.com", "", None, "a@b.c\n", "a b@c.d", "a@b@c.d"])
    assert got == ["pass", "fail", "warn", "warn", "fail", "fail", "fail"]


def test_phone_and_postal(values):
    assert values(keys.phone_format_ok, ["0887749529", "088-774-9529", "012345", "088 774 9529", "๐887749529"]) == [
        True, True, False, True, False,
    ]
    # A trailing newline is not the end of the text.
    assert values(keys.postal_format_ok, ["66000", "660", "66000\n"]) == [True, False, False]


def test_thai_id(values):
    cases = ["3100999901412", "3-1009-99901-41-2", "1234567890123", "123456789012", None, "", "0000000000000"]
    assert values(keys.thai_id_valid, cases) == [True, True, False, False, False, False, False]
    assert values(keys.thai_id_reason, cases[:4:3] + [None]) == [
        "Checksum ถูกต้อง ", "ต้อง 13 หลัก (พบ 12)", "ไม่มีเลขบัตร",
    ]


def test_presence_and_any_format(values):
    assert values(keys.has_text, ["x", " ", "", None, "　"]) == [True, False, False, False, False]
    assert values(lambda c: keys.any_format_status(c, ["^a", "^b"]), ["ax", "cx", "", None]) == ["pass", "warn", None, None]


def test_full_name(spark):
    df = spark.createDataFrame(
        [("นาย", "ก", "ข"), (None, "ก", None), ("นาย", None, ""), ("", "ก", "ข")], "p string, f string, l string"
    )
    got = [r.n for r in df.select(keys.full_name(F.col("p"), F.col("f"), F.col("l")).alias("n")).collect()]
    assert got == ["นาย ก ข", "ก", None, "ก ข"]


def test_same_id(spark):
    df = spark.createDataFrame([("1-2 3", "123"), ("12", "13")], "a string, b string")
    assert [r.v for r in df.select(keys.same_id(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False]


def test_strip_tags(values):
    assert values(text.strip_tags, ["<b>a</b>\n  b ", None, "<a href='x'>1 < 2"]) == ["a b", "", "1 < 2"]
