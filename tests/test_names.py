import pytest

from rosterproof.functions.names import add_name_similarity

CASES = [
    ("สมชาย ใจดี", "สมชาย ใจดี", True, 1.0, None),
    ("นายสมชาย ใจดี", "สมชาย ใจดี", True, 1.0, None),
    # "นาง" is stripped before "นางสาว", so this is containment, not equality.
    ("นางสาวสมหญิง ดี", "สมหญิง ดี", True, 0.9, None),
    ("สมชาย ใจดี", "สมหญิง ใจร้าย", False, 0.0, None),
    ("สมชาย", "สมชาย ใจดี", True, 0.9, None),
    (None, "test", False, 0.0, None),
    ("", "", False, 0.0, None),
    # A bare title becomes '' and is contained in anything.
    ("นาย", "สมชาย", True, 0.9, None),
    # Split glyphs and lost tones still share a skeleton.
    ("ส ุ ด า ร ต น ฉัตรธรรมนารถ", "สุดารัตน์ ฉัตรธรรมนารถ", True, 0.85, "skeleton"),
    ("Mr. John  Smith", "john smith", True, 1.0, None),
    ("alpha beta gamma", "alpha delta", False, 1 / 3, None),
    ("alpha beta", "beta delta", True, 0.5, None),
]


@pytest.mark.parametrize("swap", [False, True])
def test_similarity(spark, swap):
    rows = [(i, *((c[1], c[0]) if swap else (c[0], c[1]))) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = add_name_similarity(df, "a", "b", "r").orderBy("i").collect()
    for row, case in zip(got, CASES):
        assert (row.r.match, row.r.via) == (case[2], case[4]), case
        assert row.r.score == pytest.approx(case[3]), case


def test_keeps_other_columns(spark):
    df = spark.createDataFrame([("x", "a", "b")], "k string, a string, b string")
    assert add_name_similarity(df, "a", "b", "r").columns == ["k", "a", "b", "r"]
