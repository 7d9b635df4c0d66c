import pytest
from pyspark.sql import functions as F

from rosterproof.operators import crossref, documents, skew
from rosterproof.sources import schemas

SP7 = (
    "ใบอนุญาตเลขที่ ๑๒๓๔/๒๕๖๘\nชื่อสถานพยาบาล คลินิกสุขใจ ประเภทไม่รับผู้ป่วย\n"
    "ผู้รับอนุญาต น า ย สมชาย ใจดี\nตั้งอยู่ 12 ถนนสุขุมวิทกรุงเทพ\nหมดอายุ 31 ธันวาคม พ.ศ. 2568\n"
    "มาตรา ๕๕ ต้องระวางโทษจำคุก"
)
CARD = (
    "เลขประจำตัวประชาชน 3 1009 99901 41 2\nชื่อตัวและชื่อสกุล นายสมชาย ใจดี\nName Mr. Somchai  Jaidee\n"
    "วันบัตรหมดอายุ 3 ม.ค. 68"
)


@pytest.fixture
def docs(spark):
    def build(rows):
        full = [(r, i, u, label, None, t, 90.0, "m", s) for i, (r, u, label, t, s) in enumerate(rows)]
        return spark.createDataFrame(full, schemas.DOC_TEXTS)

    return build


@pytest.fixture
def read(docs):
    def go(label, text, url="/u"):
        return documents.read_documents(docs([("r", url, label, text, "success")])).collect()[0]

    return go


def test_licence(read):
    r = read("สพ.7", SP7)
    assert (r.doc_type, r.license_number, r.facility_name) == ("license_sp7", "1234/2568", "คลินิกสุขใจ")
    # Spaces between Thai letters are OCR artefacts and go, so the name is one run.
    assert (r.owner_name, r.address) == ("นายสมชายใจดี", "12 ถนนสุขุมวิทกรุงเทพ")
    assert (r.expiry_date_parsed, r.expiry_method) == ("2025-12-31", "labelled")
    assert r.facility_type == "ไม่รับผู้ป่วย" and r.outcome == "pass"


def test_penalty_line_is_no_owner(read):
    r = read("สพ.7", "ผู้รับอนุญาต ต้องระวางโทษจำคุก\nผู้ดำเนินการ ไม่มีคำนำหน้า")
    assert r.owner_name is None and r.operator_name is None


def test_facility_fallback_scan(read):
    r = read("สพ.7", "คลินิก\nหน้าเอกสาร คลินิกรักษ์ดี ตั้งอยู่ที่นี่")
    assert r.facility_name == "หน้าเอกสารคลินิกรักษ์ดี"


def test_value_on_next_line(read):
    assert read("สพ.7", "ชื่อสถานพยาบาล\nคลินิกสุขใจ").facility_name == "คลินิกสุขใจ"


def test_sp19_owner_defaults_to_operator(read):
    r = read("สพ.19", "ผู้ดำเนินการ นายสมชายใจดี")
    assert r.doc_type == "license_sp19" and r.owner_name == r.operator_name == "นายสมชายใจดี"
    # Text decides too: the word for operator alone makes an untitled document one.
    assert read("", "ผู้ดำเนินการ นายสมชายใจดี").doc_type == "license_sp19"


def test_pharmacy(read):
    r = read("ขย.5", "ชื่อร้าน ร้านยาใจดี\nเภสัชกร นางสาวสมหญิงใจงาม")
    assert r.pharmacy_name == r.facility_name == "ร้านยาใจดี"
    assert r.pharmacist_name == "นางสาวสมหญิงใจงาม"


def test_id_card(read):
    r = read("บัตร", CARD)
    assert (r.id_number, r.id_number_valid, r.name_th) == ("3100999901412", True, "นายสมชายใจดี")
    assert (r.name_th_skeleton, r.name_en, r.expiry_date_parsed) == ("นายสมชายใจด", "Mr. Somchai Jaidee", "2025-01-03")
    assert r.expiry_method is None and r.license_number is None


def test_general(read):
    r = read("x", "นายสมชาย\nใจดี คลินิกดีใจ 3100999901412 คลินิกดีใจ 1/2/2560")
    assert r.doc_type == "general"
    assert (r.id_numbers, r.names_found) == (["3100999901412"], ["นายสมชาย\nใจดีคลินิกดีใจ"])
    assert r.organizations_found == ["คลินิกดีใจ"]
    assert r.dates_found == ["1/2/2560"] and r.text_excerpt is None
    e = read("x", "  hello\n\nworld " + "y" * 200)
    assert e.text_excerpt == "hello world " + "y" * 107 and e.outcome == "pass"
    assert read("x", " ").outcome == "fail"


def test_model_fields_win(spark, docs):
    parsed = documents.read_documents(docs([("r", "/u", "สพ.7", SP7, "success"), ("r", "/v", "สพ.7", SP7, "success")]))
    model = spark.createDataFrame(
        [("r", "/u", "id_card", True, 0.5, "ชื่อใหม่", "")],
        "request_id string, url string, doc_type string, is_handwritten boolean, confidence double, "
        "facility_name string, owner_name string",
    )
    got = {r.url: r for r in documents.apply_model_fields(parsed, model).collect()}
    assert (got["/u"].facility_name, got["/u"].owner_name, got["/u"].doc_type) == ("ชื่อใหม่", "นายสมชายใจดี", "id_card")
    assert got["/u"].is_handwritten and not got["/v"].is_handwritten
    assert got["/v"].facility_name == "คลินิกสุขใจ"


FORM = (
    "request_id string, health_unit_name string, authority_info struct<name:string,id_number:string>, "
    "admin_info struct<name:string,id_number:string>, "
    "checklist_groups array<struct<group_id:string,document:string,items:array<struct<item_id:string,label:string>>>>"
)
GROUPS = [
    ("1", "สพ.7", [("1", "ชื่อตรงกับ LOI"), ("2", "ไม่หมดอายุ")]),
    ("2", "", [("1", "ชื่อถูกต้อง")]),
    ("3", "สำเนาบัตร HA และอื่นๆ ยาวมาก", [("1", "ชื่อถูกต้อง"), ("2", "ลายเซ็น")]),
]


def compare(spark, docs, rows, as_of="2025-06-01"):
    form = spark.createDataFrame(
        [("r", "คลินิกสุขใจ", ("สมชาย ใจดี", "3100999901412"), ("คนอื่น ไกล", "1"), GROUPS)], FORM
    )
    c = crossref.compare(documents.read_documents(docs(rows)), form, F.lit(as_of).cast("timestamp"))
    return form, c


def test_comparisons(spark, docs):
    _, c = compare(
        spark,
        docs,
        [("r", "/1", "สพ.7", SP7, "success"), ("r", "/HospitalAdmin/2", "บัตร", CARD, "success"),
         ("r", "/3", "บัตร", "Name Mr. Somchai\nหมดอายุ 1/1/2540", "success"), ("r", "/4", "สพ.7", SP7, "error"),
         ("other", "/5", "สพ.7", SP7, "success")],
    )
    rows = crossref.match_rows(c).orderBy("doc_ordinal", "row").collect()
    got = [(r.doc_ordinal, r.field, r.verdict) for r in rows]
    assert got == [
        (0, "ชื่อสถานพยาบาล/ร้านยา", "match"),
        (0, "ชื่อผู้มีอำนาจ", "match"),
        (0, "เลขที่ใบอนุญาต", "match"),
        (0, "วันหมดอายุ", "match"),
        (1, "ชื่อ HA", "mismatch"),
        (1, "เลขบัตร ปชช.  HA", "mismatch"),
        (1, "วันหมดอายุ", "mismatch"),
        (2, "ชื่อผู้มีอำนาจ", "manual"),
        (2, "วันหมดอายุ", "manual"),
    ]
    by = {(r.doc_ordinal, r.row): r for r in rows}
    assert by[0, 1].note == "ตรงกันโดยเทียบพยัญชนะ (OCR ตกสระและวรรณยุกต์)" and by[0, 1].score == 0.85
    assert by[2, 1].document_value == "Mr. Somchai (อังกฤษ)"
    assert by[2, 4].form_value == "วันที่ไม่สมเหตุสมผล"


def test_admin_route(values):
    f = lambda c: crossref.is_admin_document(c, F.lit(None).cast("string"))
    # Thai letters next to the word do not make it part of a longer word.
    assert values(f, ["สำเนาHAบัตร", "x-ha-y", "SHARE", "hospital_admin.pdf", "HA_1"]) == [True, True, False, True, False]


def test_items_and_counts(spark, docs):
    form, c = compare(spark, docs, [("r", "/1", "สพ.7 ใบ", SP7, "success"), ("r", "/4", "สพ.7", "", "error")])
    v = {(r.group_id, r.item_id): (r.state, r.reason) for r in crossref.item_verdicts(form, c).collect()}
    assert v == {
        ("1", "1"): ("verified", "ตรงกับเอกสาร"),
        ("1", "2"): ("verified", "ตรงกับเอกสาร"),
        ("2", "1"): ("pending", "ไม่มีหลักฐานจากเอกสาร"),
        ("3", "1"): ("pending", "ไม่มีหลักฐานจากเอกสาร"),
        ("3", "2"): ("pending", "ไม่มีหลักฐานจากเอกสาร"),
    }
    assert crossref.item_verdict_counts(crossref.item_verdicts(form, c), form).first().asDict() == {
        "request_id": "r", "verified": 2, "pending": 3,
    }
    # Uncovered items are judged per request, verdicts per document.
    assert [(r.document, r.label) for r in crossref.uncovered_items(form, c).collect()] == [(GROUPS[2][1], "ลายเซ็น")]
    late = crossref.item_verdicts(form, compare(spark, docs, [("r", "/1", "สพ.7", SP7, "success")], "2026-06-01")[1])
    assert {r.reason for r in late.where("group_id = '1' and item_id = '2'").collect()} == {"อ่านวันหมดอายุจากเอกสารไม่ได้"}
    n = crossref.match_counts(documents.read_documents(docs([("r", "/1", "สพ.7", SP7, "success"), ("r", "/2", "x", "", "error")])), c, form)
    assert n.first().asDict() == {
        "request_id": "r", "matched": 4, "mismatched": 0, "manual": 0, "documents_read": 1, "documents_total": 2,
    }


def test_hot_requests_change_nothing(spark, docs, monkeypatch):
    """With the request treated as hot, its documents are sliced; results stay the same."""
    rows = [("r", f"/{i}", "สพ.7 ใบ" if i % 2 else "บัตร", SP7 if i % 2 else CARD, "success") for i in range(12)]

    def results():
        form, c = compare(spark, docs, rows)
        hot = skew.hot_keys(docs(rows), ["request_id"])
        return [sorted(map(str, df.collect())) for df in (c, crossref.item_verdicts(form, c, hot), crossref.item_verdicts(form, c))]

    plain = results()
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    assert results() == plain
