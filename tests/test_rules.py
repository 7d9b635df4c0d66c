import json

import pytest
from pyspark.sql import functions as F

from rosterproof.operators import duplicates, rules, summary
from rosterproof.sources import schemas

FULL = {
    "source": "checklist",
    "hcode": "004087000",
    "health_unit_hcode": "004087000",
    "health_unit_name": "กฤษณาคลินิกการพยาบาลและการผดุงครรภ์",
    "health_unit_type": "คลินิก",
    "address": "222 ม.4",
    "province": "เมืองพิษณุโลก",
    "postal_code": "66000",
    "phone": "0887749529",
    "email": "someone@example.com",
    "authority_info": {"name": "นาง Kritsana T", "id_number": "3100999901412", "id_doc_url": "/doc/123"},
    "admin_info": {"name": "นาง Kritsana T", "email": "nk@example.com"},
    "documents": [{"url": f"/{i}.pdf", "text": t} for i, t in enumerate(["สพ.7", "สพ.19", "บัตร", ""])],
    "checklist": [],
    "agreements": {k: True for k in ("service_agreement", "data_processing", "data_sharing", "terms_accepted")},
    "duplicate_lists": {
        "strong": [{"id": "101", "code": "4087000", "name": "ก", "owner": "K", "status": "อนุมัติ", "why": "รหัสหน่วยบริการซ้ำ"}],
        "weak": [],
        "generic": False,
        "checked": 3033,
    },
    "owner_other_units": [],
    "checklist_groups": [{"group_id": "1", "document": "สพ.7", "items": [{"label": "ตรวจชื่อตรงกับ LOI", "checked": False}]}],
    "hu_id": "3238",
}


@pytest.fixture
def run(spark, tmp_path):
    def go(*submissions):
        path = tmp_path / "s.json"
        path.write_text("\n".join(json.dumps({"request_id": str(i), **s}) for i, s in enumerate(submissions)))
        df = spark.read.schema(schemas.SUBMISSIONS).json(str(path))
        return rules.with_rule_results(duplicates.verdicts_from_lists(df))

    return go


def by_id(row):
    return {r.rule_id: r for r in row.rules}


def one(run, **fields):
    base = {"source": "checklist", "hcode": "X", "health_unit_name": "X", "authority_info": {}, "admin_info": {},
            "documents": [], "agreements": {}}
    return by_id(run({**base, **fields}).collect()[0])


def test_full_checklist(run):
    r = by_id(run(FULL).collect()[0])
    passing = ["hcode-present", "hcode-format", "unit-name", "unit-type", "address", "province", "postal-code", "phone",
               "email", "authority-name", "authority-id", "authority-id-doc", "admin-name", "doc-links", "agreements",
               "owner-footprint", "doc-coverage"]
    assert {k: r[k].status for k in passing} == dict.fromkeys(passing, "pass")
    assert r["cross-names"].detail == "เป็นคนเดียวกัน (100%): นาง Kritsana T"
    assert (r["duplicate-unit"].status, r["duplicate-unit"].title) == ("fail", "สถานพยาบาลซ้ำ (1)")
    assert "[รหัสหน่วยบริการซ้ำ] ก (4087000): id 101, อนุมัติ" in r["duplicate-unit"].detail
    assert r["adaptive-checklist"].status == "info"
    assert r["adaptive-checklist"].title == "รายการตรวจของคำร้องนี้ (1 เอกสาร / 1 ข้อ)"
    assert r["admin-id"].status == "warn"
    assert "checklist-panel" not in r
    assert r["agreements"].title == "การยอมรับข้อตกลง (4/4)"
    assert r["doc-links"].detail == " สพ.7\n สพ.19\n บัตร\n /3.pdf"


def test_missing_data(run):
    r = by_id(
        run(
            {"source": "checklist", "hcode": "", "health_unit_name": "", "email": "bad-email",
             "authority_info": {"name": "", "id_number": "1234567890123"}, "admin_info": {"name": ""}, "documents": [],
             "agreements": {"service_agreement": False, "data_processing": False, "data_sharing": True, "terms_accepted": False}}
        ).collect()[0]
    )
    for k in ("hcode-present", "unit-name", "email", "authority-id", "agreements"):
        assert r[k].status == "fail", k
    assert r["doc-links"].status == "warn"
    assert r["duplicate-unit"].status == "info"
    assert r["agreements"].title == "การยอมรับข้อตกลง (1/4)"
    for k in ("hcode-format", "cross-names", "owner-footprint", "doc-coverage", "adaptive-checklist"):
        assert k not in r


def test_modal(run):
    ok = {"source": "modal", "hcode": "123456789", "health_unit_name": "ร้านยาทดสอบ",
          "admin_info": {"name": "Admin", "email": "a@b.com"}, "authority_info": {"name": "Auth", "verified": True},
          "agreements": {"service_agreement": True, "data_processing": True, "data_sharing": True},
          "documents": [{"url": "/d.pdf", "text": "doc"}],
          "duplicate_lists": {"strong": [], "weak": [], "generic": False, "checked": 1100}}
    bad = {"source": "modal", "hcode": "X", "health_unit_name": "Y", "authority_info": {"verified": False},
           "agreements": {"service_agreement": False, "data_processing": None, "data_sharing": False}, "documents": []}
    rows = run(ok, bad).orderBy("request_id").collect()
    good, poor = by_id(rows[0]), by_id(rows[1])
    assert len(rows[0].rules) == len(rows[1].rules) == 11
    assert {r.status for r in good.values()} == {"pass"}
    assert good["duplicate-unit"].detail == " ไม่พบซ้ำ (เทียบกับ 1,100 รายการ)"
    # An unknown agreement fails here, while the checklist page calls it unknown.
    assert [poor[k].status for k in ("thai-id-verify", "svc-agree", "dp-agree", "ds-agree")] == ["fail"] * 4


def test_single_fields(run):
    assert one(run, hcode="12345")["hcode-format"].detail == "12345 ยาว 5 หลัก ไม่ใช่ 9 หลักมาตรฐาน"
    assert one(run, phone="012345")["phone"].detail == "เบอร์: 012345: รูปแบบไม่ปกติ"
    assert one(run, phone="012345")["phone"].status == "pass"
    assert one(run, phone="")["phone"].status == "warn"
    assert one(run, postal_code="660")["postal-code"].detail.endswith("รูปแบบไม่ถูกต้อง")
    assert one(run, postal_code="")["postal-code"].status == "warn"
    assert one(run, email="")["email"].category == "basic"
    assert one(run)["agreements"].status == "info"
    assert one(run, hcode="", health_unit_hcode="CA1234567")["hcode-format"].status == "pass"


def test_lists_and_panels(run):
    record = {"id": "1", "code": "", "name": "n", "owner": "o", "status": "s"}
    r = one(
        run,
        owner_other_units=[record] * 7,
        checklist=[{"name": "abc", "checked": c, "from_panel": p} for c, p in ((True, True), (False, True), (True, None))],
        checklist_groups=[{"group_id": str(i), "document": None, "items": []} for i in range(2)],
        duplicate_lists={"strong": [], "weak": [{**record, "why": "ชื่อซ้ำ"}] * 10, "generic": False, "checked": 5},
    )
    assert r["owner-footprint"].status == "warn"
    assert r["owner-footprint"].detail.endswith("\n… อีก 1 รายการ")
    assert r["owner-footprint"].detail.count("ไม่มีรหัส") == 6
    assert (r["checklist-panel"].status, r["checklist-panel"].title) == ("warn", "ความคืบหน้า Checklist (1/2)")
    assert (r["doc-coverage"].status, r["doc-coverage"].title) == ("fail", "เอกสารครบตามรายการ (0/2)")
    assert (r["duplicate-unit"].status, r["duplicate-unit"].title) == ("warn", "ชื่อคล้ายกัน (10)")
    assert r["duplicate-unit"].detail.count("[ชื่อซ้ำ]") == 8
    assert r["duplicate-unit"].detail.endswith("… อีก 2 รายการ")
    assert "เอกสาร 0" in r["adaptive-checklist"].detail
    g = one(run, duplicate_lists={"strong": [], "weak": [], "generic": True, "checked": 5})
    assert g["duplicate-unit"].status == "warn"


def test_long_table_score_and_verdict(spark, run):
    with_rules = run(FULL, {"source": "modal"})
    long = rules.rule_results(with_rules).where("request_id = '0'").orderBy("ordinal").collect()
    assert [r.rule_id for r in long][:3] == ["hcode-present", "hcode-format", "unit-name"]
    assert [r.ordinal for r in long] == list(range(len(long)))
    score = {r.request_id: r for r in rules.rule_score(with_rules).collect()}
    assert (score["0"].passed, score["0"].total, score["0"].badge) == (17, 21, "มีปัญหา")

    compared = spark.createDataFrame([("0", True), ("0", False)], "request_id string, match boolean")
    s = {r.request_id: r for r in summary.request_summary(with_rules, compared).collect()}
    assert (s["0"]["pass"], s["0"].fail, s["0"].warn, s["0"].total, s["0"].doc_evidence) == (18, 2, 1, 21, 2)
    assert (s["0"].verdict, s["0"].message) == ("fail", " พบ 2 รายการที่ไม่ผ่าน")

    clean = {**FULL, "duplicate_lists": {**FULL["duplicate_lists"], "strong": []},
             "admin_info": {"name": "x", "id_number": "3100999901412"}}
    bulk = summary.request_summary(run(clean)).collect()[0]
    assert (bulk.verdict, bulk.message) == ("warn", " ตรวจเอกสารอัตโนมัติไม่ได้: ต้องตรวจด้วยตนเอง")
    ok = spark.createDataFrame([("0", True)], "request_id string, match boolean")
    assert summary.request_summary(run(clean), ok).collect()[0].verdict == "pass"


def test_rules_are_computed_once(run):
    """A filter on the number of rules, below them, computed every rule a second time."""
    rows = rules.rule_results(run(FULL, {**FULL, "source": "modal"}))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(rule_id, hcode-format") == 1
    counts = {r["request_id"]: r["count"] for r in rows.groupBy("request_id").count().collect()}
    assert counts == {r.request_id: len(r.rules) for r in run(FULL, {**FULL, "source": "modal"}).collect()}


def test_no_rules_no_rows(run):
    none = run(FULL).withColumn("rules", F.filter("rules", lambda r: F.lit(False)))
    assert rules.rule_results(none).collect() == []


def test_deep_results(spark, run):
    with_rules = run(FULL, {"source": "modal", "hu_id": "5"})
    strong = spark.createDataFrame([("3238",), ("3238",)], "id string")
    docs = spark.createDataFrame([("0", "error"), ("0", "error"), ("0", "success")], "request_id string, status string")
    deep = summary.deep_results(with_rules, strong, docs)
    d = {r.request_id: r for r in deep.collect()}
    assert d["0"].flags == [" สถานพยาบาลซ้ำ (1)", " เลขบัตร ปชช. HA", " อยู่ในกลุ่มซ้ำ (ตรวจทั้งระบบ)", " อ่านเอกสารไม่ได้ 2 ฉบับ"]
    assert (d["1"].hcode, d["1"].name, d["1"].status) == ("Unknown", "-", "fail")
    assert summary.deep_report(deep).collect()[0].asDict() == {"checked": 2, "review": 2, "clean": 0}


def test_id_from_the_page_address(spark, run):
    page = F.lit("https://h/admin/checklist/3238?x=1")
    with_rules = run(FULL).withColumns({"hu_id": F.lit(""), "url": page})
    strong = spark.createDataFrame([("3238",)], "id string")
    deep = summary.deep_results(with_rules, strong).collect()[0]
    assert deep.hu_id == "3238" and " อยู่ในกลุ่มซ้ำ (ตรวจทั้งระบบ)" in deep.flags


def test_export_has_no_values(spark, run):
    compared = spark.createDataFrame(
        [("0", 0, 1, "ชื่อ", False)], "request_id string, doc_ordinal int, row int, field string, match boolean"
    )
    docs = spark.createDataFrame([("0", "success")], "request_id string, status string")
    rows = summary.outcome_export(run(FULL), compared, docs).collect()
    text = "\n".join(r.payload for r in rows)
    for secret in ("3100999901412", "Kritsana", "someone@example.com", "222 ม.4", "004087000"):
        assert secret not in text
    assert '{"field":"ชื่อ","result":"MISMATCH"}' in text
    assert '{"signal":"พบซ้ำชัดเจน 1 รายการ"}' in text
    assert '{"read":1,"total":1}' in text
