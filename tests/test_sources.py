import base64
import json

import pytest

from rosterproof.sources import api_events, model_replies, sinks, tables


def test_registry_pages(spark, tmp_path):
    row = {"hu_id": "<b>9</b>", "hu_code": " 0012 ", "hu_name": "<a href='x'>คลินิก\n ก</a>", "hu_type_name": None,
           "status": "รอ", "member_fname": "ก", "member_lname": None, "sla": "20 วัน", "create_date": "x"}
    other = {**row, "hu_id": "10", "sla": "1.5 วัน", "member_lname": "ข"}
    (tmp_path / "page-0.json").write_text(json.dumps({"recordsTotal": 3, "data": [row, other]}, ensure_ascii=False))
    (tmp_path / "page-1.json").write_text(json.dumps({"recordsTotal": 3, "data": [{**row, "hu_id": "11", "sla": ""}]}))
    raw = tables.read_registry_pages(spark, str(tmp_path))
    got = tables.clean_registry(raw).orderBy("input_order").collect()
    assert [(r.input_order, r.id, r.sla, r.owner) for r in got] == [(0, "9", 20, "ก"), (1, "10", 15, "ก ข"), (1 << 32, "11", 0, "ก")]
    assert (got[0].code, got[0].name, got[0].type) == ("0012", "คลินิก ก", "")


def landing(spark, pages):
    """pages: (snapshot, start, total, ids, file)."""
    cell = "hu_id string"
    rows = [(s, a, t, [(i,) for i in ids] if ids is not None else None, f) for s, a, t, ids, f in pages]
    return spark.createDataFrame(rows, f"snapshot string, start long, recordsTotal int, data array<struct<{cell}>>, file string")


def test_pages_are_checked_against_the_total(spark, monkeypatch):
    pages = [("whole", 0, 5, ["a", "b"], "1"), ("whole", 2, 5, ["c", "d"], "2"), ("whole", 4, 5, ["e"], "3"),
             ("torn", 0, 9, ["a", "b", "c"], "1"), ("torn", 2, 9, ["c", "d"], "2"), ("torn", 2, 9, ["c"], "3"), ("torn", 6, 9, ["g"], "4"),
             ("cut", 0, 9, ["a"], "1"), ("cut", 1, 9, [], "2"), ("cut", 2, 9, ["c"], "3"), ("cut", 30, 9, None, "4"),
             ("over", 0, 1, ["a", "b"], "1"), ("over", 2, 1, ["c"], "2"), (None, 0, None, ["z"], "1")]
    for block in (1 << 21, 2):
        monkeypatch.setattr(tables, "PAGE_BLOCK", block)
        checked = tables.check_pages(landing(spark, pages), ["snapshot"])
        got = {(r.snapshot, r.start, r.file): (r.rows, r.missing_before, r.repeated, r.used) for r in checked.collect()}
        assert got == {
            ("whole", 0, "1"): (2, 0, 0, True), ("whole", 2, "2"): (2, 0, 0, True), ("whole", 4, "3"): (1, 0, 0, True),
            ("torn", 0, "1"): (3, 0, 0, True), ("torn", 2, "2"): (2, 0, 1, True), ("torn", 2, "3"): (1, 0, 1, True),
            ("torn", 6, "4"): (1, 2, 0, True), ("cut", 0, "1"): (1, 0, 0, True), ("cut", 1, "2"): (0, 0, 0, False),
            ("cut", 2, "3"): (1, 1, 0, False), ("cut", 30, "4"): (0, 27, 0, False), ("over", 0, "1"): (2, 0, 0, True),
            ("over", 2, "2"): (1, 0, 0, False), (None, 0, "1"): (1, 0, 0, True),
        }
        report = {r.snapshot: (r.pages, r.rows_read, r.rows_missing, r.rows_repeated, r.complete)
                  for r in tables.landing_report(checked, ["snapshot"]).collect()}
        assert report == {"whole": (3, 5, 0, 0, True), "torn": (4, 5, 4, 2, False), "cut": (4, 1, 8, 0, False),
                          "over": (2, 2, 0, 0, True), None: (1, 1, None, 0, False)}
        rows = tables.assemble_pages(checked, ["snapshot"]).where("snapshot = 'torn'").orderBy("input_order").collect()
        assert [(r.input_order, r.hu_id) for r in rows] == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (6, "g")]
    assert tables.check_pages(landing(spark, [])).collect() == []


def test_landed_pages_are_read_back(spark, tmp_path):
    pages = landing(spark, [("s", 0, 3, ["<b>1</b>", "2"], "x"), ("s", 2, 3, ["3"], "x")]).drop("file")
    tables.land_registry_pages(pages, str(tmp_path / "p"), ("snapshot",))
    back = tables.read_landed_pages(spark, str(tmp_path / "p"), "snapshot string")
    raw = tables.assemble_pages(tables.check_pages(back, ["snapshot"]), ["snapshot"])
    rows = tables.clean_registry(raw, ["snapshot"]).orderBy("input_order").collect()
    assert [(r.snapshot, r.input_order, r.id, r.owner) for r in rows] == [("s", 0, "1", ""), ("s", 1, "2", ""), ("s", 2, "3", "")]


def test_landed_files_do_not_grow_with_the_pages(spark, tmp_path):
    pages = landing(spark, [("s", i, 300, [str(i)], "x") for i in range(300)]).drop("file").coalesce(2)
    tables.land_registry_pages(pages, str(tmp_path / "p"), ("snapshot",))
    assert len(list((tmp_path / "p").rglob("*.json"))) <= 2
    back = tables.check_pages(tables.read_landed_pages(spark, str(tmp_path / "p"), "snapshot string"), ["snapshot"])
    report = tables.landing_report(back, ["snapshot"]).collect()
    assert [(r.snapshot, r.pages, r.rows_read, r.complete) for r in report] == [("s", 300, 300, True)]


def test_payload(values):
    def enc(b):
        return base64.b64encode(b).decode()

    got = values(
        tables.decode_payload,
        [enc(b"hello"), enc("é".encode("latin-1")), "aGVs bG8", "aGVsbG8", "not base64!", "a", "", None],
    )
    assert got == ["hello", "é", "hello", "hello", None, None, "", None]


def test_raw_text_documents(spark):
    df = spark.createDataFrame([("aGk=",), ("ICA=",), ("!",)], "payload string")
    got = [(r.text, r.method, r.confidence, r.status) for r in tables.raw_text_documents(df).collect()]
    assert got == [("hi", "raw-text", 70.0, "success"), (None, None, None, "error"), (None, None, None, "error")]


REPLIES = [
    'Sure: {"documentType":"id_card","ownerName":null,"operatorName":"ข","idNumber":"3-1009-99901-41-2","isHandwritten":true,"confidence":0.5} ok',
    "no object",
    '{"a": }',
    '{"isHandwritten":"true","confidence":"0.9","idNumber":"12","facilityName":""}',
    '{"confidence":1,"idNumber":3100999901412}',
]


def test_model_replies(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(REPLIES)], "request_id string, text string")
    r = model_replies.parse_replies(df).orderBy("request_id").collect()
    assert (r[0].doc_type, r[0].owner_name, r[0].id_number, r[0].id_number_valid) == ("id_card", "ข", "3100999901412", True)
    assert (r[0].is_handwritten, r[0].confidence, r[0].error) == (True, 0.5, None)
    assert r[1].error and r[2].error and r[1].is_handwritten is None
    assert (r[3].is_handwritten, r[3].confidence, r[3].id_number_valid, r[3].facility_name) == (False, None, False, None)
    assert (r[4].confidence, r[4].id_number) == (1.0, "3100999901412")


BODIES = [
    {"b": "/files/1", "a": {"x": ["a.pdf", "scan.PDF", {"deep": "my upload"}], "n": None, "t": True}},
    {"z": "image.png", "10": "ten.pdf", "2": "two.pdf"},
    ["/storage/x", 5],
    "just.pdf",
    {"k": "nothing", "e": "a\\u002fstorage\\u002fb"},
]


def test_file_links(spark):
    texts = [json.dumps(b).replace("\\\\u", "\\u") for b in BODIES] + ["{broken", None, '{"a": "x.pdf"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    got = df.select("i", api_events.file_links(df.body).alias("l")).orderBy("i").collect()
    pairs = [None if r.l is None else [(x.key, x.value) for x in r.l] for r in got]
    assert pairs == [
        [("b", "/files/1"), ("1", "scan.PDF"), ("deep", "my upload")],
        [("2", "two.pdf"), ("10", "ten.pdf"), ("z", "image.png")],
        [("0", "/storage/x")],
        [],
        [("e", "a/storage/b")],
        [],
        [],
        None,
    ]


def test_file_links_of_any_depth(spark):
    body = '{"a":' * 400 + '"/files/deep"' + "}" * 400
    df = spark.createDataFrame([(body,)], "body string")
    assert [x.value for x in df.select(api_events.file_links(df.body).alias("l")).first().l] == ["/files/deep"]


def test_shared_folder_follows_the_session(spark):
    class Cluster:
        """A session whose cluster names a shared folder; the setting is fixed at start."""

        conf = {"spark.checkpoint.dir": "hdfs://shared/tmp/"}
        sql = spark.sql

    a, b = sinks.shared_folder(Cluster), sinks.shared_folder(Cluster)
    assert a != b and a.startswith("hdfs://shared/tmp/rosterproof-")
    assert sinks.shared_folder(spark, "/given").startswith("/given/rosterproof-")


def test_no_shared_folder_is_an_error(monkeypatch):
    class Alone:
        conf = {}

    monkeypatch.setattr(sinks, "LOCAL_FOLDER", None)
    with pytest.raises(ValueError, match="share"):
        sinks.shared_folder(Alone)


def test_json_walk_of_odd_bodies(spark):
    deep = "[" * 200_000 + '"/files/deep"' + "]" * 200_000
    objects = '{"k":' * 5_000 + '{"a":"/files/x","a":"/files/y"}' + "}" * 5_000
    bodies = {
        deep: ["/files/deep"],
        objects: ["/files/y"],
        '{"n":' + "9" * 5000 + ',"f":"/files/long"}': ["/files/long"],
        '["/files/nan", NaN]': None,
        "[" * 5_000 + '"/files/open"': None,
        "[" * 5_000 + '"/files/mixed"' + "}" * 5_000: None,
        "[" * 5_000 + '"/files/a",,1' + "]" * 5_000: None,
        '["/files/ok", -Infinity]': None,
    }
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = df.select(api_events.file_links(df.body).alias("l")).collect()
    for r, want in zip(got, bodies.values(), strict=True):
        assert (r.l and [x.value for x in r.l]) == want


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_reports(spark, tmp_path, fmt):
    paths = sinks.write_reports({"x": spark.range(3), "y": spark.range(2)}, str(tmp_path), fmt)
    assert [spark.read.format(fmt).load(p).count() for p in paths] == [3, 2]
