import time

import pytest
from pyspark.sql import functions as F

from rosterproof.functions import dom, urls
from rosterproof.operators import links, pages
from rosterproof.operators.rules import panel_items

PAGE = "https://h.example/admin/list?x=1"


@pytest.fixture
def found(spark):
    def go(html, op=links.page_links, url=PAGE):
        df = spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")
        return [(r.url, r.text, r.type) for r in op(df).orderBy("part", "pos").collect()]

    return go


def test_lightbox_link(found):
    html = "<a href=\"javascript:;\" data-src='/files/a.pdf?v=1'>สพ.7 <b>x</b></a>"
    assert found(html) == [("https://h.example/files/a.pdf?v=1", "สพ.7 x", "license_sp7")]


def test_href_needs_a_word_or_an_extension(found):
    html = (
        '<a href="/about">about</a><a href="/x/1">เอกสาร</a><a href="/file/2">two</a><a href="/file/3"></a>'
        '<a href="c.docx"></a><a href="/file/4#">four</a>'
    )
    assert found(html) == [
        ("https://h.example/x/1", "เอกสาร", "general"),
        ("https://h.example/file/2", "two", "general"),
        ("https://h.example/admin/c.docx", "c.docx", "id_card"),
    ]


def test_onclick_forms_in_order(found):
    html = (
        "<button onclick=\"window.open('/upload/1')\">a</button><a href='#' onclick=\"downloadFile('f 2.pdf')\"></a>"
        "<a onclick=\"go('x', '/storage/3')\">c</a><a onclick=\"nothing()\">เอกสาร</a><a href=\"javascript:void(0)\">เอกสาร</a>"
    )
    assert [u for u, _, _ in found(html)] == [
        "https://h.example/upload/1", "https://h.example/f%202.pdf", "https://h.example/storage/3",
    ]


def test_first_link_of_an_address_wins_and_viewers_come_last(found):
    html = '<iframe src="/files/v.png"></iframe><a href="/files/a.pdf">one</a><a href="/files/a.pdf">two</a><object data="/files/a.pdf"></object>'
    assert found(html) == [
        ("https://h.example/files/a.pdf", "one", "general"),
        ("https://h.example/files/v.png", "v.png", "general"),
    ]


def test_entities_and_non_ascii(found):
    assert found('<a href="/document/ü?a=1&amp;b=2">&lt;x&gt;</a>') == [
        ("https://h.example/document/%C3%BC?a=1&b=2", "<x>", "general")
    ]


def test_modal_links(found):
    html = '<a href="/checklist/9">ตรวจเอกสาร</a><a href="#">ตรวจเอกสาร</a><a href="/none">x</a><button onclick="window.open(\'/file/1\')">b</button>'
    assert found(html, links.modal_links) == [
        ("https://h.example/checklist/9", "ตรวจเอกสาร", None),
        ("https://h.example/checklist/9", "ตรวจเอกสาร", "review_page"),
    ]


def test_canonical(values):
    got = values(lambda c: urls.canonical(c, "https://h"), ["http://a/b", "https://a", "/x", "x/y"])
    assert got == ["https://a/b", "https://a", "https://h/x", "https://h/x/y"]


def test_resolve(values):
    page = F.lit("https://h.example/a/b/page?q=1#f")
    cases = {
        "x": "https://h.example/a/b/x",
        "/x": "https://h.example/x",
        "//o/x": "https://o/x",
        "mailto:a": "mailto:a",
        "../x": "https://h.example/a/x",
        "../../../x": "https://h.example/x",
        "./x": "https://h.example/a/b/x",
        "c/../x.pdf": "https://h.example/a/b/x.pdf",
        "c/./d/..": "https://h.example/a/b/c/",
        "..": "https://h.example/a/",
        "/a/../b?x=../y": "https://h.example/b?x=../y",
        "?v=2": "https://h.example/a/b/page?v=2",
        "#sec": "https://h.example/a/b/page?q=1#sec",
        "http://o/a/../b": "http://o/b",
        "http://": None,
        "javascript:;": "javascript:;",
    }
    assert dict(zip(cases, values(lambda c: urls.resolve(c, page), list(cases)), strict=True)) == cases
    bare = F.lit("https://h.example")
    assert values(lambda c: urls.resolve(c, bare), ["x", "../x"]) == ["https://h.example/x"] * 2


def test_messy_markup(found):
    html = (
        '<a href="/files/a.pdf">A<p><a href="/files/b.pdf">B</a><a href="/x"><button onclick="go(\'/files/c.pdf\')">C</button></a>'
        "<a class=k href=/files/d.pdf>D</a><a title='a > b' href='/files/e.pdf'>E</a><A HREF=\"/files/last.pdf\">F"
    )
    assert [(u.rsplit("/", 1)[1], t) for u, t, _ in found(html)] == [
        ("a.pdf", "A"), ("b.pdf", "B"), ("c.pdf", "C"), ("d.pdf", "D"), ("e.pdf", "E"), ("last.pdf", "F"),
    ]


def test_what_is_no_markup(found):
    html = (
        "<a title=\"see href='/no.pdf'\" href=\"/files/a.pdf\">A</a><!-- <a href='/files/old.pdf'>old</a> -->"
        "<script>x = '<a href=\"/files/js.pdf\">js</a>'</script><a data-x='<a href=\"/files/in.pdf\">' href=/files/b.pdf>B</a>"
        "<a href='&#47;files&#x2f;c.pdf?x=1&copy=2&amp;y'>&nbsp;C&hellip;</a><A HREF=/files/d.pdf href=/files/e.pdf>D<!-- d --></a>"
        "<noscript><a href='/files/f.pdf'>f</a></noscript><embed data='/files/v.pdf'><a href='/files/never.pdf'"
    )
    assert [(u.removeprefix("https://h.example/files/"), t) for u, t, _ in found(html)] == [
        ("a.pdf", "A"), ("b.pdf", "B"), ("c.pdf?x=1&copy=2&y", "C…"), ("d.pdf", "D"), ("v.pdf", "v.pdf"),
    ]


def test_nested_and_open_elements(found):
    html = (
        "<a href='/files/a.pdf'><button onclick=\"go('/files/b.pdf')\">to <b>both</b></button> end</a>"
        "<table><tr><td><a href='/files/c.pdf'>cell<td>next</table><a href='/files/d.pdf'>open <p>still</p><a href='/files/e.pdf'>e"
    )
    assert [(u.rsplit("/", 1)[1], t) for u, t, _ in found(html)] == [
        ("a.pdf", "to both end"), ("b.pdf", "to both"), ("c.pdf", "cell"), ("d.pdf", "open still"), ("e.pdf", "e"),
    ]


def test_many_links_of_a_page(found):
    n = 50_000
    html = "".join(f"<a href='/files/{i % (n - 10)}.pdf'>{i}</a>" for i in range(n))
    start = time.perf_counter()
    got = found(html)
    assert [(u, t) for u, t, _ in got] == [(f"https://h.example/files/{i}.pdf", str(i)) for i in range(n - 10)]
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize("html", ['<a href="x" ' * 20_000, "<b>" * 30_000, "<!--" * 20_000, "<" * 50_000, "<td><p></a>" * 20_000])
def test_hostile_markup_is_read_in_linear_time(html):
    start = time.perf_counter()
    dom._reader()(html)
    assert time.perf_counter() - start < 10


def test_links_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, PAGE, "")], "page_id int, url string, html string")
    for op in (links.page_links, links.modal_links):
        assert "Exchange" not in op(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in links.document_urls(submission(spark))._jdf.queryExecution().executedPlan().toString()


def test_api_urls(values):
    got = values(urls.is_api_url, ["/api/v1/health_unit/3", "/API/Register", "/admin/health_unit_x", "/api/x", "/document", "/api/a/file"])
    assert got == [True, True, True, False, False, True]
    assert values(urls.is_json, ["application/json; charset=utf-8", "text/html", None]) == [True, False, False]


SUB = (
    "request_id string, documents array<struct<url:string,text:string,type:string>>, "
    "document_urls array<struct<url:string,text:string,type:string>>, "
    "api_document_urls array<struct<key:string,value:string>>, "
    "authority_info struct<id_doc_url:string>, admin_info struct<id_doc_url:string>"
)


def submission(spark):
    docs = [("/a", "A", None), ("/a", "A2", None), ("", "none", None)]
    more = [("/a", "x", None), ("/b", "B", None), ("/b", "B2", None)]
    return spark.createDataFrame([("r", docs, more, [("k", "/b"), ("k", "/c")], ("/c",), ("/d",))], SUB)


def test_union_of_addresses(spark):
    got = links.document_urls(submission(spark)).orderBy("rank", "pos").collect()
    assert [(r.url, r.text, r.type) for r in got] == [
        ("/a", "A", None), ("/a", "A2", None), ("/b", "B", None), ("/c", "k", None), ("/d", "สำเนาบัตร ปชช. HA", "id_card"),
    ]


def test_merge_of_scraped(spark):
    scraped = spark.createDataFrame(
        [("r", 0, "/a", "s", None), ("r", 1, "/n", "first", None), ("r", 2, "/n", "second", None), ("q", 0, "/a", "q", None)],
        "request_id string, pos int, url string, text string, type string",
    )
    got = {(r.request_id, r.url, r.text) for r in links.merge_documents(submission(spark), scraped).collect()}
    assert got == {("r", "/a", "A"), ("r", "/a", "A2"), ("r", "", "none"), ("r", "/n", "first"), ("q", "/a", "q")}


TEXT = (
    "รหัสหน่วยบริการ: AB123 \nประเภทการสมัคร: ใหม่ \nรายการตรวจสอบ 1 : สพ.7 ก\nรายการตรวจสอบ 2: บัตร สถานะ x\n"
    "ชื่อ Admin: นาย ก ข\nอีเมล: a@b.c\nข้อมูลผู้มีอำนาจ\nชื่อ: นาง ค อีเมล: d@e.f\nยืนยันตัวตนแล้ว\nสถานะ ชื่อ: ไม่ใช่"
)


def test_header_and_modal_fields(spark):
    df = spark.createDataFrame([(TEXT, "Check List : คลินิก ก", "https://h/admin/checklist/77?x")], "text string, heading string, url string")
    h = pages.header_fields(df).first()
    assert (h.hcode, h.request_type, h.health_unit_name, h.hu_id, h.health_unit_hcode) == ("AB123", "ใหม่", "คลินิก ก", "77", None)
    m = pages.modal_fields(df).first()
    assert (m.admin_name, m.admin_email, m.authority_name, m.authority_email, m.verified) == (
        "นาย ก ข", "a@b.c", "นาง ค", "d@e.f", True,
    )


def test_headings(values):
    got = values(pages.checklist_headings, [TEXT])[0]
    assert [(h.number, h.name) for h in got] == [(1, "สพ.7 ก"), (2, "บัตร สถานะ x")]
    got = values(lambda c: pages.checklist_headings(c, modal=True), [TEXT])[0]
    assert [(h.number, h.name) for h in got] == [(1, "สพ.7 ก"), (2, "บัตร")]


def test_groups_take_titles_by_position(spark):
    box = '<label> <input type="checkbox" name="check_detail[{}][{}]"{}> {} </label>'
    html = box.format(5, 1, " checked", "ก <i>ข</i>\n ค") + box.format(2, 9, "", "z") + box.format(5, 2, "", "เลือกทั้งหมด")
    heads = ["รายการตรวจสอบ 1 / 2 : สพ.7", "other", " รายการตรวจสอบ  2/2: บัตร  x"]
    df = spark.createDataFrame([(html, heads), (html, heads[:1])], "html string, heads array<string>")
    df = df.select(pages.checklist_boxes(F.col("html")).alias("boxes"), pages.step_titles(F.col("heads")).alias("titles"))
    rows = df.select(pages.checklist_groups(F.col("boxes"), F.col("titles")).alias("g")).collect()
    g = rows[0].g
    assert [(x.group_id, x.document) for x in g] == [("5", "สพ.7"), ("2", "บัตร x")]
    assert [(i.item_id, i.label, i.checked) for i in g[0]["items"]] == [("1", "ก ข ค", True), ("2", "เลือกทั้งหมด", False)]
    assert [x.document for x in rows[1].g] == ["สพ.7", None]


def test_boxes_in_any_markup(values):
    html = (
        "<h2>รายการตรวจสอบ 1 / 2 : <b>ก &amp; ข</b></h2><label>before <input type='checkbox' name='check_detail[1][1]' checked> after &lt;x&gt;</label>"
        '<table><tr><td>cell <input name="check_detail[1][2]" type="CHECKBOX"> text</td><td>next</td></tr></table>'
        '<li><input type=checkbox name=check_detail[2][1]>item</li><label><input type="radio" name="check_detail[9][9]">no</label>'
        '<label><input type="checkbox" name="other[1][1]">no</label><label><input type="checkbox" name="check_detail[2][3]">open'
    )
    got = values(pages.checklist_boxes, [html, "", None])
    assert [(b.group_id, b.item_id, b.label, b.checked) for b in got[0]] == [
        ("1", "1", "before after <x>", True), ("1", "2", "cell text", False), ("2", "1", "item", False), ("2", "3", "open", False),
    ]
    assert got[1] == [] and got[2] is None
    assert values(pages.page_headings, [html]) == [["รายการตรวจสอบ 1 / 2 : ก & ข"]]


def test_label_of_a_box_is_that_of_its_parent(values):
    box = '<input type=checkbox name="check_detail[1][{}]"{}>'
    html = (
        f"<table><tr><td><span>{box.format(1, '')}</span> far text<td>{box.format(2, ' title=\'not checked\'')} near <i>te&#120;t</i></table>"
        f"<label>outer <b>{box.format(3, ' checked=\'\'')}</b> <label>deep</label></label><b>{box.format(4, ' data-x=checked')}bold</b> out"
        f"<ul><li>{box.format(5, '')}one<li>{box.format(6, ' CHECKED')}two</ul><!-- {box.format(9, '')} -->"
        f"<dl><dt>term<dd>{box.format(7, '')}said<dd>next</dl><p>{box.format(8, '')}said<div>out</div>"
    )
    got = values(pages.checklist_boxes, [html])[0]
    assert [(b.item_id, b.label, b.checked) for b in got] == [
        ("1", "", False), ("2", "near text", False), ("3", "outer deep", True), ("4", "bold", False),
        ("5", "one", False), ("6", "two", True), ("7", "said", False), ("8", "said", False),
    ]


def test_panel_items(spark):
    df = spark.createDataFrame([([("short",), ("long enough",), ("เลือกทั้งหมด",)],)], "a array<struct<name:string>>")
    assert [x.name for x in df.select(panel_items(F.col("a")).alias("p")).first().p] == ["long enough"]
