"""Form fields and checklists read from page text and page HTML.

Each page is one row and stays one row: headings, groups and items are arrays of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.functions import dom, fixed
from rosterproof.functions.keys import first_given
from rosterproof.functions.text import blank_to_null, squeeze_blanks, trim_blanks

_W = f"{fixed.WS}*"
_SEP = rf"[:{fixed.BLANK}]*"
_LINE = f"({fixed.DOT}+)"

# Labels of the page and of the modal dialog.
HCODE = rf"รหัสหน่วยบริการ{_SEP}([A-Za-z0-9_]+)"
HCODE_UPPER = rf"รหัสหน่วยบริการ{_SEP}([0-9A-Z]+)"
REQUEST_TYPE = rf"ประเภทการสมัคร{_SEP}{_LINE}"
UNIT_NAME = rf"ชื่อหน่วยงาน/ชื่อสถาน{_W}พยาบาล{_SEP}{_LINE}"
UNIT_HCODE = rf"รหัสหน่วย{_W}งานบริการ{_W}สุขภาพ{_SEP}([A-Za-z0-9_]+)"
TITLE_NAME = rf"(?i)Check{_W}List{_W}:{_W}{_LINE}"
HU_ID = r"/checklist/([0-9]+)"
ADMIN_NAME = rf"(?s)ชื่อ{_W}Admin{_SEP}(.+?)(?:\n|อีเมล)"
EMAIL = rf"อีเมล{_SEP}([^{fixed.BLANK}]+@[^{fixed.BLANK}]+)"
AUTHORITY_SECTION = r"(?s)ข้อมูลผู้มีอำนาจ(.*?)(?:รายการตรวจสอบ|สถานะ|\z)"
PERSON_NAME = rf"(?s)ชื่อ{_SEP}(.+?)(?:\n|อีเมล)"
VERIFIED = "ยืนยันตัวตนแล้ว"
HEADING = rf"รายการตรวจสอบ{_W}([0-9]+){_W}:{_W}({fixed.DOT}+?)(?=\n|\z)"
MODAL_HEADING = rf"รายการตรวจสอบ{_W}([0-9]+){_W}:{_W}({fixed.DOT}+?)(?=\n|รายการ|สถานะ|\z)"
STEP_TITLE = rf"^รายการตรวจสอบ{_W}[0-9]+{_W}/{_W}[0-9]+{_W}:{_W}"
CHECKBOX_NAME = r"check_detail\[([0-9]+)\]\[([0-9]+)\]"


def _found(text: Column, pattern: str) -> Column:
    return blank_to_null(trim_blanks(F.regexp_extract(text, pattern, 1)))


def header_fields(pages: DataFrame) -> DataFrame:
    """Form header of a checklist page from its ``text``, ``heading`` and ``url``."""
    t = F.col("text")
    unit_hcode = _found(t, UNIT_HCODE)
    return pages.withColumns(
        {
            "hcode": first_given(_found(t, HCODE), _found(t, HCODE_UPPER), unit_hcode),
            "health_unit_hcode": unit_hcode,
            "request_type": _found(t, REQUEST_TYPE),
            "health_unit_name": first_given(
                _found(t, UNIT_NAME), _found(F.col("heading"), TITLE_NAME)
            ),
            "hu_id": _found(F.col("url"), HU_ID),
        }
    )


def modal_fields(pages: DataFrame) -> DataFrame:
    """Admin and authority details of a modal dialog from its ``text``."""
    t = F.col("text")
    p = pages.withColumn("__section", F.regexp_extract(t, AUTHORITY_SECTION, 1))
    s = F.col("__section")
    return p.withColumns(
        {
            "admin_name": _found(t, ADMIN_NAME),
            "admin_email": _found(t, EMAIL),
            "authority_name": _found(s, PERSON_NAME),
            "authority_email": _found(s, EMAIL),
            "verified": s.contains(VERIFIED),
        }
    ).drop("__section")


def checklist_headings(text: Column, modal: bool = False) -> Column:
    """Numbered checklist headings: array<struct<number, name>>."""
    p = F.lit(MODAL_HEADING if modal else HEADING)
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, p, F.lit(1)).alias("n"),
        F.regexp_extract_all(text, p, F.lit(2)).alias("name"),
    )
    return F.transform(
        zipped,
        lambda z: F.struct(
            z["n"].try_cast("int").alias("number"), trim_blanks(z["name"]).alias("name")
        ),
    )


def step_titles(headings: Column) -> Column:
    """Document titles of the step headings, in page order."""
    tidy = F.transform(headings, lambda h: squeeze_blanks(trim_blanks(h)))
    return F.transform(
        F.filter(tidy, lambda h: h.rlike(STEP_TITLE)),
        lambda h: F.regexp_replace(h, STEP_TITLE, ""),
    )


def page_headings(html: Column) -> Column:
    """Texts of the headings h1 to h6, in page order."""
    return F.transform(dom.elements(html)["headings"], _tidy)


def _tidy(text: Column) -> Column:
    return squeeze_blanks(trim_blanks(text))


def checklist_boxes(html: Column) -> Column:
    """Checklist boxes in page order: array<struct<group_id, item_id, label, checked>>.

    The label is the text of the ``label`` around a box, else of its parent.
    """
    return F.transform(
        dom.elements(html)["boxes"],
        lambda b: F.struct(
            F.regexp_extract(b["name"], CHECKBOX_NAME, 1).alias("group_id"),
            F.regexp_extract(b["name"], CHECKBOX_NAME, 2).alias("item_id"),
            _tidy(b["text"]).alias("label"),
            b["checked"].alias("checked"),
        ),
    )


def checklist_groups(boxes: Column, titles: Column) -> Column:
    """Checklist of a page: array<struct<group_id, document, items>>.

    ``boxes`` (from ``checklist_boxes``) and ``titles`` (from ``step_titles``) are columns of
    the page's row. Boxes are grouped by the first number of their name, groups keep page
    order, and the i-th group takes the i-th step title.
    """

    def group(g: Column, i: Column) -> Column:
        mine = F.filter(boxes, lambda b: b["group_id"] == g)
        items = F.transform(
            mine, lambda b: F.struct(*[b[f].alias(f) for f in ("item_id", "label", "checked")])
        )
        return F.struct(g.alias("group_id"), F.get(titles, i).alias("document"), items.alias("items"))

    return F.transform(F.array_distinct(boxes["group_id"]), group)
