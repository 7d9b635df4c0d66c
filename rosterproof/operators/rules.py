"""Rule checks: submissions -> rule results.

Every rule is a struct expression over one submission row, so the whole set is a map:
no shuffle, one array per submission, exploded only for the long table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.functions import fixed
from rosterproof.functions import rule_texts as T
from rosterproof.functions.keys import (
    code_format_status,
    email_status,
    first_given,
    given,
    has_text,
    phone_format_ok,
    postal_format_ok,
    thai_id_reason,
    thai_id_valid,
)
from rosterproof.functions.names import add_name_similarity
from rosterproof.functions.text import trim_blanks
from rosterproof.operators.duplicates import TOP_DUPLICATES, TOP_OWNER_UNITS
from rosterproof.operators.registry import OWNER_LIMIT

_AUTO_ITEM = "|".join(T.AUTO_ITEM_PATTERNS).replace(r"\s", fixed.WS)


def _text(v: Column | str) -> Column:
    return F.lit(v) if isinstance(v, str) else v


def _fill(template: str, *values: Column) -> Column:
    """Template with its ``%s`` replaced in turn; a missing value counts as ''."""
    texts = template.split("%s")
    parts: list[Column] = [F.lit(texts[0])]
    for value, text in zip(values, texts[1:]):
        parts += [value.cast("string"), F.lit(text)]
    return F.concat_ws("", *parts)


def _lines(c: Column) -> Column:
    return F.array_join(c, "\n")


def _rule(rule_id: str, status, title, detail, category: str, when: Column | None = None) -> Column:
    r = F.struct(
        F.lit(rule_id).alias("rule_id"),
        _text(status).alias("status"),
        _text(title).alias("title"),
        _text(detail).alias("detail"),
        F.lit(category).alias("category"),
    )
    return r if when is None else F.when(when, r)


def presence_status(c: Column, missing: str = "fail") -> Column:
    return F.when(has_text(c), "pass").otherwise(missing)


def _present(texts: dict, rule_id: str, value: Column, note: Column | None = None) -> Column:
    title, found, absent, missing = texts[rule_id]
    detail = _fill(found, value) if note is None else F.concat(_fill(found, value), note)
    return _rule(
        rule_id,
        presence_status(value, missing),
        title,
        F.when(has_text(value), detail).otherwise(absent),
        "basic",
    )


def _size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _hcode_format(code: Column) -> Column:
    c = trim_blanks(code)
    detail = (
        F.when(c.rlike(r"\A[A-Za-z]+\z"), _fill(T.HCODE_NO_DIGIT, c))
        .when(c.rlike(r"\A(?i:TEST)"), _fill(T.HCODE_TEST, c))
        .when(c.rlike(r"\A[A-Za-z0-9]{9}\z"), _fill(T.HCODE_STANDARD, c))
        .otherwise(_fill(T.HCODE_OTHER, c, F.length(c)))
    )
    status = code_format_status(code)
    return _rule("hcode-format", status, T.HCODE_TITLE, detail, "format", given(code))


def _email(rule_id: str, c: Column, title: str) -> Column:
    status = email_status(c)
    detail = (
        F.when(~given(c), T.EMAIL_MISSING)
        .when(status == "pass", _fill(T.EMAIL_OK, c))
        .otherwise(_fill(T.EMAIL_BAD, c))
    )
    # A missing address is a completeness finding, a present one a format finding.
    r = _rule(rule_id, status, title, detail, "format")
    return r.withField("category", F.when(given(c), "format").otherwise("basic"))


def _thai_id(rule_id: str, c: Column, title: str) -> Column:
    status = F.when(~given(c), "warn").when(thai_id_valid(c), "pass").otherwise("fail")
    detail = F.when(~given(c), T.ID_MISSING).otherwise(_fill(T.ID_DETAIL, c, thai_id_reason(c)))
    return _rule(rule_id, status, title, detail, "identity")


def _cross_names(authority: Column, admin: Column, similarity: Column) -> Column:
    percent = F.round(similarity["score"] * 100).cast("int")
    both = given(authority) & given(admin)
    title = F.when(both, T.NAMES_TITLE).otherwise(T.NAMES_TITLE_INCOMPLETE)
    detail = (
        F.when(~both, T.NAMES_INCOMPLETE)
        .when(similarity["match"], _fill(T.NAMES_SAME, percent, authority))
        .otherwise(_fill(T.NAMES_DIFFERENT, authority, admin))
    )
    return _rule("cross-names", "info", title, detail, "cross", given(authority) | given(admin))


def _more(n: Column, shown: int) -> Column:
    return F.when(n > shown, _fill(T.MORE, n - shown))


def _code_or(c: Column) -> Column:
    return F.coalesce(first_given(c), F.lit(T.NO_CODE))


def _duplicate_unit() -> Column:
    d = F.col("duplicates")
    strong, weak = d["strong_n"], d["weak_n"]
    listed = _lines(
        F.transform(
            d["top"],
            lambda r: _fill(
                T.DUP_RECORD, r["why"], r["name"], _code_or(r["code"]), r["id"], r["status"]
            ),
        )
    )
    status = (
        F.when(d.isNull(), "info")
        .when(strong > 0, "fail")
        .when((weak > 0) | d["generic"], "warn")
        .otherwise("pass")
    )
    title = (
        F.when(strong > 0, _fill(T.DUP_TITLE_STRONG, strong))
        .when(weak > 0, _fill(T.DUP_TITLE_WEAK, weak))
        .otherwise(T.DUP_TITLE)
    )
    detail = (
        F.when(d.isNull(), T.DUP_NOT_CHECKED)
        .when(strong > 0, _fill(T.DUP_STRONG, listed, _more(strong, TOP_DUPLICATES)))
        .when(weak > 0, _fill(T.DUP_WEAK, listed, _more(weak, TOP_DUPLICATES)))
        .when(d["generic"], T.DUP_GENERIC)
        .otherwise(_fill(T.DUP_NONE, F.format_number(d["checked"], 0)))
    )
    return _rule("duplicate-unit", status, title, detail, "basic")


def _doc_links(docs: Column) -> Column:
    n = _size(docs)
    names = F.transform(docs, lambda x: _fill(" %s", first_given(x["text"], x["url"])))
    return _rule(
        "doc-links",
        F.when(n > 0, "pass").otherwise("warn"),
        _fill(T.DOCS_TITLE, n),
        F.when(n > 0, _lines(names)).otherwise(T.DOCS_NONE),
        "document",
    )


def _agreements(a: Column) -> Column:
    required = F.array(
        *[
            F.struct(F.lit(title).alias("title"), a[field].alias("accepted"))
            for field, title in T.AGREEMENTS.items()
        ]
    )
    known = F.filter(required, lambda x: x["accepted"].isNotNull())
    n, accepted = F.size(known), F.size(F.filter(known, lambda x: x["accepted"]))
    status = F.when(n == 0, "info").when(accepted < n, "fail").otherwise("pass")
    title = F.when(n == 0, T.AGREEMENTS_TITLE).otherwise(
        _fill(T.AGREEMENTS_TITLE_COUNT, accepted, n)
    )
    detail = F.when(n == 0, T.AGREEMENTS_NONE).otherwise(
        _lines(F.transform(known, lambda x: _fill(" %s", x["title"])))
    )
    return _rule("agreements", status, title, detail, "agreement", a.isNotNull())


def _doc_coverage(groups: Column, docs: Column) -> Column:
    need, have = _size(groups), _size(docs)
    short = need > have
    return _rule(
        "doc-coverage",
        F.when(short, "fail").otherwise("pass"),
        _fill(T.COVERAGE_TITLE, F.least(need, have), need),
        F.when(short, _fill(T.COVERAGE_SHORT, need, have)).otherwise(_fill(T.COVERAGE_OK, have)),
        "document",
        need > 0,
    )


def _owner_footprint() -> Column:
    o = F.col("owner_units")
    n = o["n"]
    listed = _lines(
        F.transform(
            o["top"],
            lambda r: _fill(T.OWNER_RECORD, r["name"], _code_or(r["code"]), r["status"]),
        )
    )
    return _rule(
        "owner-footprint",
        F.when(n == 0, "pass").when(n >= OWNER_LIMIT, "warn").otherwise("info"),
        F.when(n == 0, T.OWNER_TITLE_NONE).otherwise(_fill(T.OWNER_TITLE, n)),
        F.when(n == 0, T.OWNER_NONE).otherwise(F.concat_ws("", listed, _more(n, TOP_OWNER_UNITS))),
        "cross",
        o.isNotNull(),
    )


def checklist_size(groups: Column) -> Column:
    """Number of items over all checklist groups."""
    return F.aggregate(groups, F.lit(0), lambda n, g: n + _size(g["items"]))


def automatable_items(groups: Column) -> Column:
    """Number of items an automatic rule can decide."""

    def auto(g: Column) -> Column:
        return _size(F.filter(g["items"], lambda i: i["label"].rlike(_AUTO_ITEM)))

    return F.aggregate(groups, F.lit(0), lambda n, g: n + auto(g))


def _adaptive_checklist(groups: Column) -> Column:
    total = checklist_size(groups)

    def item(i: Column) -> Column:
        auto = F.when(i["label"].rlike(_AUTO_ITEM), T.ADAPTIVE_AUTO).otherwise(T.ADAPTIVE_MANUAL)
        return _fill(T.ADAPTIVE_ITEM, i["label"], auto)

    def group(g: Column) -> Column:
        head = F.coalesce(first_given(g["document"]), _fill(T.ADAPTIVE_GROUP, g["group_id"]))
        return _fill("%s\n%s", head, _lines(F.transform(g["items"], item)))

    lines = _lines(F.transform(groups, group))
    return _rule(
        "adaptive-checklist",
        "info",
        _fill(T.ADAPTIVE_TITLE, _size(groups), total),
        _fill(T.ADAPTIVE_TOTAL, lines, automatable_items(groups), total),
        "checklist",
        _size(groups) > 0,
    )


def _checklist_panel(items: Column) -> Column:
    panel = F.filter(items, lambda i: F.coalesce(i["from_panel"], F.lit(False)))
    n, ticked = _size(panel), _size(F.filter(panel, lambda i: i["checked"]))
    return _rule(
        "checklist-panel",
        F.when(ticked == n, "pass").otherwise("warn"),
        _fill(T.PANEL_TITLE, ticked, n),
        F.when(ticked == n, T.PANEL_DONE).otherwise(_fill(T.PANEL_LEFT, n - ticked)),
        "checklist",
        n > 0,
    )


def panel_items(items: Column) -> Column:
    """Checkbox items of a page that count as checklist items."""
    return F.filter(
        items, lambda i: (F.length(i["name"]) > 5) & ~i["name"].contains(T.PANEL_SELECT_WORD)
    )


def _yes_no(rule_id: str, value: Column, category: str) -> Column:
    title, yes, no = T.MODAL_YES_NO[rule_id]
    ok = F.coalesce(value, F.lit(False))
    status = F.when(ok, "pass").otherwise("fail")
    return _rule(rule_id, status, title, F.when(ok, yes).otherwise(no), category)


def checklist_rules() -> list[Column]:
    """The rules of a checklist submission, in order. Null where a rule does not apply."""
    c = F.col
    hcode = first_given(c("hcode"), c("health_unit_hcode"))
    postal, phone = c("postal_code"), c("phone")
    authority, admin = c("authority_info"), c("admin_info")
    phone_note = F.when(phone_format_ok(phone), T.PHONE_OK).otherwise(T.PHONE_BAD)
    postal_note = F.when(postal_format_ok(postal), "").otherwise(T.POSTAL_BAD)

    def present(rule_id: str, value: Column, note: Column | None = None) -> Column:
        return _present(T.CHECKLIST_PRESENCE, rule_id, value, note)

    return [
        present("hcode-present", hcode),
        _hcode_format(hcode),
        present("unit-name", c("health_unit_name")),
        present("unit-type", c("health_unit_type")),
        present("address", c("address")),
        present("province", c("province")),
        present("postal-code", postal, postal_note),
        present("phone", phone, phone_note),
        _email("email", c("email"), T.EMAIL_TITLE),
        present("authority-name", authority["name"]),
        _thai_id("authority-id", authority["id_number"], T.ID_TITLE_AUTHORITY),
        present("authority-id-doc", authority["id_doc_url"]),
        present("admin-name", admin["name"]),
        _thai_id("admin-id", admin["id_number"], T.ID_TITLE_ADMIN),
        _cross_names(authority["name"], admin["name"], c("__persons")),
        _duplicate_unit(),
        _doc_links(c("documents")),
        _agreements(c("agreements")),
        _doc_coverage(c("checklist_groups"), c("documents")),
        _owner_footprint(),
        _adaptive_checklist(c("checklist_groups")),
        _checklist_panel(c("checklist")),
    ]


def modal_rules() -> list[Column]:
    """The rules of a modal submission, in order."""
    c = F.col
    authority, admin, agreed = c("authority_info"), c("admin_info"), c("agreements")

    def present(rule_id: str, value: Column) -> Column:
        return _present(T.MODAL_PRESENCE, rule_id, value)

    return [
        present("hcode-present", c("hcode")),
        present("unit-name", c("health_unit_name")),
        _duplicate_unit(),
        present("admin-name", admin["name"]),
        _email("admin-email", admin["email"], T.EMAIL_TITLE_ADMIN),
        present("authority-name", authority["name"]),
        _yes_no("thai-id-verify", authority["verified"], "identity"),
        _yes_no("svc-agree", agreed["service_agreement"], "agreement"),
        _yes_no("dp-agree", agreed["data_processing"], "agreement"),
        _yes_no("ds-agree", agreed["data_sharing"], "agreement"),
        _doc_links(c("documents")),
    ]


def with_rule_results(submissions: DataFrame) -> DataFrame:
    """Add ``rules``: the array of rule results that apply to each submission.

    ``submissions`` also holds ``duplicates`` and ``owner_units`` (null: not looked up).
    """
    named = submissions.withColumns(
        {"__authority": F.col("authority_info.name"), "__admin": F.col("admin_info.name")}
    )
    named = add_name_similarity(named, "__authority", "__admin", "__persons")
    rules = F.when(F.col("source") == "checklist", F.array(*checklist_rules())).otherwise(
        F.array(*modal_rules())
    )
    kept = F.filter(rules, lambda r: r.isNotNull())
    return named.withColumn("rules", kept).drop("__authority", "__admin", "__persons")


def rule_results(with_rules: DataFrame) -> DataFrame:
    """Long table: one row per rule result, ``ordinal`` being its place in the list.

    For an inner explode of a column Spark first filters on its size, below the rules, which
    computes all of them twice.
    """
    rows = with_rules.select("request_id", "source", F.posexplode_outer("rules").alias("ordinal", "r"))
    return rows.where(F.col("ordinal").isNotNull()).select("request_id", "source", "ordinal", "r.*")


def rule_score(with_rules: DataFrame) -> DataFrame:
    """Rules passed of rules run, and the badge, per request."""
    r = F.col("rules")
    failed = F.exists(r, lambda x: x["status"] == "fail")
    return with_rules.select(
        "request_id",
        F.size(F.filter(r, lambda x: x["status"] == "pass")).alias("passed"),
        F.size(r).alias("total"),
        F.when(failed, fixed.BADGE_FAIL).otherwise(fixed.BADGE_PASS).alias("badge"),
    )
