"""Form against documents: comparison rows, verdicts, checklist evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.functions import fixed
from rosterproof.functions.dates import is_expired, is_implausible, parse_date
from rosterproof.functions.keys import first_given, given, same_id
from rosterproof.functions.names import add_name_similarity
from rosterproof.functions.text import drop_blanks
from rosterproof.operators.skew import spread_join

# Characters of a checklist document title that must occur in a document's label.
TITLE_KEY_LENGTH = 12

_HA = r"(?i)HospitalAdmin|hospital_admin|(?<![A-Za-z0-9_])HA(?![A-Za-z0-9_])"


def is_admin_document(url: Column, label: Column) -> Column:
    """True when a document belongs to the hospital admin rather than the authority."""
    return F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(label, F.lit(""))).rlike(_HA)


def with_person(docs: DataFrame, submissions: DataFrame) -> DataFrame:
    """Attach the form's unit name and the person each document is about.

    Many documents may belong to one request, so the join spreads hot requests.
    """
    form = submissions.select(
        "request_id",
        "health_unit_name",
        F.col("authority_info.name").alias("__au_name"),
        F.col("authority_info.id_number").alias("__au_id"),
        F.col("admin_info.name").alias("__ad_name"),
        F.col("admin_info.id_number").alias("__ad_id"),
    )
    admin = is_admin_document(F.col("url"), F.col("label"))
    routed = spread_join(
        docs.withColumn("is_admin_doc", admin), form, ["request_id"], "inner", ["url", "doc_ordinal"]
    )

    def pick(a: str, b: str) -> Column:
        return F.when(F.col("is_admin_doc"), F.col(a)).otherwise(F.col(b))

    return routed.withColumns(
        {
            "person_label": F.when(F.col("is_admin_doc"), fixed.PERSON_ADMIN).otherwise(
                fixed.PERSON_AUTHORITY
            ),
            "person_name": pick("__ad_name", "__au_name"),
            "person_id": pick("__ad_id", "__au_id"),
        }
    ).drop("__au_name", "__au_id", "__ad_name", "__ad_id")


def _row(field, form, doc, match, score, note) -> Column:
    def col(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        col(field).alias("field"),
        col(form).alias("form_value"),
        col(doc).alias("document_value"),
        col(match).alias("match"),
        col(score).cast("double").alias("score"),
        col(note).alias("note"),
    )


def _expiry_row(as_of: Column) -> Column:
    day, shown = F.col("__expiry"), F.col("expiry_date")
    expired = is_expired(day, as_of)
    read = _row(
        fixed.FIELD_EXPIRY,
        F.when(expired, fixed.EXPIRED).otherwise(fixed.NOT_EXPIRED),
        shown,
        ~expired,
        (~expired).cast("int"),
        F.when(expired, fixed.NOTE_EXPIRED).otherwise(fixed.NOTE_NOT_EXPIRED),
    )
    implausible = _row(
        fixed.FIELD_EXPIRY, fixed.EXPIRY_IMPLAUSIBLE, shown, False, 0, fixed.NOTE_IMPLAUSIBLE
    )
    unread = _row(fixed.FIELD_EXPIRY, fixed.EXPIRY_UNREADABLE, shown, False, 0, fixed.NOTE_MANUAL)
    row = F.when(day.isNull(), unread).when(is_implausible(day, as_of), implausible).otherwise(read)
    return F.when(given(shown), row)


def compare(docs: DataFrame, submissions: DataFrame, as_of: Column) -> DataFrame:
    """Comparison rows of every readable document against its submission.

    Keys: request_id, doc_ordinal, row (place within the document). ``as_of`` is the
    timestamp that decides whether a document has expired.
    """
    c = F.col
    d = with_person(docs.where(F.col("status") == "success"), submissions)
    d = d.withColumns(
        {
            "__facility": first_given(F.col("facility_name"), F.col("pharmacy_name")),
            "__owner": first_given(
                *[F.col(c) for c in ("owner_name", "operator_name", "pharmacist_name", "name_th")]
            ),
            "__same_id": F.when(
                given(c("id_number")) & given(c("person_id")), same_id(c("id_number"), c("person_id"))
            ),
            "__expiry": parse_date(first_given(F.col("expiry_date_parsed"), F.col("expiry_date"))),
        }
    )
    d = add_name_similarity(d, "__facility", "health_unit_name", "__unit")
    d = add_name_similarity(d, "__owner", "person_name", "__person")
    unit, person = c("__unit"), c("__person")
    named = given(c("person_name"))
    name_field = F.concat(F.lit(fixed.FIELD_NAME), "person_label")
    id_match = c("__same_id")
    rows = F.array(
        F.when(
            given(c("__facility")) & given(c("health_unit_name")),
            _row(
                fixed.FIELD_FACILITY,
                c("health_unit_name"),
                c("__facility"),
                unit["match"],
                unit["score"],
                "",
            ),
        ),
        F.when(
            given(c("__owner")) & named,
            _row(
                name_field,
                c("person_name"),
                c("__owner"),
                person["match"],
                person["score"],
                F.when(person["via"] == "skeleton", fixed.NOTE_SKELETON).otherwise(""),
            ),
        ).when(
            ~given(c("__owner")) & given(c("name_en")) & named,
            _row(
                name_field,
                c("person_name"),
                F.concat("name_en", F.lit(fixed.SUFFIX_ENGLISH)),
                False,
                0,
                fixed.NOTE_ENGLISH_ONLY,
            ),
        ),
        F.when(
            given(c("id_number")) & given(c("person_id")),
            _row(
                F.concat(F.lit(fixed.FIELD_ID), "person_label"),
                c("person_id"),
                c("id_number"),
                id_match,
                id_match.cast("int"),
                F.when(id_match, fixed.NOTE_ID_SAME).otherwise(fixed.NOTE_ID_DIFFERENT),
            ),
        ),
        F.when(
            given(c("license_number")),
            _row(
                fixed.FIELD_LICENSE,
                fixed.FORM_HAS_NO_LICENSE,
                c("license_number"),
                True,
                1,
                fixed.NOTE_LICENSE,
            ),
        ),
        _expiry_row(as_of),
    )
    source = first_given(c("label"), c("doc_type"))
    return (
        d.select("request_id", "doc_ordinal", source.alias("source"), F.posexplode(rows).alias("row", "r"))
        .where(F.col("r").isNotNull())
        .select("request_id", "doc_ordinal", "row", "source", "r.*")
    )


def verdict(note: Column, match: Column) -> Column:
    """manual when the note asks for a human, else match / mismatch."""
    return (
        F.when(F.coalesce(note, F.lit("")).contains(fixed.MANUAL_WORD), "manual")
        .when(match, "match")
        .otherwise("mismatch")
    )


def match_rows(comparisons: DataFrame) -> DataFrame:
    return comparisons.withColumn("verdict", verdict(F.col("note"), F.col("match")))


def match_counts(docs: DataFrame, comparisons: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: matched, mismatched, manual rows and documents read of total.

    Requests without documents count zeros.
    """
    zero = F.lit(0)
    kinds = {"matched": "match", "mismatched": "mismatch", "manual": "manual"}
    rows = match_rows(comparisons).select(
        "request_id",
        *[(F.col("verdict") == v).cast("int").alias(k) for k, v in kinds.items()],
        zero.alias("documents_read"),
        zero.alias("documents_total"),
    )
    read = docs.select(
        "request_id",
        *[zero.alias(k) for k in kinds],
        (F.col("status") == "success").cast("int").alias("documents_read"),
        F.lit(1).alias("documents_total"),
    )
    measures = [*kinds, "documents_read", "documents_total"]
    every = requests.select("request_id", *[zero.alias(m) for m in measures])
    counted = rows.unionByName(read).unionByName(every)
    return counted.groupBy("request_id").agg(*[F.sum(m).alias(m) for m in measures])


def checklist_items(submissions: DataFrame) -> DataFrame:
    """One row per checklist item: group_id, document, item_id, label and positions."""
    return (
        submissions.select(
            "request_id", F.posexplode("checklist_groups").alias("group_ordinal", "g")
        )
        .select(
            "request_id",
            "group_ordinal",
            F.col("g.group_id").alias("group_id"),
            F.col("g.document").alias("document"),
            F.posexplode("g.items").alias("item_ordinal", "i"),
        )
        .select(
            "request_id",
            "group_ordinal",
            "item_ordinal",
            "group_id",
            "document",
            F.col("i.item_id").alias("item_id"),
            F.col("i.label").alias("label"),
        )
    )


def uncovered_items(submissions: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Checklist items no compared field of the request relates to."""
    covered = comparisons.groupBy("request_id").agg(
        F.max(F.col("field").contains(fixed.ITEM_NAME_WORD)).alias("__name"),
        F.max(F.col("field").contains(fixed.FIELD_EXPIRY)).alias("__expiry"),
    )
    # Joined before the items are exploded: one row per request on both sides.
    items = checklist_items(
        submissions.select("request_id", "checklist_groups")
        .join(covered, "request_id", "left")
        .withColumn(
            "checklist_groups",
            F.transform(
                "checklist_groups",
                lambda g: g.withField(
                    "items",
                    F.filter(
                        g["items"],
                        lambda i: ~(
                            (i["label"].contains(fixed.ITEM_NAME_WORD) & _true("__name"))
                            | (i["label"].contains(fixed.ITEM_EXPIRY_WORD) & _true("__expiry"))
                        ),
                    ),
                ),
            ),
        )
    )
    return items.drop("item_ordinal")


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _title_key(document: Column) -> Column:
    return F.substring(drop_blanks(F.coalesce(document, F.lit(""))), 1, TITLE_KEY_LENGTH)


def item_verdicts(
    submissions: DataFrame, comparisons: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Per checklist item: verified or pending, with the reason.

    An item is verified when a document whose label contains the start of the group's
    title brought a matching name, or a valid expiry date. Labels are reduced to their
    distinct forms first and tested against the handful of titles of the request's own
    form, so what is exploded are hits, never item-comparison pairs. ``hot`` gives the
    requests with very many documents (``hot_keys`` of the document table); without it
    the comparisons are computed a second time to count them.
    """
    evidence = (
        comparisons.where(F.col("match"))
        .select(
            "request_id",
            drop_blanks(F.col("source")).alias("__source"),
            F.col("field").contains(fixed.ITEM_NAME_WORD).alias("__name"),
            F.col("field").contains(fixed.FIELD_EXPIRY).alias("__expiry"),
        )
        .where(F.col("__name") | F.col("__expiry"))
        .groupBy("request_id", "__source")
        .agg(F.max("__name").alias("__name"), F.max("__expiry").alias("__expiry"))
    )
    forms = submissions.select("request_id", "checklist_groups")
    titles = forms.select(
        "request_id",
        F.array_distinct(
            F.filter(
                F.transform("checklist_groups", lambda g: _title_key(g["document"])),
                lambda k: k != "",
            )
        ).alias("__titles"),
    )
    hits = (
        spread_join(evidence, titles, ["request_id"], "inner", ["__source"], hot)
        .select(
            "request_id",
            "__name",
            "__expiry",
            F.explode(F.filter("__titles", lambda k: F.col("__source").contains(k))).alias("__key"),
        )
        .groupBy("request_id", "__key")
        .agg(F.max("__name").alias("__name"), F.max("__expiry").alias("__expiry"))
    )
    # At most one entry per checklist group of the form.
    proven = hits.groupBy("request_id").agg(
        F.collect_list(F.when(F.col("__name"), F.col("__key"))).alias("__names"),
        F.collect_list(F.when(F.col("__expiry"), F.col("__key"))).alias("__expiries"),
    )
    items = forms.join(proven, "request_id", "left").select(
        "request_id",
        "__names",
        "__expiries",
        F.posexplode("checklist_groups").alias("group_ordinal", "g"),
    )
    key = _title_key(F.col("g.document"))
    items = items.select(
        "request_id",
        "group_ordinal",
        F.coalesce(F.array_contains("__names", key), F.lit(False)).alias("__name"),
        F.coalesce(F.array_contains("__expiries", key), F.lit(False)).alias("__expiry"),
        F.col("g.group_id").alias("group_id"),
        F.col("g.document").alias("document"),
        F.posexplode("g.items").alias("item_ordinal", "i"),
    )
    label = F.col("i.label")
    about_expiry = label.contains(fixed.ITEM_NOT_EXPIRED_WORD)
    ok = (label.contains(fixed.ITEM_NAME_WORD) & F.col("__name")) | (
        about_expiry & F.col("__expiry")
    )
    return items.select(
        "request_id",
        "group_ordinal",
        "item_ordinal",
        "group_id",
        F.col("i.item_id").alias("item_id"),
        label.alias("label"),
        "document",
        F.when(ok, "verified").otherwise("pending").alias("state"),
        F.when(ok, fixed.REASON_OK)
        .when(about_expiry, fixed.REASON_NO_EXPIRY)
        .otherwise(fixed.REASON_NO_EVIDENCE)
        .alias("reason"),
    )


def item_verdict_counts(verdicts: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: items verified and pending; requests without items count zeros."""
    none = requests.select("request_id", F.lit(None).cast("string").alias("state"))
    return verdicts.select("request_id", "state").unionByName(none).groupBy("request_id").agg(
        F.count_if(F.col("state") == "verified").alias("verified"),
        F.count_if(F.col("state") == "pending").alias("pending"),
    )
