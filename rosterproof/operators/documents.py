"""Document text table -> typed document table with extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.functions import extract as X
from rosterproof.functions import fixed
from rosterproof.functions.dates import add_expiry, iso
from rosterproof.functions.keys import first_given, thai_id_valid
from rosterproof.functions.text import (
    bind,
    blank_to_null,
    clean_person_name,
    is_boilerplate,
    normalise_ocr,
    thai_skeleton,
)

LICENCES = ["pharmacy_license", "license_sp7", "license_sp19"]
KNOWN_TYPES = [*LICENCES, "id_card"]

STRING_FIELDS = [
    "id_number",
    "name_th",
    "name_th_skeleton",
    "name",
    "name_en",
    "expiry_date",
    "expiry_date_parsed",
    "expiry_method",
    "address",
    "license_number",
    "facility_name",
    "owner_name",
    "operator_name",
    "pharmacist_name",
    "facility_type",
    "pharmacy_name",
    "text_excerpt",
]
ARRAY_FIELDS = ["id_numbers", "names_found", "organizations_found", "dates_found"]
FIELDS = [*STRING_FIELDS, "id_number_valid", *ARRAY_FIELDS]


def add_doc_type(docs: DataFrame) -> DataFrame:
    """Type each document by its label, address and text together."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("label", "url", "text")]
    return docs.withColumn("doc_type", X.guess_doc_type(F.concat_ws(" ", *parts)))


def extract_fields(docs: DataFrame) -> DataFrame:
    """Add one nullable column per field to rows holding ``text`` and ``doc_type``.

    One pass over the table: each field's patterns run only on rows of the types that
    carry the field, and every intermediate value is a column computed once. Reads and
    writes no other row, so the job is a pure map whatever the distribution of types.
    """
    kind = F.col("doc_type")
    licence, card = kind.isin(LICENCES), kind == "id_card"
    general = ~kind.isin(KNOWN_TYPES)

    d = docs.withColumn("__t", normalise_ocr(F.col("text")))
    t = F.col("__t")
    d = add_expiry(d, "__t", "__exp")
    d = d.withColumns(
        {
            "__id": F.when(card | general, X.extract_thai_id(t)),
            "__facility": F.when(
                licence, F.coalesce(X.labelled_facility(t), X.scanned_facility(t))
            ),
            "__owner": F.when(licence, X.labelled_person(t, fixed.LABELS["owner_name"])),
            "__operator": F.when(licence, X.labelled_person(t, fixed.LABELS["operator_name"])),
            "pharmacist_name": F.when(
                licence, X.labelled_person(t, fixed.LABELS["pharmacist_name"])
            ),
            "license_number": F.when(licence, X.licence_number(t)),
            "address": F.when(licence, X.labelled_address(t, 120)).when(
                card, X.labelled_address(t, 110)
            ),
            "facility_type": F.when(licence, X.facility_type(t)),
            "__person": F.when(
                card,
                F.coalesce(
                    bind(
                        clean_person_name(X.find_labelled(t, fixed.LABELS["person_name"], 60)),
                        blank_to_null,
                    ),
                    bind(clean_person_name(X.titled_person(t)), blank_to_null),
                ),
            ),
            "name_en": F.when(card, X.latin_name(t)),
            "names_found": F.when(general, X.names_in_text(t)),
            "organizations_found": F.when(general, X.organisations_in_text(t)),
        }
    )
    d = d.withColumn("__valid", F.when(F.col("__id").isNotNull(), thai_id_valid(F.col("__id"))))
    person = F.col("__person")
    name_th = F.when((F.length(person) >= 4) & ~is_boilerplate(person), person)
    exp = F.col("__exp")
    dated = licence | card
    owner = F.when(kind == "license_sp19", F.coalesce("__owner", "__operator")).otherwise(
        F.col("__owner")
    )
    d = d.withColumns(
        {
            "id_number": F.when(card, F.col("__id")),
            "id_number_valid": F.when(card, F.col("__valid")),
            "name_th": name_th,
            "expiry_date": F.when(dated, exp["raw"]),
            "expiry_date_parsed": F.when(dated, iso(exp["date"])),
            "expiry_method": F.when(licence, exp["method"]),
            "facility_name": F.col("__facility"),
            "owner_name": owner,
            "operator_name": F.col("__operator"),
            "pharmacy_name": F.when(kind == "pharmacy_license", F.col("__facility")),
            "id_numbers": F.when(general & F.col("__valid"), F.array("__id")),
            "dates_found": F.when(general & exp.isNotNull(), F.array(exp["raw"])),
        }
    )
    d = d.withColumns(
        {
            "name": F.col("name_th"),
            "name_th_skeleton": thai_skeleton(F.col("name_th")),
            "text_excerpt": F.when(
                general & F.coalesce(*[F.col(c) for c in ARRAY_FIELDS]).isNull(), X.excerpt(t)
            ),
        }
    )
    return d.select(*docs.columns, *FIELDS)


def any_field() -> Column:
    """True when at least one field was extracted."""
    cols = [F.col(c) for c in STRING_FIELDS]
    arrays = [F.col(c) for c in ARRAY_FIELDS]
    return F.coalesce(*cols).isNotNull() | F.coalesce(*arrays).isNotNull()


def read_documents(docs: DataFrame) -> DataFrame:
    """Document results: type, fields and outcome class for every document row."""
    d = extract_fields(add_doc_type(docs))
    return d.withColumn(
        "outcome", X.outcome_class(F.col("status"), any_field(), F.col("text"))
    )


def apply_model_fields(parsed: DataFrame, model: DataFrame) -> DataFrame:
    """Model values over parser values, per (request_id, url).

    ``model`` holds at most one row per document; its non-empty values win and the
    parser's stay where the model gave none. A document type named by the model wins.
    """
    names = [c for c in model.columns if c in FIELDS]
    right = model.select(
        "request_id",
        "url",
        F.col("doc_type").alias("__m_doc_type"),
        F.col("is_handwritten"),
        F.col("confidence").alias("model_confidence"),
        *[F.col(c).alias(f"__m_{c}") for c in names],
    )
    joined = parsed.join(right, ["request_id", "url"], "left")
    merged = {}
    for c in names:
        value = F.col(f"__m_{c}")
        if c in STRING_FIELDS:
            value = blank_to_null(value)
        merged[c] = F.coalesce(value, F.col(c))
    merged["doc_type"] = first_given(F.col("__m_doc_type"), F.col("doc_type"))
    merged["is_handwritten"] = F.coalesce("is_handwritten", F.lit(False))
    return joined.withColumns(merged).drop("__m_doc_type", *[f"__m_{c}" for c in names])
