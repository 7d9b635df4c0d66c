"""Model replies: text that holds one JSON object -> extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.functions.keys import digits_only, first_given, thai_id_valid
from rosterproof.functions.text import blank_to_null

ERROR_NO_JSON = "โมเดลไม่ได้ตอบเป็น JSON"
ERROR_BAD_JSON = "JSON parse error"

_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
_TEXTS = (
    "documentType",
    "facilityName",
    "ownerName",
    "operatorName",
    "personName",
    "idNumber",
    "licenseNumber",
    "expiryDate",
    "address",
)
_OTHERS = ("isHandwritten", "confidence")
# What a JSON false or zero looks like as text; only then its type is asked for.
_MAYBE_NO = r"^(?:false|[-+]?[0.]+(?:[eE][-+]?[0-9]+)?)$"


def _text(value: Column, text: Column) -> Column:
    """Text of a field; null where the value is empty, false or zero."""
    text = blank_to_null(text)
    kind = F.schema_of_variant(value)
    no = (kind == "BOOLEAN") | (kind.rlike(_NUMBER) & (text.try_cast("double") == 0))
    return F.when(~text.rlike(_MAYBE_NO), text).when(~F.coalesce(no, F.lit(False)), text)


def parse_replies(replies: DataFrame) -> DataFrame:
    """Fields of each reply; ``error`` is set, and the fields null, when it has none.

    The object is the span from the first ``{`` to the last ``}``. A flag counts only as
    a JSON true, a confidence only as a JSON number. A reply that repeats a key needs the
    session setting ``spark.sql.variant.allowDuplicateKeys``, else it is a JSON error.

    A reply is decoded in steps, each a column of its own: the object, the value of each
    key as it stands there, its text.
    """
    span = F.regexp_extract("text", r"(?s)\{.*\}", 0)
    r = replies.withColumn("__span", span).withColumn("__v", F.try_parse_json("__span"))
    v = F.col("__v")
    r = r.withColumns({f"__{k}": F.try_variant_get(v, f"$.{k}", "variant") for k in (*_TEXTS, *_OTHERS)})
    r = r.withColumns({f"__t_{k}": F.try_variant_get(F.col(f"__{k}"), "$", "string") for k in _TEXTS})
    r = r.withColumns({f"__t_{k}": _text(F.col(f"__{k}"), F.col(f"__t_{k}")) for k in _TEXTS})

    def field(key: str) -> Column:
        return F.col(f"__t_{key}")

    error = F.when(F.col("__span") == "", ERROR_NO_JSON).when(v.isNull(), ERROR_BAD_JSON)
    r = r.withColumn("__ident", blank_to_null(digits_only(field("idNumber"))))
    ident, person, expiry = F.col("__ident"), field("personName"), field("expiryDate")
    numeric = F.schema_of_variant("__confidence").rlike(_NUMBER)
    flag = F.schema_of_variant("__isHandwritten") == "BOOLEAN"
    return r.select(
        *replies.columns,
        error.alias("error"),
        field("documentType").alias("doc_type"),
        field("facilityName").alias("facility_name"),
        first_given(field("ownerName"), field("operatorName")).alias("owner_name"),
        field("operatorName").alias("operator_name"),
        person.alias("name_th"),
        person.alias("name"),
        ident.alias("id_number"),
        F.when(ident.isNotNull(), thai_id_valid(ident)).alias("id_number_valid"),
        field("licenseNumber").alias("license_number"),
        expiry.alias("expiry_date"),
        expiry.alias("expiry_date_parsed"),
        field("address").alias("address"),
        F.when(
            error.isNull(),
            F.coalesce(flag & F.try_variant_get("__isHandwritten", "$", "boolean"), F.lit(False)),
        ).alias("is_handwritten"),
        F.when(numeric, F.try_variant_get("__confidence", "$", "double")).alias("confidence"),
    )
