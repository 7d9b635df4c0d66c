"""Readers for landed registry pages, submissions, document texts and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterproof.functions.keys import digits_only
from rosterproof.functions.text import drop_blanks, strip_tags, trim_blanks
from rosterproof.sources import schemas

# Wider than any page, so that pages of any size keep their order.
PAGE_SPAN = 1 << 32


def read_registry_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw registry rows of landed JSON pages, one file per page.

    The page's number is the last number in its file name; it fixes the input order.
    """
    pages = spark.read.schema(schemas.RAW_REGISTRY_PAGE).json(path, multiLine=True)
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"([0-9]+)[^0-9]*\z", 1).try_cast("bigint")
    return pages.select(
        F.coalesce(number, F.lit(0)).alias("page"), F.posexplode("data").alias("pos", "r")
    ).select((F.col("page") * PAGE_SPAN + F.col("pos")).alias("input_order"), "r.*")


def land_registry_pages(rows: DataFrame, path: str, keys: tuple[str, ...] = ()) -> None:
    """Write pages (start, recordsTotal, data and ``keys``) as JSON lines, a folder per key.

    A task writes its pages of a key to one file, so the files follow the data's size and
    not the number of pages.
    """
    rows.write.mode("overwrite").partitionBy(*keys).json(path)


def read_landed_pages(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """Landed registry pages, a page a JSON object, with their ``file``.

    ``start`` is a field of the page or a ``start=<first row>`` folder it lies in. ``keys``
    declares folder levels, such as ``snapshot string``.
    """
    schema = ", ".join(x for x in (schemas.RAW_REGISTRY_PAGE, keys, "start long") if x)
    return spark.read.schema(schema).json(path).withColumn("file", F.col("_metadata.file_path"))


#: Rows of a registry whose pages one task looks at together.
PAGE_BLOCK = 1 << 21


def check_pages(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per landed page: how far the pages up to it cover the registry.

    ``pages`` has start, recordsTotal, data and file; ``by`` names columns that tell landings
    apart. Added: rows, records_total (that of the page with the first start), missing_before
    (rows between it and all pages before), repeated (its first rows that earlier pages
    hold), and ``used``: whether a reader that asks for page after page, until it has
    records_total rows or gets an empty page, would have come to it.

    Pages are looked at in blocks of the registry, what the blocks cover in one row each, so
    a landing of any size is checked by many tasks.
    """
    by = by or []
    start = F.coalesce("start", F.lit(0))
    p = pages.withColumns({"start": start, "rows": F.coalesce(F.size("data"), F.lit(0)).cast("long")})
    p = p.withColumn("rows", F.greatest("rows", F.lit(0)))
    p = p.withColumns({"end": F.col("start") + F.col("rows"), "block": F.floor(F.col("start") / PAGE_BLOCK)})
    empty = F.when(F.col("rows") == 0, F.col("start"))
    blocks = p.groupBy(*by, "block").agg(
        F.max("end").alias("__end"),
        F.min(empty).alias("__stop"),
        F.min_by("recordsTotal", F.struct("start", "file")).alias("__total"),
    )
    past = Window.partitionBy(*by).orderBy("block")
    whole = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        *by,
        "block",
        F.max("__end").over(past.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.min("__stop").over(whole).alias("__stop"),
        F.first("__total").over(whole).alias("records_total"),
    )
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "block"]]
    joined = p.alias("p").join(blocks.alias("b"), on)
    first = F.col("p.start") == 0
    in_reach = F.coalesce(F.col("p.start") < F.col("records_total"), F.lit(False))
    unstopped = F.coalesce(F.col("p.start") < F.col("__stop"), F.lit(True))
    columns = [F.col(f"p.{c}") for c in pages.columns if c not in ("start",)]
    order = [F.asc("p.start"), F.desc("p.rows"), F.asc("p.file")]
    in_block = Window.partitionBy(*[F.col(f"p.{c}") for c in [*by, "block"]]).orderBy(*order)
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.max("p.end").over(before), F.col("__before"), F.lit(0))
    return joined.select(
        *columns, "p.start", "p.rows", "records_total", covered.alias("__covered"), (first | (in_reach & unstopped)).alias("used")
    ).select(
        *pages.columns,
        "rows",
        "records_total",
        F.greatest(F.col("start") - F.col("__covered"), F.lit(0)).alias("missing_before"),
        F.least(F.greatest(F.col("__covered") - F.col("start"), F.lit(0)), "rows").alias("repeated"),
        "used",
    )


def landing_report(checked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per landing: pages, records_total, rows_read, rows_missing, rows_repeated, complete."""
    used = F.col("used")
    found = checked.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("pages"),
        F.max("records_total").cast("long").alias("records_total"),
        F.coalesce(F.sum(F.when(used, F.col("rows") - F.col("repeated"))), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum(F.when(used, F.col("repeated"))), F.lit(0)).alias("rows_repeated"),
    )
    # Unknown where the landing does not say how many rows there are.
    missing = F.when(F.col("records_total") > F.col("rows_read"), F.col("records_total") - F.col("rows_read"))
    missing = missing.when(F.col("records_total").isNotNull(), F.lit(0))
    return found.withColumns(
        {"rows_missing": missing, "complete": F.coalesce(missing == 0, F.lit(False))}
    )


def assemble_pages(checked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Raw registry rows of checked pages, each row once; ``input_order`` is its place."""
    rows = checked.where("used").select(
        *(by or []), "start", "repeated", F.posexplode("data").alias("pos", "r")
    )
    return rows.where(F.col("pos") >= F.col("repeated")).select(
        *(by or []), (F.col("start") + F.col("pos")).alias("input_order"), "r.*"
    )


def sla_days(c: Column) -> Column:
    """Whole days: the digits of the cell read as one number, 0 when there are none."""
    return F.coalesce(digits_only(c).try_cast("int"), F.lit(0))


def clean_registry(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Registry rows from raw cells: tags stripped, owner joined, days as a number.

    Columns named in ``keep`` stay as they are.
    """

    def cell(name: str) -> Column:
        return strip_tags(F.col(name))

    def given_or_empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    owner = F.concat_ws(" ", given_or_empty("member_fname"), given_or_empty("member_lname"))
    return raw.select(
        *(keep or []),
        cell("hu_id").alias("id"),
        cell("hu_code").alias("code"),
        cell("hu_name").alias("name"),
        cell("hu_type_name").alias("type"),
        cell("status").alias("status"),
        strip_tags(owner).alias("owner"),
        sla_days(cell("sla")).alias("sla"),
        cell("create_date").alias("create_date"),
        "input_order",
    )


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A landed table with its declared schema; nothing is inferred."""
    return spark.read.format(fmt).schema(schema).load(path)


def read_submissions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_table(spark, path, schemas.SUBMISSIONS, fmt)


def read_doc_texts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.DOC_TEXTS, fmt)


def read_model_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.MODEL_RESPONSES, fmt)


def encode_payload(data: Column) -> Column:
    return F.base64(data)


def decode_payload(payload: Column) -> Column:
    """Text of a base64 payload, one character per byte; null when it is not base64."""
    s = F.rtrim(drop_blanks(payload), F.lit("="))
    padded = F.concat(s, F.repeat(F.lit("="), F.pmod(-F.length(s), F.lit(4))))
    valid = s.rlike(r"\A[A-Za-z0-9+/]*\z") & (F.length(s) % 4 != 1)
    return F.decode(F.when(valid, F.unbase64(padded)), "ISO-8859-1")


def raw_text_documents(files: DataFrame) -> DataFrame:
    """Raw-text fallback over ``payload``: text, method, confidence, status."""
    f = files.withColumn("text", decode_payload(F.col("payload")))
    readable = F.length(trim_blanks(F.coalesce("text", F.lit("")))) > 0
    return f.withColumns(
        {
            "text": F.when(readable, F.col("text")),
            "method": F.when(readable, "raw-text"),
            "confidence": F.when(readable, 70.0),
            "status": F.when(readable, "success").otherwise("error"),
        }
    )
