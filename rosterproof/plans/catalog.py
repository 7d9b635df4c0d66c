"""The query catalogue: one DataFrame query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterproof.functions import dates, extract, keys, text, urls
from rosterproof.functions.names import add_name_similarity
from rosterproof.operators import crossref, documents, duplicates, links, pages, registry, rules, summary
from rosterproof.operators.skew import hot_keys
from rosterproof.plans import standins
from rosterproof.sources import schemas, tables
from rosterproof.sources.api_events import event_links, read_api_events
from rosterproof.sources.model_replies import parse_replies
from rosterproof.sources.sinks import land, shared_folder, write_reports
from rosterproof.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def as_of() -> Column:
    return F.lit(standins.AS_OF).cast("timestamp")


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def joined(array: Column) -> Column:
    """An array of strings as one string; '' for an empty one, null for null."""
    return F.array_join(array, "|")


def flag_text() -> Column:
    return joined(F.transform("flags", lambda f: F.concat(f["level"], F.lit(":"), f["text"])))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match keys of all submissions."""
    return duplicates.request_keys(standins.submissions(spark, sf_dir))


def index(
    spark: SparkSession, sf_dir: str, asked: DataFrame | None = None
) -> duplicates.RegistryIndex:
    return duplicates.registry_index(standins.registry(spark, sf_dir), asked)


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir)
    return duplicates.lookup(asked, index(spark, sf_dir, asked))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with their duplicate lookup and rule results."""
    found = looked_up(spark, sf_dir)
    return rules.with_rule_results(
        standins.submissions(spark, sf_dir).join(found, "request_id", "left")
    )


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.read_documents(standins.documents(spark, sf_dir))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossref.compare(read(spark, sf_dir), standins.submissions(spark, sf_dir), as_of())


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = hot_keys(standins.documents(spark, sf_dir), ["request_id"])
    return crossref.item_verdicts(standins.submissions(spark, sf_dir), compared(spark, sf_dir), hot)


# --- registry ---------------------------------------------------------------------


@query
def registry_clean(spark, sf_dir):
    raw = standins.derive(spark, sf_dir, standins.RAW_REGISTRY_SQL)
    clean = tables.clean_registry(raw)
    return clean.withColumn("sla", long("sla"))


def _landed_registry(spark, sf_dir) -> DataFrame:
    """Registry pages landed as JSON files, read back and checked."""
    flat = standins.derive(spark, sf_dir, standins.LANDED_SQL)
    cells = F.struct("input_order", *_CELLS)
    pages = flat.groupBy("snapshot", "copy", "start").agg(
        F.max("total").alias("recordsTotal"), F.sort_array(F.collect_list(cells)).alias("data")
    )
    data = F.transform("data", lambda r: r.dropFields("input_order"))
    pages = pages.withColumn("data", data).drop("copy")
    # The answer that ends a landing early has no rows.
    empty = spark.range(1).select(
        F.lit("cut").alias("snapshot"),
        F.lit(2 * standins.PAGES_OF).cast("long").alias("start"),
        F.lit(0).cast("long").alias("recordsTotal"),
        F.array().cast(pages.schema["data"].dataType).alias("data"),
    )
    folder = f"{shared_folder(spark)}/registry"
    tables.land_registry_pages(pages.unionByName(empty), folder, ("snapshot",))
    return tables.check_pages(tables.read_landed_pages(spark, folder, "snapshot string"), ["snapshot"])


_CELLS = ("hu_id", "hu_code", "hu_name", "hu_type_name", "status", "member_fname", "member_lname", "sla", "create_date")


@query
def registry_pages(spark, sf_dir):
    checked = _landed_registry(spark, sf_dir)
    numbers = ("start", "rows", "records_total", "missing_before", "repeated")
    return checked.select("snapshot", *[long(c).alias(c) for c in numbers], "used")


@query
def registry_landings(spark, sf_dir):
    return tables.landing_report(_landed_registry(spark, sf_dir), ["snapshot"])


@query
def registry_assembled(spark, sf_dir):
    raw = tables.assemble_pages(_landed_registry(spark, sf_dir), ["snapshot"])
    return tables.clean_registry(raw, ["snapshot"]).withColumn("sla", long("sla"))


@query
def registry_keys(spark, sf_dir):
    r = registry.with_keys(standins.registry(spark, sf_dir))
    return r.select("id", "code_key", "name_key", "owner_key")


@query
def generic_names(spark, sf_dir):
    return registry.generic_names(standins.registry(spark, sf_dir))


@query
def owner_counts(spark, sf_dir):
    return registry.owner_counts(standins.registry(spark, sf_dir))


@query
def dup_clusters(spark, sf_dir):
    c = registry.duplicate_clusters(standins.registry(spark, sf_dir))
    return c.select("cluster_id", "kind", "severity", "label", "n", "first_order")


@query
def cluster_edges(spark, sf_dir):
    e = registry.cluster_members(standins.registry(spark, sf_dir))
    return e.select("cluster_id", "kind", "severity", "n", "id", "code", "name", "status")


@query
def flagged_ids(spark, sf_dir):
    return registry.flagged_ids(standins.registry(spark, sf_dir))


@query
def sweep_totals(spark, sf_dir):
    return registry.sweep_totals(standins.registry(spark, sf_dir))


@query
def weak_cluster_topk(spark, sf_dir):
    t = registry.top_weak_clusters(standins.registry(spark, sf_dir))
    return t.select("cluster_id", "label", "n", "id", "short_name", "status")


def _audit_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "code", "name", "status", flag_text().alias("flags"), "flagged", "failed"
    )


@query
def registry_audit(spark, sf_dir):
    return _audit_rows(registry.audit(standins.registry(spark, sf_dir), sla_limit=45))


@query
def registry_audit_big(spark, sf_dir):
    return _audit_rows(registry.audit(standins.big_registry(spark, sf_dir), sla_limit=2000))


@query
def audit_headline(spark, sf_dir):
    r = standins.registry(spark, sf_dir)
    return registry.audit_headline(r)


@query
def flagged_topk(spark, sf_dir):
    ranked = registry.rank_flagged(registry.audit(standins.registry(spark, sf_dir)), 300)
    return ranked.select(
        "id", "code", "short_name", "status", flag_text().alias("flags"), long("n_flags").alias("n_flags"), "failed"
    )


@query
def flagged_shown(spark, sf_dir):
    shown = registry.shown_of_total(registry.audit(standins.registry(spark, sf_dir)), 300)
    return shown.select("id", long("n_flags").alias("n_flags"), "n_shown", "n_flagged")


@query
def flagged_report(spark, sf_dir):
    ranked = registry.rank_flagged(registry.audit(standins.registry(spark, sf_dir)), None)
    return ranked.select("id", "code", "name", "status", flag_text().alias("flags"))


@query
def pending_requests(spark, sf_dir):
    return registry.review_queue(standins.registry(spark, sf_dir), standins.HOST)


@query
def deep_check_queue(spark, sf_dir):
    return registry.review_queue(standins.registry(spark, sf_dir), standins.HOST, 25)


# --- duplicate lookup ---------------------------------------------------------------


@query
def dup_counts(spark, sf_dir):
    asked = requests(spark, sf_dir)
    return duplicates.match_counts(asked, index(spark, sf_dir, asked))


@query
def dup_matches(spark, sf_dir):
    asked = requests(spark, sf_dir)
    return duplicates.match_groups(asked, index(spark, sf_dir, asked))


@query
def dup_group_members(spark, sf_dir):
    m = duplicates.group_members(standins.registry(spark, sf_dir))
    return m.select("kind", "g_code", "g_name", "g_owner", "id", "code", "name", "status")


@query
def dup_topk(spark, sf_dir):
    top = duplicates.top_duplicates(looked_up(spark, sf_dir))
    return top.select(
        "request_id", long("rank").alias("rank"), "why", "id", "name", "code", "status", "remaining"
    )


@query
def owner_footprint(spark, sf_dir):
    top = duplicates.owner_footprint(looked_up(spark, sf_dir))
    return top.select(
        "request_id", "units", long("rank").alias("rank"), "id", "name", "code", "status", "remaining"
    )


# --- validators -----------------------------------------------------------------------


@query
def code_format(spark, sf_dir):
    s = standins.submissions(spark, sf_dir)
    return s.select("request_id", "hcode", keys.code_format_status(F.col("hcode")).alias("status"))


@query
def email_check(spark, sf_dir):
    s = standins.submissions(spark, sf_dir)
    return s.select("request_id", "email", keys.email_status(F.col("email")).alias("status"))


@query
def phone_check(spark, sf_dir):
    s, c = standins.submissions(spark, sf_dir), F.col("phone")
    return s.select(
        "request_id",
        rules.presence_status(c, "warn").alias("status"),
        (keys.given(c) & keys.phone_format_ok(c)).alias("format_ok"),
    )


@query
def postal_check(spark, sf_dir):
    s, c = standins.submissions(spark, sf_dir), F.col("postal_code")
    return s.select(
        "request_id",
        rules.presence_status(c, "warn").alias("status"),
        (keys.given(c) & keys.postal_format_ok(c)).alias("format_ok"),
    )


@query
def thai_id_check(spark, sf_dir):
    s = standins.submissions(spark, sf_dir)
    a, b = F.col("authority_info.id_number"), F.col("admin_info.id_number")
    return s.select(
        "request_id",
        keys.thai_id_valid(a).alias("valid"),
        keys.thai_id_reason(a).alias("reason"),
        keys.same_id(a, b).alias("same_person"),
    )


@query
def presence_check(spark, sf_dir):
    s = standins.submissions(spark, sf_dir)
    return s.select(
        "request_id",
        rules.presence_status(F.col("health_unit_type")).alias("unit_type"),
        rules.presence_status(F.col("address"), "warn").alias("address"),
        keys.any_format_status(F.col("hcode"), [r"\A[0-9]{9}\z", r"\A[A-Z]{2}[0-9]{7}\z"]).alias(
            "canonical_code"
        ),
    )


@query
def person_names(spark, sf_dir):
    c = standins.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    prefix = F.when(k % 3 == 0, "นาย").when(k % 3 == 1, "")
    first, last = F.when(k % 4 > 0, F.col("c_name")), F.when(k % 5 > 0, F.col("c_mktsegment"))
    return c.select("c_custkey", keys.full_name(prefix, first, last).alias("name"))


@query
def name_similarity(spark, sf_dir):
    s = standins.submissions(spark, sf_dir).select(
        "request_id",
        F.col("authority_info.name").alias("authority"),
        F.col("admin_info.name").alias("admin"),
    )
    r = add_name_similarity(s, "authority", "admin", "r")
    return r.select(
        "request_id", "authority", "admin", "r.match", F.round("r.score", 4).alias("score"), "r.via"
    )


@query
def name_similarity_registry(spark, sf_dir):
    """Each registry name against the next record's, for token overlap and containment."""
    r = standins.registry(spark, sf_dir).select(
        "input_order", F.concat_ws(" ", "name", "type", "owner").alias("a")
    )
    other = r.select((F.col("input_order") - 1).alias("input_order"), F.col("a").alias("b"))
    m = add_name_similarity(r.join(other, "input_order"), "a", "b", "r")
    return m.select("input_order", "r.match", F.round("r.score", 4).alias("score"), "r.via")


# --- rules ------------------------------------------------------------------------------


def _rule_rows(df: DataFrame, source: str) -> DataFrame:
    return (
        rules.rule_results(df.where(F.col("source") == source))
        .drop("source")
        .withColumn("ordinal", long("ordinal"))
    )


@query
def rule_results_checklist(spark, sf_dir):
    return _rule_rows(checked(spark, sf_dir), "checklist")


@query
def rule_results_modal(spark, sf_dir):
    return _rule_rows(checked(spark, sf_dir), "modal")


@query
def rule_score(spark, sf_dir):
    s = rules.rule_score(checked(spark, sf_dir))
    return s.withColumns({"passed": long("passed"), "total": long("total")})


@query
def request_summary(spark, sf_dir):
    return summary.request_summary(checked(spark, sf_dir), compared(spark, sf_dir))


# --- text and dates ------------------------------------------------------------------------


@query
def text_normalise(spark, sf_dir):
    d = standins.documents(spark, sf_dir)
    t = F.col("text")
    return d.select(
        "k",
        text.join_thai(t).alias("joined"),
        text.ascii_digits(t).alias("digits"),
        text.normalise_ocr(t).alias("normalised"),
    )


@query
def skeleton(spark, sf_dir):
    d = standins.documents(spark, sf_dir)
    return d.select("k", text.thai_skeleton(F.col("text")).alias("skeleton"))


@query
def html_text(spark, sf_dir):
    p = standins.table(spark, sf_dir, "pages")
    return p.select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query
def junk_filter(spark, sf_dir):
    d = standins.documents(spark, sf_dir)
    lines = d.select("k", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lines.select(
        "k",
        long("line").alias("line"),
        text.is_boilerplate(F.col("value")).alias("boilerplate"),
        text.is_junk(F.col("value")).alias("junk"),
        text.is_junk(F.col("value"), min_thai_ratio=0.3, min_len=2, max_len=20).alias("junk_loose"),
    )


@query
def clean_names(spark, sf_dir):
    d = standins.documents(spark, sf_dir)
    lines = d.select("k", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lines.select(
        "k",
        long("line").alias("line"),
        text.clean_facility_name(F.col("value")).alias("facility"),
        text.clean_person_name(F.col("value")).alias("person"),
    )


@query
def thai_dates(spark, sf_dir):
    o = standins.table(spark, sf_dir, "orders")
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in dates.fixed.THAI_MONTHS]), (k % 24 + 1).cast("int"))
    day = (k % 32).cast("string")
    form = (
        F.when(k % 6 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k % 6 == 1, F.concat_ws("/", day, (k % 14).cast("string"), (y + 543).cast("string")))
        .when(k % 6 == 2, F.concat_ws("-", day, (k % 13).cast("string"), ((y + 543) % 100).cast("string")))
        .when(k % 6 == 3, F.concat(day, F.lit(" "), month, F.lit(" พ.ศ. "), (y + 543).cast("string")))
        .when(k % 6 == 4, F.concat(F.lit("วันที่ "), day, F.lit(" เดือน "), month, F.lit(" พ.ศ. "), (y + 543).cast("string")))
        .otherwise(F.concat(day, month, F.lit("๖๘")))
    )
    d = o.select("o_orderkey", form.alias("raw"))
    return d.withColumn("parsed", dates.iso(dates.parse_date(F.col("raw"))))


@query
def expiry_extract(spark, sf_dir):
    d = standins.documents(spark, sf_dir).select("k", text.normalise_ocr(F.col("text")).alias("t"))
    e = dates.add_expiry(d, "t", "e")
    return e.select("k", "e.raw", dates.iso(F.col("e.date")).alias("day"), "e.method")


@query
def expiry_status(spark, sf_dir):
    d = standins.documents(spark, sf_dir).select("k", text.normalise_ocr(F.col("text")).alias("t"))
    e = dates.add_expiry(d, "t", "e").select("k", F.col("e.date").alias("day"))
    late = F.lit("2010-01-01 00:00:00").cast("timestamp")
    return e.select(
        "k",
        dates.is_expired(F.col("day"), as_of()).alias("expired"),
        dates.is_implausible(F.col("day"), late).alias("implausible"),
    )


# --- documents -----------------------------------------------------------------------------


@query
def thai_id_extract(spark, sf_dir):
    d = standins.documents(spark, sf_dir)
    found = extract.extract_thai_id(text.normalise_ocr(F.col("text")))
    return d.select("k", found.alias("id_number"))


@query
def labelled_values(spark, sf_dir):
    d = standins.documents(spark, sf_dir).select("k", text.normalise_ocr(F.col("text")).alias("t"))
    labels, t = extract.fixed.LABELS, F.col("t")
    return d.select(
        "k",
        extract.find_labelled(t, labels["facility_name"], 80).alias("facility"),
        extract.find_labelled(t, labels["owner_name"], 55).alias("owner"),
        extract.find_labelled(t, labels["license_number"], 30).alias("license"),
        extract.find_labelled(t, labels["person_name"], 60).alias("person"),
    )


@query
def doc_type(spark, sf_dir):
    return documents.add_doc_type(standins.documents(spark, sf_dir)).select("k", "label", "doc_type")


@query
def doc_routes(spark, sf_dir):
    d = standins.documents(spark, sf_dir)
    mime, url = F.col("content_type"), F.col("url")
    return d.select(
        "k",
        extract.extraction_route(mime, url).alias("route"),
        extract.image_type(mime, url).alias("image_type"),
        extract.model_mime(mime, url).alias("model_mime"),
        extract.is_scanned_pdf(F.col("text")).alias("scanned"),
    )


@query
def doc_fields(spark, sf_dir):
    d = read(spark, sf_dir)
    arrays = {c: joined(F.col(c)) for c in documents.ARRAY_FIELDS}
    return d.withColumns(arrays).select(
        "k", "doc_type", *documents.STRING_FIELDS, "id_number_valid", *documents.ARRAY_FIELDS, "outcome"
    )


@query
def free_text_entities(spark, sf_dir):
    d = standins.documents(spark, sf_dir).select("k", text.normalise_ocr(F.col("text")).alias("t"))
    return d.select(
        "k",
        joined(extract.names_in_text(F.col("t"))).alias("names"),
        joined(extract.organisations_in_text(F.col("t"))).alias("organisations"),
        extract.excerpt(F.col("t")).alias("excerpt"),
    )


# --- comparisons ---------------------------------------------------------------------------


@query
def doc_person_route(spark, sf_dir):
    d = standins.documents(spark, sf_dir)
    routed = crossref.with_person(d, standins.submissions(spark, sf_dir))
    return routed.select("k", "is_admin_doc", "person_label", "person_name", "person_id")


def _comparison_rows(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"score": F.round("score", 4), "row": long("row"), "doc_ordinal": long("doc_ordinal")}
    )


@query
def comparisons(spark, sf_dir):
    return _comparison_rows(compared(spark, sf_dir))


@query
def match_rows(spark, sf_dir):
    m = crossref.match_rows(compared(spark, sf_dir))
    return _comparison_rows(m).drop("match", "score")


@query
def match_counts(spark, sf_dir):
    return crossref.match_counts(
        read(spark, sf_dir), compared(spark, sf_dir), standins.submissions(spark, sf_dir)
    )


@query
def uncovered_items(spark, sf_dir):
    u = crossref.uncovered_items(standins.submissions(spark, sf_dir), compared(spark, sf_dir))
    return u.select("request_id", "document", "label")


@query
def item_verdicts(spark, sf_dir):
    return verdicts(spark, sf_dir).drop("group_ordinal", "item_ordinal")


@query
def item_verdict_counts(spark, sf_dir):
    return crossref.item_verdict_counts(
        verdicts(spark, sf_dir), standins.submissions(spark, sf_dir)
    )


# --- deep check and reports ------------------------------------------------------------------


def deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checked(spark, sf_dir)
    # Bulk run: documents are counted, not read.
    ids = registry.flagged_ids(standins.registry(spark, sf_dir)).where("severity = 'strong'")
    docs = standins.documents(spark, sf_dir)
    hot = hot_keys(standins.submissions(spark, sf_dir), ["hu_id"])
    return summary.deep_results(c, ids, docs, hot=hot)


@query
def deep_results(spark, sf_dir):
    r = summary.rank_deep_results(deep(spark, sf_dir))
    return r.select(
        "request_id", "hcode", "name", "status", "doc_evidence", joined(F.col("flags")).alias("flags"), "badge"
    )


@query
def deep_report(spark, sf_dir):
    return summary.deep_report(deep(spark, sf_dir))


@query
def outcome_export(spark, sf_dir):
    out = summary.outcome_export(
        checked(spark, sf_dir), compared(spark, sf_dir), standins.documents(spark, sf_dir)
    )
    return out.withColumns({"doc_ordinal": long("doc_ordinal"), "ordinal": long("ordinal")})


@query
def report_sink(spark, sf_dir):
    """Report tables written in full to shared storage; their rows are read back."""
    r = standins.registry(spark, sf_dir)
    reports = {
        "flagged": registry.rank_flagged(registry.audit(r), None),
        "clusters": registry.duplicate_clusters(r),
        "members": registry.cluster_members(r),
        "headline": registry.audit_headline(r),
        "deep": summary.rank_deep_results(deep(spark, sf_dir)),
    }
    folder = shared_folder(spark)
    write_reports(reports, folder)
    lines = {
        "flagged": [F.col("id"), flag_text()],
        "clusters": [F.col("cluster_id"), F.concat_ws("|", "kind", "severity", "label", "n")],
        "members": [F.concat_ws("|", "cluster_id", "id"), F.concat_ws("|", "code", "name", "status")],
        "headline": [
            F.lit("all"),
            F.concat_ws("|", "scanned", "failed", "review", "clean", "strong_clusters", "weak_clusters"),
        ],
        "deep": [F.col("request_id"), F.concat_ws("|", "hcode", "name", "status", joined(F.col("flags")))],
    }
    back = [
        spark.read.parquet(f"{folder}/{n}").select(
            F.lit(n).alias("report"), key.alias("key"), line.alias("line")
        )
        for n, (key, line) in lines.items()
    ]
    return reduce(DataFrame.unionByName, back)


@query
def landed_sources(spark, sf_dir):
    """Inputs landed as files in their declared layouts, read back through the readers."""
    folder = shared_folder(spark)
    land(standins.submissions(spark, sf_dir), f"{folder}/submissions", schemas.SUBMISSIONS, "json")
    land(standins.documents(spark, sf_dir), f"{folder}/documents", schemas.DOC_TEXTS)
    land(standins.replies(spark, sf_dir), f"{folder}/replies", schemas.MODEL_RESPONSES)
    events = standins.derive(spark, sf_dir, standins.EVENTS_SQL)
    land(events, f"{folder}/events", schemas.API_EVENTS)
    rows = {
        "submissions": (tables.read_submissions(spark, f"{folder}/submissions"), "request_id", "health_unit_name"),
        "documents": (tables.read_doc_texts(spark, f"{folder}/documents"), "url", "status"),
        "replies": (tables.read_model_responses(spark, f"{folder}/replies"), "request_id", "text"),
        "events": (read_api_events(spark, f"{folder}/events"), "event_id", "body"),
    }
    back = [
        df.select(F.lit(n).alias("source"), F.col(k).cast("string").alias("key"), F.col(v).alias("value"))
        for n, (df, k, v) in rows.items()
    ]
    return reduce(DataFrame.unionByName, back)


# --- links, pages, JSON ------------------------------------------------------------------------


def _pages(spark, sf_dir):
    easy, hard = (standins.derive(spark, sf_dir, q) for q in (standins.PAGES_SQL, standins.HARD_PAGES_SQL))
    return easy.unionByName(hard)


@query
def page_links(spark, sf_dir):
    p = links.page_links(_pages(spark, sf_dir))
    return p.select("page_id", long("part").alias("part"), long("pos").alias("pos"), "url", "text", "type")


@query
def modal_links(spark, sf_dir):
    p = links.modal_links(_pages(spark, sf_dir))
    return p.select("page_id", long("part").alias("part"), long("pos").alias("pos"), "url", "text", "type")


@query
def url_canonical(spark, sf_dir):
    p = standins.table(spark, sf_dir, "pages")
    u = F.col("url")
    path = F.regexp_replace(u, "^[a-z]+://[^/]*", "")
    return p.select(
        "page_id",
        urls.canonical(u, standins.HOST).alias("absolute"),
        urls.canonical(path, standins.HOST).alias("from_path"),
        urls.canonical(F.regexp_replace(path, "^/", ""), standins.HOST).alias("from_name"),
        urls.is_api_url(F.concat(F.lit("/api"), path)).alias("is_api"),
    )


@query
def page_header_fields(spark, sf_dir):
    p = pages.header_fields(standins.derive(spark, sf_dir, standins.PAGE_TEXT_SQL))
    return p.select(
        "k", "hcode", "health_unit_hcode", "request_type", "health_unit_name", "hu_id"
    )


@query
def modal_fields(spark, sf_dir):
    p = pages.modal_fields(standins.derive(spark, sf_dir, standins.PAGE_TEXT_SQL))
    return p.select("k", "admin_name", "admin_email", "authority_name", "authority_email", "verified")


@query
def checklist_headings(spark, sf_dir):
    p = standins.derive(spark, sf_dir, standins.PAGE_TEXT_SQL)

    def rows(modal: bool, kind: str) -> DataFrame:
        h = pages.checklist_headings(F.col("text"), modal)
        return p.select("k", F.lit(kind).alias("page"), F.inline(h))

    both = rows(False, "checklist").unionByName(rows(True, "modal"))
    return both.withColumn("number", long("number"))


@query
def checklist_groups(spark, sf_dir):
    easy = standins.derive(spark, sf_dir, standins.PAGE_TEXT_SQL).select("k", "html")
    p = easy.unionByName(standins.derive(spark, sf_dir, standins.HARD_CHECKLIST_SQL))
    p = p.select(
        "k",
        pages.step_titles(pages.page_headings(F.col("html"))).alias("titles"),
        pages.checklist_boxes(F.col("html")).alias("boxes"),
    )
    g = p.select(
        "k", F.posexplode(pages.checklist_groups(F.col("boxes"), F.col("titles"))).alias("pos", "g")
    )
    items = g.select(
        "k", long("pos").alias("pos"), "g.group_id", "g.document", F.posexplode("g.items").alias("item", "i")
    )
    kept = items.withColumn("panel", F.size(rules.panel_items(F.array(F.struct(F.col("i.label").alias("name"))))) > 0)
    return kept.select(
        "k", "pos", "group_id", "document", long("item").alias("item"), "i.item_id", "i.label", "i.checked", "panel"
    )


@query
def doc_url_union(spark, sf_dir):
    u = links.document_urls(standins.submissions(spark, sf_dir))
    return u.select("request_id", long("rank").alias("rank"), long("pos").alias("pos"), "url", "text", "type")


@query
def doc_url_merge(spark, sf_dir):
    docs = standins.documents(spark, sf_dir)
    scraped = docs.select(
        "request_id",
        F.col("k").cast("int").alias("pos"),
        "url",
        F.col("label").alias("text"),
        F.lit(None).cast("string").alias("type"),
    )
    m = links.merge_documents(standins.submissions(spark, sf_dir), scraped)
    return m.select("request_id", long("rank").alias("rank"), long("pos").alias("pos"), "url", "text")


@query
def json_file_links(spark, sf_dir):
    e = standins.derive(spark, sf_dir, standins.EVENTS_SQL)
    return event_links(e, ["event_id"]).withColumn("pos", long("pos"))


@query
def model_response_parse(spark, sf_dir):
    r = parse_replies(standins.replies(spark, sf_dir))
    return r.drop("text", "url")


@query
def field_merge(spark, sf_dir):
    """Model values over parser values, document by document."""
    replies = parse_replies(standins.replies(spark, sf_dir))
    docs = standins.documents(spark, sf_dir).withColumns(
        {"request_id": F.col("k").cast("string"), "url": F.concat(F.lit("/files/"), F.col("k").cast("string"))}
    )
    model = replies.where(F.col("error").isNull()).drop("text", "error")
    merged = documents.apply_model_fields(documents.read_documents(docs), model)
    return merged.select(
        "k",
        "doc_type",
        "facility_name",
        "owner_name",
        "operator_name",
        "id_number",
        "id_number_valid",
        "license_number",
        "expiry_date_parsed",
        "address",
        "is_handwritten",
        "model_confidence",
    )


@query
def payload_decode(spark, sf_dir):
    d = standins.table(spark, sf_dir, "documents")
    files = d.select("doc_id", tables.encode_payload(F.encode("text", "UTF-8")).alias("payload"))
    r = tables.raw_text_documents(files)
    return r.select(
        "doc_id",
        long(F.length("text")).alias("n_chars"),
        F.md5(F.encode("text", "ISO-8859-1")).alias("digest"),
        "method",
        "status",
    )


# --- streaming -----------------------------------------------------------------------------------


@query
def stream_verify(spark, sf_dir):
    folder = shared_folder(spark)

    def prepare(batch: DataFrame) -> DataFrame:
        s = batch.sparkSession
        return standins.nest_submissions(
            standins.derive(s, sf_dir, standins.SUBMISSIONS_SQL, customer=batch)
        )

    q = jobs.verify_stream(
        jobs.table_stream(spark, sf_dir, "customer"), index(spark, sf_dir), folder, prepare
    )
    q.awaitTermination()
    r = spark.read.parquet(f"{folder}/results").drop("batch", "source", "detail", "title", "category")
    return r.withColumn("ordinal", long("ordinal"))


@query
def stream_dedup(spark, sf_dir):
    folder = shared_folder(spark)
    e = jobs.table_stream(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("hu_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    jobs.append_parquet(jobs.new_requests(e, "hu_id", "ts").select("hu_id"), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/results")


@query
def stream_links(spark, sf_dir):
    folder = shared_folder(spark)
    raw = jobs.table_stream(spark, sf_dir, "events")
    e = standins.derive(spark, sf_dir, standins.EVENTS_SQL, events=raw)
    jobs.append_parquet(jobs.stream_event_links(e, ["event_id"]), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/results").withColumn("pos", long("pos"))
