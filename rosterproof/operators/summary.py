"""Per-request verdicts, deep results, and the outcome export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.functions import fixed
from rosterproof.functions.keys import first_given
from rosterproof.operators.pages import HU_ID
from rosterproof.operators.skew import spread_join


def _rule_count(status: str) -> Column:
    return F.size(F.filter("rules", lambda r: r["status"] == status)).cast("bigint")


def _comparison_counts(comparisons: DataFrame) -> DataFrame:
    return comparisons.groupBy("request_id").agg(
        F.count_if("match").alias("__ok"), F.count_if(~F.col("match")).alias("__bad")
    )


def with_verdict(with_rules: DataFrame, comparisons: DataFrame | None = None) -> DataFrame:
    """Add pass, fail, warn, total, verdict, doc_evidence and message to each request.

    Rules are counted within the row; comparisons arrive as one counted row per request.
    ``comparisons=None`` is the bulk run, where documents were not read.
    """
    if comparisons is None:
        rows, ok, bad = with_rules, F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    else:
        rows = with_rules.join(_comparison_counts(comparisons), "request_id", "left")
        ok, bad = F.coalesce("__ok", F.lit(0)), F.coalesce("__bad", F.lit(0))
    rows = rows.withColumns(
        {
            "pass": _rule_count("pass") + ok,
            "fail": _rule_count("fail") + bad,
            "warn": _rule_count("warn"),
            "doc_evidence": ok + bad,
        }
    )
    fail, warn, evidence = F.col("fail"), F.col("warn"), F.col("doc_evidence")
    verdict = F.when(fail > 0, "fail").when((evidence == 0) | (warn > 0), "warn").otherwise("pass")
    message = (
        F.when(fail > 0, F.format_string(fixed.MESSAGE_FAIL, fail))
        .when(evidence == 0, fixed.MESSAGE_NO_EVIDENCE)
        .when(warn > 0, F.format_string(fixed.MESSAGE_WARN, warn))
        .otherwise(fixed.MESSAGE_PASS)
    )
    total = F.col("pass") + fail + warn
    return rows.withColumns({"total": total, "verdict": verdict, "message": message})


def request_summary(with_rules: DataFrame, comparisons: DataFrame | None = None) -> DataFrame:
    """Counts, verdict and message per request over its rules and comparisons."""
    return with_verdict(with_rules, comparisons).select(
        "request_id", "pass", "fail", "warn", "total", "verdict", "doc_evidence", "message"
    )


def unreadable_documents(docs: DataFrame) -> DataFrame:
    return docs.groupBy("request_id").agg(F.count_if(F.col("status") == "error").alias("unreadable"))


def deep_results(
    with_rules: DataFrame,
    strong_ids: DataFrame,
    docs: DataFrame | None = None,
    comparisons: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """One row per checked request: verdict and the ordered list of flags.

    Failing rules come first, then warnings, then membership of a strong cluster of the
    whole-registry sweep, then unreadable documents. ``hot`` names registry ids that very
    many requests share, if known (see ``hot_keys``).
    """
    ids = strong_ids.select(F.col("id").alias("hu_id")).distinct()
    ids = ids.withColumn("__in_sweep", F.lit(True))
    judged = with_verdict(with_rules, comparisons)
    if "url" in judged.columns:
        # A form without an id is known by the address of its page.
        of_page = F.nullif(F.regexp_extract("url", HU_ID, 1), F.lit(""))
        judged = judged.withColumn("hu_id", F.coalesce(first_given(F.col("hu_id")), of_page))
    rows = spread_join(judged, ids, ["hu_id"], "left", ["request_id"], hot)
    if docs is None:
        rows = rows.withColumn("unreadable", F.lit(0).cast("bigint"))
    else:
        rows = rows.join(unreadable_documents(docs), "request_id", "left")
    unreadable = F.coalesce("unreadable", F.lit(0))

    def titles(status: str) -> Column:
        found = F.filter("rules", lambda r: r["status"] == status)
        return F.transform(found, lambda r: F.concat(F.lit(" "), r["title"]))

    def one(when: Column, text: Column) -> Column:
        return F.when(when, F.array(text)).otherwise(F.array().cast("array<string>"))

    flags = F.concat(
        titles("fail"),
        titles("warn"),
        one(F.coalesce("__in_sweep", F.lit(False)), F.lit(fixed.FLAG_IN_SWEEP)),
        one(unreadable > 0, F.format_string(fixed.FLAG_UNREADABLE, unreadable)),
    )
    return rows.select(
        "request_id",
        "hu_id",
        "input_order",
        F.coalesce(first_given(F.col("hcode")), F.lit("Unknown")).alias("hcode"),
        F.coalesce(first_given(F.col("health_unit_name")), F.lit("-")).alias("name"),
        F.col("verdict").alias("status"),
        "doc_evidence",
        flags.alias("flags"),
    )


def rank_deep_results(deep: DataFrame, limit: int | None = None) -> DataFrame:
    """Failing first, then warnings, then passes; input order within each."""
    order = (
        F.when(F.col("status") == "fail", 0)
        .when(F.col("status") == "warn", 1)
        .when(F.col("status") == "pass", 2)
        .otherwise(3)
    )
    badge = (
        F.when(F.col("status") == "fail", fixed.DEEP_BADGE_FAIL)
        .when(F.size("flags") > 0, fixed.DEEP_BADGE_REVIEW)
        .otherwise(fixed.DEEP_BADGE_CLEAN)
    )
    ranked = deep.withColumn("badge", badge).orderBy(order, "input_order")
    return ranked.limit(limit) if limit else ranked


def deep_report(deep: DataFrame) -> DataFrame:
    """One row: requests checked, needing review, clean."""
    review = (F.size("flags") > 0) | (F.col("status") == "fail")
    return deep.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(review).alias("review"),
        F.count_if(~review).alias("clean"),
    )


def duplicate_signal() -> Column:
    d = F.col("duplicates")
    return (
        F.when(d.isNull(), fixed.DUPLICATES_NOT_CHECKED)
        .when(d["strong_n"] > 0, F.format_string(fixed.DUPLICATES_STRONG, d["strong_n"]))
        .when(d["weak_n"] > 0, F.format_string(fixed.DUPLICATES_WEAK, d["weak_n"]))
        .otherwise(fixed.DUPLICATES_NONE)
    )


def outcome_export(with_rules: DataFrame, comparisons: DataFrame, docs: DataFrame) -> DataFrame:
    """Check outcomes without any value from the form or a document, as JSON lines.

    Rows carry (request_id, part, doc_ordinal, ordinal, payload). A request's payload is
    its rows in that order; nothing is gathered, so a request may have any number.
    """
    zero = F.lit(0)

    def payload(**fields: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("payload")

    def entry(part: str, ordinal: Column, body: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"),
            zero.alias("doc_ordinal"),
            ordinal.cast("int").alias("ordinal"),
            body,
        )

    ruled = F.transform(
        "rules",
        lambda r, i: entry("rule", i, payload(check=r["title"], result=r["status"])),
    )
    signal = F.array(entry("duplicates", zero, payload(signal=duplicate_signal())))
    per_request = with_rules.select("request_id", F.inline(F.concat(ruled, signal)))
    compared = comparisons.select(
        "request_id",
        F.lit("comparison").alias("part"),
        "doc_ordinal",
        F.col("row").alias("ordinal"),
        payload(field=F.col("field"), result=F.when(F.col("match"), "MATCH").otherwise("MISMATCH")),
    )
    read = docs.groupBy("request_id").agg(
        F.count_if(F.col("status") == "success").alias("read"), F.count(F.lit(1)).alias("total")
    )
    documents = read.select(
        "request_id",
        F.lit("documents").alias("part"),
        zero.alias("doc_ordinal"),
        zero.alias("ordinal"),
        payload(read=F.col("read"), total=F.col("total")),
    )
    return per_request.unionByName(compared).unionByName(documents)
