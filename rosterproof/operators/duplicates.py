"""Duplicate lookup of submitted requests against the registry.

The matches of one request are counted by inclusion and exclusion over group counts, and
only the first few are listed, so no (request, record) pairs are ever formed in bulk. The
full match list of a request is its groups (``match_groups``) joined to ``group_members``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterproof.functions import fixed
from rosterproof.functions.keys import code_key, first_given, name_key
from rosterproof.operators.registry import (
    GENERIC_AT,
    GROUP_KEYS,
    KINDS,
    first_members,
    group_rows,
    with_keys,
)
from rosterproof.operators.skew import hot_keys, spread_join
from rosterproof.sources.sinks import write_reports

TOP_DUPLICATES = 8
TOP_OWNER_UNITS = 6
_LISTED = ["code", "name+owner", "name", "owner"]

# A saved index: groups in a bucket, how many buckets there are, and how many group keys of
# a batch are broadcast (at most about 50 MB).
BUCKET_ROWS = 1 << 18
LEAST_BUCKETS, MAX_BUCKETS = 16, 4096
BROADCAST_KEYS = 200_000
_BUCKETED = ("groups", "own")


def request_keys(submissions: DataFrame) -> DataFrame:
    """(request_id, hu_id, code_key, name_key, owner_key) of each submission."""
    return submissions.select(
        "request_id",
        F.coalesce("hu_id", F.lit("")).alias("hu_id"),
        code_key(first_given(F.col("hcode"), F.col("health_unit_hcode"))).alias("code_key"),
        name_key(F.col("health_unit_name")).alias("name_key"),
        name_key(F.col("authority_info.name")).alias("owner_key"),
    )


def _column(kind: str) -> str:
    return "n_" + kind.replace("+", "_")


_KEYS = ("code_key", "name_key", "owner_key")
_OWN_KEYS = [*GROUP_KEYS, "hu_id"]


@dataclass(frozen=True)
class RegistryIndex:
    """What a lookup needs of a registry: a row per group, per group and id, and the record count."""

    groups: DataFrame  # group, n, top (its first members)
    own: DataFrame  # group, hu_id, own (members of the group with that id)
    total: DataFrame  # n


def registry_index(registry: DataFrame, requests: DataFrame | None = None) -> RegistryIndex:
    """Index of a registry; with ``requests`` (from ``request_keys``) of what they can meet.

    The requests' group keys, up to ``BROADCAST_KEYS`` of them (counted first), go to the
    registry's rows before anything is shuffled, so only rows of groups that some request
    falls into are counted and ranked. Beyond that all groups are indexed.
    """
    keyed = with_keys(registry)
    met = mine = None
    if requests is not None:
        probes = group_rows(requests, list(KINDS), ["hu_id"]).distinct()
        if probes.count() <= BROADCAST_KEYS:
            met, mine = probes.select(*GROUP_KEYS).distinct(), probes.where("hu_id <> ''")
    record = F.struct("input_order", "id", "name", "code", "status", *_KEYS)
    # Enough to show, whichever id is the request's own and left out afterwards.
    firsts = (
        first_members(keyed, _LISTED, TOP_DUPLICATES, met)
        .groupBy(*GROUP_KEYS)
        .agg(F.sort_array(F.collect_list(record)).alias("top"))
    )
    members = group_rows(keyed, list(KINDS), [])
    ids = keyed.where(F.col("id") != "").withColumnRenamed("id", "hu_id")
    own = group_rows(ids, list(KINDS), ["hu_id"])
    if met is not None:
        members = members.join(F.broadcast(met), GROUP_KEYS, "left_semi")
        own = own.join(F.broadcast(mine), _OWN_KEYS, "left_semi")
    counts = members.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("n"))
    return RegistryIndex(
        groups=counts.join(firsts, GROUP_KEYS, "left"),
        own=own.groupBy(*_OWN_KEYS).agg(F.count(F.lit(1)).alias("own")),
        total=registry.agg(F.count(F.lit(1)).alias("n")),
    )


def _bucket(buckets: Column | int) -> Column:
    of = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.pmod(F.xxhash64(*GROUP_KEYS), of).cast("int")


def save_index(index: RegistryIndex, folder: str) -> None:
    """Write the index tables, for lookups that run many times over one snapshot.

    Rows lie in a folder per bucket of their group's hash, as many as the index needs for
    ``BUCKET_ROWS`` groups each, so that a lookup reads the buckets of its own groups only.
    """
    records = index.total.first().n
    buckets = min(MAX_BUCKETS, max(LEAST_BUCKETS, records * len(KINDS) // BUCKET_ROWS))
    for name in _BUCKETED:
        table = getattr(index, name).withColumn("bucket", _bucket(buckets))
        table = table.repartition("bucket").sortWithinPartitions("bucket", *GROUP_KEYS)
        table.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")
    write_reports({"total": index.total.withColumn("buckets", F.lit(buckets))}, folder)


def load_index(spark: SparkSession, folder: str, requests: DataFrame | None = None) -> RegistryIndex:
    """The saved index; with ``requests`` (from ``request_keys``) only what they can meet.

    The buckets of the requests' groups, at most ``MAX_BUCKETS`` numbers, become a partition
    filter, and the rest is met by the requests' group keys: broadcast up to
    ``BROADCAST_KEYS`` of them, so the index is neither read whole nor shuffled.
    """
    total = spark.read.parquet(f"{folder}/total")
    tables = {n: spark.read.parquet(f"{folder}/{n}") for n in _BUCKETED}
    if requests is not None:
        buckets = total.first().buckets
        probes = group_rows(requests, list(KINDS), ["hu_id"]).withColumn("bucket", _bucket(buckets))
        probes = probes.distinct()
        met = probes.agg(F.collect_set("bucket").alias("buckets"), F.count(F.lit(1)).alias("n")).first()
        few = met.n <= BROADCAST_KEYS
        for name, keys in (("groups", GROUP_KEYS), ("own", _OWN_KEYS)):
            wanted = probes.select("bucket", *keys).distinct()
            near = tables[name].where(F.col("bucket").isin(met.buckets))
            tables[name] = near.join(F.broadcast(wanted) if few else wanted, ["bucket", *keys], "left_semi")
    return RegistryIndex(total=total.select("n"), **{n: t.drop("bucket") for n, t in tables.items()})


def _found(requests: DataFrame, index: RegistryIndex, generic_at: int) -> DataFrame:
    """One row per request: its keys, its match counts, and the first members it met.

    All groups of a request are probed together, and again with its own id for the records
    to leave out; a request without groups has its row of kind ``id`` only. ``__code`` ..
    ``__owner`` are the members by kind.
    """
    keep = ["request_id", "hu_id", *_KEYS]
    probes = group_rows(requests, list(KINDS), keep, "hu_id")
    hot = hot_keys(probes, GROUP_KEYS)
    mine = hot_keys(probes, _OWN_KEYS)
    probes = spread_join(probes, index.own, _OWN_KEYS, "left", ["request_id"], mine)
    hits = spread_join(probes, index.groups, GROUP_KEYS, "left", ["request_id"], hot)

    def of(kind: str, column: str) -> Column:
        return F.first(F.when(F.col("kind") == kind, F.col(column)), ignorenulls=True)

    row = hits.groupBy("request_id").agg(
        *[F.first(c).alias(c) for c in keep[1:]],
        *[of(k, "n").alias(_column(k)) for k in KINDS],
        *[of(k, "own").alias("__own_" + _column(k)) for k in KINDS],
        *[of(k, "top").alias(f"__{k.replace('name+owner', 'own')}") for k in _LISTED],
    )

    def others(kind: str) -> Column:
        """Group size without the registry records of the request's own id."""
        n, own = (F.coalesce(c, F.lit(0)) for c in (_column(kind), "__own_" + _column(kind)))
        return (n - own).cast("bigint")

    generic = F.coalesce(F.col("n_name") >= generic_at, F.lit(False))
    named = others("name+owner") - others("code+name+owner")
    weak = others("name") - others("code+name") - named
    return row.withColumns(
        {
            "strong_code_n": others("code"),
            "strong_owner_n": F.when(generic, F.lit(0)).otherwise(named).cast("bigint"),
            "weak_n": F.when(generic, F.lit(0)).otherwise(weak).cast("bigint"),
            "owner_n": others("owner"),
            "generic": generic,
            "checked": index.total.scalar(),
        }
    )


def match_counts(
    requests: DataFrame, index: RegistryIndex, generic_at: int = GENERIC_AT
) -> DataFrame:
    """Per request: strong_code_n, strong_owner_n, weak_n, owner_n, generic, checked."""
    counts = ["strong_code_n", "strong_owner_n", "weak_n", "owner_n", "generic", "checked"]
    return _found(requests, index, generic_at).select("request_id", *counts)


def match_groups(
    requests: DataFrame, index: RegistryIndex, generic_at: int = GENERIC_AT
) -> DataFrame:
    """One row per request and match reason: severity, why, group key and match count.

    Counts leave out the request's own record and apply the priority code > name and
    owner > name, so they add up to the number of matching records.
    """

    def reason(kind: str, severity: str, why: str, n: str) -> Column:
        parts = [F.col(k) if u else F.lit("") for k, u in zip(_KEYS, KINDS[kind])]
        fields = [F.lit(kind), *parts, F.lit(severity), F.lit(why), F.col(n)]
        names = [*GROUP_KEYS, "severity", "why", "n"]
        return F.when(F.col(n) > 0, F.struct(*[f.alias(a) for f, a in zip(fields, names)]))

    reasons = F.array(
        reason("code", "strong", fixed.WHY_CODE, "strong_code_n"),
        reason("name+owner", "strong", fixed.WHY_NAME_OWNER, "strong_owner_n"),
        reason("name", "weak", fixed.WHY_NAME, "weak_n"),
    )
    found = _found(requests, index, generic_at)
    return found.select("request_id", F.inline(F.filter(reasons, lambda r: r.isNotNull())))


def group_members(registry: DataFrame) -> DataFrame:
    """Edges (group, record) of every group a request can fall into."""
    keep = ["id", "code", "name", "owner", "status", "input_order"]
    return group_rows(with_keys(registry), _LISTED, keep)


def lookup(
    requests: DataFrame, index: RegistryIndex, generic_at: int = GENERIC_AT
) -> DataFrame:
    """Duplicate verdict and owner footprint of each request.

    ``duplicates``: struct(strong_n, weak_n, generic, checked, top), ``top`` being the
    first eight strong matches, or weak ones where no match is strong.
    ``owner_units``: struct(n, top), the first six other records of the owner.
    """
    found = _found(requests, index, generic_at)
    my_code = F.col("code_key")

    def listed(column: str, why: str | None) -> Column:
        def shown(r: Column) -> Column:
            reason = F.lit(why).cast("string")
            if why:
                by_code = (my_code != "") & (r["code_key"] == my_code)
                reason = F.when(by_code, fixed.WHY_CODE).otherwise(reason)
            rest = [r[f].alias(f) for f in ("id", "name", "code", "status")]
            return F.struct(r["input_order"].alias("input_order"), reason.alias("why"), *rest)

        others = F.filter(column, lambda r: r["id"] != F.col("hu_id"))
        return F.coalesce(F.transform(others, shown), F.array().cast(_SHOWN))

    lists = {
        "__code": listed("__code", fixed.WHY_CODE),
        "__own": listed("__own", fixed.WHY_NAME_OWNER),
        "__name": listed("__name", fixed.WHY_NAME),
        "__owner": listed("__owner", None),
    }
    strong_n = F.col("strong_code_n") + F.col("strong_owner_n")
    strong = F.when(F.col("generic"), F.col("__code")).otherwise(
        F.array_sort(F.array_union("__code", "__own"))
    )
    top = F.when(strong_n > 0, F.slice(strong, 1, TOP_DUPLICATES)).when(
        F.col("weak_n") > 0, F.slice("__name", 1, TOP_DUPLICATES)
    )
    return found.withColumns(lists).select(
        "request_id",
        F.struct(
            strong_n.alias("strong_n"),
            F.col("weak_n"),
            F.col("generic"),
            F.col("checked"),
            top.alias("top"),
        ).alias("duplicates"),
        F.struct(
            F.col("owner_n").alias("n"), F.slice("__owner", 1, TOP_OWNER_UNITS).alias("top")
        ).alias("owner_units"),
    )


_SHOWN = (
    "array<struct<input_order:bigint,why:string,id:string,name:string,code:string,status:string>>"
)


def top_duplicates(looked_up: DataFrame) -> DataFrame:
    """The listed matches as rows, with their rank and how many more there are."""
    d = F.col("duplicates")
    shown = F.when(d["strong_n"] > 0, d["strong_n"]).otherwise(d["weak_n"])
    return looked_up.select(
        "request_id",
        F.greatest(shown - TOP_DUPLICATES, F.lit(0)).alias("remaining"),
        F.posexplode(d["top"]).alias("rank", "match"),
    ).select("request_id", (F.col("rank") + 1).alias("rank"), "match.*", "remaining")


def owner_footprint(looked_up: DataFrame) -> DataFrame:
    """The owner's other records as rows, with their rank and how many more there are."""
    o = F.col("owner_units")
    return looked_up.select(
        "request_id",
        o["n"].alias("units"),
        F.greatest(o["n"] - TOP_OWNER_UNITS, F.lit(0)).alias("remaining"),
        F.posexplode(o["top"]).alias("rank", "unit"),
    ).select("request_id", "units", (F.col("rank") + 1).alias("rank"), "unit.*", "remaining")


def verdicts_from_lists(submissions: DataFrame) -> DataFrame:
    """Same columns as ``lookup`` for submissions that carry their match lists.

    ``duplicate_lists`` is struct(strong, weak, generic, checked) with arrays of records,
    ``owner_other_units`` an array of records; null means not looked up.
    """
    d, o = F.col("duplicate_lists"), F.col("owner_other_units")

    def record(x: Column, i: Column, why: Column) -> Column:
        fields = ["id", "name", "code", "status"]
        return F.struct(
            i.cast("bigint").alias("input_order"),
            why.alias("why"),
            *[x[f].alias(f) for f in fields],
        )

    def matches(c: Column) -> Column:
        return F.slice(F.transform(c, lambda x, i: record(x, i, x["why"])), 1, TOP_DUPLICATES)

    strong_n = F.size(d["strong"]).cast("bigint")
    weak_n = F.size(d["weak"]).cast("bigint")
    verdict = F.struct(
        strong_n.alias("strong_n"),
        weak_n.alias("weak_n"),
        d["generic"].alias("generic"),
        d["checked"].cast("bigint").alias("checked"),
        F.when(strong_n > 0, matches(d["strong"])).otherwise(matches(d["weak"])).alias("top"),
    )
    no_why = F.lit(None).cast("string")
    units = F.struct(
        F.size(o).cast("bigint").alias("n"),
        F.slice(F.transform(o, lambda x, i: record(x, i, no_why)), 1, TOP_OWNER_UNITS).alias("top"),
    )
    return submissions.withColumns(
        {
            "duplicates": F.when(d.isNotNull(), verdict),
            "owner_units": F.when(o.isNotNull(), units),
        }
    )


