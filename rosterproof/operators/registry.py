"""Registry sweep: generic names, duplicate clusters, audit flags, headline counts.

A registry row has: id, code, name, type, status, owner, sla, create_date, input_order.
``input_order`` is the row's position in the source; ids may be empty or repeat.

Everything is decided from group sizes. Groups are counted (partial aggregation), the
sizes are brought back to the records, and each record then knows by itself whether it is
flagged and which clusters it belongs to. No group is ever collected or windowed over, so
a key that holds a third of the table costs one counted row and evenly spread edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterproof.functions import fixed
from rosterproof.functions.keys import code_key, given, name_key
from rosterproof.operators.skew import hot_groups, spread_join

GENERIC_AT = 10
SLA_LIMIT = 15
OWNER_LIMIT = 5
# Rows of a ranking that are broadcast at most; longer ones are joined as Spark sees fit.
WINNERS = 100_000
GROUP_KEYS = ["kind", "g_code", "g_name", "g_owner"]

# Which match keys make up each kind of group: (code, name, owner).
KINDS = {
    "code": (True, False, False),
    "name": (False, True, False),
    "name+owner": (False, True, True),
    "owner": (False, False, True),
    "code+name": (True, True, False),
    "code+name+owner": (True, True, True),
}


def with_keys(registry: DataFrame) -> DataFrame:
    """Add code_key, name_key and owner_key."""
    return registry.withColumns(
        {
            "code_key": code_key(F.col("code")),
            "name_key": name_key(F.col("name")),
            "owner_key": name_key(F.col("owner")),
        }
    )


def group_rows(
    keyed: DataFrame, kinds: list[str], keep: list[str], id_column: str | None = None
) -> DataFrame:
    """One row per record and kind of group it belongs to.

    A record belongs to a kind when all of the kind's keys are non-empty. With
    ``id_column`` every record also has a row of kind ``id``.
    """
    names = ("code_key", "name_key", "owner_key")

    def entry(kind: str) -> Column:
        used = KINDS[kind]
        present = [F.col(k) != "" for k, u in zip(names, used) if u]
        ok = present[0]
        for p in present[1:]:
            ok = ok & p
        parts = [(F.col(k) if u else F.lit("")) for k, u in zip(names, used)]
        fields = [F.lit(kind), *parts]
        return F.when(ok, F.struct(*[f.alias(n) for f, n in zip(fields, GROUP_KEYS)]))

    every = [entry(k) for k in kinds]
    if id_column:
        parts = [F.lit("id"), F.col(id_column), F.lit(""), F.lit("")]
        every.append(F.struct(*[f.alias(n) for f, n in zip(parts, GROUP_KEYS)]))
    entries = F.filter(F.array(*every), lambda e: e.isNotNull())
    return keyed.select(*keep, F.inline(entries))


def generic_names(registry: DataFrame, generic_at: int = GENERIC_AT) -> DataFrame:
    """Placeholder names: normalised names shared by ``generic_at`` records or more."""
    return (
        registry.select(name_key(F.col("name")).alias("name_key"))
        .where(F.col("name_key") != "")
        .groupBy("name_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= generic_at)
    )


def _size_column(kind: str) -> str:
    return "n_" + kind.replace("+", "_")


TRIPLE = ["code_key", "name_key", "owner_key"]


def with_group_sizes(registry: DataFrame, kinds: list[str]) -> DataFrame:
    """Registry rows with their keys and one size column per kind, e.g. ``n_name_owner``.

    A record alone in its group, or in no group of a kind, has size 1. Records are counted
    once per triple of keys; all group sizes come from that compact table and go back to
    the records on the triple, so ids may repeat or be empty.
    """
    keyed = with_keys(registry)
    triples = keyed.groupBy(*TRIPLE).agg(F.count(F.lit(1)).alias("n"))
    parts = group_rows(triples, kinds, [*TRIPLE, "n"])
    counts = (
        parts.groupBy(*GROUP_KEYS)
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("__triples"))
        .where(F.col("n") >= 2)
    )
    hot = hot_groups(counts.select(*GROUP_KEYS, F.col("__triples").alias("n")), GROUP_KEYS)
    hits = spread_join(
        parts.drop("n"), counts.drop("__triples"), GROUP_KEYS, "inner", TRIPLE, hot
    )
    sizes = hits.groupBy(*TRIPLE).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(_size_column(k)) for k in kinds]
    )
    one = {_size_column(k): F.coalesce(_size_column(k), F.lit(1)) for k in kinds}
    spread = hot_groups(triples, TRIPLE)
    return spread_join(keyed, sizes, TRIPLE, "left", hot=spread).withColumns(one)


SWEEP_KINDS = ["code", "name", "name+owner", "code+name", "code+name+owner"]


def _sweep_flags(generic_at: int) -> dict[str, Column]:
    """Per record: generic name, and the clusters it is in, from its group sizes.

    A cluster with the very members of an earlier one is dropped. All members of a group
    share another key exactly when the group does not shrink by adding that key, so the
    sets are compared by sizes alone.
    """
    code, name, own = F.col("n_code"), F.col("n_name"), F.col("n_name_owner")
    name_code, all_three = F.col("n_code_name"), F.col("n_code_name_owner")
    generic = name >= generic_at
    own_pair = (own >= 2) & ~generic
    return {
        "is_generic": generic,
        "in_code": code >= 2,
        "in_own": own_pair & ~((all_three == own) & (code == own)),
        "in_name": (name >= 2) & ~generic & (own != name) & ~((name_code == name) & (code == name)),
        # A dropped name+owner cluster equals a code cluster, so its members are strong.
        "is_strong": (code >= 2) | own_pair,
    }


def sweep(registry: DataFrame, generic_at: int = GENERIC_AT, extra: list[str] | None = None) -> DataFrame:
    """Registry rows with sizes, is_generic, is_strong and cluster membership."""
    sized = with_group_sizes(registry, [*SWEEP_KINDS, *(extra or [])])
    return sized.withColumns(_sweep_flags(generic_at))


def _cluster_entries(generic: bool = False) -> Column:
    """Clusters a swept record is in: array<struct<kind, severity, cluster_id, n>>.

    ``cluster_id`` is the kind and the shared keys; keys hold no blanks.
    """

    def entry(member: str, kind: str, severity: str, *key_columns: str) -> Column:
        cluster = F.concat(F.lit(f"{kind}:"), F.concat_ws(" ", *key_columns))
        fields = {
            "kind": F.lit(kind),
            "severity": F.lit(severity),
            "cluster_id": cluster,
            "n": F.col(_size_column(kind)),
        }
        return F.when(F.col(member), F.struct(*[v.alias(k) for k, v in fields.items()]))

    entries = [
        entry("in_code", "code", "strong", "code_key"),
        entry("in_own", "name+owner", "strong", "name_key", "owner_key"),
        entry("in_name", "name", "weak", "name_key"),
    ]
    if generic:
        entries.append(entry("is_generic", "name", "generic", "name_key"))
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def cluster_members(registry: DataFrame, generic_at: int = GENERIC_AT) -> DataFrame:
    """Edges (cluster, record) of every duplicate cluster, with the cluster's size ``n``."""
    return sweep(registry, generic_at).select(
        F.inline(_cluster_entries()),
        "id",
        "code",
        "name",
        "status",
        "input_order",
        "code_key",
    )


def duplicate_clusters(registry: DataFrame, generic_at: int = GENERIC_AT) -> DataFrame:
    """Duplicate clusters of the whole registry: id, kind, severity, label, size."""
    return clusters_of(cluster_members(registry, generic_at))


def clusters_of(members: DataFrame) -> DataFrame:
    first = F.min(F.struct("input_order", "name", "code_key"))
    label = (
        F.when(F.col("kind") == "code", F.concat(F.lit(fixed.LABEL_CODE), "f.code_key"))
        .when(F.col("kind") == "name", F.concat(F.lit(fixed.LABEL_NAME), "f.name"))
        .otherwise(F.concat(F.lit(fixed.LABEL_NAME_OWNER), "f.name"))
    )
    return (
        members.groupBy("cluster_id", "kind", "severity", "n")
        .agg(first.alias("f"))
        .select(
            "cluster_id",
            "kind",
            "severity",
            label.alias("label"),
            "n",
            F.col("f.input_order").alias("first_order"),
        )
    )


def flagged_ids(registry: DataFrame, generic_at: int = GENERIC_AT) -> DataFrame:
    """Distinct (id, severity): members of strong clusters, and members of weak ones."""
    severities = F.array(
        F.when(F.col("is_strong"), F.lit("strong")), F.when(F.col("in_name"), F.lit("weak"))
    )
    return (
        sweep(registry, generic_at)
        .select("id", F.explode(F.filter(severities, lambda s: s.isNotNull())).alias("severity"))
        .distinct()
    )


def _tally(swept: DataFrame, *more: Column) -> DataFrame:
    """(measure, key, n) over swept records: clusters by severity, generic names, records.

    ``more`` are further measures of a record, null where it does not count.
    """
    clusters = F.transform(
        _cluster_entries(generic=True),
        lambda e: F.struct(e["severity"].alias("measure"), e["cluster_id"].alias("key")),
    )
    single = F.filter(F.array(F.lit("scanned"), *more), lambda m: m.isNotNull())
    records = F.transform(single, lambda m: F.struct(m.alias("measure"), F.lit("").alias("key")))
    return (
        swept.select(F.inline(F.concat(clusters, records)))
        .groupBy("measure", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sweep_totals(registry: DataFrame, generic_at: int = GENERIC_AT) -> DataFrame:
    """Clusters by severity, generic names, and records scanned, as (measure, n).

    A severity without clusters has no row.
    """
    measure = F.col("measure")
    name = (
        F.when(measure == "generic", "generic_names")
        .when(measure == "scanned", measure)
        .otherwise(F.concat(measure, F.lit("_clusters")))
    )
    counted = _tally(sweep(registry, generic_at))
    groups = F.count(F.lit(1))
    found = counted.groupBy(name.alias("measure")).agg(
        F.when(F.first("measure") == "scanned", F.sum("n")).otherwise(groups).alias("n")
    )
    none = registry.sparkSession.sql(
        "select * from values ('generic_names', 0L), ('scanned', 0L) as t(measure, n)"
    )
    return found.unionByName(none).groupBy("measure").agg(F.max("n").alias("n"))


def owner_counts(registry: DataFrame) -> DataFrame:
    """Records per normalised owner."""
    return (
        registry.select(name_key(F.col("owner")).alias("owner_key"))
        .where(F.col("owner_key") != "")
        .groupBy("owner_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def audit(
    registry: DataFrame,
    sla_limit: int | None = SLA_LIMIT,
    owner_limit: int | None = OWNER_LIMIT,
    generic_at: int = GENERIC_AT,
) -> DataFrame:
    """Registry rows with ``flags`` array<struct<level, text>> and flagged / failed.

    A limit of 0 or None means the default.
    """
    sla_limit, owner_limit = sla_limit or SLA_LIMIT, owner_limit or OWNER_LIMIT
    rows = sweep(registry, generic_at, ["owner"])
    kept = _audit_flags(sla_limit, owner_limit)
    return rows.select(*registry.columns, kept.alias("flags")).withColumns(_verdict())


def _audit_flags(sla_limit: int, owner_limit: int) -> Column:
    """Flags of a swept record."""
    owner_n = F.when(F.col("owner_key") != "", F.col("n_owner"))

    def flag(when: Column, level: str, text) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.when(when, F.struct(F.lit(level).alias("level"), text.alias("text")))

    flags = F.array(
        flag(F.col("is_strong"), "fail", fixed.FLAG_STRONG),
        flag(~F.col("is_strong") & F.col("in_name"), "warn", fixed.FLAG_WEAK),
        flag(~given(F.col("code")), "fail", fixed.FLAG_NO_CODE),
        flag(F.col("is_generic"), "warn", fixed.FLAG_GENERIC),
        flag(owner_n >= owner_limit, "warn", F.format_string(fixed.FLAG_OWNER, owner_n)),
        flag(F.col("sla") >= sla_limit, "warn", F.format_string(fixed.FLAG_SLA, F.col("sla"))),
    )
    return F.filter(flags, lambda f: f.isNotNull())


def _verdict() -> dict[str, Column]:
    return {
        "flagged": F.size("flags") > 0,
        "failed": F.exists("flags", lambda f: f["level"] == "fail"),
    }


def audit_headline(
    registry: DataFrame,
    sla_limit: int | None = SLA_LIMIT,
    owner_limit: int | None = OWNER_LIMIT,
    generic_at: int = GENERIC_AT,
) -> DataFrame:
    """One row: scanned, failed, review, clean, strong and weak clusters, from one sweep."""
    flags = _audit_flags(sla_limit or SLA_LIMIT, owner_limit or OWNER_LIMIT)
    rows = sweep(registry, generic_at, ["owner"]).withColumn("flags", flags).withColumns(_verdict())
    state = F.when(F.col("failed"), "failed").when(F.col("flagged"), "review").otherwise("clean")
    counted = _tally(rows, state)
    measure = F.col("measure")

    def records(name: str) -> Column:
        return F.coalesce(F.sum(F.when(measure == name, F.col("n"))), F.lit(0)).alias(name)

    return counted.agg(
        *[records(m) for m in ("scanned", "failed", "review", "clean")],
        F.count_if(measure == "strong").alias("strong_clusters"),
        F.count_if(measure == "weak").alias("weak_clusters"),
    )


def rank_flagged(audited: DataFrame, limit: int | None = 300) -> DataFrame:
    """Flagged records, failing first, then by number of flags, then in input order."""
    ranked = (
        audited.where("flagged")
        .withColumns({"n_flags": F.size("flags"), "short_name": F.substring("name", 1, 30)})
        .orderBy(F.desc("failed"), F.desc("n_flags"), "input_order")
    )
    return ranked.limit(limit) if limit else ranked


def shown_of_total(audited: DataFrame, limit: int = 300) -> DataFrame:
    """The first ``limit`` flagged records in rank order, with ``n_shown`` of ``n_flagged``.

    The total is one number, counted over the flagged rows by partial sums; it needs none
    of their columns, and the ranking keeps ``limit`` rows a task.
    """
    total = audited.where("flagged").agg(F.count(F.lit(1)).alias("n")).scalar()
    shown = rank_flagged(audited, limit).withColumn("n_flagged", total)
    return shown.withColumn("n_shown", F.least(F.lit(limit).cast("long"), "n_flagged"))


def top_weak_clusters(registry: DataFrame, limit: int = 60, generic_at: int = GENERIC_AT) -> DataFrame:
    """Members of the first ``limit`` weak clusters, names cut to 28 characters.

    A weak cluster has a non-generic name, so it holds under ``generic_at`` members. Clusters
    are ranked by their first record alone; members are fetched for the winners only.
    """
    members = cluster_members(registry, generic_at).where(F.col("kind") == "name")
    first = F.min(F.struct("input_order", "name"))
    winners = (
        members.groupBy("cluster_id")
        .agg(first.alias("first"))
        .orderBy("first.input_order")
        .limit(limit)
        .select(
            F.col("cluster_id").alias("winner"),
            F.concat(F.lit(fixed.LABEL_NAME), "first.name").alias("label"),
        )
    )
    # At most ``limit`` rows: few enough to broadcast.
    return members.join(
        F.broadcast(winners) if limit <= WINNERS else winners,
        F.col("cluster_id") == F.col("winner"),
    ).select(
        "cluster_id",
        "label",
        "n",
        "id",
        F.substring("name", 1, 28).alias("short_name"),
        "status",
        "input_order",
    )


def pending(registry: DataFrame) -> DataFrame:
    """Records waiting for document approval."""
    return registry.where(F.col("status").contains(fixed.PENDING_STATUS))


def review_queue(registry: DataFrame, base_url: str, n: int | None = None) -> DataFrame:
    """(id, url, input_order) of pending records in input order, ids missing left out.

    ``n`` is the deep-check bound: the first n, clamped to 0 .. all. None means all.
    """
    queue = (
        pending(registry)
        .where(given(F.col("id")))
        .select(
            "id", F.concat(F.lit(f"{base_url}/admin/checklist/"), "id").alias("url"), "input_order"
        )
    )
    if n is None:
        return queue
    return queue.orderBy("input_order").limit(max(0, n))


def first_members(
    keyed: DataFrame, kinds: list[str], k: int, groups: DataFrame | None = None
) -> DataFrame:
    """First members of each group, in input order: k of each of its first k + 1 ids.

    With ``groups`` (few enough to broadcast) only the members of these are looked at.

    Whichever id is left out, the first ``k`` of the other members are among them. Spark
    limits the rows of an id, and the ids of a group, in every map task before the shuffle.
    """
    keep = ["id", "code", "name", "status", "input_order", *TRIPLE]
    of_id = Window.partitionBy(*GROUP_KEYS, "id").orderBy("input_order")
    so_far = of_id.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = group_rows(keyed, kinds, keep)
    if groups is not None:
        rows = rows.join(F.broadcast(groups), GROUP_KEYS, "left_semi")
    rows = rows.withColumns(
        {"__rank": F.row_number().over(of_id), "__first": F.min("input_order").over(so_far)}
    )
    ids = Window.partitionBy(*GROUP_KEYS).orderBy("__first", "id")
    few = rows.where(F.col("__rank") <= k).withColumn("__ids", F.dense_rank().over(ids))
    return few.where(F.col("__ids") <= k + 1).drop("__rank", "__first", "__ids")
