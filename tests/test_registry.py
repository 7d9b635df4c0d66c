import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rosterproof.operators import registry as R
from rosterproof.operators import skew
from rosterproof.plans import standins

R3 = [
    ("1", "AAA111111", "คลินิก A", "เจ้าของ A"),
    ("2", "AAA111111", "คลินิก A", "เจ้าของ A"),
    ("3", "BBB222222", "คลินิก B", "เจ้าของ B"),
    ("4", "CCC333333", "คลินิก B", "เจ้าของ C"),
]


def members_by_cluster(df):
    out = defaultdict(set)
    for r in df.collect():
        out[(r.kind, r.cluster_id)].add(r.id)
    return {(k, frozenset(v)) for (k, _), v in out.items()}


def test_clusters(registry):
    reg = registry(R3)
    got = {(c.kind, c.severity, c.label, c.n) for c in R.duplicate_clusters(reg).collect()}
    # The name+owner and name clusters of 1 and 2 are the code cluster again.
    assert got == {("code", "strong", "รหัสซ้ำ 111111", 2), ("name", "weak", "ชื่อซ้ำ: คลินิก B", 2)}
    assert {(r.id, r.severity) for r in R.flagged_ids(reg).collect()} == {
        ("1", "strong"), ("2", "strong"), ("3", "weak"), ("4", "weak"),
    }
    totals = {r.measure: r.n for r in R.sweep_totals(reg).collect()}
    assert totals == {"strong_clusters": 1, "weak_clusters": 1, "generic_names": 0, "scanned": 4}


def test_audit(registry):
    reg = registry(
        [
            ("1", "DUP000001", "คลินิก Dup", "OwnerA", 20),
            ("2", "DUP000001", "คลินิก Dup", "OwnerA", 0),
            ("3", "", "ไม่มีรหัส", "OwnerB", 3),
        ]
    )
    rows = {r.id: r for r in R.audit(reg, 15, 2).collect()}
    flags = {i: [(f.level, f.text) for f in r.flags] for i, r in rows.items()}
    assert flags["1"] == [
        ("fail", "ซ้ำชัดเจน (รหัส/ชื่อ+เจ้าของ)"), ("warn", "เจ้าของยื่น 2 คำร้อง"), ("warn", "ค้าง 20 วัน"),
    ]
    assert flags["3"] == [("fail", "ไม่มีรหัสหน่วยบริการ")]
    assert all(r.failed and r.flagged for r in rows.values())


def test_audit_limit_zero_means_default(registry):
    reg = registry([("1", "1", "a", "x", 14), ("2", "2", "b", "y", 15)])
    assert {r.id: len(r.flags) for r in R.audit(reg, 0, 0).collect()} == {"1": 0, "2": 1}


def test_owner_limit_of_one(registry):
    reg = registry([("1", "1", "a", "x"), ("2", "2", "b", "")])
    assert {r.id: [f.text for f in r.flags] for r in R.audit(reg, 15, 1).collect()} == {
        "1": ["เจ้าของยื่น 1 คำร้อง"], "2": [],
    }


def test_generic_from_ten(registry):
    rows = [(str(i), str(i), "เอกชน", f"o{i}") for i in range(1, 11)]
    rows += [(str(i), str(i), "เก้า", f"o{i}") for i in range(11, 20)]
    got = R.generic_names(registry(rows)).collect()
    assert [(r.name_key, r.n) for r in got] == [("เอกชน", 10)]
    clusters = R.duplicate_clusters(registry(rows)).collect()
    assert [(c.kind, c.n) for c in clusters] == [("name", 9)]


def test_headline_and_ranking(registry):
    reg = registry(
        [("1", "", "a", "x", 20), ("2", "2", "b", "y", 99), ("3", "", "c", "z", 0), ("4", "4", "d", "w", 0)]
    )
    audited = R.audit(reg)
    head = R.audit_headline(reg).collect()[0]
    assert head.asDict() == {
        "scanned": 4, "failed": 2, "review": 1, "clean": 1, "strong_clusters": 0, "weak_clusters": 0,
    }
    assert [r.id for r in R.rank_flagged(audited).collect()] == ["1", "3", "2"]
    assert [r.id for r in R.rank_flagged(audited, 1).collect()] == ["1"]


def test_queue(registry):
    reg = registry(
        [("5", "1", "a", "x", 0, "รออนุมัติเอกสาร (1)"), ("", "2", "b", "y", 0, "รออนุมัติเอกสาร"), ("7", "2", "b", "y", 0, "อนุมัติ"),
         ("6", "1", "a", "x", 0, "รออนุมัติเอกสาร")]
    )
    assert [r.url for r in R.review_queue(reg, "https://h").orderBy("input_order").collect()] == [
        "https://h/admin/checklist/5", "https://h/admin/checklist/6",
    ]
    assert [r.id for r in R.review_queue(reg, "https://h", 1).collect()] == ["5"]
    assert R.review_queue(reg, "https://h", -3).count() == 0


def random_registry(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        code = rng.choice(["", "000", f"{rng.randrange(60):05d}", f"CA{rng.randrange(60)}"])
        name = rng.choice(["เอกชน", f"คลินิก {rng.randrange(40)}", f"คลินิก-{rng.randrange(40)}", "", f"only {i}"])
        owner = rng.choice(["", "hot owner", f"o{rng.randrange(25)}"])
        rows.append((str(i), code, name, owner, rng.randrange(30)))
    # Twins that share every key, so that clusters of different kinds coincide.
    for j in range(0, 60, 3):
        for t in range(2):
            rows.append((f"t{j}.{t}", f"9{j:05d}", f"twin {j}", f"twin owner {j}", 0))
    return rows


def norm(s):
    return "".join(c for c in s.lower() if c not in " ()._/\\–—-")


def norm_code(s):
    digits = "".join(c for c in s if c.isdigit())
    return digits.lstrip("0") if digits else s.lower()


def brute_clusters(rows):
    """Member sets in the order code, name+owner, name; a repeated set is dropped."""
    names = Counter(norm(r[2]) for r in rows if norm(r[2]))
    generic = {n for n, c in names.items() if c >= 10}
    kinds = {"code": defaultdict(list), "name+owner": defaultdict(list), "name": defaultdict(list)}
    for r in rows:
        c, n, o = norm_code(r[1]), norm(r[2]), norm(r[3])
        if c:
            kinds["code"][c].append(r[0])
        if n and n not in generic:
            kinds["name"][n].append(r[0])
            if o:
                kinds["name+owner"][n, o].append(r[0])
    seen, out = set(), set()
    for kind in ("code", "name+owner", "name"):
        for ids in kinds[kind].values():
            key = frozenset(ids)
            if len(ids) >= 2 and (kind == "code" or key not in seen):
                out.add((kind, key))
                if kind != "name":
                    seen.add(key)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_against_brute_force(registry, seed):
    rows = random_registry(seed)
    expected = brute_clusters(rows)
    assert {k for k, _ in expected} == {"code", "name+owner", "name"}
    assert members_by_cluster(R.cluster_members(registry(rows))) == expected


def test_hot_groups_change_nothing(registry, monkeypatch):
    """With every group treated as hot, joins are sliced and results stay the same."""
    reg = registry(random_registry(3))
    plain = sorted(map(str, R.audit(reg).collect()))
    edges = members_by_cluster(R.cluster_members(reg))
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    assert sorted(map(str, R.audit(reg).collect())) == plain
    assert members_by_cluster(R.cluster_members(reg)) == edges


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_spread_join(spark, how):
    many = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    many = many.unionByName(spark.range(5).select(F.lit(None).cast("bigint").alias("k"), "id"))
    few = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    few = few.unionByName(spark.createDataFrame([(7, 1), (7, 2)], "k bigint, v bigint"))
    hot = skew.hot_keys(many, ["k"], 5)
    assert hot.count() > 1
    got = skew.spread_join(many, few, ["k"], how, ["id"], hot)
    want = many.join(few, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_only_hot_keys_are_broadcast(spark):
    """The other side of a spread join and the registry behind forms stay off the driver."""
    many, few = spark.range(100).selectExpr("id % 7 as k", "id"), spark.range(7).selectExpr("id as k", "id as v")
    hot = skew.hot_keys(many, ["k"], 5).localCheckpoint()
    plan = skew.spread_join(many, few, ["k"], "left", ["id"], hot)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1
    parts = spark.createDataFrame(
        [(1, "a", "t", "b", 3)], "p_partkey bigint, p_name string, p_type string, p_brand string, p_size int"
    )
    customers = spark.createDataFrame([(1, 2), (5, 2)], "c_custkey bigint, c_nationkey int")
    nations = spark.createDataFrame([(2, "n")], "n_nationkey int, n_name string")
    forms = standins.derive(spark, "", standins.SUBMISSIONS_SQL, part=parts, customer=customers, nation=nations)
    joins = forms._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in joins and sorted(r.request_id for r in forms.collect()) == ["1", "5"]


def test_hot_key_reaches_many_tasks(spark):
    """The rows of one key are cut into slices, about as many as hot_rows says."""
    many = spark.range(1000).select(F.lit(7).alias("k"), "id")
    few = spark.createDataFrame([(7, 1)], "k int, v int")
    hot = skew.hot_keys(many, ["k"], 100)
    assert hot.collect()[0]["__cut"] == 10
    assert skew.spread_join(many, few, ["k"], "inner", ["id"], hot).count() == 1000


def test_empty_and_repeated_ids(registry):
    """Groups are of rows: an id shared by several rows joins nothing that its keys don't."""
    reg = registry([("", "1", "a", "x"), ("", "1", "b", "y"), ("", "7", "c", "z"), ("x", "9", "d", "w"), ("x", "8", "e", "w")])
    assert [(c.cluster_id, c.n) for c in R.duplicate_clusters(reg).collect()] == [("code:1", 2)]
    members = R.cluster_members(reg).collect()
    assert sorted((m.id, m.code) for m in members) == [("", "1"), ("", "1")]
    assert [(r.id, r.severity) for r in R.flagged_ids(reg).collect()] == [("", "strong")]
    flags = {r.input_order: [f.text for f in r.flags] for r in R.audit(reg).collect()}
    assert len(flags) == 5 and flags[0] and flags[1] and not flags[2] and not flags[3]


def test_many_equal_hot_keys_keep_every_row(spark):
    """Hot keys follow from the totals, so both sides agree even without exchange reuse."""
    from pyspark.sql import functions as F

    from rosterproof.operators import skew

    many = spark.range(40_000).select((F.col("id") % 200).alias("k"), "id")
    few = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        hot = skew.hot_keys(many, ["k"], 50)
        assert hot.count() == 200
        got = skew.spread_join(many, few, ["k"], "inner", ["id"], hot)
        assert got.count() == 40_000 and got.where("v <> 2 * k").count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_shown_of_total(registry):
    r = registry([(str(i), "x", f"ก{i // 2}", f"o{i}") for i in range(10)])
    shown = R.shown_of_total(R.audit(r), 3).collect()
    assert [(x.id, x.n_shown, x.n_flagged) for x in shown] == [
        (i, 3, 10) for i in ("0", "1", "2")
    ]
    assert {(x.n_shown, x.n_flagged) for x in R.shown_of_total(R.audit(r), 300).collect()} == {(10, 10)}
    assert R.shown_of_total(R.audit(r.limit(0))).collect() == []


def test_weak_clusters_are_ranked_before_members_are_fetched(registry):
    names = ["a", "b", "a", "c", "b", "c", "c"]
    r = registry([(str(i), str(100 + i), n, f"o{i}") for i, n in enumerate(names)])
    top = R.top_weak_clusters(r, 2)
    assert sorted((x.label[-1], x.n, x.id) for x in top.collect()) == [
        ("a", 2, "0"), ("a", 2, "2"), ("b", 2, "1"), ("b", 2, "4")
    ]
    assert "collect_list" not in top._jdf.queryExecution().optimizedPlan().toString()
