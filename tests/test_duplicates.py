import random
from collections import defaultdict

import pytest

from rosterproof.operators import duplicates as D
from rosterproof.operators import skew
from tests.test_registry import norm, norm_code, random_registry

REQ = "request_id string, hu_id string, code_key string, name_key string, owner_key string"
R2 = [(str(1000 + i), f"GEN{i}", "เอกชน", f"o{i}") for i in range(15)] + [
    ("2000", "ABC123456", "คลินิกเฉพาะทาง ก", "นายสมศักดิ์ ดีมาก"),
    ("2001", "ABC123456", "คลินิกเฉพาะทาง ก", "นายสมศักดิ์ ดีมาก"),
    ("2002", "XYZ999999", "คลินิกเฉพาะทาง ก", "นางสาวใจดี"),
]


def requests(spark, rows):
    """(request_id, hu_id, code, name, owner) to match keys."""
    return spark.createDataFrame(
        [(r, h, norm_code(c), norm(n), norm(o)) for r, h, c, n, o in rows], REQ
    )


def lookup(spark, reg, rows):
    found = D.lookup(requests(spark, rows), D.registry_index(reg))
    return {r.request_id: r for r in found.collect()}


def test_leading_zeros(spark, registry):
    reg = registry(
        [("100", "004087000", "คลินิกทดสอบ", "สมชาย ใจดี"), ("101", "4087000", "คลินิกทดสอบ", "สมชาย ใจดี"),
         ("102", "123456789", "ร้านยาทดสอบ", "สมหญิง ใจงาม")]
    )
    got = lookup(
        spark,
        reg,
        [("a", "100", "004087000", "คลินิกทดสอบ", "สมชาย ใจดี"), ("b", "999", "999999999", "คลินิกใหม่", "สมชาย"),
         ("c", "999", "000123456789", "ร้านยาทดสอบ", "คนอื่น")],
    )
    assert [got[k].duplicates.strong_n for k in "abc"] == [1, 0, 1]
    assert got["a"].duplicates.top[0].id == "101"


def test_classes(spark, registry):
    got = lookup(
        spark,
        registry(R2),
        [("code", "9999", "ABC123456", "x", "y"), ("own", "9999", "ZZZ", "คลินิกเฉพาะทาง ก", "นายสมศักดิ์ ดีมาก"),
         ("weak", "9999", "ZZZ", "คลินิกเฉพาะทาง ก", "คนแปลก"), ("generic", "9999", "ZZZ", "เอกชน", "x"),
         ("self", "2000", "ABC123456", "คลินิกเฉพาะทาง ก", "x"), ("none", "9999", "UNIQ", "ไม่มีซ้ำ", "ไม่ซ้ำ")],
    )
    d = {k: r.duplicates for k, r in got.items()}
    assert d["code"].strong_n == 2
    assert (d["own"].strong_n, d["own"].weak_n) == (2, 1)
    assert {t.why for t in d["own"].top} == {"ชื่อและเจ้าของซ้ำ"}
    assert (d["weak"].strong_n, d["weak"].weak_n) == (0, 3)
    assert (d["generic"].generic, d["generic"].strong_n, d["generic"].weak_n) == (True, 0, 0)
    assert "2000" not in [t.id for t in d["self"].top] and d["self"].strong_n == 1
    assert (d["none"].strong_n, d["none"].weak_n, d["none"].top) == (0, 0, None)
    assert {x.checked for x in d.values()} == {18}


def test_owner_footprint(spark, registry):
    reg = registry([(str(i), f"A{i}", f"C{i}", "นาย สมชาย ดีมาก") for i in (1, 2, 3)] + [("4", "B1", "C4", "นางสาวอื่น")])
    got = lookup(
        spark, reg, [("a", "1", "q", "q", "นาย สมชาย ดีมาก"), ("b", "9", "q", "q", "ไม่มี"), ("c", "1", "q", "q", "")]
    )
    assert [got[k].owner_units.n for k in "abc"] == [2, 0, 0]
    assert [u.id for u in got["a"].owner_units.top] == ["2", "3"]


def brute(rows, reqs):
    counts = defaultdict(int)
    for r in rows:
        counts[norm(r[2])] += 1
    out = {}
    for rid, hu, code, name, owner in reqs:
        c, n, o = norm_code(code), norm(name), norm(owner)
        generic = bool(n) and counts[n] >= 10
        strong, weak, units = [], [], []
        for r in rows:
            if r[0] == hu:
                continue
            same_name = n and norm(r[2]) == n
            same_owner = o and norm(r[3]) == o
            if c and norm_code(r[1]) == c:
                strong.append(r[0])
            elif same_name and same_owner and not generic:
                strong.append(r[0])
            elif same_name and not generic:
                weak.append(r[0])
            if same_owner:
                units.append(r[0])
        top = strong[:8] if strong else weak[:8]
        out[rid] = (len(strong), len(weak), generic, top, len(units), units[:6])
    return out


@pytest.mark.parametrize("hot", [None, 2])
def test_against_brute_force(spark, registry, monkeypatch, hot):
    rows = random_registry(5)
    rng = random.Random(6)
    reqs = []
    for i in range(200):
        base = rng.choice(rows)
        hu = rng.choice([base[0], "", "nobody"])
        other = rng.choice(rows)
        reqs.append((f"r{i}", hu, rng.choice([base[1], other[1]]), base[2], rng.choice([base[3], other[3]])))
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
    got = lookup(spark, registry(rows), reqs)
    for rid, want in brute(rows, reqs).items():
        d, o = got[rid].duplicates, got[rid].owner_units
        top = [t.id for t in d.top or []]
        assert (d.strong_n, d.weak_n, d.generic, top, o.n, [u.id for u in o.top or []]) == want, rid


def test_groups_hold_all_matches(spark, registry):
    """A request's groups joined to their members give its whole match list."""
    rows = random_registry(7)
    reg = registry(rows)
    reqs = [(f"r{i}", r[0], *r[1:4]) for i, r in enumerate(rows[::5])]
    req = requests(spark, reqs)
    groups = D.match_groups(req, D.registry_index(reg)).select("request_id", *D.GROUP_KEYS)
    pairs = groups.join(D.group_members(reg), D.GROUP_KEYS).select("request_id", "id").distinct()
    by_request = defaultdict(set)
    for p in pairs.collect():
        by_request[p.request_id].add(p.id)
    for rid, want in brute(rows, reqs).items():
        own = next(r[1] for r in reqs if r[0] == rid)
        assert len(by_request[rid] - {own}) == want[0] + want[1], rid


def test_index_round_trip(spark, registry, tmp_path):
    reg = registry(R2)
    D.save_index(D.registry_index(reg), str(tmp_path))
    req = requests(spark, [("a", "2000", "ABC123456", "คลินิกเฉพาะทาง ก", "x")])
    a = D.lookup(req, D.registry_index(reg)).collect()
    assert D.lookup(req, D.load_index(spark, str(tmp_path))).collect() == a


def test_own_id_repeats(spark, registry):
    """All records of the request's own id are left out, however many; other matches are listed."""
    rows = [("1", "ABC123456", "คลินิกก", "นายหนึ่ง")] * 30 + [("2", "ABC123456", "คลินิกข", "นายสอง")] * 12
    rows += [("3", "XYZ999999", "คลินิกค", "นายสาม")] * 40 + [("4", "ABC123456", "คลินิกข", "นายสอง")]
    reqs = [("a", "1", "ABC123456", "x", "y"), ("b", "3", "XYZ999999", "คลินิกค", "นายสาม"), ("c", "2", "ABC123456", "x", "นายสอง"),
            ("d", "9", "ABC123456", "x", "y")]
    got = lookup(spark, registry(rows), reqs)
    for rid, want in brute(rows, reqs).items():
        d, o = got[rid].duplicates, got[rid].owner_units
        top = [t.id for t in d.top or []]
        assert (d.strong_n, d.weak_n, d.generic, top, o.n, [u.id for u in o.top or []]) == want, rid


def test_index_of_the_groups_that_requests_meet(spark, registry, monkeypatch):
    rows = [(str(i % 7), str(i % 3), f"ก{i % 4}", f"o{i % 2}") for i in range(40)]
    reg = registry([*rows, *[(f"x{i}", f"9{i}", f"far{i}", f"p{i}") for i in range(50)]])
    asked = [("a", "1", "1", "ก1", "o1"), ("b", "", "2", "ก9", "o0"), ("c", "99", "", "", ""), ("d", "2", "1", "ก1", "o1")]
    req = requests(spark, asked)
    whole = D.registry_index(reg)
    near = D.registry_index(reg, req)
    assert near.groups.count() < whole.groups.count() and near.own.count() < whole.own.count()
    want = sorted(map(str, D.lookup(req, whole).collect()))
    assert sorted(map(str, D.lookup(req, near).collect())) == want
    monkeypatch.setattr(D, "BROADCAST_KEYS", 3)
    many = D.registry_index(reg, req)
    assert many.groups.count() == whole.groups.count()
    assert sorted(map(str, D.lookup(req, many).collect())) == want
    assert D.registry_index(reg, req.limit(0)).groups.count() == 0
