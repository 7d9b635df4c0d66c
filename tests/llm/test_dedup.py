"""Exact dedup and SimHash near-dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from rosterproof.llm import common, exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp string, node int"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, "en", "s", None, 7, "x", 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def norm(t):
    return "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")


CASES = [
    (3, "a b c"),
    (1, "abc"),
    (2, "a  b\tc\n"),
    (4, None),
    (5, ""),
    (6, " \n"),
    (7, "other"),
    (8, "other"),
    (8, "other"),
    (None, "other"),
    (9, "x" * 200_000 + " y"),
    (10, "x" * 200_000 + "y"),
    (11, "x" * 200_000 + "z"),
    (12, "é" * 3),
    (13, "ABC"),
]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))
        for i, _ in members:
            sha = hashlib.sha256(text.encode()).hexdigest()
            out.append((str(i), str(best[0]), len(members), sha))
    return sorted(out)


@pytest.mark.parametrize("hashes", [exact_dedup.HASHES, ((2, 1), (3, 1), (5, 1))])
def test_exact_groups(spark, hashes):
    """The second choice of primes makes nearly all fingerprints collide."""
    found = exact_dedup.exact_groups(docs_of(spark, CASES), hashes).collect()
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found)
    assert got == brute_exact(CASES)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({norm(t) for _, t in CASES})


def test_exact_stage(spark):
    docs = docs_of(spark, [*CASES, (7, "another text of id 7")])
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in left.collect()]
    assert len(rows) == len({norm(t) for _, t in rows}) == len({norm(t) for _, t in CASES}) + 1
    assert (2, "a  b\tc\n") in rows and (7, "another text of id 7") in rows


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert exact_dedup.exact_groups(none).collect() == []
    assert simhash.near_groups(none).collect() == []
    assert exact_dedup.drop_exact_copies(none).collect() == []
    assert simhash.drop_near_copies(none).collect() == []


def test_fingerprints_compose():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(exact_dedup.CHUNK + 777))
    powers = exact_dedup._powers(exact_dedup.HASHES)
    whole = exact_dedup.fingerprints([data], powers)[0]
    for cut in (1, 1000, exact_dedup.CHUNK):
        a, b = exact_dedup.fingerprints([data[:cut], data[cut:]], powers)
        assert exact_dedup.combine(a, b) == whole
    for k, (prime, base) in enumerate(exact_dedup.HASHES):
        assert whole[1 + k] == sum(c * pow(base, i, prime) for i, c in enumerate(data)) % prime


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + n] for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(find(k), []).append(i)
    return sorted(
        (str(i), f"{fps[k]:016x}", str(min((x for x in low[find(k)] if x is not None), default=None)))
        for k, (i, _) in enumerate(rows)
    )


def near_texts(n, seed=1):
    """Texts with chains of small edits, copies, short and blank ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(150, 400))) for _ in range(8)]
    while len(texts) < n:
        w = rng.choice(texts).split()
        w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    return texts + ["", None, " \n", "one", "One", "one two", "a b c", "a b c d"]


def test_simhash_groups(spark):
    rows = [(i * 3 % 1009, t) for i, t in enumerate(near_texts(220))] + [(5000, "one"), (None, "one two")]
    got = simhash.near_groups(docs_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute_components(rows)


def test_bit_sliced_comparison():
    rng = np.random.default_rng(3)
    for longs, radius in ((1, 0), (1, 2), (1, 5), (4, 20), (4, 46)):
        fps = rng.integers(0, 2**63, (90, longs), dtype=np.uint64)
        fps = np.concatenate([fps, fps[:40] ^ (np.uint64(1) << rng.integers(0, 63, (40, longs), dtype=np.uint64))])
        for lo, hi in ((0, len(fps)), (17, 70)):
            i, j = simhash.near(fps, radius, lo, hi)
            want = {
                (a, b)
                for a in range(lo, hi)
                for b in range(a + 1, len(fps))
                if int(np.bitwise_count(fps[a] ^ fps[b]).sum()) <= radius
            }
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_every_near_pair_shares_a_bucket():
    masks = [m % (1 << 64) for m in simhash.block_masks()]
    rng = random.Random(4)
    assert all((~m % (1 << 64)).bit_count() == 16 for m in masks)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(a & m == b & m for m in masks)


def test_near_copy_stage(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choices(words, k=400) for _ in range(12)]
    rows, want = [], set()
    for g, b in enumerate(base):
        rows.append((100 * g, " ".join(b)))
        want.add(100 * g)
        for k in range(1, 5):
            w = list(b)
            for _ in range(4):
                w[rng.randrange(400)] = "edited"
            rows.append((100 * g + k, " ".join(w)))
    rows += [(9001, ""), (9002, None), (None, "no id at all here"), (9003, "short")]
    left = simhash.drop_near_copies(docs_of(spark, rows))
    got = {r.doc_id for r in left.collect()}
    assert left.columns == docs_of(spark, []).columns
    assert got == want | {9001, 9003, None}


def brute_kept(rows, similarity=0.8):
    """Indices of the rows that stay, by all pairs of the rows' shingle sets."""
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both / len(sets[i] | sets[j]) >= similarity:
                root[find(i)] = find(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        best.setdefault(find(k), []).append((i is None, i or 0, k))
    return {min(x)[2] for x in best.values()}


def similar_texts(seed, groups, copies, edits):
    """Texts of one base each with different words changed: similarity falls with edits."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(groups):
        b = rng.choices(words, k=200)
        for _ in range(copies):
            w = list(b)
            for _ in range(rng.choice(edits)):
                w[rng.randrange(200)] = rng.choice(words)
            texts.append(" ".join(w))
    return texts


def test_near_copies_are_verified(spark):
    """Pairs of similarity 0.6 to 0.95: all from 0.8 on link, none below, also with repeated shingles."""
    texts = similar_texts(7, 12, 8, (0, 2, 4, 6, 8))
    filler = " again and again and again" * 60
    texts += [f"{t}{filler}" for t in similar_texts(8, 3, 1, (0,))]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id for r in simhash.drop_near_copies(docs_of(spark, rows)).collect()}
    assert got == brute_kept(rows)


def test_near_copies_go_by_row(spark):
    """Null and repeated ids: a copy takes no unrelated row along, and copies of one id go too."""
    a, b, c, d, clean, other = similar_texts(9, 6, 1, (0,))
    rows = [
        (1, a), (None, a + " more"), (None, clean),
        (2, b), (3, a + " x"), (3, other),
        (4, c), (4, c + " y"),
        (None, d), (None, d + " z"),
    ]
    left = [(r.doc_id, r.text) for r in simhash.drop_near_copies(docs_of(spark, rows)).collect()]
    assert sorted(t for _, t in left if t not in (c, c + " y", d, d + " z")) == sorted([a, clean, b, other])
    assert [i for i, _ in left].count(4) == 1
    assert sum(t in (d, d + " z") for _, t in left) == 1
    assert len(left) == len(brute_kept(rows)) == 6


def test_cells_bound_a_hot_bucket(spark):
    """No cell holds a hot group whole, yet any two of its members meet in one."""
    rows = [(1, n, 0) for n in range(200)] + [(2, n, 0) for n in range(300, 305)] + [(3, 400, 0)]
    dealt = simhash.cells(spark.createDataFrame(rows, "group long, node long, size int"), 20).collect()
    held = {}
    for r in dealt:
        held.setdefault((r.t, r.key), set()).add(r.node)
    assert max(len(x) for x in held.values()) < 80
    met = {(a, b) for x in held.values() for a in x for b in x}
    assert all((a, b) in met for a in range(200) for b in range(200))
    assert (300, 304) in met and not any(400 in x for x in held.values())


@pytest.mark.parametrize("edits", [(0, 1), (0, 2, 4, 6, 8)])
def test_hot_template_in_blocks(spark, monkeypatch, edits):
    """A template of many copies, compared in blocks, gives what all pairs give."""
    monkeypatch.setattr(simhash, "BLOCK", 12)
    rows = list(enumerate(similar_texts(11, 2, 60, edits)))
    got = {r.doc_id for r in simhash.drop_near_copies(docs_of(spark, rows)).collect()}
    assert got == brute_kept(rows)


def test_exact_stage_keeps_the_row_that_the_groups_keep(spark, tmp_path):
    rows = [(1, "abc"), (1, "a b  c"), (2, "other"), (2, "ot her"), (2, None), (None, ""), (None, "abc"), (3, "alone")]
    want = sorted(["a b  c", "ot her", None, "alone"], key=str)
    made = docs_of(spark, rows)
    made.repartition(3).write.parquet(str(tmp_path / "d"))
    for docs in (made, spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "d")).where("true")):
        left = exact_dedup.drop_exact_copies(docs)
        assert sorted((r.text for r in left.collect()), key=str) == want and left.columns == docs.columns
        assert sorted((r.text for r in simhash.drop_near_copies(docs).collect()), key=str) == sorted({str(t): t for _, t in rows if t != ""}.values(), key=str)


def test_row_keys_of_files(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").alias("__row")).repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows, key = common.keyed(docs, "t")
    assert key == "__row_" and rows.columns == ["doc_id", "__row", "__row_"]
    first, again = ({r.doc_id: r[key] for r in x.collect()} for x in (rows, rows.select("doc_id", key).orderBy("doc_id")))
    assert first == again and len(set(first.values())) == 100
    assert common.without(rows, key, rows.where("doc_id < 90").select(key)).count() == 10
