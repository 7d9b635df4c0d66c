"""Merkle manifest, source mixing and prefix trie against plain versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rosterproof.llm import merkle, mixing, ordering, prefix_trie, queries
from rosterproof.llm.common import sql_crc32, staged

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, position string, tree string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def crc(number):
    return zlib.crc32(str(number).encode())


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_prefix_trie"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = Counter(tuple(sorted(zip(columns, r, strict=True))) for r in found.fetchall())
    got = Counter(tuple(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, SF).collect())
    assert got == want and sum(got.values()) > 5


def test_sql_crc32():
    for v in (0, 7, -12, 10**15):
        assert duckdb.sql(f"select {sql_crc32(f'({v})::varchar')}").fetchall() == [(crc(v),)]


def test_numbered(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), "id").repartition(7)
    got = ordering.numbered(staged(rows, "t"), [F.desc("k"), F.asc("id")], "t").collect()
    want = sorted((-(i % 3), i) for i in range(5000))
    assert [(-r.k, r.id) for r in sorted(got, key=lambda r: r.position)] == want
    assert sorted(r.position for r in got) == list(range(5000))


def plain_manifest(rows):
    """Rows of (doc_id, text, lang, source, n_chars) -> result rows, level by level."""

    def leaf(doc_id, text, lang, source, n_chars):
        fields = [doc_id, source, lang, n_chars, text]
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    def climb(nodes, index, mine):
        """Root of nodes, what index meets and where ``mine`` put in its place leads."""
        met = []
        while len(nodes) > 1:
            pair = nodes[index // 2 * 2 : index // 2 * 2 + 2]
            other = [x for k, x in enumerate(pair) if k != index % 2]
            mine = sha(*([mine, *other] if index % 2 == 0 else [*other, mine]))
            met += other
            nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            index //= 2
        return nodes[0], met, mine

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(((r[0] is not None, r[0] or 0), leaf(*r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subroots = []
    for lang in order:
        langs[lang].sort(key=lambda x: x[:2])
        subroots.append(climb([x[1] for x in langs[lang]], 0, "")[0])
    out = []
    for k, lang in enumerate(order):
        nodes = [x[1] for x in langs[lang]]
        for i, (_, own, (doc_id, text, _, source, n_chars)) in enumerate(langs[lang]):
            start = own
            if doc_id is not None and crc(doc_id) % 7 == 0 and n_chars is not None:
                start = leaf(doc_id, text, lang, source, n_chars + 1)
            subroot, met, folded = climb(nodes, i, start)
            root, more, folded = climb(subroots, k, folded)
            out.append((doc_id, own, subroot, root, sha(*met, *more), folded, folded == root))
    return Counter(out)


def manifest_rows(n, langs):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "ä€𝄞 \n" * rng.randint(1, 9), "x" * rng.randint(1, 50)])
        rows.append((i * 3, text, rng.choice(langs), rng.choice([None, "", "s1"]), rng.choice([None, 5, -1, 2**63 - 1])))
    rows += [(None, "no id", langs[0], None, 3), (None, None, None, None, None)]
    rows += [(7, "same", langs[-1], "s", 4)] * 9 + [(7, "other", langs[-1], "s", 4)]
    return rows


def manifest_of(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS).repartition(5)
    return Counter(tuple(r) for r in merkle.manifest(docs).collect())


@pytest.mark.parametrize("round_levels, step", [(2, 1), (3, 2), (12, 4)])
def test_manifest(spark, monkeypatch, round_levels, step):
    monkeypatch.setattr(merkle, "ROUND", round_levels)
    monkeypatch.setattr(merkle, "STEP", step)
    rows = manifest_rows(70, ["en", None, "é", "zz", "a", "ab"])
    got = manifest_of(spark, rows)
    assert got == plain_manifest(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_few_rows(spark):
    assert not manifest_of(spark, [])
    one = [(7, "t" * 3_000_000, None, None, 1)]
    assert manifest_of(spark, one) == plain_manifest(one)
    languages = [(i, str(i), f"l{i}", "s", 1) for i in range(5)]
    assert manifest_of(spark, languages) == plain_manifest(languages)


MIX = "doc_id long, text string, source string, size string, row int, start int, up string"


def mix_of(spark, rows, parts=3, seed="0"):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], MIX).repartition(parts)
    return mixing.mixed(docs, seed).collect()


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free, target, rest = set(order), {}, sum(sizes.values())
    while free:
        share = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("block", [2, 12])
def test_mixing(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(4)
    rows = [(None, None, None), (1, "", "a"), (1, " \t\n", "a"), (2, "a\x0bb\x0cc d\x1ce", "a"), (3, "", "empty")]
    rows += [(9, "same words here", "hot")] * 150
    rows += [(i, "w " * rng.randint(0, 60), rng.choice(["a", "é", "b", "hot", None, "z", ""])) for i in range(100, 700)]
    rows += [(5000, "lonely", "tiny"), (5001, "long " * 3_000, "larger")]
    got = mix_of(spark, rows)

    def count(text):
        return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))

    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, count(t)) for d, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want, taken, largest = plain_targets(sizes), Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        times = r.target / r.source_size if r.source_size else 0
        assert int(times) <= r.copies <= int(times) + 1 <= 4 and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 0.01
    again = mix_of(spark, rows[::-1], 11)
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert Counter(map(tuple, mix_of(spark, rows, 3, "1"))) != Counter(map(tuple, got))
    assert mix_of(spark, []) == []


def test_mixing_of_a_very_long_text(spark):
    got = mix_of(spark, [(1, "word \n" * 1_000_000, "b"), (2, "word " * 1000, "a")])
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 1_000_000, 998_000.0, 1_000_000), (2, 1000, 3000.0, 3000)}


def test_pivot_keeps_sums_and_expectations():
    rng = random.Random(5)
    fulls = [rng.randint(1, 50) for _ in range(12)]
    begin = [rng.randint(0, f) for f in fulls]
    sums, runs = [0] * 12, 20000
    for _ in range(runs):
        masses = begin[:]
        left = mixing.pivot(masses, fulls, [rng.getrandbits(64) for _ in fulls])
        assert sum(masses) == sum(begin)
        assert [i for i, m in enumerate(masses) if 0 < m < fulls[i]] == ([] if left is None else [left])
        sums = [a + b for a, b in zip(sums, masses, strict=True)]
    for f, m, s in zip(fulls, begin, sums, strict=True):
        assert abs(s / runs - m) < 0.02 * f + 1e-9


TALK = "conv_id long, turn long, role string, text string, node int, conv string, at string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = crc(c) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        size = len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * size
    return Counter(
        (
            min(who),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(who),
            children[node],
            leaves[node],
            saved[node],
            sha(",".join(map(str, sorted(ends[node])))),
        )
        for node, who in members.items()
    )


def trie_of(spark, rows):
    talk = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TALK).repartition(4)
    return Counter(tuple(r) for r in prefix_trie.prefix_trie(talk).collect())


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rng = random.Random(6)
    rows = []
    for c in range(60):
        for t in range(rng.choice([1, 2, 5, 9, 12])):
            # Few texts, so sequences fork at any depth; long runs of the same turn.
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["a", "a", "ä€", "", None])))
    rows += [(c, t, "user", "everybody says this") for c in range(100, 160) for t in range(3)]
    rows += [(200, None, "x", "first"), (200, 0, "x", "second"), (201, 1, "x", "y"), (201, 1, "x", "y"), (201, 1, "x", "z")]
    rows += [(300, t, "user", f"turn {t}") for t in range(70)] + [(304, t, "user", f"turn {t % 66}") for t in range(70)]
    rows += [(None, 0, "user", "no conversation"), (401, 0, "u", "long " * 400_000)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_without_turns(spark):
    assert not trie_of(spark, [])
    # crc32("3") % 9 is over 0 and conversation 0 is missing, so no turn is left.
    bare = next(c for c in range(1, 5) if crc(c) % 9)
    rows = [(bare, 0, "u", "t")]
    got = trie_of(spark, rows)
    assert got == plain_trie(rows) == Counter({(bare, 0, None, 1, 0, 1, 0, sha(str(bare))): 1})
