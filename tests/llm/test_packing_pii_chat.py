"""Packing, pseudonyms, quotation linking, the pipeline, SQL twins on the smallest tables."""

import os
import random
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rosterproof.llm import chat, decontaminate, encoders, packing, pii, queries, simhash, toxicity
from rosterproof.llm.sample import is_held_out
from tests.llm.test_dedup import docs_of

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


def test_plan_covers_the_histogram():
    rng = random.Random(1)
    for _ in range(1500):
        capacity = rng.choice([10, 30, 64])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        placed = Counter()
        for content, times in packing.plan(counts, capacity):
            assert times > 0 and sum(n * k for n, k in content) <= capacity
            for n, k in content:
                placed[n] += k * times
        assert placed == Counter(counts)


def test_large_items_pair_as_well_as_any_matching():
    rng = random.Random(2)
    for _ in range(300):
        items = [rng.randint(35, 100) for _ in range(rng.randint(1, 9))]

        def fewest(left):
            if not left:
                return 0
            first, rest = left[0], left[1:]
            best = 1 + fewest(rest)
            for k, x in enumerate(rest):
                if first + x <= 100:
                    best = min(best, 1 + fewest(rest[:k] + rest[k + 1 :]))
            return best

        got = sum(times for _, times in packing.plan(Counter(items), 100))
        assert got == fewest(tuple(items))


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKETS", 3)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["a", "bb", "Ccc.", "ddddd"], k=rng.randint(0, 90)))) for i in range(300)]
    rows += [(None, None), (500, ""), (7, rows[7][1]), (501, "word " * 1000)] + [(600 + i, "same text") for i in range(50)]
    docs = docs_of(spark, rows)
    got = packing.pack_documents(docs, 64).collect()
    encode = encoders.WordEncoder()
    want = Counter()
    for i, t in rows:
        ids = [*np.frombuffer(encode((t or "").encode()), "<u4").tolist(), 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    least = -(-sum(n for parts in bins.values() for _, n in parts) // 64)
    assert least <= len(bins) <= least * 1.05 + 1
    packed = packing.sequences(docs, 64).collect()
    assert Counter(x for r in packed for x in r.ids) == Counter(
        x for _, t in rows for x in [*np.frombuffer(encode((t or "").encode()), "<u4").tolist(), 1]
    )
    assert packing.pack_documents(docs_of(spark, [])).collect() == []


# Pseudonyms

VALUES = [
    ("card", "4111 1111 1111 1111"),
    ("card", "378282246310005"),
    ("iban", "DE89370400440532013000"),
    ("iban", "GB82WEST12345698765432"),
    ("phone", "+1 (743) 555-3824"),
    ("ip", "192.168.10.7"),
    ("date", "2020-02-29"),
    ("date", "29.02.2020"),
    ("date", "12/25/1999"),
    ("ssn", "123-45-6789"),
    ("email", "Jo.Doe9@mail2.example.com"),
    ("hex", "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"),
]
LEFT_ALONE = [
    "4111111111111112", "300.1.1.1", "2021-02-29", "666-45-6789", "DE89370400440532013001",
    "version 1.2.3.4.5", "31/02/2020", "12345", "",
]


def shape(s):
    return "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s)


@pytest.mark.parametrize("kind,value", VALUES)
def test_pseudonyms(kind, value):
    names = pii.Pseudonyms(b"key")
    text, found = pii.pseudonymised(f"see {value}, and {value}.", names)
    assert [f[0] for f in found] == [kind, kind]
    new = text[found[0][1] : found[0][2]]
    assert text == f"see {new}, and {new}." and new != value
    if kind != "hex":
        assert shape(new) == shape(value)
    # What comes out is valid again, and another key gives something else.
    assert pii.pseudonymised(new, names)[1] == [(kind, 0, len(new))]
    assert pii.Pseudonyms(b"other")(kind, value) != new


@pytest.mark.parametrize("text", LEFT_ALONE)
def test_invalid_values_stay(text):
    assert pii.pseudonymised(text, pii.Pseudonyms(b"key")) == (text, [])


def test_permutations_lose_nothing():
    names = pii.Pseudonyms(b"key")
    days = [date(1900, 1, 1) + timedelta(n) for n in range(36524)]
    assert sorted(names("date", d.isoformat()) for d in days) == [d.isoformat() for d in days]
    same_day = {names("date", f"{d:%d.%m.%Y}") == date.fromisoformat(names("date", d.isoformat())).strftime("%d.%m.%Y") for d in days[:500]}
    assert same_day == {True}
    ips = [f"1.2.3.{n}" for n in range(10)] + [f"1.2.{n}.3" for n in (0, 1, 2, 4, 5)]
    assert len({names("ip", v) for v in ips}) == len(set(ips))
    cards = [str(n) for n in range(4000000000000, 4000000003000) if pii.luhn(str(n))]
    out = {names("card", c) for c in cards}
    assert len(out) == len(cards) and all(map(pii.luhn, out))


def test_pseudonym_rows(spark):
    rows = [(1, "card 4111111111111111 end"), (2, "again 4111111111111111"), (3, None), (4, ""), (4, "none")]
    got = {(r.doc_id, r.text): len(r.found) for r in pii.with_pseudonyms(docs_of(spark, rows), b"k").collect()}
    new = pii.Pseudonyms(b"k")("card", "4111111111111111")
    assert got == {(1, f"card {new} end"): 1, (2, f"again {new}"): 1, (3, None): 0, (4, ""): 0, (4, "none"): 0}
    assert pii.with_pseudonyms(docs_of(spark, []), b"k").collect() == []


# Quotation linking

CHAT = [
    (1, 0, "user", "How do I read a file?\nIt is large."),
    (1, 1, "assistant", "Use open().\n\nOr pathlib, which is nicer."),
    (1, 2, "user", "> Use  OPEN().\nThat failed."),
    (1, 3, "assistant", "> > Use open().\n> That failed.\n\nWhy?\n"),
    (1, 4, "user", "> How do I read a file?\n> It is large.\nsecond question"),
    (1, 5, "user", ">> nobody said this\n>nor this\nplain"),
    (1, 6, "user", "> Or pathlib, which is nicer.\n> \n> Use open()."),
    (1, 7, None, None),
    (1, 7, None, None),
    (1, None, "user", "> no turn"),
    (2, 0, "user", ">"),
    (2, 1, "user", ""),
    (2, 2, "user", "> > > deep\r\n> > less\r> one"),
    (None, 0, "user", "hello there"),
    (None, 1, "user", "> hello there\nhi"),
    (4, 0, "user", "first line\nsecond line\nthird line\nfourth line"),
    (4, 1, "user", "> second line\n> THIRD  line\nsome lines of a paragraph"),
    (4, 2, "user", "> first line\n> third line\nnot one after another"),
    (4, 3, "user", "> second line\n> third line\n> fourth line\nthree lines, > inside"),
    (4, 4, "user", "x\nsecond line\nthird line\nx\n\nsecond line"),
    (4, 5, "user", "> third line\n> x\n\n> not said\n> at all"),
    (4, 6, "user", "> > second line\n> > third line\n> some lines of a paragraph"),
    (4, 7, "user", "> second line\n> third line\n> x\n> second line"),
    (4, None, "user", "> second line\n> third line"),
    (5, 0, "user", "second line\nthird line\nzeroth line"),
    (5, 1, "user", "> third line\n> zeroth line"),
    *[(6, t, "user", "\n".join(f"w{i * i % (t + 5)}" for i in range(40)) if t % 2 else
       "\n".join(f"> w{i * i % (t + 4)}" for i in range(t, t + 3 + t % 11))) for t in range(30)],
    *[(3, t, "user", f"line {t}" if t % 3 else f"> line {max(0, t - 1)}\nanswer {t}") for t in range(150)],
]


def brute_chat(rows):
    """Reply target of each message, by walking the lines."""
    norm = lambda s: " ".join(s.lower().replace("\r", "\n").split())
    parsed = []
    for conv, turn, role, text in rows:
        text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
        own, passages, last = [], [], None
        quotes = any(x.lstrip(" \t").startswith(">") for x in text.split("\n"))
        for line in text.split("\n"):
            body, level = line, 0
            while body.lstrip(" \t").startswith(">"):
                body, level = body.lstrip(" \t")[1:], level + 1
            if level:
                body = body.lstrip(" \t")
            if level == 0:
                own.append(body)
            if not norm(body):
                last = None
            elif level and last == level:
                passages[-1][1].append(body)
            elif level:
                passages.append((level, [body]))
            if norm(body):
                last = level
        if quotes:
            while own and not own[0].strip(" \t"):
                own.pop(0)
            while own and not own[-1].strip(" \t"):
                own.pop()
        parsed.append((conv, turn, role or "unknown", "\n".join(own), passages))
    first = {}
    for conv, turn, _, own, _ in parsed:
        if turn is None:
            continue
        paragraphs, current = [], []
        for line in own.split("\n"):
            if line.strip(" \t"):
                current.append(line)
            else:
                paragraphs.append("\n".join(current))
                current = []
        for part in [own, *own.split("\n"), *paragraphs, "\n".join(current)]:
            if norm(part):
                key = (conv, norm(part))
                first[key] = min(first.get(key, turn), turn)
    lines = [(conv, turn, [norm(x) for x in own.split("\n")]) for conv, turn, _, own, _ in parsed]

    def origin(conv, turn, body):
        whole = first.get((conv, norm("\n".join(body))))
        if turn is None or (whole is not None and whole < turn):
            return whole
        said = [norm(x) for x in body]
        return min(
            (
                t for c, t, own in lines
                if c == conv and t is not None and len(said) > 1
                and any(own[i : i + len(said)] == said for i in range(len(own)))
            ),
            default=None,
        )

    out = []
    for conv, turn, role, own, passages in parsed:
        came = [origin(conv, turn, b) for level, b in passages if level == 1]
        came = [c for c in came if c is not None and turn is not None and c < turn]
        out.append((str(conv), str(turn), role, own, str(max(came, default=None))))
    return sorted(out)


def test_quotation_links(spark):
    table = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    got = chat.ordered_messages(table.withColumn("own", table.turn).withColumn("key", table.turn)).collect()
    assert sorted((str(r.conv_id), str(r.turn), r.role, r.own, str(r.reply_to)) for r in got) == brute_chat(CHAT)
    by = {(r.conv_id, r.turn): r for r in got}
    partial = {t: by[4, t].reply_to for t in range(1, 8)}
    assert partial == {1: 0, 2: None, 3: 0, 4: None, 5: 4, 6: 1, 7: None} and by[5, 1].reply_to == 0
    assert by[1, 2].reply_to == 1 and by[1, 4].reply_to == 0 and by[1, 3].reply_to == 2
    for conv in {r.conv_id for r in got}:
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine)))
        assert [(r.thread is not None, r.thread, r.turn) for r in mine] == sorted(
            ((r.thread is not None, r.thread, r.turn) for r in mine), key=lambda x: (x[0], x[1] or 0, x[2] or 0)
        )
        place = {r.turn: r.position for r in mine}
        assert all(place[r.reply_to] < r.position for r in mine if r.reply_to is not None)


def compare(spark_rows, cursor):
    names = [d[0] for d in cursor.description]
    want = Counter(tuple(r) for r in cursor.fetchall())
    got = Counter(tuple(r[n] for n in names) for r in spark_rows)
    assert got == want


def test_chat_sql_twin(spark, tmp_path):
    table = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    table.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    compare(chat.chat_segments(table).collect(), con.execute(chat.SQL))


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_segments(none).collect() == []


# Registration and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    compare(entry.queries()[name](spark, SF).collect(), con.execute(entry.oracle_sql()[name]))


def test_all_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_pipeline_against_brute_force(spark):
    """Each stage redone in plain Python on the rows the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF))
    texts = [{r.doc_id: r.text for r in d.collect()} for d in steps[:5]]
    assert all(d.columns == docs.columns for d in steps[:5])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_documents(docs, labels, ~is_held_out(F.col("doc_id"), 5, 0))
    words = toxicity._Words()
    assert set(texts[1]) == {
        i for i, t in texts[0].items() if toxicity.judge(model, t, words)[0] < 0.5
    }
    assert len(texts[1]) > 0.85 * len(texts[0])
    norm = lambda t: "".join((t or "").split())
    best = {}
    for i, t in texts[1].items():
        k = norm(t)
        if k not in best or (-len(t), i) < (-len(texts[1][best[k]]), best[k]):
            best[k] = i
    assert set(texts[2]) == set(best.values())
    shingles = {i: set(simhash.shingle_hashes(t.encode(), 5)) for i, t in texts[2].items()}

    def alike(a, b):
        return len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))

    kept = sorted(texts[3])
    assert all(alike(a, b) < 0.9 for k, a in enumerate(kept) for b in kept[:k])
    for gone in set(texts[2]) - set(kept):
        assert max(alike(gone, b) for b in texts[2] if b != gone) > 0.6
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, t in texts[3].items():
        if any(x in decontaminate.normalise(t) for x in items):
            assert i not in texts[4]
        elif i not in texts[4]:
            assert decontaminate.Matcher([(0, x) for x in items]).find(t)
    packed = steps[5].collect()
    encode = encoders.WordEncoder()
    assert {r.doc_id for r in packed} == set(texts[4])
    assert sum(r.length for r in packed) == sum(len(encode(t.encode())) // 4 + 1 for t in texts[4].values())


def test_pipeline_run(spark):
    got = entry.queries()["pipeline"](spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 50


def test_a_day_has_one_pseudonym_however_it_is_spelled():
    names = pii.Pseudonyms(b"key")
    seen = {}
    day = date(2000, 1, 1)
    while day.year < 2100:
        d = f"{day.day:02d}", f"{day.month:02d}", f"{day.year}"
        spelled = [day.isoformat(), "/".join(d), ".".join(d)]
        if day.day > 12:
            spelled.append(f"{d[1]}/{d[0]}/{d[2]}")
        got = {names("date", x) for x in spelled}
        new = date.fromisoformat(names("date", day.isoformat()))
        n = f"{new.day:02d}", f"{new.month:02d}", f"{new.year}"
        want = {new.isoformat(), "/".join(n), ".".join(n)} | ({f"{n[1]}/{n[0]}/{n[2]}"} if day.day > 12 else set())
        assert got == want and (new.day > 12) == (day.day > 12)
        seen[day] = new
        day += timedelta(days=7 if day.year % 10 else 1)
    assert len(set(seen.values())) == len(seen)


def test_hex_pseudonyms_are_hex_secrets_again():
    names = pii.Pseudonyms(b"key")
    rng = random.Random(9)
    for _ in range(3000):
        value = "".join(rng.choices("0123456789ab", weights=[9] * 10 + [1, 1], k=32))
        new = names("hex", value)
        assert (new is None) == (value.isdigit() or value.isalpha())
        if new is not None:
            assert len(new) == 32 and new != value and not new.isdigit() and not new.isalpha()
