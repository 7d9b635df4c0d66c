"""Decontamination, language model, token counts, classifiers."""

import functools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterproof.llm import ctw, decontaminate, encoders, lm, quality, token_counts, toxicity
from rosterproof.llm.sample import is_held_out, labelled_features
from tests.llm.test_dedup import docs_of

ITEM = "The quick brown fox jumps over the lazy dog and then it runs far away from the hungry wolves."


def edited(text, n, rng):
    s = list(text)
    for _ in range(n):
        k = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[k] = "#"
        elif kind == 1:
            s.insert(k, "#")
        else:
            del s[k]
    return "".join(s)


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choices("abc", k=rng.randint(1, 40)))
        t = "".join(rng.choices("abc", k=rng.randint(0, 60)))
        d = brute_distance(p, t)
        got = decontaminate.myers(p, t, 40)
        assert (got[0] if got else len(p)) == d


def test_leaks(spark):
    rng = random.Random(2)
    budget = len(decontaminate.normalise(ITEM)) // decontaminate.CHARS_PER_EDIT
    long_item = " ".join(f"part{i}of{i * i}" for i in range(600))
    rows = [(1, "before " + ITEM.upper() + " after"), (2, "clean text"), (3, None), (4, "")]
    rows += [(10 + k, "x " + edited(ITEM, budget, rng) + " y") for k in range(30)]
    rows += [(50, "yes"), (51, "yes indeed"), (60, "start " + long_item[-3000:]), (61, long_item[5000:5900]), (62, "a " + long_item + " b")]
    items = [(7, ITEM), (8, "yes"), (9, ""), (10, None), (11, long_item), (7, ITEM)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 7), *((10 + k, 7) for k in range(30)), (50, 8), (51, 8), (62, 11)}
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {2, 3, 4, 60, 61}
    for r in decontaminate.leaks(docs, bench).where("item_id = 7").collect():
        text = decontaminate.normalise(dict(rows)[r.doc_id])
        assert r.distance == brute_distance(decontaminate.normalise(ITEM), text) <= budget


def test_leaks_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join("".join(rng.choices("abcdef", k=7)) for _ in range(12))) for i in range(40)]
    docs = docs_of(spark, [(i, "in front " + t + " behind") for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    few = decontaminate.blocks(bench, 700)
    assert len(list(few)) > 3
    whole = sorted(decontaminate.leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (700,))
    assert sorted(decontaminate.leaks(docs, bench).collect()) == whole
    assert {(r.doc_id, r.item_id) for r in whole} == {(i, i) for i, _ in items}


def test_no_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, [(1, "text")])
    assert decontaminate.leaks(docs, none).collect() == []
    assert decontaminate.drop_leaks(docs, none).count() == 1
    full = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.leaks(docs_of(spark, []), full).collect() == []


# Language model


def brute_ctw(train, queries, depth):
    """log10 probabilities straight from the definition."""
    data = []
    for t in train:
        s = b"\n" * depth + t + b"\n"
        data += [(s[i - depth : i], s[i]) for i in range(depth, len(s))]

    def kt(z, o):
        return (
            math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
        )

    @functools.lru_cache(None)
    def counts(context, prefix):
        n = [0, 0]
        for c, x in data:
            if c.endswith(context) and format(x, "08b").startswith(prefix):
                n[int(format(x, "08b")[len(prefix)])] += 1
        return tuple(n)

    @functools.lru_cache(None)
    def weighted(context, prefix):
        n = counts(context, prefix)
        if sum(n) == 0:
            return 0.0
        if len(context) == depth:
            return kt(*n)
        return np.logaddexp(kt(*n), children(context, prefix)) - math.log(2)

    def children(context, prefix):
        older = {c[depth - len(context) - 1 : depth - len(context)] for c, _ in data}
        return sum(weighted(b + context, prefix) for b in older)

    out = []
    for q in queries:
        s = b"\n" * depth + q + b"\n"
        total = 0.0
        for i in range(depth, len(s)):
            bits = format(s[i], "08b")
            for j in range(8):
                p = None
                for d in range(depth, -1, -1):
                    context = s[i - d : i]
                    n = counts(context, bits[:j])
                    own = (n[int(bits[j])] + 0.5) / (sum(n) + 1)
                    if d == depth:
                        p = own
                    else:
                        w = 1 / (1 + math.exp(children(context, bits[:j]) - kt(*n)))
                        p = w * own + (1 - w) * p
                total += math.log10(p)
        out.append(total)
    return out


TEXTS = [
    (1, "Abracadabra the cat"),
    (2, "the  cat\tsat"),
    (3, None),
    (4, ""),
    (5, "the dog, THE dog"),
    (6, "unseen wörds zz"),
    (7, "the cat sat on it"),
    (7, "the cat sat on it"),
    (None, "the end"),
]


@pytest.mark.parametrize("shard", [lm.SHARD, 20])
def test_lm_scores(spark, shard):
    """Against brute force, in one shard and in several."""
    train = ~is_held_out(F.col("doc_id"), 5, 1)
    got = lm.scores(docs_of(spark, TEXTS), train, 3, shard).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in TEXTS}
    words = {k: (t or "").encode().lower().split() for k, (_, t) in enumerate(TEXTS)}
    learn = [words[k] for k, (i, _) in enumerate(TEXTS) if not held[i]]
    assert 0 < len(learn) < len(TEXTS)
    count = {}
    for ws in learn:
        for w in [*ws, None]:
            count[w] = count.get(w, 0) + 1
    total = sum(count.values())

    def base(ws):
        return sum(
            math.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (len(count) + 1))) for w in [*ws, None]
        )

    model = brute_ctw([b" ".join(ws) for ws in learn], [b" ".join(words[k]) for k in words], 3)
    want = sorted(
        (str(i), len(words[k]) + 1, sum(w in count for w in [*words[k], None]), total, base(words[k]), model[k])
        for k, (i, _) in enumerate(TEXTS)
    )
    rows = sorted(
        (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got
    )
    for a, b in zip(rows, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-5)


def test_lm_probabilities_sum_to_one():
    texts = [b"abcabc", b"abd"]
    codes, _ = ctw.grams(texts, 2)
    contexts = np.unique(codes >> np.uint64(8))
    asked = ((contexts[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)).ravel()
    keys = np.unique(np.concatenate([asked, codes]))
    seen, n = np.unique(codes, return_counts=True)
    counts = np.zeros(len(keys))
    counts[np.searchsorted(keys, seen)] = n
    p = 10 ** ctw.table(keys, counts, 2)
    sums = [p[(keys >> np.uint64(8)) == c].sum() for c in contexts]
    assert sums == pytest.approx([1.0] * len(contexts))


def test_lm_nothing(spark):
    train = ~is_held_out(F.col("doc_id"), 5, 1)
    assert lm.scores(docs_of(spark, []), train).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.scores(docs_of(spark, [(held, "ab")]), train).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0)
    assert r.score == pytest.approx(-3 * 8 * math.log10(2), rel=1e-6)


# Token counts


def test_token_counts(spark, monkeypatch):
    rng = random.Random(5)
    words = ["alpha", "Beta,", "γάμμα", "!", "12345", "\n"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(200)]
    rows += [(None, None), (1000, ""), (1001, "word " * 30_000)]
    encoding = encoders.rank_encoding()
    lengths = sorted(len(encoding.encode_ordinary(t or "")) for _, t in rows)
    hist = token_counts.histogram(token_counts.encoded_lengths(docs_of(spark, rows)))
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    sums = token_counts.suffix_sums(hist)
    for r in sums.collect():
        n = r.n_tokens
        assert r.docs == lengths.count(n) and r.tokens == n * r.docs
        assert r.docs_from == sum(x >= n for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= n)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.rank_share == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits, shares = [0, 1, 7, 50, 10**6], [0.0, 0.25, 0.5, 0.99, 1.0]
    for question, at, answer in token_counts.answers(sums, limits, shares).collect():
        if question == "truncated":
            assert answer == sum(min(x, at) for x in lengths)
        elif question == "reaching":
            assert answer == sum(x >= at for x in lengths)
        else:
            assert answer == min(x for x in lengths if sum(y <= x for y in lengths) >= at * len(lengths))


def test_token_counts_empty(spark):
    hist = token_counts.histogram(token_counts.encoded_lengths(docs_of(spark, [])))
    assert token_counts.suffix_sums(hist).collect() == []


def test_word_encoder_equals_the_tokenizer():
    rng = random.Random(8)
    encode = encoders.WordEncoder(limit=300)
    alphabet = "aZéÉßÿŸŁŉIJŐ.,!'<|>~`^_-0%&*İıKÅﬁ中Σσ́̌\t\n\x0b　  "
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(1500)]
    texts += ["<|endoftext|> a<|startoftext|>b", "it's WE'LL 'S", "x" * 5000, "J̌ ǰ"]
    for t in texts:
        want = encode.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == want, t


# Classifiers


def labelled(spark, n=600):
    """Toxic documents have one bad sentence; bad ones of quality are symbols."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(2, 12))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            sentences[rng.randrange(len(sentences))] += " vile " + rng.choice(words)
        text = ". ".join(sentences)
        rows.append((i, text if good else text.replace(" ", " ## @@ ")))
        labels.append((i, int(good), int(toxic)))
    rows += [(9000, None), (9001, ""), (None, "some words"), (9002, "word1 " * 300_000)]
    labels += [(9000, None, None), (None, 1, 1), (77, 1, 5), (123456, 1, 0)]
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(rows)


def test_toxicity(spark):
    docs, labels, texts = labelled(spark)
    model = toxicity.fit_documents(docs, labels, ~is_held_out(F.col("doc_id"), 5, 0))
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is not None and r.doc_id < 9000:
            bad = "vile" in texts[r.doc_id]
            assert (r.score >= 0.5) == bad
            sentences = texts[r.doc_id].split(".")
            assert all("vile" in sentences[k] for k in r.offending)
            assert bool(r.offending) == bad
    scores = {r.doc_id: r.score for r in rows}
    assert scores[9000] == scores[9001] == pytest.approx(model.leak) and 0 <= scores[9002] <= 1
    assert model.leak < 0.1
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i in texts if scores[i] < 0.5}


def test_quality(spark):
    docs, labels, texts = labelled(spark)
    model = quality.fit_documents(docs, labels, ~is_held_out(F.col("doc_id"), 4, 2))
    rows = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert len(rows) == len(texts) and all(0 <= s <= 1 for s in rows.values())
    right = sum((rows[i] >= 0.7) == (i % 3 != 0) for i in range(600))
    assert right >= 590


def test_votes_are_exact_cosines():
    rng = random.Random(10)
    texts = ["".join(rng.choices("abcdef ", k=rng.randint(5, 200))).encode() for _ in range(300)]
    sample = [(quality.encode(t.decode()), k % 2) for k, t in enumerate(texts[:200])]
    held = sum((quality.counts([t]) > 0)[0] for t in texts)
    model = quality.fit(sample, (len(texts), held))
    assert np.allclose(model.idf, np.log((len(texts) + 1) / (held + 1)))
    got = model.score(quality.counts(texts))
    for k in range(200, 300):
        v = model.latent(quality.counts([texts[k]]))[0].astype(float)
        cos = model.vectors.astype(float) @ v
        near = np.argsort(-cos)[: quality.NEIGHBOURS]
        weight = np.maximum(cos[near], 0) ** quality.SHARPNESS
        assert got[k] == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=1e-3)


def test_classifiers_without_labels(spark):
    docs = docs_of(spark, [(1, "text"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    train = ~is_held_out(F.col("doc_id"), 5, 0)
    assert [r.score for r in toxicity.scored(docs, toxicity.fit_documents(docs, labels, train)).collect()] == [0, 0]
    assert [r.score for r in quality.scored(docs, quality.fit_documents(docs, labels, train)).collect()] == [0.5, 0.5]
    empty = docs_of(spark, [])
    assert toxicity.scored(empty, toxicity.fit([])).collect() == []
    assert quality.scored(empty, quality.fit([], quality.document_frequencies(empty))).collect() == []


def test_text_parts_keep_sentences():
    text = "one two. " * 50 + "no end here" * 40
    for size in (1, 10, 100, 10**6):
        parts = [p for _, p in toxicity.text_parts(text, size)]
        assert "".join(parts) == text
        words = toxicity._Words()
        together = np.concatenate([toxicity.features(p, words) for p in parts])
        assert together.tolist() == toxicity.features(text, words).tolist()


def test_sample_leaves_out_copies_only():
    """A passage that many documents share makes none of them a copy; real near copies go."""
    rng = random.Random(12)
    passage = "all rights of this page are reserved by the owner. "
    own = [" ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for _ in range(80)]
    texts = [passage + t for t in own] + [passage + t + " end" for t in own[:10]] + ["", "", "a b", "a b", "a c"]
    sample = toxicity._Sample([(toxicity.encode(t), k % 2) for k, t in enumerate(texts)])
    assert len(sample.y) == 80 + 3


def test_sample_skips_what_is_over_budget(spark):
    docs = docs_of(spark, [(i, "x" * (5000 if i % 10 == 0 else 10)) for i in range(100)])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    found = labelled_features(docs, labels, "toxic", F.lit(True), 100, 4000, str.encode)
    assert [len(x) for x, _ in found] == [10] * 90


def test_document_frequencies_cover_all_documents(spark):
    texts = ["abc abc", "abcd", "", None, "zz", "x" * 100_000, "abc abc"]
    docs = docs_of(spark, list(enumerate(texts))).repartition(3)
    n, held = quality.document_frequencies(docs)
    want = sum((quality.counts([(t or "").encode()]) > 0)[0].astype(int) for t in texts)
    assert n == len(texts) and held.tolist() == want.tolist()


def test_latent_directions_are_those_of_the_svd():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, 6).tolist()) for _ in range(40)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 8, 30) + 8 * (k % 4)) for k in range(120)]
    held = (quality.counts(texts) > 0).sum(0)
    model = quality.fit([(quality.encode(t.decode()), k % 2) for k, t in enumerate(texts)], (len(texts), held))
    m = quality.unit(np.log1p(quality.counts(texts)) * model.idf)
    _, sizes, right = np.linalg.svd(m, full_matrices=False)
    strong = int((sizes > 0.2 * sizes[0]).sum())
    assert 0 < strong <= quality.RANK
    # The strong singular vectors lie in the space of the directions.
    inside = np.linalg.norm(right[:strong] @ model.directions, axis=1)
    assert inside.min() > 0.999


@pytest.mark.parametrize("gap", [" ", "\n", "\t \n", "\u3000 "])
def test_long_white_space_is_counted_as_the_tokenizer_does(monkeypatch, gap):
    encoding = encoders.rank_encoding()
    for pattern in ("{}", "word{}", "{}word", "a{}b{}1 c{}!", "a\x1f{}\x1fb"):
        text = pattern.replace("{}", gap * 700)
        want = len(encoding.encode_ordinary(text))
        monkeypatch.setattr(encoders, "LONG_RUN", 50)
        monkeypatch.setattr(encoders, "_RUN", re.compile(encoders._RUN.pattern.replace("65536", "50")))
        assert encoders.rank_count(encoding, text) == want
        monkeypatch.undo()
    for n in (1_000_000, 5_000_000):
        assert encoders.rank_count(encoding, "a" + " " * n + "b") == encoders.rank_count(encoding, "a" + " " * 100_000 + "b") + n - 100_000


def test_short_and_long_passages():
    long = " ".join(f"word{i}" for i in range(900))
    m = decontaminate.Matcher([(1, "short one"), (2, long), (3, "x"), (4, "  "), (5, "")])
    assert m.find("a Short  one here") == [(1, 0, 0, 2, 11)]
    assert m.find("short one") == [(1, 0, 0, 0, 9)] and m.find("shorts one, ashort one, short ones") == []
    assert m.find("(x)") == [(3, 0, 0, 1, 2)] and m.find("xx") == [] and m.find("") == []
    words = long.split()
    # Half of a long passage is none; one with an edit every few words still is.
    assert m.find(" ".join(words[:450])) == []
    edited = "before " + " ".join(w + ("s" if i % 10 == 0 else "") for i, w in enumerate(words)) + " after"
    assert [f[:3] for f in m.find(edited)] == [(2, 0, 90)]
