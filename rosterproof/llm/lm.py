"""Language-model scoring by context-tree weighting over bytes.

The text is its words, lower-cased (A-Z), single-spaced, closed by an end byte; the model
sums the log10 probabilities of its bytes (see ``ctw``) learned from the training rows.

1. Each task counts the distinct grams (context and byte) of its documents and passes them
   on in blobs, one per part of the contexts' last two bytes.
2. All grams of a part meet in one task, which weighs its trees from the deepest contexts
   up to two bytes. What the parts hold for the two levels above is added up (at most
   65,536 nodes) and finished on the driver. A gram that only held-out texts have takes
   part with count 0, so every gram of every text gets its probability here.
3. Documents are scored against that table, and their words against the training counts of
   words. Both tables grow with the corpus: they are broadcast in shards of about ``SHARD``
   entries, chosen by hash. A task splits each text once, sorts the keys of about ``LOAD``
   bytes of text by shard, and loads one shard after the other to answer them, so its
   documents' sums are complete without a shuffle.

Cases: a null or blank text is its end byte alone; repeated rows are scored and counted
each; a null doc_id is a training row; extra columns are not read; an empty table gives no
rows. Memory: a task holds a batch's grams, the largest part, or a shard and a load's keys.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.llm import ctw
from rosterproof.llm.common import pieces, raw, sliced, staged

DEPTH = 6
PARTS = 1024
#: Entries of a broadcast shard; 12 bytes each.
SHARD = 2_500_000
SLICE = 2 << 20
#: Bytes of text whose keys (12 bytes each) a task holds while the shards pass by.
LOAD = 8 << 20
MERGE = 4_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
END = b"\n"


def plain(text: bytes) -> tuple[bytes, list[bytes]]:
    words = text.lower().split()
    return b" ".join(words), words


def _part(grams: np.ndarray) -> np.ndarray:
    last_two = (grams >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((last_two * np.uint64(40503)) & np.uint64(0xFFFF)) >> np.uint64(6)


_BYTE = np.uint64(8)


def _packed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Grams (56 bits at most) and counts (8 bits) as one number; larger counts repeat."""
    many = np.maximum(1, -(-counts // 255))
    if (many > 1).any():
        last = counts - 255 * (many - 1)
        full = np.full(int(many.sum()), 255)
        full[np.cumsum(many) - 1] = last
        keys, counts = np.repeat(keys, many), full
    return (keys << _BYTE) | counts.astype(np.uint64)


def _summed(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, with their counts added up."""
    if not len(packed):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.sort(packed)
    keys = packed >> _BYTE
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = (packed & np.uint64(255)).astype(np.int64)
    return keys[first], np.add.reduceat(counts, first)


def _merged(held: list[np.ndarray]) -> np.ndarray:
    return _packed(*_summed(np.concatenate(held))) if held else np.zeros(0, np.uint64)


def _counted(grams: np.ndarray, count: bool) -> np.ndarray:
    grams = np.sort(grams)
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, int)
    sizes = np.diff(np.r_[first, len(grams)])
    return _packed(grams[first], sizes if count else np.zeros_like(sizes))


def gram_blobs(docs: DataFrame, train: Column, depth: int) -> DataFrame:
    """Rows (part, grams): the packed grams of a task's documents, counted in training."""
    if depth > 6:
        raise ValueError("a gram and its count share 64 bits: depth is 6 at most")

    def run(batches):
        held: list = []

        def out():
            packed = _merged(held)
            held.clear()
            part = _part(packed >> _BYTE)
            order = np.argsort(part, kind="stable")
            part, packed = part[order], packed[order]
            cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else [0]
            for a in range(0, len(cut) - 1, 256):
                spans = list(zip(cut[a : a + 256], cut[a + 1 : a + 257], strict=False))
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([int(part[i]) for i, _ in spans], pa.int32()),
                        "grams": pa.array([packed[i:j].tobytes() for i, j in spans], pa.binary()),
                    }
                )

        for b in sliced(batches):
            texts = [plain(t)[0] for t in raw(b.column("text"))]
            learn = np.array(b.column("train").to_pylist(), bool)
            for i, j in pieces(texts, SLICE):
                codes, sizes = ctw.grams(texts[i:j], depth, END)
                used = np.repeat(learn[i:j], sizes)
                held += [_counted(codes[used], True), _counted(codes[~used], False)]
                if sum(map(len, held)) > MERGE:
                    held[:] = [_merged(held)]
                    if len(held[0]) > MERGE // 2:
                        yield from out()
        yield from out()

    rows = docs.select("text", train.alias("train"))
    return rows.mapInArrow(run, "part int, grams binary")


def deep_levels(blobs: DataFrame, depth: int) -> DataFrame:
    """Rows of two kinds: grams with p of their decisions (8 floats each), and nodes above.

    Blobs come sorted by part; one part is in work at a time.
    """

    def run(batches):
        part, held = None, []

        def out():
            keys, counts = _summed(np.concatenate(held)) if held else _summed(np.zeros(0, np.uint64))
            held.clear()
            if not len(keys):
                return
            p, (nodes, below, zeros, ones) = ctw.deep(keys, counts, depth, 2)
            p = p.astype(np.float32)
            step = 1 << 16
            for at in range(0, len(keys), step):
                yield row(keys[at : at + step], p[at : at + step], *[np.zeros(0)] * 4)
            yield row(keys[:0], p[:0], nodes, below, zeros, ones)

        def row(keys, p, nodes, below, zeros, ones):
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64())
            lists = [pa.array([x.tolist()], pa.list_(k)) for x, k in zip((nodes.astype(int), below, zeros, ones), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([keys.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary()), *lists],
                ["grams", "p", "node", "below", "zeros", "ones"],
            )

        for b in batches:
            grams = b.column("grams")
            for i, k in enumerate(b.column("part").to_pylist()):
                if k != part:
                    yield from out()
                    part = k
                held.append(np.frombuffer(grams[i].as_buffer(), np.uint64).copy())
                if sum(map(len, held)) > MERGE:
                    held[:] = [_merged(held)]
        yield from out()

    parts = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        blobs.repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(
            run,
            "grams binary, p binary, node array<int>, below array<double>, "
            "zeros array<double>, ones array<double>",
        )
    )


def top_levels(deep: DataFrame) -> ctw.Top:
    """The two levels above, from at most 65,536 summed rows."""
    rows = (
        deep.select(F.explode(F.arrays_zip("node", "below", "zeros", "ones")).alias("n"))
        .groupBy("n.node")
        .agg(F.sum("n.below").alias("below"), F.sum("n.zeros").alias("z"), F.sum("n.ones").alias("o"))
        .collect()
    )
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return ctw.Top(np.array(columns[0], int), *(np.array(c, float) for c in columns[1:]))


def gram_table(deep: DataFrame, top: ctw.Top) -> DataFrame:
    """(key, value): each gram times an odd constant, and its log10 probability."""
    held = deep.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        for b in batches:
            for g, p in zip(b.column("grams").to_pylist(), b.column("p").to_pylist(), strict=True):
                keys = np.frombuffer(g, np.uint64)
                got = np.frombuffer(p, np.float32).reshape(-1, 8).astype(float)
                value = held.value.log10(keys, got)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array((keys * ODD).view(np.int64)),
                        "value": pa.array(value.astype(np.float32)),
                    }
                )

    return deep.where("length(grams) > 0").select("grams", "p").mapInArrow(run, "key long, value float")


def word_table(docs: DataFrame, train: Column) -> DataFrame:
    """(word, n): how often each word occurs in the training rows."""

    def run(batches):
        count: Counter = Counter()

        def out():
            words = list(count)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "word": pa.array(part, pa.binary()),
                        "n": pa.array([count[w] for w in part], pa.int64()),
                    }
                )
            count.clear()

        for b in sliced(batches):
            for t in raw(b.column("text")):
                count.update(t.lower().split())
                if len(count) > 500_000:
                    yield from out()
        yield from out()

    found = docs.where(train).select("text").mapInArrow(run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Lookup:
    """Values by 64-bit keys: keys in order, with the first key of each of 2**bits ranges."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(1, int(len(keys)).bit_length() - 1)
        self.starts = np.searchsorted(
            self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)
        ).astype(np.int32)

    def __call__(self, keys: np.ndarray, other: float) -> np.ndarray:
        """Value of each key, ``other`` for a key that is not there."""
        if not len(self.keys):
            return np.full(len(keys), other, self.values.dtype)
        last = len(self.keys) - 1
        at = np.minimum(self.starts[keys >> np.uint64(64 - self.bits)], last)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.values.dtype.type(other))
        todo = np.flatnonzero((there < keys) & (at < last))
        at = at[todo] + 1
        while len(todo):
            there, want = self.keys[at], keys[todo]
            hit = there == want
            out[todo[hit]] = self.values[at[hit]]
            more = (there < want) & (at < last)
            todo, at = todo[more], at[more] + 1
        return out


def _shard(table: DataFrame, s: int, many: int) -> Lookup:
    """Lookup of the table's rows whose key falls to shard ``s``."""
    got = table.where(F.pmod("key", F.lit(many)) == s).select("key", "value").toArrow()
    return Lookup(got.column("key").to_numpy().view(np.uint64), got.column("value").to_numpy())


def scores(docs: DataFrame, train: Column, depth: int = DEPTH, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the unigram score with half-counts; ``score`` the model's log10
    probability of the text, ``n_bytes`` the bytes it speaks for.
    """
    train = F.coalesce(train, F.lit(False))
    deep = staged(deep_levels(gram_blobs(docs, train, depth), depth), "lm-deep")
    grams = staged(gram_table(deep, top_levels(deep)), "lm-grams")
    words = staged(
        word_table(docs, train).select(F.xxhash64("word").alias("key"), F.col("n").cast("double").alias("value"), "n"),
        "lm-words",
    )
    kinds, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = docs.where(train).count()
    grams_held = _shards(grams, grams.count(), shard)
    words_held = _shards(words, kinds, shard)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds, total = kinds + (ends > 0), total + ends
    found = rows.mapInArrow(_scorer(grams_held, words_held, depth, total, kinds, ends), _SCORES)
    return found.withColumn("train_tokens", F.lit(total).cast("long")).select(
        "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"
    )


_SCORES = "doc_id long, n_tokens long, n_bytes long, n_known long, base_score double, score double"


def _shards(table: DataFrame, n: int, shard: int) -> list[Broadcast]:
    """The table in broadcasts of about ``shard`` entries; the driver holds one at a time."""
    many, out = max(1, -(-n // shard)), []
    for s in range(many):
        out.append(table.sparkSession.sparkContext.broadcast(_shard(table, s, many)))
        # The driver keeps no copy; tasks read the file that was written of it.
        vars(out[-1]).pop("_value", None)
    return out


class _Asked(NamedTuple):
    """Keys in order of their shard, the document of each, and where each shard's keys end."""

    keys: np.ndarray
    at: np.ndarray
    cuts: np.ndarray


def _asked(keys: np.ndarray, at: np.ndarray, many: int) -> _Asked:
    if many == 1:
        return _Asked(keys, at, np.array([0, len(keys)]))
    # Spark's pmod of the signed key; a stable sort of 16-bit numbers is linear.
    to = (keys.view(np.int64) % many).astype(np.uint16 if many < 1 << 16 else np.int64)
    order = np.argsort(to, kind="stable")
    return _Asked(keys[order], at[order], np.searchsorted(to[order], np.arange(many + 1)))


def _answers(shards: list[Broadcast], asked: list[list[_Asked]], other: float, take) -> None:
    """``take(i, at, values)`` for each part ``i`` and shard; one shard is loaded at a time."""
    for s, held in enumerate(shards):
        table = held.value
        for i, part in enumerate(asked):
            for q in part:
                here = slice(q.cuts[s], q.cuts[s + 1])
                take(i, q.at[here], table(q.keys[here], other))
        # With a path, a task reads the value from the executor's file again at need.
        if len(shards) > 1 and getattr(held, "_path", None):
            vars(held).pop("_value", None)


def _scorer(grams: list[Broadcast], words: list[Broadcast], depth: int, total: int, kinds: int, ends: int):
    """Scores of documents. A task splits each text once, gathers what about ``LOAD`` bytes
    of text ask of the tables, and lets the shards pass by."""
    divisor = total + 0.5 * (kinds + 1)
    end_score = float(np.log10((ends + 0.5) / divisor))

    def run(batches):
        known: dict[bytes, int] = {}

        def hashes(tokens):
            if len(known) > 150_000:
                known.clear()
            for w in tokens:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w, 42)
            return np.array([known[w] for w in tokens], np.uint64)

        parts: list[dict] = []

        def read(b) -> int:
            flat, split = zip(*(plain(t) for t in raw(b.column("text"))), strict=True)
            tokens = np.array([len(ws) for ws in split])
            asked, size = [], np.zeros(len(flat), np.int64)
            for i, j in pieces(flat, SLICE):
                codes, size[i:j] = ctw.grams(flat[i:j], depth, END)
                at = np.repeat(np.arange(i, j, dtype=np.int32), size[i:j])
                asked.append(_asked(codes * ODD, at, len(grams)))
            keys = hashes([w for ws in split for w in ws])
            at = np.repeat(np.arange(len(flat), dtype=np.int32), tokens)
            parts.append(
                {
                    "doc_id": b.column("doc_id").to_pylist(),
                    "n_tokens": tokens + 1,
                    "n_bytes": size,
                    "n_known": np.full(len(flat), int(ends > 0)),
                    "base_score": np.full(len(flat), end_score),
                    "score": np.zeros(len(flat)),
                    "grams": asked,
                    "words": [_asked(keys, at, len(words))],
                }
            )
            return int(size.sum())

        def add_grams(i, at, log10):
            parts[i]["score"] += np.bincount(at, log10, len(parts[i]["score"]))

        def add_words(i, at, counts):
            n = len(parts[i]["score"])
            parts[i]["n_known"] += np.bincount(at[counts > 0], minlength=n)
            parts[i]["base_score"] += np.bincount(at, np.log10((counts + 0.5) / divisor), n)

        def answered():
            _answers(grams, [p.pop("grams") for p in parts], np.nan, add_grams)
            _answers(words, [p.pop("words") for p in parts], 0.0, add_words)
            for p in parts:
                ids = pa.array(p.pop("doc_id"), pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": ids, **{c: pa.array(x) for c, x in p.items()}})
            parts.clear()

        load = 0
        for b in sliced(batches):
            load += read(b)
            if load >= LOAD:
                yield from answered()
                load = 0
        if parts:
            yield from answered()

    return run
