"""Exact dedup by composable polynomial fingerprints.

A text (white space removed) is cut into chunks. Each chunk has a polynomial hash
sum(byte[i] * base**i) mod prime for three primes near 2**31; the hash of two parts is
hash(left) + base**len(left) * hash(right), so the chunks of a huge text are hashed apart
and combined. Texts of equal fingerprint and length are then compared chunk by chunk: the
chunks of a group meet by (fingerprint, chunk number) and only their smallest and largest
are kept, so a group of any size reaches a task as at most one pair per map task. Where
they differ, the fingerprint collided and the group is split by the texts' SHA-256.

Cases: a null text is empty; empty texts equal each other; rows that repeat a doc_id are
rows of their own and count in group_size; of a tie in length the smallest doc_id stays,
null last. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.llm.common import BLANKS, keyed, raw, sliced, staged, without

CHUNK = 1 << 16
SLICE = 1 << 20
#: (prime, base); products of a byte and a residue sum to under 2**55 in a chunk.
HASHES = ((2147483647, 1103515245), (2147483629, 1299709231), (2147483587, 1566083941))
#: Bits of the filter that says which fingerprints occur more than once: 8 MB, always.
FILTER_BITS = 1 << 26


def _powers(hashes) -> np.ndarray:
    table = np.empty((len(hashes), CHUNK), np.int64)
    for k, (prime, base) in enumerate(hashes):
        p = 1
        for i in range(CHUNK):
            table[k, i] = p
            p = p * base % prime
    return table


def combine(left: tuple, right: tuple, hashes=HASHES) -> tuple:
    """Fingerprint of two parts, each (length, hash, hash, ...)."""
    return (left[0] + right[0],) + tuple(
        (a + pow(base, left[0], prime) * b) % prime
        for (prime, base), a, b in zip(hashes, left[1:], right[1:], strict=True)
    )


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)] or [b""]


def fingerprints(texts: list[bytes], powers: np.ndarray, hashes=HASHES) -> list[tuple]:
    """(length, hash, ...) of each text; memory is bounded by a slice of chunks."""
    out: list[tuple] = [(0,) + (0,) * len(hashes)] * len(texts)
    todo: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not todo:
            return
        lengths = np.array([len(c) for _, c in todo])
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(c for _, c in todo), np.uint8).astype(np.int64)
        at = np.arange(len(data)) - np.repeat(starts, lengths)
        sums = [
            (np.add.reduceat(data * powers[k][at], starts) % prime).tolist()
            for k, (prime, _) in enumerate(hashes)
        ]
        for j, (i, c) in enumerate(todo):
            part = (len(c), *(s[j] for s in sums))
            out[i] = combine(out[i], part, hashes) if out[i][0] else part
        todo.clear()

    size = 0
    for i, text in enumerate(texts):
        for c in chunks(text) if text else ():
            todo.append((i, c))
            size += len(c)
            if size >= SLICE:
                flush()
                size = 0
    flush()
    return out


def _packed(fps: list[tuple]) -> tuple[list[int], list[int]]:
    """The three hashes and the length in two longs."""
    return [f[1] << 31 | f[2] for f in fps], [f[3] for f in fps]


_FP = "f1 long, f2 long, bytes long"


def text_fingerprints(docs: DataFrame, hashes=HASHES, row: Column | None = None) -> DataFrame:
    """One row per document: row, doc_id, points (code points), f1, f2, bytes, sha.

    ``row`` is a key of the rows, by default a number of this read.
    """

    def run(batches):
        powers = _powers(hashes)
        for b in sliced(batches):
            texts = [t.translate(None, BLANKS) for t in raw(b.column("text"))]
            fps = fingerprints(texts, powers, hashes)
            f1, f2 = _packed(fps)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": b.column("row"),
                    "doc_id": b.column("doc_id"),
                    "points": b.column("points"),
                    "f1": pa.array(f1, pa.int64()),
                    "f2": pa.array(f2, pa.int64()),
                    "bytes": pa.array([f[0] for f in fps], pa.int64()),
                    "sha": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                }
            )

    rows = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"),
    )
    return rows.mapInArrow(run, f"row long, doc_id long, points long, {_FP}, sha binary")


def _repeated_filter(groups: DataFrame, bits: int) -> np.ndarray:
    """Bit set of the fingerprints that several rows share; its size never grows."""
    at = F.pmod(F.col("f1") + F.col("f2"), F.lit(bits))
    maps = (
        groups.select((at + 1).alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("k"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for k, m in maps:
        part = np.frombuffer(m, np.uint8)
        start = (k - 1) * len(part)
        out[start : start + len(part)] |= part[: len(out) - start]
    return out


def collided(docs: DataFrame, groups: DataFrame, hashes=HASHES) -> DataFrame:
    """Fingerprints (f1, f2, bytes) under which texts of different content meet.

    ``groups`` holds the fingerprints of more than one row. A fixed-size filter lets a
    task pass on the chunks of those rows only; a false positive is compared for nothing.
    """
    spark = docs.sparkSession
    seen = spark.sparkContext.broadcast(_repeated_filter(groups, FILTER_BITS))

    def run(batches):
        powers, table = _powers(hashes), seen.value
        for b in sliced(batches):
            texts = [t.translate(None, BLANKS) for t in raw(b.column("text"))]
            fps = fingerprints(texts, powers, hashes)
            f1, f2 = (np.array(x, np.int64) for x in _packed(fps))
            at = (f1 + f2) % FILTER_BITS
            known: dict = {}
            for i in np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                key = (int(f1[i]), int(f2[i]), fps[i][0])
                # Equal texts of a batch are passed on once; others meet in the shuffle.
                if texts[i] in known.setdefault(key, set()):
                    continue
                known[key].add(texts[i])
                cut = chunks(texts[i])
                for k in range(0, len(cut), 16):
                    part = cut[k : k + 16]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "f1": pa.array([key[0]] * len(part), pa.int64()),
                            "f2": pa.array([key[1]] * len(part), pa.int64()),
                            "bytes": pa.array([key[2]] * len(part), pa.int64()),
                            "k": pa.array(range(k, k + len(part)), pa.int64()),
                            "chunk": pa.array(part, pa.binary()),
                        }
                    )

    met = docs.select("text").mapInArrow(run, f"{_FP}, k long, chunk binary")
    return (
        met.groupBy("f1", "f2", "bytes", "k")
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        .where("low <> high")
        .select("f1", "f2", "bytes")
        .distinct()
    )


def exact_groups(docs: DataFrame, hashes=HASHES, row: Column | None = None) -> DataFrame:
    """One row per document: row, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row of the longest original, then of the smallest doc_id (null
    last), then the first row stays.
    """
    key = ["f1", "f2", "bytes"]
    rows = staged(text_fingerprints(docs, hashes, row), "exact")
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    wrong = staged(collided(docs, repeated, hashes), "exact-collided")
    part = F.lit(None).cast("binary")
    if not wrong.isEmpty():
        rows = rows.join(wrong.withColumn("split", F.lit(True)), key, "left")
        part = F.when(F.col("split"), F.col("sha"))
    rows = rows.withColumn("part", part)
    order = F.struct(
        -F.col("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"
    )
    best = (
        rows.groupBy(*key, "part")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best"))
        .where("n > 1")
        .select(
            *(F.col(c).alias(f"g_{c}") for c in (*key, "part")),
            "n",
            F.col("best.doc_id").alias("best_id"),
            F.col("best.row").alias("best_row"),
        )
    )
    on = [rows[c].eqNullSafe(best[f"g_{c}"]) if c == "part" else rows[c] == best[f"g_{c}"] for c in (*key, "part")]
    joined = rows.join(best, on, "left")
    alone = F.col("n").isNull()
    return joined.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row has; columns as given.

    Of equal texts the row that ``exact_groups`` keeps stays. Rows are told apart by a key of
    their own, so ids may be null or repeat.
    """
    rows, key = keyed(docs, "exact-rows")
    found = staged(exact_groups(rows, row=F.col(key)), "exact-groups")
    return without(rows, key, found.where("not kept").select("row"))
