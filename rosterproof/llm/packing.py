"""Best-fit packing of token sequences with large-item matching.

Documents are tokenised whole, closed with an end id and cut only where longer than the
capacity. The plan is made from the histogram of piece lengths, at most ``capacity``
numbers however many documents there are: pieces above one third of the capacity pair at
most twice per bin (each, largest first, with the largest that still fits), then smaller
pieces go, largest first, into the smallest gap that takes them, and open new bins when
none does. Equal bins are planned once with a multiplicity. A piece finds its place by its
rank among the pieces of its length; ranks are counted per bucket of rows and offset, so a
length that a third of all pieces have is never sorted in one task.

Cases: a null or empty text is one piece, its end id; repeated rows are pieces of their
own; a null doc_id is kept; a text's length is bounded by a row only.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterproof.llm.common import raw, sliced, staged
from rosterproof.llm.encoders import WORD_BPE, word_encoder

CAPACITY = 4096
END_ID = 1
#: Rows of one length are ranked in this many buckets.
BUCKETS = 256

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = WORD_BPE,
    end_id: int = END_ID,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids if asked."""

    def run(batches):
        encode = word_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for b in sliced(batches):
            out: list[list] = [[] for _ in range(6)]
            texts = raw(b.column("text"))
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                packed = encode(text) + end
                for k, at in enumerate(range(0, len(packed), step)):
                    part = packed[at : at + step]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=False)]
            if ids:
                flat = np.frombuffer(b"".join(out[5]), "<u4").astype(np.int32)
                cuts = np.r_[0, np.cumsum([len(p) // 4 for p in out[5]])].astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECE + (", ids array<int>" if ids else ""))


class Bins:
    """Bins of equal content with a multiplicity, found by their gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_gap: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
        self.gaps: list[int] = []

    def add(self, gap: int, content: tuple, count: int) -> None:
        if count:
            if not self.by_gap[gap]:
                insort(self.gaps, gap)
            self.by_gap[gap].append((content, count))

    def take(self, least: int) -> tuple[int, tuple, int] | None:
        """Remove and return bins of the smallest gap of ``least`` or more."""
        k = bisect_left(self.gaps, least)
        if k == len(self.gaps):
            return None
        gap = self.gaps[k]
        content, count = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            self.gaps.pop(k)
        return gap, content, count


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins for the histogram ``counts``: ([(length, copies), ...], multiplicity) each."""
    bins = Bins(capacity)
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large.pop()
        c = left[n]
        while c:
            # The largest partner that fits; of equal lengths two share a bin.
            k = bisect_left(large, capacity - n + 1) - 1
            if 2 * n <= capacity and c >= 2:
                bins.add(capacity - 2 * n, ((n, 2),), c // 2)
                c %= 2
            elif k >= 0 and 2 * n > capacity or k >= 0 and c == 1:
                m = large[k]
                pairs = min(c, left[m])
                bins.add(capacity - n - m, ((n, 1), (m, 1)), pairs)
                c -= pairs
                left[m] -= pairs
                if not left[m]:
                    large.pop(k)
            else:
                bins.add(capacity - n, ((n, 1),), c)
                c = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        while c:
            gap, content, count = bins.take(n) or (capacity, (), -(-c * n // capacity) + 1)
            each = gap // n
            if c >= each:
                full = min(count, c // each)
                bins.add(gap - each * n, content + ((n, each),), full)
                if content or gap < capacity:
                    bins.add(gap, content, count - full)
                c -= full * each
            else:
                bins.add(gap - c * n, content + ((n, c),), 1)
                if content or gap < capacity:
                    bins.add(gap, content, count - 1)
                c = 0
    return [x for gap in bins.gaps for x in bins.by_gap[gap]]


def places(planned: list, capacity: int) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks, ordered by (length, first rank).

    Ranks first .. first + count * copies - 1 of a length fill ``count`` bins from
    ``sequence`` on, ``copies`` in each, from ``offset`` on.
    """
    rows = []
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for content, count in planned:
        offset = 0
        for n, copies in content:
            rows.append((n, used[n], sequence, copies, offset))
            used[n] += count * copies
            offset += n * copies
        sequence += count
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "copies", "offset"), a.T.copy(), strict=True))


def ranked(pieces: DataFrame, order: list[str]) -> DataFrame:
    """``pieces`` with ``rank``, 0 .. n-1 within each length, in no particular order.

    Each bucket of a length is numbered on its own and starts where the counted buckets
    before it end.
    """
    rows = pieces.withColumn(
        "bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int")
    )
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    own = Window.partitionBy("length", "bucket").orderBy(*order)
    return (
        rows.withColumn("own", F.row_number().over(own) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("rank", (F.col("base") + F.col("own")).cast("long"))
        .drop("bucket", "own", "base")
    )


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: as few sequences as best fit finds."""
    spark = pieces.sparkSession
    counts = {
        r.length: r["count"] for r in pieces.groupBy("length").count().collect()
    }  # at most ``capacity`` rows
    where = spark.sparkContext.broadcast(places(plan(counts, capacity), capacity))
    out = [c for c in pieces.columns if c != "length"]

    def run(batches):
        p = where.value
        top = int(p["first"].max(initial=0)) + 1
        keys = p["length"] * top + p["first"]
        for b in batches:
            n = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            k = np.searchsorted(keys, n * top + np.minimum(rank, top - 1), "right") - 1
            bin_, copy = np.divmod(rank - p["first"][k], p["copies"][k])
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in out),
                    b.column("length"),
                    pa.array(p["sequence"][k] + bin_),
                    pa.array(p["offset"][k] + copy * n),
                ],
                [*out, "length", "sequence_id", "offset"],
            )

    ready = ranked(pieces, ["doc_id", "piece", "ids_crc32"])
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*out, "length"])
    return ready.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = WORD_BPE) -> DataFrame:
    """Pieces of all ``docs`` with their sequence and place in it."""
    return packed(staged(token_pieces(docs, capacity, tokenizer), "pieces"), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = WORD_BPE) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of at most ``capacity``)."""
    pieces = staged(token_pieces(docs, capacity, tokenizer, ids=True), "pieces")
    placed = packed(pieces, capacity)
    return (
        placed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"))
    )
