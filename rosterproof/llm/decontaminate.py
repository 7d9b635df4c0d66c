"""Benchmark decontamination by pigeonhole edit matching.

Each benchmark passage, lower-cased and with white space collapsed, gets an error budget
of one edit per ``CHARS_PER_EDIT`` characters and is cut into budget + 1 pieces: in a copy
with no more edits than that, at least one piece is intact. An Aho-Corasick automaton of
all pieces finds intact pieces in the whole document in one scan; around each hit Myers'
bit-parallel algorithm gives the smallest edit distance of the passage to the text.

The benchmark is a query set: it is held against all documents in blocks of at most
``BLOCK_BYTES`` of passages, so the broadcast is bounded whatever the benchmark's size.

Cases: a passage of under ``CHARS_PER_EDIT`` normalised characters has no budget and must be
found as it is, between words; an empty one is never found; a passage of any length is
searched whole; null texts are empty; repeated rows each give their rows; null item_ids
are kept. ``part`` is always 0.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterproof.llm.common import sliced

CHARS_PER_EDIT = 20
BLOCK_BYTES = 8 << 20

MATCH = "item_id long, part int, distance int, start long, end long"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def split(passage: str) -> list[tuple[int, str]]:
    """Budget + 1 pieces (offset, piece) of nearly equal length."""
    n = len(passage) // CHARS_PER_EDIT + 1
    at = [len(passage) * i // n for i in range(n + 1)]
    return [(a, passage[a:b]) for a, b in zip(at, at[1:], strict=False)]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the closest substring of ``text``, None beyond the budget.

    One column of the edit matrix at a time, its differences held in two bit vectors.
    """
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """All passages of a block, ready to scan documents."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.passages: list[tuple[int | None, str, int]] = []
        self.automaton = ahocorasick.Automaton()
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            self.passages.append((item_id, text, len(text) // CHARS_PER_EDIT))
            for offset, piece in split(text):
                if piece not in self.automaton:
                    self.automaton.add_word(piece, (len(piece), []))
                self.automaton.get(piece)[1].append((len(self.passages) - 1, offset))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item_id, part, distance, start, end) of each passage found, its closest place.

        Places are positions in the normalised text; start is exact for intact copies,
        else the end less the passage's length.
        """
        text = normalise(text)
        found: list[tuple[int | None, int, int, int, int]] = []
        if not len(self.automaton):
            return found
        places: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for passage, offset in uses:
                places.setdefault(passage, []).append(end + 1 - size - offset)
        for passage, starts in places.items():
            item_id, pattern, budget = self.passages[passage]
            m = len(pattern)
            best = None
            for s in sorted(set(starts)):
                if s >= 0 and text.startswith(pattern, s) and (budget or _bounded(text, s, s + m)):
                    best = (0, s + m)
                    break
            if best is None and budget:
                # Overlapping windows are joined, so a place is verified once.
                for lo, hi in _windows(sorted(set(starts)), budget, m, len(text)):
                    got = myers(pattern, text[lo:hi], budget)
                    if got and (best is None or got[0] < best[0]):
                        best = (got[0], lo + got[1])
            if best:
                found.append((item_id, 0, best[0], max(0, best[1] - m), best[1]))
        return found


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether a place in a text neither begins nor ends within a word."""
    inside = [text[i - 1 : i + 1] for i in (start, end) if 0 < i < len(text)]
    return not any(x.isalnum() for x in inside)


def _windows(starts: list[int], budget: int, m: int, n: int):
    lo = hi = None
    for s in starts:
        a, b = max(0, s - budget), min(n, s + m + budget)
        if hi is not None and a <= hi:
            hi = max(hi, b)
        else:
            if hi is not None:
                yield lo, hi
            lo, hi = a, b
    if hi is not None:
        yield lo, hi


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The benchmark's (item_id, text) rows in lists of about ``limit`` bytes.

    Rows come to the driver partition by partition and each block is used before the next
    is fetched, so what is held and broadcast at once is bounded.
    """
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    for r in rows.toLocalIterator():
        held.append((r.item_id, r.text or ""))
        size += len(r.text or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document, passage found in it and part: doc_id, item_id, part, distance,
    start, end (in the normalised text). Clean documents have no row.
    """
    spark = docs.sparkSession
    out = None
    for items in blocks(benchmark):
        held = spark.sparkContext.broadcast(items)

        def run(batches, held=held):
            matcher = Matcher(held.value)
            for b in sliced(batches):
                rows = []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    rows += [(doc_id, *f) for f in matcher.find(text)]
                names = ("doc_id", "item_id", "part", "distance", "start", "end")
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names)
                )

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            run, f"doc_id long, {MATCH}"
        )
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], f"doc_id long, {MATCH}") if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; columns as given."""
    spark = docs.sparkSession
    text = docs.columns.index("text")
    for items in blocks(benchmark):
        held = spark.sparkContext.broadcast(items)

        def run(batches, held=held):
            matcher = Matcher(held.value)
            for b in sliced(batches, text):
                clean = [not matcher.find(t) for t in b.column(text).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
