"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code point order, null last, weigh 5, 2, 1, repeating. Their targets share the
words of all documents by weight; a target stops at three times its source's words, and
what it cannot take is shared again by weight among the others.

A document should be taken target / source words times: a whole number of times that all
documents of the source share, and a fraction that must become 0 or 1 once more. Fractions
are rounded in pairs: words move between two documents, up or down at random so that each
keeps its expectation, until one of the two is taken wholly or not at all; the other meets
the next document. The words of a source stay the same throughout, so all sources meet
their targets but for one last document each. Blocks of 4,096 documents are rounded in
parallel, what each leaves over is rounded in blocks of 4,096 again, and so on up a tree.

Words are counted in 2**-20 parts, so nothing is lost in sums. Random numbers come from a
hash of the seed and the block; blocks are cut from an order of (hash of doc_id, doc_id,
size), so a rerun gives the same rows however the input is partitioned, also where equal
rows repeat: rows that only their place in a file tells apart have the same result, or swap
it.

Bounds: a task holds 4,096 documents' sizes; a source of any size is cut into blocks. The
driver holds totals only.

Cases: a null text has no words; a document without words takes nothing; a null source is
the last source; rows that repeat a doc_id are documents of their own; a null doc_id is one
like any other; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.llm.common import meet, staged
from rosterproof.llm.ordering import numbered

WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST_COPIES = 3
#: Documents that one task rounds together, as a power of two; parts of a word, likewise.
BLOCK, PARTS = 12, 20

_STATE = "source_no long, start long, pos long, doc_id long, size long, mass long, up int"


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; null is 0."""
    tidy = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.length(F.regexp_replace(tidy, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target``.

    Sources are capped in rounds: those whose share of the rest exceeds the cap are, until
    none does. The driver holds two sums a round.
    """
    cap = F.col("source_size") * MOST_COPIES
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rest, weights, capped = total, None, F.lit(False)
    while True:
        free = sources.where(~capped)
        row = free.agg(F.sum("weight").alias("w"), F.sum(cap).alias("c"), F.count(F.lit(1)).alias("n")).first()
        weights = row.w or 0
        if not weights:
            return sources.withColumn("target", cap.cast("double"))
        share = F.col("weight") * F.lit(rest).cast("double") / F.lit(weights)
        over = ~capped & (share > cap)
        taken = sources.where(over).agg(F.sum(cap)).first()[0]
        if taken is None:
            return sources.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share))
        rest -= taken
        capped = capped | (share > cap)


def pivot(masses: list[int], fulls: list[int], draws: list[int]) -> int | None:
    """Round ``masses``, in place, to 0 or their ``fulls`` in pairs; index of one left over.

    The sum stays the same. ``draws``: a 64-bit random number for each.
    """
    left = None
    for i, mass in enumerate(masses):
        if not 0 < mass < fulls[i]:
            continue
        if left is None:
            left = i
            continue
        up = min(fulls[left] - masses[left], mass)
        down = min(masses[left], fulls[i] - mass)
        move = up if draws[i] * (up + down) >> 64 < down else -down
        masses[left] += move
        masses[i] -= move
        if 0 < masses[i] < fulls[i]:
            left = i
        elif not 0 < masses[left] < fulls[left]:
            left = None
    return left


def _round_blocks(seed: str, level: int, last: bool):
    """Arrow function: a block of documents per row -> its documents with ``up``, null for
    the one left over; in the last round that one is drawn."""
    types = [pa.int64()] * 6 + [pa.int32()]
    names = [c.split()[0] for c in _STATE.split(", ")]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                items = r["items"]
                fulls = [x["size"] << PARTS for x in items]
                masses = [x["mass"] for x in items]
                key = f"{seed}/{level}/{r['start']}/{r['block']}".encode()
                bits = hashlib.shake_256(key).digest(8 * (len(items) + 1))
                draws = [int.from_bytes(bits[8 * i : 8 * i + 8], "little") for i in range(len(items) + 1)]
                left = pivot(masses, fulls, draws)
                if last and left is not None:
                    masses[left] = fulls[left] if draws[-1] * fulls[left] >> 64 < masses[left] else 0
                    left = None
                up = [None if i == left else int(masses[i] > 0) for i in range(len(items))]
                columns = [
                    [r["source_no"]] * len(items),
                    [r["start"]] * len(items),
                    [x["pos"] for x in items],
                    [x["doc_id"] for x in items],
                    [x["size"] for x in items],
                    masses,
                    up,
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
                )

    return run


def mixed(docs: DataFrame, seed: str = "0") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, one row per document."""
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    sizes = staged(sizes, "mix-sizes")
    by_source = F.asc_nulls_last("source")
    order = [by_source, F.asc(F.xxhash64("doc_id")), F.asc_nulls_first("doc_id"), F.asc("size"), F.asc("row")]
    rows = numbered(sizes, order, "mix-order")
    sources = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.min("position").alias("start"),
        F.count(F.lit(1)).alias("n"),
    )
    sources = numbered(staged(sources, "mix-sources"), [by_source], "mix-weights")
    sources = sources.withColumnRenamed("position", "source_no")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS)).cast("int"))
    # At least 0 and at most MOST_COPIES times, whatever the division rounds to.
    times = F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))
    sources = targets(sources.withColumn("weight", weight.cast("long")))
    sources = sources.withColumn("times", F.when(F.col("source_size") > 0, times).otherwise(0.0))
    sources = staged(sources.withColumn("whole", F.floor("times").cast("long")), "mix-targets")

    part = F.col("times") - F.col("whole")
    mass = F.floor((F.col("size") * F.lit(1 << PARTS)) * part).cast("long")
    items = meet(rows, sources, "source").select(
        "source_no",
        "start",
        (F.col("position") - F.col("start")).alias("pos"),
        "doc_id",
        "size",
        mass.alias("mass"),
        F.lit(None).cast("int").alias("up"),
    )
    largest = sources.agg(F.max("n")).first()[0] or 0
    done, level = None, 0
    while True:
        last = largest <= 1 << (BLOCK * (level + 1))
        block = F.shiftright("pos", BLOCK * (level + 1)).alias("block")
        together = F.sort_array(F.collect_list(F.struct("pos", "doc_id", "size", "mass")))
        blocks = items.groupBy("source_no", "start", block).agg(together.alias("items"))
        found = staged(blocks.mapInArrow(_round_blocks(seed, level, last), _STATE), f"mix-round-{level}")
        fixed = found.where("up is not null")
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            break
        items, level = found.where("up is null"), level + 1
    facts = sources.select("source_no", "source", "source_size", "target", "whole")
    copies = F.col("whole") + F.col("up")
    return meet(done, facts, "source_no").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
