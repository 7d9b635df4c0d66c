"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_features(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    train: Column,
    rows: int,
    size: int,
    encode: Callable[[str], bytes],
) -> Iterator[tuple[bytes, int]]:
    """(encoded features, label) of at most ``rows`` labelled documents, ``size`` bytes in all.

    The documents are chosen by a hash of their ids among the labels that satisfy
    ``train``, so the choice does not depend on order or partitioning. A document labelled
    several times counts as labelled 1 if any label says so; labels other than 0 and 1 and
    null labels or ids are not used. At most ``rows`` ids are broadcast; the features come
    to the driver one partition at a time; a document that would exceed ``size`` is left out,
    those behind it are not.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .withColumnRenamed("id", "doc_id")
        .where(train)
        .withColumnRenamed("doc_id", "id")
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = picked.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", "text")

    def run(batches):
        for b in batches:
            for i, y, t in zip(*(b.column(k).to_pylist() for k in ("id", "y", "text")), strict=True):
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array([i], pa.int64()),
                        "y": pa.array([y], pa.int32()),
                        "x": pa.array([encode(t or "")], pa.binary()),
                    }
                )

    found = picked.mapInArrow(run, "id long, y int, x binary")
    spent = 0
    for r in found.repartitionByRange(8, F.xxhash64("id"), "id").sortWithinPartitions(
        F.xxhash64("id"), "id"
    ).toLocalIterator():
        if spent + len(r.x) <= size:
            spent += len(r.x)
            yield bytes(r.x), r.y


def is_held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """crc32 of the id's decimal text gives ``remainder``; false for a null id."""
    crc = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    return F.coalesce(crc % mod == remainder, F.lit(False))
