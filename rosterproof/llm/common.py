"""Shared helpers: written intermediate tables, text bytes, bounded broadcasts, small local graphs."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as every contract of this package spells it: [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset a local session (tests) gets a temporary folder; a cluster must
    name one, since its machines do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="rosterproof-")
        base = _LOCAL["dir"]
    return base.rstrip("/")


_LOCAL: dict[str, str] = {}


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: later jobs, and retries after a lost executor, read the files.
    """
    spark = df.sparkSession
    path = path or f"{scratch(spark)}/rosterproof-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column without decoding; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches, column: str | int = "text", limit: int = 2 << 20):
    """Parts of Arrow batches with about ``limit`` bytes of text each, at least one row.

    What a task holds as Python objects is then bounded by that and the longest text.
    """
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield b.slice(start, end - start)
            start = end


def pieces(items: list[bytes], limit: int):
    """Runs (start, end) of ``items`` of about ``limit`` bytes, at least one item each."""
    start = size = 0
    for i, x in enumerate(items):
        size += len(x)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(items):
        yield start, len(items)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index reachable from each of ``n`` nodes over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        differs = label[a] != label[b]
        a, b = a[differs], b[differs]
        if np.array_equal(before, label):
            break
    return label


def smallest_reachable(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node of each connected component of ``edges`` (a, b).

    Alternating large-star and small-star rounds (Kiveris et al., "Connected components in
    MapReduce and beyond"), each written to shared storage. Every group is reduced to its
    minimum by partial aggregation and joined back, so a hub is never gathered; AQE splits
    the join of a hub. Nodes without an edge to another node are not in the result.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    folder = f"{scratch(spark)}/rosterproof-{name}-{uuid.uuid4().hex[:12]}"
    current, last = staged(both.distinct(), name, f"{folder}/0"), f"{folder}/0"
    seen = None
    for step in range(1, 200):
        current = staged(_star(_star(current, True), False), name, f"{folder}/{step}")
        remove(spark, last)
        last = f"{folder}/{step}"
        # Order-free digest of the edge set: the rounds end when a round changes nothing.
        digest = current.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            F.bit_xor(F.xxhash64("b", "a")),
        ).first()
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError(f"{name}: components still change after 200 rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def meet(rows: DataFrame, grouped: DataFrame, key: str) -> DataFrame:
    """Rows joined to the one row that ``grouped`` has for their key.

    A null-safe equality is keyed otherwise than the aggregation that made ``grouped``, so
    both sides are shuffled for the join and AQE can split a hot key of ``rows``.
    """
    other = grouped.withColumnRenamed(key, "__key")
    return rows.join(other, rows[key].eqNullSafe(other["__key"])).drop("__key")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges a > b: neighbours are linked to the smallest one."""
    if large:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        out = meet(around.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = (
            meet(edges, low, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


#: Row keys that are broadcast: 16 bytes each, 32 MB. More are met in a shuffle join.
LISTED = 2_000_000


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a key of its rows, and the key's column name (none that docs has).

    Rows read straight from files are keyed by file and place in it, which any later read
    finds again; others are written once and keyed there. The list of files, which the
    driver holds anyhow, is broadcast.
    """
    key = "__row"
    while key in docs.columns:
        key += "_"
    plain = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    if not plain or "_metadata" in docs.columns:
        return staged(docs.withColumn(key, F.monotonically_increasing_id()), name), key
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = docs.select(path.alias("__file")).distinct()
    place = docs.withColumns({f"{key}f": path, key: index})
    number = F.row_number().over(Window.orderBy("__file"))
    files = staged(files.select("__file", number.cast("long").alias("__number")), f"{name}-files")
    met = place.join(F.broadcast(files), place[f"{key}f"] == files["__file"])
    row = F.shiftleft("__number", 36).bitwiseOR(F.col(key))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], row.alias(key)), key


def listed(keys: DataFrame) -> DataFrame:
    """``keys`` (a few longs a row), marked for broadcast if they are at most ``LISTED``."""
    return F.broadcast(keys) if keys.count() <= LISTED else keys


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose key is not in ``gone`` (of one column), and without the key."""
    out = gone.toDF("__gone")
    return rows.join(listed(out), F.col(key) == F.col("__gone"), "left_anti").drop(key)


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text expression of ASCII characters."""
    bits = (
        "list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 "
        "THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(h, b))"
    )
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda h, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"
