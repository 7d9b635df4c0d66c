"""Equi-joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# No more than this many keys can be hot: a hot key holds at least that share of all rows,
# so the broadcast table of (bigint, int) rows is bounded by arithmetic (about 1 MB).
MAX_HOT_KEYS = 65_536
# Below this many rows a key is not worth splitting.
HOT_ROWS = 250_000


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """(hash, slices) of the heaviest keys of ``rows``.

    The count is a partial aggregation, so a hot key reaches the shuffle as one row per
    map task. Two keys sharing a hash are cut alike, which costs copies, not rows.
    """
    counted = rows.groupBy(F.xxhash64(*keys).alias("__hash")).agg(
        F.count(F.lit(1)).alias("__rows")
    )
    return _hot(counted, hot_rows)


def hot_groups(counted: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """Like ``hot_keys`` where ``counted`` already holds the rows per key as ``n``."""
    hashed = counted.groupBy(F.xxhash64(*keys).alias("__hash")).agg(F.max("n").alias("__rows"))
    return _hot(hashed, hot_rows)


def _hot(counted: DataFrame, hot_rows: int | None) -> DataFrame:
    """Keys of at least the hot size, cut into slices of about that size.

    The size follows from the counted total alone, so every evaluation finds the same
    keys and slices.
    """
    share = F.ceil(counted.agg(F.sum("__rows")).scalar() / MAX_HOT_KEYS)
    limit = F.greatest(F.lit(hot_rows or HOT_ROWS), F.coalesce(share, F.lit(0)))
    return (
        counted.withColumn("__limit", limit)
        .where(F.col("__rows") >= F.col("__limit"))
        .select("__hash", F.ceil(F.col("__rows") / F.col("__limit")).cast("int").alias("__cut"))
    )


def spread_join(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` to ``few`` on ``keys``; hot keys of ``many`` go to several tasks.

    Each row of a hot key gets a slice by a hash of ``spread_by``, and the rows of
    ``few`` with that key are copied once per slice. ``few`` must hold a small number of
    rows per key (one, or a first-k list). Works for inner, left, left_semi, left_anti.
    ``hot`` gives the hot keys where group sizes are known; else ``many`` is counted.

    ``few`` grows with the input and its size is guessed low behind joins and explodes, so
    it is merged: only the hot keys ever pass through the driver.
    """
    hot = hot_keys(many, keys) if hot is None else hot
    cut = F.coalesce(F.col("__cut"), F.lit(1))
    spread = F.pmod(F.xxhash64(*(spread_by or many.columns)), cut).cast("int")

    def with_cut(df: DataFrame) -> DataFrame:
        return df.withColumn("__hash", F.xxhash64(*keys)).join(F.broadcast(hot), "__hash", "left")

    left = with_cut(many).withColumn("__slice", spread).drop("__hash", "__cut")
    right = (
        with_cut(few)
        .withColumn("__slice", F.explode(F.sequence(F.lit(0), cut - 1)))
        .drop("__hash", "__cut")
    )
    return left.join(right.hint("merge"), [*keys, "__slice"], how).drop("__slice")
