"""Token counts for every context limit from an exact length histogram.

Documents are encoded whole and aggregated by their length; the histogram has a row per
length that occurs. Suffix sums over it answer, for any limit, how many documents reach
it, how many tokens stay when longer documents are cut to it, and which length is a
quantile. The suffix sums are taken in two steps, within blocks of lengths and over the
blocks' totals, so the histogram is never sorted in one task.

Cases: a null or empty text has length 0; repeated rows count each; an empty table has an
empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterproof.llm.common import raw, sliced, staged
from rosterproof.llm.encoders import BYTE_BPE, rank_count, rank_encoding

#: Lengths of a block; the blocks' totals are a small table (longest length / BLOCK rows).
BLOCK = 256


def encoded_lengths(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """One row per document: doc_id, n_tokens."""

    def run(batches):
        encoding = rank_encoding(tokenizer)
        for b in sliced(batches):
            sizes = [rank_count(encoding, t.decode()) for t in raw(b.column("text"))]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64())}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs) for each length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """A row per length L of the histogram, with the answers for the limit L.

    docs, tokens: of that length; docs_from, tokens_from: of that length or longer;
    total_docs, total_tokens: of all; truncated_tokens: sum of min(length, L);
    rank_share: share of documents of length L or less.
    """
    # Written once, so that the documents behind it are encoded once.
    rows = staged(hist, "lengths").select(
        "n_tokens",
        "docs",
        (F.col("n_tokens") * F.col("docs")).alias("tokens"),
        F.floor(F.col("n_tokens") / BLOCK).alias("block"),
    )
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy(F.desc("block")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    later = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(all_).alias("total_docs"),
        F.sum("t").over(all_).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    docs_from = F.sum("docs").over(within) + F.col("d_after")
    tokens_from = F.sum("tokens").over(within) + F.col("t_after")
    full = rows.join(later, "block").select(
        "n_tokens",
        "docs",
        "tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        "total_docs",
        "total_tokens",
    )
    return full.withColumns(
        {
            "truncated_tokens": F.col("total_tokens")
            - F.col("tokens_from")
            + F.col("n_tokens") * F.col("docs_from"),
            "rank_share": 1 - (F.col("docs_from") - F.col("docs")) / F.col("total_docs"),
        }
    )


def answers(sums: DataFrame, limits: list[int], quantiles: list[float]) -> DataFrame:
    """(question, at, answer) from the suffix sums, in one aggregation.

    ``truncated``: tokens left when documents are cut to the limit ``at``; ``reaching``:
    documents of that length or longer; ``quantile``: the smallest length that a share
    ``at`` of the documents does not exceed.
    """
    n = F.col("n_tokens")
    total = F.max("total_tokens")
    asked = []
    for limit in limits:
        # The next length that occurs knows all documents that the limit cuts.
        near = F.min(F.when(n >= limit, F.struct("n_tokens", "tokens_from", "docs_from")))
        cut = F.coalesce(near["docs_from"], F.lit(0))
        rest = total - F.coalesce(near["tokens_from"], F.lit(0))
        asked.append(("truncated", float(limit), rest + cut * limit))
        asked.append(("reaching", float(limit), cut))
    for q in quantiles:
        asked.append(("quantile", q, F.min(F.when(F.col("rank_share") >= q - 1e-12, n))))
    rows = [
        F.struct(F.lit(k).alias("question"), F.lit(at).alias("at"), v.cast("long").alias("answer"))
        for k, at, v in asked
    ]
    return sums.agg(F.array(*rows).alias("a")).select(F.inline("a"))
