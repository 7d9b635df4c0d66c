"""Streaming jobs over incoming submissions and API events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rosterproof.operators.duplicates import RegistryIndex, load_index, lookup, request_keys, save_index
from rosterproof.operators.rules import rule_results, with_rule_results
from rosterproof.sources.api_events import event_links


def verify(submissions: DataFrame, index: RegistryIndex) -> DataFrame:
    """Rule results of submissions against a registry snapshot."""
    found = lookup(request_keys(submissions), index)
    return rule_results(with_rule_results(submissions.join(found, "request_id", "left")))


def verify_stream(
    incoming: DataFrame,
    registry_index: RegistryIndex,
    folder: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    **trigger,
) -> StreamingQuery:
    """Verify arriving submissions against the snapshot; results go to ``folder``/results.

    The snapshot is reduced to its key tables once, on shared storage. Each micro-batch is
    one bounded batch job writing its own directory, so a replayed batch overwrites itself;
    of the snapshot it reads the buckets of its own keys and keeps what these meet.
    """
    save_index(registry_index, f"{folder}/index")

    def each(batch: DataFrame, batch_id: int) -> None:
        # Read several times below; a lost part of it is read anew from the source.
        batch.persist()
        try:
            submissions = prepare(batch) if prepare else batch
            index = load_index(batch.sparkSession, f"{folder}/index", request_keys(submissions))
            results = verify(submissions, index)
            results.write.mode("overwrite").parquet(f"{folder}/results/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        incoming.writeStream.foreachBatch(each)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def new_requests(
    incoming: DataFrame,
    key: str = "hu_id",
    event_time: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """Each request once. With an event time, keys are forgotten after ``delay``."""
    if event_time is None:
        return incoming.dropDuplicates([key])
    return incoming.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def stream_event_links(events: DataFrame, keep: list[str]) -> DataFrame:
    """File links of arriving API responses; stateless."""
    return event_links(events, keep)


def append_parquet(df: DataFrame, folder: str, **trigger) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .option("path", f"{folder}/results")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def table_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 64) -> DataFrame:
    """A parquet table of the folder as a stream, ``files`` files at most in a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return found.option("maxFilesPerTrigger", files).parquet(sf_dir)
