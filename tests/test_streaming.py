import re

from pyspark.sql import functions as F

from rosterproof.operators import duplicates
from rosterproof.plans import standins
from rosterproof.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_verify_in_several_batches(spark, tmp_path):
    """Results do not depend on how submissions arrive, nor on a replayed batch."""
    src = str(tmp_path / "in")
    customers = standins.table(spark, SF, "customer")
    customers.repartition(3).write.parquet(src)
    index = duplicates.registry_index(standins.registry(spark, SF))

    def prepare(batch):
        return standins.nest_submissions(
            standins.derive(batch.sparkSession, SF, standins.SUBMISSIONS_SQL, customer=batch)
        )

    stream = spark.readStream.schema(customers.schema).option("maxFilesPerTrigger", 1).parquet(src)
    folder = str(tmp_path / "out")
    jobs.verify_stream(stream, index, folder, prepare).awaitTermination()
    got = spark.read.parquet(f"{folder}/results")
    assert got.select("batch").distinct().count() == 3
    want = jobs.verify(standins.submissions(spark, SF), index)
    cols = ["request_id", "ordinal", "rule_id", "status", "title", "detail"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(duplicates, "LEAST_BUCKETS", 64)
    index = duplicates.registry_index(standins.registry(spark, SF))
    folder = str(tmp_path / "index")
    duplicates.save_index(index, folder)
    requests = duplicates.request_keys(standins.submissions(spark, SF))
    for keys in (requests, requests.limit(3), requests.limit(0)):
        keys = spark.createDataFrame(keys.collect(), keys.schema)
        want = sorted(map(str, duplicates.lookup(keys, index).collect()))
        for most in (200_000, 0):
            monkeypatch.setattr(duplicates, "BROADCAST_KEYS", most)
            near = duplicates.load_index(spark, folder, keys)
            assert sorted(map(str, duplicates.lookup(keys, near).collect())) == want
            if not want:
                continue
            plan = near.groups._jdf.queryExecution().executedPlan().toString()
            filters = plan.split("PartitionFilters: [")[1].split("]")[0]
            assert "bucket#" in filters
            if most:
                # Only the batch's keys move; the index is read where it lies.
                join, scan = plan.index("BroadcastHashJoin"), plan.index("FileScan")
                assert join < scan and "Exchange" not in plan[join:scan]
    three = duplicates.load_index(spark, folder, spark.createDataFrame(requests.limit(3).collect(), requests.schema))
    plan = three.groups._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    wanted = set(re.findall(r"(?<![#\d])\d+", filters))
    assert 0 < three.groups.count() <= 3 * 6 and 0 < len(wanted) <= 3 * 6 < 64


def test_each_request_once(spark, tmp_path):
    src = str(tmp_path / "in")
    events = spark.range(40).select(
        (F.col("id") % 7).cast("string").alias("hu_id"), F.timestamp_seconds(F.col("id")).alias("ts")
    )
    events.repartition(4).write.parquet(src)
    for n, event_time in enumerate((None, "ts")):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = str(tmp_path / f"out{n}")
        jobs.append_parquet(jobs.new_requests(stream, "hu_id", event_time), out).awaitTermination()
        assert sorted(r.hu_id for r in spark.read.parquet(f"{out}/results").collect()) == list("0123456")
