import pytest

from rosterproof.session import local_session

REGISTRY = (
    "id string, code string, name string, type string, status string, owner string, "
    "sla int, create_date string, input_order bigint"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "rosterproof-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def registry(spark):
    """Build a registry from (id, code, name, owner[, sla[, status]]) rows."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            rid, code, name, owner, sla, status = (*r, *(0, "รอ")[len(r) - 4 :])[:6]
            full.append((rid, code, name, "t", status, owner, sla, None, i))
        return spark.createDataFrame(full, REGISTRY)

    return build


@pytest.fixture
def values(spark):
    """Evaluate a column function over a list of strings."""

    def run(f, items):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, s string")
        rows = df.select("i", f(F.col("s")).alias("v")).orderBy("i").collect()
        return [r.v for r in rows]

    return run
