"""Result tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where written tables go in a session that names no shared folder. Nothing sets it but a
# caller that runs on one machine and says so.
LOCAL_FOLDER: str | None = None


def shared_folder(spark: SparkSession, base: str | None = None) -> str:
    """A fresh folder under ``base`` or the cluster's ``spark.checkpoint.dir``.

    Raises where neither is given: a machine's own folder is not seen by the others.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None) or LOCAL_FOLDER
    if not base:
        raise ValueError("give a folder that all machines share, or set spark.checkpoint.dir")
    run = spark.sql("select uuid()").first()[0]
    return f"{base.rstrip('/')}/rosterproof-{run}"


def land(df: DataFrame, path: str, schema: str, fmt: str = "parquet") -> None:
    """Write a table in the layout its reader declares; columns it lacks are null."""
    fields = T.StructType.fromDDL(schema).fields
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ]
    df.select(*columns).write.mode("overwrite").format(fmt).save(path)


def write_reports(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Write each report table below ``folder``; returns the paths."""
    paths = []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        df.write.mode("overwrite").format(fmt).save(path)
        paths.append(path)
    return paths
