"""Places for intermediate results that must survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (``local``) gets a temporary folder, once; a
    cluster gets an error, because a machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not known and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="petrel-"))
        return sc.getCheckpointDir().rstrip("/")
    if not known:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: lineage ends there.

    Unlike checkpoint() the result stays columnar, so later steps read only the columns
    they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, most: int) -> list[Row]:
    """All rows of a reference table on the driver; an error, never a part, if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for the driver")
    return rows
