"""The orphan report kept up to date from a stream of captures.

Every micro-batch is turned into signed deltas per key and folded into a stored table, so the
work per batch follows the batch and the number of keys, never the history of rows. Batches
are numbered by the engine; each state is written under its number, so a repeated batch after
a failure overwrites its own result (exactly once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from petrel.operators.references import fold_state, orphan_state

STATE = "record_uuid string, refs bigint, existing bigint"


def read_state(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """State after a batch; empty before the first."""
    return spark.read.schema(STATE).parquet(f"{folder}/{batch}") if batch >= 0 else spark.createDataFrame([], STATE)


def keep_state(captures: DataFrame, withdrawn: DataFrame, folder: str, checkpoint: str, **trigger: bool | str) -> StreamingQuery:
    """Start folding a stream of captures into states ``folder/<batch>``."""
    nothing = withdrawn.limit(0)

    def fold(batch: DataFrame, number: int) -> None:
        before = read_state(batch.sparkSession, folder, number - 1)
        fold_state(before, orphan_state(batch, [batch], nothing)).write.mode("overwrite").parquet(f"{folder}/{number}")

    return captures.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_orphans(state: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Keys with positive references and no existence, or withdrawn ones."""
    from pyspark.sql import functions as F

    from petrel.functions.headers import uuid_bytes, uuid_text

    gone = withdrawn.select(uuid_text(uuid_bytes(F.col("record_id"))).alias("record_uuid")).where("record_uuid is not null").distinct().withColumn("gone", F.lit(True))
    return state.join(gone, "record_uuid", "left").where((F.col("refs") > 0) & ((F.col("existing") <= 0) | F.col("gone"))).drop("gone")
