import os

import pytest

from petrel.operators.references import orphan_state
from petrel.streaming.counts import first_deliveries, windowed_counts
from petrel.streaming.references import current_orphans, keep_state, read_state

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def stream(spark, tmp_path):
    rows = spark.read.parquet(f"{D}/captures.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_state_of_a_stream_equals_the_batch(spark, tmp_path):
    rows, arriving = stream(spark, tmp_path)
    gone = spark.read.parquet(f"{D}/takedowns.parquet")
    keep_state(arriving, gone, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    state = read_state(spark, str(tmp_path / "state"), 2)
    want = orphan_state(rows, [rows], gone).where("refs > 0 and existing <= 0")
    key = lambda df: sorted(r.record_uuid for r in df.collect())
    assert key(current_orphans(state, gone)) == key(want) != []


def test_windows(spark, tmp_path):
    rows, arriving = stream(spark, tmp_path)
    for name, df in (("counted", windowed_counts(arriving)), ("first", first_deliveries(arriving, "4000 days"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counted" else "append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("counted").groupBy().sum("records").head()[0] == rows.count()
    assert spark.table("first").count() == rows.select("record_id").distinct().count()
