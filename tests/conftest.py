import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


CAPTURE = (
    "row_id bigint, path string, type string, record_id string, url string, headers array<struct<name:string,value:string>>, content_type string, content_length bigint, content binary, "
    "harvester_id int, batch_id int, ingested_at timestamp"
)


@pytest.fixture(scope="session")
def captures(spark):
    """A maker of small captures tables from dicts; what is not given is null."""

    def make(rows):
        names = [c.split()[0] for c in CAPTURE.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CAPTURE)

    return make
