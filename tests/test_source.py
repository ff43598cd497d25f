import gzip

import pytest
from pyspark.sql import functions as F

from petrel.codec import archive
from petrel.sources.archive import parse_objects, read_objects, register, stream_objects


def data(n, compressed=False):
    # payloads that look like records must not mislead a split
    parts = [archive.serialize("WARC/1.0", [("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:uuid:{i}>"), ("WARC-Date", "2020-01-02T03:04:05Z")], b"\r\n\r\nWARC/1.0\r\nX: 1\r\n\r\n" + b"ab" * (i % 50), "text/plain", compressed=compressed) for i in range(n)]
    return b"".join(parts)


@pytest.mark.parametrize("compressed", [False, True])
def test_splits_change_nothing(spark, tmp_path, compressed):
    register(spark)
    name = tmp_path / ("a.warc" + ".gz" * compressed)
    name.write_bytes(data(120, compressed))
    whole = spark.read.format("webarchive").load(str(tmp_path))
    want = sorted((r.offset, r.record_id, bytes(r.content)) for r in whole.collect())
    assert len(want) == 120 and whole.where("date_ts is null or fatal is not null").count() == 0
    for size in (700, 5000):
        parts = spark.read.format("webarchive").option("splitBytes", str(size)).load(str(tmp_path))
        assert (parts.rdd.getNumPartitions() > 1) == compressed  # plain files hold payloads that may be archives: never split
        assert sorted((r.offset, r.record_id, bytes(r.content)) for r in parts.collect()) == want


def test_embedded_archives_stay_whole(spark, tmp_path):
    """A payload that is itself an archive is one record, however the file is split."""
    register(spark)
    inner = data(3)
    outer = b"".join(archive.serialize("WARC/1.0", [("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:uuid:o{i}>")], inner, "application/warc", compressed=False) for i in range(2))
    (tmp_path / "o.warc").write_bytes(outer)
    assert spark.read.format("webarchive").option("splitBytes", "1000").load(str(tmp_path)).count() == 2


def test_options_and_seeking(spark, tmp_path):
    register(spark)
    (tmp_path / "a.warc.gz").write_bytes(data(5, True))
    (tmp_path / "b.warc").write_bytes(data(2) + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")
    load = lambda **o: spark.read.format("webarchive").options(**o).load(str(tmp_path))
    assert load(includeContent="false").where("content is not null").count() == 0
    assert load(limitPerFile="1").count() == 2
    at = load().where("path like '%a.warc.gz' and record_index = 3").head()
    one = load().where((F.col("path") == at.path) & (F.col("offset") == at.offset)).collect()
    assert [r.record_id for r in one] == ["<urn:uuid:3>"]
    assert load().where("fatal is not null").head().fatal == "expected 99 bytes but only read 5"
    with pytest.raises(Exception, match="expected 99"):
        load(mode="FAILFAST").collect()


def test_write_and_read_back(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(data(30))
    rows = spark.read.format("webarchive").load(str(tmp_path / "in"))
    for gz in ("false", "true"):
        out = str(tmp_path / f"out-{gz}")
        rows.repartition(3).write.format("webarchive").option("gzip", gz).mode("append").save(out)
        back = spark.read.format("webarchive").load(out)
        key = lambda df: sorted((r.record_id, bytes(r.content), r.content_length) for r in df.collect())
        assert key(back) == key(rows)


def test_whole_objects_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(data(7)))
    assert read_objects(spark, str(tmp_path / "in")).count() == 7
    empty = spark.createDataFrame([("x", None), ("y", b"")], "path string, content binary")
    assert parse_objects(empty).count() == 0
    q = stream_objects(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("archive_stream").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("archive_stream").count() == 7
