from pyspark.sql import functions as F

from petrel.functions import headers as h
from petrel.operators import records as ops
from petrel.sources.archive import parse_objects
from tests.test_codec import ABOUT, ARC1, ARC2, FIRST, SECOND


def test_filters_keep_missing_values_when_inverted(spark):
    df = spark.createDataFrame([(1, "http://a/x"), (2, None), (3, "http://b/\ny")], "row_id int, url string")
    ids = lambda d: sorted(r.row_id for r in d.collect())
    assert ids(ops.filter_records(df, "/x$", "url")) == [1] and ids(ops.filter_records(df, "/x$", "url", invert=True)) == [2, 3]


def test_headers(spark):
    df = spark.sql("select array(struct('A' as name, '1' as value), struct('b' as name, '2' as value), struct('a' as name, '3' as value)) as headers")
    r = df.select(h.get_header(F.col("headers"), "a").alias("a"), h.get_header(F.col("headers"), "c").alias("c"), h.set_header(F.col("headers"), "a", F.lit("9")).alias("s")).head()
    assert (r.a, r.c, [tuple(x) for x in r.s]) == ("1", None, [("b", "2"), ("a", "9")])


def test_index_and_validity(spark):
    files = spark.createDataFrame([("a", FIRST + b"\r\n\r\n" + SECOND), ("b", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")], "path string, content binary")
    back = parse_objects(files)
    lines = [r.value for r in ops.index_text(ops.index(back.where("path = 'a'"))).collect()]
    assert lines[0].startswith("a 0 warcinfo - <urn:uuid:00000000-0000-0000-0000-000000000000> application/warc-fields 30")
    v = {r.path: r for r in ops.validate(back).collect()}
    assert v["a"].valid and not v["b"].valid and v["b"].first_fault == "expected 9 bytes but only read 3"
    assert "Headers:" in ops.dump(back.where("path = 'a'")).head().text


def test_arc_conversion(spark):
    back = parse_objects(spark.createDataFrame([("a.arc", ARC1 + b"\n" + ARC2 + b"\n" + b"dns:e.org 1.1.1.1 20131113000000 text/dns 4\nabcd\n" + SECOND)], "path string, content binary"))
    rows = ops.arc_to_warc(back, "2020-01-01T00:00:00Z", "petrel").orderBy("record_index", "part").collect()
    # the answer's declared length leaves two bytes over, so it is no complete response
    assert [r.type for r in rows] == ["warcinfo", "metadata", "resource", "resource", "response"]
    info = dict((x.name, x.value) for x in rows[0].headers)["WARC-Record-ID"]
    about = dict((x.name, x.value) for x in rows[1].headers)
    assert bytes(rows[1].content) == ABOUT and about["WARC-Target-URI"] == "saltmarsh-0042.arc" and about["WARC-Warcinfo-ID"] == info
    assert dict((x.name, x.value) for x in rows[2].headers)["WARC-Warcinfo-ID"] == info
    assert [x.name for x in rows[2].headers] == ["WARC-Record-ID", "WARC-Target-URI", "WARC-Warcinfo-ID", "WARC-IP-Address", "WARC-Date", "WARC-Type"]


def test_warcinfo_and_unpacking(spark, tmp_path):
    df = spark.sql("select encode('a: 1\r\nbad\r\nb:2\r\na: 3\r\n', 'utf-8') as c, cast('a: 1\r\nbad\r\nb:2\r\na: 3\r\n' as string) as t")
    r = df.select(ops.warcinfo_fields(F.col("t")).alias("m"), ops.warcinfo_malformed(F.col("t")).alias("bad")).head()
    assert r.m == {"a": "3", "b": "2"} and r.bad == ["bad"]
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; x\r\nContent-Length: 2\r\n\r\nhi"
    rows = [(p, i, i, "response", u, "application/http;msgtype=response", "2020", "id", page) for i, (p, u) in enumerate([("f", "http://h/a/b?q=1"), ("f", "http://h/a/b#x"), ("f", "http://h/"), ("f", "http://h/../../x.txt")])]
    records = spark.createDataFrame(rows, "path string, record_index bigint, offset bigint, type string, url string, content_type string, date_raw string, record_id string, content binary")
    log = ops.unpack_names(records).collect()
    names = sorted(r.outfile for r in log)
    assert [n for n in names if "-" not in n] == ["http/h/a/b.html", "http/h/index.html", "x.html"] and len(set(names)) == 4
    done = ops.unpack(records, str(tmp_path))
    assert all((tmp_path / r.outfile).read_bytes() == b"hi" and r.length == 2 and r.error is None for r in done.collect())
    assert all(len(r.value.split("\t")) == 9 for r in ops.unpack_log(done).collect())


def test_generated_names_never_meet_real_ones(spark):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\nhi"
    urls = ["http://h/b", "http://h/b?x", "http://h/b-2", "http://h/a/../b", "http://h/B", None]
    rows = [("f", i, i, "response", u, "application/http;msgtype=response", page) for i, u in enumerate(urls)]
    named = ops.unpack_names(spark.createDataFrame(rows, "path string, record_index bigint, offset bigint, type string, url string, content_type string, content binary")).collect()
    names = [r.outfile for r in named if r.url]
    assert len({n.lower() for n in names}) == len(names) == 5 and not any(".." in n for n in names)


def test_payload_of_a_place(spark):
    back = parse_objects(spark.createDataFrame([("a", FIRST + b"\r\n\r\n" + SECOND)], "path string, content binary"))
    at = back.where("type = 'response'").head().offset
    assert bytes(ops.extract_payload(back, "a", at).head().payload) == b"mud and samphire"
