"""Dangling references, rejected rows, instants: edge cases."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from petrel.operators import instants, references, rejects

U = "{:08x}-0000-0000-0000-000000000000".format


def ref(name, n, form="<urn:uuid:{}>"):
    return {"name": name, "value": form.format(U(n))}


def test_dangling_references(spark, captures):
    rows = captures(
        [
            {"row_id": 1, "batch_id": 2, "record_id": f"<urn:uuid:{U(1)}>", "headers": [ref("warc-refers-to", 2, " <URN:UUID:{}> "), ref("WARC-Refers-To", 2), ref("WARC-Concurrent-To", 9), ref("WARC-Concurrent-To", 3), {"name": None, "value": None}, {"name": "WARC-Refers-To", "value": "none"}]},
            {"row_id": 2, "batch_id": 3, "record_id": U(2).upper(), "headers": [ref("WARC-Warcinfo-ID", 5), ref("WARC-Refers-To", 1)]},
            {"row_id": 3, "batch_id": 1, "record_id": f"<urn:uuid:{U(3)}>", "headers": None},
            {"row_id": 4, "batch_id": None, "record_id": None, "headers": [ref("WARC-Refers-To", 2)]},
        ]
    ).withColumn("key", F.lit("clash"))
    infos = spark.createDataFrame([(U(5), 1)], "record_id string, batch_id int")
    gone = spark.createDataFrame([(f"urn:uuid:{U(3)}",), (None,)], "record_id string")
    got = {(r.row_id, r.ref_field, r.ref_id, r.reason) for r in references.dangling_references(rows, [rows, infos], gone).collect()}
    assert got == {(1, "WARC-Refers-To", U(2), "later"), (1, "WARC-Concurrent-To", U(9), "absent"), (1, "WARC-Concurrent-To", U(3), "withdrawn")}
    report = references.orphan_report(rows, [rows, infos], gone, F.lit("p")).collect()
    assert sum(r.refs for r in report) == 3
    nothing = rows.limit(0)
    assert references.dangling_references(nothing, [nothing, infos], gone).count() == 0


def test_folding_deltas_equals_the_whole(spark, captures):
    make = lambda ids, targets: captures([{"row_id": i, "batch_id": 1, "record_id": U(i), "headers": [ref("WARC-Refers-To", t)]} for i, t in zip(ids, targets)])
    gone = spark.createDataFrame([], "record_id string")
    a, b = make([1, 2], [3, 9]), make([3], [9])
    state = lambda x: references.orphan_state(x, [x], gone)
    both = a.unionByName(b)
    assert {tuple(r) for r in references.fold_state(state(a), state(b)).collect()} == {tuple(r) for r in state(both).collect()}


def test_rejects(spark):
    good = "f,7,response,u,<urn:uuid:00000000-0000-0000-0000-000000000000>,t,-"
    cases = {
        good: None, '"a,b",7,response,"u ""x""",<URN:UUID:00000000-0000-0000-0000-00000000000A>,-,0012': None, good + ",x": "fields: 8", "a,b": "fields: 2", '"open,1': "quoting", 'f"x,7,response,u,i,t,1': "quoting", '"f"x' + good[1:]: "quoting",
        good.replace(",7,", ",7.0,"): "offset", good.replace(",7,", ",-,"): "offset", good.replace(",7,", ",9223372036854775808,"): "offset", good.replace("response", "Response"): "warc_type", good.replace("urn:uuid:0", "urn:uuid:g"): "record_id", good[:-1] + "x": "content_length", good[:-1]: "content_length",
        good.replace(",7,", ",٧,"): "offset", '"a\nb' + good[1:].replace(",", '",', 1): None, "f" * 100_000 + good[1:]: None,
    }
    lines = [*cases, None, "", "  ", "# note", good]
    df = spark.createDataFrame([(i, "f", i, s, "extra") for i, s in enumerate(lines)], "line_id bigint, file_name string, line_no bigint, line string, reason string")
    got = {r.line_id: r for r in rejects.parse_index_lines(df).collect()}
    assert {i: got[i].reason for i in range(len(cases))} == dict(enumerate(cases.values()))
    assert set(got) == {*range(len(cases)), len(lines) - 1}
    assert (got[0].offset, got[0].subject_uri, got[0].content_length) == (7, "u", None) and (got[1].filename, got[1].subject_uri, got[1].content_type, got[1].content_length) == ("a,b", 'u "x"', None, 12)
    assert rejects.parse_index_lines(df.limit(0)).count() == 0


def instant(spark, rows, zones=("Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "UTC")):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, t string, z string, o string").withColumn("epoch_ms_before", F.lit(1))
    out = instants.to_instants(df, "t", "z", "o", instants.zone_tables(spark, list(zones), instants.years_used(df, "t")))
    return {r.id: (r.epoch_ms, r.time_kind) for r in out.collect()}


def ms(*args, zone=timezone.utc, fold=0):
    return int(datetime(*args, tzinfo=zone, fold=fold).timestamp() * 1000)


def test_instants(spark):
    berlin, b = ZoneInfo("Europe/Berlin"), "Europe/Berlin"
    cases = [
        (("2022-10-30 02:30:00", b, "dmy"), ms(2022, 10, 30, 0, 30)), (("2022-10-30 02:30:00 CET", b, "dmy"), ms(2022, 10, 30, 1, 30)), (("2022-10-30 02:30:00 CEST", b, None), ms(2022, 10, 30, 0, 30)), (("2022-03-27 02:30:00", b, "dmy"), ms(2022, 3, 27, 1, 30)),
        (("20220115", b, None), ms(2022, 1, 15, zone=berlin)), (("202201151954", b, None), ms(2022, 1, 15, 19, 54, zone=berlin)), (("20220115195401Z", None, None), ms(2022, 1, 15, 19, 54, 1)), (("20140620080011+1000", None, None), ms(2014, 6, 19, 22, 0, 11)),
        (("1642650824", None, None), 1642650824000), (("1642246927714", None, None), 1642246927714), (("2022-01-21T16:36:16.204397Z", None, None), ms(2022, 1, 21, 16, 36, 16) + 204), (("05/01/2022 1:06:16 AM", b, "mdy"), ms(2022, 5, 1, 1, 6, 16, zone=berlin)),
        (("05/01/2022 12:06:16 AM", "UTC", "dmy"), ms(2022, 1, 5, 0, 6, 16)), (("2022/02/13 12:47:48 PM", "UTC", "ymd"), ms(2022, 2, 13, 12, 47, 48)), (("Tue, 18 Jan 2022 06:49:46 GMT", None, None), ms(2022, 1, 18, 6, 49, 46)), (("5 February 2022 22:10", "UTC", None), ms(2022, 2, 5, 22, 10)),
        (("2022-01-16T08:47:36[America/New_York]", b, None), ms(2022, 1, 16, 13, 47, 36)), (("2022-01-16T08:47:36 America/New_York", None, None), ms(2022, 1, 16, 13, 47, 36)), (("2022-01-16t08:47:36z ", None, None), ms(2022, 1, 16, 8, 47, 36)), (("2022-01-16 08:47:36 EST", "America/New_York", None), ms(2022, 1, 16, 13, 47, 36)),
        (("2022-01-16T08:47:36-0530", None, None), ms(2022, 1, 16, 14, 17, 36)), (("14.01.2022 13:00:42", "UTC", "mdy"), ms(2022, 1, 14, 13, 0, 42)), (("2022-04-03 02:00:00", "Australia/Lord_Howe", None), ms(2022, 4, 2, 15, 30)), (("2022-04-03 01:45:00", "Australia/Lord_Howe", None), ms(2022, 4, 2, 14, 45)),
        (("2022-13-01T00:00:00Z", b, "dmy"), None), (("2022-02-30 00:00:00", b, "dmy"), None), (("2022-01-01T25:00:00Z", b, "dmy"), None), (("2022-01-01 10:00:60", b, "dmy"), None), (("2022-01-01 10:00:00", None, "dmy"), None), (("2022-01-01 10:00:00 XYZ", b, "dmy"), None),
        (("", b, "dmy"), None), (("-", b, "dmy"), None), ((None, b, "dmy"), None), (("13/14/2022 10:00:00", b, "dmy"), None), (("2022-01-01 10:00:00[No/Where]", b, None), None), (("01/02/2022 10:00:00", b, None), None), (("x" * 50_000, b, "dmy"), None),
    ]
    got = instant(spark, [c for c, _ in cases])
    assert [(c[0][:40] if c[0] else c[0], got[i][0]) for i, (c, _) in enumerate(cases)] == [(c[0][:40] if c[0] else c[0], want) for c, want in cases]
    assert [got[i][1] for i in (0, 1, 3)] == ["ambiguous", "offset", "skipped"]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe"])
def test_every_local_hour_of_a_year_agrees_with_the_library(spark, zone):
    info, start = ZoneInfo(zone), datetime(2021, 1, 1)
    times = [start + timedelta(minutes=30 * k) for k in range(365 * 48)]
    got = instant(spark, [(t.strftime("%Y-%m-%d %H:%M:%S"), zone, None) for t in times], (zone,))
    for i, t in enumerate(times):
        early, late = (int(t.replace(tzinfo=info, fold=f).timestamp() * 1000) for f in (0, 1))
        skipped = datetime.fromtimestamp(early / 1000, info).replace(tzinfo=None) != t
        assert got[i][0] == early, (t, got[i])
        assert got[i][1] == ("skipped" if skipped else "ambiguous" if early != late else "unique")


def test_empty_tables(spark):
    df = spark.createDataFrame([], "t string, z string, o string")
    assert instants.to_instants(df, "t", "z", "o", instants.zone_tables(spark, ["UTC"])).count() == 0


def test_years_far_from_now_and_abbreviations_of_their_time(spark):
    """Any year is read with its own offsets, and an abbreviation means what it meant then."""
    berlin, moscow = "Europe/Berlin", "Europe/Moscow"
    rows = [("1955-06-01 12:00:00", berlin, None), ("2065-06-01 12:00:00", berlin, None), ("2012-06-01 12:00:00 MSK", moscow, None), ("2016-06-01 12:00:00 MSK", moscow, None), ("2016-06-01 12:00:00 MSD", moscow, None), ("2012-01-01 12:00:00 CEST", berlin, None), ("1850-06-01 12:00:00", berlin, None)]
    got = instant(spark, rows, (berlin, moscow))
    local = lambda *a: ms(*a, zone=ZoneInfo(berlin))
    want = [local(1955, 6, 1, 12), local(2065, 6, 1, 12), ms(2012, 6, 1, 8), ms(2016, 6, 1, 9), ms(2016, 6, 1, 8), ms(2012, 1, 1, 10), local(1850, 6, 1, 12)]
    assert [got[i][0] for i in range(len(rows))] == want


def test_line_breaks_and_private_signs_survive(spark):
    line = '"a\n\rb",7,response,u,<urn:uuid:00000000-0000-0000-0000-000000000000>,t,-'
    df = spark.createDataFrame([(1, "f", 1, line)], "line_id bigint, file_name string, line_no bigint, line string")
    assert rejects.parse_index_lines(df).head().filename == "a\n\rb"
