"""Queries of the general training-data problems (3, 4, 6) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.operators import instants, references, rejects
from petrel.storage import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    captures, infos, gone = (table(spark, d, t) for t in ("captures", "warcinfos", "takedowns"))
    return references.dangling_references(captures, [captures, infos], gone).select("row_id", "ref_field", "ref_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references per header and month of arrival."""
    captures, infos, gone = (table(spark, d, t) for t in ("captures", "warcinfos", "takedowns"))
    return references.orphan_report(captures, [captures, infos], gone, F.date_format("ingested_at", "yyyy-MM"))


def p3_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Keys with positive references and zero existence in the running sums."""
    captures, infos, gone = (table(spark, d, t) for t in ("captures", "warcinfos", "takedowns"))
    state = references.orphan_state(captures, [captures, infos], gone)
    return state.where((F.col("refs") > 0) & (F.col("existing") <= 0))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_index_lines(table(spark, d, "index_lines")).where(F.col("reason").isNotNull()).select("line_id")


def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = rejects.parse_index_lines(table(spark, d, "index_lines")).where(F.col("reason").isNull())
    return rows.select("line_id", *rejects.FIELDS)


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = rejects.parse_index_lines(table(spark, d, "index_lines")).where(F.col("reason").isNotNull())
    return rows.groupBy("file_name", "reason").agg(F.count("*").alias("lines"))


def _dates(spark: SparkSession, d: str) -> DataFrame:
    parts = [("captures", "date_raw"), ("arc_captures", "archive_date")]
    both = [table(spark, d, t).select(F.lit(t).alias("tbl"), "row_id", F.col(c).alias("date_text"), "harvester_id") for t, c in parts]
    return both[0].unionByName(both[1])


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every date text that is not canonical, with its instant (or none) and how it was found."""
    texts = _dates(spark, d).where(~F.col("date_text").rlike(instants.CANONICAL))
    harvesters = table(spark, d, "harvesters").select("harvester_id", "time_zone", "date_order")
    zones, years = instants.regions_used(texts, "date_text", harvesters.select("time_zone")), instants.years_used(texts, "date_text")
    rows = texts.join(harvesters, "harvester_id", "left")
    return instants.to_instants(rows, "date_text", "time_zone", "date_order", instants.zone_tables(spark, zones, years))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_instants(spark, d).where(F.col("epoch_ms").isNotNull()).select("tbl", "row_id", "epoch_ms")


QUERIES = {q.__name__: q for q in (p3_found, p3_report, p3_orphans, p4_found, p4_valid, p4_reasons, p6_found, p6_instants)}

_UUID = "'([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})'"
_P3 = f"""
with refs as (
  select distinct row_id, batch_id, ingested_at, lower(h.name) n, lower(regexp_extract(h.value, {_UUID}, 1)) k
  from (select row_id, batch_id, ingested_at, unnest(headers) h from captures)
  where lower(h.name) in ('warc-concurrent-to', 'warc-refers-to', 'warc-warcinfo-id') and regexp_extract(h.value, {_UUID}, 1) <> ''
), held as (
  select k, min(batch_id) b, count(*) c from (
    select lower(regexp_extract(record_id, {_UUID}, 1)) k, batch_id from captures
    union all select lower(regexp_extract(record_id, {_UUID}, 1)), batch_id from warcinfos) where k <> '' group by k
), gone as (select distinct lower(regexp_extract(record_id, {_UUID}, 1)) k from takedowns where record_id is not null),
found as (
  select r.*, case when g.k is not null then 'withdrawn' when e.k is null then 'absent' when e.b > r.batch_id then 'later' end reason,
    case r.n when 'warc-concurrent-to' then 'WARC-Concurrent-To' when 'warc-refers-to' then 'WARC-Refers-To' else 'WARC-Warcinfo-ID' end ref_field
  from refs r left join held e using (k) left join gone g using (k))
"""
_P4 = r"""
with kept as (select *, regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', 's') quoted
  from index_lines where trim(line) <> '' and line not like '#%'),
cells as (select *, case when quoted then list_transform(regexp_extract_all(line, '(?:^|,)("(?:[^"]|"")*"|[^",]*)', 1, 's'),
  lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) end f from kept),
fit as (select *, len(f) n, coalesce(regexp_full_match(f[2], '[0-9]+') and try_cast(f[2] as bigint) is not null, false) ok2,
  coalesce(f[3] in ('warcinfo', 'response', 'request', 'revisit', 'metadata', 'conversion', 'resource'), false) ok3,
  coalesce(regexp_full_match(f[5], '<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}>', 'i'), false) ok5,
  coalesce(f[7] = '-' or (regexp_full_match(f[7], '[0-9]+') and try_cast(f[7] as bigint) is not null), false) ok7 from cells),
judged as (select *, case when not quoted then 'quoting' when n <> 7 then 'fields: ' || n when not ok2 then 'offset' when not ok3 then 'warc_type'
  when not ok5 then 'record_id' when not ok7 then 'content_length' end reason from fit)
"""
SQL = {
    "p3_found": _P3 + "select row_id, ref_field, k ref_id from found where reason is not null",
    "p3_report": _P3 + "select ref_field, strftime(ingested_at, '%Y-%m') period, reason, count(*) refs from found where reason is not null group by all",
    "p3_orphans": _P3 + "select r.k record_uuid, count(*) refs, 0::bigint existing from refs r left join held e using (k) left join gone g using (k) where e.k is null or g.k is not null group by r.k",
    "p4_found": _P4 + "select line_id from judged where reason is not null",
    "p4_valid": _P4 + """select line_id, f[1] filename, f[2]::bigint "offset", f[3] warc_type, nullif(f[4], '-') subject_uri, f[5] record_id,
      nullif(f[6], '-') content_type, try_cast(nullif(f[7], '-') as bigint) content_length from judged where reason is null""",
    "p4_reasons": _P4 + "select file_name, reason, count(*) lines from judged where reason is not null group by all",
}
