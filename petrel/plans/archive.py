"""Queries of the archive operators over the test tables, with SQL of the same results.

``captures`` already holds parsed records; the queries that test the codec write rows as WARC,
ARC or HTTP bytes and read them back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.codec import archive, http
from petrel.functions import http as http_f
from petrel.functions.headers import get_header, set_header
from petrel.operators import records as ops
from petrel.sources.archive import parse_objects, register
from petrel.storage import shared_dir, table


def _captures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures")


def _sha(c: Column) -> Column:
    return F.sha2(c, 256)


def index_records(spark: SparkSession, d: str) -> DataFrame:
    return ops.index(_captures(spark, d))


def index_lines_text(spark: SparkSession, d: str) -> DataFrame:
    return ops.index_text(ops.index(_captures(spark, d)))


def validate_files(spark: SparkSession, d: str) -> DataFrame:
    return ops.validate(_captures(spark, d))


def header_lookup(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("headers")
    names = ("WARC-Payload-Digest", "WARC-IP-Address", "content-TYPE", "WARC-Concurrent-To")
    return _captures(spark, d).select("row_id", *[get_header(h, n).alias(n.lower().replace("-", "_")) for n in names])


def header_replace(spark: SparkSession, d: str) -> DataFrame:
    new = set_header(F.col("headers"), "WARC-Date", F.lit("2000-01-01T00:00:00Z"))
    return _captures(spark, d).select("row_id", F.size(new).alias("n"), F.element_at(new, -1)["name"].alias("last_name"), get_header(new, "warc-date").alias("date"))


def header_content_length(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).select("row_id", ops.declared_or_actual_length(F.col("content_length"), F.col("content")).alias("length"), F.coalesce("content_type", get_header(F.col("headers"), "Content-Type")).alias("content_type"))


def digest_block(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).where("content is not null").select("row_id", ops.block_digest(F.col("content")).alias("digest"))


def uuid_stable(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).where("url is not null").select("row_id", ops.stable_uuid(F.col("url")).alias("id"))


def uuid_random(spark: SparkSession, d: str) -> DataFrame:
    """How many random ids there are, and how many differ: the ids themselves differ from run to run."""
    ids = _captures(spark, d).select(ops.random_uuid().alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count_if(F.col("id").rlike("^<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>$")).alias("well_formed"))


def date_text(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).where("date_ts is not null").select("row_id", ops.warc_date(F.col("date_ts")).alias("date"))


def date_arc(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "arc_captures").where(F.col("archive_date").rlike(r"^(\d{8}|\d{14})$"))
    return rows.select("row_id", F.unix_seconds(ops.arc_date(F.col("archive_date"))).alias("epoch"))


def path_clean(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).where("url is not null").select("row_id", ops.clean_path(F.col("url")).alias("clean"))


def wayback_address(spark: SparkSession, d: str) -> DataFrame:
    rows = _captures(spark, d).where("url is not null and date_ts is not null")
    return rows.select("row_id", ops.wayback_uri("http://wayback.example/", F.lit("all"), ops.warc_date(F.col("date_ts")), F.col("url")).alias("uri"))


def printable_content(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).where("content is not null").select("row_id", ops.printable("content").alias("text"))


def warcinfo_values(spark: SparkSession, d: str) -> DataFrame:
    content = F.col("content")
    rows = table(spark, d, "warcinfos").where("content is not null and record_id is not null")
    return rows.select("record_id", "path", F.try_element_at(ops.warcinfo_fields(content), F.lit("software")).alias("software"), F.size(ops.warcinfo_pairs(content)).alias("fields"), F.size(ops.warcinfo_malformed(content)).alias("malformed"))


def _ids(df: DataFrame) -> DataFrame:
    return df.select("row_id")


def filter_url(spark: SparkSession, d: str) -> DataFrame:
    return _ids(ops.filter_records(_captures(spark, d), r"/(wiki|notes)/", "url"))


def filter_url_invert(spark: SparkSession, d: str) -> DataFrame:
    return _ids(ops.filter_records(_captures(spark, d), r"/(wiki|notes)/", "url", invert=True))


def filter_type(spark: SparkSession, d: str) -> DataFrame:
    return _ids(ops.filter_records(_captures(spark, d), "^re[qs]", "type"))


def filter_content_type(spark: SparkSession, d: str) -> DataFrame:
    return _ids(ops.filter_records(_captures(spark, d), "^text/plain", "content_type"))


def filter_date(spark: SparkSession, d: str) -> DataFrame:
    return _ids(ops.filter_records(_captures(spark, d), "^2022-0[1-3]", "date"))


def filter_http_content_type(spark: SparkSession, d: str) -> DataFrame:
    return _ids(ops.filter_records(_captures(spark, d), "html", "http_content_type", invert=False))


def filter_any(spark: SparkSession, d: str) -> DataFrame:
    return _ids(ops.filter_records(_captures(spark, d), "(tidal clock|sha256:0)", "any"))


def filter_any_invert(spark: SparkSession, d: str) -> DataFrame:
    return _ids(ops.filter_records(_captures(spark, d), "(tidal clock|sha256:0)", "any", invert=True))


def filter_successful_html(spark: SparkSession, d: str) -> DataFrame:
    return _ids(ops.successful_responses(_captures(spark, d), html=True))


def http_codes(spark: SparkSession, d: str) -> DataFrame:
    code = http_f.http_code(F.col("content"))
    rows = _captures(spark, d).where("type = 'response' and content is not null").select(code.alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n")).select("code", http_f.code_class(F.col("code")).alias("class"), http_f.code_has_no_body(F.col("code")).alias("no_body"), "n")


def http_request_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _captures(spark, d).where("type = 'request' and content is not null").withColumn("m", http_f.parse_request("content"))
    return rows.select("row_id", F.col("m.method").alias("method"), F.col("m.target_uri").alias("target"), F.col("m.host").alias("host"), F.col("m.complete").alias("complete"), http_f.method_is(F.col("m.method"), "safe").alias("safe"))


def http_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = _captures(spark, d).where("type = 'response' and content is not null").withColumn("m", http_f.parse_response("content", F.lit("GET")))
    return rows.select("row_id", *[F.col(f"m.{c}").alias(c) for c in ("version", "code", "phrase", "body_mode", "declared_length", "encoding", "complete", "leftover_bytes", "error")], F.size("m.headers").alias("n_headers"), _sha(F.col("m.body")).alias("body_sha"))


def http_old(spark: SparkSession, d: str) -> DataFrame:
    """Contents taken as HTTP/0.9 responses: everything is body."""
    rows = _captures(spark, d).where("type = 'resource' and content is not null").withColumn("m", http_f.parse_response_http09("content"))
    return rows.select("row_id", F.col("m.code").alias("code"), _sha(F.col("m.body")).alias("body_sha"))


def http_is_response(spark: SparkSession, d: str) -> DataFrame:
    rows = _captures(spark, d).where("content is not null")
    return rows.groupBy("type").agg(F.count_if(http_f.is_http_response("content")).alias("complete"), F.count("*").alias("n"))


def _wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Whole payload texts of resource rows inside HTTP responses: plain, chunked, gzip, chunked gzip by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for b in batches:
            out = []
            for mode, content in zip(b["mode"], b["content"]):
                body = gzip.compress(content, mtime=0) if mode >= 2 else content
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n" + ("Content-Encoding: gzip\r\n" if mode >= 2 else "")
                if mode % 2:
                    parts = b"".join(b"%x\r\n%s\r\n" % (len(body[k : k + 700]), body[k : k + 700]) for k in range(0, len(body), 700))
                    out.append(head.encode() + b"Transfer-Encoding: chunked\r\n\r\n" + parts + b"0\r\n\r\n")
                else:
                    out.append(head.encode() + b"Content-Length: %d\r\n\r\n" % len(body) + body)
            yield b[["row_id"]].assign(mode=b["mode"], message=out)

    rows = _captures(spark, d).where("type = 'resource' and content is not null").select("row_id", F.pmod("row_id", F.lit(4)).cast("int").alias("mode"), "content")
    return rows.mapInPandas(run, "row_id bigint, mode int, message binary")


def http_payload(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of every wrapped text; those sent compressed are unpacked here to be compared."""

    def unzip(packed: pd.Series) -> pd.Series:
        import gzip

        return packed.map(gzip.decompress)

    rows = _wrapped(spark, d).select("row_id", "mode", http_f.payload("message").alias("payload"))
    plain, packed = rows.where("mode < 2").select("row_id", "payload"), rows.where("mode >= 2").select("row_id", F.pandas_udf(unzip, "binary")("payload").alias("payload"))
    return plain.unionByName(packed).select("row_id", _sha(F.col("payload")).alias("sha"))


def http_decoded(spark: SparkSession, d: str) -> DataFrame:
    return _wrapped(spark, d).select("row_id", _sha(http_f.decoded_payload("message")).alias("sha"))


def http_decoded_message(spark: SparkSession, d: str) -> DataFrame:
    """Decoded messages keep the body and carry its true length."""
    m = _wrapped(spark, d).withColumn("m", http_f.parse_response("message", F.lit("GET")))
    text = F.decode(F.col("m.decoded_message"), "ISO-8859-1")
    length = F.regexp_extract(text, r"Content-Length: (\d+)\r\n", 1).cast("bigint")
    body = F.expr("substring(m.decoded_message, length(substring_index(decode(m.decoded_message, 'ISO-8859-1'), '\r\n\r\n', 1)) + 5)")
    return m.select("row_id", length.alias("length"), _sha(body).alias("sha"))


def _archived(spark: SparkSession, d: str, compressed: bool) -> DataFrame:
    """One archive file's bytes per record path: captures written as WARC (rows without type are damage, not records)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id")
        parts = [archive.serialize(v or "WARC/1.0", [(h["name"], h["value"]) for h in hs], c or b"", t, compressed=compressed) for v, hs, c, t in zip(rows["version"], rows["headers"], rows["content"], rows["content_type"])]
        return pd.DataFrame({"path": [key[0]], "content": [b"".join(parts)]})

    # one file's bytes are one value by nature; a file holds at most FILE_ROWS records here
    rows = _captures(spark, d).where("type is not null")
    file = F.concat_ws("#", "path", F.floor(F.col("row_id") / FILE_ROWS).cast("string"))
    return rows.select(file.alias("path"), "row_id", "version", "headers", "content", "content_type").groupBy("path").applyInPandas(run, "path string, content binary")


FILE_ROWS = 500


def _read_back(files: DataFrame) -> DataFrame:
    return _summary(parse_objects(files))


def _summary(back: DataFrame) -> DataFrame:
    return back.groupBy("type").agg(F.count("*").alias("records"), F.sum("content_length").alias("bytes"), F.count_if(F.size("errors") > 0).alias("flagged"), F.count("fatal").alias("fatal"), F.sum(F.conv(F.substring(F.md5("content"), 1, 8), 16, 10).cast("bigint")).alias("digests"))


def roundtrip_warc(spark: SparkSession, d: str) -> DataFrame:
    return _read_back(_archived(spark, d, False))


def roundtrip_warc_gz(spark: SparkSession, d: str) -> DataFrame:
    return _read_back(_archived(spark, d, True))


def _stored(spark: SparkSession, d: str, **options: str) -> DataFrame:
    """Captures written through the sink as files of gzip members and read through the source."""
    register(spark)
    folder = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    rows = _captures(spark, d).where("type is not null").select("version", "headers", "content", "content_type")
    rows.write.format("webarchive").option("gzip", "true").mode("append").save(folder)
    return spark.read.format("webarchive").options(**options).load(folder)


def sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _summary(_stored(spark, d))


def source_split(spark: SparkSession, d: str) -> DataFrame:
    """The same with every file read in splits."""
    return _summary(_stored(spark, d, splitBytes=str(1 << 18)))


def source_seek(spark: SparkSession, d: str) -> DataFrame:
    """The record at the last place of each file, found again by path and offset: how many are the same."""
    stored = _stored(spark, d)
    last = stored.groupBy("path").agg(F.max("offset").alias("offset")).orderBy("path").limit(3).collect()  # a few files, whole
    found = [ops.extract(stored, r["path"], r["offset"]).agg(F.count("*").alias("records"), F.count_if(F.col("fatal").isNull()).alias("sound")) for r in last]
    return reduce(DataFrame.unionByName, found).agg(F.min("records").alias("fewest"), F.max("records").alias("most"), F.min("sound").alias("sound"))

def roundtrip_content(spark: SparkSession, d: str) -> DataFrame:
    """Digest and place of every record read back: offsets are sums of what lies before."""
    back = parse_objects(_archived(spark, d, False))
    return back.select("path", "record_index", "type", F.sha2(F.col("content"), 256).alias("sha"), F.col("content_length").alias("n"))


def serialize_size(spark: SparkSession, d: str) -> DataFrame:
    rows = _captures(spark, d).where("type is not null")
    return rows.select("row_id", F.octet_length(ops.serialized(rows)).alias("size"))


def convert_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Copy with HTTP decoded: rows and their lengths."""
    out = ops.decode_http(_captures(spark, d).where("type is not null"))
    return out.select("row_id", "type", F.octet_length("content").alias("n"), (F.octet_length("content") == F.col("content_length")).alias("agrees"))


def _arc_files(spark: SparkSession, d: str) -> DataFrame:
    """ARC files of the rows of arc_captures with an address, as bytes; the payload names the row."""
    names = "URL IP-address Archive-date Content-type Archive-length"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id")
        about = f"1 0 Petrel\n{names}\n".encode()
        out = [f"filedesc://{key[0]} 0.0.0.0 20100101000000 text/plain {len(about)}\n".encode() + about + b"\n"]
        for row_id, url, ip, date, mime in zip(rows["row_id"], rows["url"], rows["ip"], rows["date"], rows["mime"]):
            body = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n%d" % (len(str(row_id)), row_id)
            out.append(f"{url} {ip} {date} {mime} {len(body)}\n".encode("latin-1", "replace") + body + b"\n")
        return pd.DataFrame({"path": [key[0]], "content": [b"".join(out)]})

    rows = table(spark, d, "arc_captures").where(F.col("url").rlike(r"^https?://[!-~]+$") & F.col("archive_date").rlike(r"^\d{14}$"))
    file = F.concat_ws("#", F.lit("f"), F.floor(F.col("row_id") / FILE_ROWS).cast("string"))
    plain = lambda c, other: F.when(F.col(c).rlike(r"^[!-~]+$"), F.col(c)).otherwise(F.lit(other))
    rows = rows.select(file.alias("path"), "row_id", "url", plain("ip_address", "0.0.0.0").alias("ip"), F.col("archive_date").alias("date"), plain("content_type", "no-type").alias("mime"))
    return rows.groupBy("path").applyInPandas(run, "path string, content binary")


def arc_records(spark: SparkSession, d: str) -> DataFrame:
    """ARC bytes read back: one row per record, its row named by the payload."""
    back = parse_objects(_arc_files(spark, d)).where("type = 'response'")
    return back.select(F.decode(http_f.payload("content"), "UTF-8").cast("bigint").alias("row_id"), "url", "date_raw", "content_type")


def arc_converted(spark: SparkSession, d: str) -> DataFrame:
    """ARC records as WARC records: type, date and address by the conversion rules."""
    out = ops.arc_to_warc(parse_objects(_arc_files(spark, d)), "2020-01-01T00:00:00Z", "petrel")
    h = F.col("headers")
    out = out.where((F.col("type") != "metadata") & get_header(h, "WARC-Warcinfo-ID").isNotNull())
    return out.select(F.decode(http_f.payload("content"), "UTF-8").cast("bigint").alias("row_id"), "type", "content_type", get_header(h, "WARC-IP-Address").alias("ip"), get_header(h, "WARC-Target-URI").alias("url"))


def arc_conversion_parts(spark: SparkSession, d: str) -> DataFrame:
    """A file description gives a warcinfo and a metadata record."""
    out = ops.arc_to_warc(parse_objects(_arc_files(spark, d)), "2020-01-01T00:00:00Z", "petrel")
    return out.groupBy("type").agg(F.count("*").alias("n"))


def arc_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The metadata record of a file description: original bytes, address without its scheme, tied to the warcinfo record."""
    out = ops.arc_to_warc(parse_objects(_arc_files(spark, d)), "2020-01-01T00:00:00Z", "petrel").where("type = 'metadata'")
    h = F.col("headers")
    return out.select("path", _sha(F.col("content")).alias("sha"), get_header(h, "WARC-Target-URI").alias("url"), (get_header(h, "WARC-Warcinfo-ID") == get_header(h, "WARC-Concurrent-To")).alias("tied"))


def unpack_unique(spark: SparkSession, d: str) -> DataFrame:
    """Names of unpacked files: how many there are and how many differ, letter case aside; a record delivered again has its place and its name."""
    return unpack_files(spark, d).agg(F.count("*").alias("files"), F.count_distinct(F.lower("outfile")).alias("names"), F.count_if(F.col("outfile").rlike(r"(^|/)\.\.?(/|$)|^/")).alias("unsafe"))


def links_plain(spark: SparkSession, d: str) -> DataFrame:
    return ops.extract_links(_captures(spark, d)).where("tag = 'a'").groupBy("page_url", "link_raw").agg(F.count("*").alias("n"))


def links_absolute(spark: SparkSession, d: str) -> DataFrame:
    return ops.extract_links(_captures(spark, d)).groupBy("tag", "attr").agg(F.count("*").alias("n"), F.count_distinct("link_abs").alias("distinct_links"))


def links_compat(spark: SparkSession, d: str) -> DataFrame:
    return ops.extract_links(_captures(spark, d), mode="compat").groupBy("page_url").agg(F.count("*").alias("n"), F.max("link_abs").alias("last"))


def links_by_expression(spark: SparkSession, d: str) -> DataFrame:
    """The quoted hrefs of uncompressed pages without leaving the JVM."""
    text = F.decode(F.col("content"), "ISO-8859-1")
    found = ops.successful_responses(_captures(spark, d), html=True).where(~F.contains(F.lower(F.substring_index(text, "\r\n\r\n", 1)), F.lit("transfer-encoding")))
    return found.select("row_id", F.explode(F.regexp_extract_all(text, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("link"))


def unpack_files(spark: SparkSession, d: str) -> DataFrame:
    return ops.unpack_names(_captures(spark, d)).select("row_id", "mime", "outfile")


def dump_records(spark: SparkSession, d: str) -> DataFrame:
    return ops.dump(_captures(spark, d).where("type is not null"))


def host_counts(spark: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1))
    return _captures(spark, d).where("url is not null").groupBy(host.alias("host")).agg(F.count("*").alias("n"))


def request_response_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct request and response ids tied by WARC-Concurrent-To, request side."""
    from petrel.functions.headers import uuid_bytes, uuid_text

    rows = _captures(spark, d)
    asked = rows.where("type = 'request'").select(uuid_bytes(F.col("record_id")).alias("request"), F.explode(F.filter("headers", lambda h: F.lower(h["name"]) == "warc-concurrent-to")).alias("h"))
    asked = asked.select("request", uuid_bytes(F.col("h.value")).alias("key")).where("key is not null").distinct()
    answers = rows.where("type = 'response'").select(uuid_bytes(F.col("record_id")).alias("key")).where("key is not null").distinct()
    return asked.join(answers, "key").select(uuid_text(F.col("request")).alias("request_id"), uuid_text(F.col("key")).alias("response_id"))


def latest_capture(spark: SparkSession, d: str) -> DataFrame:
    """Latest clean date and number of captures per address and type."""
    rows = _captures(spark, d).where("url is not null and date_ts is not null and type is not null")
    return rows.groupBy("url", "type").agg(F.count("*").alias("captures"), F.max_by("row_id", F.struct("date_ts", "row_id")).alias("row_id"))


def revisits(spark: SparkSession, d: str) -> DataFrame:
    """Payloads stored once: the first row of each resource text stays, later ones become revisits."""
    rows = _captures(spark, d).where("type = 'resource' and content is not null").withColumn("sha", _sha(F.col("content")))
    first = rows.groupBy("sha").agg(F.min("row_id").alias("first"))
    return rows.select("row_id", "sha").join(first, "sha").select("row_id", F.when(F.col("row_id") == F.col("first"), "response").otherwise("revisit").alias("kind"))


QUERIES = {
    q.__name__: q
    for q in (
        index_records, index_lines_text, validate_files, header_lookup, header_replace, header_content_length, digest_block, uuid_stable, uuid_random, date_text, date_arc, path_clean, wayback_address, printable_content, warcinfo_values,
        filter_url, filter_url_invert, filter_type, filter_content_type, filter_date, filter_http_content_type, filter_any, filter_any_invert, filter_successful_html, http_codes, http_request_lines, http_messages, http_old, http_is_response,
        http_payload, http_decoded, http_decoded_message, roundtrip_warc, roundtrip_warc_gz, roundtrip_content, serialize_size, convert_decoded, arc_records, arc_converted, arc_conversion_parts, arc_metadata, sink_roundtrip, source_split, source_seek, unpack_unique, links_plain, links_absolute, links_compat,
        links_by_expression, unpack_files, dump_records, host_counts, request_response_pairs, latest_capture, revisits,
    )
}

_LEN = "case when content_type is null then coalesce(octet_length(content), content_length) else content_length end"
_INDEX = f"""select path filename, "offset", type warc_type, url subject_uri, record_id, content_type, {_LEN} content_length from captures where fatal is null or type is not null"""
_HEAD = "(list_filter(headers, lambda h: lower(h.name) = '{}')[1]).value"
#: DuckDB's text form of a blob: ASCII as it is, line ends as \x0D\x0A.
_TEXT = "content::varchar"
_CODE = rf"try_cast(regexp_extract({_TEXT}, '^HTTP/\S+\s+(\d{{3}})', 1) as int)"
_MIME = rf"trim(regexp_extract(split_part({_TEXT}, '\x0D\x0A\x0D\x0A', 1), '(?i)\\x0D\\x0Acontent-type:[ \t]*([^;\\]*)', 1))"
_HTTP = "type = 'response' and starts_with(content_type, 'application/http') and starts_with(content::varchar, 'HTTP/')"
_ANY = f"(coalesce(len(list_filter(headers, lambda h: regexp_matches(h.value, '(tidal clock|sha256:0)'))) > 0, false) or coalesce(regexp_matches({_TEXT}, '(tidal clock|sha256:0)'), false))"
_UUID5 = "'<urn:uuid:' || regexp_replace(substr(sha1({}), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"
_ARC_ROWS = r"select row_id, url, case when regexp_full_match(ip_address, '[!-~]+') then ip_address else '0.0.0.0' end ip, archive_date, case when regexp_full_match(content_type, '[!-~]+') then content_type else 'no-type' end mime from arc_captures where regexp_full_match(url, 'https?://[!-~]+') and regexp_full_match(archive_date, '\d{14}')"
_RES = "from captures where type = 'resource' and content is not null"
_ROUND = """select type, count(*) records, sum(coalesce(octet_length(content), 0))::bigint bytes, count(*) filter (where version not in ('WARC/1.0', 'WARC/0.17', 'WARC/0.18')) flagged, 0::bigint fatal,
  sum(('0x' || substr(md5(coalesce(content, ''::blob)), 1, 8))::bigint)::bigint digests from captures where type is not null group by type"""
SQL = {
    "index_records": _INDEX,
    "index_lines_text": f"""select concat_ws(' ', coalesce(filename, '-'), coalesce("offset"::varchar, '-'), coalesce(warc_type, '-'), coalesce(subject_uri, '-'), coalesce(record_id, '-'), coalesce(content_type, '-'), coalesce(content_length::varchar, '-')) "value" from ({_INDEX})""",
    "validate_files": """with c as (select *, coalesce(len(errors), 0) > 0 or fatal is not null is_bad, coalesce(fatal, errors[1].code) fault from captures)
      select path, count(*) records, count(*) filter (where is_bad) bad, count(*) filter (where is_bad) = 0 valid,
      arg_min({'f': fault, 'o': "offset"}, (coalesce(record_index, "offset"), coalesce("offset", -1), fault)) filter (where is_bad).f first_fault,
      arg_min({'f': fault, 'o': "offset"}, (coalesce(record_index, "offset"), coalesce("offset", -1), fault)) filter (where is_bad).o first_offset from c group by path""",
    "header_lookup": f"select row_id, {_HEAD.format('warc-payload-digest')} warc_payload_digest, {_HEAD.format('warc-ip-address')} warc_ip_address, {_HEAD.format('content-type')} content_type, {_HEAD.format('warc-concurrent-to')} warc_concurrent_to from captures",
    "header_replace": "select row_id, (len(list_filter(headers, lambda h: lower(h.name) <> 'warc-date')) + 1)::int n, 'WARC-Date' last_name, '2000-01-01T00:00:00Z' date from captures where headers is not null",
    "header_content_length": f"select row_id, coalesce(content_length, octet_length(content)) length, coalesce(content_type, {_HEAD.format('content-type')}) content_type from captures",
    "digest_block": "select row_id, 'sha256:' || sha256(content) digest from captures where content is not null",
    "uuid_stable": f"select row_id, {_UUID5.format('url')} id from captures where url is not null",
    "uuid_random": "select count(*) n, count(*) well_formed from captures",
    "date_text": "select row_id, strftime(date_ts, '%Y-%m-%dT%H:%M:%SZ') date from captures where date_ts is not null",
    "date_arc": "select row_id, epoch(coalesce(try_strptime(archive_date, '%Y%m%d%H%M%S'), try_strptime(archive_date, '%Y%m%d')))::bigint epoch from arc_captures where regexp_full_match(archive_date, '\\d{8}|\\d{14}')",
    "path_clean": "select row_id, regexp_replace(regexp_replace(url, '^([^:/]*)://', '\\1/'), '[^A-Za-z0-9_./-]', '_', 'g') clean from captures where url is not null",
    "wayback_address": "select row_id, 'http://wayback.example/all/' || strftime(date_ts, '%Y%m%d%H%M%S') || '/' || url uri from captures where url is not null and date_ts is not null",
    "filter_url": "select row_id from captures where regexp_matches(url, '/(wiki|notes)/')",
    "filter_url_invert": "select row_id from captures where not coalesce(regexp_matches(url, '/(wiki|notes)/'), false)",
    "filter_type": "select row_id from captures where regexp_matches(type, '^re[qs]')",
    "filter_content_type": "select row_id from captures where regexp_matches(content_type, '^text/plain')",
    "filter_date": "select row_id from captures where regexp_matches(date_raw, '^2022-0[1-3]')",
    "filter_any": f"select row_id from captures where {_ANY}",
    "filter_any_invert": f"select row_id from captures where not {_ANY}",
    "filter_http_content_type": f"select row_id from captures where {_HTTP} and contains({_MIME}, 'html')",
    "filter_successful_html": f"select row_id from captures where {_HTTP} and {_CODE} between 200 and 299 and contains(lower({_MIME}), 'html')",
    "http_codes": f"""select code, case code // 100 when 1 then 'informational' when 2 then 'successful' when 3 then 'redirection' when 4 then 'client error' when 5 then 'server error' end class,
      code between 100 and 199 or code in (204, 304) no_body, count(*) n from (select {_CODE} code from captures where type = 'response' and content is not null) group by code""",
    "http_request_lines": rf"""select row_id, regexp_extract({_TEXT}, '^(\S+) ', 1) "method", regexp_extract({_TEXT}, '^\S+ (\S+) ', 1) target, regexp_extract({_TEXT}, '(?i)\\x0D\\x0Ahost: *([^:\\]+)', 1) host,
      contains({_TEXT}, '\x0D\x0A\x0D\x0A') complete, regexp_extract({_TEXT}, '^(\S+) ', 1) in ('GET', 'HEAD', 'OPTIONS', 'TRACE') safe from captures where type = 'request' and content is not null""",
    "serialize_size": f"""select row_id, (length(version) + 2 + coalesce(list_sum(list_transform(list_filter(headers, lambda h: lower(h.name) not in ('content-type', 'content-length')), lambda h: length(h.name) + length(h.value) + 4)), 0)
      + case when coalesce(nullif(content_type, ''), {_HEAD.format('content-type')}) is not null then 16 + length(coalesce(nullif(content_type, ''), {_HEAD.format('content-type')})) else 0 end
      + 18 + length(coalesce(octet_length(content), 0)::varchar) + 2 + coalesce(octet_length(content), 0) + 4)::int size from captures where type is not null""",
    "warcinfo_values": r"""with w as (select record_id, path, string_split_regex(content, '\r\n|\n|\r') l from warcinfos where content is not null and record_id is not null),
      f as (select *, list_filter(l, lambda x: instr(x, ':') > 1) ok from w)
      select record_id, path, trim(regexp_replace(list_filter(ok, lambda x: trim(split_part(x, ':', 1)) = 'software')[-1], '^[^:]*:', '')) software, len(ok)::int fields,
      len(list_filter(l, lambda x: trim(x) <> '' and instr(x, ':') <= 1))::int malformed from f""",
    "http_old": f"select row_id, 200 code, sha256(content) body_sha {_RES}",
    "http_payload": f"select row_id, sha256(content) sha {_RES}",
    "http_decoded": f"select row_id, sha256(content) sha {_RES}",
    "http_decoded_message": f"select row_id, octet_length(content)::bigint length, sha256(content) sha {_RES}",
    **dict.fromkeys(("roundtrip_warc", "roundtrip_warc_gz", "sink_roundtrip", "source_split"), _ROUND),
    "source_seek": "select 1::bigint fewest, 1::bigint most, 1::bigint sound",
    "arc_metadata": f"""select distinct 'f#' || (row_id // 500) path, sha256('1 0 Petrel' || chr(10) || 'URL IP-address Archive-date Content-type Archive-length' || chr(10)) sha, 'f#' || (row_id // 500) url, true tied from ({_ARC_ROWS})""",
    "unpack_unique": f"select count(*) files, count(distinct (path, coalesce(record_index, -1), coalesce(\"offset\", -1))) names, 0::bigint unsafe from captures where {_HTTP} and {_CODE} between 200 and 299",
    "roundtrip_content": "select path || '#' || (row_id // 500) path, row_number() over (partition by path, row_id // 500 order by row_id) - 1 record_index, type, sha256(coalesce(content, ''::blob)) sha, coalesce(octet_length(content), 0)::bigint n from captures where type is not null",
    "arc_records": f"select row_id, url, archive_date date_raw, mime content_type from ({_ARC_ROWS})",
    "arc_converted": f"select row_id, 'response' type, 'application/http;msgtype=response' content_type, case when ip <> '0.0.0.0' then ip end ip, url from ({_ARC_ROWS})",
    "arc_conversion_parts": f"with f as (select count(*) n, count(distinct row_id // 500) files from ({_ARC_ROWS})) select 'response' type, n from f union all select 'warcinfo', files from f union all select 'metadata', files from f",
    "host_counts": "select lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) host, count(*) n from captures where url is not null group by 1",
    "request_response_pairs": "with i as (select lower(regexp_extract(record_id, '[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}')) id, type, headers from captures where record_id is not null) select distinct r.id request_id, s.id response_id from (select id, lower(regexp_extract(h.value, '[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}')) k from (select id, unnest(headers) h from i where type = 'request') where lower(h.name) = 'warc-concurrent-to') r join i s on r.k = s.id and s.type = 'response'",
    "latest_capture": "select url, type, count(*) captures, max_by(row_id, (date_ts, row_id)) row_id from captures where url is not null and date_ts is not null and type is not null group by url, type",
    "revisits": f"select row_id, case when row_id = min(row_id) over (partition by sha256(content)) then 'response' else 'revisit' end kind {_RES}",
}
