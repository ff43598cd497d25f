"""Operators on rows of parsed records: index, filters, validity, payloads, links, conversion, unpacking.

Everything that can be an expression is one, so predicates and projections run inside the
JVM and only the needed columns are read; contents are parsed in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrel.codec import archive, http, links
from petrel.functions import http as http_f
from petrel.functions.headers import get_header

LATIN1 = "ISO-8859-1"
INDEX_COLUMNS = ("filename", "offset", "warc_type", "subject_uri", "record_id", "content_type", "content_length")


# --- scalar helpers ------------------------------------------------------------------------


def block_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def stable_uuid(value: Column) -> Column:
    """A record id that depends only on the value."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(F.sha1(value), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def random_uuid() -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))


def warc_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def arc_date(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def declared_or_actual_length(declared: Column, content: Column) -> Column:
    return F.coalesce(declared, F.octet_length(content).cast("bigint"))


def clean_path(url: Column) -> Column:
    """An address as a relative path: the first ``://`` becomes a slash, odd signs become underscores."""
    return F.regexp_replace(F.regexp_replace(url, "^([^:/]*)://", "$1/"), r"[^A-Za-z0-9_./-]", "_")


def wayback_uri(prefix: str, collection: Column, date: Column, url: Column) -> Column:
    return F.concat(F.lit(prefix), collection, F.lit("/"), F.translate(date, "TZ:-", ""), F.lit("/"), url)


def warcinfo_pairs(content: Column) -> Column:
    """``key: value`` lines as an array of pairs; lines without a colon are left out."""
    lines = F.split(content, r"\r\n|\n|\r")
    pairs = F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 1), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    return pairs


def warcinfo_fields(content: Column) -> Column:
    """Fields as a map; of a repeated key the last value holds."""
    pairs = warcinfo_pairs(content)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def warcinfo_malformed(content: Column) -> Column:
    """The lines that are neither blank nor a field."""
    return F.filter(F.split(content, r"\r\n|\n|\r"), lambda x: (F.trim(x) != "") & (F.instr(x, ":") <= 1))


def _printable(content: pd.Series) -> pd.Series:
    import re

    odd = re.compile(rb"[^\w\t |\\/]")
    return content.map(lambda c: None if c is None else odd.sub(lambda m: b"\\x%X" % m[0][0], bytes(c[:1024])).decode("latin-1"))


def printable(content: Column | str) -> Column:
    """The first 1024 bytes with every sign that is no word sign, blank, tab, pipe or slash escaped."""
    return F.pandas_udf(_printable, "string")(content)


# --- index, extraction, validity -----------------------------------------------------------


def index(records: DataFrame) -> DataFrame:
    """One row per record; without a content type the length is that of the stored content."""
    length = F.when(F.col("content_type").isNull(), F.coalesce(F.octet_length("content").cast("bigint"), F.col("content_length"))).otherwise(F.col("content_length"))
    return records.where(F.col("fatal").isNull() | F.col("type").isNotNull()).select(
        F.col("path").alias("filename"), "offset", F.col("type").alias("warc_type"), F.col("url").alias("subject_uri"), "record_id", "content_type", length.alias("content_length")
    )


def index_text(indexed: DataFrame) -> DataFrame:
    """Index rows as lines, ``-`` for null."""
    return indexed.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in INDEX_COLUMNS]).alias("value"))


def index_header() -> str:
    return "#" + " ".join(INDEX_COLUMNS)


def extract(records: DataFrame, path: str, offset: int) -> DataFrame:
    """The record at a place; both conditions reach the scan."""
    return records.where((F.col("path") == path) & (F.col("offset") == offset))


def is_valid() -> Column:
    return (F.coalesce(F.size("errors"), F.lit(0)) == 0) & F.col("fatal").isNull()


def validate(records: DataFrame) -> DataFrame:
    """Per file: records, bad records, whether all are valid, and the first fault in file order."""
    fault = F.struct(F.coalesce("fatal", F.try_element_at("errors", F.lit(1))["code"]).alias("fault"), F.col("offset").alias("at"))
    bad = ~is_valid()
    place = F.struct(F.coalesce("record_index", "offset"), F.coalesce("offset", F.lit(-1)), fault["fault"])
    out = records.groupBy("path").agg(F.count("*").alias("records"), F.count_if(bad).alias("bad"), F.min_by(F.when(bad, fault), F.when(bad, place)).alias("first"))
    return out.select("path", "records", "bad", (F.col("bad") == 0).alias("valid"), F.col("first.fault").alias("first_fault"), F.col("first.at").alias("first_offset"))


def dump(records: DataFrame) -> DataFrame:
    """A readable rendering of each record."""
    head = F.array_join(F.transform("headers", lambda h: F.concat(F.lit("\t"), h["name"], F.lit(":"), F.coalesce(h["value"], F.lit("")))), "\n")
    faults = F.array_join(F.transform("errors", lambda e: F.concat(F.lit("\t"), e["code"], F.lit(" "), F.array_join(e["args"], " "))), "\n")
    text = F.concat_ws(
        "\n", F.concat(F.lit("archive record at "), F.col("path"), F.lit(":"), F.coalesce(F.col("offset").cast("string"), F.lit("-"))), F.lit("Headers:"), head, F.when(F.size("errors") > 0, F.concat(F.lit("Errors:\n"), faults)),
        F.concat(F.lit("Content Headers:\n\t"), F.coalesce("content_type", F.lit("-")), F.lit(" : "), F.coalesce(F.col("content_length").cast("string"), F.lit("-"))), F.lit("Content:"), F.concat(F.lit("\t"), F.coalesce(printable("content"), F.lit(""))),
    )
    return records.select("path", "offset", text.alias("text"))


# --- filters -------------------------------------------------------------------------------


def matches(value: Column, pattern: str, invert: bool = False) -> Column:
    """Regular expression search with ``\\n`` as the only line end; a missing value matches nothing, so it stays if inverted."""
    return F.coalesce(F.rlike(value, F.lit(f"(?d){pattern}")), F.lit(False)) != F.lit(invert)


def filter_records(records: DataFrame, pattern: str, mode: str = "any", invert: bool = False) -> DataFrame:
    """mode: url, type, content_type, http_content_type, date or any (every header value, else the content)."""
    if mode == "http_content_type":
        http_rows = records.where((F.col("type") == "response") & F.startswith(F.col("content_type"), F.lit("application/http")))
        return http_rows.where(matches(http_f.http_mime(F.col("content")), pattern, invert))
    if mode == "any":
        rx = F.lit(f"(?d){pattern}")
        in_header = F.exists("headers", lambda h: F.coalesce(F.rlike(h["value"], rx), F.lit(False)))
        hit = F.coalesce(in_header, F.lit(False)) | F.coalesce(F.rlike(F.decode(F.col("content"), LATIN1), rx), F.lit(False))
        return records.where(hit != F.lit(invert))
    return records.where(matches(F.col({"url": "url", "type": "type", "content_type": "content_type", "date": "date_raw"}[mode]), pattern, invert))


def successful_responses(records: DataFrame, html: bool = False) -> DataFrame:
    """Responses with a 2xx code, and only HTML if asked for."""
    found = records.where((F.col("type") == "response") & F.startswith(F.col("content_type"), F.lit("application/http")) & http_f.http_code(F.col("content")).between(200, 299))
    return found.where(F.contains(F.lower(http_f.http_mime(F.col("content"))), F.lit("html"))) if html else found


# --- links ---------------------------------------------------------------------------------


def extract_links(records: DataFrame, mode: str = "rfc3986") -> DataFrame:
    """path, offset, page_url, tag, attr, link_raw, link_abs of every link of successful HTML responses."""
    schema = "path string, offset bigint, page_url string, tag string, attr string, link_raw string, link_abs string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, offset, url, content in zip(b["path"], b["offset"], b["url"], b["content"]):
                body, _ = http.content(http.parse_response(content))
                offset = None if pd.isna(offset) else int(offset)
                rows += [(path, offset, url, *x) for x in links.page_links(body.decode("utf-8", "replace"), url, mode)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"offset": "Int64"})

    return successful_responses(records, html=True).select("path", "offset", "url", "content").mapInPandas(run, schema)


# --- conversion and writing ----------------------------------------------------------------


def _serialize_warc(version: pd.Series, names: pd.Series, values: pd.Series, content: pd.Series, content_type: pd.Series) -> pd.Series:
    rows = zip(version, names, values, content, content_type)
    return pd.Series([archive.serialize(v or "WARC/1.0", list(zip(n if n is not None else (), x if x is not None else ())), bytes(c or b""), t) for v, n, x, c, t in rows])


def serialize_warc(version: Column | str, names: Column | str, values: Column | str, content: Column | str, content_type: Column | str) -> Column:
    return F.pandas_udf(_serialize_warc, "binary")(version, names, values, content, content_type)


def serialized(records: DataFrame) -> Column:
    """The record as the bytes of a WARC file."""
    return serialize_warc(F.col("version"), F.transform("headers", lambda h: h["name"]), F.transform("headers", lambda h: h["value"]), F.col("content"), F.col("content_type"))


def decode_http(records: DataFrame) -> DataFrame:
    """Complete HTTP responses with their transfer and content encoding undone; other rows unchanged."""
    is_http = (F.col("type") == "response") & (F.translate(F.lower("content_type"), " ", "") == "application/http;msgtype=response")
    m = http_f.parse_response(F.when(is_http, F.col("content")), F.lit("GET"))
    out = records.withColumn("_m", m)
    whole = is_http & F.col("_m.complete") & (F.col("_m.leftover_bytes") == 0) & F.col("_m.error").isNull()
    content = F.when(whole, F.col("_m.decoded_message")).otherwise(F.col("content"))
    return out.withColumn("content", content).withColumn("content_length", F.when(whole, F.octet_length("content").cast("bigint")).otherwise(F.col("content_length"))).drop("_m")


def record(kind: str, url: Column, date: Column, content: Column, content_type: Column, record_id: Column, concurrent_to: Column | None = None, refers_to: Column | None = None, extra: list[tuple[str, Column]] = ()) -> Column:
    """A record as a struct (version, headers, content, content_type): response, request, metadata, conversion, ..."""
    pairs = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Concurrent-To", concurrent_to), ("WARC-Refers-To", refers_to), ("WARC-Block-Digest", block_digest(content)), *extra]
    headers = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs if v is not None]), lambda h: h["value"].isNotNull())
    return F.struct(F.lit("WARC/1.0").alias("version"), headers.alias("headers"), content.alias("content"), content_type.alias("content_type"))


def arc_to_warc(records: DataFrame, created: str, software: str, resource_prefixes: tuple[str, ...] = (), response_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """ARC records as WARC records, in the order of their file; WARC rows pass unchanged.

    A file description becomes a warcinfo record and a metadata record that holds its original
    bytes; later records of the file refer to that warcinfo. ``created`` is the conversion date.
    """
    arc = F.col("container") == "arc"
    describes = arc & (F.col("type") == "filedesc")
    # the reader numbers a file's records and names the description that holds for each: no window over contents
    described_by = F.col("description_index") if "description_index" in records.columns else F.when(describes, F.col("record_index"))
    rows = records.withColumn("_info", stable_uuid(F.when(arc & described_by.isNotNull(), F.concat_ws("|", "path", described_by.cast("string"), F.lit("description")))))
    starts = lambda prefixes: reduce(lambda a, b: a | b, [F.startswith(F.col("url"), F.lit(p)) for p in prefixes], F.lit(False))
    ascii_text = (F.col("content_type") == "text/dns") & ~F.decode(F.col("content"), LATIN1).rlike(r"[^\x00-\x7f]")
    is_response = http_f.is_http_response(F.col("content"))
    kind = (
        F.when(starts(resource_prefixes), "resource").when(starts(response_prefixes), "response")
        .when(F.startswith(F.col("url"), F.lit("http")), F.when(is_response, "response").otherwise("resource"))
        .when(F.startswith(F.col("url"), F.lit("dns")), F.when(ascii_text, "resource").otherwise("response")).otherwise("response")
    )
    address = get_header(F.col("headers"), "IP-address")
    blank = (F.col("content_type").isNull()) | (F.trim("content_type") == "")
    mime = F.when((kind == "response") & F.startswith(F.col("url"), F.lit("http")) & is_response, F.lit("application/http;msgtype=response")).when(blank, F.lit("application/octet-stream")).otherwise(F.col("content_type"))
    date = warc_date(F.coalesce("date_ts", arc_date(F.col("date_raw"))))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    keep = lambda *pairs: F.filter(F.array(*pairs), lambda h: h["value"].isNotNull())
    own_id = stable_uuid(F.concat_ws("|", "path", F.col("offset").cast("string"), "url", "date_raw"))
    converted = F.struct(
        kind.alias("type"), F.lit("WARC/1.0").alias("version"),
        keep(pair("WARC-Record-ID", own_id), pair("WARC-Target-URI", F.col("url")), pair("WARC-Warcinfo-ID", F.col("_info")), pair("WARC-IP-Address", F.when(address != "0.0.0.0", address)), pair("WARC-Date", date), pair("WARC-Type", kind)).alias("headers"),
        mime.alias("content_type"), F.col("content").alias("content"),
    )
    original = F.concat(F.coalesce(F.col("preamble"), F.lit(b"")), F.col("content")) if "preamble" in records.columns else F.col("content")
    about = F.encode(F.concat(F.lit(f"software: {software}\r\nformat: WARC File Format 1.0\r\n")), LATIN1)
    info = F.struct(
        F.lit("warcinfo").alias("type"), F.lit("WARC/1.0").alias("version"), keep(pair("WARC-Type", F.lit("warcinfo")), pair("WARC-Record-ID", F.col("_info")), pair("WARC-Date", F.lit(created)), pair("WARC-Filename", F.element_at(F.split("path", "/"), -1))).alias("headers"),
        F.lit("application/warc-fields").alias("content_type"), about.alias("content"),
    )
    described = F.struct(
        F.lit("metadata").alias("type"), F.lit("WARC/1.0").alias("version"), keep(pair("WARC-Type", F.lit("metadata")), pair("WARC-Record-ID", own_id), pair("WARC-Concurrent-To", F.col("_info")), pair("WARC-Target-URI", F.regexp_replace("url", "^filedesc://", "")), pair("WARC-Date", date), pair("WARC-Warcinfo-ID", F.col("_info"))).alias("headers"),
        F.lit("application/arc").alias("content_type"), original.alias("content"),
    )
    same = F.struct("type", "version", "headers", "content_type", "content")
    out = F.when(describes, F.array(info, described)).when(arc, F.array(converted)).otherwise(F.array(same))
    return rows.select("path", "record_index", "offset", F.posexplode(out).alias("part", "r")).select("path", "record_index", "offset", "part", "r.*")


# --- unpacking -----------------------------------------------------------------------------

#: File name endings by mime type.
ENDINGS = {"text/html": ".html", "text/plain": ".txt", "text/css": ".css", "application/javascript": ".js", "text/javascript": ".js", "application/json": ".json", "application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "application/xml": ".xml", "text/xml": ".xml"}


DEFAULT_NAME = "index"


def file_ending(mime: Column) -> Column:
    """File name ending by mime type, null for an unknown one."""
    return reduce(lambda acc, x: F.when(F.lower(mime) == x[0], F.lit(x[1])).otherwise(acc), ENDINGS.items(), F.lit(None).cast("string"))


def unpack_names(records: DataFrame, default_name: str = DEFAULT_NAME) -> DataFrame:
    """Successful responses with the file each body goes to, unique below the folder.

    Steps like ``..`` are resolved first. A record delivered again (same path, number and offset) keeps its name. Of records with the same name (letter case aside) the first in
    file order keeps it, the others get a hash of their place; only keys are compared, contents are not shuffled for it
    where the names that collide fit a broadcast.
    """
    found = successful_responses(records).withColumn("mime", http_f.http_mime(F.col("content")))
    path = clean_path(F.regexp_replace("url", r"[?#].*$", ""))
    parts = F.split(path, "/")
    steps = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: ~x.isin("", "."))
    folder = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    last = F.element_at(parts, -1)
    name = F.when(last.isin("", ".", ".."), F.lit(default_name)).otherwise(last)
    own = F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,5})$", 1)
    stem = F.substring(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), 1, 45)
    found = found.withColumn("_base", F.concat_ws("/", F.nullif(F.substring(F.array_join(folder, "/"), 1, 200), F.lit("")), stem)).withColumn("_end", F.coalesce(file_ending(F.col("mime")), F.when(own != "", own), F.lit(".html")))
    place = F.struct(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("record_index", F.lit(-1)).alias("record_index"), F.coalesce("offset", F.lit(-1)).alias("offset"))
    same = F.lower(F.concat("_base", "_end"))
    taken = found.groupBy(same.alias("_same")).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    mark = F.when(F.col("_first") != place, F.concat(F.lit("-"), F.substring(F.sha1(F.concat_ws("|", place["path"], place["record_index"], place["offset"])), 1, 16)))
    named = found.withColumn("_same", same).join(taken, "_same", "left")
    return named.withColumn("outfile", F.concat("_base", F.coalesce(mark, F.lit("")), "_end")).drop("_base", "_end", "_same", "_first")


LOG_COLUMNS = ("outfile", "path", "offset", "warc_type", "url", "date_raw", "mime", "record_id", "wayback_uri")


def unpack(records: DataFrame, folder: str, wayback_prefix: str = "http://wayback.example/all/", default_name: str = DEFAULT_NAME) -> DataFrame:
    """Write the bodies below ``folder`` (a shared path) and return the log: one row per file; ``error`` tells why one was not written."""
    schema = "outfile string, path string, offset bigint, warc_type string, url string, date_raw string, mime string, record_id string, wayback_uri string, length bigint, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            sizes, faults = [], []
            for name, content in zip(b["outfile"], b["content"]):
                try:
                    body, _ = http.content(http.parse_response(content))
                    target = os.path.join(folder, name)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target, "wb") as out:
                        out.write(body)
                    sizes.append(len(body))
                    faults.append(None)
                except OSError as e:
                    sizes.append(0)
                    faults.append(str(e))
            yield b.drop(columns="content").assign(length=sizes, error=faults)[[c.split()[0] for c in schema.split(", ")]]

    named = unpack_names(records, default_name)
    address = F.concat(F.lit(wayback_prefix), F.regexp_replace("date_raw", "[^0-9]", ""), F.lit("/"), F.col("url"))
    return named.select("outfile", "path", "offset", F.col("type").alias("warc_type"), "url", "date_raw", "mime", "record_id", address.alias("wayback_uri"), "content").mapInPandas(run, schema)


def unpack_log(log: DataFrame) -> DataFrame:
    """The log as lines of tab-separated values, ``-`` for null."""
    return log.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in LOG_COLUMNS]).alias("value"))


def extract_payload(records: DataFrame, path: str, offset: int) -> DataFrame:
    """The payload of the record at a place: the body of an HTTP message, else the content."""
    one = extract(records, path, offset)
    return one.select("path", "offset", F.when(F.startswith(F.col("content_type"), F.lit("application/http")), http_f.payload("content")).otherwise(F.col("content")).alias("payload"))


def copy_archive(records: DataFrame, folder: str, gzip: bool = False, decode: bool = False) -> None:
    """Write records as WARC files: a filtered selection, or a copy, with HTTP decoded if asked for."""
    out = decode_http(records) if decode else records
    out.write.format("webarchive").option("gzip", str(gzip).lower()).mode("append").save(folder)
