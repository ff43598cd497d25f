"""HTTP messages as struct columns (Arrow batches; one parse per row)."""

from __future__ import annotations

from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petrel.codec import http

_PAIRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "pairs": _PAIRS}
_FIELDS = (
    "kind string, version string, code int, phrase string, method string, target_uri string, scheme string, host string, port int, url string, headers pairs, trailers pairs, "
    "body_mode string, declared_length bigint, encoding string, keep_alive boolean, expect_continue boolean, interim_count int, body binary, decoded_message binary, complete boolean, parse_mode string, leftover_bytes int, error string"
)
COLUMNS = [c.split()[0] for c in _FIELDS.split(", ")]
SCHEMA = T.StructType([T.StructField(*c.split()[:1], _TYPES[c.split()[1]]) for c in _FIELDS.split(", ")])


def _row(m: http.Message) -> dict:
    row = asdict(m)
    row["headers"], row["trailers"] = ([{"name": n, "value": v} for n, v in pairs] for pairs in (m.headers, m.trailers))
    row["scheme"], row["host"], row["port"], row["url"] = http.request_url(m) if m.kind == "request" and not m.error else (None,) * 4
    row["decoded_message"] = http.decoded_message(m) if m.complete and not m.error and m.version else None
    return row


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    for c in ("code", "port", "interim_count", "leftover_bytes"):
        out[c] = out[c].astype("Int32")
    out["declared_length"] = out["declared_length"].astype("Int64")
    return out


def _parse_response(content: pd.Series, method: pd.Series) -> pd.DataFrame:
    return _frame([_row(http.parse_response(c, m or "GET")) for c, m in zip(content, method)])


def parse_response(content: Column | str, method: Column | str) -> Column:
    """Response message of each value; the request's method tells whether a body may follow (NULL: GET)."""
    return F.pandas_udf(_parse_response, SCHEMA)(content, method)


def _parse_response_http09(content: pd.Series) -> pd.DataFrame:
    return _frame([_row(http.parse_response(c, http09=True)) for c in content])


def parse_response_http09(content: Column | str) -> Column:
    return F.pandas_udf(_parse_response_http09, SCHEMA)(content)


def _parse_request(content: pd.Series) -> pd.DataFrame:
    return _frame([_row(http.parse_request(c)) for c in content])


def parse_request(content: Column | str) -> Column:
    return F.pandas_udf(_parse_request, SCHEMA)(content)


def _payload(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else http.dechunked_payload(c))


def payload(content: Column | str) -> Column:
    """Chunks joined, content encoding kept; other contents as they are."""
    return F.pandas_udf(_payload, "binary")(content)


def _decoded_payload(content: pd.Series) -> pd.Series:
    def one(c: bytes | None) -> bytes | None:
        m = http.parse_response(c) if c is not None else None
        return None if m is None or m.code is None else http.content(m)[0]

    return content.map(one)


def decoded_payload(content: Column | str) -> Column:
    """Body of a response with transfer and content encoding undone; NULL if it is no response."""
    return F.pandas_udf(_decoded_payload, "binary")(content)


def _is_http_response(content: pd.Series) -> pd.Series:
    return content.map(lambda c: c is not None and http.is_response(c))


def is_http_response(content: Column | str) -> Column:
    return F.pandas_udf(_is_http_response, "boolean")(content)


def http_mime(content: Column) -> Column:
    """Mime type of the first Content-Type header of an HTTP message, read from its head by expressions only."""
    head = F.substring_index(F.decode(content, "ISO-8859-1"), "\r\n\r\n", 1)
    value = F.regexp_extract(head, r"(?im)^content-type:[ \t]*([^\r\n;]*)", 1)
    return F.when(F.startswith(head, F.lit("HTTP/")) & (value != ""), F.trim(value))


def http_code(content: Column) -> Column:
    """Status code, read from the status line by expressions only."""
    line = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    return F.regexp_extract(line, r"^HTTP/\S+\s+(\d{3})", 1).try_cast("int")


def code_class(code: Column) -> Column:
    return (
        F.when(code.between(100, 199), "informational").when(code.between(200, 299), "successful").when(code.between(300, 399), "redirection")
        .when(code.between(400, 499), "client error").when(code.between(500, 599), "server error")
    )


def code_has_no_body(code: Column) -> Column:
    return code.between(100, 199) | code.isin(204, 304)


def method_is(method: Column, kind: str) -> Column:
    """kind: safe, idempotent, no_body or cacheable."""
    names = {"safe": ("GET", "HEAD", "OPTIONS", "TRACE"), "idempotent": ("GET", "HEAD", "OPTIONS", "TRACE", "PUT", "DELETE"), "no_body": ("HEAD",), "cacheable": ("GET", "HEAD")}
    return method.isin(*names[kind])
