"""HTTP messages stored as whole values: framing, chunks, trailers, gzip bodies, decoding.

A message is parsed as if all its bytes had arrived at once and the connection then closed.
Nothing raises on bad input: what is wrong is named in ``error`` and parsing stops there.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

#: Headers that belong to the transfer, not to the message.
STRIPPED_WHEN_DECODED = ("content-encoding", "content-length", "connection", "keep-alive", "proxy-connection", "transfer-encoding")

Pairs = list[tuple[str, str]]


@dataclass
class Message:
    kind: str
    version: str | None = None
    code: int | None = None
    phrase: str | None = None
    method: str | None = None
    target_uri: str | None = None
    headers: Pairs = field(default_factory=list)
    trailers: Pairs = field(default_factory=list)
    body_mode: str | None = None
    declared_length: int | None = None
    encoding: str | None = None
    keep_alive: bool = False
    expect_continue: bool = False
    interim_count: int = 0
    body: bytes = b""
    complete: bool = False
    parse_mode: str = "start"
    leftover_bytes: int = 0
    error: str | None = None

    def header(self, name: str) -> str | None:
        wanted = name.lower()
        return next((v for n, v in self.headers if n.lower() == wanted), None)


def _line(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The line at ``at`` without its terminator, and where the next begins; (None, at) if unterminated."""
    end = data.find(b"\n", at)
    if end < 0:
        return None, at
    return (data[at : end - 1] if end > at and data[end - 1] == 13 else data[at:end]), end + 1


def _fields(data: bytes, at: int, pairs: Pairs) -> tuple[int, str | None, bool]:
    """Header lines up to the blank one: (position after it, error, whether it was reached)."""
    while True:
        line, after = _line(data, at)
        if line is None:
            return at, None, False
        if not line:
            return after, None, True
        if line[:1] in (b" ", b"\t"):
            if not pairs:
                return at, "folded line without a header", False
            name, value = pairs[-1]
            pairs[-1] = (name, f"{value} {line.strip().decode('latin-1')}")
        else:
            name, colon, value = line.partition(b":")
            if not colon:
                return at, "header line without colon", False
            pairs.append((name.decode("latin-1").strip(), value.decode("latin-1").strip()))
        at = after


def _framing(m: Message, ignored: frozenset[str]) -> None:
    m.body_mode = "close"
    m.keep_alive = (m.version or "").upper() == "HTTP/1.1"
    for name, value in m.headers:
        key, low = name.lower(), value.lower()
        if key in ignored:
            continue
        if key == "expect":
            m.expect_continue = "100-continue" in low
        elif key == "content-length":
            if m.body_mode == "close" and value.isdigit():
                m.body_mode, m.declared_length = "length", int(value)
        elif key == "transfer-encoding":
            if "chunked" in low:
                m.body_mode, m.declared_length = "chunked", None
        elif key == "content-encoding":
            m.encoding = low
        elif key == "connection":
            m.keep_alive = "keep-alive" in low if "close" not in low else False


def _chunks(m: Message, data: bytes, at: int) -> int:
    parts: list[bytes] = []
    first = True
    while True:
        line, after = _line(data, at)
        if line is None:
            if not first or all(c in b"0123456789abcdefABCDEF" for c in data[at:]):
                break
            line = data[at:]
        text = line.split(b";", 1)[0].strip()
        try:
            size = int(text, 16) if text[:1].isalnum() else -1
        except ValueError:
            size = -1
        if size < 0:
            if first:  # not chunked after all: everything left is the body
                m.body_mode, m.parse_mode, m.complete = "close", "end", True
                m.body = data[at:]
                return len(data)
            m.error = "bad chunk size"
            break
        first = False
        at = after
        if size == 0:
            at, m.error, done = _fields(data, at, m.trailers)
            if done:
                m.complete, m.parse_mode = True, "end"
            break
        parts.append(data[at : at + size])
        if at + size >= len(data):
            at = len(data)
            break
        at += size
        gap, after = _line(data, at)
        if gap is None:
            at = len(data)
            break
        if gap:
            m.error = "chunk without line end"
            break
        at = after
    m.body = b"".join(parts)
    if not m.complete:
        m.parse_mode = "incomplete"
        return len(data) if m.error is None else at
    return at


def inflate(data: bytes) -> tuple[bytes, bool]:
    """(what could be inflated, whether the stream reached its end); zlib, then gzip, then raw deflate."""
    for bits in (15, 31, -15):
        engine = zlib.decompressobj(bits)
        out = b""
        try:
            for k in range(0, len(data), 1 << 16):
                out += engine.decompress(data[k : k + (1 << 16)])
            out += engine.flush()
        except zlib.error:
            if not out:
                continue
        if out or engine.eof:
            return out, engine.eof
    return b"", False


def _body(m: Message, data: bytes, at: int) -> int:
    if m.body_mode == "chunked":
        return _chunks(m, data, at)
    if m.body_mode == "length":
        n = m.declared_length or 0
        if m.encoding and m.encoding.strip().endswith("gzip") and n:
            out, whole = inflate(data[at : at + n])
            if whole and data[at : at + 2] == b"\x1f\x8b":
                m.body, m.complete, m.parse_mode = out, at + n <= len(data), "end" if at + n <= len(data) else "incomplete"
                return min(len(data), at + n)
            m.body_mode = "close"  # the length was of something else
        else:
            m.body = data[at : at + n]
            m.complete = len(m.body) == n
            m.parse_mode = "end" if m.complete else "incomplete"
            return at + len(m.body)
    m.body, m.complete, m.parse_mode = data[at:], True, "end"
    return len(data)


def parse_response(data: bytes | None, method: str = "GET", ignore_headers: tuple[str, ...] = (), http09: bool = False) -> Message:
    """A response to ``method``; interim responses before it are skipped and counted."""
    m = Message("response")
    data = data or b""
    if http09:
        m.version, m.code, m.body, m.body_mode, m.complete, m.parse_mode = "HTTP/0.9", 200, data, "close", True, "end"
        return m
    ignored, at = frozenset(x.lower() for x in ignore_headers), 0
    interim = 0
    while True:
        m = Message("response", interim_count=interim)
        while at < len(data) and data[at] in b"\r\n":
            at += 1
        line, after = _line(data, at)
        if line is None:
            m.error = "no start line" if at < len(data) else None
            m.leftover_bytes = len(data) - at
            return m
        parts = line.decode("latin-1").split(None, 2)
        if len(parts) < 2 or not parts[1].isdigit() or not parts[0].upper().startswith("HTTP/"):
            m.error, m.leftover_bytes = "bad status line", len(data) - at
            return m
        m.version, m.code, m.phrase = parts[0], int(parts[1]), parts[2] if len(parts) > 2 else ""
        m.parse_mode = "headers"
        at, m.error, done = _fields(data, after, m.headers)
        if not done:
            m.parse_mode = "incomplete"
            m.leftover_bytes = len(data) - at if m.error else 0
            return m
        _framing(m, ignored)
        if method.upper() == "HEAD" or 100 <= m.code < 200 or m.code in (204, 304):
            m.complete, m.parse_mode = True, "end"
        else:
            at = _body(m, data, at)
        if m.code == 100 and m.complete:
            interim += 1
            continue
        m.leftover_bytes = len(data) - at
        return m


def parse_request(data: bytes | None, ignore_headers: tuple[str, ...] = ()) -> Message:
    m, data, at = Message("request"), data or b"", 0
    while at < len(data) and data[at] in b"\r\n":
        at += 1
    line, after = _line(data, at)
    parts = line.decode("latin-1").split(" ") if line is not None else []
    if len(parts) != 3:
        m.error, m.leftover_bytes = "bad request line", len(data) - at
        return m
    m.method, m.target_uri, m.version = parts
    at, m.error, done = _fields(data, after, m.headers)
    if not done:
        m.parse_mode = "incomplete"
        return m
    _framing(m, frozenset(x.lower() for x in ignore_headers))
    if m.body_mode == "close":
        m.complete, m.parse_mode = True, "end"
    else:
        at = _body(m, data, at)
    m.leftover_bytes = len(data) - at
    return m


def request_url(m: Message) -> tuple[str | None, str | None, int | None, str | None]:
    """(scheme, host, port, url) of a request: absolute target, CONNECT target, or Host header."""
    target = m.target_uri or ""
    scheme, rest = "http", target
    if (m.method or "").upper() == "CONNECT":
        authority, path = target, ""
        scheme = "https"
    elif "://" in target:
        scheme, _, rest = target.partition("://")
        scheme = scheme.lower()
        authority, slash, path = rest.partition("/")
        path = slash + path
    else:
        authority, path = m.header("Host") or "", target
    host, colon, port = authority.rpartition(":")
    if not colon or not port.isdigit():
        host, port = authority, "443" if scheme == "https" else "80"
    if not host:
        return scheme, None, None, None
    shown = host if int(port) == (443 if scheme == "https" else 80) else f"{host}:{port}"
    return scheme, host, int(port), f"{scheme}://{shown}{path}"


def content(m: Message) -> tuple[bytes, bool]:
    """The body with its content encoding undone, and whether that reached its end."""
    body = m.body
    if body[:2] == b"\x1f\x8b" or (m.encoding or "").strip() in ("deflate", "gzip", "x-gzip"):
        out, whole = inflate(body)
        if out or whole:
            return out, whole
    return body, True


def decoded_message(m: Message) -> bytes:
    """The message without transfer and content encoding, with the length of what it now holds."""
    start = f"{m.version} {m.code} {m.phrase or ''}" if m.kind == "response" else f"{m.method} {m.target_uri} {m.version}"
    body, undone = m.body, True
    if m.encoding and body:
        out, _ = inflate(body)
        if out:
            body = out
        else:
            undone = m.body_mode == "length" and m.encoding.strip().endswith("gzip") and body[:2] != b"\x1f\x8b"
    no_body = m.kind == "response" and m.code is not None and (100 <= m.code < 200 or m.code in (204, 304))
    kept = [(n, v) for n, v in m.headers + m.trailers if no_body or n.lower() not in STRIPPED_WHEN_DECODED]
    if not no_body:
        kept.append(("Content-Length", str(len(body))))
        if not undone:
            kept.append(("Content-Encoding", m.encoding))
    head = start + "\r\n" + "".join(f"{n}: {v}\r\n" for n, v in kept) + "\r\n"
    return head.encode("latin-1", "replace") + body


def dechunked_payload(data: bytes) -> bytes:
    """Payload as a plain HTTP client hands it over: chunks joined, content encoding kept."""
    at = 0
    head = data.find(b"\r\n\r\n")
    if not data[:5].upper() == b"HTTP/" or head < 0:
        return data
    m = Message("response")
    parts = data.split(b"\n", 1)[0].decode("latin-1").split(None, 2)
    m.version, m.code = parts[0], int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 200
    at, _, done = _fields(data, data.find(b"\n") + 1, m.headers)
    if not done:
        return data
    _framing(m, frozenset())
    if m.body_mode == "chunked":
        _chunks(m, data, at)
        return m.body
    return data[at : at + m.declared_length] if m.body_mode == "length" else data[at:]


def is_response(data: bytes) -> bool:
    m = parse_response(data)
    return m.complete and not m.leftover_bytes
