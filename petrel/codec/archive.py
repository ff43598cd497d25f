"""WARC and ARC records out of byte streams, tolerant of damage; one stream may hold both.

``records(source)`` yields a Record for everything found. What is wrong with a record is in its
``errors``; what ends the stream is a Record with only ``fatal``. Offsets are those of the
version or address line in plain streams, of the member in per-record gzip, None elsewhere.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from petrel.codec.http import Pairs

MAX_BAD_LINES = 5
KNOWN_VERSIONS = ("1.0", "0.17", "0.18")
#: The names an ARC header line may declare.
ARC_FIELDS = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
VERSION_LINE = re.compile(rb"^(.*?)\s*WARC/(\d+(?:\.\d+)*)\s*?(\r\n|\r|\n|)$", re.I | re.S)
GZIP_MAGIC = b"\x1f\x8b"


@dataclass
class Record:
    container: str | None = None
    compression: str = "none"
    offset: int | None = None
    version: str | None = None
    headers: Pairs = field(default_factory=list)
    content: bytes | None = None
    content_length: int | None = None
    errors: list[tuple[str, list[str]]] = field(default_factory=list)
    fatal: str | None = None
    #: Of an ARC file description: the two lines before its content.
    preamble: bytes = b""

    def header(self, name: str) -> str | None:
        wanted = name.lower()
        return next((v for n, v in self.headers if n.lower() == wanted), None)

    @property
    def type(self) -> str | None:
        if self.container == "arc":
            return "filedesc" if (self.header("URL") or "").startswith("filedesc:") else "response"
        return self.header("WARC-Type")

    @property
    def url(self) -> str | None:
        return self.header("URL" if self.container == "arc" else "WARC-Target-URI")

    @property
    def date(self) -> str | None:
        return self.header("Archive-date" if self.container == "arc" else "WARC-Date")

    @property
    def record_id(self) -> str | None:
        return None if self.container == "arc" else self.header("WARC-Record-ID")

    @property
    def content_type(self) -> str | None:
        return self.header("Content-type")


class Damage(Exception):
    """The stream can't be read on."""


class Lines:
    """A stream with one line of look-ahead and a position; never reads past what is asked."""

    def __init__(self, raw: BinaryIO, at: int = 0):
        self.raw, self.at = raw, at
        self.held: list[bytes] = []

    def readline(self) -> bytes:
        line = self.held.pop() if self.held else self.raw.readline()
        self.at += len(line)
        return line

    def unread(self, line: bytes) -> None:
        if line:
            self.held.append(line)
            self.at -= len(line)

    def read(self, n: int, keep: bool = True) -> tuple[bytes | None, int]:
        """(the bytes, or None if they are not kept; how many there were)."""
        parts, got = [], 0
        while got < n:
            piece = self.held.pop() if self.held else self.raw.read(min(n - got, 1 << 20))
            if not piece:
                break
            if len(piece) > n - got:
                self.held.append(piece[n - got :])
                piece = piece[: n - got]
            got += len(piece)
            if keep:
                parts.append(piece)
        self.at += got
        return (b"".join(parts) if keep else None), got

    def rest(self, keep: bool = True) -> tuple[bytes | None, int]:
        return self.read(1 << 62, keep)


def _text(raw: bytes) -> str:
    return raw.decode("latin-1")


def _newline(line: bytes) -> bytes:
    return b"\r\n" if line.endswith(b"\r\n") else line[-1:] if line[-1:] in (b"\r", b"\n") else b""


def parse_warc(lines: Lines, first: bytes, compat: bool = False) -> Record:
    """The record whose version line, or the junk before it, is ``first``; the content is still unread."""
    errors: list[tuple[str, list[str]]] = []
    line, start, bad = first, lines.at - len(first), 0
    while True:
        m = VERSION_LINE.match(line)
        if m:
            break
        if line.strip():
            errors.append(("ignored line", [_text(line)]))
            bad += 1
            if bad > MAX_BAD_LINES:
                errors.append(("too many errors, giving up hope", []))
                return Record("warc", errors=errors, fatal="too many errors, giving up hope")
        start = lines.at
        line = lines.readline()
        if not line:
            return Record("warc", errors=errors, fatal="no version line" if errors else None)
    prefix, version, newline = m.groups()
    r = Record("warc", offset=start + len(prefix), version=f"WARC/{_text(version)}", errors=errors)
    if newline != b"\r\n":
        errors.append(("incorrect newline in version", [_text(newline)]))
    if _text(version) not in KNOWN_VERSIONS:
        errors.append((f"version field is not known ({', '.join(KNOWN_VERSIONS)})", [_text(version)]))
    if prefix.strip():
        errors.append(("bad prefix on WARC version header", [_text(prefix)]))
    length = 0
    while True:
        line = lines.readline()
        if not line or not line.strip(b"\r\n") or line[:1] == b"\r":
            break
        newline = _newline(line)
        body = line[: len(line) - len(newline)]
        follows = line[:1] in (b" ", b"\t")
        if newline != b"\r\n" or (compat and not body.partition(b":")[2].strip() and not follows):
            errors.append(("incorrect newline in follow header" if follows else "incorrect newline in header", [_text(line)]))
        if follows and r.headers:
            name, value = r.headers[-1]
            r.headers[-1] = (name, f"{value} {_text(body).strip()}")
            continue
        name, colon, value = body.partition(b":")
        if not colon:
            errors.append(("malformed header line", [_text(body)]))
            continue
        r.headers.append((_text(name).strip(), _text(value).strip()))
    for name, value in r.headers:
        if name.lower() == "content-length":
            if value.isascii() and value.isdigit():
                length = int(value)
            else:
                errors.append(("invalid header", [name, value]))
        elif name.lower() == "content-type" and not value:
            errors.append(("invalid header", [name, value]))
    r.content_length = length
    return r


def split_arc_line(text: str, names: list[str]) -> list[str]:
    """Values of an ARC header line; a count that differs is repaired from the side where spaces are harmless."""
    parts = text.split(" ")
    if len(parts) != len(names):
        if names and names[0].lower() in ("url", "content-type"):
            parts = text.rsplit(None, len(names) - 1)
        else:
            parts = text.split(None, len(names) - 1)
    if len(parts) != len(names):
        raise Damage(f"missing headers {' '.join(names)}: {text}")
    return parts


def parse_arc(lines: Lines, first: bytes, names: list[str]) -> tuple[Record, list[str]]:
    """(record, the field names that hold from now on); the content is still unread."""
    r = Record("arc", offset=lines.at - len(first))
    taken = 0
    if first.startswith(b"filedesc:"):
        version, columns = lines.readline(), lines.readline()
        r.preamble = version + columns
        taken = len(r.preamble)
        names = _text(columns).split()
        r.version = _text(version).strip()
    elif not names:
        raise Damage("missing filedesc")
    values = split_arc_line(_text(first).rstrip("\r\n"), names)
    r.headers = list(zip(names, values))
    raw = r.header("Archive-length")
    if raw is None or not (raw.isascii() and raw.isdigit()):
        if raw is not None:
            r.errors.append(("invalid header", ["Archive-length", raw]))
        r.content_length = None if raw is None else 0
    else:
        r.content_length = int(raw)
    if not r.content_type:
        r.errors.append(("invalid header", ["Content-type", r.content_type or ""]))
    r._taken = taken  # of the declared length, bytes that are already read
    return r, names


class Parser:
    """Records of one file, in order; ARC field names carry over from its file description."""

    def __init__(self, compat: bool = False, keep_content: bool = True):
        self.names: list[str] = []
        self.compat, self.keep_content = compat, keep_content

    def one(self, lines: Lines) -> Record | None:
        """The next record with its content, or None at the end."""
        while True:
            line = lines.readline()
            if not line:
                return None
            if line.strip(b"\r\n"):
                break
        try:
            head = line.lstrip()[:4].upper()
            if head == b"WARC" or not self.looks_arc(line):
                r = parse_warc(lines, line, self.compat)
                if r.fatal or r.version is None:
                    return r if r.fatal or r.errors else None
                want = r.content_length
            else:
                r, self.names = parse_arc(lines, line, self.names)
                want = None if r.content_length is None else max(0, r.content_length - r._taken)
        except Damage as e:
            return Record(fatal=str(e))
        r.content, got = lines.rest(self.keep_content) if want is None else lines.read(want, self.keep_content)
        if want is not None and got < want:
            r.fatal = f"expected {want} bytes but only read {got}"
        return r

    def looks_arc(self, line: bytes) -> bool:
        if line.startswith(b"filedesc:"):
            return True
        if VERSION_LINE.match(line):
            return False
        if self.names:
            return len(line.split()) >= len(self.names)
        return bool(re.match(rb"^[A-Za-z][A-Za-z0-9+.-]*:\S* \d{1,3}(?:\.\d{1,3}){3} \d{8,14} ", line))


class _Member(io.RawIOBase):
    def __init__(self, owner: "Members"):
        self.owner = owner

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:  # noqa: ANN001
        piece = self.owner.inflate(len(buffer))
        buffer[: len(piece)] = piece
        return len(piece)


class Members:
    """The members of a gzip file one after another, with where each begins."""

    def __init__(self, raw: BinaryIO, at: int = 0):
        self.raw, self.at, self.buffer = raw, at, b""
        self.engine = None
        self.broken: str | None = None

    def next(self) -> tuple[int, BinaryIO] | None:
        if self.engine is not None and not self.engine.eof and not self.broken:
            while self.inflate(1 << 20):
                pass
        if self.broken:
            return None
        while True:
            self._fill()
            stripped = self.buffer.lstrip(b"\0")  # padding between members
            self.at += len(self.buffer) - len(stripped)
            self.buffer = stripped
            if self.buffer or not self._more:
                break
        if not self.buffer:
            return None
        if self.buffer[:2] != GZIP_MAGIC:
            self.broken = "no gzip member where one should begin"
            return None
        self.engine = zlib.decompressobj(31)
        return self.at, io.BufferedReader(_Member(self), 1 << 16)

    def _fill(self) -> None:
        self._more = False
        if len(self.buffer) < 2:
            piece = self.raw.read(1 << 16)
            self._more = bool(piece)
            self.buffer += piece

    def inflate(self, n: int) -> bytes:
        engine = self.engine
        while not engine.eof:
            if not self.buffer:
                self.buffer = self.raw.read(1 << 16)
                if not self.buffer:
                    self.broken = "gzip member ends early"
                    return b""
            before = len(self.buffer)
            try:
                out = engine.decompress(self.buffer, n)
            except zlib.error as e:
                self.broken = f"damaged gzip member: {e}"
                return b""
            self.buffer = engine.unused_data if engine.eof else engine.unconsumed_tail
            self.at += before - len(self.buffer)
            if out:
                return out
        return b""


def sniff(head: bytes, name: str = "", compression: str = "auto") -> str:
    """none, record or file: what is asked for, else by the first two bytes (the name alone decides nothing)."""
    if compression != "auto":
        return compression
    return "record" if head[:2] == GZIP_MAGIC else "none"


def records(raw: BinaryIO, compression: str = "auto", start: int = 0, limit: int | None = None, compat: bool = False, keep_content: bool = True, end: int | None = None, parser: Parser | None = None) -> Iterator[Record]:
    """Records from ``start`` on, those that begin before ``end``; ``raw`` stands at ``start``."""
    parser = parser or Parser(compat, keep_content)
    parser.keep_content = keep_content
    n = 0
    if compression == "auto":
        head = raw.peek(2)[:2] if hasattr(raw, "peek") else raw.read(2)
        if not hasattr(raw, "peek"):
            raw.seek(-len(head), 1)
        compression = sniff(head)
    if compression == "record":
        members = Members(raw, start)
        while (member := members.next()) is not None:
            offset, body = member
            if end is not None and offset >= end:
                return
            lines, first = Lines(body), True
            while (r := parser.one(lines)) is not None:
                r.compression, r.offset = ("record", offset) if first else ("file", None)
                first = False
                if members.broken and r.fatal is None:
                    r.fatal = members.broken
                yield r
                n += 1
                if r.fatal and r.container is None or limit is not None and n >= limit:
                    return
        if members.broken:
            yield Record(fatal=members.broken, offset=members.at, compression="record")
        return
    if compression == "file":
        import gzip

        raw = gzip.GzipFile(fileobj=raw)
    lines = Lines(raw, start)
    try:
        while (r := parser.one(lines)) is not None:
            if end is not None and r.offset is not None and r.offset >= end:
                return
            r.compression = "file" if compression == "file" else "none"
            if compression == "file":
                r.offset = None
            yield r
            n += 1
            if r.fatal or limit is not None and n >= limit:
                return
    except (EOFError, OSError, zlib.error) as e:
        yield Record(fatal=f"damaged stream: {e}", compression=compression)


def find_start(raw: BinaryIO, start: int, size: int) -> int:
    """The first WARC record at or after ``start`` in a file of gzip members; ``size`` if there is none."""
    if start == 0:
        return 0
    at, tail = start, b""
    raw.seek(at)
    while at < size:
        piece = raw.read(1 << 20)
        if not piece:
            return size
        window = tail + piece
        base = at - len(tail)
        for m in re.finditer(rb"\x1f\x8b\x08", window):
            if _confirmed(raw, base + m.start()):
                return base + m.start()
        at += len(piece)
        raw.seek(at)
        tail = window[-2:]
    return size


def _confirmed(raw: BinaryIO, where: int) -> bool:
    """Whether a member that holds a WARC record begins here and ends where another one or the file does."""
    raw.seek(where)
    members = Members(raw, where)
    try:
        found = members.next()
        if found is None or not VERSION_LINE.match(found[1].readline(1 << 10)):
            return False
        following = members.next()
    except (OSError, EOFError, zlib.error):
        return False
    if members.broken:
        return members.broken.endswith("ends early")  # the file itself is cut in this member
    return following is None or bool(VERSION_LINE.match(following[1].readline(1 << 10)))


# --- writing -------------------------------------------------------------------------------

CONTENT_HEADERS = ("content-type", "content-length")


def serialize(version: str, headers: Pairs, content: bytes, content_type: str | None = None, verbatim: bool = False, newline: bytes = b"\r\n", compressed: bool = False) -> bytes:
    """One WARC record. Content headers are derived and come last, unless ``verbatim``."""
    kept = headers if verbatim else [(n, v) for n, v in headers if n.lower() not in CONTENT_HEADERS]
    out = [version.encode("latin-1")] + [f"{n}: {v}".encode("latin-1", "replace") for n, v in kept]
    if not verbatim:
        content_type = content_type or next((v for n, v in headers if n.lower() == "content-type"), None)
        if content_type:
            out.append(f"Content-Type: {content_type}".encode("latin-1", "replace"))
        out.append(b"Content-Length: %d" % len(content))
    raw = newline.join(out) + newline + newline + content + newline + newline
    if compressed:
        engine = zlib.compressobj(9, zlib.DEFLATED, 31)
        return engine.compress(raw) + engine.flush()
    return raw
