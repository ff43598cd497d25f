import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from petrel.codec import archive, http, links

#: Record ends: any run of line ends that closes with LF.
TERMINATORS = [a + b for a in ("", "\n", "\r\n", "\n\r\n", "\r\r\r\r", "\r\n\n\r\n", "\n" * 15) for b in ("\n", "\r\n")]
PAYLOAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Length: 16\r\n\r\nmud and samphire\r\n"


def warc(kind, number, content, mime):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-00000000000{number}>\r\nContent-Type: {mime}\r\nContent-Length: {len(content)}\r\n\r\n"
    return head.encode() + content


FIRST, SECOND = warc("warcinfo", 0, b"format: WARC File Format 1.0\r\n", "application/warc-fields"), warc("response", 1, PAYLOAD, "application/http;msgtype=response")
ABOUT = b"1 0 Saltmarsh Crawl\nURL IP-address Archive-date Content-type Archive-length\nlow tide, nothing else to report\n"
ARC1 = b"filedesc://saltmarsh-0042.arc 0.0.0.0 20070611083000 text/plain %d\n" % len(ABOUT) + ABOUT
ARC2 = b"http://heron.example/nest 10.1.2.3 20070611083105 text/plain %d\n" % len(PAYLOAD) + PAYLOAD


def gz(data):
    import gzip

    return gzip.compress(data)


def read(data, **kw):
    return list(archive.records(io.BufferedReader(io.BytesIO(data)), **kw))


@pytest.mark.parametrize("end", TERMINATORS)
def test_warc_terminators(end):
    a, b = read(FIRST + end.encode() + SECOND + end.encode())
    assert (a.offset, b.offset) == (0, len(FIRST) + len(end))
    assert (a.type, b.type, a.content_length, b.content) == ("warcinfo", "response", 30, PAYLOAD)
    assert not a.errors and not b.errors and a.fatal is b.fatal is None


@pytest.mark.parametrize("end", TERMINATORS)
def test_arc_terminators(end):
    a, b = read(ARC1 + end.encode() + ARC2 + end.encode())
    assert (a.type, b.type, a.offset, b.offset) == ("filedesc", "response", 0, len(ARC1) + len(end))
    assert a.content_length == len(ABOUT) and a.content == b"low tide, nothing else to report\n" and b.content == PAYLOAD
    assert a.preamble + a.content == ABOUT


def test_members_have_their_own_offsets():
    one = gz(FIRST + b"\r\n\r\n")
    a, b = read(one + gz(SECOND + b"\r\n\r\n"))
    assert (a.offset, b.offset, a.compression) == (0, len(one), "record") and b.content == PAYLOAD


def test_one_member_for_all_records():
    a, b = read(gz(FIRST + b"\r\n\r\n" + SECOND))
    assert b.offset is None and b.content == PAYLOAD and (a.compression, b.compression) == ("record", "file")
    assert [r.content for r in read(gz(FIRST + b"\r\n\r\n" + SECOND), compression="file")] == [a.content, b.content]


@pytest.mark.parametrize(
    "data, offset, codes, fatal",
    [
        (b"junk\r\n" * 3 + FIRST, 18, ["ignored line"] * 3, None),
        (b"junk\r\n" * 6 + FIRST, None, ["ignored line"] * 6 + ["too many errors, giving up hope"], "too many errors, giving up hope"),
        (b"xx" + FIRST, 2, ["bad prefix on WARC version header"], None),
        (FIRST.replace(b"WARC/1.0", b"WARC/1.1"), 0, ["version field is not known (1.0, 0.17, 0.18)"], None),
        (FIRST.replace(b"WARC/1.0", b"WARC/0.18"), 0, [], None),
        (FIRST.replace(b"WARC-Type: warcinfo", b"garbage"), 0, ["malformed header line"], None),
        (FIRST.replace(b"Content-Length: 30", b"Content-Length: -5"), 0, ["invalid header"], None),
        (FIRST[:-3], 0, [], "expected 30 bytes but only read 27"),
        (b"http://e.org/ 1.1.1.1 20131113000000 text/html 4\nabcd", None, [], "missing filedesc"),
    ],
)
def test_damage(data, offset, codes, fatal):
    r = read(data)[0]
    assert (r.offset, [c for c, _ in r.errors], r.fatal) == (offset, codes, fatal)


def test_header_forms():
    r = read(b"WARC/1.0\r\nX: a\r\n b\r\nE:\r\nContent-length: 2\r\nWARC-Concurrent-To: 1\r\nWARC-Concurrent-To: 2\r\n\r\nhi")[0]
    assert r.headers[0] == ("X", "a b") and r.header("warc-concurrent-to") == "1" and r.content == b"hi" and not r.errors
    assert [c for c, _ in read(b"WARC/1.0\nA: 1\n\n")[0].errors] == ["incorrect newline in version", "incorrect newline in header"]


def test_arc_spaces_and_ten_columns():
    names = " ".join(archive.ARC_FIELDS)
    head = b"filedesc://x 0.0.0.0 20200101000000 text/plain 200 - - 0 x 60\n1 0 x\n" + names.encode() + b"\n\n"
    r = read(head + b"http://e.org/a b 1.1.1.1 20131113000000 text/html 200 - - 0 f 4\nabcd")[-1]
    assert r.url == "http://e.org/a b" and r.header("Filename") == "f" and r.content == b"abcd"


def test_mixed_and_empty_files():
    assert [r.container for r in read(FIRST + b"\r\n\r\n" + ARC1 + b"\n" + ARC2 + b"\n" + SECOND)] == ["warc", "arc", "arc", "warc"]
    assert read(b"") == read(b"\n\r\n") == [] and read(b"\0\1binary")[0].fatal


def test_damaged_gzip_is_named():
    whole = gz(FIRST + b"\r\n\r\n")
    assert any(r.fatal for r in read(whole[:-20])) and any(r.fatal for r in read(whole + b"plain bytes"))
    assert len(read(whole + b"\0" * 300)) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(st.from_regex(r"X-[A-Za-z]{1,8}", fullmatch=True), st.from_regex(r"([!-~]([ -~]{0,20}[!-~])?)?", fullmatch=True)), max_size=4), st.binary(max_size=200)), min_size=1, max_size=5), st.booleans())
def test_what_is_written_is_read(rows, compressed):
    data = b"".join(archive.serialize("WARC/1.0", headers, content, "text/plain", compressed=compressed) for headers, content in rows)
    back = read(data)
    assert [(r.headers[:-2], r.content) for r in back] == rows and not any(r.fatal for r in back)


def test_serialized_layout_and_lower_case_headers():
    got = archive.serialize("WARC/1.0", [("WARC-Type", "response"), ("content-length", "9")], b"hi", "text/x")
    assert got == b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: text/x\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"


# --- HTTP ----------------------------------------------------------------------------------


def test_get_and_response():
    m = http.parse_response(b"HTTP/1.1 200 OK\r\nHost: a\r\nContent-Length: 5\r\n\r\ntests")
    assert m.complete and m.body == b"tests" and m.leftover_bytes == 0 and m.keep_alive
    r = http.parse_request(b"GET / HTTP/1.1\r\nHost: example.org:8080\r\n\r\n")
    assert r.complete and http.request_url(r) == ("http", "example.org", 8080, "http://example.org:8080/")
    assert http.request_url(http.parse_request(b"CONNECT h:443 HTTP/1.1\r\n\r\n"))[:3] == ("https", "h", 443)
    assert http.request_url(http.parse_request(b"GET https://h/x HTTP/1.1\r\n\r\n")) == ("https", "h", 443, "https://h/x")


def test_head_has_no_body():
    m = http.parse_response(b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n", "HEAD")
    assert m.complete and m.body == b""


@pytest.mark.parametrize("body, want", [(b"8\r\nabcdefgh\r\n0\r\n\r\n", b"abcdefgh"), (b"0\r\n\r\n", b""), (b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n", b"abc")])
def test_chunked_post(body, want):
    m = http.parse_request(b"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n" + body)
    assert m.complete and m.leftover_bytes == 0 and m.body == want


def test_broken_chunks():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    m = http.parse_response(head + b"plain text")
    assert m.complete and m.body == b"plain text" and m.body_mode == "close"
    assert http.parse_response(head + b"3\r\nabc\r\nzz\r\n").error == "bad chunk size"
    assert http.parse_response(head + b"3\r\nabc\r\n-1\r\n").error == "bad chunk size"
    assert not http.parse_response(head + b"9\r\nabc").complete


def test_interim_response_and_short_status():
    m = http.parse_response(b"HTTP/1.1 100 Continue\r\n\r\nHTTP/1.0 204 No Content\r\nDate: x\r\n\r\n")
    assert (m.code, m.version, m.phrase, m.interim_count) == (204, "HTTP/1.0", "No Content", 1)
    assert http.parse_response(b"HTTP/1.1 404\r\nContent-Length:0\r\n\r\n").code == 404
    assert http.parse_response(b"\r\nHTTP/1.1 200 OK\r\n\r\n").complete


def test_gzip_declared():
    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Length: %d\r\n\r\n"
    assert http.parse_response(head % 7 + b"text\r\n").complete  # plain text under a wrong length
    whole = gz(b"payload")
    m = http.parse_response(head % len(whole) + whole)
    assert m.complete and m.body == b"payload"
    assert http.decoded_message(m).endswith(b"Content-Length: 7\r\n\r\npayload")
    import zlib

    for packed in (zlib.compress(b"abc" * 50), zlib.compress(b"abc" * 50)[2:-4]):
        m = http.parse_response(b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate\r\n\r\n" + packed)
        assert http.content(m)[0] == b"abc" * 50
    body, whole_end = http.content(http.parse_response(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + whole[:-9]))
    assert not whole_end


def test_bad_http_is_an_error_not_an_exception():
    assert http.parse_response(b"HTTP/1.1 200 OK\r\n folded\r\n\r\n").error
    assert http.parse_response(b"HTTP/1.1 200 OK\r\nno colon\r\n\r\n").error
    assert http.parse_response(b"nonsense\r\n").error and http.parse_response(None).code is None
    assert http.parse_response(b"x", http09=True).body == b"x"
    assert http.parse_response(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nabcd").leftover_bytes == 2


def test_links():
    page = "<base href='/b/'>" + "".join(f'<{t} {a}="x-{t}"></{t}>' for t, names in links.LINK_ATTRIBUTES.items() for a in names) + '<meta http-equiv=refresh content="0; url=next.html">'
    found = links.page_links(page, "http://h/a/p.html")
    assert len(found) == sum(map(len, links.LINK_ATTRIBUTES.values())) + 1 and found[0][3] == "http://h/b/x-a" and found[-1][2] == "next.html"
    base = "http://h/a/b.html"
    assert [links.resolve(base, x) for x in ("../c", "//k/x", "mailto:a@b", "#f", "?q")] == ["http://h/c", "http://k/x", "mailto:a@b", "http://h/a/b.html#f", "http://h/a/b.html?q"]
    assert links.resolve(base, "mailto:a@b", "compat") == "http://h/a/a@b" and links.resolve(base, "#f", "compat") == "http://h/a/"
    # compat: leading steps only are resolved, and a meta element needs no http-equiv
    assert [links.resolve(base, x, "compat") for x in ("./c", "../c", "x/./y/../z", "/r/../s#f")] == ["http://h/a/c", "http://h/c", "http://h/a/x/./y/../z", "http://h/r/../s"]
    page = '<meta name=x content="0;url=n.html">'
    assert links.page_links(page, base) == [] and links.page_links(page, base, "compat") == [("meta", "content", "n.html", "http://h/a/n.html")]
    assert links.refresh_target("0; url=a", compat=True) is None and links.refresh_target("0;url=a=b", compat=True) == "a"
