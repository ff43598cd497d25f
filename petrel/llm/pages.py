"""Pages as lines: HTML messages and extracted text in one form."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from petrel.codec import http

TOKEN = re.compile(r"<!--.*?-->|<!?(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*>", re.S)
BLOCKS = frozenset("title h1 h2 h3 h4 h5 h6 p li div nav footer header aside section article main a noscript td th blockquote pre figcaption button ul ol table tr body html head".split())
CONTAINERS = frozenset("section article main body html head ul ol table tr header".split())
SILENT = frozenset(("script", "style"))
#: Elements of the page's own article; everything else is what the host puts around it.
CONTENT_TAGS = frozenset("h1 h2 h3 p li blockquote pre td th figcaption".split())


@dataclass
class Line:
    tag: str
    text: str
    closed: bool


def html_lines(page: str) -> tuple[list[Line], str]:
    """Text lines with the block element that holds them, and what follows the last complete tag."""
    lines: list[Line] = []
    stack: list[str] = ["body"]
    buffer = ""
    silent = None
    at = 0

    def flush(closed: bool) -> None:
        nonlocal buffer
        if buffer.strip():
            text = html.unescape(buffer) if "&" in buffer else buffer
            lines.extend(Line(stack[-1], t.strip(), closed) for t in text.split("\n") if t.strip())
        buffer = ""

    for m in TOKEN.finditer(page):
        if silent is None:
            buffer += page[at : m.start()]
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if silent:
            if m[1] and name == silent:
                silent = None
            continue
        if name in SILENT and not m[1]:
            silent = name
            continue
        if name not in BLOCKS or (name == "a" and (stack[-1] in ("p", "li", "h1", "h2", "h3", "div", "nav", "footer", "td", "th") or (m[1] and stack[-1] != "a"))):
            if name == "br":
                buffer += "\n"
            continue
        flush(True)
        if name in CONTAINERS:
            continue
        if m[1]:
            if name in stack[1:]:
                while stack.pop() != name:
                    pass
        else:
            if stack[-1] in ("p", "li", "h1", "h2", "h3", "h4", "title", "a"):  # these end where the next block begins
                stack.pop()
            stack.append(name)
    tail = "" if silent else page[at:]
    buffer += re.sub(r"<[^<>]*$", "", tail) if "<" in tail else tail
    flush(False)
    return lines, tail


def response_page(content: bytes) -> tuple[http.Message, str, bool]:
    """(message, decoded page, whether the content encoding reached its end)."""
    m = http.parse_response(content)
    body, whole = http.content(m)
    return m, body.decode("utf-8", "replace"), whole


def text_of(content: bytes | None) -> str:
    return content.decode("utf-8", "replace") if content else ""


BULLET = re.compile(r"^\s*(?:[*•–-]|\d{1,2}[.)])\s+")


def bare(line: str) -> str:
    """A text line without bullet and outer blanks, entities resolved."""
    line = BULLET.sub("", line).strip()
    return html.unescape(line) if "&" in line else line


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z]+://([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


LETTERS = re.compile(r"[^a-z0-9]+")


def squashed(text: str) -> str:
    return LETTERS.sub("", text.lower())


def site_label(url: str | None) -> str:
    """The host's own name without dots, dashes and common prefixes: copper-herald.example -> copperherald."""
    parts = [p for p in host_of(url).split(".") if p]
    return squashed(parts[-2]) if len(parts) > 1 else squashed(parts[0]) if parts else ""
