"""Links of an HTML page, and two ways to resolve them."""

from __future__ import annotations

from html.parser import HTMLParser
from posixpath import dirname, join
from urllib.parse import urljoin, urlsplit, urlunsplit

#: Which attributes of which elements are links.
LINK_ATTRIBUTES = {
    "a": ("href",), "applet": ("code",), "area": ("href",), "bgsound": ("src",), "body": ("background",), "embed": ("href", "src"), "fig": ("src",), "form": ("action",), "frame": ("src",), "iframe": ("src",),
    "img": ("href", "src", "lowsrc"), "input": ("src",), "link": ("href",), "layer": ("src",), "object": ("data",), "overlay": ("src",), "script": ("src",), "table": ("background",), "td": ("background",), "th": ("background",),
}


class _Links(HTMLParser):
    def __init__(self, compat: bool):
        super().__init__(convert_charrefs=True)
        self.compat = compat
        self.found: list[tuple[str, str, str]] = []
        self.base: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values: dict[str, str] = {}
        for k, v in attrs:
            if v is not None:
                values.setdefault(k, v)
        for name in LINK_ATTRIBUTES.get(tag, ()):
            if name in values:
                self.found.append((tag, name, values[name]))
        if tag == "base" and "href" in values:
            self.base = values["href"]
        if tag == "meta" and (self.compat or values.get("http-equiv", "").strip().lower() == "refresh"):
            target = refresh_target(values.get("content", ""), self.compat)
            if target:
                self.found.append(("meta", "content", target))

    handle_startendtag = handle_starttag


def refresh_target(content: str, compat: bool = False) -> str | None:
    """The address of a refresh instruction; compat: key not trimmed, value ends at a second ``=``."""
    for part in content.split(";"):
        key, eq, value = part.partition("=")
        if eq and (key if compat else key.strip()).lower() == "url":
            return value.split("=", 1)[0] if compat else value.strip().strip("'\"")
    return None


def clean(link: str) -> str:
    return link.translate({10: None, 13: None, 9: None})


def resolve(base: str, link: str, mode: str = "rfc3986") -> str:
    """Absolute form of a link. compat treats whatever has no host as a path below the base's directory."""
    if mode != "compat":
        try:
            return urljoin(base, link)
        except ValueError:
            return link
    here, there = urlsplit(base), urlsplit(link)
    if there.netloc:
        return link
    path = there.path
    if not path.startswith("/"):
        folder = dirname(here.path)
        while path.startswith(("./", "../")):  # leading steps only; inner ones stay as they are
            step, path = path.split("/", 1)
            if step == "..":
                folder = dirname(folder)
        path = join(folder, path)
    return urlunsplit((here.scheme, here.netloc, path, there.query, ""))


def page_links(page: str, url: str | None, mode: str = "rfc3986") -> list[tuple[str, str, str, str]]:
    """(tag, attribute, link as written, absolute link), in page order; the last <base> holds for all."""
    parser = _Links(mode == "compat")
    parser.feed(page)
    parser.close()
    base = resolve(url or "", parser.base, mode) if parser.base else url or ""
    return [(t, a, clean(v), clean(resolve(base, clean(v), mode)) if base else clean(v)) for t, a, v in parser.found]
