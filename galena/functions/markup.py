"""Tags and attributes of web pages, in one pass of linear time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_SPACE = re.compile(r"[\s/]*")
_NAME = re.compile(r"[^\s/>][^\s/>=]*")
_BARE = re.compile(r"[^\s>]*")
_EQUALS = re.compile(r"\s*=\s*")
#: Elements whose content is text, up to their end tag. With scripts on, noscript is one.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
#: end of a declaration, its property, url() and strings
_CSS = re.compile(r"""([;{}])|(?<![\w-])([a-z-]++)\s*+:|url\(\s*+(?:"([^"\n]*)"|'([^'\n]*)'|([^"'()\s]++))\s*+\)|"[^"\n]*"|'[^'\n]*'""", re.I)


def tags(html: str) -> Iterator[tuple[str, dict[str, str], str]]:
    """(name, attributes, text) of every start tag: names in lower case, the first of equal attributes, text of raw elements only.

    What comments and raw elements hold is no tag. A tag that does not end
    before the page does is none.
    """
    at = 0
    while found := _OPEN.search(html, at):
        at = found.end()
        if found[1]:
            end = at - 2 if html.startswith(">", at) else html.find("-->", at - 2 if html.startswith("->", at) else at)
            if end < 0:
                return
            at = html.index(">", end) + 1
            continue
        if found[4]:
            at = html.find(">", at) + 1
            if not at:
                return
            continue
        own: dict[str, str] = {}
        while True:
            at = _SPACE.match(html, at).end()
            if at >= len(html):
                return
            if html[at] == ">":
                at += 1
                break
            name = _NAME.match(html, at)
            at, value = name.end(), ""
            if equals := _EQUALS.match(html, at):
                at = equals.end()
                quote = html[at : at + 1]
                if quote and quote in "\"'":
                    end = html.find(quote, at + 1)
                    if end < 0:
                        return
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            own.setdefault(name[0].lower(), unescape(value))
        tag = found[3].lower()
        if found[2]:
            if tag == "template":
                yield "/template", {}, ""
            continue
        text = ""
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            text = html[at : close.start() if close else len(html)]
            at = close.start() if close else len(html)
        yield tag, own, text


def css_urls(text: str) -> list[str]:
    """url() of background declarations."""
    found, name = [], ""
    for m in _CSS.finditer(_CSS_COMMENT.sub(" ", text)):
        if m[1]:
            name = ""
        elif m[2]:
            name = name or m[2].lower()
        elif name in ("background", "background-image"):
            found += [g for g in m.groups()[2:] if g is not None]
    return found


def _size(value: str | None) -> int:
    found = re.match(r"\s*(\d{1,9})", value or "")
    return int(found[1]) if found else 0


def image_references(html: str | None) -> tuple[str, list[tuple[str, bool, int, int]]]:
    """(base, images) of a page: the first base address, "" without one, and (reference, against the base, width, height).

    In the order of a collector: of images src (or the first of srcset),
    data-src, data-original and data-lazy, image by image; then the first of
    these three of any element; then backgrounds of styles. Addresses in data
    attributes hang on the page's address, the others on the base. What
    templates hold is not on the page.
    """
    base, images, lazy, backgrounds, depth = "", [], [], [], 0
    for tag, own, text in tags(html or ""):
        if tag == "/template":
            depth = max(0, depth - 1)
            continue
        if tag == "template":
            depth += 1
            continue
        if depth:
            continue
        if tag == "base" and not base:
            base = own.get("href", "")
        data = [own.get(k, "") for k in ("data-src", "data-original", "data-lazy")]
        if tag == "img":
            size = _size(own.get("width")), _size(own.get("height"))
            first = own.get("src") or re.split(r"[\s,]", own.get("srcset", "").strip(), maxsplit=1)[0]
            images += [(r, hangs, *size) for r, hangs in ((first, True), *((d, False) for d in data)) if r.strip()]
        if reference := next((d for d in data if d), ""):
            lazy.append((reference, False, 0, 0))
        for css in (own.get("style", ""), text if tag == "style" else ""):
            backgrounds += [(u, True, 0, 0) for u in css_urls(css)] if css else []
    return base, images + lazy + backgrounds
