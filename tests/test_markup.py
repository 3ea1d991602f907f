"""Tags, attributes and images of pages: known cases, another parser, and hostile pages."""

import time
from html.parser import HTMLParser

import duckdb
import pytest

from galena.functions import markup
from galena.sources import scan


@pytest.mark.parametrize("html, want", [
    ("<IMG SRC=a ALT='x > y' src=b>", [("img", {"src": "a", "alt": "x > y"})]),
    ("<img src = \"a&amp;b\"/><img/src=c/d/>", [("img", {"src": "a&b"}), ("img", {"src": "c/d/"})]),
    ("<!-- <img src=a> --><img =x src=b>", [("img", {"=x": "", "src": "b"})]),
    ("<!--><img src=a><!---><img src=b>", [("img", {"src": "a"}), ("img", {"src": "b"})]),
    ("<script>'<img src=a>'</script ><p><textarea><img></textarea>", [("script", {}), ("p", {}), ("textarea", {})]),
    ("a < b <3 </ p> <?php x?> <!doctype x><b>", [("b", {})]), ("<img src='a", []), ("<img src=a", []), ("<script><img src=a>", [("script", {})]), ("<a b= c>", [("a", {"b": "c"})]), ("<a b=>c", [("a", {"b": ""})]),
])
def test_tags(html, want):
    assert [(t, a) for t, a, _ in markup.tags(html)] == want


def test_images():
    html = """<base href="/x/"><base href="/y/"><img src=a width=10 height="20px" data-src=b data-lazy=c><template><img src=no></template><img srcset="s1 1x, s2 2x">
    <div data-original=d data-lazy=e style="background: red url('f') no-repeat, URL( g )"><style>p { background-image:url("h;i") } /* x { background:url(no) } */ q{content:url(no)}</style><noscript><img src=no></noscript>"""
    base, found = markup.image_references(html)
    assert base == "/x/" and found == [("a", True, 10, 20), ("b", False, 10, 20), ("c", False, 10, 20), ("s1", True, 0, 0), ("b", False, 0, 0), ("d", False, 0, 0), ("f", True, 0, 0), ("g", True, 0, 0), ("h;i", True, 0, 0)]
    assert markup.image_references(None) == ("", [])


def test_resolved(spark):
    rows = [("https://p.example/a/b?q", "<base href='c/d'><img src=e><img data-src=f><img src=e width=3><img src='data:x'><img src=' //Q.example '>"), ("not a page", "<img src=a><img src=http://r.example>"), ("https://p.example/z", None)]
    got = scan.images_of_pages(spark.createDataFrame(rows, "url string, html string")).orderBy("url", "place").collect()
    assert [(r.url, r.image_url) for r in got] == [("https://p.example/a/b?q", "https://p.example/a/c/e"), ("https://p.example/a/b?q", "https://p.example/a/f"), ("https://p.example/a/b?q", "https://q.example/"), ("not a page", "http://r.example/")]


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.found.append((tag, own))

    handle_startendtag = handle_starttag


def test_pages_against_another_parser(sf_dir):
    for (html,) in duckdb.sql(f"SELECT html FROM '{sf_dir}/pages.parquet'").fetchall():
        plain = Plain()
        plain.feed(html)
        plain.close()
        assert [(t, a) for t, a, _ in markup.tags(html) if t[0] != "/"] == plain.found


@pytest.mark.parametrize("html", ["<" * 400_000, "<a " * 150_000, "<a b='" * 80_000, "<!--" * 150_000, "<script>" * 100_000, "<a " + "x=1 " * 150_000 + ">", "<p style='" + "background:url(" * 60_000 + "'>", "<p style='" + "background:(" * 60_000 + "'>", "<style>" + "/*" * 200_000, "<a " + "=" * 400_000])
def test_hostile_pages_take_linear_time(html):
    began = time.process_time()
    markup.image_references(html)
    assert time.process_time() - began < 5
