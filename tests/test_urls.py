"""References and file names of URLs against known cases and Python's resolver."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from galena.functions import urls


def test_resolve(spark):
    base = "HTTP://A.Example:80/b/c/d;p?q"
    same = ["g", "./g", "g/", "/g", "//h.example/x", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http://x.example/a/../b"]
    # as browsers have it, and Python's resolver has not
    own = {"\\g": "http://a.example/g", " g\n": "http://a.example/b/c/g", "a b é\"": "http://a.example/b/c/a%20b%20%C3%A9%22", "%2E%2e/g": "http://a.example/b/g", "https:x.example/y": "https://x.example/y", "HTTPS://X.example:443": "https://x.example/", "data:image/png;base64,AA": None, "javascript:x": None, "//": None, "///h.example//y": "http://h.example//y", "https://": None, "http:g": "http://a.example/b/c/g"}
    rows = spark.createDataFrame([(base, r) for r in [*same, *own]], "base string, r string")
    got = {r.r: r.u for r in rows.select("r", urls.resolve(F.col("base"), F.col("r")).alias("u")).collect()}
    want = {r: urljoin("http://a.example/b/c/d;p?q", r).replace("x.example/a/../b", "x.example/b") for r in same}
    assert {r: (got[r], u) for r, u in (want | own).items() if got[r] != u} == {}


def test_image_filename(spark):
    cases = [
        ("https://x.example/a/b.PNG?v=1#x", "image/jpeg", "b.PNG"), ("https://x.example/a//", "image/webp", "a.webp"), ("https://x.example/", "image/png", "browser-image.png"), ("https://x.example", None, "browser-image"),
        ("not a url", "image/gif", "browser-image.gif"), (None, None, "browser-image"), ("https://x.example/%ZZ", "", "browser-image"), ("https://x.example/%C3%A9+b", "text/html", "é+b"), ("https://x.example/%EF%BF%BD", "", "�"),
        ('https://x.example/a<>:"b|?c', "image/tiff;q=1", "a_b_.tiff"), ("https://x.example/" + "a" * 170 + ".png", "image/bmp", "a" * 160 + ".bmp"), ("https://x.example/" + "😀" * 90, "", "😀" * 80), ("https://x.example/x" + "😀" * 90, "", "x" + "😀" * 79),
        ("https://x.example/a/..", "image/avif", "browser-image.avif"), ("https://x.example/x.123456789", "image/heic", "x.123456789.heic"),
    ]
    rows = spark.createDataFrame([(k, u, c) for k, (u, c, _) in enumerate(cases)], "k int, u string, c string")
    got = {r.k: r.n for r in rows.select("k", urls.image_filename(F.col("u"), F.col("c")).alias("n")).collect()}
    assert [(got[k], n) for k, (_, _, n) in enumerate(cases) if got[k] != n] == []
