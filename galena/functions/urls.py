"""References, paths and file names of URLs, as browsers read them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query and fragment of a reference (RFC 3986, appendix B)
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
DEFAULT_NAME, MOST_UNITS = "browser-image", 160

# Extensions that a collector gives to content types without one in the name.
IMAGE_EXTENSIONS = {
    "image/apng": "png", "image/avif": "avif", "image/bmp": "bmp", "image/gif": "gif", "image/heic": "heic", "image/heif": "heif",
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/svg+xml": "svg", "image/tiff": "tiff", "image/webp": "webp",
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def clean(url: Column) -> Column:
    """Without spaces and controls at either end, and without tabs and line ends."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")


def parts(url: Column) -> Column:
    """Struct scheme, host, path, query, fragment; the scheme in lower case, query and fragment with their marks."""
    names = ("scheme", "host", "path", "query", "fragment")
    return F.struct(*((F.lower(x) if k == 0 else x).alias(n) for k, n in enumerate(names) for x in [F.regexp_extract(url, PARTS, k + 1)]))


def without_dots(path: Column) -> Column:
    """``path`` without its segments ``.`` and ``..``, in plain or in percent form."""

    def step(done: Column, s: Column) -> Column:
        up, here = s.rlike(r"(?i)^(\.|%2e){2}$"), s.rlike(r"(?i)^(\.|%2e)$")
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(up, kept).when(here, done).otherwise(F.concat(done, F.array(s)))

    def joined(p: Column) -> Column:
        segments = F.split(F.regexp_replace(p, "^/", ""), "/")
        out = F.concat(F.lit("/"), F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/"))
        # a path that ends in a dot segment names a folder
        return let(out, lambda x: F.when(p.rlike(r"(?i)(^|/)(\.|%2e){1,2}$") & ~x.endswith("/"), F.concat(x, F.lit("/"))).otherwise(x))

    return let(path, joined)


def escaped(text: Column) -> Column:
    """Spaces, quotes, angle brackets, controls and what is not ASCII in percent form; escapes stay as they are."""
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"""[^!-~]|["<>`{}]"""), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(text.rlike(r"""[^!-~]|["<>`{}]"""), F.array_join(each, "")).otherwise(text)


def resolve(base: Column, reference: Column) -> Column:
    """``reference`` against the absolute http(s) URL ``base``, normalised; null unless the outcome is http(s).

    Backslashes are slashes, the scheme and the host are in lower case, default
    ports go and dot segments are resolved, as in the address a browser gives.
    """
    at = F.regexp_replace(clean(base), r"\\", "/")
    of = F.regexp_replace(F.regexp_replace(clean(reference), r"\\", "/"), "^((?i)(?:https?:)?)//+", "$1//")  # more slashes than two count as two

    def targets(p: Column) -> Column:
        """Struct of what the outcome is made of; empty parts of a relative reference come from the base."""
        own, up = p["of"], p["at"]
        relative = (own["scheme"] == "") | ((own["scheme"] == up["scheme"]) & (own["host"] == "") & ~own["path"].startswith("/") & ~p["slashes"])
        inherits = relative & (own["host"] == "")
        loose = ~relative & (own["host"] == "")  # an absolute URL may lack the two slashes
        host = F.when(loose, F.regexp_extract(own["path"], "^/*([^/]*)", 1)).when(inherits, up["host"]).otherwise(own["host"])
        path = (
            F.when(loose, F.regexp_extract(own["path"], "^/*[^/]*(.*)$", 1)).when(inherits & (own["path"] == ""), up["path"])
            .when(inherits & ~own["path"].startswith("/"), F.concat(F.regexp_extract(up["path"], r"^(.*/)[^/]*$", 1), own["path"])).otherwise(own["path"])
        )
        query = F.when(inherits & (own["path"] == "") & (own["query"] == ""), up["query"]).otherwise(own["query"])
        return F.struct(F.when(relative, up["scheme"]).otherwise(own["scheme"]).alias("scheme"), F.lower(host).alias("host"), path.alias("path"), query.alias("query"), own["fragment"].alias("fragment"), (p["slashes"] & (own["host"] == "")).alias("hostless"))

    def whole(t: Column) -> Column:
        host = F.when(t["scheme"] == "http", F.regexp_replace(t["host"], ":(80)?$", "")).otherwise(F.regexp_replace(t["host"], ":(443)?$", ""))
        known = F.regexp_replace(t["host"], "^.*@", "").rlike("^[^:]") & ~t["hostless"]
        return F.when(t["scheme"].isin("http", "https") & known, F.concat(t["scheme"], F.lit("://"), host, escaped(without_dots(t["path"])), escaped(t["query"]), escaped(t["fragment"])))

    split = let(F.struct(at.alias("at"), of.alias("of")), lambda p: F.struct(parts(p["at"]).alias("at"), parts(p["of"]).alias("of"), p["of"].rlike("^(?i)(?:https?:)?//").alias("slashes")))
    return let(split, lambda p: let(targets(p), whole))


# The one site whose notes are known, and the paths of its notes and lists of notes.
NOTE_SITE, NOTE_PATHS = "xiaohongshu.com", ("/explore", "/discovery/item", "/search_result")


def note_url(base: Column, href: Column) -> Column:
    """Absolute address of ``href`` on page ``base`` if it is a note, or a list of notes, of the known site; null otherwise.

    A host counts that has the site's name in it. Query and fragment stay.
    """

    def kept(url: Column) -> Column:
        p = parts(url)
        paths = [(p["path"] == x) | p["path"].startswith(f"{x}/") for x in NOTE_PATHS]
        return F.when(p["host"].contains(NOTE_SITE) & (paths[0] | paths[1] | paths[2]), url)

    return F.when(F.trim(href) != "", let(resolve(base, href), kept))


def prefix(text: Column, units: int) -> Column:
    """At most ``units`` UTF-16 units from the front; a character of two units that would be cut goes."""

    def step(done: Column, c: Column) -> Column:
        size = F.when(c.rlike(r"[\x{10000}-\x{10FFFF}]"), 2).otherwise(1)
        n = done["n"] + size
        return F.struct(F.when(n <= units, F.concat(done["text"], c)).otherwise(done["text"]).alias("text"), n.alias("n"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    plain = (F.length(text) * 2 <= units) | ~text.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(plain, F.substring(text, 1, units)).otherwise(F.aggregate(F.split(text, ""), start, step)["text"])


def content_type_extension(content_type: Column) -> Column:
    mime = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return F.element_at(F.create_map(*(F.lit(x) for kv in IMAGE_EXTENSIONS.items() for x in kv)), mime)


def image_filename(url: Column, content_type: Column) -> Column:
    """File name of a collected image: its URL's last segment that is not empty, decoded.

    Of at most 160 UTF-16 units, characters that file systems refuse as
    underscores. Names without an extension get that of the content type, if
    it is an image's. URLs without a segment, that are no URL (null too), or
    whose segment is no percent-encoded UTF-8 are ``browser-image``.
    """
    at = parts(F.regexp_replace(clean(url), r"\\", "/"))
    path = let(at, lambda p: F.when(p["scheme"] != "", without_dots(p["path"])))
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1))

    def decoded(own: Column) -> Column:
        # bytes that are no UTF-8 decode to a mark that the segment does not spell
        spelled = F.upper(own).contains("%EF%BF%BD") | own.contains("�")
        return let(F.try_url_decode(F.replace(own, F.lit("+"), F.lit("%2B"))), lambda d: F.when(~d.contains("�") | spelled, d))

    def with_extension(name: Column) -> Column:
        ext = content_type_extension(content_type)
        return F.when(name.rlike(r"(?i)\.[a-z0-9]{1,8}$") | ext.isNull(), name).otherwise(F.concat(name, F.lit("."), ext))

    name = F.coalesce(F.nullif(let(last, decoded), F.lit("")), F.lit(DEFAULT_NAME))
    return let(let(F.regexp_replace(name, r'[\\/:*?"<>|]+', "_"), lambda n: prefix(n, MOST_UNITS)), with_extension)
