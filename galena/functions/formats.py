"""File formats as a dimension, and what follows from an extension or a content type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by group and kind, in registry order, with their media types.
IMAGES = (
    ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("jpe", "image/jpeg"), ("jfif", "image/jpeg"), ("png", "image/png"), ("gif", "image/gif"),
    ("webp", "image/webp"), ("avif", "image/avif"), ("heic", "image/heic"), ("heif", "image/heif"), ("svg", "image/svg+xml"), ("bmp", "image/bmp"),
    ("ico", "image/x-icon"), ("tif", "image/tiff"), ("tiff", "image/tiff"), ("psd", None),
)
VIDEOS = (
    ("mp4", "video/mp4"), ("avi", "video/x-msvideo"), ("mov", "video/quicktime"), ("mkv", "video/x-matroska"), ("wmv", "video/x-ms-wmv"),
    ("flv", "video/x-flv"), ("webm", "video/webm"), ("m4v", "video/mp4"), ("3gp", "video/3gpp"), ("3g2", "video/3gpp2"), ("ts", "video/mp2t"),
    ("swf", None), ("rmvb", None), ("rm", None), ("vob", None), ("trp", None), ("sct", None), ("ogv", "video/ogg"), ("mxf", None),
    ("mpg", "video/mpeg"), ("mpeg", "video/mpeg"), ("m2ts", "video/mp2t"), ("f4v", "video/mp4"), ("dv", None), ("dcr", None), ("asf", "video/x-ms-asf"),
)
AUDIOS = (
    ("mp3", "audio/mpeg"), ("wav", "audio/wav"), ("flac", "audio/flac"), ("aac", "audio/aac"), ("ogg", "audio/ogg"), ("m4a", "audio/mp4"),
    ("ape", None), ("aiff", "audio/aiff"), ("aif", "audio/aiff"), ("amr", "audio/amr"), ("wma", "audio/x-ms-wma"),
)
OFFICE = "application/vnd.openxmlformats-officedocument."
OPEN = "application/vnd.oasis.opendocument."
DOCUMENTS = (
    ("pdf", "pdf", "application/pdf"), ("txt", "text", "text/plain; charset=utf-8"), ("doc", "word", "application/msword"),
    ("docx", "word", OFFICE + "wordprocessingml.document"), ("rtf", "word", "application/rtf"), ("odt", "word", OPEN + "text"),
    ("htm", "word", "text/html; charset=utf-8"), ("html", "word", "text/html; charset=utf-8"), ("mht", "word", "message/rfc822"),
    ("xls", "spreadsheet", "application/vnd.ms-excel"), ("xlsx", "spreadsheet", OFFICE + "spreadsheetml.sheet"),
    ("csv", "spreadsheet", "text/csv; charset=utf-8"), ("ods", "spreadsheet", OPEN + "spreadsheet"),
    ("ppt", "presentation", "application/vnd.ms-powerpoint"), ("pptx", "presentation", OFFICE + "presentationml.presentation"),
    ("odp", "presentation", OPEN + "presentation"), ("pps", "presentation", "application/vnd.ms-powerpoint"),
    ("ppsx", "presentation", OFFICE + "presentationml.slideshow"),
)
ARCHIVES = (("zip", "application/zip"), ("rar", "application/vnd.rar"))
CODE = "js jsx tsx json css scss less md mdx rs py java kt go c cpp h hpp sh ps1 yaml yml toml xml".split()
PLAIN = "log ini conf".split()
BLOCKED = "ai eps raw 3fr arw cr2 cr3 crw dng erf mrw nef nrw orf otf pef raf rw2 sr2 srw x3f".split()
TEXT_PREVIEW = "txt log md csv ini conf htm html".split()
ALIASES = {
    "image/apng": "png", "image/jpg": "jpg", "image/jfif": "jpg", "image/pjpeg": "jpg", "image/x-ms-bmp": "bmp", "image/vnd.microsoft.icon": "ico",
    "image/tif": "tiff", "audio/mp3": "mp3", "audio/wave": "wav", "audio/x-wav": "wav", "application/x-rar-compressed": "rar", "image/vnd.adobe.photoshop": "psd",
    "image/jpeg": "jpg", "image/tiff": "tiff", "text/html": "html",
}
GROUPS = ("image", "video", "audio", "document", "archive")


def _rows() -> list[tuple]:
    """(ext, kind, group, mime, decodable, analyzable, searchable, previewable, thumbnail, text_preview, blocked)"""
    rows = []
    for ext, mime in IMAGES:
        raster, shown = ext not in ("svg", "psd"), ext not in ("heic", "heif", "psd")
        rows.append((ext, "image", "image", mime, ext != "psd", raster, raster, shown, "main", False, False))
    rows += [(ext, "video", "video", mime, False, False, False, False, "renderer", False, False) for ext, mime in VIDEOS]
    rows += [(ext, "audio", "audio", mime, False, False, False, False, "none", False, False) for ext, mime in AUDIOS]
    rows += [(ext, kind, "document", mime, False, False, False, False, "main" if ext == "pdf" else "none", ext in TEXT_PREVIEW, False) for ext, kind, mime in DOCUMENTS]
    rows += [(ext, "archive", "archive", mime, False, False, False, False, "none", False, False) for ext, mime in ARCHIVES]
    mimes = {"md": "text/markdown; charset=utf-8"}
    rows += [(ext, "code", None, mimes.get(ext), False, False, False, False, "none", ext in TEXT_PREVIEW, False) for ext in CODE]
    rows += [(ext, "text", None, None, False, False, False, False, "none", True, False) for ext in PLAIN]
    rows += [(ext, "other", None, None, False, False, False, False, "none", False, True) for ext in BLOCKED]
    return rows


ROWS = _rows()
COLUMNS = "ext string, kind string, group string, mime string, decodable boolean, analyzable boolean, searchable boolean, previewable boolean, thumbnail string, text_preview boolean, blocked boolean"


def dimension(spark: SparkSession) -> DataFrame:
    """All known formats, one row each: about 120 rows, fit to broadcast."""
    return spark.createDataFrame(ROWS, COLUMNS)


def extensions(test) -> list[str]:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return [r[0] for r in ROWS if test(dict(zip(names, r, strict=True)))]


BY_GROUP = {g: extensions(lambda r, g=g: r["group"] == g) for g in GROUPS}
SCAN_SUPPORTED = [e for g in GROUPS for e in BY_GROUP[g]]
SEARCHABLE = extensions(lambda r: r["searchable"])


def normalize_extension(ext: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(ext), r"^\.", ""))


def import_extension(ext: Column) -> Column:
    return F.coalesce(F.nullif(normalize_extension(ext), F.lit("")), F.lit("bin"))


def _lookup(pairs: dict[str, object], key: Column) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*flat), key)


def kind_of(ext: Column) -> Column:
    return F.coalesce(_lookup({r[0]: r[1] for r in ROWS}, normalize_extension(ext)), F.lit("other"))


def mime_of(ext: Column) -> Column:
    return F.coalesce(_lookup({r[0]: r[3] for r in ROWS if r[3]}, normalize_extension(ext)), F.lit("application/octet-stream"))


def thumbnail_runtime(ext: Column) -> Column:
    return F.coalesce(_lookup({r[0]: r[8] for r in ROWS}, normalize_extension(ext)), F.lit("none"))


def preview_mode(ext: Column) -> Column:
    e = normalize_extension(ext)
    return (
        F.when(e.isin(extensions(lambda r: r["previewable"])), "image")
        .when(kind_of(ext) == "video", "video")
        .when(thumbnail_runtime(ext) != "none", "thumbnail")
        .when(e.isin(TEXT_PREVIEW), "text")
        .otherwise("none")
    )


def content_type(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1)))), F.lit(""))


def extension_for_content_type(value: Column) -> Column:
    """Aliases and preferred names first, then the first registered extension of the type; else null."""
    first: dict[str, str] = {}
    for r in ROWS:
        if r[3]:
            first.setdefault(r[3].split(";")[0].strip().lower(), r[0])
    return _lookup(first | ALIASES, content_type(value))


def sniff_extension(content: Column, declared: Column | None = None) -> Column:
    """Extension from the first bytes of a file, else from its declared content type, else null."""
    head = F.substring(content, 1, 4096)
    hexed = F.hex(F.substring(content, 1, 64))
    latin = F.decode(head, "ISO-8859-1")
    box = F.when(F.substring(latin, 5, 4) == "ftyp", F.substring(latin, 9, 4096))
    brands = F.lower(F.substring(box, 1, 56))
    text = F.lower(F.regexp_replace(F.substring(latin, 1, 4096), r"^(\xEF\xBB\xBF|\s)+", ""))

    def starts(*codes: str) -> Column:
        test = hexed.startswith(codes[0])
        for c in codes[1:]:
            test = test | hexed.startswith(c)
        return test

    def brand(*names: str) -> Column:
        return F.coalesce(brands.rlike("|".join(names)), F.lit(False))

    riff = starts("52494646")
    found = (
        F.when(starts("89504E47"), "png").when(starts("FFD8FF"), "jpg").when(starts("47494638"), "gif")
        .when(riff & (F.substring(hexed, 17, 8) == "57454250"), "webp").when(riff & (F.substring(hexed, 17, 8) == "41564920"), "avi")
        .when(starts("424D"), "bmp").when(starts("49492A00", "4D4D002A"), "tiff").when(starts("00000100"), "ico")
        .when(brand("avif", "avis"), "avif").when(brand("heic", "heix", "hevc", "hevx"), "heic")
        .when(brand("mif1", "msf1", "heif", "heis", "heim", "hevm", "hevs"), "heif").when(brand("qt  "), "mov").when(brand("m4v"), "m4v")
        .when(brand("3g2"), "3g2").when(brand("3gp", "3gr", "3gs"), "3gp").when(brand("mp4", "isom", "iso2", "iso5", "iso6", "avc1", "dash"), "mp4")
        .when(starts("3026B2758E66CF11A6D900AA0062CE6C"), "wmv").when(starts("464C56"), "flv")
        .when(starts("1A45DFA3") & F.lower(latin).contains("webm"), "webm").when(starts("1A45DFA3") & F.lower(latin).contains("matroska"), "mkv")
        .when(starts("38425053"), "psd").when(text.startswith("%pdf-"), "pdf").when(text.startswith("<svg") | text.startswith("<?xml"), "svg")
    )
    return F.coalesce(found, extension_for_content_type(declared)) if declared is not None else found


def sniff_mime(content: Column, name: Column) -> Column:
    """Media type from the first bytes of a file, as a viewer needs it: stricter signatures, brands within 32 bytes, else by the name."""
    hexed = F.hex(F.substring(content, 1, 32))
    latin = F.decode(F.substring(content, 1, 32), "ISO-8859-1")
    brands = F.when(F.substring(latin, 5, 4) == "ftyp", F.substring(latin, 9, 24))
    text = F.regexp_replace(F.decode(F.substring(content, 1, 256), "UTF-8"), r"^[\s\uFEFF]+", "")
    found = (
        F.when(hexed.startswith("FFD8FF"), "image/jpeg").when(hexed.startswith("89504E470D0A1A0A"), "image/png").when(latin.startswith("GIF8"), "image/gif")
        .when(latin.startswith("RIFF") & (F.substring(latin, 9, 4) == "WEBP"), "image/webp").when(brands.rlike("avif|avis"), "image/avif").when(brands.rlike("mif1|heic|heif"), "image/heif")
        .when(hexed.startswith("424D"), "image/bmp").when(hexed.startswith("49492A00") | hexed.startswith("4D4D002A"), "image/tiff").when(hexed.startswith("00000100"), "image/x-icon")
        .when(text.startswith("<svg") | text.startswith("<?xml"), "image/svg+xml")
    )
    return F.coalesce(found, mime_of(F.regexp_extract(name, r"\.([^.]+)$", 1)))
