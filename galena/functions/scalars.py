"""Scalar functions of the library as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galena.functions import formats

# Fixed values.
TAG_COLORS = ["#ef4444", "#f97316", "#eab308", "#22c55e", "#14b8a6", "#3b82f6", "#8b5cf6", "#ec4899"]
CACHE_VERSION = "v4"
PIXELS, EDGE, BYTES = 10_000_000, 3840, 8 * 1024 * 1024


def parse_hex_color(value: Column) -> Column:
    """Struct r, g, b of six hexadecimal digits with an optional leading #; null otherwise."""
    digits = F.regexp_extract(F.trim(value), r"^#?([0-9A-Fa-f]{6})$", 1)
    part = [F.conv(F.substring(digits, k, 2), 16, 10).cast("int") for k in (1, 3, 5)]
    return F.when(digits != "", F.struct(part[0].alias("r"), part[1].alias("g"), part[2].alias("b")))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.hex(x.cast("int")), 2, "0") for x in (r, g, b)))


def color_distance_squared(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    d = [(x.cast("long") - y.cast("long")) for x, y in zip(a, b, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def color_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(color_distance_squared(a, b).cast("double"))


def normalize_path(path: Column) -> Column:
    """Slashes forward, none repeated or trailing, '.' and '..' segments resolved."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))

    def step(done: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def has_prefix(path: Column, prefix: Column) -> Column:
    """Whether ``path`` is ``prefix`` or lies below it."""
    top = F.regexp_replace(prefix, r"/+$", "")
    return (path == top) | path.startswith(F.concat(top, F.lit("/")))


def replace_prefix(path: Column, old: Column, new: Column) -> Column:
    return F.when(has_prefix(path, old), F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))).otherwise(path)


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def folder_name(name: Column) -> Column:
    """Trimmed; null if it can't name a folder."""
    n = F.trim(name)
    return F.when((n != "") & ~n.isin(".", "..") & ~n.rlike(r"[/\\]"), n)


def name_stem(name: Column) -> Column:
    """File name without its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def sanitize_stem(value: Column, fallback: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(value, r'[\\/:*?"<>|]', " "), r"\s+", " "))
    return F.coalesce(F.nullif(F.substring(clean, 1, 80), F.lit("")), fallback)


def tag_color(name: Column) -> Column:
    """By the sum of the first UTF-16 units of the name's characters (basic plane: the characters)."""
    total = F.aggregate(F.split(name, ""), F.lit(0), lambda s, c: s + F.ascii(c))
    return F.element_at(F.lit(TAG_COLORS), total % len(TAG_COLORS) + 1)


def cache_key(path: Column, content_hash: Column, size: Column, modified: Column) -> Column:
    """Trimmed content hash, else a hash of version, path, size and time, else of version and path."""
    zero = F.lit(b"\x00")

    def digest(*parts: Column) -> Column:
        out = [F.lit(CACHE_VERSION).cast("binary")]
        for p in parts:
            out += [zero, p.cast("string").cast("binary")]
        return F.sha2(F.concat(*out), 256)

    own, at = F.trim(content_hash), F.trim(modified)
    return F.coalesce(F.nullif(own, F.lit("")), F.when(size.isNotNull() & (F.coalesce(at, F.lit("")) != ""), digest(path, size, at)), digest(path))


def thumbnail_plan(ext: Column, width: Column, height: Column, size: Column) -> Column:
    """Struct should_generate, reason, runtime."""
    e, runtime = formats.normalize_extension(ext), formats.thumbnail_runtime(ext)
    w, h, n = (F.greatest(x, F.lit(0)).cast("long") for x in (width, height, size))
    reason = (
        F.when(runtime == "none", "skip").when(runtime == "renderer", "video").when(e == "psd", "psd").when(e == "pdf", "pdf").when(e.isin("heic", "heif"), "format")
        .when(w * h >= PIXELS, "pixel-threshold").when(F.greatest(w, h) >= EDGE, "edge-threshold").when(n >= BYTES, "size-threshold").otherwise("skip")
    )
    should = reason != "skip"
    return F.struct(should.alias("should_generate"), reason.alias("reason"), F.when(should, runtime).otherwise("none").alias("runtime"))


def byte_range(header: Column, size: Column) -> Column:
    """Struct start, end of a single ``bytes=`` range clipped to the file; null if it can't be served."""
    h = F.trim(header)
    a, b = (F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", k) for k in (1, 2))
    start, end = (F.nullif(x, F.lit("")).cast("decimal(38,0)") for x in (a, b))
    last = size - 1
    suffix = F.when(end > 0, F.struct(F.greatest(F.lit(0), size - end).cast("long").alias("start"), last.cast("long").alias("end")))
    stop = F.coalesce(end, last)
    span = F.when((stop >= start) & (start < size), F.struct(start.cast("long").alias("start"), F.least(stop, last).cast("long").alias("end")))
    return F.when(h.rlike(r"^bytes=\d*-\d*$") & (size > 0) & ~((a == "") & (b == "")), F.when(a == "", suffix).otherwise(span))


def version_parts(version: Column) -> Column:
    bare = F.regexp_replace(F.trim(version), r"^[vV]", "")
    return F.transform(F.split(bare, "[.-]"), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^\s*(\d+)", 1), F.lit("")).cast("long"), F.lit(0)))


def is_newer(candidate: Column, current: Column) -> Column:
    """Whether version ``candidate`` is above ``current``; missing parts count as 0."""
    a, b = version_parts(candidate), version_parts(current)
    signs = F.zip_with(a, b, lambda x, y: F.sign(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int"))
    return F.coalesce(F.get(F.filter(signs, lambda s: s != 0), F.lit(0)) > 0, F.lit(False))


def format_size(size: Column) -> Column:
    unit = F.when(size < 1024, 0).when(size < 1024**2, 1).when(size < 1024**3, 2).otherwise(3)
    scaled = F.round(size / F.pow(F.lit(1024.0), unit), 1)
    text = F.regexp_replace(F.format_string("%.1f", scaled), r"\.0$", "")
    return F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1))


def format_time(iso: Column) -> Column:
    return F.when(iso == "", "").otherwise(F.date_format(F.to_timestamp(iso), "yyyy-MM-dd HH:mm:ss"))


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such part."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def clean_rating(value: Column, fallback: Column) -> Column:
    """A suggested rating from text: its number if from 1 to 5, else ``fallback``."""
    number = F.round(F.try_to_number(F.regexp_extract(value, r"^\s*([+-]?\d{1,9})", 1), F.lit("S999999999")))
    number = F.coalesce(number, F.nullif(F.regexp_extract(value, r"^\s*\+?(\d{1,9})", 1), F.lit("")).cast("int")).cast("int")
    return F.when(number.between(1, 5), number).otherwise(fallback)


def clean_tags(tags: Column) -> Column:
    """Trimmed, first of each lower-cased name, five at most, cut to 32 characters."""
    named = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")

    def step(done: Column, t: Column) -> Column:
        seen = F.exists(done, lambda d: F.lower(d) == F.lower(t))
        return F.when(seen | (F.size(done) >= 5), done).otherwise(F.concat(done, F.array(t)))

    return F.transform(F.aggregate(named, F.array().cast("array<string>"), step), lambda t: F.substring(t, 1, 32))


def response_text(response: Column) -> Column:
    """Text of the first choice of a chat response: a string, or the text parts joined."""
    content = F.get_json_object(response, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.when(content.startswith("["), joined).otherwise(content)


def normalize_image_url(url: Column) -> Column:
    """Absolute http(s) URLs without their fragment; null for any others."""
    return F.when(url.rlike(r"^(?i)https?://[^\s/]+"), F.regexp_replace(F.trim(url), r"#.*$", ""))


def dot(a: Column, b: Column) -> Column:
    """Inner product summed in double precision, left to right; null unless the lengths agree."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(product, F.lit(0.0), lambda s, x: s + x))


def l2_normalize(v: Column) -> Column:
    """Scaled to unit length; unchanged if the norm is zero or not finite."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def recent_paths(current: Column, recent: Column, existing: Column) -> Column:
    """Library paths, the current one first, normalized, each once; only those in ``existing`` (array)."""
    all_ = F.transform(F.concat(F.array(current), F.coalesce(recent, F.array().cast("array<string>"))), lambda p: normalize_path(F.nullif(F.trim(p), F.lit(""))))
    return F.array_distinct(F.filter(all_, lambda p: p.isNotNull() & F.array_contains(existing, p)))


# Defaults of the search model's settings.
DEVICES, PATCHES, THREADS = ("auto", "cpu", "gpu"), 256, 4


def search_config(raw: Column) -> Column:
    """Struct of settings from JSON text; what is missing or not valid has its default."""
    get = lambda path: F.get_json_object(raw, path)
    number = lambda path: F.round(F.try_to_number(F.regexp_extract(get(path), r"^(\d{1,9})", 1), F.lit("999999999"))).cast("int")
    patches = F.when(raw.rlike(r'"fgclipMaxPatches"\s*:\s*null'), F.lit(None)).otherwise(F.coalesce(F.nullif(number("$.runtime.fgclipMaxPatches"), F.lit(0)), F.lit(PATCHES)))
    threads = F.when(F.lower(F.trim(get("$.runtime.intraThreads"))) == "auto", "auto").otherwise(F.coalesce(F.nullif(number("$.runtime.intraThreads"), F.lit(0)), F.lit(THREADS)).cast("string"))
    device = F.when(get("$.runtime.device").isin(*DEVICES), get("$.runtime.device")).otherwise("cpu")
    return F.struct(
        F.coalesce(get("$.enabled") == "true", F.lit(False)).alias("enabled"),
        F.coalesce(get("$.modelPath"), F.lit("")).alias("model_path"),
        F.coalesce(get("$.processUnindexedOnly") != "false", F.lit(True)).alias("unindexed_only"),
        device.alias("device"), threads.alias("threads"), patches.alias("max_patches"),
    )


def embedding_key(config: Column) -> Column:
    """What embeddings depend on: the model's path, without quotes and resolved, and the patch limit, as JSON."""
    path = F.regexp_replace(F.trim(config["model_path"]), "^[\"']|[\"']$", "")
    return F.to_json(F.struct(F.when(path == "", "").otherwise(normalize_path(path)).alias("modelPath"), config["max_patches"].alias("fgclipMaxPatches")), {"ignoreNullFields": "false"})


# The parts of the prompt for suggested metadata.
PROMPT_HEAD = (
    "你是素材库整理助手。请根据图片内容和提供的信息整理素材元数据。",
    "要求：\n- 只返回合法 JSON。\n- 不要输出解释。\n- 不要编造图片中不可见或原数据中没有的信息。\n- 中文优先。",
)
PROMPT_SHAPE = {"filename": '"filename": "string"', "tags": '"tags": ["string"]', "description": '"description": "string"', "rating": '"rating": 4'}
PROMPT_TITLE = {"filename": "文件名规则", "tags": "标签规则", "description": "备注规则", "rating": "评价规则"}
NOTHING = "无"


def metadata_prompt(name: Column, tags: Column, description: Column, rating: Column, pool: str, rules: dict[str, str]) -> Column:
    """The prompt for the fields that ``rules`` has (field to its rule); ``tags`` is an array of names."""
    if not rules:
        raise ValueError("at least one field must be asked for")
    known = {
        "filename": [F.concat(F.lit("当前文件名："), name)],
        "tags": [F.concat(F.lit("当前已有标签："), F.coalesce(F.nullif(F.array_join(tags, "、"), F.lit("")), F.lit(NOTHING))), F.lit(f"可复用标签池：{pool}")],
        "description": [F.concat(F.lit("当前备注："), F.coalesce(F.nullif(F.trim(description), F.lit("")), F.lit(NOTHING)))],
        "rating": [F.concat(F.lit("当前评价："), F.when(rating > 0, F.concat(rating.cast("string"), F.lit(" 分"))).otherwise(NOTHING))],
    }
    asked = [f for f in PROMPT_SHAPE if f in rules]
    shape = "{\n" + ",\n".join("  " + PROMPT_SHAPE[f] for f in asked) + "\n}"
    facts = F.concat_ws("\n", F.lit("可用原数据："), *(x for f in asked for x in known[f]))
    return F.concat_ws("\n\n", *map(F.lit, PROMPT_HEAD), facts, F.lit(f"需要生成的 JSON 格式：\n{shape}"), *(F.lit(f"{PROMPT_TITLE[f]}：\n{rules[f].strip()}") for f in asked))
