"""Rows as the records that callers see, settings, and the paths of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_FIELDS = (
    "id path name ext size width height folder_id created_at modified_at imported_at last_accessed_at rating description source_url dominant_color color_distribution thumb_hash content_hash deleted_at missing_at"
).split()
PALETTE = "array<struct<color:string,percentage:double>>"


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(map(str.capitalize, rest))


def file_records(files: DataFrame) -> DataFrame:
    """Files as records: names in camel case, an empty palette and hash where there are none, nested tags (none unless there)."""
    there = set(files.columns)
    column = lambda c: F.col(c) if c in there else F.lit(None).cast("string")
    default = {"color_distribution": "[]", "thumb_hash": ""}
    out = [F.coalesce(F.nullif(column(c), F.lit("")), F.lit(default[c])) if c in default else column(c) for c in FILE_FIELDS]
    tags = F.col("tags") if "tags" in there else F.array().cast("array<struct<id:long,name:string,color:string>>")
    return files.select(*(x.alias(camel(c)) for c, x in zip(FILE_FIELDS, out, strict=True)), tags.alias("tags"))


def folder_records(folders: DataFrame) -> DataFrame:
    """Folders as records; a missing system flag is false, a missing order 0."""
    system = F.coalesce(F.col("is_system") == 1, F.lit(False))
    return folders.select("id", "path", "name", "parent_id", "created_at", system.alias("isSystem"), F.coalesce("sort_order", F.lit(0)).alias("sortOrder"), F.col("deleted_at").alias("deletedAt"))


def palette(text: Column) -> Column:
    """Colors and percentages of a palette's JSON text; empty where there is none."""
    return F.coalesce(F.from_json(text, PALETTE), F.array().cast(PALETTE))


def trashed_folders(folders: DataFrame, entries: DataFrame) -> DataFrame:
    """Trashed folders with what they held; order by deleted_at descending, id."""
    own = entries.select(F.col("folder_id").alias("id"), "temp_path", F.col("deleted_at").alias("_at"), "file_count", "subfolder_count")
    joined = folders.filter(F.col("deleted_at").isNotNull()).join(own, "id")
    return joined.select("id", "path", "name", F.coalesce("deleted_at", F.lit("")).alias("deleted_at"), "temp_path", "file_count", "subfolder_count", F.col("_at").alias("trashed_at"))


def above(path: Column) -> Column:
    """The folders of a path, from the top to itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def trashed_above(paths: DataFrame, folders: DataFrame, entries: DataFrame) -> DataFrame:
    """``paths`` (path) below or at a trashed folder: folder_id, original_path, temp_path, source_path.

    Of several the first in the order of the folder table, by id, counts, be
    it the deepest or not. Paths meet folders by equality of their parts.
    """
    held = trashed_folders(folders, entries).select(F.col("id").alias("folder_id"), F.col("path").alias("original_path"), "temp_path")
    each = paths.select("path", F.explode(above(F.col("path"))).alias("original_path"))
    first = each.join(held, "original_path").groupBy("path").agg(F.min(F.struct("folder_id", "original_path", "temp_path")).alias("f")).select("path", "f.*")
    return first.withColumn("source_path", F.concat("temp_path", F.substring(F.col("path"), F.length("original_path") + 1, F.length("path"))))


# ---------------------------------------------------------------- settings and index paths


def setting(settings: DataFrame, key: str) -> str | None:
    row = settings.filter(F.col("key") == key).select("value").first()
    return row[0] if row else None


def index_path(paths: DataFrame) -> str | None:
    """The one index path there is: of ``paths`` (id, path) the first by id."""
    row = paths.orderBy("id").select("path").first()
    return row[0] if row else None


def set_index_path(paths: DataFrame, path: str) -> DataFrame:
    """``path`` alone, with a new id."""
    last = paths.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    return last.select((F.col("m") + 1).cast("long").alias("id"), F.lit(path).alias("path"))


def add_index_path(paths: DataFrame, path: str) -> DataFrame:
    """``paths`` with ``path``; an error if another is there."""
    now = index_path(paths)
    if now and now != path:
        raise ValueError("only one index path is supported")
    return paths if now == path else paths.unionByName(set_index_path(paths, path))


def remove_index_path(paths: DataFrame, path: str) -> DataFrame:
    return paths.filter(F.col("path") != path)


# ---------------------------------------------------------------- folder rows


def delete_folder_records(folders: DataFrame, ids: DataFrame) -> DataFrame:
    """``folders`` without the rows of ``ids`` (id); what is below them stays."""
    return folders.join(ids.select("id").distinct(), "id", "left_anti")


def clear_system_flag(folders: DataFrame, name: str | None = None, folder_id: int | None = None) -> DataFrame:
    """The system flag off, by name (of system folders) or by id."""
    hit = F.lit(False)
    if name is not None:
        hit = hit | F.coalesce((F.col("name") == name) & (F.col("is_system") == 1), F.lit(False))
    if folder_id is not None:
        hit = hit | (F.col("id") == folder_id)
    return folders.withColumn("is_system", F.when(hit, F.lit(0)).otherwise(F.col("is_system")))


CLIPBOARD_VERSION = 1
EDGES = r"^[\s\x{FEFF}\p{Z}]+|[\s\x{FEFF}\p{Z}]+$"


def clipboard_payloads(files: DataFrame, tags: DataFrame, group: str) -> DataFrame:
    """(``group``, payload): the files of a selection as JSON text that can be pasted as imports, by id, with their tags.

    ``tags`` has file_id, tag_id and ord. A selection is a row, so it is to be one that a user can hold.
    """
    own = tags.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tag_id"))), lambda t: t["tag_id"]).alias("tags"))
    item = F.struct(
        F.col("path").alias("sourcePath"), "ext", F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("source_url", F.lit("")).alias("sourceUrl"), F.coalesce("tags", F.array().cast("array<long>")).alias("tagIds"),
    )
    whole = files.join(own, files["id"] == own["file_id"], "left").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("id", item.alias("item")))).alias("items"))
    return whole.select(group, F.to_json(F.struct(F.lit(CLIPBOARD_VERSION).alias("version"), F.transform("items", lambda i: i["item"]).alias("items"))).alias("payload"))


def clipboard_items(payload: Column) -> Column:
    """Array of structs source_path, ext, rating, description, source_url, tag_ids; null where a payload has no valid item.

    An item needs a path and an extension (white space around them and a
    leading dot go; numbers and truth values count as their text, other values
    as none). Ratings that are no numbers are 0, texts that are no texts are
    empty, and of tags the whole numbers stay. Text that is no JSON, or of
    another version, is null.
    """

    def kind(v: Column, path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def number(v: Column, path: str) -> Column:
        return F.when(kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.try_variant_get(v, path, "double"))

    def text(v: Column, path: str) -> Column:
        return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))

    def trimmed(v: Column, path: str) -> Column:
        plain = ~F.coalesce(kind(v, path), F.lit("VOID")).rlike("^(OBJECT|ARRAY|VOID)")
        return F.regexp_replace(F.coalesce(F.when(plain, F.try_variant_get(v, path, "string")), F.lit("")), EDGES, "")

    def item(v: Column) -> Column:
        tags = F.transform(F.coalesce(F.try_variant_get(v, "$.tagIds", "array<variant>"), F.array().cast("array<variant>")), lambda t: number(t, "$"))
        return F.struct(
            trimmed(v, "$.sourcePath").alias("source_path"), F.lower(F.regexp_replace(trimmed(v, "$.ext"), r"^\.", "")).alias("ext"), F.coalesce(number(v, "$.rating"), F.lit(0.0)).alias("rating"),
            F.coalesce(text(v, "$.description"), F.lit("")).alias("description"), F.coalesce(text(v, "$.sourceUrl"), F.lit("")).alias("source_url"),
            F.transform(F.filter(tags, lambda t: t == F.floor(t)), lambda t: t.cast("long")).alias("tag_ids"),
        )

    v = F.try_parse_json(payload)
    items = F.when(number(v, "$.version") == CLIPBOARD_VERSION, F.try_variant_get(v, "$.items", "array<variant>"))
    valid = F.filter(F.transform(items, item), lambda i: (i["source_path"] != "") & (i["ext"] != ""))
    return F.when(F.size(valid) > 0, valid)
