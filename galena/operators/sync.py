"""Library synchronization: the difference between a directory snapshot and the catalog; and the trash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.scalars import has_prefix
from galena.operators.library import move_candidates


def kind_of_known(deleted_at: Column, missing_at: Column, unchanged: Column) -> Column:
    """What happens to a path that is in both snapshot and catalog."""
    return F.when(deleted_at.isNotNull(), "skipped").when(missing_at.isNotNull(), "added").when(unchanged, "skipped").otherwise("updated")


def is_unchanged(ext: Column, size: Column, mtime: Column) -> Column:
    return (F.lower("ext") == F.lower(ext)) & (F.col("size") == size) & (F.col("fs_modified_at") == mtime)


def sync_diff(catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, kind, id, from_path) of a full scan.

    ``snapshot`` has path, ext, size, mtime, content_hash. kind is skipped,
    updated, added, moved (its content was at a path that is missing or gone)
    or removed (in the catalog, active, and not in the snapshot).
    """
    seen = snapshot.select(F.col("path").alias("_path"), F.col("ext").alias("_ext"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("content_hash").alias("_hash"))
    both = catalog.join(seen, F.col("normalized_path") == F.col("_path"), "full_outer")
    known, found = F.col("normalized_path").isNotNull(), F.col("_path").isNotNull()
    unchanged = is_unchanged(F.col("_ext"), F.col("_size"), F.col("_mtime"))
    kind = F.when(known & found, kind_of_known(F.col("deleted_at"), F.col("missing_at"), unchanged)).when(known, F.when(F.col("deleted_at").isNull() & F.col("missing_at").isNull(), "removed"))
    settled = both.filter(known).withColumn("kind", kind).filter("kind is not null")
    settled = settled.select(F.col("normalized_path").alias("path"), "kind", "id", F.lit(None).cast("string").alias("from_path"))
    new = both.filter(~known).select(F.col("_path").alias("path"), F.nullif("_hash", F.lit("")).alias("content_hash"))
    # paths that are still there, for the rows whose content comes up anew
    hashes = new.filter("content_hash is not null").select("content_hash").distinct()
    sources = catalog.join(hashes, "content_hash", "left_semi")
    there = seen.select(F.col("_path"), F.lit(True).alias("_there")).distinct()
    marked = sources.join(there, F.col("path") == F.col("_path"), "left").withColumn("present", F.coalesce("_there", F.lit(False)))
    origin = move_candidates(marked).withColumnRenamed("path", "from_path")
    # one of several new paths takes over the row: the first by name
    first = new.filter("content_hash is not null").groupBy("content_hash").agg(F.min("path").alias("path"))
    moved = first.join(origin, "content_hash").select("path", "id", "from_path")
    fresh = new.select("path").join(moved, "path", "left").select("path", F.when(F.col("id").isNotNull(), "moved").otherwise("added").alias("kind"), "id", "from_path")
    taken = moved.select("id")
    return settled.join(taken, "id", "left_anti").unionByName(fresh, allowMissingColumns=True).select("path", "kind", "id", "from_path")


def sync_summary(diff: DataFrame) -> DataFrame:
    """One row: scanned, added, updated, moved, removed, skipped."""
    kinds = ("added", "updated", "moved", "removed", "skipped")
    return diff.agg(F.count_if(F.col("kind") != "removed").alias("scanned"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def trash_preview(files: DataFrame, entries: DataFrame, folders: DataFrame) -> DataFrame:
    """Deleted files with preview_path: inside the deepest trashed folder above them, its holding place.

    Each file's parent directories are exploded and joined by equality, so the
    prefix join needs no comparison of all pairs.
    """
    held = entries.join(folders.select(F.col("id").alias("folder_id"), F.col("normalized_path").alias("_top")), "folder_id").select("_top", "temp_path")
    gone = files.filter(F.col("deleted_at").isNotNull()).select("id", "normalized_path", "deleted_at")
    parts = F.split("normalized_path", "/")
    above = gone.select("id", "normalized_path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("_top"))
    hits = above.join(held, "_top").groupBy("id").agg(F.max_by(F.concat("temp_path", F.substring(F.col("normalized_path"), F.length("_top") + 1, F.length("normalized_path"))), F.length("_top")).alias("preview_path"))
    return gone.join(hits, "id", "left").select("id", "deleted_at", F.coalesce("preview_path", "normalized_path").alias("preview_path"))


def trash_items(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Trashed folders and files in one list; order by deleted_at descending, id."""
    f = files.filter(F.col("deleted_at").isNotNull()).select(F.lit("file").alias("kind"), "id", "deleted_at", "name")
    d = entries.select(F.lit("folder").alias("kind"), F.col("folder_id").alias("id"), "deleted_at", "file_count", "subfolder_count")
    return d.unionByName(f, allowMissingColumns=True)


def restore_targets(files: DataFrame, folders: DataFrame, entries: DataFrame, root: str) -> DataFrame:
    """Where each deleted file goes: (id, target_path, folder_id, from_trashed_folder).

    A file of a trashed folder, or of a folder that is gone, goes to the root
    without a folder; any other stays where it was.
    """
    gone = files.filter(F.col("deleted_at").isNotNull()).select("id", "name", "normalized_path", "folder_id")
    preview = trash_preview(files, entries, folders).select("id", "preview_path")
    live = folders.filter(F.col("deleted_at").isNull()).select(F.col("id").alias("_live"))
    j = gone.join(preview, "id").join(live, F.col("folder_id") == F.col("_live"), "left")
    trashed = F.col("preview_path") != F.col("normalized_path")
    lost = F.col("folder_id").isNotNull() & F.col("_live").isNull()
    home = trashed | lost
    return j.select("id", F.when(home, F.concat(F.lit(root.rstrip("/") + "/"), F.col("name"))).otherwise(F.col("normalized_path")).alias("target_path"), F.when(~home, F.col("folder_id")).alias("folder_id"), trashed.alias("from_trashed_folder"))


def readable(path: Column, roots: list[str]) -> Column:
    """Whether a path lies in one of the roots."""
    test = F.lit(False)
    for r in roots:
        test = test | has_prefix(path, F.lit(r))
    return test


def trash_count(files: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: n, deleted files and trashed folders together."""
    return files.filter(F.col("deleted_at").isNotNull()).select("id").unionByName(entries.select(F.col("folder_id").alias("id"))).agg(F.count(F.lit(1)).alias("n"))


def trash_entry_counts(folders: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """One row: file_count below a folder and subfolder_count, itself not counted."""
    under = has_prefix(F.col("normalized_path"), F.lit(path))
    own = folders.filter(under).agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("subfolder_count"))
    return own.crossJoin(files.filter(under).agg(F.count(F.lit(1)).alias("file_count")))  # one row each


def total_size(sizes: DataFrame, fallback: int) -> DataFrame:
    """One row: total of ``size``, or ``fallback`` where that is zero or unknown."""
    total = F.coalesce(F.sum("size"), F.lit(0))
    return sizes.agg(F.when(total == 0, F.lit(fallback)).otherwise(total).alias("total"))
