"""Changes of library tables as pure functions from a snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions.scalars import has_prefix, normalize_path, parse_hex_color, replace_prefix
from galena.plans.filters import is_active

KEPT = ("imported_at", "rating", "description", "source_url", "dominant_color", "color_distribution", "thumb_hash", "sync_id")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def last_of(rows: DataFrame, key: list[str], order: list[Column] | None) -> DataFrame:
    """One row of each key: the first of ``order``; without one the greatest by its other columns, so that reruns agree."""
    return latest(rows, key, order or [F.to_json(F.struct(*sorted(rows.columns))).desc()])


def upsert_files(files: DataFrame, incoming: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Merge ``incoming`` (columns of files) into ``files``; of rows that repeat a normalized_path the first of ``order`` counts.

    A known path keeps its id and the columns of ``KEPT``; its content hash is
    the incoming one if there is one. Extensions are lower-cased, channels
    derived from the color, both tombstones cleared. New ids follow the largest.
    """
    new = last_of(incoming, ["normalized_path"], order).select(*[F.col(c).alias(f"_{c}") for c in incoming.columns])
    joined = files.join(new, files["normalized_path"] == new["_normalized_path"], "full_outer")
    hit, known = F.col("_normalized_path").isNotNull(), F.col("normalized_path").isNotNull()
    columns = []
    for c in files.columns:
        own, got = F.col(c), F.col(f"_{c}") if c in incoming.columns else F.lit(None)
        if c == "id":
            value = own
        elif c in KEPT:
            value = F.when(known, own).otherwise(got)
        elif c == "content_hash":
            value = F.when(hit, F.coalesce(got, own)).otherwise(own)
        elif c in ("deleted_at", "missing_at"):
            value = F.when(hit, F.lit(None)).otherwise(own)
        elif c == "ext":
            value = F.when(hit, F.lower(got)).otherwise(own)
        elif c in incoming.columns:
            value = F.when(hit, got).otherwise(own)
        else:
            value = own
        columns.append(value.cast(files.schema[c].dataType).alias(c))
    out = joined.select(*columns)
    rgb = parse_hex_color(F.col("dominant_color"))
    out = out.withColumns({f"dominant_{k}": rgb[k] for k in "rgb"})
    top = files.agg(F.max("id")).first()[0] or 0
    from galena.operators.ranking import numbered

    fresh = numbered(out.filter(F.col("id").isNull()), [F.col("normalized_path").asc()], "_new")
    fresh = fresh.withColumn("id", F.col("_new") + F.lit(top)).drop("_new")
    return out.filter(F.col("id").isNotNull()).unionByName(fresh)


def update_where(rows: DataFrame, test: Column, **values: Column) -> DataFrame:
    """Columns set where ``test`` holds."""
    return rows.withColumns({k: F.when(F.coalesce(test, F.lit(False)), v).otherwise(F.col(k)).cast(rows.schema[k].dataType) for k, v in values.items()})


def mark_missing(files: DataFrame, test: Column, at: str) -> DataFrame:
    return update_where(files, test & is_active(), missing_at=F.lit(at), updated_at=F.lit(at))


def soft_delete(files: DataFrame, test: Column, at: str) -> DataFrame:
    return update_where(files, test, deleted_at=F.lit(at), missing_at=F.lit(None), updated_at=F.lit(at))


def restore(files: DataFrame, test: Column, at: str) -> DataFrame:
    return update_where(files, test, deleted_at=F.lit(None), missing_at=F.lit(None), updated_at=F.lit(at))


def delete_files(files: DataFrame, gone: DataFrame, *dependents: DataFrame) -> list[DataFrame]:
    """Files without ``gone`` (id), and each dependent table (file_id) without them."""
    keys = gone.select("id").distinct()
    return [files.join(keys, "id", "left_anti"), *(d.join(keys.select(F.col("id").alias("file_id")), "file_id", "left_anti") for d in dependents)]


def ancestor_folders(paths: DataFrame, root: str, folders: DataFrame) -> DataFrame:
    """Folders that must be there for ``paths`` (path: directories) below ``root`` and are not: path, parent_path, name."""
    top = root.rstrip("/")
    below = paths.select(normalize_path(F.col("path")).alias("path")).filter(has_prefix(F.col("path"), F.lit(top)) & (F.col("path") != top))
    parts = F.filter(F.split(F.substring(F.col("path"), F.lit(len(top) + 2), F.length("path")), "/"), lambda x: x != "")
    chain = below.select(parts.alias("parts")).distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.concat(F.lit(top + "/"), F.array_join(F.slice("parts", F.lit(1), k), "/")))).alias("path"))
    known = folders.select(F.col("normalized_path").alias("path"))
    new = chain.distinct().join(known, "path", "left_anti")
    return new.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("parent_path"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


def prepend_sort_order(folders: DataFrame) -> DataFrame:
    """(parent_id, sort_order) a new first folder takes among its active siblings; 0 goes for parents without."""
    live = folders.filter(F.col("deleted_at").isNull())
    return live.groupBy("parent_id").agg((F.min(F.coalesce("sort_order", F.lit(0))) - 1).alias("sort_order"))


def move_subtree(rows: DataFrame, old: str, new: str, *columns: str) -> DataFrame:
    """Path columns with prefix ``old`` put below ``new``; siblings that merely begin alike stay."""
    return rows.withColumns({c: replace_prefix(F.col(c), F.lit(old), F.lit(new)) for c in columns or ("path", "normalized_path")})


def delete_subtree(folders: DataFrame, path: str, at: str) -> DataFrame:
    return update_where(folders, has_prefix(F.col("normalized_path"), F.lit(path)), deleted_at=F.lit(at))


def restore_subtree(folders: DataFrame, temp: str, target: str, root_id: int, parent_id: int | None) -> DataFrame:
    inside = has_prefix(F.col("normalized_path"), F.lit(temp))
    freed = update_where(folders, inside, deleted_at=F.lit(None))
    moved = move_subtree(freed, temp, target)
    return update_where(moved, F.col("id") == root_id, parent_id=F.lit(parent_id))


def reorder(rows: DataFrame, ids: list[int], parent_id: int | None = None, set_parent: bool = False) -> DataFrame:
    """sort_order by place in ``ids`` (and their parent, if asked)."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), "_pos int, _id long")
    joined = rows.join(wanted, rows["id"] == wanted["_id"], "left")
    hit = F.col("_id").isNotNull()
    out = joined.withColumn("sort_order", F.when(hit, F.col("_pos")).otherwise(F.col("sort_order")).cast(rows.schema["sort_order"].dataType))
    if set_parent:
        out = out.withColumn("parent_id", F.when(hit, F.lit(parent_id).cast("long")).otherwise(F.col("parent_id")))
    return out.drop("_pos", "_id")


def link_tags(file_tags: DataFrame, links: DataFrame) -> DataFrame:
    """Add links (file_id, tag_id, ord); those there already keep their place."""
    both = file_tags.select("file_id", "tag_id", "ord").unionByName(links.select("file_id", "tag_id", "ord"))
    return both.groupBy("file_id", "tag_id").agg(F.min("ord").alias("ord"))


def unlink_tags(file_tags: DataFrame, links: DataFrame) -> DataFrame:
    return file_tags.join(links.select("file_id", "tag_id").distinct(), ["file_id", "tag_id"], "left_anti")


def delete_tags(tags: DataFrame, file_tags: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """Tags and links without ``ids`` and all below them."""
    from galena.operators.trees import closure, tag_tree

    gone = closure(tag_tree(tags)).filter(F.col("ancestor").isin(ids)).select(F.col("descendant").alias("id")).distinct()
    return tags.join(gone, "id", "left_anti"), file_tags.join(gone.select(F.col("id").alias("tag_id")), "tag_id", "left_anti")


def merge_last(rows: DataFrame, incoming: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``incoming`` replace those of the same key (embeddings, settings, trash entries); of repeated ones the first of ``order`` counts."""
    incoming = last_of(incoming, key, order)
    return rows.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def embedding_errors(rows: DataFrame, failed: DataFrame, at: str) -> DataFrame:
    """Embeddings with an error row for each of ``failed`` (file_id, model_id, last_error)."""
    new = failed.select("file_id", "model_id", F.lit(0).alias("dimensions"), F.lit(None).cast("array<float>").alias("embedding"), F.lit("error").alias("status"), "last_error", F.lit(at).alias("indexed_at"))
    return merge_last(rows, new, ["file_id"])


def adjust_trash_counts(entries: DataFrame, deltas: DataFrame) -> DataFrame:
    """file_count moved by (folder_id, delta), never below zero."""
    change = deltas.groupBy("folder_id").agg(F.sum("delta").alias("_d"))
    joined = entries.join(change, "folder_id", "left")
    return joined.withColumn("file_count", F.greatest(F.col("file_count") + F.coalesce("_d", F.lit(0)), F.lit(0)).cast("int")).drop("_d")


def free_names(wanted: DataFrame, taken: DataFrame, suffix: str = " ({n})", tries: int = 16) -> DataFrame:
    """(id, name): no two alike and none of ``taken`` (name); null after ``tries``.

    The first row by id keeps a free name; others of the name take name +
    suffix 2, 3, ... in turn, leaving out what is taken or wanted by any row.
    """
    left, right = suffix.split("{n}")
    place = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    busy = taken.select(F.col("name").alias("option")).distinct()
    rows = wanted.select("id", "name").withColumn("_k", place)
    names = rows.select("name").distinct()
    own = names.join(busy, names["name"] == busy["option"], "left_anti").select("name", F.col("name").alias("option"), F.lit(0).alias("at"))
    more = names.select("name", F.posexplode(F.transform(F.sequence(F.lit(2), F.lit(tries)), lambda n: F.concat("name", F.lit(left), n.cast("string"), F.lit(right)))).alias("at", "option"))
    more = more.join(busy.unionByName(names.select(F.col("name").alias("option"))).distinct(), "option", "left_anti").select("name", "option", (F.col("at") + 1).alias("at"))
    free = own.unionByName(more).withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy("at"))).select("name", "_k", "option")
    return rows.join(free, ["name", "_k"], "left").select("id", F.col("option").alias("name"))


def overwrite_basics(files: DataFrame, incoming: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Known paths of ``incoming`` (normalized_path and columns of files) take its values as they are, nulls too, and lose both tombstones."""
    new = last_of(incoming, ["normalized_path"], order).select(*[F.col(c).alias(f"_{c}") for c in incoming.columns])
    joined = files.join(new, files["normalized_path"] == new["_normalized_path"], "left")
    hit = F.col("_normalized_path").isNotNull()
    values = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).cast(files.schema[c].dataType) for c in incoming.columns if c in files.columns and c not in ("id", "normalized_path")}
    values |= {c: F.when(~hit, F.col(c)) for c in ("deleted_at", "missing_at")}
    return joined.withColumns(values).select(*files.columns)


def create_rows(rows: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with those of ``new`` after them, numbered in ``order`` from the largest id on."""
    from galena.operators.ranking import numbered

    top = rows.agg(F.max("id")).first()[0] or 0
    fresh = numbered(new, order, "_n").withColumn("id", F.col("_n") + F.lit(top)).drop("_n")
    return rows.unionByName(fresh, allowMissingColumns=True)


def move_tag(tags: DataFrame, tag_id: int, parent_id: int | None, sibling_ids: list[int]) -> DataFrame:
    """A tag put under another parent, and its new siblings in the order given."""
    moved = update_where(tags, F.col("id") == tag_id, parent_id=F.lit(parent_id))
    return reorder(moved, sibling_ids)


def delete_folder(folders: DataFrame, files: DataFrame, path: str, at: str, to_trash: bool, on_disk: bool) -> tuple[DataFrame, DataFrame]:
    """Folders and files after a folder is deleted: with trash mode on and the directory there, tombstones below it; else they are gone."""
    under = has_prefix(F.col("normalized_path"), F.lit(path))
    if to_trash and on_disk:
        return delete_subtree(folders, path, at), update_where(files, under & is_active(), missing_at=F.lit(at), updated_at=F.lit(at))
    return folders.filter(~under), files.filter(~under)


def clear_if_changed(embeddings: DataFrame, before: dict | None, after: dict | None, relevant: tuple[str, ...]) -> DataFrame:
    """Embeddings, none of them if a setting they depend on differs."""
    same = all((before or {}).get(k) == (after or {}).get(k) for k in relevant)
    return embeddings if same else embeddings.limit(0)


def restore_paths(wanted: DataFrame, folders: DataFrame, root: str, suffix: str = " (\u5df2\u6062\u590d", tries: int = 32) -> DataFrame:
    """(id, parent_path, name) where trashed folders (id, parent_path, name) go: their parent if it is there, else ``root``, under a free name.

    A taken name gets ``suffix`` and a closing parenthesis, then ``suffix``
    with 2, 3, ... before it. Folders that go to one place at once are named
    in turn.
    """
    live = folders.filter(F.col("deleted_at").isNull()).select(F.col("normalized_path").alias("_live"))
    placed = wanted.join(live, wanted["parent_path"] == F.col("_live"), "left").select("id", "name", F.coalesce("_live", F.lit(root)).alias("parent_path"))
    full = placed.select("id", F.concat_ws("/", "parent_path", "name").alias("name"))
    taken = folders.filter(F.col("deleted_at").isNull()).select(F.col("normalized_path").alias("name"))
    free = free_names(full, taken, suffix + " {n})", tries)
    # the second of a name has no number
    name = F.regexp_replace("name", r" 2\)$", ")")
    return free.select("id", F.regexp_extract("name", "^(.*)/[^/]*$", 1).alias("parent_path"), F.regexp_extract(name, "([^/]*)$", 1).alias("name"))


def expand_imports(items: DataFrame, files: DataFrame, folder_path: str) -> DataFrame:
    """(item, path, target_dir) of an import: a file as it is, a directory as all files below it, each in the folder that mirrors its own.

    ``items`` has item and path, ``files`` path and relative_dir (of the
    directory source) and the item it was found for.
    """
    base = folder_path.rstrip("/")
    own = items.filter("not is_directory").select("item", "path", F.lit(base).alias("target_dir"))
    name = F.regexp_extract(F.col("d.path"), "([^/]+)/?$", 1)
    below = files.alias("f").join(items.filter("is_directory").alias("d"), "item")
    inside = F.when(F.col("f.relative_dir") == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.col("f.relative_dir")))
    return own.unionByName(below.select("item", F.col("f.path").alias("path"), F.concat(F.lit(base + "/"), name, inside).alias("target_dir")))


def empty_trash(files: DataFrame, folders: DataFrame, entries: DataFrame, *dependents: DataFrame) -> list[DataFrame]:
    """Files, folders, trash entries and dependents of files without all that is deleted."""
    gone = files.filter(F.col("deleted_at").isNotNull())
    left, *rest = delete_files(files, gone, *dependents)
    return [left, folders.filter(F.col("deleted_at").isNull()), entries.limit(0), *rest]
