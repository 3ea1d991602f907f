"""Copies and moves of files to folders, under names that are free there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.operators.ranking import numbered


def target_paths(rows: DataFrame, taken: DataFrame, suffix: str, at_ms: int, stay: bool = False) -> DataFrame:
    """(id, path, target_path) of ``rows`` (id, path, folder): each under its name in ``folder``, or under a name that is free there.

    Of rows that want one path the first by id has it, if no path of
    ``taken`` (path) is the same; the others are ``stem_suffix_time_n.ext``,
    time in hexadecimal milliseconds, n from 0 past what is taken or wanted.
    None is left without a path. With ``stay`` a row that is in its place
    already keeps it. Rows of one wanted path are numbered by one task.
    """
    name = F.substring_index("path", "/", -1)
    parted = rows.select("id", "path", "folder", F.concat("folder", F.lit("/"), name).alias("want"), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1).alias("stem"), F.regexp_extract(name, r"^.+?(\.[^.]*)?$", 1).alias("ext"))
    same = (F.col("want") == F.col("path")) if stay else F.lit(False)
    kept = parted.filter(same).select("id", "path", F.col("want").alias("target_path"))
    moving = parted.filter(~same).withColumn("k", F.row_number().over(Window.partitionBy("want").orderBy("id")))
    wants = moving.groupBy("want").agg(F.first("folder").alias("folder"), F.first("stem").alias("stem"), F.first("ext").alias("ext"), F.count(F.lit(1)).alias("n"))
    busy = taken.select(F.col("path").alias("option")).distinct()
    own = wants.join(busy, wants["want"] == busy["option"], "left_anti").select("want", F.col("want").alias("option"), F.lit(-1).alias("at"))
    # as many names as there are rows, and as many more as are taken among the names of this time
    like = F.concat("stem", F.lit(f"_{suffix}_{at_ms:x}_"))
    option = lambda n: F.concat("folder", F.lit("/"), like, n.cast("string"), "ext")
    used = busy.unionByName(wants.select(F.col("want").alias("option"))).distinct()
    tail = rf"^(.*)_{suffix}_{at_ms:x}_(\d+)(\.[^.]*)?$"
    groups = used.filter(F.col("option").rlike(tail)).groupBy(F.regexp_replace("option", tail, "$1$3").alias("want")).agg(F.count(F.lit(1)).alias("m"))
    more = wants.join(groups, "want", "left").select("want", F.explode(F.transform(F.sequence(F.lit(0), (F.col("n") + F.coalesce("m", F.lit(0))).cast("int")), lambda n: F.struct(option(n).alias("option"), n.alias("at")))).alias("o")).select("want", "o.*")
    free = own.unionByName(more.join(used, "option", "left_anti").select("want", "option", "at"))
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("want").orderBy("at")))
    placed = moving.join(free, ["want", "k"], "left").select("id", "path", F.col("option").alias("target_path"))
    return kept.unionByName(placed)


def moved_files(files: DataFrame, moves: DataFrame, at_ms: int) -> DataFrame:
    """``files`` after ``moves`` (id, folder: path, folder_id): new paths, names and folders; others as they were."""
    wanted = files.join(moves, "id").select("id", "path", "folder")
    placed = target_paths(wanted, files.join(wanted.select("id"), "id", "left_anti"), "moved", at_ms, stay=True).select("id", "target_path")
    to = moves.select("id", F.col("folder_id").alias("_folder"))
    joined = files.join(placed, "id", "left").join(to, "id", "left")
    hit = F.col("target_path").isNotNull()
    changed = {"path": F.coalesce("target_path", "path"), "normalized_path": F.when(hit, F.col("target_path")).otherwise(F.col("normalized_path")), "name": F.when(hit, F.substring_index("target_path", "/", -1)).otherwise(F.col("name")), "folder_id": F.when(hit, F.col("_folder")).otherwise(F.col("folder_id"))}
    return joined.withColumns(changed).select(*files.columns)


def copied_files(files: DataFrame, file_tags: DataFrame, copies: DataFrame, at: str, at_ms: int) -> tuple[DataFrame, DataFrame]:
    """(new files, new links) of ``copies`` (id, folder: path, folder_id): rows with new ids, as imports of ``at``, with rating, description, source and tags of the original."""
    wanted = files.join(copies, "id").select("id", "path", "folder")
    placed = target_paths(wanted, files, "copy", at_ms).select("id", "target_path")
    last = files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ids = numbered(placed, [F.col("id").asc()], "n").select("id", "target_path", (F.col("n") + last).alias("new_id"))
    rows = files.join(ids, "id").join(copies.select("id", F.col("folder_id").alias("_folder")), "id")
    own = {"path": F.col("target_path"), "normalized_path": F.col("target_path"), "name": F.substring_index("target_path", "/", -1), "folder_id": F.col("_folder"), "imported_at": F.lit(at), "deleted_at": F.lit(None).cast("string"), "missing_at": F.lit(None).cast("string")}
    new = rows.withColumns({k: v for k, v in own.items() if k in files.columns}).drop("id").withColumnRenamed("new_id", "id").select(*files.columns)
    links = file_tags.join(ids.select(F.col("id").alias("file_id"), "new_id"), "file_id").drop("file_id").withColumnRenamed("new_id", "file_id").select(*file_tags.columns)
    return new, links
