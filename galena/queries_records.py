"""Queries over records, settings, trash prefixes and placements, and their oracle SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.operators import placement, records
from galena.queries import files_of, query
from galena.session import shared_folder
from galena.sources import listing
from galena.sources.library import view

COLORED = """CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '[{"color":"' || dominant_color || '","percentage":' || CAST(rating AS STRING) || '.5},{"color":"#000000","percentage":40}]' END"""


def _colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(spark, sf_dir).withColumn("color_distribution", F.expr(COLORED)).withColumn("thumb_hash", F.expr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE sync_id END"))


@query(
    f"""SELECT id, path, folder_id AS "folderId", last_accessed_at AS "lastAccessedAt", rating, dominant_color AS "dominantColor", coalesce(nullif({COLORED.replace("STRING", "VARCHAR")}, ''), '[]') AS "colorDistribution",
    CASE id % 3 WHEN 2 THEN sync_id ELSE '' END AS "thumbHash", content_hash AS "contentHash", deleted_at AS "deletedAt", missing_at AS "missingAt", 0 AS tags FROM files""",
    "files",
)
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as records: what is null has its default."""
    r = records.file_records(_colored(spark, sf_dir))
    return r.select("id", "path", "folderId", "lastAccessedAt", "rating", "dominantColor", "colorDistribution", "thumbHash", "contentHash", "deletedAt", "missingAt", F.size("tags").alias("tags"))


@query("""SELECT id, path, name, parent_id, created_at, id % 4 = 1 AS "isSystem", CASE WHEN id % 3 = 0 THEN 0 ELSE sort_order END AS "sortOrder", deleted_at AS "deletedAt" FROM folders""", "folders")
def folder_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "folders").withColumn("is_system", F.when(F.col("id") % 4 != 0, (F.col("id") % 4 == 1).cast("int"))).withColumn("sort_order", F.when(F.col("id") % 3 != 0, F.col("sort_order")))
    return records.folder_records(f)


@query("""SELECT id, CASE WHEN id % 5 < 2 THEN 0 ELSE 2 END AS n, CASE WHEN id % 5 >= 2 THEN dominant_color END AS first, CASE WHEN id % 5 >= 2 THEN rating + 0.5::DOUBLE END AS share FROM files""", "files")
def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes from the records' JSON text."""
    p = records.file_records(_colored(spark, sf_dir)).select("id", records.palette(F.col("colorDistribution")).alias("p"))
    return p.select("id", F.size("p").alias("n"), F.get("p", F.lit(0))["color"].alias("first"), F.get("p", F.lit(0))["percentage"].alias("share"))


@query("SELECT f.id, f.path, f.name, f.deleted_at, e.temp_path, e.file_count, e.subfolder_count, e.deleted_at AS trashed_at FROM folders f JOIN folder_trash_entries e ON e.folder_id = f.id", "folder_trash_entries", "folders")
def trashed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.trashed_folders(view(spark, sf_dir, "folders"), view(spark, sf_dir, "folder_trash_entries"))


@query(
    """WITH t AS (SELECT f.id, f.path, '/t/' || f.id AS temp FROM folders f WHERE f.id % 13 = 0 OR f.id % 4 = 2), p AS (SELECT path || '/x.png' AS path FROM folders UNION ALL SELECT path FROM folders),
    h AS (SELECT p.path, t.id, t.path AS top, t.temp, row_number() OVER (PARTITION BY p.path ORDER BY t.id) AS n, row_number() OVER (PARTITION BY p.path ORDER BY length(t.path) DESC) AS deep FROM p JOIN t ON p.path = t.path OR starts_with(p.path, t.path || '/'))
    SELECT path, id AS folder_id, top AS original_path, temp || substr(path, length(top) + 1) AS source_path, deep > 1 AS above_deepest FROM h WHERE n = 1""",
    "folders",
)
def trashed_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first trashed folder over a path; not always the deepest."""
    f = view(spark, sf_dir, "folders").withColumn("deleted_at", F.when((F.col("id") % 13 == 0) | (F.col("id") % 4 == 2), F.lit("2026")))
    e = f.filter("deleted_at IS NOT NULL").select(F.col("id").alias("folder_id"), F.concat(F.lit("/t/"), "id").alias("temp_path"), "deleted_at", F.lit(1).alias("file_count"), F.lit(0).alias("subfolder_count"))
    paths = f.select(F.concat("path", F.lit("/x.png")).alias("path")).unionByName(f.select("path"))
    found = records.trashed_above(paths, f, e)
    deepest = paths.select("path", F.explode(records.above(F.col("path"))).alias("top")).join(e.join(f.select(F.col("id").alias("folder_id"), F.col("path").alias("top")), "folder_id"), "top").groupBy("path").agg(F.max(F.length("top")).alias("most"))
    return found.join(deepest, "path").select("path", "folder_id", "original_path", "source_path", (F.length("original_path") < F.col("most")).alias("above_deepest"))


@query("SELECT * FROM (VALUES (1, '/a', 'kept'), (2, '/b', 'set'), (2, '/b', 'added again'), (3, '/c', 'added to none')) v(id, path, step) UNION ALL SELECT count(*), 'v7', 'setting' FROM region WHERE r_regionkey < 0 HAVING count(*) = 0")
def index_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one index path: replaced, added when it is there, removed and added anew; a setting that a table gives."""
    first = spark.createDataFrame([(1, "/a")], "id long, path string")
    second = records.set_index_path(first, "/b")
    steps = {"kept": records.remove_index_path(first, "/x"), "set": second, "added again": records.add_index_path(second, "/b"), "added to none": records.set_index_path(second, "/c")}
    out = [df.withColumn("step", F.lit(k)) for k, df in steps.items()]
    settings = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("k"), "n_nationkey").alias("key"), F.concat(F.lit("v"), "n_nationkey").alias("value"))
    found = spark.createDataFrame([(0 if records.setting(settings, "none") is None else 1, records.setting(settings, "k7"), "setting")], "id long, path string, step string")
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(found)


@query("SELECT id, CASE WHEN id % 2 = 0 AND NOT (name = 'ASIA' OR id = 14) THEN 1 ELSE 0 END AS is_system FROM folders WHERE id % 7 <> 3", "folders")
def folder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder rows deleted, and system flags taken off by name and by id."""
    f = view(spark, sf_dir, "folders").withColumn("is_system", (F.col("id") % 2 == 0).cast("int"))
    left = records.delete_folder_records(f, f.filter("id % 7 = 3"))
    return records.clear_system_flag(left, "ASIA", 14).select("id", "is_system")


NAMES = "SELECT id, '/library/s' || CAST(id % 40 AS STRING) || '/n' || CAST(id % 90 AS STRING) || '.' || lower(ext) AS path, id % 3 AS kind FROM files"


@query(
    f"""WITH a AS ({NAMES.replace("STRING", "VARCHAR")}), t AS (SELECT regexp_replace(path, '^/library/s[0-9]+/', '/library/t' || CAST(id % 2 AS VARCHAR) || '/') AS path FROM a WHERE kind = 1),
    w AS (SELECT *, '/library/t' || CAST(id % 2 AS VARCHAR) || '/' || regexp_extract(path, '[^/]+$') AS want FROM a WHERE kind <> 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY id) - CASE WHEN want IN (SELECT path FROM t) THEN 0 ELSE 1 END AS k FROM w)
    SELECT id, CASE WHEN k = 0 THEN want ELSE regexp_replace(want, '([.][a-z0-9]+)$', '_moved_ff_' || CAST(k - 1 AS VARCHAR) || '\\1') END AS target_path FROM k""",
    "files",
)
def target_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files moved to two folders in which some of their names are taken and many are wanted by several."""
    a = spark.sql(NAMES.replace("FROM files", "FROM {files}"), files=files_of(spark, sf_dir))
    folder = F.concat(F.lit("/library/t"), F.col("id") % 2)
    taken = a.filter("kind = 1").select(F.concat(folder, F.lit("/"), F.substring_index("path", "/", -1)).alias("path"))
    return placement.target_paths(a.filter("kind <> 1").withColumn("folder", folder), taken, "moved", 255).select("id", "target_path")


@query(
    f"""WITH a AS ({NAMES.replace("STRING", "VARCHAR")}), c AS (SELECT id, path, rating FROM files WHERE id % 4 = 0)
    SELECT (SELECT max(id) FROM files) + row_number() OVER (ORDER BY c.id) AS id, '/library/copies/' || regexp_extract(path, '[^/]+$') AS path, 77 AS folder_id, rating, (SELECT count(*) FROM file_tags t WHERE t.file_id = c.id) AS tags, TRUE AS there FROM c""",
    "files", "file_tags",
)
def copied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files copied to a folder, rows with their tags and the files themselves."""
    f, links = files_of(spark, sf_dir), view(spark, sf_dir, "file_tags")
    root = f"{shared_folder(spark)}/copies-{uuid4().hex}"
    own = f.filter("id % 4 = 0")
    listing.write_files(own.select(F.expr("substr(path, 2)").alias("path"), F.col("name").cast("binary").alias("content")), root)
    new, tagged = placement.copied_files(f, links, own.select("id", F.lit("/library/copies").alias("folder"), F.lit(77).cast("long").alias("folder_id")), "2027", 1)
    listing.copy_files(own.select("name", F.concat(F.lit(root), "path").alias("source")).join(new.select("name", F.concat(F.lit(root), "path").alias("target")), "name"))
    there = listing.tree(spark, f"{root}/library/copies").filter("kind = 'file'").select(F.substring_index("path", "/", -1).alias("name"), F.lit(True).alias("there"))
    n = tagged.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("tags"))
    out = new.select("id", "path", "name", "folder_id", "rating").join(n, "id", "left").join(there, "name", "left")
    return out.select("id", "path", "folder_id", "rating", F.coalesce("tags", F.lit(0)).alias("tags"), F.coalesce("there", F.lit(False)).alias("there"))
