"""Asset-library tables.

``schemas`` are the library's own tables. ``view`` derives such tables from
the generated test tables by SQL that Spark and DuckDB both read, so that an
operator and its oracle see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}


def _struct(text: str) -> T.StructType:
    """A schema from ``name type`` pairs, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


SCHEMAS: dict[str, T.StructType] = {
    "files": _struct(
        "id long, path string, normalized_path string, name string, ext string, size long, width int, height int, folder_id long, "
        "created_at string, modified_at string, imported_at string, last_accessed_at string, rating int, description string, "
        "source_url string, dominant_color string, dominant_r int, dominant_g int, dominant_b int, color_distribution string, "
        "thumb_hash string, deleted_at string, missing_at string, sync_id string, content_hash string, fs_modified_at string, updated_at string"
    ),
    "folders": _struct("id long, path string, normalized_path string, name string, parent_id long, created_at string, is_system int, sort_order int, deleted_at string, sync_id string, updated_at string"),
    "tags": _struct("id long, name string, color string, parent_id long, sort_order int, sync_id string, updated_at string"),
    "file_tags": _struct("file_id long, tag_id long, ord long"),
    "file_visual_embeddings": _struct("file_id long, model_id string, dimensions int, embedding array<float>, source_size long, source_modified_at string, source_content_hash string, indexed_at string, status string, last_error string"),
    "folder_trash_entries": _struct("folder_id long, temp_path string, deleted_at string, file_count int, subfolder_count int"),
    "settings": _struct("key string, value string"),
    "fs_events": _struct("path string, kind string, ts timestamp, size long, mtime string"),
}

_HEX = "substr('0123456789ABCDEF', CAST(floor({0} / 16.0) AS INT) + 1, 1) || substr('0123456789ABCDEF', CAST({0} % 16 AS INT) + 1, 1)"
_DAY = "'2026-' || lpad(CAST(1 + {0} % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + {0} % 28 AS STRING), 2, '0') || 'T' || lpad(CAST({0} % 24 AS STRING), 2, '0') || ':' || lpad(CAST({0} * 7 % 60 AS STRING), 2, '0') || ':00.000Z'"

_FILES = f"""
SELECT id, '/library/' || folder || '/' || stem || '.' || ext AS path, '/library/' || folder || '/' || stem || '.' || ext AS normalized_path,
       stem || '.' || ext AS name, ext, size,
       CAST(100 + id * 37 % 5000 AS INT) AS width, CAST(100 + id * 53 % 4000 AS INT) AS height,
       CASE WHEN id % 11 = 0 THEN NULL ELSE TRY_CAST(substr(folder, 4) AS BIGINT) END AS folder_id,
       {_DAY.format("id")} AS created_at, {_DAY.format("(id * 3)")} AS modified_at, {_DAY.format("(id * 5)")} AS imported_at,
       CASE WHEN id % 3 = 0 THEN {_DAY.format("(id * 11)")} END AS last_accessed_at,
       CAST(coalesce(quality, 0) * (1 + id % 5) AS INT) AS rating,
       '' AS description, 'https://' || folder || '.example.com/' || CAST(id AS STRING) AS source_url,
       CASE WHEN id % 10 = 0 THEN '' ELSE '#' || {_HEX.format("(id * 37 % 256)")} || {_HEX.format("(id * 59 % 256)")} || {_HEX.format("(id * 83 % 256)")} END AS dominant_color,
       CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id * 37 % 256 AS INT) END AS dominant_r,
       CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id * 59 % 256 AS INT) END AS dominant_g,
       CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id * 83 % 256 AS INT) END AS dominant_b,
       CASE WHEN id % 17 = 0 THEN {_DAY.format("(id * 13)")} END AS deleted_at,
       CASE WHEN id % 19 = 0 THEN {_DAY.format("(id * 17)")} END AS missing_at,
       'file_' || CAST(id AS STRING) AS sync_id,
       CASE WHEN id % 29 = 0 THEN '' WHEN id % 31 = 0 THEN NULL ELSE md5(text) END AS content_hash,
       {_DAY.format("(id * 3)")} AS fs_modified_at, {_DAY.format("(id * 5)")} AS updated_at
FROM (SELECT d.doc_id AS id, d.source AS folder, d.source || ' ' || d.lang || ' ' || CAST(d.doc_id AS STRING) AS stem, d.text, d.n_chars AS size, l.quality,
             CASE d.doc_id % 8 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'mp4' WHEN 3 THEN 'pdf' WHEN 4 THEN 'MP3' WHEN 5 THEN 'zip' WHEN 6 THEN 'webp' ELSE 'svg' END AS ext
      FROM {{documents}} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {{labels}} GROUP BY doc_id) l ON d.doc_id = l.doc_id) x"""

_FOLDERS = f"""
SELECT id, path, path AS normalized_path, name, parent_id, {_DAY.format("id")} AS created_at, CAST(0 AS INT) AS is_system, sort_order,
       CASE WHEN id % 13 = 0 THEN {_DAY.format("id")} END AS deleted_at
FROM (SELECT CAST(1000 + r_regionkey AS BIGINT) AS id, '/library/' || r_name AS path, r_name AS name, CAST(NULL AS BIGINT) AS parent_id, CAST(r_regionkey AS INT) AS sort_order FROM {{region}}
      UNION ALL
      SELECT CAST(n_nationkey AS BIGINT), '/library/' || r_name || '/' || n_name, n_name, CAST(1000 + n_regionkey AS BIGINT), CAST(n_nationkey % 3 AS INT) FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
      UNION ALL
      SELECT CAST(2000 + s_suppkey AS BIGINT), '/library/' || r_name || '/' || n_name || '/' || s_name, s_name, CAST(s_nationkey AS BIGINT), CAST(s_suppkey % 5 AS INT)
      FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey) x"""

_TAGS = """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, '#3b82f6' AS color,
       CASE WHEN n_nationkey % 6 = 5 THEN 9999 WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_nationkey - n_nationkey % 4 AS BIGINT) END AS parent_id,
       CAST(n_nationkey % 5 AS INT) AS sort_order
FROM {nation}"""

_FILE_TAGS = """
SELECT file_id, tag_id, min(ord) AS ord
FROM (SELECT doc_id AS file_id, doc_id % 25 AS tag_id, doc_id * 2 AS ord FROM {documents} WHERE doc_id % 4 <> 0
      UNION ALL SELECT doc_id, doc_id * 7 % 25, doc_id * 2 + 1 FROM {documents} WHERE doc_id % 3 = 0) x
GROUP BY file_id, tag_id"""

_EMBEDDINGS = f"""
SELECT e.vec_id AS file_id, CASE WHEN e.label % 2 = 0 THEN 'clip-a' ELSE 'clip-b' END AS model_id, CAST(64 AS INT) AS dimensions,
       CASE WHEN e.vec_id % 23 = 0 THEN NULL ELSE e.embedding END AS embedding,
       d.n_chars + CASE WHEN e.vec_id % 7 = 0 THEN 1 ELSE 0 END AS source_size,
       {_DAY.format("(e.vec_id * 3)")} AS source_modified_at,
       CASE e.vec_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'stale' ELSE md5(d.text) END AS source_content_hash,
       {_DAY.format("(e.vec_id * 5)")} AS indexed_at,
       CASE WHEN e.vec_id % 23 = 0 THEN 'error' WHEN e.vec_id % 37 = 0 THEN 'pending' ELSE 'ready' END AS status
FROM {{embeddings}} e JOIN {{documents}} d ON e.vec_id = d.doc_id"""

_EVENTS = """
SELECT 'file' || CAST(user_id AS STRING) AS path,
       CASE event_type WHEN 'view' THEN 'change' WHEN 'click' THEN 'change' WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'add' ELSE 'unlink' END AS kind,
       ts, event_id, CAST(floor(value) AS BIGINT) AS size
FROM {events}"""

_TRASH = """
SELECT id AS folder_id, '/holding/' || CAST(id AS STRING) AS temp_path, deleted_at, CAST(1 + id % 4 AS INT) AS file_count, CAST(id % 3 AS INT) AS subfolder_count
FROM folders WHERE deleted_at IS NOT NULL"""

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "files": (_FILES, ("documents", "labels")),
    "folders": (_FOLDERS, ("region", "nation", "supplier")),
    "tags": (_TAGS, ("nation",)),
    "file_tags": (_FILE_TAGS, ("documents",)),
    "file_visual_embeddings": (_EMBEDDINGS, ("embeddings", "documents")),
    "fs_events": (_EVENTS, ("events",)),
    "folder_trash_entries": (_TRASH, ("region", "nation", "supplier")),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A library table derived from the test tables in ``sf_dir``."""
    sql, tables = VIEWS[name]
    if name == "folder_trash_entries":
        folders = view(spark, sf_dir, "folders")
        return spark.sql(sql.replace("FROM folders", "FROM {folders}"), folders=folders)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if "md5(" in sql:  # taken where texts are read, else whole texts go through the shuffles of the joins
        frames["documents"] = frames["documents"].withColumn("text", F.md5("text"))
        sql = sql.replace("md5(text)", "text").replace("md5(d.text)", "d.text")
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB after the named views, for queries that begin with WITH or SELECT."""
    names = tuple(dict.fromkeys((*(("folders",) if "folder_trash_entries" in names else ()), *names)))
    views = ",\n".join(f"{n} AS ({VIEWS[n][0].format(**{t: t for t in VIEWS[n][1]})})" for n in names)
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else ""
    body = sql.strip()
    if body.upper().startswith("WITH"):
        body = ", " + body.split(None, 2 if recursive else 1)[2 if recursive else 1]
    return f"WITH {recursive}{views}\n{body}"
