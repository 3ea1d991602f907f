"""Queries over moves among siblings, clipboard payloads and note addresses, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import urls
from galena.operators import moves, records
from galena.queries import files_of, query
from galena.sources.library import view

# What moves, as wanted: every fifth tag beside the one after it. A row below the moved one moves nothing.
BESIDE = """WITH RECURSIVE w AS (SELECT id, id + 1 AS target, id % 2 = 0 AS before FROM {t} WHERE id % 5 = 0),
    up AS (SELECT id, id AS above FROM {t} UNION SELECT up.id, {t}.parent_id FROM up JOIN {t} ON {t}.id = up.above WHERE {t}.parent_id IS NOT NULL),
    m AS (SELECT w.id, w.before, r.parent_id, w.target FROM w JOIN {t} r ON r.id = w.target WHERE w.target % 5 <> 0 AND NOT EXISTS (FROM up WHERE up.id = r.parent_id AND up.above = w.id)),
    s AS (SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, name, id) - 1 AS p FROM {t} WHERE id NOT IN (SELECT id FROM m)),
    l AS (SELECT id, parent_id, CAST(p AS DOUBLE) AS q FROM s UNION ALL SELECT m.id, m.parent_id, s.p + CASE WHEN m.before THEN -0.5 ELSE 0.5 END FROM m JOIN s ON s.id = m.target),
    n AS (SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY q, id) - 1 AS n FROM l),
    x AS (SELECT coalesce(parent_id, -1) AS p FROM m UNION SELECT coalesce(t.parent_id, -1) FROM {t} t JOIN m ON m.id = t.id)
    SELECT t.id, n.parent_id, CASE WHEN coalesce(n.parent_id, -1) IN (FROM x) THEN n.n ELSE t.sort_order END AS sort_order FROM {t} t JOIN n ON n.id = t.id"""


@query(BESIDE.format(t="tags"), "tags")
def tags_put_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags dragged before or after another: parents and both lists of siblings."""
    tags = view(spark, sf_dir, "tags")
    wanted = tags.filter("id % 5 = 0").select("id", (F.col("id") + 1).alias("target"), (F.col("id") % 2 == 0).alias("before"), F.col("id").alias("pos"))
    return moves.beside(tags, wanted).select("id", "parent_id", "sort_order")


@query(
    """WITH RECURSIVE up AS (SELECT id, id AS above FROM folders UNION SELECT up.id, folders.parent_id FROM up JOIN folders ON folders.id = up.above WHERE folders.parent_id IS NOT NULL),
    w AS (SELECT f.id, p.id AS parent_id, CASE WHEN f.id % 4 <> 0 THEN f.id % 7 - 2 END AS place FROM folders f JOIN folders p ON p.id = f.id - 3 WHERE f.id % 6 = 1),
    m AS (SELECT * FROM w WHERE NOT EXISTS (FROM up WHERE up.id = w.parent_id AND up.above = w.id)),
    s AS (SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, name, id) - 1 AS p FROM folders WHERE id NOT IN (SELECT id FROM m)),
    z AS (SELECT parent_id, count(*) AS n FROM s GROUP BY parent_id),
    l AS (SELECT id, parent_id, CAST(p AS DOUBLE) AS q FROM s UNION ALL SELECT m.id, m.parent_id, greatest(least(coalesce(place, n, 0), coalesce(n, 0)), 0) - 0.5 FROM m LEFT JOIN z ON z.parent_id = m.parent_id),
    n AS (SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY q, id) - 1 AS n FROM l),
    x AS (SELECT coalesce(parent_id, -1) AS p FROM m UNION SELECT coalesce(t.parent_id, -1) FROM folders t JOIN m ON m.id = t.id)
    SELECT t.id, n.parent_id, CASE WHEN coalesce(n.parent_id, -1) IN (FROM x) THEN n.n ELSE t.sort_order END AS sort_order FROM folders t JOIN n ON n.id = t.id""",
    "folders",
)
def folders_put_at_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders moved to a place among another parent's children, held to the places there are."""
    folders = view(spark, sf_dir, "folders")
    place = F.when(F.col("id") % 4 != 0, F.col("id") % 7 - 2)
    wanted = folders.filter("id % 6 = 1").select("id", (F.col("id") - 3).alias("parent_id"), place.alias("place"), F.col("id").alias("pos"))
    wanted = wanted.join(folders.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return moves.at_places(folders, wanted).select("id", "parent_id", "sort_order")


@query(
    """SELECT folder_id, path, lower(ext) AS ext, CAST(coalesce(rating, 0) AS DOUBLE) AS rating, coalesce(source_url, '') AS source_url, coalesce(t.tags, '') AS tags
    FROM files f LEFT JOIN (SELECT file_id, string_agg(tag_id, ',' ORDER BY ord, tag_id) AS tags FROM file_tags GROUP BY file_id) t ON t.file_id = f.id WHERE id % 11 <> 0 AND trim(ext) <> ''""",
    "files", "file_tags",
)
def pasted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each folder copied to a clipboard payload and read from it; those without an extension are no items."""
    ext = F.when(F.col("id") % 11 == 0, " . ").otherwise(F.concat(F.lit(" ."), F.upper("ext")))
    sent = records.clipboard_payloads(files_of(spark, sf_dir).withColumn("ext", ext), view(spark, sf_dir, "file_tags"), "folder_id")
    got = sent.select("folder_id", F.explode(records.clipboard_items(F.col("payload"))).alias("i"))
    return got.select("folder_id", F.col("i.source_path").alias("path"), "i.ext", "i.rating", "i.source_url", F.array_join("i.tag_ids", ",").alias("tags"))


@query(
    """SELECT page_id, CASE page_id % 7 WHEN 0 THEN regexp_extract(url, '^(https?):', 1) || '://www.xiaohongshu.com/explore/' || page_id || '?from=a#top' WHEN 2 THEN 'https://xiaohongshu.com/search_result'
    WHEN 4 THEN 'https://m.xiaohongshu.com/discovery/item/' || page_id END AS note FROM pages""",
)
def note_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that lead to notes of the known site."""
    href = F.expr(
        """CASE page_id % 7 WHEN 0 THEN concat('//WWW.xiaohongshu.com/explore/', page_id, '?from=a#top') WHEN 1 THEN concat('/explore/', page_id) WHEN 2 THEN ' https://xiaohongshu.com/search_result '
        WHEN 3 THEN url WHEN 4 THEN concat('https://m.xiaohongshu.com/discovery/x/../item/', page_id) WHEN 5 THEN 'https://xiaohongshu.com/explored/1' ELSE '  ' END"""
    )
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.note_url(F.col("url"), href).alias("note"))
