"""Scans, joins and aggregations over library tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions.scalars import has_prefix
from galena.plans.filters import is_active


def multi_get(files: DataFrame, ids: list[int]) -> DataFrame:
    """Files by id in the order of ``ids``, with ``pos``; unknown ids are left out."""
    wanted = files.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(ids))), "pos int, id long")
    return files.join(wanted, "id").orderBy("pos")


def under_path(rows: DataFrame, directory: str, column: str = "normalized_path") -> DataFrame:
    """Rows whose path is ``directory`` or lies below it."""
    return rows.filter(has_prefix(F.col(column), F.lit(directory)))


def tags_of_files(file_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """file_id and tags: array of struct (ord, id, name, color, parent_id, sort_order) in order of tagging."""
    named = file_tags.join(tags, file_tags["tag_id"] == tags["id"])
    tag = F.struct("ord", "id", "name", "color", "parent_id", "sort_order")
    return named.groupBy("file_id").agg(F.sort_array(F.collect_list(tag)).alias("tags"))


def attach_tags(files: DataFrame, file_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """``files`` with ``tags``; an empty array where there are none."""
    wanted = file_tags.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    nested = tags_of_files(wanted, tags)
    empty = F.array().cast(nested.schema["tags"].dataType)
    return files.join(nested, files["id"] == nested["file_id"], "left").drop("file_id").withColumn("tags", F.coalesce("tags", empty))


def tag_usage(tags: DataFrame, file_tags: DataFrame, files: DataFrame) -> DataFrame:
    """Tags with the number of active files that bear them, unused tags too."""
    used = file_tags.join(files.filter(is_active()).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    count = used.groupBy("tag_id").agg(F.count(F.lit(1)).alias("count"))
    joined = tags.join(count, tags["id"] == count["tag_id"], "left")
    return joined.select("id", "name", "color", "parent_id", "sort_order", F.coalesce("count", F.lit(0)).alias("count"))


def tag_order() -> list[Column]:
    return [F.coalesce("parent_id", "id").asc(), F.col("sort_order").asc(), F.col("name").asc()]


def folder_counts(files: DataFrame) -> DataFrame:
    """Active files directly in each folder."""
    return files.filter(is_active() & F.col("folder_id").isNotNull()).groupBy("folder_id").agg(F.count(F.lit(1)).alias("file_count"))


def smart_stats(files: DataFrame, file_tags: DataFrame) -> DataFrame:
    """One row: all, unclassified and untagged active files."""
    tagged = file_tags.select(F.col("file_id").alias("id"), F.lit(1).alias("tagged")).distinct()
    live = files.filter(is_active()).select("id", "folder_id").join(tagged, "id", "left")
    return live.agg(
        F.count(F.lit(1)).alias("all_count"),
        F.count_if(F.col("folder_id").isNull()).alias("unclassified_count"),
        F.count_if(F.col("tagged").isNull()).alias("untagged_count"),
    )


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(content_hash, size of group, latest import, first id) of active files that share a hash, best first."""
    hashed = files.filter(is_active() & (F.coalesce("content_hash", F.lit("")) != ""))
    groups = hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("group_size"), F.max("imported_at").alias("latest"), F.max_by("id", F.struct("imported_at", -F.col("id"))).alias("first_id"))
    return groups.filter("group_size > 1")


def score_summary(scores: DataFrame, column: str = "score") -> DataFrame:
    """count, top, p90, p50 and min of a page's scores; percentiles by nearest rank.

    Exact: a page has at most as many scores as a page has rows.
    """
    page = scores.agg(F.sort_array(F.collect_list(column)).alias("s"))

    def rank(p: float) -> Column:
        return F.element_at("s", F.greatest(F.ceil(F.size("s") * F.lit(p)), F.lit(1)).cast("int"))

    return page.filter(F.size("s") > 0).select(F.size("s").cast("long").alias("n"), F.element_at("s", -1).alias("top"), rank(0.9).alias("p90"), rank(0.5).alias("p50"), F.element_at("s", 1).alias("least"))


def move_candidates(files: DataFrame) -> DataFrame:
    """Per content hash of ``files`` (catalog rows with ``present``: its path is still there) the row a moved file may come from.

    Of the eight best rows (active first, latest import, smallest id) a missing
    one is preferred, else the first active one that is not present.
    """
    own = files.filter(F.col("deleted_at").isNull())
    order = Window.partitionBy("content_hash").orderBy(F.col("missing_at").isNotNull(), F.col("imported_at").desc(), "id")
    best = own.withColumn("_rank", F.row_number().over(order)).filter("_rank <= 8")
    gone = F.col("missing_at").isNotNull() | ~F.col("present")
    return best.filter(gone).groupBy("content_hash").agg(F.min_by(F.struct("id", "path"), F.struct(F.col("missing_at").isNull(), F.col("_rank"))).alias("from")).select("content_hash", "from.id", "from.path")
