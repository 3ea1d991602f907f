"""Batch tasks: progress, retries, undo, and applying suggested metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions.scalars import clean_rating, clean_tags, json_object, name_stem, response_text, sanitize_stem, tag_color
from galena.operators.ranking import numbered

ANSWER = "filename string, description string, rating string, tags array<string>"


def progress(items: DataFrame) -> DataFrame:
    """Per task: total, processed, succeeded, failed and status.

    ``items`` has task_id, index, status (completed, failed or null while it
    waits) and cancelled.
    """
    counts = items.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isNotNull()).alias("processed"),
        F.count_if(F.col("status") == "completed").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.bool_or("cancelled").alias("_cancelled"),
    )
    done = F.col("processed") == F.col("total")
    status = F.when(done & (F.col("failed") > 0), "completed_with_errors").when(done, "completed").when(F.col("_cancelled"), "cancelled").otherwise("running")
    return counts.withColumn("status", status).drop("_cancelled")


def retries(items: DataFrame) -> DataFrame:
    """Failed items in their order, to be run again."""
    return items.filter(F.col("status") == "failed").select("task_id", "index", "source").orderBy("task_id", "index")


def undo_window(deletes: DataFrame, most: int = 50) -> DataFrame:
    """The last ``most`` deletes of each session, latest first: what undo can bring back."""
    order = Window.partitionBy("session").orderBy(F.col("ts").desc(), F.col("id").desc())
    return deletes.withColumn("step", F.row_number().over(order)).filter(F.col("step") <= most)


def fill_gaps(files: DataFrame, found: DataFrame) -> DataFrame:
    """Hash, palette and thumb hash of ``found`` (id, ...) where a file has none."""
    names = ("content_hash", "color_distribution", "thumb_hash")
    new = found.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in names))
    joined = files.join(new, files["id"] == new["_id"], "left")

    def gap(c: str) -> Column:
        return F.coalesce(F.nullif(F.nullif(F.col(c), F.lit("")), F.lit("[]")), F.col(f"_{c}"), F.col(c))

    return joined.withColumns({c: gap(c) for c in names}).drop("_id", *(f"_{c}" for c in names))


def suggestions(files: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, name, description, rating, tags) that chat responses (id, response) suggest for files.

    Only usable parts count: otherwise the file keeps its own. tags is empty
    where nothing is suggested; the file's tags then stay as they are.
    """
    answer = F.from_json(json_object(response_text(F.col("response"))), ANSWER)
    own = files.select("id", "name", "description", "rating")
    j = own.join(responses.select("id", answer.alias("a")), "id")
    ext = F.regexp_extract("name", r".(\.[^.]*)$", 1)
    stem = sanitize_stem(F.coalesce("a.filename", F.lit("")), name_stem(F.col("name")))
    text = F.substring(F.trim(F.coalesce("a.description", F.lit(""))), 1, 200)
    return j.select("id", F.concat(stem, ext).alias("name"), F.coalesce(F.nullif(text, F.lit("")), F.col("description")).alias("description"), F.coalesce(clean_rating(F.col("a.rating"), F.col("rating")), F.col("rating")).alias("rating"), clean_tags(F.col("a.tags")).alias("tags"))


def apply_tags(tags: DataFrame, file_tags: DataFrame, suggested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and links after the suggested tags (id, tags) replace those of their files.

    A tag of the same trimmed, lower-cased name is used again; else a new root
    tag with a color of its name is made. New ids follow the largest.
    """
    each = suggested.filter(F.size("tags") > 0).select(F.col("id").alias("file_id"), F.posexplode("tags").alias("ord", "name")).withColumn("_key", F.lower("name"))
    known = tags.groupBy(F.lower(F.trim("name")).alias("_key")).agg(F.max("id").alias("tag_id"))
    fresh = each.join(known, "_key", "left_anti").groupBy("_key").agg(F.min_by("name", F.struct("file_id", "ord")).alias("name"))
    top = tags.agg(F.max("id")).first()[0] or 0
    made = numbered(fresh, [F.col("_key").asc()], "_n").select((F.col("_n") + F.lit(top)).alias("id"), "name", "_key")
    added = made.select("id", "name", tag_color(F.col("name")).alias("color"))
    all_keys = known.unionByName(made.select("_key", F.col("id").alias("tag_id")))
    links = each.join(all_keys, "_key").select("file_id", "tag_id", F.col("ord").cast("long").alias("ord"))
    rest = file_tags.join(links.select("file_id").distinct(), "file_id", "left_anti")
    return tags.unionByName(added, allowMissingColumns=True), rest.select("file_id", "tag_id", "ord").unionByName(links)
