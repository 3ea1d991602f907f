"""The library's searches: one entry for names, smart views and filters, and search by vector within filters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions.scalars import json_object
from galena.operators import fuzzy, vectors
from galena.operators.library import attach_tags
from galena.operators.ranking import numbered
from galena.plans.filters import FilterSpec, Page, filtered, order_of, page_args, page_of


def scoped(files: DataFrame, file_tags: DataFrame, embeddings: DataFrame | None, spec: FilterSpec, sort_by: str | None = None, direction: str | None = None) -> tuple[DataFrame, list[Column]]:
    """Files that ``spec`` admits and the order they are shown in.

    The view of exact and similar files is its rank list, held to all other
    filters; other views and orders are those of :mod:`galena.plans.filters`.
    """
    if spec.smart_view == "similar":
        if embeddings is None:
            raise ValueError("the view of similar files needs embeddings")
        ranks = vectors.duplicate_or_similar(files, embeddings).select("id", F.col("rank").alias("_rank"))
        return filtered(files, file_tags, replace(spec, smart_view=None)).join(ranks, "id"), [F.col("_rank").asc()]
    return filtered(files, file_tags, spec), order_of(sort_by, direction, spec)


def _page(found: DataFrame, order: list[Column], file_tags: DataFrame, tags: DataFrame, page: int | None, page_size: int | None) -> Page:
    """A page with nested tags and ``rank`` (from 1 on each page), and the total of ``found``."""
    at, size, offset = page_args(page, page_size)
    shown = numbered(page_of(found, order, page, page_size), order).withColumn("rank", F.col("rank") + F.lit(offset))
    return Page(attach_tags(shown, file_tags, tags), found.count(), at, size)


def search_files(
    files: DataFrame, file_tags: DataFrame, tags: DataFrame, spec: FilterSpec, sort_by: str | None = None, direction: str | None = None,
    page: int | None = None, page_size: int | None = None, embeddings: DataFrame | None = None, sounds: dict[str, list[str]] | None = None,
) -> Page:
    """A page of files: with a query, those whose name stem matches, best first; else all that the filters admit.

    A query is matched within the other filters; files that match alike keep
    the order they had without it.
    """
    query = (spec.query or "").strip()
    if not query:
        found, order = scoped(files, file_tags, embeddings, spec, sort_by, direction)
        return _page(found, order, file_tags, tags, page, page_size)
    inside, order = scoped(files, file_tags, embeddings, replace(spec, query=None), sort_by, direction)
    return _page(fuzzy.fuzzy_files(inside, query, sounds), fuzzy.fuzzy_order(*order), file_tags, tags, page, page_size)


def search_by_vector(
    files: DataFrame, file_tags: DataFrame, tags: DataFrame, embeddings: DataFrame, spec: FilterSpec, model_id: str, vector: list[float],
    exclude: int | None = None, page: int | None = None, page_size: int | None = None,
) -> Page:
    """A page of files within the filters by their exact score; the total is that of all scored."""
    inside, _ = scoped(files, file_tags, embeddings, spec)
    return _page(vectors.search(inside, embeddings, model_id, vector, exclude), vectors.search_order(), file_tags, tags, page, page_size)


def search_by_text(
    files: DataFrame, file_tags: DataFrame, tags: DataFrame, embeddings: DataFrame, spec: FilterSpec, text: str, model: tuple[str, object] | None, configured: bool,
    page: int | None = None, page_size: int | None = None,
) -> Page:
    """Search by what images show: ``model`` is (model_id, encoder from text to vector).

    Without a configured model the text is searched in names; a configured one
    that does not load is an error.
    """
    if not configured:
        return search_files(files, file_tags, tags, replace(spec, query=text), page=page, page_size=page_size, embeddings=embeddings)
    if model is None:
        raise ValueError("the configured model is not valid")
    model_id, encode = model
    return search_by_vector(files, file_tags, tags, embeddings, spec, model_id, list(encode(text)), page=page, page_size=page_size)


def selection_kept(selected: DataFrame, visible: DataFrame) -> DataFrame:
    """Selected rows (id, pos) that are still visible, in their order."""
    return selected.join(visible.select("id").distinct(), "id", "left_semi").orderBy("pos")


#: Names of orders that were saved before fields and directions were.
OLD_ORDERS = {
    "imported_desc": ("imported_at", "desc"), "imported_asc": ("imported_at", "asc"), "modified_desc": ("modified_at", "desc"), "created_desc": ("created_at", "desc"),
    "name_asc": ("name", "asc"), "name_desc": ("name", "desc"), "size_desc": ("size", "desc"), "size_asc": ("size", "asc"),
}
SORTABLE = ("imported_at", "created_at", "modified_at", "name", "ext", "size")


def saved_order(preferences: Column) -> Column:
    """Struct sort_by, direction of saved preferences (JSON); old names of orders are understood, others give the default."""
    p = F.from_json(json_object(preferences), "sortBy string, sortDirection string")
    pairs = [F.struct(F.lit(by).alias("sort_by"), F.lit(way).alias("direction")) for by, way in OLD_ORDERS.values()]
    old = F.coalesce(*(F.when(p["sortBy"] == name, pair) for name, pair in zip(OLD_ORDERS, pairs, strict=True)))
    new = F.when(p["sortBy"].isin(*SORTABLE), F.struct(p["sortBy"].alias("sort_by"), F.when(p["sortDirection"].isin("asc", "desc"), p["sortDirection"]).otherwise("desc").alias("direction")))
    return F.coalesce(old, new, pairs[0])


def prewarm(ranked: DataFrame, viewports: DataFrame, bucket: int = 64) -> DataFrame:
    """(view, id, place): rows that each viewport shows, and as many ahead of it, 12 to 36, as it shows.

    ``ranked`` has id and rank from 1; ``viewports`` has view, first and last
    (ranks it shows, from 1; last before first: none) and forward. Ahead is
    past the last row, or before the first; what is shown comes first in
    place. Bands meet rows by buckets of ranks, so a viewport's cost is that of
    its rows.
    """
    total = ranked.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("n"))
    v = viewports.crossJoin(F.broadcast(total))  # one row
    shows = F.col("last") >= F.col("first")
    low, high = F.when(shows, F.col("first")).otherwise(F.lit(1)), F.when(shows, F.col("last")).otherwise(F.lit(0))
    n = F.greatest(F.least(high, F.col("n")) - low + 1, F.lit(0))
    ahead = F.greatest(F.lit(12), F.least(F.lit(36), n))
    band = lambda a, b, part: F.struct(F.greatest(a, F.lit(1)).cast("long").alias("a"), F.least(b, F.col("n")).cast("long").alias("b"), F.lit(part).alias("part"))
    bands = F.array(band(low, high, 0), F.when(F.col("forward"), band(high + 1, high + ahead, 1)).otherwise(band(low - ahead, low - 1, 1)))
    each = v.select("view", F.explode(bands).alias("s")).select("view", "s.*").filter("a <= b")
    each = each.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))))
    rows = ranked.select("id", "rank", F.floor(F.col("rank") / bucket).alias("_bucket"))
    met = each.join(rows, "_bucket").filter("rank BETWEEN a AND b")
    place = F.row_number().over(Window.partitionBy("view").orderBy("part", "rank"))
    return met.select("view", "id", place.alias("place"))
