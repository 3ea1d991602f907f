"""More queries over library views, and their oracle SQL: searches, changes, settings, tasks, scalar functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import formats, media, scalars, urls
from galena.operators import fuzzy, library, mutations, search, sync, tasks, trees, vectors
from galena.operators.ranking import numbered
from galena.plans import filters
from galena.plans.filters import FilterSpec
from galena.queries import COUNTS, CURRENT, REACH, _query_vector, files_of, query
from galena.sources import scan
from galena.sources.library import view
from galena.streaming import events

# ---------------------------------------------------------------- searches


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return files_of(spark, sf_dir), view(spark, sf_dir, "file_tags"), view(spark, sf_dir, "tags")


def _shown(page: filters.Page, *more: str) -> DataFrame:
    names = F.array_join(F.transform("tags", lambda t: t["name"]), ",")
    return page.rows.select("id", "name", names.alias("tags"), "rank", F.lit(page.total).cast("long").alias("total"), F.lit(page.total_pages).cast("long").alias("pages"), *more)


NESTED = "SELECT p.id, p.name, coalesce(string_agg(t.name, ',' ORDER BY ft.ord), '') AS tags, p.rank, p.total, p.pages{more} FROM p LEFT JOIN file_tags ft ON ft.file_id = p.id LEFT JOIN tags t ON t.id = ft.tag_id GROUP BY p.id, p.name, p.rank, p.total, p.pages{more}"


@query(
    r"""
    WITH c AS (SELECT id, name, row_number() OVER (ORDER BY size DESC, $TAIL) AS place, lower(regexp_replace(name, '(.)\.[^.]*$', '\1')) AS n FROM files WHERE $ACTIVE AND lower(ext) IN ('jpg', 'png', 'webp', 'svg')),
    m AS (SELECT *, CASE WHEN n = 's1' THEN 6 WHEN starts_with(n, 's1') THEN 5 WHEN contains(n, ' s1') THEN 4 WHEN contains(n, 's1') THEN 3
                 WHEN contains(array_to_string(list_transform(list_filter(regexp_split_to_array(n, '[ -]'), lambda w: w <> ''), lambda w: w[1]), ''), 's1') THEN 2
                 WHEN regexp_matches(n, '(?s)s.*?1') THEN 1 END AS tier FROM c),
    h AS (SELECT *, CASE WHEN tier = 1 THEN length(regexp_extract(n, '(?s)s.*?1')) END AS spread FROM m WHERE tier IS NOT NULL),
    p AS (SELECT id, name, row_number() OVER (ORDER BY tier DESC, spread NULLS FIRST, n, place) AS rank, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 25) AS BIGINT) AS pages FROM h QUALIFY rank BETWEEN 26 AND 50)
    """ + NESTED.format(more=""),
    "files", "file_tags", "tags",
)
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query within type filters: second page, tags nested, totals."""
    return _shown(search.search_files(*_parts(spark, sf_dir), FilterSpec(query=" S1 ", file_types=("image",)), "size", "desc", 2, 25))


@query(
    "WITH h AS (SELECT id, name, size, imported_at FROM files WHERE $ACTIVE AND rating >= 2),\n"
    "p AS (SELECT id, name, row_number() OVER (ORDER BY size ASC, $TAIL) AS rank, (SELECT count(*) FROM h) AS total, CAST(ceil((SELECT count(*) FROM h) / 30) AS BIGINT) AS pages FROM h QUALIFY rank BETWEEN 31 AND 60)\n" + NESTED.format(more=""),
    "files", "file_tags", "tags",
)
def search_without_a_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank query lists what the filters admit."""
    return _shown(search.search_files(*_parts(spark, sf_dir), FilterSpec(query="  ", min_rating=2), "size", "asc", 2, 30))


@query(
    CURRENT.replace("WITH", "WITH RECURSIVE", 1) + REACH.replace("0.35", "0.94") + """,
    x AS (SELECT id, imported_at, max(imported_at) OVER w AS latest, first_value(id) OVER (w ORDER BY $TAIL) AS lead
          FROM files WHERE $ACTIVE AND coalesce(content_hash, '') <> '' WINDOW w AS (PARTITION BY content_hash) QUALIFY count(*) OVER w > 1),
    m AS (SELECT g.id, g.component, f.imported_at FROM g JOIN files f ON f.id = g.id),
    s AS (SELECT DISTINCT component, latest, lead FROM x JOIN m ON m.id = x.id),
    i AS (SELECT component, max(imported_at) AS latest, first(id ORDER BY $TAIL) AS lead, (SELECT max(score) FROM e JOIN g ON g.id = e.a WHERE g.component = m.component) AS best FROM m GROUP BY component),
    q AS (SELECT id, 0 AS tier, CAST(0 AS DOUBLE) AS best, latest, lead, 0 AS part, imported_at FROM x
          UNION ALL SELECT m.id, 0, 0, s.latest, s.lead, 1, m.imported_at FROM m JOIN s ON s.component = m.component
          UNION ALL SELECT m.id, 1, i.best, i.latest, i.lead, 0, m.imported_at FROM m JOIN i ON i.component = m.component WHERE m.component NOT IN (SELECT component FROM s)),
    o AS (SELECT id, row_number() OVER (ORDER BY tier, best DESC, latest DESC, lead, part, imported_at DESC, id) AS n FROM q),
    r2 AS (SELECT id, min(n) AS n FROM o GROUP BY id),
    h AS (SELECT f.id, f.name, r2.n FROM r2 JOIN files f ON f.id = r2.id WHERE $ACTIVE AND size >= 300),
    p AS (SELECT id, name, row_number() OVER (ORDER BY n) AS rank, (SELECT count(*) FROM h) AS total, CAST(ceil((SELECT count(*) FROM h) / 10) AS BIGINT) AS pages FROM h QUALIFY rank <= 10)
    """ + NESTED.format(more=""),
    "files", "file_visual_embeddings", "file_tags", "tags",
)
def search_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of exact and similar files held to a size filter."""
    e = view(spark, sf_dir, "file_visual_embeddings")
    return _shown(search.search_files(*_parts(spark, sf_dir), FilterSpec(smart_view="similar", size_min=300), page=1, page_size=10, embeddings=e))


@query(
    CURRENT + """,
    h AS (SELECT c.id, f.name, c.imported_at, list_dot_product(v, (SELECT arg_min(embedding, vec_id)::DOUBLE[] FROM embeddings)) AS score
          FROM c JOIN files f ON f.id = c.id WHERE c.model_id = 'clip-a' AND f.rating >= 1 AND f.id <> 2),
    p AS (SELECT id, name, round(score, 6) AS score, row_number() OVER (ORDER BY h.score DESC, $TAIL) AS rank, (SELECT count(*) FROM h) AS total, CAST(ceil((SELECT count(*) FROM h) / 20) AS BIGINT) AS pages FROM h QUALIFY rank BETWEEN 21 AND 40)
    """ + NESTED.format(more=", p.score"),
    "files", "file_visual_embeddings", "file_tags", "tags",
)
def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By vector within a rating filter, without the queried file: second page and total."""
    e = view(spark, sf_dir, "file_visual_embeddings")
    page = search.search_by_vector(*_parts(spark, sf_dir), e, FilterSpec(min_rating=1), "clip-a", _query_vector(spark, sf_dir), exclude=2, page=2, page_size=20)
    return _shown(page, F.round("score", 6).alias("score"))


@query("SELECT id FROM files WHERE id IN (SELECT unnest(range(3, 400, 7))) AND id IN (SELECT id FROM files WHERE $ACTIVE AND rating >= 1)", "files")
def selection_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = library.multi_get(files_of(spark, sf_dir), list(range(3, 400, 7))).select("id", "pos")
    return search.selection_kept(chosen, files_of(spark, sf_dir).filter(filters.predicate(FilterSpec(min_rating=1)))).select("id")


@query(CURRENT + " SELECT id, model_id, round(list_sum(v), 6) AS total FROM c WHERE id IN (1, 3, 8, 9) AND model_id = 'clip-a'", "files", "file_visual_embeddings")
def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of files that are ready and current."""
    own = vectors.candidates(files_of(spark, sf_dir).filter(F.col("id").isin(1, 3, 8, 9)), view(spark, sf_dir, "file_visual_embeddings").filter("model_id = 'clip-a'"))
    return own.select("id", "model_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


# ---------------------------------------------------------------- scans, counts, records


@query("SELECT id, deleted_at IS NOT NULL AS gone FROM folders WHERE path = '/library/ASIA' OR id = 13 OR id = 26", "folders")
def folder_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By path and by id, deleted ones too."""
    f = view(spark, sf_dir, "folders")
    return f.filter((F.col("normalized_path") == scalars.normalize_path(F.lit("/library//ASIA/"))) | F.col("id").isin(13, 26)).select("id", F.col("deleted_at").isNotNull().alias("gone"))


@query("SELECT id, name FROM files WHERE normalized_path = '/library/src1/src1 en 3.pdf' OR normalized_path IN (SELECT min(normalized_path) FROM files)", "files")
def file_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_of(spark, sf_dir)
    least = f.agg(F.min("normalized_path")).first()[0]
    wanted = scalars.normalize_path(F.lit(least.replace("/library/", "\\library\\.\\x\\..\\")))
    return f.filter((F.col("normalized_path") == wanted) | (F.col("normalized_path") == "/library/src1/src1 en 3.pdf")).select("id", "name")


@query("SELECT (SELECT count(*) FROM files WHERE deleted_at IS NOT NULL) + (SELECT count(*) FROM folder_trash_entries) AS n", "files", "folder_trash_entries")
def trash_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.trash_count(files_of(spark, sf_dir), view(spark, sf_dir, "folder_trash_entries"))


@query("SELECT (SELECT greatest(count(*) - 1, 0) FROM folders WHERE path = '/library/EUROPE' OR starts_with(path, '/library/EUROPE/')) AS subfolder_count, (SELECT count(*) FROM files WHERE starts_with(normalized_path, '/library/EUROPE/')) AS file_count", "folders", "files")
def trash_entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.trash_entry_counts(view(spark, sf_dir, "folders"), files_of(spark, sf_dir), "/library/EUROPE")


@query("SELECT CASE WHEN coalesce(sum(size), 0) = 0 THEN 7 ELSE sum(size) END AS total FROM files WHERE folder_id = 3 AND deleted_at IS NULL", "files")
def total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.total_size(files_of(spark, sf_dir).filter("folder_id = 3 and deleted_at is null"), 7).select(F.col("total").cast("long").alias("total"))


@query("SELECT id, row_number() OVER (ORDER BY $TAIL) AS rank FROM files WHERE $ACTIVE AND lower(ext) IN ('jpg', 'png', 'webp')", "files")
def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vectors.index_state(files_of(spark, sf_dir), view(spark, sf_dir, "file_visual_embeddings").limit(0), "clip-a").filter("pending")
    return numbered(s, [F.col("imported_at").desc(), F.col("id").asc()]).select("id", "rank")


# ---------------------------------------------------------------- changes


@query(
    """SELECT id, CASE WHEN id % 5 = 0 THEN size + 3 ELSE size END AS size, CASE WHEN id % 5 = 0 THEN NULL ELSE content_hash END AS content_hash, CASE WHEN id % 5 = 0 THEN 't' ELSE description END AS description,
    CASE WHEN id % 5 <> 0 THEN deleted_at END AS deleted_at, CASE WHEN id % 5 <> 0 THEN missing_at END AS missing_at FROM files""",
    "files",
)
def overwrite_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_of(spark, sf_dir)
    new = f.filter("id % 5 = 0").select("normalized_path", (F.col("size") + 3).alias("size"), F.lit(None).cast("string").alias("content_hash"), F.lit("t").alias("description"))
    new = new.unionByName(new.withColumn("normalized_path", F.lit("/nowhere")))
    return mutations.overwrite_basics(f, new).select("id", "size", "content_hash", "description", "deleted_at", "missing_at")


@query("SELECT id, CASE WHEN id = 12 THEN 'renamed' ELSE name END AS name, CASE WHEN id = 12 THEN '2027' ELSE last_accessed_at END AS last_accessed_at, CASE WHEN id = 12 THEN NULL ELSE folder_id END AS folder_id FROM files", "files")
def update_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mutations.update_where(files_of(spark, sf_dir), F.col("id") == 12, name=F.lit("renamed"), last_accessed_at=F.lit("2027"), folder_id=F.lit(None))
    return out.select("id", "name", "last_accessed_at", "folder_id")


@query("SELECT id, CASE WHEN id % 17 = 0 AND id % 2 = 0 THEN NULL ELSE deleted_at END AS deleted_at, CASE WHEN id % 17 = 0 AND id % 2 = 0 THEN NULL ELSE missing_at END AS missing_at FROM files", "files")
def restore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.restore(files_of(spark, sf_dir), (F.col("id") % 17 == 0) & (F.col("id") % 2 == 0), "2027").select("id", "deleted_at", "missing_at")


@query("SELECT 'file' AS kind, id FROM files WHERE id % 9 <> 0 UNION ALL SELECT 'tag', file_id FROM file_tags WHERE file_id % 9 <> 0 UNION ALL SELECT 'vector', file_id FROM file_visual_embeddings WHERE file_id % 9 <> 0", "files", "file_tags", "file_visual_embeddings")
def delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files for good, with their tags and vectors."""
    f = files_of(spark, sf_dir)
    left, links, vecs = mutations.delete_files(f, f.filter("id % 9 = 0"), view(spark, sf_dir, "file_tags"), view(spark, sf_dir, "file_visual_embeddings"))
    return left.select(F.lit("file").alias("kind"), "id").unionByName(links.select(F.lit("tag").alias("kind"), F.col("file_id").alias("id"))).unionByName(vecs.select(F.lit("vector").alias("kind"), F.col("file_id").alias("id")))


@query("SELECT id, CASE WHEN path = '/library/ASIA' OR starts_with(path, '/library/ASIA/') THEN '2027' ELSE deleted_at END AS deleted_at FROM folders", "folders")
def delete_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.delete_subtree(view(spark, sf_dir, "folders"), "/library/ASIA", "2027").select("id", "deleted_at")


_IN_ASIA = "(path = '/library/ASIA' OR starts_with(path, '/library/ASIA/'))"


@query(
    f"""SELECT id, CASE WHEN {_IN_ASIA} THEN '/library/back' || substr(path, 14) ELSE path END AS path, CASE WHEN NOT {_IN_ASIA} THEN deleted_at END AS deleted_at,
    CASE WHEN id = 1002 THEN 1003 ELSE parent_id END AS parent_id FROM folders""",
    "folders",
)
def restore_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.restore_subtree(view(spark, sf_dir, "folders"), "/library/ASIA", "/library/back", 1002, 1003).select("id", "path", "deleted_at", "parent_id")


@query(f"SELECT 'folder' AS kind, id, CASE WHEN {_IN_ASIA} THEN '2027' ELSE deleted_at END AS at FROM folders UNION ALL SELECT 'file', id, missing_at FROM files", "folders", "files")
def delete_folder_to_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders, files = mutations.delete_folder(view(spark, sf_dir, "folders"), files_of(spark, sf_dir), "/library/ASIA", "2027", to_trash=True, on_disk=True)
    return folders.select(F.lit("folder").alias("kind"), "id", F.col("deleted_at").alias("at")).unionByName(files.select(F.lit("file").alias("kind"), "id", F.col("missing_at").alias("at")))


@query("SELECT 'folder' AS kind, id FROM folders WHERE NOT starts_with(path || '/', '/library/EUROPE/') UNION ALL SELECT 'file', id FROM files WHERE NOT starts_with(normalized_path, '/library/EUROPE/')", "folders", "files")
def delete_folder_for_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory is not there, so trash mode does not matter."""
    folders, files = mutations.delete_folder(view(spark, sf_dir, "folders"), files_of(spark, sf_dir), "/library/EUROPE", "2027", to_trash=True, on_disk=False)
    return folders.select(F.lit("folder").alias("kind"), "id").unionByName(files.select(F.lit("file").alias("kind"), "id"))


@query(
    """
    WITH w AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'ASIA' ELSE 'AFRICA' END AS name FROM folders WHERE id BETWEEN 2001 AND 2006),
    k AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM w)
    SELECT id, '/library' AS parent_path, name || ' (已恢复' || CASE WHEN n = 1 THEN '' ELSE ' ' || (n + 1) END || ')' AS name FROM k""",
    "folders",
)
def restore_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trashed folders go back under names that are free."""
    f = view(spark, sf_dir, "folders").withColumn("deleted_at", F.lit(None).cast("string"))
    wanted = f.filter("id between 2001 and 2006").select("id", F.lit("/gone").alias("parent_path"), F.when(F.col("id") % 2 == 0, "ASIA").otherwise("AFRICA").alias("name"))
    return mutations.restore_paths(wanted, f, "/library")


@query(
    """
    WITH w AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS name FROM files WHERE id BETWEEN 1 AND 8),
    k AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM w)
    SELECT id, CASE WHEN name = 'a' THEN CASE n WHEN 1 THEN 'a' ELSE 'a (3)' END ELSE 'b (' || (n + 1) || ')' END AS name FROM k""",
    "files",
)
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two rows want and some have already."""
    wanted = files_of(spark, sf_dir).filter("id between 1 and 8").select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("name"))
    return mutations.free_names(wanted, spark.createDataFrame([("a (2)",), ("b",)], "name string"))


@query("SELECT file_id, tag_id FROM file_tags WHERE NOT (tag_id = 3 AND file_id % 2 = 1)", "file_tags")
def unlink_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, "file_tags")
    return mutations.unlink_tags(links, links.filter("tag_id = 3 and file_id % 2 = 1")).select("file_id", "tag_id")


@query("SELECT id, name, color, parent_id FROM tags UNION ALL SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY n), n, '#fff', 4 FROM (VALUES ('aa'), ('bb')) v(n)", "tags")
def create_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([("bb", "#fff", 4), ("aa", "#fff", 4)], "name string, color string, parent_id long")
    return mutations.create_rows(view(spark, sf_dir, "tags"), new, [F.col("name").asc()]).select("id", "name", "color", "parent_id")


@query("SELECT id, CASE WHEN id = 7 THEN 8 ELSE parent_id END AS parent_id, CASE id WHEN 9 THEN 0 WHEN 7 THEN 1 WHEN 10 THEN 2 ELSE sort_order END AS sort_order FROM tags", "tags")
def move_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = trees.move_plan([9, 10], 7, 1)["target"]
    return mutations.move_tag(view(spark, sf_dir, "tags"), 7, 8, order).select("id", "parent_id", "sort_order")


@query(
    """WITH RECURSIVE g AS (SELECT id FROM tags WHERE id IN (4, 20) UNION SELECT t.id FROM tags t JOIN g ON t.parent_id = g.id)
    SELECT 'tag' AS kind, id AS a, 0 AS b FROM tags WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'link', file_id, tag_id FROM file_tags WHERE tag_id NOT IN (SELECT id FROM g)""",
    "tags", "file_tags",
)
def delete_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with all below them, and their links."""
    tags, links = mutations.delete_tags(view(spark, sf_dir, "tags"), view(spark, sf_dir, "file_tags"), [4, 20])
    return tags.select(F.lit("tag").alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(links.select(F.lit("link").alias("kind"), F.col("file_id").alias("a"), F.col("tag_id").alias("b")))


@query(
    """SELECT file_id, model_id, CASE WHEN file_id % 10 = 3 THEN 0 ELSE dimensions END AS dimensions, CASE WHEN file_id % 10 = 3 THEN 'error' ELSE status END AS status FROM file_visual_embeddings""",
    "file_visual_embeddings",
)
def embedding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "file_visual_embeddings")
    return mutations.embedding_errors(e, e.filter("file_id % 10 = 3").select("file_id", "model_id", F.lit("bad").alias("last_error")), "2027").select("file_id", "model_id", "dimensions", "status")


@query("SELECT file_id, CASE WHEN file_id % 4 = 1 THEN 'clip-c' ELSE model_id END AS model_id, CASE WHEN file_id % 4 = 1 THEN 'ready' ELSE status END AS status FROM file_visual_embeddings", "file_visual_embeddings")
def upsert_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of two results for a file wins."""
    e = view(spark, sf_dir, "file_visual_embeddings")
    new = e.filter("file_id % 4 = 1").withColumns({"model_id": F.lit("clip-c"), "status": F.lit("ready"), "indexed_at": F.lit("2027-2")})
    old = new.withColumns({"model_id": F.lit("clip-b"), "indexed_at": F.lit("2027-1")})
    return mutations.merge_last(e, new.unionByName(old), ["file_id"], [F.col("indexed_at").desc()]).select("file_id", "model_id", "status")


@query("SELECT 'kept' AS part, count(*) AS n FROM file_visual_embeddings UNION ALL SELECT 'cleared', 0", "file_visual_embeddings")
def clear_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device changes nothing of what embeddings say; a model does."""
    e, keys = view(spark, sf_dir, "file_visual_embeddings"), ("modelPath", "fgclipMaxPatches")
    kept = mutations.clear_if_changed(e, {"modelPath": "/m", "device": "cpu"}, {"modelPath": "/m", "device": "gpu"}, keys)
    gone = mutations.clear_if_changed(e, {"modelPath": "/m"}, {"modelPath": "/n"}, keys)
    count = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return count(kept, "kept").unionByName(count(gone, "cleared"))


@query("SELECT 'n' || n_nationkey AS key, CASE WHEN n_nationkey = 3 THEN 'new' ELSE n_name END AS value FROM nation UNION ALL SELECT 'theme', 'dark'")
def upsert_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by key, the last value of each."""
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    new = spark.createDataFrame([("n3", "old", 1), ("n3", "new", 2), ("theme", "dark", 1)], "key string, value string, at int")
    return mutations.merge_last(own, new, ["key"], [F.col("at").desc()]).select("key", "value")


@query(
    """SELECT 'file' AS kind, id FROM files WHERE deleted_at IS NULL UNION ALL SELECT 'folder', id FROM folders WHERE deleted_at IS NULL UNION ALL SELECT 'link', file_id FROM file_tags WHERE file_id NOT IN (SELECT id FROM files WHERE deleted_at IS NOT NULL)""",
    "files", "folders", "file_tags",
)
def empty_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, folders, entries, links = mutations.empty_trash(files_of(spark, sf_dir), view(spark, sf_dir, "folders"), view(spark, sf_dir, "folder_trash_entries"), view(spark, sf_dir, "file_tags"))
    out = files.select(F.lit("file").alias("kind"), "id").unionByName(folders.select(F.lit("folder").alias("kind"), "id")).unionByName(links.select(F.lit("link").alias("kind"), F.col("file_id").alias("id")))
    return out.unionByName(entries.select(F.lit("entry").alias("kind"), F.col("folder_id").alias("id")))


@query(
    """SELECT id AS item, path, '/library/in' AS target_dir FROM files WHERE id % 50 = 1
    UNION ALL SELECT 0, path, '/library/in/library/' || regexp_extract(path, '^/library/([^/]*)/', 1) FROM files WHERE id % 50 = 2""",
    "files",
)
def expand_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and one directory, whose own folders come along."""
    f = files_of(spark, sf_dir)
    items = f.filter("id % 50 = 1").select(F.col("id").alias("item"), "path", F.lit(False).alias("is_directory")).unionByName(spark.createDataFrame([(0, "/library", True)], "item long, path string, is_directory boolean"))
    inside = f.filter("id % 50 = 2").select(F.lit(0).cast("long").alias("item"), "path", F.regexp_extract("path", "^/library/(.*)/[^/]*$", 1).alias("relative_dir"))
    return mutations.expand_imports(items, inside, "/library/in/")


# ---------------------------------------------------------------- trees and tasks


@query(
    """WITH RECURSIVE live AS (SELECT id, parent_id, CASE WHEN id % 7 = 1 THEN '.' || name ELSE name END AS name FROM folders WHERE deleted_at IS NULL),
    t AS (SELECT id, name FROM live WHERE parent_id IS NULL AND name NOT LIKE '.%' UNION ALL SELECT c.id, c.name FROM live c JOIN t ON c.parent_id = t.id WHERE c.name NOT LIKE '.%') SELECT id, name FROM t""",
    "folders",
)
def folders_without_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "folders").withColumn("name", F.when(F.col("id") % 7 == 1, F.concat(F.lit("."), F.col("name"))).otherwise(F.col("name")))
    return trees.without_hidden(trees.folder_tree(f)).select("id", "name")


@query(
    """WITH RECURSIVE live AS (SELECT id, parent_id FROM folders WHERE deleted_at IS NULL),
    t AS (SELECT id, 0 AS depth FROM live WHERE parent_id IS NULL UNION ALL SELECT c.id, t.depth + 1 FROM live c JOIN t ON c.parent_id = t.id WHERE t.id IN (1000, 1002, 8, 12))
    SELECT id, depth, EXISTS (SELECT 1 FROM live l WHERE l.parent_id = t.id) AS has_children, id IN (1000, 1002, 8, 12) AS is_expanded FROM t""",
    "folders",
)
def visible_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an expanded tree shows."""
    tree = trees.folder_tree(view(spark, sf_dir, "folders"))
    return trees.visible_items(tree, spark.createDataFrame([(1000,), (1002,), (8,), (12,)], "id long")).select("id", "depth", "has_children", "is_expanded")


@query("SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, name, id) AS place FROM folders WHERE deleted_at IS NULL", "folders")
def sibling_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("parent_id").orderBy(*trees.named_order()))
    return view(spark, sf_dir, "folders").filter("deleted_at is null").select("id", "parent_id", place.alias("place"))


@query("SELECT o_custkey % 97 AS task_id, o_orderkey AS index, 's' || o_orderkey AS source FROM orders WHERE o_orderkey % 41 = 0")
def task_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = o.select((F.col("o_custkey") % 97).alias("task_id"), F.col("o_orderkey").alias("index"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("source"), F.when(F.col("o_orderkey") % 41 == 0, "failed").otherwise("completed").alias("status"))
    return tasks.retries(items)


@query(
    """SELECT id, CASE WHEN coalesce(content_hash, '') = '' AND id % 2 = 0 THEN 'found' ELSE content_hash END AS content_hash, CASE WHEN id % 2 = 0 THEN 'thumb' ELSE '' END AS thumb_hash FROM files""",
    "files",
)
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_of(spark, sf_dir).withColumns({"color_distribution": F.lit("[]"), "thumb_hash": F.lit("")})
    found = f.filter("id % 2 = 0").select("id", F.lit("found").alias("content_hash"), F.lit('[{"color":"#000000"}]').alias("color_distribution"), F.lit("thumb").alias("thumb_hash"))
    out = tasks.fill_gaps(f, found)
    return out.select("id", "content_hash", "thumb_hash")



@query(
    """SELECT id, 'new name ' || id || '.' || ext AS name, CASE WHEN id % 2 = 0 THEN 'seen' ELSE description END AS description, CASE WHEN id % 6 BETWEEN 1 AND 5 THEN CAST(id % 6 AS INT) ELSE rating END AS rating, 'Sea,sky' AS tags FROM files WHERE id % 3 = 0""",
    "files",
)
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat responses applied where usable."""
    f = files_of(spark, sf_dir)
    answer = F.to_json(F.struct(F.concat(F.lit("new/name: "), F.col("id").cast("string")).alias("filename"), F.when(F.col("id") % 2 == 0, " seen ").otherwise("").alias("description"), (F.col("id") % 6).cast("string").alias("rating"), F.array(F.lit(" Sea"), F.lit("sea"), F.lit(""), F.lit("sky")).alias("tags")))
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("Here: "), answer, F.lit(" ok")).alias("content")).alias("message"))).alias("choices")))
    out = tasks.suggestions(f, f.filter("id % 3 = 0").select("id", said.alias("response")))
    return out.select("id", "name", "description", "rating", F.array_join("tags", ",").alias("tags"))


# ---------------------------------------------------------------- scalar functions


@query(
    r"""SELECT id, CASE WHEN trim(n) IN ('', '.', '..') OR regexp_matches(trim(n), '[/\\]') THEN NULL ELSE trim(n) END AS folder, starts_with(n, '.') AS hidden,
    coalesce(nullif(substr(trim(regexp_replace(regexp_replace(n, '[\\/:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g')), 1, 80), ''), 'untitled') AS stem,
    coalesce(nullif(lower(trim(e)), ''), 'bin') AS ext
    FROM (SELECT id, CASE id % 6 WHEN 0 THEN ' ' || name WHEN 1 THEN 'a/b:c' WHEN 2 THEN '..' WHEN 3 THEN '.hid' WHEN 4 THEN '  ' ELSE name || '?' END AS n, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  PNG ' WHEN 2 THEN '' ELSE ext END AS e FROM files)""",
    "files",
)
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 6
    n = F.when(k == 0, F.concat(F.lit(" "), F.col("name"))).when(k == 1, "a/b:c").when(k == 2, "..").when(k == 3, ".hid").when(k == 4, "  ").otherwise(F.concat("name", F.lit("?")))
    e = F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, "  PNG ").when(F.col("id") % 4 == 2, "").otherwise(F.col("ext"))
    f = files_of(spark, sf_dir).select("id", n.alias("n"), e.alias("e"))
    return f.select("id", scalars.folder_name(F.col("n")).alias("folder"), scalars.is_hidden(F.col("n")).alias("hidden"), scalars.sanitize_stem(F.col("n"), F.lit("untitled")).alias("stem"), formats.import_extension(F.col("e")).alias("ext"))


@query("SELECT id, name, list_extract(['#ef4444', '#f97316', '#eab308', '#22c55e', '#14b8a6', '#3b82f6', '#8b5cf6', '#ec4899'], CAST(list_sum(list_transform(string_split(name, ''), lambda c: unicode(c))) % 8 + 1 AS INT)) AS color FROM tags", "tags")
def tag_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tags").select("id", "name", scalars.tag_color(F.col("name")).alias("color"))


@query(
    """SELECT id, CASE WHEN size < 1024 THEN size || ' B' ELSE regexp_replace(printf('%.1f', round(size / 1024.0, 1)), '\\.0$', '') || ' KB' END AS size, substr(replace(imported_at, 'T', ' '), 1, 19) AS at FROM files WHERE size < 1048576""",
    "files",
)
def sizes_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_of(spark, sf_dir).filter("size < 1048576")
    return f.select("id", scalars.format_size(F.col("size")).alias("size"), scalars.format_time(F.col("imported_at")).alias("at"))


@query(
    """WITH v AS (SELECT p_partkey AS id, (p_partkey % 3) AS a, (p_size % 4) AS b, (p_partkey % 5) AS c, (p_size % 3) AS d FROM part)
    SELECT id, a > c OR (a = c AND b > d) AS newer FROM v"""
)
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as text, one with a v, one with a suffix that counts as 0."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = lambda *xs: F.concat_ws(".", *(x.cast("string") for x in xs))
    one, two = F.concat(F.lit("v"), text(F.col("p_partkey") % 3, F.col("p_size") % 4)), F.concat(text(F.col("p_partkey") % 5, F.col("p_size") % 3), F.lit("-beta"))
    return p.select(F.col("p_partkey").alias("id"), scalars.is_newer(one, two).alias("newer"))


@query("SELECT id, starts_with(normalized_path, '/library/src1/') OR starts_with(normalized_path, '/library/src3/') AS ok FROM files", "files")
def readable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(spark, sf_dir).select("id", sync.readable(F.col("normalized_path"), ["/library/src1", "/library/src3/"]).alias("ok"))


@query(
    """SELECT id, CASE WHEN id % 8 = 7 THEN 'imported_at' ELSE list_extract(['imported_at', 'created_at', 'name', 'size', 'ext', 'name', 'modified_at'], CAST(id % 8 + 1 AS INT)) END AS sort_by,
    list_extract(['asc', 'desc', 'asc', 'desc', 'asc', 'desc', 'desc', 'desc'], CAST(id % 8 + 1 AS INT)) AS direction FROM files""",
    "files",
)
def saved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved preferences with old and new names of orders."""
    names = [("imported_asc", None), ("created_desc", None), ("name", "asc"), ("size_desc", None), ("ext", "asc"), ("name", "sideways"), ("modified_desc", "asc"), ("color", "asc")]
    options = F.array(*(F.struct(F.lit(a).alias("sortBy"), F.lit(b).cast("string").alias("sortDirection")) for a, b in names))
    f = files_of(spark, sf_dir).select("id", search.saved_order(F.to_json(F.get(options, (F.col("id") % 8).cast("int")))).alias("o"))
    return f.select("id", "o.sort_by", "o.direction")


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS s FROM pages),
    v AS (SELECT page_id, 0 AS form, url, regexp_extract(rtrim(s, '/'), '([^/]+)$', 1) AS name FROM p
          UNION ALL SELECT page_id, 1, s || '/a%3Ab%2F' || page_id || '+x/?q=/z.png', 'a_b_' || page_id || '+x' FROM p
          UNION ALL SELECT page_id, 2, s || '//' || repeat('wört ', 40), repeat('wört ', 32) FROM p
          UNION ALL SELECT page_id, 3, s || '/up/%2e%2E/' || page_id || '/', CAST(page_id AS VARCHAR) FROM p
          UNION ALL SELECT page_id, 4, s || '/%E9', 'browser-image' FROM p
          UNION ALL SELECT page_id, 5, 'no url ' || page_id, 'browser-image' FROM p)
    SELECT page_id AS id, form, name || CASE WHEN regexp_matches(name, '\.[A-Za-z0-9]{1,8}$') THEN '' ELSE CASE page_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.svg' ELSE '' END END AS filename,
           CASE WHEN form < 5 THEN regexp_replace(url, '#.*$', '') END AS clean FROM v"""
)
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of images at the pages' URLs, and at hostile ones made of these."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("s", F.regexp_replace("url", r"[?#].*$", ""))
    tails = [F.concat(F.lit("/a%3Ab%2F"), "page_id", F.lit("+x/?q=/z.png")), F.lit("//" + "wört " * 40), F.concat(F.lit("/up/%2e%2E/"), "page_id", F.lit("/")), F.lit("/%E9")]
    each = F.array(F.col("url"), *(F.concat("s", t) for t in tails), F.concat(F.lit("no url "), "page_id"))
    kind = F.element_at(F.create_map(F.lit(0), F.lit("IMAGE/JPEG; charset=x"), F.lit(1), F.lit("image/svg+xml"), F.lit(2), F.lit("text/html")), (F.col("page_id") % 4).cast("int"))
    v = p.select("page_id", kind.alias("kind"), F.posexplode(each).alias("form", "url"))
    return v.select(F.col("page_id").alias("id"), "form", urls.image_filename(F.col("url"), F.col("kind")).alias("filename"), scalars.normalize_image_url(F.concat("url", F.lit("#x"))).alias("clean"))


@query("SELECT vec_id AS id, 256 AS bytes, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) > 0 AS positive FROM embeddings")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to bytes and back, then to unit length."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), media.encode_vector("embedding").alias("b"))
    v = media.decode_vector("b", F.lit(64)).alias("v")
    norm = F.sqrt(F.aggregate(scalars.l2_normalize(F.col("v")), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return e.select("id", F.length("b").alias("bytes"), v).select("id", "bytes", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), (F.abs(norm - 1) < 1e-5).alias("positive"))


@query("SELECT p_partkey AS id, sha256(unhex(printf('%02X000000%02X000000', p_size % 5 + 1, 2)) || unhex(repeat('0A141E', CAST((p_size % 5 + 1) * 2 AS INT)))) AS hash FROM part")
def visual_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of one color, two pixels high."""
    w = F.col("p_size") % 5 + 1
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), media.visual_hash(w, F.lit(2), F.unhex(F.expr("repeat('0A141E', CAST((p_size % 5 + 1) * 2 AS INT))"))).alias("hash"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '#0A141E:100.0' ELSE '#0A141E:75.0,#F0F0F0:25.0' END AS colors FROM part")
def color_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes of images of one and of two colors."""
    rgb = F.when(F.col("p_size") % 3 == 0, F.unhex(F.lit("0A141E" * 8))).otherwise(F.unhex(F.lit("0A141E" * 6 + "F0F0F0" * 2)))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a few MB of rows are many images: one task would take them all
    p = part.repartition(spread).select(F.col("p_partkey").alias("id"), media.palette(rgb).alias("c"))
    return p.select("id", F.array_join(F.transform("c", lambda x: F.concat(x["color"], F.lit(":"), x["percentage"].cast("string"))), ",").alias("colors"))


@query(
    """SELECT id, CASE id % 9 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/avif' WHEN 5 THEN 'image/heif' WHEN 6 THEN 'image/svg+xml' WHEN 7 THEN 'image/bmp' ELSE 'application/pdf' END AS mime,
    CASE id % 9 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'avif' WHEN 5 THEN 'heic' WHEN 6 THEN 'svg' WHEN 7 THEN 'bmp' ELSE 'mp4' END AS ext FROM files""",
    "files",
)
def sniffed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by the first bytes; the last by its content type or its name."""
    heads = ["89504E470D0A1A0A00", "FFD8FFE000", "474946383961", "524946460000000057454250", "0000001866747970" + "61766966" + "00000000", "0000001866747970" + "68656963" + "00000000", "20203C737667", "424D0000", "00010203"]
    head = F.get(F.array(*(F.unhex(F.lit(h)) for h in heads)), (F.col("id") % 9).cast("int"))
    return files_of(spark, sf_dir).select("id", formats.sniff_mime(head, F.lit("a.pdf")).alias("mime"), formats.sniff_extension(head, F.lit("video/mp4; codecs=x")).alias("ext"))


@query("SELECT id, CASE id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' WHEN 3 THEN 'rar' END AS ext FROM files", "files")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(*map(F.lit, ("text/html; charset=utf-8", "image/apng", " IMAGE/JPG ", "application/vnd.rar", "application/octet-stream")))
    return files_of(spark, sf_dir).select("id", formats.extension_for_content_type(F.get(types, (F.col("id") % 5).cast("int"))).alias("ext"))


@query(
    """SELECT url || '/a.png#top' AS image_url, url AS source_url FROM p UNION ALL SELECT url || '/b.png', url FROM p UNION ALL SELECT url || '/c.jpg', url FROM p UNION ALL SELECT url || '/d.webp', url FROM p
    UNION ALL SELECT 'https://cdn.example.com/same.png', min(url) FROM p UNION ALL SELECT regexp_extract(url, '^[a-z]+://[^/]*') || '/relative.png', min(url) FROM p GROUP BY 1""".replace("FROM p", "FROM (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages) p")
)
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several images a tag, of other elements and of styles; one that all pages share."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    html = F.format_string("<img alt=x src='%s/a.png#top' data-src=\"%s/b.png\"><div data-lazy=%s/c.jpg data-x=1></div><p style='background:url(%s/d.webp)'><img src=https://cdn.example.com/same.png><img src=/relative.png>", *["url"] * 4)
    return scan.page_images(p.withColumn("html", html))


@query(
    """SELECT id, CASE id % 4 WHEN 0 THEN '{"modelPath":"","fgclipMaxPatches":256}' WHEN 1 THEN '{"modelPath":"/m/x","fgclipMaxPatches":576}' WHEN 2 THEN '{"modelPath":"/m/x","fgclipMaxPatches":null}' ELSE '{"modelPath":"","fgclipMaxPatches":256}' END AS key,
    id % 4 = 1 AS enabled, CASE id % 4 WHEN 1 THEN 'gpu' ELSE 'cpu' END AS device, CASE id % 4 WHEN 2 THEN 'auto' WHEN 1 THEN '8' ELSE '4' END AS threads FROM files""",
    "files",
)
def search_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of the search model from JSON, and what embeddings depend on."""
    raw = ("", '{"enabled":true,"modelPath":" /m/./x/ ","runtime":{"device":"gpu","intraThreads":8,"fgclipMaxPatches":576}}', '{"enabled":"yes","modelPath":"\'/m/x\'","runtime":{"device":"tpu","intraThreads":"Auto","fgclipMaxPatches":null}}', "not json")
    c = scalars.search_config(F.get(F.array(*map(F.lit, raw)), (F.col("id") % 4).cast("int")))
    f = files_of(spark, sf_dir).select("id", c.alias("c"))
    return f.select("id", scalars.embedding_key(F.col("c")).alias("key"), "c.enabled", "c.device", "c.threads")


@query("SELECT id, CASE WHEN folder_id IS NULL THEN '/library/x,/library/src1' ELSE '/library/src' || folder_id || CASE WHEN folder_id = 1 THEN ',/library/x' ELSE ',/library/x,/library/src1' END END AS paths FROM files WHERE coalesce(folder_id, 1) < 4", "files")
def recent_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current library first, each once, only those that are there."""
    f = files_of(spark, sf_dir).filter("coalesce(folder_id, 1) < 4")
    there = F.array(*(F.lit(f"/library/{x}") for x in ("x", "src0", "src1", "src2", "src3")))
    current = F.when(F.col("folder_id").isNotNull(), F.concat(F.lit("/library/src"), F.col("folder_id").cast("string"), F.lit("/")))
    return f.select("id", F.array_join(scalars.recent_paths(current, F.array(F.lit("/library/x/"), F.lit("/gone"), F.lit("/library//src1"), F.lit("/library/x")), there), ",").alias("paths"))


@query(
    """SELECT id, '你是素材库整理助手。请根据图片内容和提供的信息整理素材元数据。' || chr(10) || chr(10) || '要求：' || chr(10) || '- 只返回合法 JSON。' || chr(10) || '- 不要输出解释。' || chr(10) || '- 不要编造图片中不可见或原数据中没有的信息。' || chr(10) || '- 中文优先。' || chr(10) || chr(10)
    || '可用原数据：' || chr(10) || '当前文件名：' || name || chr(10) || '当前评价：' || CASE WHEN rating > 0 THEN rating || ' 分' ELSE '无' END || chr(10) || chr(10) || '需要生成的 JSON 格式：' || chr(10) || '{' || chr(10) || '  "filename": "string",' || chr(10) || '  "rating": 4' || chr(10) || '}' || chr(10) || chr(10)
    || '文件名规则：' || chr(10) || 'short' || chr(10) || chr(10) || '评价规则：' || chr(10) || '1 to 5' AS prompt FROM files""",
    "files",
)
def metadata_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array().cast("array<string>")
    return files_of(spark, sf_dir).select("id", scalars.metadata_prompt(F.col("name"), tags, F.col("description"), F.col("rating"), "", {"rating": "1 to 5", "filename": " short "}).alias("prompt"))


# ---------------------------------------------------------------- trees and index runs


@query(
    """WITH RECURSIVE live AS (SELECT id, parent_id, name FROM folders WHERE deleted_at IS NULL),
    t AS (SELECT id, name AS label FROM live WHERE parent_id IS NULL UNION ALL SELECT c.id, t.label || '/' || c.name FROM live c JOIN t ON c.parent_id = t.id) SELECT id, label FROM t WHERE id <> 1002""",
    "folders",
)
def folder_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders flattened with the path of names; the default folder has no row."""
    return trees.path_labels(trees.folder_tree(view(spark, sf_dir, "folders")), 1002).select("id", "label")


@query(
    """WITH RECURSIVE t AS (SELECT id AS ancestor, id AS descendant, 0 AS distance FROM tags UNION ALL SELECT t.ancestor, c.id, t.distance + 1 FROM t JOIN tags c ON c.parent_id = t.descendant) SELECT ancestor, descendant, distance FROM t""",
    "tags",
)
def tag_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a tag and what lies below it."""
    return trees.closure(trees.tag_tree(view(spark, sf_dir, "tags")))


@query(CURRENT + " SELECT id, id IN (SELECT id FROM c WHERE model_id = 'clip-a') AS ready FROM files", "files", "file_visual_embeddings")
def embedding_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.is_ready(files_of(spark, sf_dir), view(spark, sf_dir, "file_visual_embeddings"), "clip-a")


@query(
    COUNTS + """,
    n AS (SELECT s.id, f.size FROM s JOIN files f ON f.id = s.id WHERE (NOT coalesce(status = 'ready' AND embedding IS NOT NULL, FALSE) OR coalesce(outdated, FALSE)) AND NOT (coalesce(status = 'error', FALSE) AND NOT coalesce(outdated, FALSE)) AND s.id % 2 = 0)
    SELECT file_id, status, CAST(dimensions AS INT) AS dimensions FROM file_visual_embeddings WHERE file_id NOT IN (SELECT id FROM n)
    UNION ALL SELECT id, CASE WHEN size % 5 = 0 THEN 'error' ELSE 'ready' END, CASE WHEN size % 5 = 0 THEN 0 ELSE 2 END FROM n""",
    "files", "file_visual_embeddings",
)
def index_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index run with an encoder that fails on some sizes; every other file has content."""
    f, e = files_of(spark, sf_dir), view(spark, sf_dir, "file_visual_embeddings")

    def make():
        def encode(content: bytes) -> list[float]:
            size = int(content)
            if size % 5 == 0:
                raise ValueError(f"cannot read {size}")
            return [float(size), 1.0]

        return encode

    contents = f.filter("id % 2 = 0").select("id", F.col("size").cast("string").cast("binary").alias("content"))
    return vectors.index_job(f, e, "clip-a", contents, make, "2027", wait=0.0).select("file_id", "status", "dimensions")


@query("SELECT CAST(count(*) FILTER (kind <> 'removed') AS BIGINT) AS scanned, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'updated') AS updated, count(*) FILTER (kind = 'moved') AS moved, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'skipped') AS skipped FROM (SELECT CASE event_type WHEN 'view' THEN 'added' WHEN 'click' THEN 'updated' WHEN 'signup' THEN 'moved' WHEN 'purchase' THEN 'removed' ELSE 'skipped' END AS kind FROM events)")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in (("view", "added"), ("click", "updated"), ("signup", "moved"), ("purchase", "removed"), ("error", "skipped")) for x in kv)), F.col("event_type"))
    return sync.sync_summary(spark.read.parquet(f"{sf_dir}/events.parquet").select(kind.alias("kind")))


@query("SELECT id, CASE WHEN folder_id = 3 THEN NULL ELSE folder_id END AS folder_id FROM files", "files")
def clear_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.update_where(files_of(spark, sf_dir), F.col("folder_id") == 3, folder_id=F.lit(None)).select("id", "folder_id")


@query(
    """WITH m AS (SELECT p_partkey AS id, lower(p_name) AS n, lower(p_brand) AS b FROM part),
    r AS (SELECT id, CASE WHEN n = 'br' THEN 6 WHEN starts_with(n, 'br') THEN 5 WHEN contains(n, ' br') THEN 4 WHEN contains(n, 'br') THEN 3 WHEN regexp_matches(n, '(?s)b.*?r') THEN 1 ELSE 0 END AS x, CASE WHEN starts_with(b, 'br') THEN 5 ELSE 0 END AS y FROM m)
    SELECT id, greatest(x, y) AS tier FROM r WHERE greatest(x, y) > 0"""
)
def fuzzy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a text and an array of texts."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), "p_name", F.array(F.lit(None).cast("string"), F.col("p_brand")).alias("tags"))
    return fuzzy.with_tiers(parts, "br", F.col("p_name"), F.col("tags")).select("id", "tier")


# ---------------------------------------------------------------- events


@query(
    """
    WITH RECURSIVE e AS (SELECT path, ts, event_id, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS n FROM fs_events),
    f AS (SELECT path, n, event_id, ts, ts AS armed FROM e WHERE n = 1
          UNION ALL SELECT e.path, e.n, e.event_id, e.ts, CASE WHEN e.ts - f.armed >= INTERVAL 6 HOUR THEN e.ts ELSE f.armed END FROM f JOIN e ON e.path = f.path AND e.n = f.n + 1)
    SELECT event_id, armed FROM f""",
    "fs_events",
)
def armed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that their first event begins: throttled scans, summaries and refreshes."""
    own = view(spark, sf_dir, "fs_events").select("path", "ts", "event_id")
    return events.armed_windows(own, ["path"], 6 * 3600 * 1000).select("event_id", F.col("armed").cast("timestamp_ntz").alias("armed"))


@query(
    """
    WITH e AS (SELECT event_type AS g, ts, user_id, event_id % 7 = 0 AS again, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    k AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT g AS "group", min(ts) AS start, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS ids, bool_or(again) AS again FROM k GROUP BY g, k"""
)
def batches_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids gathered between pauses."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("group"), "ts", F.col("user_id").cast("string").alias("id"), (F.col("event_id") % 7 == 0).alias("again"))
    out = events.batches_of_ids(e, "20 minutes")
    return out.select("group", F.col("start").cast("timestamp_ntz").alias("start"), F.array_join("ids", ",").alias("ids"), "again")


@query(
    """WITH e AS (SELECT path, ts, size, size = lag(size) OVER (PARTITION BY path ORDER BY ts, event_id) AS same FROM fs_events) SELECT path, min(ts) AS ts FROM e WHERE same GROUP BY path""",
    "fs_events",
)
def stable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose size came up twice in a row."""
    own = view(spark, sf_dir, "fs_events").select("path", "ts", "size", F.lit("m").alias("mtime"))
    return events.stable_files(own).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
