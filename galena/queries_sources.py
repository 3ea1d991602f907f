"""Queries over sources and sinks of files, and their oracle SQL: trees that Spark writes from the tables, listed, followed and stored."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.queries import query
from galena.session import shared_folder
from galena.sources import contents, listing, scan
from galena.sources.library import view

# ---------------------------------------------------------------- directory trees

TREE = """SELECT id, CASE WHEN id % 19 = 0 THEN '.cache/' ELSE '' END || 'f' || CAST(id % 7 AS STRING) || '/g' || CAST(id % 3 AS STRING) || '/' || CASE WHEN id % 23 = 0 THEN '.' ELSE '' END
    || 'n' || CAST(id AS STRING) || '.' || CASE id % 11 WHEN 0 THEN 'eps' WHEN 1 THEN 'exe' ELSE ext END AS path,
    CASE id % 9 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '474946383961' WHEN 3 THEN '255044462D312E37' WHEN 4 THEN '524946460000000057454250' WHEN 5 THEN '00000018667479706D703432' WHEN 6 THEN '424D' WHEN 7 THEN '' ELSE '3C73766720' END AS head,
    CAST(size % 9000 AS INT) AS fill FROM files"""


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Files and folders made of the file table, and folders without files of the nations."""
    root = f"{shared_folder(spark)}/tree-{uuid4().hex}"
    rows = spark.sql(TREE.replace("FROM files", "FROM {files}"), files=view(spark, sf_dir, "files"))
    empty = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("empty/"), "n_name").alias("path"), F.lit(None).cast("binary").alias("content"))
    listing.write_files(rows.select("path", F.concat(F.unhex("head"), F.expr("repeat('x', fill)").cast("binary")).alias("content")).unionByName(empty), root)
    return root


def _below(path: str, root: str) -> F.Column:
    return F.substring_index(F.col(path), f"/{root.rpartition('/')[2]}/", -1)


@query(
    f"""WITH t AS ({TREE.replace("STRING", "VARCHAR")}), s AS (SELECT *, CASE id % 9 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'pdf' WHEN 4 THEN 'webp' WHEN 5 THEN 'mp4' WHEN 6 THEN 'bmp' WHEN 8 THEN 'svg' ELSE lower(regexp_extract(path, '[.]([^.]+)$', 1)) END AS ext FROM t)
    SELECT path, ext, length(head) // 2 + fill AS size FROM s WHERE id % 19 <> 0 AND id % 23 <> 0 AND id % 11 <> 0 AND ext <> 'exe'""",
    "files",
)
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported files of a tree by what their first bytes say; hidden and blocked ones left out."""
    root = _tree(spark, sf_dir)
    return scan.directory(spark, root).select(_below("path", root).alias("path"), "ext", "size")


@query(
    f"""WITH t AS ({TREE.replace("STRING", "VARCHAR")}) SELECT path, lower(regexp_extract(path, '[.]([^.]+)$', 1)) AS ext, coalesce(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS relative_dir FROM t WHERE id % 11 NOT IN (0, 1)""",
    "files",
)
def import_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files for an import: hidden ones too, by their names alone, with their folder below the root."""
    root = _tree(spark, sf_dir)
    files = scan.relative(scan.directory(spark, root, sniff=False, hidden=True), root.removeprefix("file:"))
    return files.select(_below("path", root).alias("path"), "ext", "relative_dir")


@query("SELECT DISTINCT 'f' || CAST(id % 7 AS VARCHAR) AS path FROM files WHERE id % 19 <> 0 UNION SELECT 'f' || CAST(id % 7 AS VARCHAR) || '/g' || CAST(id % 3 AS VARCHAR) FROM files WHERE id % 19 <> 0 UNION SELECT 'empty' UNION SELECT 'empty/' || n_name FROM nation", "files")
def directory_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of a tree, empty ones too."""
    root = _tree(spark, sf_dir)
    return scan.folders(spark, root).select(_below("path", root).alias("path"))


# ---------------------------------------------------------------- changes of a tree

QUARTERS = """SELECT 'u' || CAST(user_id % 30 AS STRING) || '/' || CAST(user_id AS STRING) || '.bin' AS path, q, event_type = 'error' AS gone, CAST(floor(value) AS INT) AS size
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, q ORDER BY ts DESC, event_id DESC) AS n FROM (SELECT *, CAST((event_id * 4) DIV (SELECT max(event_id) + 1 FROM events) AS INT) AS q FROM events) x) y WHERE n = 1"""


@query(
    f"""WITH l AS ({QUARTERS.replace("STRING", "VARCHAR").replace(" DIV ", " // ")}),
    w AS (SELECT *, lag(gone) OVER (PARTITION BY path ORDER BY q) AS before FROM l)
    SELECT path, CASE WHEN gone THEN 'unlink' WHEN coalesce(before, TRUE) THEN 'add' ELSE 'change' END AS kind, q AS listing, CASE WHEN NOT gone THEN size END AS size FROM w WHERE q > 0 AND NOT (gone AND coalesce(before, TRUE))
    UNION ALL SELECT split_part(path, '/', 1), 'addDir', min(q), NULL FROM l WHERE NOT gone GROUP BY 1 HAVING min(q) > 0"""
)
def folder_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree written anew after each quarter of the events, followed by a stream: what its listings differ in."""
    base = f"{shared_folder(spark)}/watch-{uuid4().hex}"
    rows = spark.sql(QUARTERS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows.write.parquet(f"{base}/quarters")
    rows = spark.read.schema(rows.schema).parquet(f"{base}/quarters")
    out = "path string, kind string, size int"

    def take(batch: DataFrame, number: int) -> None:
        batch.select("path", "kind", F.col("size").cast("int").alias("size")).write.mode("overwrite").parquet(f"{base}/out/listing={number}")

    for q in range(4):
        own = rows.filter(F.col("q") == q)
        listing.write_files(own.filter("NOT gone").select("path", F.expr("repeat('x', size)").cast("binary").alias("content")), f"{base}/tree")
        listing.remove_files(own.filter("gone"), f"{base}/tree")
        stream = listing.changes(spark, f"{base}/tree", f"{base}/listings", buckets=4)
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(f"{out}, listing int").parquet(f"{base}/out")
    return got.select(F.regexp_replace("path", "^.*/tree/", "").alias("path"), "kind", "listing", "size")


# ---------------------------------------------------------------- contents by key


@query("SELECT md5(text) AS key, octet_length(encode(any_value(text))) AS size, count(*) FILTER (doc_id % 29 <> 0 AND doc_id % 31 <> 0) AS files FROM documents GROUP BY 1 HAVING count(*) FILTER (doc_id % 29 <> 0 AND doc_id % 31 <> 0) > 0")
def stored_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents stored by hash in two jobs: one file a key, however many files have it."""
    folder = f"{shared_folder(spark)}/contents-{uuid4().hex}"
    f = view(spark, sf_dir, "files").select("id", F.col("content_hash").alias("key"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))
    rows = f.join(d, "id")
    for part in (rows.filter("id % 3 = 0"), rows):
        contents.put_contents(part, folder)
    stored = listing.tree(spark, folder).filter("kind = 'file'").select(F.regexp_extract("path", r"([^/]+)\.webp$", 1).alias("key"), "size")
    uses = f.filter("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("files"))
    return stored.join(uses, "key", "left").select("key", "size", "files")


# ---------------------------------------------------------------- images of pages


@query(
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*/)[^/]*$', 1) AS folder, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    r AS (SELECT *, replace(replace(href, '&amp;', '&'), '&quot;', '"') AS h FROM p),
    i AS (SELECT page_id, url, CASE WHEN regexp_matches(h, '^https?://') THEN h WHEN h LIKE '/%' THEN CASE page_id % 2 WHEN 0 THEN host ELSE 'https://cdn.example.com' END || h ELSE CASE page_id % 2 WHEN 0 THEN folder ELSE 'https://cdn.example.com/x/' END || h END AS image FROM r WHERE h <> '')
    SELECT url, array_to_string(list_transform(string_split(image, ''), lambda c: CASE WHEN regexp_matches(c, '^[!-~]$') AND c NOT IN ('"', '<', '>', '`', '{', '}') THEN c ELSE url_encode(c) END), '') AS image_url, count(*) AS findings
    FROM i GROUP BY ALL"""
)
def linked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of real pages read as images, half of them under a base address; how often each is found."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    base = F.when(F.col("page_id") % 2 == 1, '<head><base href="https://CDN.example.com:443/./x/y/../z">').otherwise("<head>")
    html = F.replace(F.regexp_replace("html", "<head>", base), F.lit("<a href="), F.lit("<img alt='a > b' src="))
    found = scan.image_findings(p.select("url", html.alias("html")))
    return found.groupBy("url", "image_url").agg(F.count(F.lit(1)).alias("findings"))
