"""Sources: directories of files, web pages, and landing folders of a collector."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import formats, markup, urls
from galena.sources import listing


def directory(spark: SparkSession, path: str, sniff: bool = True, hidden: bool = False) -> DataFrame:
    """Supported files below ``path``: path, name, ext, size, modified_at.

    Names and directories that begin with a dot are skipped unless ``hidden``
    (imports take them). ``sniff`` takes the first 4096 bytes of each file
    that its name does not block for its real format; else the name decides
    and no content is read.
    """
    named = listing.tree(spark, path, hidden).filter("kind = 'file'").withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    own = formats.normalize_extension(F.regexp_extract("name", r"[^.]\.([^.]+)$", 1))
    files = named.withColumn("ext", own).filter(~F.col("ext").isin(formats.BLOCKED))
    if sniff:
        files = listing.with_heads(files).withColumn("ext", F.coalesce(formats.sniff_extension(F.col("head")), "ext"))
    out = files.select("path", "name", "ext", "size", F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("modified_at"))
    return out.filter(F.col("ext").isin(formats.SCAN_SUPPORTED) & ~F.col("ext").isin(formats.BLOCKED))


def folders(spark: SparkSession, path: str) -> DataFrame:
    """Folders below ``path`` but for hidden ones, empty ones too."""
    return listing.tree(spark, path).filter("kind = 'dir'").select("path")


def directories(files: DataFrame) -> DataFrame:
    """Distinct parent directories of ``files``."""
    return files.select(F.regexp_replace("path", r"/[^/]+$", "").alias("path")).distinct()


def relative(files: DataFrame, root: str) -> DataFrame:
    """``files`` with relative_dir below ``root``."""
    top = root.rstrip("/") + "/"
    return files.withColumn("relative_dir", F.regexp_replace(F.substring(F.col("path"), F.lit(len(top) + 1), F.length("path")), r"/?[^/]*$", ""))


def image_findings(pages: DataFrame) -> DataFrame:
    """(url, image_url, place, width, height): every image reference of each page (url, html), in the order a collector finds them.

    References are resolved as browsers do, relative ones too; only http(s)
    images count.
    """
    schema = "url string, base string, reference string, hangs boolean, place int, width int, height int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for url, html in zip(*(batch.column(k).slice(at, 64).to_pylist() for k in (0, 1)), strict=True):
                    base, found = markup.image_references(html)
                    rows += [(url, base, reference, hangs, place, width, height) for place, (reference, hangs, width, height) in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()))], names=[x.split()[0] for x in schema.split(", ")])

    found = pages.select("url", "html").mapInArrow(run, schema)
    # a base that is no http(s) address is none
    base = F.when((F.col("base") != "") & F.col("hangs"), F.coalesce(urls.resolve(F.col("url"), F.col("base")), "url")).otherwise(F.col("url"))
    return found.select("url", urls.resolve(base, F.col("reference")).alias("image_url"), "place", "width", "height").filter("image_url IS NOT NULL")


def images_of_pages(pages: DataFrame) -> DataFrame:
    """(url, image_url, place, width, height): images of each page, each once; the first finding gives place and size."""
    first = F.min(F.struct("place", "width", "height"))
    return image_findings(pages).groupBy("url", "image_url").agg(first.alias("f")).select("url", "image_url", "f.place", "f.width", "f.height")


def page_images(pages: DataFrame) -> DataFrame:
    """(image_url, source_url): images of all pages, each once; the smallest page URL is its source."""
    return images_of_pages(pages).groupBy("image_url").agg(F.min("url").alias("source_url"))


def page_links(pages: DataFrame) -> DataFrame:
    """(href, n): link targets and how often they occur."""
    each = pages.select(F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a href="([^"]*)"'), 1)).alias("href"))
    return each.groupBy("href").agg(F.count(F.lit(1)).alias("n"))


def landing_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files dropped into a folder as a stream of path, content and time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(path)
