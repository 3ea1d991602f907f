"""A store of contents by key: each key is one file, made once.

Writing goes in two steps. Tasks stage what is new in folders of their
attempt; the commit of the job writes one record that names the attempts that
count. Publishing then moves staged files to their places, in tasks, each key
once; it may be run again at any time and ends in the same state. An aborted
job leaves nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from galena.sources.files import file_system, put

STAGING, JOBS = ".staging", ".jobs"
FILES = 5000  # in one staged folder: keys that a task remembers, and lists, at once
ROWS = 100  # contents that a batch brings a task
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def place(folder: str, key: str, suffix: str) -> str:
    """File of a key: spread over 256 folders by a hash of the key."""
    from zlib import crc32

    return f"{folder}/{crc32(key.encode()) % 256:02x}/{quote(key, safe='')}{suffix}"


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class ContentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.suffix, self.job = options["path"], options.get("suffix", ".webp"), options.get("job") or uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, folder = file_system(self.folder)
        own, seen, files, part = f"{STAGING}/{self.job}/{uuid4().hex}", set(), 0, ""
        for batch in iterator:
            contents = batch.column(1)
            for at, key in enumerate(batch.column(0).to_pylist()):
                if not key or not contents[at].is_valid or key in seen or store.get_file_info(place(folder, key, self.suffix)).type == fs.FileType.File:
                    continue
                if files % FILES == 0:  # a key that comes again in a later folder is left there by publish
                    part = f"{folder}/{own}/{files // FILES}"
                    store.create_dir(part, recursive=True)
                    seen.clear()
                seen.add(key)
                files += 1
                with store.open_output_stream(f"{part}/{quote(key, safe='')}") as out:
                    out.write(contents[at].as_buffer())
        return Staged(own, files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, folder = file_system(self.folder)
        store.create_dir(f"{folder}/{JOBS}", recursive=True)
        put(store, f"{folder}/{JOBS}/{self.job}.json", json.dumps([m.folder for m in messages if m and m.files]).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        store, folder = file_system(self.folder)
        if store.get_file_info(f"{folder}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{STAGING}/{self.job}")


class AssetContents(DataSource):
    """``format("asset_contents")``: stages rows (key, content) for :func:`publish`."""

    @classmethod
    def name(cls) -> str:
        return "asset_contents"

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema, overwrite: bool) -> ContentWriter:
        return ContentWriter(dict(self.options))


def publish(spark: SparkSession, folder: str, suffix: str = ".webp") -> int:
    """Move what committed jobs have staged to its place, each key once; how many tasks' folders there were."""
    store, own = file_system(folder)
    jobs = [i for i in store.get_file_info(fs.FileSelector(f"{own}/{JOBS}", allow_not_found=True)) if i.base_name.endswith(".json")]
    staged = []
    for job in jobs:
        with store.open_input_stream(job.path) as file:
            staged += [(x,) for x in json.loads(file.read())]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        store, own = file_system(folder)
        for part in parts:
            for source in part.column("folder").to_pylist():
                for staged in sorted(store.get_file_info(fs.FileSelector(f"{own}/{source}", allow_not_found=True)), key=lambda i: int(i.base_name)):
                    for info in store.get_file_info(fs.FileSelector(staged.path)):
                        to = place(own, unquote(info.base_name), suffix)
                        if store.get_file_info(to).type == fs.FileType.NotFound:
                            store.create_dir(to.rpartition("/")[0], recursive=True)
                            store.move(info.path, to)  # equal keys have equal contents: whichever task comes last
            yield pa.RecordBatch.from_pydict({"folder": part.column("folder")})

    if staged:
        spark.createDataFrame(staged, "folder string").repartition(len(staged)).mapInArrow(run, "folder string").count()
    for job in jobs:
        name = job.base_name.removesuffix(".json")
        if store.get_file_info(f"{own}/{STAGING}/{name}").type == fs.FileType.Directory:
            store.delete_dir(f"{own}/{STAGING}/{name}")
        store.delete_file(job.path)
    return len(staged)


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """Batches that start here bring a task ``rows`` rows at most, as a content may be large."""
    before = spark.conf.get(RECORDS)
    spark.conf.set(RECORDS, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(RECORDS, before)


def put_contents(rows: DataFrame, folder: str, suffix: str = ".webp") -> None:
    """Store rows (key, content): keys that are there stay as they are, of rows of one key one is taken.

    Null and empty keys and null contents are left out. Rows of a key meet in
    one task, with one row of each task at most.
    """
    spark = rows.sparkSession
    spark.dataSource.register(AssetContents)
    once = rows.select(F.col("key").cast("string").alias("key"), F.col("content").cast("binary").alias("content")).filter("key <> '' AND content IS NOT NULL").groupBy("key").agg(F.first("content").alias("content"))
    with small_batches(spark):
        once.write.format("asset_contents").option("suffix", suffix).mode("append").save(folder)
    publish(spark, folder, suffix)


def contents_of(keys: DataFrame, folder: str, suffix: str = ".webp") -> DataFrame:
    """``keys`` (key, ...) with ``at``, the path of their file, null where there is none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, own = file_system(folder)
        for part in parts:
            paths = [place(own, k, suffix) if k else None for k in part.column("key").to_pylist()]
            found = [p if p and store.get_file_info(p).type == fs.FileType.File else None for p in paths]
            yield part.append_column("at", pa.array(found, pa.string()))

    return keys.mapInArrow(run, keys.withColumn("at", F.lit(None).cast("string")).schema)


def remove_contents(keys: DataFrame, folder: str, suffix: str = ".webp") -> int:
    """Remove the files of ``keys`` (key, legacy: another key of the same file, or null); how many went."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, own = file_system(folder)
        for part in parts:
            gone = 0
            for key in {*part.column("key").to_pylist(), *part.column("legacy").to_pylist()} - {None, ""}:
                to = place(own, key, suffix)
                if store.get_file_info(to).type == fs.FileType.File:
                    store.delete_file(to)
                    gone += 1
            yield pa.RecordBatch.from_pydict({"n": [gone]})

    legacy = F.col("legacy") if "legacy" in keys.columns else F.lit(None)
    once = keys.select("key", legacy.cast("string").alias("legacy")).distinct()
    return once.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
