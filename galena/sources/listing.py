"""Directory trees as tables and as streams of differences.

Trees are listed by tasks: the driver only looks for enough folders to deal
out, and a folder with many entries is dealt by their names. A folder is one
row too, so empty ones are kept. What is in files is read apart, by
:func:`with_heads`, and no more of each than asked for.

Files are written, read, copied and removed by as many tasks as there are
shuffle partitions: each costs the same few calls however small its row is,
and a few MB of rows are many files.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from galena.sources.files import file_system, put

PROBE = 4096
WIDE = 10_000  # entries of a folder that is dealt as a whole, at most
LISTING = "path string, kind string, size long, modified_at timestamp"
CHANGES = "path string, kind string, ts timestamp, size long, modified_at timestamp"
ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC"))])


def flag(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


def children(store: fs.FileSystem, folder: str, hidden: bool) -> list[fs.FileInfo]:
    """Files and folders in ``folder``, by name; links are neither. A folder that went meanwhile has none."""
    local = isinstance(store, fs.LocalFileSystem)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    kept = [i for i in found if (hidden or not i.base_name.startswith(".")) and i.type in (fs.FileType.File, fs.FileType.Directory) and not (local and os.path.islink(i.path))]
    return sorted(kept, key=lambda i: i.base_name)


def is_wide(store: fs.FileSystem, folder: str) -> bool:
    """Whether ``folder`` holds more than ``WIDE`` entries; of a local one no more than these are looked at."""
    if not isinstance(store, fs.LocalFileSystem):
        return len(store.get_file_info(fs.FileSelector(folder, allow_not_found=True))) > WIDE
    try:
        with os.scandir(folder) as found:
            return sum(1 for _ in islice(found, WIDE + 1)) > WIDE
    except OSError:  # gone, or no folder: its listing tells
        return False


def share_of(store: fs.FileSystem, folder: str, hidden: bool, share: int, of: int) -> list[fs.FileInfo]:
    """The children whose names hash to ``share`` of ``of``; only these are held of a local folder."""
    own = lambda name: crc32(os.fsencode(name)) % of == share
    if not isinstance(store, fs.LocalFileSystem):
        return [i for i in children(store, folder, hidden) if own(i.base_name)]
    try:
        with os.scandir(folder) as found:
            paths = sorted(e.path for e in found if own(e.name) and (hidden or not e.name.startswith(".")) and not e.is_symlink())
    except FileNotFoundError:
        return []
    return [i for i in store.get_file_info(paths) if i.type in (fs.FileType.File, fs.FileType.Directory)]


def walk(store: fs.FileSystem, folder: str, hidden: bool) -> Iterator[fs.FileInfo]:
    """All below ``folder``, a folder before what it holds."""
    todo = [folder]
    while todo:
        below = []
        for info in children(store, todo.pop(), hidden):
            yield info
            if info.type == fs.FileType.Directory:
                below.append(info.path)
        todo += reversed(below)


def entry(info: fs.FileInfo) -> tuple:
    is_dir = info.type == fs.FileType.Directory
    at = info.mtime_ns
    return info.path, "dir" if is_dir else "file", None if is_dir else info.size, None if at is None else at // 1000


def batches(rows: Iterator[tuple], schema: pa.Schema, room: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)
        held.clear()
        return made

    for row in rows:
        held.append(row)
        if len(held) == room:
            yield batch()
    yield batch()


@dataclass
class Folders(InputPartition):
    """Folders to list: with all below them, or their own entries alone; and wide ones, of which each task takes a share with all below."""

    whole: list[str]
    own: list[str]
    wide: list[str]
    share: int
    of: int


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.hidden, self.splits = options["path"], flag(options, "hidden"), int(options.get("splits", 64))

    def partitions(self) -> list[Folders]:
        store, root = file_system(self.root)
        whole, own, wide = [root], [], []
        for _ in range(8 * self.splits):  # folders that the driver opens, at most
            if not whole or len(whole) >= self.splits:
                break
            folder = whole.pop(0)
            if is_wide(store, folder):
                wide.append(folder)
                continue
            own.append(folder)
            whole += [i.path for i in children(store, folder, self.hidden) if i.type == fs.FileType.Directory]
        n = self.splits if wide else max(1, min(self.splits, len(whole) + len(own)))
        return [Folders(whole[k::n], own[k::n], wide, k, n) for k in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.root)

        def rows() -> Iterator[tuple]:
            for folder in partition.own:
                yield from map(entry, children(store, folder, self.hidden))
            for folder in partition.whole:
                yield from map(entry, walk(store, folder, self.hidden))
            for folder in partition.wide:
                for info in share_of(store, folder, self.hidden, partition.share, partition.of):
                    yield entry(info)
                    if info.type == fs.FileType.Directory:
                        yield from map(entry, walk(store, info.path, self.hidden))

        return batches(rows(), ARROW)


class AssetTree(DataSource):
    """``format("asset_tree")``: all files and folders below ``path``.

    Names that begin with a dot are skipped, with all below them, unless
    ``hidden``. ``splits`` bounds the tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "asset_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def tree(spark: SparkSession, path: str, hidden: bool = False, splits: int = 64) -> DataFrame:
    """(path, kind, size, modified_at) of the files and folders below ``path``."""
    spark.dataSource.register(AssetTree)
    return spark.read.format("asset_tree").option("hidden", hidden).option("splits", splits).load(path)


def spread(rows: DataFrame, key: str = "path") -> DataFrame:
    """``rows`` dealt by ``key`` to as many tasks as there are shuffle partitions, which are not merged by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def with_heads(files: DataFrame, size: int = PROBE) -> DataFrame:
    """``files`` with ``head``: the first ``size`` bytes, null where a file can't be read.

    Files are dealt out by path, as one folder may hold most of them.
    """
    schema = files.withColumn("head", F.lit(None).cast("binary")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                own, heads = part.slice(at, 256), []
                for path in own.column("path").to_pylist():
                    try:
                        store, place = file_system(path)
                        with store.open_input_file(place) as file:
                            head = file.read_at(min(size, PROBE), 0)
                            if len(head) == PROBE < size:  # what is asked for is set aside before it is read: most files are small
                                head += file.read_at(size - PROBE, PROBE)
                            heads.append(head)
                    except OSError:
                        heads.append(None)
                yield own.append_column("head", pa.array(heads, pa.binary()))

    return spread(files).mapInArrow(run, schema)


# ---------------------------------------------------------------- differences of successive listings


@dataclass
class Bucket(InputPartition):
    start: int
    end: int
    bucket: int


class ChangeReader(DataSourceStreamReader):
    """Every micro-batch lists the tree once and tells what differs from the listing before.

    Folders at ``depth`` are dealt to ``buckets`` by a hash of their path, what
    lies above them to bucket 0, so tasks list and compare their own parts
    alone. A part's listing is stored under its number in ``state`` before it
    is compared: a batch that runs again, after a loss or from a checkpoint,
    compares the same listings and tells the same changes.
    """

    def __init__(self, options: dict):
        self.root, self.state, self.hidden, self.initial = options["path"], options["state"], flag(options, "hidden"), flag(options, "initial")
        self.buckets, self.depth = int(options.get("buckets", 16)), int(options.get("depth", 1))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def stored(self) -> int:
        """The last listing that all buckets have stored."""
        store, state = file_system(self.state)
        numbers = sorted((int(i.base_name) for i in store.get_file_info(fs.FileSelector(state, allow_not_found=True)) if i.base_name.isdigit()), reverse=True)
        for n in numbers:
            parts = [i for i in store.get_file_info(fs.FileSelector(f"{state}/{n}")) if i.base_name.endswith(".json")]
            if len(parts) == self.buckets:
                return n
        return 0

    def latestOffset(self) -> dict:
        return {"listing": self.stored() + 1}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        return [Bucket(start["listing"], end["listing"], k) for k in range(self.buckets)]

    def bucket_of(self, path: str) -> int:
        return crc32(path.encode()) % self.buckets

    def listed(self, bucket: int) -> Iterator[tuple]:
        store, root = file_system(self.root)
        level = [root]
        for depth in range(1, self.depth + 1):
            below = []
            for folder in level:
                for info in children(store, folder, self.hidden):
                    is_dir = info.type == fs.FileType.Directory
                    if not (is_dir and depth == self.depth) and bucket == 0:
                        yield entry(info)
                    if is_dir and depth < self.depth:
                        below.append(info.path)
                    elif is_dir and self.bucket_of(info.path) == bucket:
                        yield entry(info)
                        yield from map(entry, walk(store, info.path, self.hidden))
            level = below

    def listing(self, n: int, bucket: int, make: bool) -> dict:
        """Listing ``n`` of a bucket as stored; ``make`` takes and stores it if it is not there."""
        store, state = file_system(self.state)
        place = f"{state}/{n}/{bucket}.json"
        if store.get_file_info(place).type == fs.FileType.NotFound:
            if not make:
                return {"at": 0, "entries": {}}
            at = time.time_ns() // 1000
            entries = {path: [kind, size, mtime] for path, kind, size, mtime in self.listed(bucket)}
            store.create_dir(f"{state}/{n}", recursive=True)
            put(store, place, json.dumps({"at": at, "entries": entries}).encode())
        with store.open_input_stream(place) as file:
            return json.loads(file.read())

    def read(self, partition: Bucket) -> Iterator[tuple]:
        now = self.listing(partition.end, partition.bucket, True)
        before = self.listing(partition.start, partition.bucket, False)
        if partition.start == 0 and not self.initial:
            return
        time_of = lambda t: None if t is None else datetime.fromtimestamp(t / 1e6, UTC)
        at = time_of(now["at"])
        old, new = before["entries"], now["entries"]
        for path in sorted(old.keys() | new.keys()):
            was, is_ = old.get(path), new.get(path)
            if was and (not is_ or is_[0] != was[0]):
                yield path, "unlinkDir" if was[0] == "dir" else "unlink", at, None, None
            if is_ and (not was or is_[0] != was[0]):
                yield path, "addDir" if is_[0] == "dir" else "add", at, is_[1], time_of(is_[2])
            elif is_ and is_[0] == "file" and is_ != was:
                yield path, "change", at, is_[1], time_of(is_[2])

    def commit(self, end: dict) -> None:
        """Listings before the last two are needed no more."""
        store, state = file_system(self.state)
        for info in store.get_file_info(fs.FileSelector(state, allow_not_found=True)):
            if info.base_name.isdigit() and int(info.base_name) < end["listing"] - 1:
                store.delete_dir(info.path)


class AssetChanges(DataSource):
    """``format("asset_changes")``: a stream of add, change, unlink, addDir and unlinkDir below ``path``.

    What is there at first is silent unless ``initial``. ``state`` is a folder
    for the listings, of one stream alone.
    """

    @classmethod
    def name(cls) -> str:
        return "asset_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


def changes(spark: SparkSession, path: str, state: str, **options) -> DataFrame:
    """A stream of (path, kind, ts, size, modified_at): differences of successive listings of ``path``."""
    spark.dataSource.register(AssetChanges)
    return spark.readStream.format("asset_changes").option("state", state).options(**options).load(path)


# ---------------------------------------------------------------- writing


def write_files(rows: DataFrame, root: str) -> int:
    """Write rows (path below ``root``, content; null: a folder) as files, each whole or not at all; null paths are left out. The number written."""
    clean = re.sub(r"/+$", "", root)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(clean)
        for part in parts:
            made = 0
            for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True):
                place = f"{top}/{path}"
                store.create_dir(place if content is None else place.rpartition("/")[0], recursive=True)
                if content is not None:
                    put(store, place, content)
                made += 1
            yield pa.RecordBatch.from_pydict({"n": [made]})

    own = rows.select(F.col("path"), F.col("content").cast("binary").alias("content")).filter("path IS NOT NULL")
    return spread(own).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def remove_files(paths: DataFrame, root: str) -> int:
    """Remove the files of ``paths`` (path below ``root``) that are there; how many went."""
    clean = re.sub(r"/+$", "", root)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(clean)
        for part in parts:
            there = [p for p in part.column("path").to_pylist() if p and store.get_file_info(f"{top}/{p}").type == fs.FileType.File]
            for path in there:
                store.delete_file(f"{top}/{path}")
            yield pa.RecordBatch.from_pydict({"n": [len(there)]})

    return spread(paths.select("path")).distinct().mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def copy_files(pairs: DataFrame, move: bool = False) -> int:
    """Copy files (source, target: paths), or move them, each whole or not at all; sources that are gone are passed over. The number done."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = 0
            for source, target in zip(part.column("source").to_pylist(), part.column("target").to_pylist(), strict=True):
                if not source or not target or source == target:
                    continue
                store, own = file_system(source)
                _, to = file_system(target)
                if store.get_file_info(own).type != fs.FileType.File:
                    continue
                store.create_dir(to.rpartition("/")[0], recursive=True)
                if move:
                    store.move(own, to)
                else:
                    store.copy_file(own, f"{to}.part")
                    store.move(f"{to}.part", to)
                done += 1
            yield pa.RecordBatch.from_pydict({"n": [done]})

    return spread(pairs.select("source", "target"), "target").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
