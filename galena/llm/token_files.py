"""Token ids in files of directly addressable codes.

A file splits each id into chunks of ``bits`` bits. Level 0 holds the lowest
chunk of every id; a bitmap says which ids go on, and level 1 holds the next
chunk of those alone, and so forth. A rank directory counts the ones before
each 512 bits of a bitmap, so the place of an id in the next level is one
count and at most 64 bytes away: any id is read by a few small reads, and no
block is decoded. Ids that lie side by side do so at every level, so a
document is one range of each.

Files are written and read as a Spark data source. A task cuts what it gets
into files of about ``file_ids`` ids; a manifest, written when all tasks have
ended, names the files of the attempts that count, in order, so lost tasks and
repeated attempts leave no trace. The driver holds one line a file.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from galena.llm.common import shared_folder, text_of
from galena.llm.rows import tag
from galena.llm.tokens import WORD_BPE, word_ids
from galena.sources.files import file_system, put

MAGIC, BLOCK, MANIFEST = b"DAC1", 512, "manifest.json"
SCHEMA = "doc_id long, start long, ids binary"


def packed(chunks: np.ndarray, bits: int) -> bytes:
    """``chunks`` in ``bits`` bits each, from the lowest bit of the first byte."""
    if bits in (8, 16):
        return chunks.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((chunks[:, None] >> np.arange(bits, dtype="uint32") & 1).astype("uint8").ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, bits: int, skip: int, n: int) -> np.ndarray:
    """``n`` chunks that begin ``skip`` bits into ``data``."""
    if bits in (8, 16):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("uint32")
    each = np.unpackbits(np.frombuffer(data, "uint8"), bitorder="little")[skip : skip + n * bits]
    return each.reshape(n, bits).astype("uint32") @ (np.uint32(1) << np.arange(bits, dtype="uint32"))


def encoded(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """One file: parts, then where they are as JSON, its size, and a mark."""
    parts: list[bytes] = []
    places: list[int] = []

    def add(data: bytes) -> int:
        places.append(places[-1] + len(parts[-1]) if parts else 0)
        parts.append(data)
        return places[-1]

    levels, rest = [], ids.astype("uint32")
    while not levels or len(rest):
        above = rest >> np.uint32(bits)
        more = above > 0
        level = {"n": len(rest), "chunks": add(packed(rest & np.uint32((1 << bits) - 1), bits))}
        if more.any():
            blocks = -(-len(more) // BLOCK)
            level["more"] = add(np.packbits(np.pad(more, (0, blocks * BLOCK - len(more))), bitorder="little").tobytes())
            ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype="int64")
            level["ranks"] = add((np.cumsum(ones) - ones).astype("<u4").tobytes())
        levels.append(level)
        rest = above[more]
    head = {
        "bits": bits, "levels": levels, "n_docs": len(doc_ids), "n_ids": len(ids), "doc_ids": add(np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        "named": add(np.array([d is not None for d in doc_ids], "u1").tobytes()), "starts": add(np.concatenate([[0], np.cumsum(lengths, dtype="int64")]).astype("<i8").tobytes()),
    }
    foot = json.dumps(head).encode()
    return b"".join([*parts, foot, len(foot).to_bytes(4, "little"), MAGIC])


class TokenFile:
    """One file, read by small reads."""

    def __init__(self, path: str):
        store, own = file_system(path)
        self.file = store.open_input_file(own)
        size = self.file.size()
        tail = self.file.read_at(8, size - 8)
        if tail[4:] != MAGIC:
            raise ValueError(f"no token file: {path}")
        foot = int.from_bytes(tail[:4], "little")
        self.head = json.loads(self.file.read_at(foot, size - 8 - foot))
        self.bits, self.levels = self.head["bits"], self.head["levels"]

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def numbers(self, name: str, kind: str, a: int, b: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at((b - a) * width, self.head[name] + a * width), kind)

    def chunks(self, level: dict, a: int, b: int) -> np.ndarray:
        first = a * self.bits // 8
        return unpacked(self.file.read_at((b * self.bits + 7) // 8 - first, level["chunks"] + first), self.bits, a * self.bits - first * 8, b - a)

    def goes_on(self, level: dict, a: int, b: int) -> np.ndarray:
        data = np.frombuffer(self.file.read_at((b + 7) // 8 - a // 8, level["more"] + a // 8), "uint8")
        return np.unpackbits(data, bitorder="little")[a % 8 :][: b - a].astype(bool)

    def rank(self, level: dict, i: int) -> int:
        """How many ids before place ``i`` go on."""
        block = i // BLOCK
        before = int.from_bytes(self.file.read_at(4, level["ranks"] + 4 * block), "little")
        return before + int(self.goes_on(level, block * BLOCK, i).sum())

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids of places [a, b)."""
        out, at = np.zeros(b - a, "uint32"), np.arange(b - a)
        for k, level in enumerate(self.levels):
            if a >= b:
                break
            out[at] |= self.chunks(level, a, b) << np.uint32(k * self.bits)
            if "more" not in level:
                break
            more = self.goes_on(level, a, b)
            at, a = at[more], self.rank(level, a)
            b = a + len(at)
        return out

    def batches(self, base: int, room: int) -> Iterator[pa.RecordBatch]:
        """(doc_id, start, ids) of all documents, about ``room`` ids at a time; ``base`` is the place of the file's first id."""
        n = self.head["n_docs"]
        starts = self.numbers("starts", "<i8", 0, n + 1)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + room, "right")) - 1)
            own = starts[a : b + 1]
            data, bounds = self.ids(int(own[0]), int(own[-1])).astype("<u4").tobytes(), (own - own[0]) * 4
            ids = pa.array([data[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
            named = self.numbers("named", "u1", a, b) == 0
            yield pa.RecordBatch.from_arrays([pa.array(self.numbers("doc_ids", "<i8", a, b), pa.int64(), mask=named), pa.array(base + own[:-1], pa.int64()), ids], names=["doc_id", "start", "ids"])
            a = b


@dataclass
class Files(WriterCommitMessage):
    part: int
    files: list[tuple[str, int, int, int]]


class TokenWriter(DataSourceArrowWriter):
    """Writes rows (doc_id, ids as binary) or, given a tokenizer file, (doc_id, text); ``end_id`` ends each text."""

    def __init__(self, options: dict):
        self.folder, self.bits, self.file_ids = options["path"], int(options.get("bits", 8)), int(options.get("file_ids", 1 << 22))
        self.tokenizer, self.end = options.get("tokenizer"), np.array([int(options.get("end_id", 2))], "<u4").tobytes()

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of all rows; texts become ids here, in the task that writes them."""
        of = word_ids(self.tokenizer).of if self.tokenizer else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                doc_ids, own = (batch.column(k).slice(at, 256).to_pylist() for k in (0, 1))
                yield from zip(doc_ids, (of(t) + self.end for t in own) if of else (x or b"" for x in own), strict=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, folder = file_system(self.folder)
        store.create_dir(folder, recursive=True)
        part, files = TaskContext.get().partitionId(), []
        doc_ids: list[int | None] = []
        each: list[bytes] = []
        room = 0

        def close() -> None:
            nonlocal doc_ids, each, room
            if doc_ids:
                name = f"{part:06d}-{len(files):06d}-{uuid4().hex}.dac"
                data = encoded(doc_ids, [len(x) // 4 for x in each], np.frombuffer(b"".join(each), "<u4"), self.bits)
                put(store, f"{folder}/{name}", data)
                files.append((name, len(doc_ids), room // 4, len(data)))
            doc_ids, each, room = [], [], 0

        for doc_id, ids in self.rows(iterator):
            doc_ids.append(doc_id)
            each.append(ids)
            room += len(ids)
            if room >= 4 * self.file_ids:
                close()
        close()
        return Files(part, files)

    def commit(self, messages: list[Files | None]) -> None:
        store, folder = file_system(self.folder)
        store.create_dir(folder, recursive=True)
        lines, start = [], 0
        for message in sorted((m for m in messages if m), key=lambda m: m.part):
            for name, n_docs, n_ids, size in message.files:
                lines.append(json.dumps({"file": name, "start": start, "n_docs": n_docs, "n_ids": n_ids, "bytes": size}))
                start += n_ids
        self.clear({json.loads(x)["file"] for x in lines})
        put(store, f"{folder}/{MANIFEST}", "\n".join(lines).encode())

    def abort(self, messages: list[Files | None]) -> None:
        self.clear(set())

    def clear(self, keep: set[str]) -> None:
        """Remove the files of attempts that don't count."""
        from pyarrow import fs

        store, folder = file_system(self.folder)
        for found in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if found.is_file and found.base_name not in keep:
                store.delete_file(found.path)


@dataclass
class Group(InputPartition):
    files: list[tuple[str, int]]


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.group_bytes, self.room = options["path"], int(options.get("group_bytes", 1 << 25)), int(options.get("room", 1 << 20))

    def partitions(self) -> list[Group]:
        groups, left = [], 0
        for entry in manifest(self.folder):
            if left <= 0:
                groups.append(Group([]))
                left = self.group_bytes
            groups[-1].files.append((entry["file"], entry["start"]))
            left -= entry["bytes"]
        return groups or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        for name, start in partition.files:
            with TokenFile(f"{self.folder}/{name}") as file:
                yield from file.batches(start, self.room)


class TokenFiles(DataSource):
    """``format("token_files")``: writes (doc_id, ids or text) in the order of partitions, reads (doc_id, start, ids)."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options))


def manifest(folder: str) -> list[dict]:
    """Files of a folder in order: file, start, n_docs, n_ids, bytes."""
    store, own = file_system(folder)
    with store.open_input_stream(f"{own}/{MANIFEST}") as file:
        return [json.loads(line) for line in file.read().decode().splitlines()]


def write_ids(docs: DataFrame, folder: str, path: str = WORD_BPE, end_id: int = 2, **options) -> None:
    """Encode ``docs`` (doc_id, text) and write their ids to ``folder`` by ascending doc_id, null last.

    Texts are shuffled once, by ranges of doc_id; rows of one doc_id follow by
    a hash of their text and then as they lie, so a doc_id with a third of all
    rows is spread over ranges too.
    """
    place = [F.col("doc_id").asc_nulls_last(), "_tag", "_row"]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"), tag(docs).alias("_tag"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "text")
    docs.sparkSession.dataSource.register(TokenFiles)
    ordered.write.format("token_files").options(tokenizer=path, end_id=end_id, **options).mode("append").save(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) from the files of ``folder``."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(folder)


def tokens_at(places: DataFrame, folder: str) -> DataFrame:
    """(place, id) of each row of ``places`` (place: long, of all ids from 0), each id read by itself; id is null where there is none.

    Places are dealt by file and by stretches of 65,536 ids, each read from
    the file it lies in.
    """
    entries = [e for e in manifest(folder) if e["n_ids"]]
    starts, names = np.array([e["start"] for e in entries], "int64"), [e["file"] for e in entries]
    total = sum(e["n_ids"] for e in entries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, file = -1, None
        for batch in batches:
            out = []
            for place in batch.column("place").to_pylist():
                if place is None or not 0 <= place < total:
                    out.append(None)
                    continue
                own = int(np.searchsorted(starts, place, "right")) - 1
                if own != known:
                    known, file = own, TokenFile(f"{folder}/{names[own]}")
                out.append(int(file.ids(place - int(starts[own]), place - int(starts[own]) + 1)[0]))
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.int64())], names=["place", "id"])

    dealt = places.select(F.col("place").cast("long").alias("place")).repartition(F.floor(F.col("place") / 65_536)).sortWithinPartitions("place")
    return dealt.mapInArrow(run, "place long, id long")


def token_report(docs: DataFrame, path: str = WORD_BPE, end_id: int = 2, **options) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to files in the shared folder and tell what the files hold.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the
    end id) and ids_crc32, one row for each row of ``docs``. Null text is empty
    text: its end id alone. Null doc_ids come last; rows that repeat a doc_id
    follow each other, as do copies. A text may be of any length: it lies in
    one file, which may then be larger. An empty table writes a manifest
    without files and gives an empty result; further columns, of whatever
    names, are ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    write_ids(docs, folder, path, end_id, **options)
    return read_ids(spark, folder).select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
