"""Tensor files: rows of fixed stride in half or single precision, little-endian, read by byte ranges; and the manifests of models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from galena.sources.files import file_system

ROWS = "row long, vector array<float>"


def kind_of(options: dict) -> np.dtype:
    kind = {"f16": "<f2", "f32": "<f4"}.get(options.get("dtype", "f32"))
    if kind is None:
        raise ValueError(f"no such dtype: {options.get('dtype')}")
    return np.dtype(kind)


@dataclass
class Span(InputPartition):
    file: str
    first: int  # row of the table
    start: int  # row of the file
    rows: int


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dim, self.kind = options["path"], int(options["dim"]), kind_of(options)
        self.split = max(1, int(options.get("split_bytes", 1 << 25)) // (self.dim * self.kind.itemsize))

    def partitions(self) -> list[Span]:
        store, path = file_system(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else sorted((i for i in store.get_file_info(fs.FileSelector(path)) if i.is_file and i.base_name.startswith("part-")), key=lambda i: i.base_name)
        out, first, stride = [], 0, self.dim * self.kind.itemsize
        for i in files:
            if i.size % stride:
                raise ValueError(f"{i.path} has {i.size} bytes, no whole rows of {stride}")
            rows = i.size // stride
            out += [Span(i.path, first + a, a, min(self.split, rows - a)) for a in range(0, rows, self.split)]
            first += rows
        return out or [Span("", 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        stride, step = self.dim * self.kind.itemsize, max(1, (1 << 22) // (self.dim * 4))
        if not partition.rows:
            return
        with store.open_input_file(partition.file) as file:
            for at in range(0, partition.rows, step):
                n = min(step, partition.rows - at)
                values = np.frombuffer(file.read_at(n * stride, (partition.start + at) * stride), self.kind).astype("float32")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.dim + 1, self.dim, dtype="int32")), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first + at, partition.first + at + n)), lists], names=["row", "vector"])


@dataclass
class Part(WriterCommitMessage):
    file: str


class TensorWriter(DataSourceArrowWriter):
    """A file a task, in the order of tasks; the commit leaves those of attempts that count."""

    def __init__(self, options: dict):
        self.folder, self.dim, self.kind = options["path"], int(options["dim"]), kind_of(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        store, folder = file_system(self.folder)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                lists = batch.column(1)
                if lists.null_count or lists.flatten().null_count or len(lists.flatten()) != self.dim * len(lists):
                    raise ValueError(f"a vector is null, holds null or has not {self.dim} entries")
                out.write(lists.flatten().to_numpy(zero_copy_only=False).astype(self.kind).tobytes())
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        self.keep({m.file for m in messages if m})

    def abort(self, messages: list[Part | None]) -> None:
        self.keep(set())

    def keep(self, names: set[str]) -> None:
        store, folder = file_system(self.folder)
        for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if i.is_file and i.base_name.startswith("part-") and i.base_name not in names:
                store.delete_file(i.path)


class TensorRows(DataSource):
    """``format("tensor_rows")`` with ``dim`` and ``dtype`` (f16, f32): one flat file, or a folder of parts in order of name."""

    @classmethod
    def name(cls) -> str:
        return "tensor_rows"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> TensorReader:
        return TensorReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(dict(self.options))


def read_tensor(spark: SparkSession, path: str, dim: int, dtype: str = "f32", **options) -> DataFrame:
    """(row, vector) of a tensor file; tasks read ranges of ``split_bytes``."""
    spark.dataSource.register(TensorRows)
    return spark.read.format("tensor_rows").options(dim=dim, dtype=dtype, **options).load(path)


def write_tensor(rows: DataFrame, folder: str, dim: int, dtype: str = "f32") -> None:
    """Write ``rows`` (row, vector) by ascending row; rows count anew from 0 when they are read."""
    rows.sparkSession.dataSource.register(TensorRows)
    ordered = rows.select(F.col("row").cast("long").alias("row"), F.col("vector").cast("array<float>").alias("vector")).repartitionByRange("row").sortWithinPartitions("row")
    ordered.write.format("tensor_rows").options(dim=dim, dtype=dtype).mode("append").save(folder)


def gathered(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """``tokens`` (token_id, ...) with ``vector``, the row of ``table`` (row, vector) of that number.

    A token id without a row is an error, as the table must cover the
    vocabulary. Only rows that are asked for meet the tokens.
    """
    asked = table.join(tokens.select(F.col("token_id").alias("row")).distinct(), "row", "left_semi")
    both = tokens.join(asked, tokens["token_id"] == asked["row"], "left").drop(asked["row"])
    lost = F.raise_error(F.concat(F.lit("token id beyond the table: "), F.coalesce(F.col("token_id").cast("string"), F.lit("null"))))
    return both.withColumn("vector", F.when(F.col("vector").isNull(), lost.cast("array<float>")).otherwise(F.col("vector")))


# ---------------------------------------------------------------- manifests

MANIFEST = (
    "format string, schema_version double, family string, model_id string, model_revision string, embedding_dim double, "
    "text struct<onnx:string,tokenizer:string,context_length:double,input:struct<kind:string>,token_embedding:struct<file:string,dtype:string,embedding_dim:double>>, "
    "image struct<onnx:string,preprocess:struct<kind:string,image_size:int,crop:string,mean:array<double>,std:array<double>,patch_size:int,default_max_patches:int,vision_pos_embedding:string>>"
)


def required_files(m: Column) -> Column:
    """Files that a manifest (parsed with ``MANIFEST``) needs beside it; a name of its own stands for an entry that lacks one."""
    table, positions = m["text"]["token_embedding"]["file"], F.when(m["image"]["preprocess"]["kind"] == "fgclip_patch_tokens", m["image"]["preprocess"]["vision_pos_embedding"])
    base = F.array(F.lit("model_config.json"), m["text"]["onnx"], m["image"]["onnx"], m["text"]["tokenizer"])
    more = F.array(F.coalesce(F.nullif(table, F.lit("")), F.lit("text.token_embedding.file")), F.coalesce(F.nullif(positions, F.lit("")), F.lit("image.preprocess.vision_pos_embedding")))
    return F.when(m["family"] == "fg_clip", F.concat(base, more)).otherwise(base)


def manifest_check(m: Column) -> Column:
    """Struct valid, reason and missing (entries that the manifest lacks) of a manifest parsed with ``MANIFEST``.

    The reasons, in the order of the checks: format, dimensions, text input,
    image preprocessing, token embedding, embedding dimension, dtype, patches,
    family.
    """
    text, image, none = m["text"], m["image"]["preprocess"], F.array().cast("array<string>")
    table = text["token_embedding"]
    positive = lambda c: F.coalesce((c > 0) & ~F.isnan(c.cast("double")) & (c.cast("double") < float("inf")), F.lit(False))
    fits = lambda c: F.coalesce(c, F.lit(False))
    chinese, fg = fits(m["family"] == "chinese_clip"), fits(m["family"] == "fg_clip")
    reason = (
        F.when(~fits((m["format"] == "omni_flat_v1") & (m["schema_version"] == 1)), "format")
        .when(~(positive(m["embedding_dim"]) & positive(text["context_length"] - 2)), "dimensions")
        .when(chinese & ~fits(text["input"]["kind"] == "bert_like") | fg & ~fits(text["input"]["kind"] == "token_embeds"), "text input")
        .when(chinese & ~fits(image["kind"] == "clip_image") | fg & ~fits(image["kind"] == "fgclip_patch_tokens"), "image preprocessing")
        .when(fg & table.isNull(), "token embedding")
        .when(fg & ~fits(table["embedding_dim"] == m["embedding_dim"]), "embedding dimension")
        .when(fg & ~fits(table["dtype"].isin("f16", "f32")), "dtype")
        .when(fg & ~(positive(image["patch_size"]) & positive(image["default_max_patches"])), "patches")
        .when(~chinese & ~fg, "family")
    )
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"), F.when(fits(reason == "token embedding"), F.array(F.lit("text.token_embedding.file"))).otherwise(none).alias("missing"))


def missing_files(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, file) that ``manifests`` (folder, manifest) need and ``files`` (path) do not have.

    Rows are sorted by a hash first: paths below one root begin alike, and are
    slow to compare. Paths are packed too well for the planner to tell a
    table that could be broadcast.
    """
    wanted = manifests.select("folder", F.explode(required_files(F.col("manifest"))).alias("file")).filter("file IS NOT NULL").withColumn("_path", F.concat("folder", F.lit("/"), "file"))
    there = files.select("path").hint("merge")
    same = (F.xxhash64(wanted["_path"]) == F.xxhash64(there["path"])) & (wanted["_path"] == there["path"])
    return wanted.join(there, same, "left_anti").select("folder", "file").distinct()

