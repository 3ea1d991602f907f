"""Session settings the library expects, and tables that cut lineage."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and skew handling; ``conf`` overrides (dots as underscores)."""
    builder = SparkSession.builder.appName("galena")
    builder = builder.master(master) if master else builder
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it names none, a session on one machine (``local[...]``) gets a
    temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or mkdtemp(prefix="galena-"))
    return sc.getCheckpointDir()


#: Folder of the tables of the innermost :func:`scratch`.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for tables that are ``written`` inside; it goes at the end.

    Write the result elsewhere before: what is read from such a table is gone
    with it.
    """
    from galena.sources.files import file_system

    folder = f"{shared_folder(spark)}/scratch-{uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        store, own = file_system(folder)
        if store.get_file_info(own).type.name == "Directory":
            store.delete_dir(own)


def scratch_folder(spark: SparkSession) -> str:
    """The folder of the innermost :func:`scratch`, else the shared one."""
    return _scratch.get() or shared_folder(spark)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and its size is known to the planner."""
    path = f"{scratch_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
