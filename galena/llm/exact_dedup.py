"""Exact deduplication by a tree merge of digest runs (DataFrame functions only).

Each input partition forms a sorted run of (digest, smallest row, row count).
Runs meet in binomial rounds: in every round ``2 ** bits`` neighbouring runs
merge into one, cut by digest so that no task holds a whole run. A digest that
a third of all rows share sends one row per run, and every level keeps the
smallest row of each digest. Equality is verified at every level: SHA-256,
code-point length and an independent 64-bit hash of the normalised text must
all agree.

Shuffled per level: about 80 bytes for each distinct text of each run; texts
themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import SPACE, checkpointed, text_of
from galena.llm.rows import keep_rows, tag

_EQUAL = ["digest", "chars", "check"]


def digest_runs(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``row`` (order of keeping), digest columns, ``run``."""
    normal = docs.select("doc_id", F.regexp_replace(text_of(), SPACE, " ").alias("normal"))
    return normal.select(
        "doc_id",
        # rows without an id come after all others; equal ids keep one row
        F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("tie")).alias("row"),
        F.unhex(F.sha2("normal", 256)).alias("digest"),
        F.length("normal").alias("chars"),
        F.xxhash64("normal").alias("check"),
        F.spark_partition_id().alias("run"),
    )


def tree_merge(runs: DataFrame, bits: int = 3) -> DataFrame:
    """Merge ``runs`` to one row per text: digest columns, ``keep`` and ``group_size``.

    The first round forms the runs: each task sorts and combines its own rows
    before they leave it. In the rounds after it a digest comes at most once
    from each run, so runs are exchanged as they are, sorted into one and
    merged in that order.
    """
    last = runs.agg(F.max("run")).first()[0] or 0
    merged, level = runs.select(F.col("run").alias("lane"), *_EQUAL, F.col("row").alias("keep"), F.lit(1).cast("long").alias("group_size")), 0
    while True:
        level += 1
        # 0 at last, but as a column: the join then deals both sides anew and can split hot digests
        merged = merged.withColumn("lane", F.shiftright("lane", bits))
        if level > 1:
            merged = merged.repartition("lane", *_EQUAL).sortWithinPartitions("lane", *_EQUAL)
        merged = merged.groupBy("lane", *_EQUAL).agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        if not last >> (bits * level):
            return merged.drop("lane")


def exact_dedup(docs: DataFrame, bits: int = 3) -> DataFrame:
    """Return one row per row of ``docs``, dropped ones too.

    Columns: doc_id, keep_id (doc_id of the row that stays), group_size, kept,
    text_sha256 (of the text with white space runs replaced by one space).

    Null text is empty text and equals it. A row with a null doc_id is kept
    only if no row of its text has an id (keep_id is null then). Of rows that
    repeat both doc_id and text exactly one is kept. Texts may be of any
    length. An empty table gives an empty result; further columns of ``docs``,
    of whatever names, are ignored.
    """
    runs = checkpointed(digest_runs(docs))
    groups = tree_merge(runs, bits)
    return runs.join(groups, _EQUAL).select(
        "doc_id",
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and texts unchanged.

    Null text is empty text; of rows that repeat doc_id and text one is kept,
    of other equal texts the smallest doc_id, a null one last. An empty table
    gives an empty result.
    """
    normal = docs.select("doc_id", tag(docs).alias("tag"), F.regexp_replace(text_of(), SPACE, " ").alias("normal"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "tag").alias("row")
    runs = checkpointed(normal.select(row, F.unhex(F.sha2("normal", 256)).alias("digest"), F.length("normal").alias("chars"), F.xxhash64("normal").alias("check"), F.spark_partition_id().alias("run")))
    keep = tree_merge(runs, bits).select(F.col("keep.id").alias("doc_id"), F.col("keep.tag").alias("tag"), F.col("group_size").alias("copies"))
    return keep_rows(docs, keep)
