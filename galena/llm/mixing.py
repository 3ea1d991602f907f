"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall, by a seeded hash, into blocks of about
``block_words`` words (more in a source that would have over ``max_blocks``);
block order is then a random permutation of the source. A source's quota is
whole epochs over its blocks and a prefix of one more; the last block and
document of that prefix are cut to the word. A splitting tree deals the quotas
to output shards of about ``shard_words`` words: at a node the exact block
counts per source are split between the two halves of the node's shards by a
multivariate hypergeometric draw, so every shard is a uniform sample of the
mix, and shards draw disjoint ranges of the permuted blocks. What the mix
takes of a document is what its block was dealt. Rows are shuffled within
their shard only.

Driver and closures hold one row per source (bounded by ``max_sources``,
checked). Documents are dealt by (source, block), so a source with a third of
all rows is spread like any other. Texts are not shuffled to plan a mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.common import WORD, text_of, written

WEIGHTS = (5, 2, 1)
BROADCAST_SOURCES = 10_000  # about 1 MB
BROADCAST_BLOCKS = 200_000  # about 20 MB


def water_fill(sizes: list[int], weights: list[int], share: Fraction = Fraction(1), most: int = 3) -> list[Fraction]:
    """Targets by weight of ``share`` of all sizes; each stops at ``most`` times its size, the excess reshared."""
    targets, open_, rest = [Fraction(0)] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = rest / sum(weights[k] for k in open_)
        above = [k for k in open_ if weights[k] * unit > most * sizes[k]]
        for k in above or open_:
            targets[k] = Fraction(most * sizes[k]) if above else weights[k] * unit
        if not above:
            break
        rest -= sum(targets[k] for k in above)
        open_ -= set(above)
    return targets


def split_tree(quotas: np.ndarray, shards: int, seed: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (shard, first, count) for shards in [low, high): each source's draws there, as rank ranges.

    Only the path from the root and the subtrees that meet [low, high) are
    walked; a node's draw is seeded by its place, so all tasks agree.
    """
    high = shards if high is None else high
    todo = [(0, shards, np.zeros_like(quotas), quotas)]
    while todo:
        a, b, first, count = todo.pop()
        if b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, first, count
            continue
        mid = (a + b) // 2
        total = int(count.sum())
        rng = np.random.default_rng([seed, a, b])
        left = rng.multivariate_hypergeometric(count, total * (mid - a) // (b - a), method="marginals") if total else count
        todo += [(a, mid, first, left), (mid, b, first + left, count - left)]


class Mix:
    """A planned mix of ``docs`` (doc_id, text, source); see :func:`mix` and :func:`mixed_documents`."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, shard_words: int = 1 << 24, block_words: int = 1 << 17, max_blocks: int = 1 << 16, seed: int = 7, max_sources: int = 1_000_000):
        self.spark, self.seed = docs.sparkSession, seed
        self.rows = written(docs.select("doc_id", "source", *self.measures()))
        found = self.rows.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
        if len(found) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
        sizes = [r["size"] for r in found]
        self.shards = max(1, ceil(sum(sizes) / shard_words))
        targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(found))], most=most)
        self.plan = [
            {"rank": k, "source": r.source, "source_size": n, "target": float(t), "epochs": (e := int(t // n) if n else 0), "rest": round(t - e * n), "blocks": min(max_blocks, max(1, ceil(n / block_words)))}
            for k, (r, n, t) in enumerate(zip(found, sizes, targets, strict=True))
        ]
        self.blocks = written(self._deal())
        self.few_blocks = self.blocks.count() <= BROADCAST_BLOCKS

    def measures(self) -> list[Column]:
        return [F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(self.seed), "doc_id", "text").alias("key")]

    def planned(self, rows: DataFrame) -> DataFrame:
        """``rows`` (source, key, ...) with their source's plan and their block."""
        schema = "rank int, _source string, source_size long, target double, epochs int, rest long, blocks long"
        plan = self.spark.createDataFrame([tuple(p.values()) for p in self.plan], schema)
        plan = F.broadcast(plan) if len(self.plan) <= BROADCAST_SOURCES else plan
        joined = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).drop("_source")
        return joined.withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))

    def _deal(self) -> DataFrame:
        """Drawn blocks (rank, block, dealt, cut): dealt lists (epoch, shard) of each draw, cut the words of the last one, if not whole.

        A source's draws are numbered: all blocks in their permuted order, once
        an epoch, then those of the first ``rest`` words. The tree deals ranges
        of these numbers to shards.
        """
        blocks = self.planned(self.rows).groupBy("rank", "block", "epochs", "rest").agg(F.sum("size").alias("words"))
        own = Window.partitionBy("rank")  # of ``max_blocks`` rows at most
        order = own.orderBy(F.xxhash64(F.lit(self.seed), "block"), "block")
        before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        blocks = blocks.withColumns({"at": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(own), "before": before})
        drawn = written(blocks.withColumn("draws", F.col("epochs") + (F.col("before") < F.col("rest")).cast("int")))
        quotas = np.zeros(len(self.plan), np.int64)
        for r in drawn.groupBy("rank").agg(F.sum("draws").alias("q")).collect():
            quotas[r["rank"]] = r.q
        shards, seed = self.shards, self.seed
        parts = min(shards, 1024)

        def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for part in frame["id"]:
                    for shard, first, count in split_tree(quotas, shards, seed, part * shards // parts, (part + 1) * shards // parts):
                        at = np.flatnonzero(count)
                        yield pd.DataFrame({"rank": at.astype("int32"), "first": first[at], "last": first[at] + count[at] - 1, "shard": np.int32(shard)})

        tree = self.spark.range(parts).mapInPandas(ranges, "rank int, first long, last long, shard int")
        dealt = tree.select("rank", "shard", F.explode(F.sequence("first", "last")).alias("draw"))
        each = drawn.filter("draws > 0").select("rank", "block", "epochs", "words", (F.col("rest") - F.col("before")).alias("cut"), F.explode(F.sequence(F.lit(0), F.col("draws") - 1)).alias("epoch"), "at", "n")
        each = each.withColumn("draw", (F.col("epoch").cast("long") * F.col("n") + F.col("at")).cast("long"))
        last = (F.col("epoch") == F.col("epochs")) & (F.col("cut") < F.col("words"))
        return each.join(dealt, ["rank", "draw"]).groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("dealt"), F.max(F.when(last, F.col("cut"))).alias("cut"))

    def taken(self, rows: DataFrame) -> DataFrame:
        """``rows`` (source, size, key, doc_id, ...) with source_size, target, epochs, dealt, last (words of the cut draw; null: it has none) and taken.

        What a row's block was dealt decides: its size for each whole draw,
        and its part of the words of a cut one.
        """
        # only the rows of cut blocks, one block a source, need to meet
        blocks = F.broadcast(self.blocks) if self.few_blocks else self.blocks.hint("shuffle_hash")
        joined = self.planned(rows).join(blocks, ["rank", "block"], "left")
        joined = joined.withColumn("dealt", F.coalesce("dealt", F.array().cast("array<struct<epoch:int,shard:int>>")))
        whole = joined.filter(F.col("cut").isNull()).withColumn("last", F.lit(None).cast("long"))
        order = Window.partitionBy("rank", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        part = joined.filter(F.col("cut").isNotNull()).withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        part = part.withColumn("last", F.least(F.col("size"), F.greatest(F.col("cut") - F.col("_before"), F.lit(0)))).drop("_before")
        draws = F.size("dealt") - F.col("last").isNotNull().cast("int")
        return whole.unionByName(part).withColumn("taken", draws * F.col("size") + F.coalesce("last", F.lit(0)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Return per row of ``docs``: doc_id, size, source_size, target, taken and shards.

    size counts words (null text: 0). Sources by code point, null last, weigh
    ``weights`` in turn and share the sum of all sizes; a target stops at
    ``most`` times its source's size. taken is what the mix takes of the row's
    words, repeats counted: each source's sum is its target rounded to a word,
    and no row exceeds ``most`` times its size. shards lists the output shards
    of the row's block, one per draw, comma-joined.

    Rows that repeat doc_id and text share a block and are drawn in turn.
    Reruns agree whatever the partitioning; of rows equal in both columns it
    is open which one a cut falls on. Null doc_ids need no care; texts may be
    of any length. An empty table gives an empty result; further columns, of
    whatever names, are ignored.
    """
    plan = Mix(docs.select("doc_id", "text", "source"), **options)
    shards = F.array_join(F.transform("dealt", lambda d: d["shard"].cast("string")), ",")
    return plan.taken(plan.rows).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: a document repeats once per draw, dealt and shuffled by shard.

    Only whole documents: one that the last cut halves is drawn if at least
    half of it is taken. Documents without words are taken with their block.
    """
    plan = Mix(docs.select("doc_id", "text", "source"), **options)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"], docs["source"], *plan.measures())
    drawn = plan.taken(rows)
    half = F.col("last").isNull() | ((F.col("last") > 0) & (2 * F.col("last") >= F.col("size")))
    each = drawn.withColumn("draw", F.explode("dealt")).filter((F.col("draw.epoch") < F.col("epochs")) | half)
    order = F.xxhash64(F.lit(plan.seed), "key", "draw.epoch")
    out = each.select("doc", F.col("draw.shard").alias("shard"), order.alias("place")).repartition("shard").sortWithinPartitions("shard", "place")
    return out.select("doc.*")
