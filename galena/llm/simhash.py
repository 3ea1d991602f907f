"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into ``blocks`` blocks. Two fingerprints with
at most ``distance`` differing bits agree in ``blocks - distance`` blocks at
least, so they meet under the key of some such set of blocks. Texts are read
once and give one number each; all that follows works on distinct
fingerprints, so exact and near-exact copies cost one row.

Under a key the Hamming distance is verified, and all fingerprints that reach
each other there over links are tied to the one in their middle: the same
components, never all pairs of a group, and mostly the same ties under all
keys of a group. A key with more than ``chunk`` fingerprints is salted into
chunks, each pair of chunks being a group of its own, so no task holds more
than ``2 * chunk`` rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.common import batches_of, checkpointed, written
from galena.llm.components import components


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of ``text``, A-Z lowered, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(whole, seed)], np.uint64)
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        start = end - length
        n = len(words) - shingle + 1
        hashes = np.fromiter((xxh64_intdigest(whole[a:b], seed) for a, b in zip(start[:n].tolist(), end[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    return majority_bits(hashes)


def majority_bits(hashes: np.ndarray) -> int:
    """The number whose bits are those that over half of ``hashes`` have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounds the unpacked bits of a long text
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """Columns of ``docs`` but text, and ``fp`` (the fingerprint as a signed long)."""
    keep = [c for c in docs.columns if c != "text"]
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    return batches_of(docs, run, schema)


def block_keys(distance: int, blocks: int) -> Column:
    """Array of keys of column ``fp``: each set of blocks with the bits in them."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).cast("short").alias("set"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def roots(fp: np.ndarray, distance: int) -> np.ndarray:
    """Of each of ``fp`` the smallest index reachable over links of at most ``distance`` bits."""
    root, rest, todo, top = np.zeros(len(fp), np.int64), np.arange(1, len(fp)), [0], 0
    while len(rest):
        if not todo:
            top, todo, rest = int(rest[0]), [int(rest[0])], rest[1:]
            root[top] = top
            continue
        near = np.bitwise_count(fp[rest] ^ fp[todo.pop()]) <= distance
        root[rest[near]] = top
        todo += rest[near].tolist()
        rest = rest[~near]
    return root


def middles(fp: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of each of ``fp`` the index of its group's middle: the member nearest to the group's bitwise majority, the first of equals."""
    order = np.argsort(root, kind="stable")
    _, first, group, size = np.unique(root[order], return_index=True, return_inverse=True, return_counts=True)
    bits = np.unpackbits(fp[order].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > size[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)
    off = np.bitwise_count(fp[order] ^ majority[group])
    out = np.empty_like(root)
    out[order] = order[np.lexsort((order, off, group))[first]][group]
    return out


def links(distinct: DataFrame, distance: int = 4, blocks: int = 7, chunk: int = 2048) -> DataFrame:
    """Ties (a, b) between the ``fp`` of ``distinct`` that connect what verified links connect, and nothing else."""
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes now, many rows when exploded: not to be coalesced
    keyed = distinct.repartition(spread, "fp").select("fp", F.explode(block_keys(distance, blocks)).alias("k")).select("fp", "k.set", "k.bits")
    many = keyed.groupBy("set", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(many.hint("merge"), ["set", "bits"])  # the planner takes exploded keys for few and would broadcast them: the driver is not to hold them
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = shared.select("fp", "set", "bits", parts.alias("parts"), own.alias("own")).select("fp", "set", "bits", F.explode(F.when(F.col("parts") == 1, alone).otherwise(pairs)).alias("p"))
    group = ["set", "bits", "i", "j"]
    sorted_ = dealt.select("set", "bits", "p.i", "p.j", "fp").repartition(*group).sortWithinPartitions(*group, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, 5), np.int64)

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            fp = rows[:, 4].view(np.uint64) if rows.flags.c_contiguous else np.ascontiguousarray(rows[:, 4]).view(np.uint64)
            fp = np.ascontiguousarray(fp)
            starts = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            sizes = np.diff(np.r_[starts, len(rows)])
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            a, b = [near], [near + 1]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                root = middles(fp[s : s + n], roots(fp[s : s + n], distance))
                away = np.flatnonzero(root != np.arange(n))
                a.append(away + s)
                b.append(root[away] + s)
            signed = fp.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[np.concatenate(x)]) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns])
            rows = np.concatenate([kept, rows])
            if not len(rows):
                continue
            last = len(rows) - 1
            new = np.flatnonzero((rows[:, :4] != rows[last, :4]).any(axis=1))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last group may go on
            kept = rows[cut:]
            if cut:
                yield solve(np.ascontiguousarray(rows[:cut]))
        if len(kept):
            yield solve(np.ascontiguousarray(kept))

    return batches_of(sorted_, run, "a long, b long", rows=20_000).distinct()


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """Return doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``distance`` differing bits, the row's own included. Null and empty texts
    have fingerprint zero and link like any other. Texts shorter than a
    shingle count as one shingle. Rows that repeat a doc_id are each returned.
    A row with a null doc_id links and is returned, but names no component;
    component_id is null if nothing reachable has an id. Texts may be of any
    length. An empty table gives an empty result; further columns, of whatever
    names, are ignored.
    """
    marked = checkpointed(fingerprints(docs.select("doc_id", "text"), shingle))
    # a table, so that dealing it anew for the keys is not taken for done already
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    reach = components(links(nodes.select("fp"), distance, blocks)).select(F.col("node").alias("fp"), "component")
    root = nodes.join(reach, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    root = checkpointed(root)
    least = root.groupBy("component").agg(F.min("first").alias("component_id"))
    named = root.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
