"""Near-duplicate removal: SimHash groups, and an exact join of five-word shingle sets, verified by Jaccard similarity.

Each text has a SimHash of its set of shingles. Fingerprints of at most
``distance`` differing bits meet in pigeonhole blocks (:mod:`galena.llm.simhash`)
and each group that such links connect names its middle. Those of the middles
that are not alike stay. Each text of a group is a pair with its middle, which Jaccard
similarity verifies: what is alike goes. That clears most copies, of
groups of any size. It finds no pair for certain, so what is left, the middles
that stay among it, is compared by an exact join:

Two sets of a similarity of at least ``similarity`` share a shingle among the
first n - ceil(similarity * n) + 1 of each, n being its size, in any one order
of all shingles. So documents that share none of these, their postings, are
never alike, and all others are compared: no pair is missed. Shingles that a
sample of the texts shows to be common come last in the order, the more common
the later; the sample bears on speed only.

A list that still has more than ``crowd`` documents would give too many pairs
where they are all copies of each other. So the most typical documents of such
lists are taken first, as the middles were. What is left gives pairs; lists of more than ``room`` documents are
salted into chunks, each pair of chunks being a group of its own. Verified
pairs make an edge table on which documents are chosen round by round, the one
with the most neighbours first. Every dropped document is alike to one that
stays, and no two that stay are alike, whatever the size of a group.

Texts with the same words collapse before anything else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.common import batches_of, text_of, written
from galena.llm.components import components
from galena.llm.rows import frequent, keep_rows, tag
from galena.llm.simhash import links, majority_bits

HOT = 50_000  # postings of a shingle that one task takes


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than a shingle are one."""
    from xxhash import xxh64_intdigest

    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(whole, 1)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    n = len(words) - shingle + 1
    return np.unique(np.fromiter((xxh64_intdigest(whole[a:b], 1) for a, b in zip((end - length)[:n].tolist(), end[shingle - 1 :].tolist(), strict=True)), np.uint64, n))


def common_shingles(docs: DataFrame, shingle: int, one_in: int = 8, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent shingles in a sample of the texts, sorted, and how often each comes up."""
    texts = docs.select(text_of().alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(_words(t), shingle).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["h"])

    counted = batches_of(texts, run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    rows = counted.orderBy(F.desc("n"), "h").limit(most).collect()
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    n, order = np.array([r.n for r in rows], np.int64), np.argsort(h)
    return h[order], n[order]


def marks(docs: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, tag, same_a and same_b (hash of the words), fp (SimHash), n (shingles) and first (those it is found by) of each row."""
    texts = docs.select("doc_id", tag(docs).alias("tag"), text_of().alias("text"))
    known, often = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            same, prints, sizes, first = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                whole = xxh3_128_intdigest(b" ".join(words))
                same.append((whole >> 64, whole & ((1 << 64) - 1)))
                own = shingles(words, shingle)
                late = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    late = np.where(known[at] == own, often[at], 0)
                n = len(own)
                prints.append(majority_bits(own))
                sizes.append(n)
                first.append(own[np.lexsort((own, late))[: n - math.ceil(similarity * n - 1e-9) + 1]].view(np.int64))
            pair = np.array(same, np.uint64).reshape(-1, 2)
            columns = [pa.array(np.ascontiguousarray(pair[:, k]).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *columns, pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "tag", "same_a", "same_b", "fp", "n", "first"])

    return batches_of(texts, run, "doc_id long, tag long, same_a long, same_b long, fp long, n int, first array<long>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """Columns of ``rows`` but text, and ``set``: the sorted distinct hashes of its word shingles."""
    keep = [c for c in rows.columns if c != "text"]
    schema = rows.select(*keep, F.array(F.lit(0).cast("long")).alias("set")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(_words(text), shingle).view(np.int64) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sets, pa.list_(pa.int64()))], names=[*keep, "set"])

    return batches_of(rows, run, schema)


def _named(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """``rows`` (doc_id, tag and one more column) of ``reps`` as (node, that column), one of each node."""
    value = next(c for c in rows.columns if c not in ("doc_id", "tag"))
    named = reps.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "node", (F.col("copies") > 1).alias("_many"))
    both = rows.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("tag").eqNullSafe(F.col("_tag")))
    again = both.filter("_many").groupBy("node").agg(F.first(value).alias(value))
    return both.filter(~F.col("_many")).select("node", value).unionByName(again)


def _lists(postings: DataFrame) -> DataFrame:
    """``postings`` (h, node, n, about) of lists of several documents, with c, how many.

    ``about`` is how long a list is that is too long for one task (else null);
    it is dealt by a salt, and that number stands for its length.
    """
    salt = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("about") / HOT)), F.lit(0)).alias("salt")
    own = postings.select("h", "node", "n", "about", salt).withColumn("c", F.coalesce("about", F.count(F.lit(1)).over(Window.partitionBy("h", "salt"))))
    return written(own.filter("c > 1").select("h", "node", "n", "c"))


def _like_in_size(similarity: float) -> Column:
    return F.least("n", "_n") >= similarity * F.greatest("n", "_n") - 1e-9


def _enough(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``shared`` (a, b, n, _n; a row for each shared posting) that may be alike.

    Of two documents the one whose postings end first in the order has all it
    shares up to there in both; beyond, it has what is no posting of its own.
    """
    rest = lambda c: F.ceil(similarity * F.col(c) - 1e-9) - 1
    counted = shared.groupBy("a", "b", "n", "_n").agg(F.count(F.lit(1)).alias("k"))
    most = F.col("k") + F.greatest(rest("n"), rest("_n"))
    return counted.filter(most * (1 + similarity) >= similarity * (F.col("n") + F.col("_n")) - 1e-6).select("a", "b")


def _pairs(lists: DataFrame, similarity: float, room: int) -> DataFrame:
    """Pairs (a, b), a < b, of documents that share lists and whose sizes and shared postings allow for the similarity."""
    parts = F.ceil(F.col("c") / room).cast("int")
    own = lists.select("h", "node", "n", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = own.select("h", "node", "n", F.col("own").alias("i"), other.alias("j"))
    right = own.select(F.col("h").alias("_h"), F.col("node").alias("_node"), F.col("n").alias("_n"), F.col("own").alias("_j"), other.alias("_i"))
    both = left.join(right, (F.col("h") == F.col("_h")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & (F.col("node") < F.col("_node")) & _like_in_size(similarity))
    return _enough(both.select(F.col("node").alias("a"), F.col("_node").alias("b"), "n", "_n"), similarity)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) that are alike."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    like = both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9
    return written(pairs.join(one, "a").join(two, "b").filter(like).select("a", "b"))


def independent(edges: DataFrame) -> DataFrame:
    """(node) that go, of the nodes of ``edges`` (a, b): all others are not alike, and each that goes is alike to one of them."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    degree = both.groupBy("u").agg((-F.count(F.lit(1))).alias("d"))
    ranked = both.join(degree, "u").select(F.struct("d", "u").alias("u"), "v").join(degree.select(F.col("u").alias("v"), "d"), "v")
    left = written(ranked.select("u", F.struct("d", F.col("v").alias("u")).alias("v")))
    gone = left.select(F.col("u.u").alias("node")).limit(0)
    while not left.isEmpty():
        first = left.groupBy("u").agg(F.min("v").alias("least")).filter("u < least").select(F.col("u").alias("k"))
        goes = written(left.join(first, F.col("u") == F.col("k")).select(F.col("v").alias("k")).distinct())
        gone = gone.unionByName(goes.select(F.col("k.u").alias("node")))
        # an edge of one that stays leads to one that goes, so these two joins take the edges of both
        left = written(left.join(goes, F.col("u") == F.col("k"), "left_anti").join(goes, F.col("v") == F.col("k"), "left_anti"))
    return gone


def _ties(reps: DataFrame, distance: int) -> DataFrame:
    """(a, b) of each group of ``reps`` (node, fp) that near SimHashes connect: a its middle, the one most are tied to, b each other one."""
    own = reps.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    near = written(links(own.select("fp"), distance, distance + 3))
    group = components(near).select(F.col("node").alias("fp"), "component")
    tied = near.groupBy(F.col("b").alias("fp")).agg(F.count(F.lit(1)).alias("k"))
    middle = group.join(tied, "fp").groupBy("component").agg(F.max_by("fp", F.struct("k", "fp")).alias("middle"))
    alone = own.filter("n > 1").join(group, "fp", "left_anti").select("fp", F.col("fp").alias("middle"))
    to = group.join(middle, "component").select("fp", "middle").unionByName(alone).join(own.select(F.col("fp").alias("middle"), F.col("node").alias("a")), "middle")
    return written(reps.select("fp", F.col("node").alias("b")).join(to.select("fp", "a"), "fp").filter("a <> b").select("a", "b"))


def _typical(lists: DataFrame, crowd: int) -> DataFrame:
    """(node): of each list of more than ``crowd`` the one that shares the most with others."""
    typical = lists.groupBy("node").agg((-F.sum("c") / F.max("n")).alias("s"))
    best = lists.filter(F.col("c") > crowd).join(typical, "node").groupBy("h").agg(F.min(F.struct("s", "node")).alias("best"))
    return best.select("best.node").distinct()


def _clear(pivots: DataFrame, lists: DataFrame, sets: DataFrame, similarity: float, room: int, ties: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node) that go for ``pivots`` (node), of which those not alike stay, and the lists without them and these.

    ``ties`` (a, b) of pivots to others are verified first; what goes by them meets no more lists.
    """
    pivots = written(pivots)
    alike = _verified(_pairs(lists.join(pivots, "node", "left_semi"), similarity, room), sets, similarity)
    stay = written(pivots.join(independent(alike), "node", "left_anti"))
    gone = None
    if ties is not None:
        gone = _verified(ties.join(stay.select(F.col("node").alias("a")), "a", "left_semi"), sets, similarity).select(F.col("b").alias("node"))
        lists = lists.join(gone, "node", "left_anti")
    own = lists.join(stay, "node", "left_semi").select(F.col("h").alias("_h"), F.col("node").alias("a"), F.col("n").alias("_n"))
    near = lists.join(own, (F.col("h") == F.col("_h")) & (F.col("node") != F.col("a")) & _like_in_size(similarity)).select("a", F.col("node").alias("b"), "n", "_n")
    goes = written(_verified(_enough(near, similarity), sets, similarity).select(F.col("b").alias("node")).distinct())
    rest = lists.join(goes.unionByName(stay), "node", "left_anti")
    return goes if gone is None else goes.unionByName(gone), _lists(rest.select("h", "node", "n", F.when(F.col("c") > HOT, F.col("c")).alias("about")))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 3, crowd: int = 32, room: int = 1000) -> DataFrame:
    """Return (doc_id, tag, copies) of the rows of ``docs`` that stay; see :mod:`galena.llm.rows`.

    Words are parted by ASCII white space, A-Z lowered. A text of fewer words
    than a shingle is one shingle. Null and empty texts are alike; texts may
    be of any length. Among equals the smallest doc_id stays, a null one last.
    An empty table gives an empty result; further columns, of whatever names,
    are ignored.
    """
    docs = docs.select("doc_id", "text")
    seen = written(marks(docs, shingle, similarity, common_shingles(docs, shingle)))
    rows = seen.groupBy("doc_id", "tag").agg(*(F.first(c).alias(c) for c in ("same_a", "same_b", "fp")), F.count(F.lit(1)).alias("copies"))
    same = rows.groupBy("same_a", "same_b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag", "copies", "fp")).alias("who")).select("who.*")
    order = [F.col("no_id"), F.col("doc_id"), F.col("tag")]
    reps = written(same.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "tag", "copies", "fp", F.monotonically_increasing_id().alias("node")))  # numbered in order

    first = _named(seen.select("doc_id", "tag", F.struct("n", "first").alias("first")), reps)
    hot = F.broadcast(frequent(seen.select(F.col("first").alias("key")), HOT).select(F.col("key").alias("h"), F.col("n").alias("about")))  # at most 200,000 rows
    lists = _lists(first.select("node", "first.n", F.explode("first.first").alias("h")).join(hot, "h", "left"))
    # of two alike either both are in a crowd, or what they share is in other lists alone
    few = _pairs(lists.filter(F.col("c") <= crowd), similarity, room)
    ties = _ties(reps, distance)
    both = F.explode(F.array("a", "b")).alias("node")
    shared = lists.filter(F.col("c") > crowd).select("node").unionByName(few.select(both)).unionByName(ties.select(both)).distinct()
    texts = docs.select("doc_id", tag(docs).alias("tag"), text_of().alias("text"))
    sets = written(shingle_sets(_named(texts, reps.join(shared, "node", "left_semi")), shingle))

    goes, lists = _clear(ties.select(F.col("a").alias("node")).distinct(), lists, sets, similarity, room, ties)
    gone = [goes]
    for _ in range(2):  # as often as it pays; the pairs of any list are taken below
        if lists.filter(F.col("c") > crowd).isEmpty():
            break
        goes, lists = _clear(_typical(lists, crowd), lists, sets, similarity, room)
        gone.append(goes)
    out = independent(_verified(_pairs(lists, similarity, room), sets, similarity))
    for x in gone:
        out = out.unionByName(x)
    return reps.join(out, "node", "left_anti").select("doc_id", "tag", "copies")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns unchanged."""
    return keep_rows(docs, near_duplicates(docs, **options))
