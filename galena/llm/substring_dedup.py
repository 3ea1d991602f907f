"""Substring deduplication by seed and extend.

Anchors: the k-gram hashes of a text are winnowed (smallest of every window,
rightmost ties), so every run of ``length`` words has one anchor, the same one
wherever the run occurs. An anchor's reach is all runs that chose it.

Seed: anchors are joined on their gram. Occurrences whose whole reach agrees
are one context; where there are several of a context, all its runs repeat.

Extend: one occurrence of each different context of a gram goes on. Each is
matched with the gram's first context and extended both ways, word by word;
a match of ``length`` words or more is a repeat of both. A run that goes
beyond that match differs from the first context, so another occurrence of it
goes beyond its own match too: such runs are named by a 128-bit hash of their
words and kept if the name comes up again. Repeats that overlap make up the
maximal repeats, and exactly their words are removed.

A gram with more than ``room`` occurrences (and a hundred thousandth of all,
found by counting what is frequent in any one partition) is salted, and its
contexts are counted over the salts afterwards; the first context of a gram is
copied to each salt of its others. Counts are combined before they are
shuffled. Anchors are written once and shuffled once, with 32 bytes each;
texts are shuffled once, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.common import batches_of, text_of, written
from galena.llm.rows import frequent

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BITS = 12  # of a span's length, and of what an anchor reaches to either side


class WordHashes(dict):
    """64-bit hash of a word (bytes), kept for up to ``room`` words."""

    def __init__(self, room: int = 500_000):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.hash, self.room = xxh64_intdigest, room

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word)
        if len(self) >= self.room:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class RunHashes:
    """Polynomial hashes (modulo 2**64, mixed) of any runs of ``hashes``."""

    def __init__(self, hashes: np.ndarray, base: int):
        power = np.full(len(hashes), base, np.uint64)
        power[:1] = 1
        self.back = np.full(len(hashes), pow(base, -1, 1 << 64), np.uint64)
        self.back[:1] = 1
        self.back = np.multiply.accumulate(self.back)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * np.multiply.accumulate(power))])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.total[end] - self.total[start]) * self.back[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x


def chosen(grams: np.ndarray, window: int) -> np.ndarray:
    """Of each window of ``grams`` the index of its smallest, the rightmost of equal ones."""
    value, at, size = grams, np.arange(len(grams)), 1
    while size < window:
        step = min(size, window - size)
        right = value[step:] <= value[:-step]
        value, at, size = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step]), size + step
    return at


def anchors(hashes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, context hash, place << 24 | words before << 12 | words from there on) of the anchors of a text."""
    n = len(hashes)
    if n < length:
        return (np.empty(0, np.int64),) * 3
    every = np.arange(n - k + 1)
    grams = RunHashes(hashes, BASES[0]).of(every, every + k)
    at = chosen(grams, length - k + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    end = np.r_[first[1:] - 1, n - length] + length  # where the last run of each reach ends
    at = at[first]
    before, after = at - first, end - at
    shape = (before << BITS | after).astype(np.uint64)
    context = RunHashes(hashes, BASES[1]).of(first, end) + shape * np.uint64(BASES[0])
    return grams[at].view(np.int64), context.view(np.int64), at << 2 * BITS | before << BITS | after


def _arrow(arrays: list, schema: str) -> pa.RecordBatch:
    """A batch of ``schema`` (names and types as Spark writes them) from Python or numpy values."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, types[t]) for a, (_, t) in zip(arrays, fields, strict=True)], names=[n for n, _ in fields])


def scan(texts: DataFrame, length: int, k: int) -> DataFrame:
    """id, tag, seed, context, at (arrays) of each row of ``texts`` (id, tag, text) that has anchors."""
    schema = "id long, tag long, seed array<long>, context array<long>, at array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordHashes().of
        for batch in batches:
            found = [anchors(of(t.encode().split()), length, k) for t in batch.column("text").to_pylist()]
            some = [i for i, x in enumerate(found) if len(x[0])]
            keep = batch.take(pa.array(some, pa.int64()))
            yield _arrow([keep.column("id"), keep.column("tag"), *([found[i][c] for i in some] for c in range(3))], schema)

    return batches_of(texts, run, schema)


def occurrences(scanned: DataFrame, room: int) -> DataFrame:
    """Anchors of grams that occur more than once: row, at, n (of their context, in their salt) and, for one of each different context, seed and context (else null)."""
    each = scanned.select("row", F.explode(F.arrays_zip("seed", "context", "at")).alias("a")).select("row", "a.seed", "a.context", "a.at")
    hot = frequent(scanned.select(F.col("seed").alias("key")), room).select(F.col("key").alias("seed"), F.ceil(2 * F.col("n") / room).cast("int").alias("parts"))
    each = each.join(F.broadcast(hot), "seed", "left")  # at most 200,000 rows
    each = each.select("seed", F.coalesce(F.pmod(F.xxhash64("row"), "parts"), F.lit(0)).cast("int").alias("salt"), "context", "row", "at", F.col("parts").isNotNull().alias("hot"))
    own, same = Window.partitionBy("seed", "salt"), Window.partitionBy("seed", "salt", "context")
    each = each.withColumn("m", F.count(F.lit(1)).over(same)).withColumn("first", F.row_number().over(same.orderBy("row", "at")) == 1).withColumn("all", F.count(F.lit(1)).over(own))
    goes_on = F.col("first") & (F.col("hot") | (F.col("m") < F.col("all")))
    return each.filter(goes_on | (F.col("m") > 1)).select("row", "at", "m", F.when(goes_on, F.col("seed")).alias("seed"), F.when(goes_on, F.col("context")).alias("context"))


def contexts(found: DataFrame, room: int) -> DataFrame:
    """The different contexts of ``found``: seed, context, m (occurrences), salts (it lies in), lead (row and at of its first), and of their gram c (contexts), first (the lead of its first context), parts (to deal them into)."""
    own = found.filter("seed is not null")
    same = own.groupBy("seed", "context", F.shiftright("context", 63).alias("half")).agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("salts"), F.min(F.struct("row", "at")).alias("lead")).drop("half")
    grams = same.groupBy("seed", F.shiftright("seed", 63).alias("half")).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct((F.col("m") == 1).alias("light"), "lead")).alias("first")).drop("half")
    return same.join(grams, "seed").select("seed", "context", "m", "salts", "lead", "c", F.col("first.lead").alias("first"), F.ceil(F.col("c") / room).cast("int").alias("parts"))


def compressed(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, id, tag, text) with the text as compressed bytes, which shuffle at half the size or less."""
    schema = "doc_id long, id long, tag long, text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        shrink = ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [shrink(t.encode()) for t in batch.column("text").to_pylist()]
            yield _arrow([*(batch.column(c) for c in ("doc_id", "id", "tag")), packed], schema)

    return batches_of(texts, run, schema)


def reaches(rows: DataFrame) -> DataFrame:
    """``rows`` (row, text compressed, places: array of seed, parts, leads, heavy, at) as one row a place, with its words, dealt to the salts."""
    schema = "seed long, salt int, other int, row long, at long, heavy boolean, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        grow = ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = grow(row["text"]).split()
                for p in row["places"]:
                    at = p["at"]
                    start = (at >> 2 * BITS) - (at >> BITS & ((1 << BITS) - 1))
                    reach = b" ".join(words[start : (at >> 2 * BITS) + (at & ((1 << BITS) - 1))])
                    salts = range(p["parts"]) if p["leads"] else (hash((row["row"], at)) % p["parts"],)
                    out += [(p["seed"], s, int(not p["leads"]), row["row"], at, p["heavy"], reach) for s in salts]
            yield _arrow(list(zip(*out, strict=True)) or [[]] * 7, schema)

    return batches_of(rows, run, schema, rows=250)


def matched(a: list[bytes], i: int, b: list[bytes], j: int) -> tuple[int, int]:
    """How many words ``a`` and ``b`` agree in before places i and j, and from there on."""
    left, right = 0, 0
    while left < i and left < j and a[i - left - 1] == b[j - left - 1]:
        left += 1
    while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
        right += 1
    return left, right


def extended(found: DataFrame, length: int) -> DataFrame:
    """Repeats (row, span) of what :func:`reaches` gives, and runs beyond them with a name: name_a, name_b, weight.

    A span is start << 12 | words. What repeats for certain has no name.
    """
    schema = "row long, span long, name_a long, name_b long, weight int"
    part = (1 << BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        group, lead, first, at_lead, light, told = None, [], 0, 0, False, set()
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                words, at = x["words"].split(), x["at"]
                before, start = at >> BITS & part, (at >> 2 * BITS) - (at >> BITS & part)
                if (x["seed"], x["salt"]) != group:  # its first context comes first
                    group, lead, first, at_lead, light, told = (x["seed"], x["salt"]), words, before, (x["row"], start), not x["heavy"], set()
                    continue
                left, right = matched(words, before, lead, first)
                lo, hi = before - left, before + right
                if hi - lo >= length:
                    if not x["heavy"]:
                        out.append((x["row"], start + lo << BITS | hi - lo, None, None, None))
                    span = at_lead[1] + first - left << BITS | hi - lo
                    if light and span not in told:
                        told.add(span)
                        out.append((at_lead[0], span, None, None, None))
                for s in range(len(words) - length + 1):
                    if s < lo or s + length > hi:
                        name = xxh3_128_intdigest(b" ".join(words[s : s + length]))
                        out.append((x["row"], start + s << BITS | length, (name >> 64) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63), 1 + x["heavy"]))
            yield _arrow(list(zip(*out, strict=True)) or [[]] * 5, schema)

    dealt = found.repartition("seed", "salt").sortWithinPartitions("seed", "salt", "other")
    return batches_of(dealt, run, schema, rows=2000)


def repeated_spans(docs: DataFrame, length: int = 35, k: int = 8, room: int = 4096) -> DataFrame:
    """``docs`` (doc_id, text, compressed) with spans: where repeated runs of at least ``length`` words lie (null: nowhere)."""
    no_id = F.col("doc_id").isNull()
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", F.length("text"), no_id).alias("tag"), "text")
    scanned = written(scan(texts.drop("doc_id"), length, k).withColumn("row", F.monotonically_increasing_id()))
    found = written(occurrences(scanned, room))

    part = (1 << BITS) - 1
    before, after = F.shiftright("at", BITS).bitwiseAND(F.lit(part)), F.col("at").bitwiseAND(F.lit(part))
    span = F.shiftleft(F.shiftright("at", 2 * BITS) - before, BITS).bitwiseOR(before + after).alias("span")
    ways = written(contexts(found, room // 4))
    again = found.filter("m > 1").select("row", span)
    # a context that only the salts of a frequent gram together repeat
    over = found.filter("seed is not null and m = 1").join(ways.filter("m > 1 and salts > 1").select("seed", "context"), ["seed", "context"]).select("row", span)

    places = ways.filter("c > 1").select(F.col("lead.row").alias("row"), F.struct("seed", "parts", (F.col("lead") == F.col("first")).alias("leads"), (F.col("m") > 1).alias("heavy"), F.col("lead.at").alias("at")).alias("place"))
    places = places.groupBy("row").agg(F.collect_list("place").alias("places"))
    ids = scanned.select("row", "id", "tag")
    dealt = compressed(texts).repartition("id", "tag")  # the one shuffle of texts, for extending and for cutting
    todo = dealt.select("id", "tag", "text").join(places.join(ids, "row").hint("shuffle_hash"), ["id", "tag"])
    far = extended(reaches(todo.select("row", "text", "places")), length)
    named = far.filter("name_a is not null")
    names = named.groupBy("name_a", "name_b", F.shiftright("name_a", 63).alias("half")).agg(F.sum("weight").alias("n")).filter("n > 1").select("name_a", "name_b")
    repeats = named.filter("weight = 1").join(names, ["name_a", "name_b"]).select("row", "span")
    spans = again.unionByName(over).unionByName(far.filter("name_a is null").select("row", "span")).unionByName(repeats)
    marks = spans.groupBy("row").agg(F.collect_set("span").alias("spans")).join(ids, "row").dropDuplicates(["id", "tag"])  # rows equal in both have the same
    return dealt.join(marks.select("id", "tag", "spans").hint("shuffle_hash"), ["id", "tag"], "left").select("doc_id", "text", "spans")


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal repeats (start, end) of spans: those that overlap are one, those that only touch are not."""
    out: list[tuple[int, int]] = []
    for x in sorted(spans or []):
        start, end = x >> BITS, (x >> BITS) + (x & ((1 << BITS) - 1))
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _each(rows: DataFrame, schema: str, result) -> DataFrame:
    """doc_id and what ``result`` makes of the words and the maximal repeats of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        grow = ZstdDecompressor().decompress
        for batch in batches:
            out = [(x["doc_id"], *result(grow(x["text"]).split(), merged(x["spans"]))) for x in batch.to_pylist()]
            yield _arrow(list(zip(*out, strict=True)) or [[]] * len(schema.split(", ")), schema)

    return batches_of(rows, run, schema)


def _kept(words: list[bytes], repeats: list[tuple[int, int]]) -> list[bytes]:
    at, out = 0, []
    for start, end in repeats:
        out += words[at:start]
        at = end
    return out + words[at:]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of().alias("text"))


def maximal_repeats(docs: DataFrame, length: int = 35, k: int = 8, **options) -> DataFrame:
    """Return doc_id, first, last: the words from ``first`` to before ``last`` (counted from 0) are a maximal stretch of overlapping repeated runs.

    One row per stretch; rows as in :func:`without_repeats`.
    """
    rows = repeated_spans(_texts(docs), length, k, **options)
    found = _each(rows, "doc_id long, ends array<long>", lambda words, repeats: ([x for r in repeats for x in r],))
    pairs = F.transform(F.sequence(F.lit(0), F.size("ends") - 2, F.lit(2)), lambda i: F.struct(F.get("ends", i).alias("first"), F.get("ends", i + 1).alias("last")))
    return found.filter(F.size("ends") > 0).select("doc_id", F.explode(pairs).alias("r")).select("doc_id", "r.first", "r.last")


def without_repeats(docs: DataFrame, length: int = 35, k: int = 8, **options) -> DataFrame:
    """Return doc_id and text, without the words in runs of ``length`` words that occur more than once.

    Words are what ASCII white space parts. A run counts as repeated if its
    words also start anywhere else, in the same or another row; every
    occurrence goes. Kept words are joined by one space. Null and empty texts
    give an empty text. Texts may be of any length. Rows with the same doc_id
    or a null one are rows like others; rows equal in both columns are repeats
    of each other. An empty table gives an empty result; further columns, of
    whatever names, are ignored. ``length`` is below 2048, ``k`` at most
    ``length``.
    """
    return _each(repeated_spans(_texts(docs), length, k, **options), "doc_id long, text string", lambda words, repeats: (b" ".join(_kept(words, repeats)).decode(),))


def repeat_report(docs: DataFrame, length: int = 35, k: int = 8, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 of what :func:`without_repeats` keeps."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def result(words: list[bytes], repeats: list[tuple[int, int]]) -> tuple:
        kept = _kept(words, repeats)
        return len(words), len(words) - len(kept), sha256(b" ".join(kept)).hexdigest()

    return _each(repeated_spans(_texts(docs), length, k, **options), schema, result)
