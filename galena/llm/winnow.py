"""Document fingerprints by winnowing, in DataFrame functions only.

Words are split at ASCII white space. Every run of ``k`` words has a rolling
hash of the hashes of its words; of every ``window`` consecutive hashes the smallest is kept, the rightmost of
equal ones. What is kept is (hash, position): two texts that share
``k + window - 1`` words in a row share a hash at the matching positions.

A kept entry is one long: the upper 40 bits are the hash, the lower 24 the
complement of its position, so the minimum of longs is the smallest hash with
rightmost ties. (Positions count modulo 2**24; across that border, 16.7
million words in, equal hashes tie to the left.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.common import SPACE, text_of

POSITION = (1 << 24) - 1


def words_of(text: Column) -> Column:
    """Words of a text; an empty array if it has none."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def rotated(h: Column, n: int) -> Column:
    """A long turned left by ``n`` bits."""
    n %= 64
    return F.shiftleft(h, n).bitwiseOR(F.shiftrightunsigned(h, 64 - n)) if n else h


def rolled(df: DataFrame, hashes: str, to: str, k: int) -> DataFrame:
    """``df`` with ``to``: the cyclic polynomial hash of every run of ``k`` of ``hashes``, null past the last whole run.

    The hash of a run is that of its first part turned by the length of the
    second, combined with that of the second: so a run is rolled up from
    hashes of shorter ones, in at most two steps for each doubling, and each
    word is hashed once.
    """
    df = df.withColumn(to, F.col(hashes))
    length = 1
    for bit in bin(k)[3:]:
        # one projection a step, so that no step is worked out again for each element of the next
        df = df.withColumn(to, F.transform(to, lambda h, i: rotated(h, length).bitwiseXOR(F.get(to, i + length))))
        length *= 2
        if bit == "1":
            df = df.withColumn(to, F.transform(to, lambda h, i: rotated(h, 1).bitwiseXOR(F.get(hashes, i + length))))
            length += 1
    return df


def gram_hashes(words: Column, rolls: Column, k: int) -> Column:
    """Packed (hash, position) of every run of ``k`` words from their rolled hashes; of the one run there is if words are fewer."""

    def packed(h: Column, i: Column) -> Column:
        return F.xxhash64(h).bitwiseAND(F.lit(~POSITION)).bitwiseOR(F.lit(POSITION) - i % (POSITION + 1))

    short = F.array(F.aggregate(words, F.lit(0).cast("long"), lambda h, x: rotated(h, 1).bitwiseXOR(x)))
    whole = F.slice(rolls, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(F.when(F.size(words) >= k, whole).when(F.size(words) > 0, short).otherwise(F.array().cast("array<bigint>")), packed)


def least_ahead(values: Column, ahead: list[int]) -> Column:
    """Of each element, the least of it and those ``ahead`` of it that exist."""
    return F.transform(values, lambda x, i: F.least(x, *(F.get(values, i + j) for j in ahead)))


def window_minima(grams: Column, fours: Column, window: int) -> Column:
    """Distinct minima of all whole windows (of all grams, if fewer)."""
    starts = F.greatest(F.size(grams) - (window - 1), F.least(F.size(grams), F.lit(1)))
    steps = [*range(4, window - 3, 4), *([window - 4] if window % 4 else [])]
    return F.array_distinct(F.slice(least_ahead(fours, steps), F.lit(1), starts))


def winnow(df: DataFrame, text: str, to: str, k: int, window: int) -> DataFrame:
    """``df`` with ``to``, the packed fingerprint array of column ``text``. ``window`` is 8 at least."""
    return (
        rolled(df.withColumn(f"{to}_words", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))), f"{to}_words", f"{to}_rolls", k)
        .withColumn(f"{to}_grams", gram_hashes(F.col(f"{to}_words"), F.col(f"{to}_rolls"), k))
        .withColumn(f"{to}_fours", least_ahead(F.col(f"{to}_grams"), [1, 2, 3]))
        .withColumn(to, window_minima(F.col(f"{to}_grams"), F.col(f"{to}_fours"), window))
        .drop(f"{to}_words", f"{to}_rolls", f"{to}_grams", f"{to}_fours")
    )


def hashes(kept: Column) -> Column:
    """The distinct hashes of a packed fingerprint."""
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 24)))


def positions(kept: Column) -> Column:
    """Array of (hash, position) of a packed fingerprint, positions from 0 in words."""
    return F.transform(kept, lambda x: F.struct(F.shiftright(x, 24).alias("hash"), (F.lit(POSITION) - x.bitwiseAND(F.lit(POSITION))).alias("position")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash arrays; 1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def printed(kept: Column) -> Column:
    """A fingerprint as text: hexadecimal ``hash:position`` entries, the packed longs, comma-joined."""
    return F.array_join(F.transform(kept, lambda x: F.lower(F.hex(x))), ",")


def fingerprints(docs: DataFrame, k: int = 5, window: int = 16) -> DataFrame:
    """Return doc_id and fingerprint: array of (hash, position) of each row of ``docs``.

    Null and empty texts have an empty fingerprint; texts of fewer than ``k``
    words have the hash of all their words. Equal texts have equal
    fingerprints. Further columns are ignored.
    """
    made = winnow(docs.select("doc_id", text_of().alias("text")), "text", "kept", k, window)
    return made.select("doc_id", positions(F.col("kept")).alias("fingerprint"))


class Bounds:
    """Sorted lower bounds of ranges; finds a key's range in two steps of about the square root of their number."""

    def __init__(self, lower: list[int]):
        self.lower = sorted(lower) or [0]
        self.step = int(len(self.lower) ** 0.5) + 1
        self.groups = [self.lower[i : i + self.step] for i in range(0, len(self.lower), self.step)]

    def _within(self, key: Column) -> tuple[Column, Column]:
        at = F.size(F.filter(F.lit([g[0] for g in self.groups]).cast("array<bigint>"), lambda b: b <= key))
        text = F.split(F.lit(";".join(",".join(map(str, g)) for g in self.groups)), ";")
        return at, F.split(F.element_at(text, F.greatest(at, F.lit(1))), ",").cast("array<bigint>")

    def place(self, key: Column) -> Column:
        at, own = self._within(key)
        return F.greatest((at - 1) * self.step + F.size(F.filter(own, lambda b: b <= key)) - 1, F.lit(0))

    def has(self, key: Column) -> Column:
        return F.array_contains(self._within(key)[1], key)


def in_order(docs: DataFrame, range_bytes: int) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ranges of about ``range_bytes`` of text: columns bucket, guest, key, doc_id, text.

    The order is by doc_id, rows without one first, by a hash of their text
    (``key``), then by text. Each range also has the first rows of the range
    after it as guests (those of the first range are guests of the last), so
    the next row of any row is in its own range. Bounds come from approximate
    quantiles of four times as many small ranges, joined up by the bytes they
    hold: that many numbers reach the driver. A range holds at least all rows
    of one key.
    """
    null, key = F.col("doc_id").isNull(), F.coalesce("doc_id", F.xxhash64("text"))
    docs = docs.withColumn("key", key)
    bytes_ = F.sum(F.octet_length("text").cast("long") + 64)
    whole = docs.groupBy(null.alias("no_id")).agg(bytes_.alias("b"), F.min("key").alias("least")).collect()
    small = {r.no_id: 4 * -(-r.b // range_bytes) for r in whole}
    cuts = docs.agg(*(F.percentile_approx(F.when(null == F.lit(k), F.col("key")), [i / n for i in range(n)], 10 * n).alias(str(k)) for k, n in sorted(small.items()))).first() if whole else {}
    fine = {r.no_id: Bounds(list({r.least, *(cuts[str(r.no_id)] or [])})) for r in whole}

    def bucket(bounds: dict[bool, Bounds], f) -> Column:
        return F.when(null, f(bounds[True]) if True in bounds else F.lit(None)).otherwise(f(bounds[False]) if False in bounds else F.lit(None))

    if not whole:
        return docs.select(F.lit(0).alias("bucket"), F.lit(False).alias("guest"), "key", "doc_id", "text")
    # quantiles are numbers near to keys; bounds are the least keys that there are
    held = docs.groupBy(null.alias("no_id"), bucket(fine, lambda x: x.place(F.col("key"))).alias("at")).agg(bytes_.alias("b"), F.min("key").alias("least")).collect()
    bounds = {}
    for k in fine:
        chosen, room = [], 0
        for r in sorted((r for r in held if r.no_id == k), key=lambda r: r.least):
            if not chosen or room + r.b > range_bytes:
                chosen, room = [*chosen, r.least], 0
            room += r.b
        bounds[k] = Bounds(chosen)
    nulls = len(bounds[True].lower) if True in bounds else 0
    total = nulls + (len(bounds[False].lower) if False in bounds else 0)
    place = bucket(bounds, lambda x: x.place(F.col("key"))) + F.when(null, F.lit(0)).otherwise(F.lit(nulls))
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    host = F.struct(F.pmod(F.col("bucket") - 1, F.lit(total)).alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(bucket(bounds, lambda x: x.has(F.col("key"))), F.array(own, host)).otherwise(F.array(own))
    return docs.withColumn("bucket", place).withColumn("place", F.explode(places)).select("place.bucket", "place.guest", "key", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, k: int = 5, window: int = 16, range_bytes: int = 1 << 24) -> DataFrame:
    """Fingerprint every text, and its edited text, and compare both with it.

    The edited text has its last ``n_chars // 4`` code points replaced by the
    first as many of the next row's text (all of it, if shorter), rows being
    ordered by doc_id (nulls first, by a hash of their text), then by text, and
    the last followed by the first. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Null text is empty; two empty fingerprints are alike (1.0), an empty and
    another one are not (0.0). Of rows that repeat a doc_id each is returned
    and counts as a row of its own. A single row is its own next row. An empty
    table gives an empty result; texts may be of any length; further columns,
    of whatever names, are ignored.

    Each row and its kept hashes are shuffled once, to ranges of doc_id of
    about ``range_bytes`` of text.
    """
    rows = winnow(in_order(docs.select("doc_id", text_of().alias("text")), range_bytes), "text", "kept", k, window)
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "key", "text")
    pairs = rows.withColumn("next", F.lead(F.struct("text", "kept")).over(order)).filter("not guest")
    n = F.length("text").cast("long")
    edited = pairs.select("doc_id", "kept", F.col("next.kept").alias("next_kept"), n.alias("n_chars"), F.col("text").alias("own"), F.col("next.text").alias("next_text"))
    q = F.floor(F.col("n_chars") / 4).cast("int")
    edited = edited.withColumn("edited", F.concat(F.substring("own", F.lit(1), F.col("n_chars").cast("int") - q), F.substring("next_text", F.lit(1), q))).drop("own", "next_text")
    both = winnow(edited, "edited", "edited_kept", k, window)
    both = both.select("doc_id", "n_chars", "edited", "kept", "edited_kept", hashes(F.col("kept")).alias("h"), hashes(F.col("edited_kept")).alias("eh"), hashes(F.col("next_kept")).alias("nh"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("kept")).alias("fingerprint"),
        printed(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("eh")).alias("near_edited"),
        likeness(F.col("h"), F.col("nh")).alias("near_next"),
    )
