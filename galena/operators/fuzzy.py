"""Fuzzy name search: tiers of match as Column expressions, and search by pinyin."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.scalars import name_stem

EXACT, EQUAL, PREFIX, WORD, CONTAINS, ACRONYM, IN_ORDER, PINYIN = 7, 6, 5, 4, 3, 2, 1, 0


@cache
def _accents() -> tuple[str, str]:
    """Latin letters with marks, and those without them, from their canonical decomposition."""
    pairs = [(c, d[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := normalize("NFD", c)) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Without the marks of Latin letters, composed or combining."""
    return F.regexp_replace(F.translate(text, *_accents()), "[\\u0300-\\u036F]", "")


def _bare(query: str) -> str:
    return "".join(c for c in normalize("NFD", query.strip()) if not "\u0300" <= c <= "\u036f")


def in_order(query: str) -> str:
    return "(?s)" + ".*?".join(map(re.escape, query))


def tier(name: Column, query: str) -> Column:
    """How well ``name`` matches, 7 (equal in case too) to 1 (letters in order); null if it does not. Accents count for nothing."""
    raw = _bare(query)
    q, own = raw.lower(), folded(name)
    n = F.lower(own)
    initials = F.array_join(F.transform(F.filter(F.split(n, r"[ \-]"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")
    out = F.when(own == raw, EXACT).when(n == q, EQUAL).when(n.startswith(q), PREFIX).when(n.contains(" " + q), WORD).when(n.contains(q), CONTAINS)
    return out if len(q) == 1 else out.when(initials.contains(q), ACRONYM).when(n.rlike(in_order(q)), IN_ORDER)


def spread(name: Column, query: str) -> Column:
    """Length of the first stretch that has the query's letters in order; shorter is closer."""
    return F.length(F.regexp_extract(F.lower(folded(name)), in_order(_bare(query).lower()), 0))


#: The first character of each initial letter in the GB 2312 order of sounds, from a to z; none begins with i, u or v.
FIRST_OF_INITIAL = dict(zip("abcdefghjklmnopqrstwxyz", "啊芭擦搭蛾发噶哈击喀垃妈拿哦啪期然撒塌挖昔压匝", strict=True))


@cache
def initial_sounds() -> dict[str, list[str]]:
    """The initial letter of each of the 3,755 common characters, which GB 2312 lists in the order of their sounds.

    Enough for searches by initials; a table of whole sounds is a parameter.
    """
    codes = {c.encode("gb2312"): letter for letter, c in FIRST_OF_INITIAL.items()}
    out, letter = {}, ""
    for row in range(0xB0, 0xD8):
        for cell in range(0xA1, 0xFF if row < 0xD7 else 0xFA):
            code = bytes((row, cell))
            letter = codes.get(code, letter)
            out[code.decode("gb2312")] = [letter]
    return out


def best_pinyin(name: str, query: str, sounds: dict[str, list[str]]) -> tuple[int, int, int] | None:
    """(start, span, end) of the best match of ``query`` by full or initial sounds of the characters, the last sound perhaps unfinished.

    From the last character to the first, ends[k] is the least end of a match
    of query[k:] that begins there: time is that of name, query and sounds.
    """
    n, best = len(query), None
    ends: list[int | None] = [None] * n + [-1]  # past the name only nothing matches
    for at in range(len(name) - 1, -1, -1):
        own: list[int | None] = [None] * n
        begin: int | None = None
        for sound in sounds.get(name[at], [name[at].lower()]):
            for k in range(n):
                for cut in {sound, sound[:1]}:
                    if cut and query.startswith(cut, k):
                        rest = k + len(cut)
                        end = at if rest == n else ends[rest]
                        if end is not None:
                            own[k] = end if own[k] is None else min(own[k], end)
                            if k == 0:
                                begin = end if begin is None else min(begin, end)
                if n - k < len(sound) and sound.startswith(query[k:]):
                    own[k] = at  # the least end there is
        if begin is not None:
            best = at, begin - at, begin
        ends = [*own, -1]
    return best


def with_tiers(rows: DataFrame, query: str, *keys: Column, sounds: dict[str, list[str]] | None = None) -> DataFrame:
    """``rows`` that match in one of ``keys``, with tier, spread, key (the text that ranked best) and, for letters-only queries, pinyin matches last.

    A key is a column of text or of an array of texts; nulls are left out. Of
    keys that rank alike the first counts.
    """
    q = query.strip()
    values = [k if rows.select(k.alias("k")).schema["k"].dataType.typeName() == "array" else F.array(k) for k in keys]
    texts = F.filter(F.concat(*(F.coalesce(v, F.array().cast("array<string>")) for v in values)), lambda x: x.isNotNull())
    # smallest first: the tier downwards, spread among letters in order, place of the key
    ranked = F.transform(texts, lambda x, i: F.struct((-tier(x, q)).alias("t"), F.when(tier(x, q) == IN_ORDER, spread(x, q)).alias("s"), i.alias("i"), x.alias("key")))
    best = F.array_min(F.filter(ranked, lambda r: r["t"].isNotNull()))
    out = rows.withColumn("_texts", texts).withColumn("_best", best)
    out = out.withColumn("tier", -F.col("_best.t")).withColumn("spread", F.col("_best.s")).withColumn("key", F.col("_best.key")).drop("_best")
    if not (sounds and re.fullmatch("[a-zA-Z]+", q)):
        return out.drop("_texts").filter("tier is not null").withColumn("pinyin", F.lit(None).cast("array<int>"))

    @F.pandas_udf("array<int>")
    def pinyin(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for n in names:
            found = n.map(lambda own: min((m for x in own if not x.isascii() and (m := best_pinyin(x, q.lower(), sounds))), default=None) if own is not None else None)
            yield found.map(lambda m: None if m is None else list(m))

    hits = out.withColumn("pinyin", F.when(F.col("tier").isNull(), pinyin("_texts"))).drop("_texts")
    return hits.filter("tier is not null or pinyin is not null").withColumn("tier", F.coalesce("tier", F.lit(PINYIN)))


def fuzzy_order(*before: Column) -> list[Column]:
    """Best first: tier, spread, the matched text in dictionary order, then the order ``before`` the search; else the id."""
    return [F.col("tier").desc(), F.col("pinyin").asc(), F.col("spread").asc(), F.collate(F.when(F.col("tier") > PINYIN, F.col("key")), "UNICODE").asc(), *(before or [F.col("id").asc()])]


def fuzzy_files(files: DataFrame, query: str, sounds: dict[str, list[str]] | None = None) -> DataFrame:
    """Files whose name stem matches; order by :func:`fuzzy_order`."""
    return with_tiers(files, query, name_stem(F.col("name")), sounds=sounds)


def suggest_tags(tags: DataFrame, file_tags: DataFrame, file_id: int, text: str) -> DataFrame:
    """Tags not yet on a file whose name contains ``text``, best first; a row without id offers to create it."""
    q = text.strip().lower()
    own = file_tags.filter(F.col("file_id") == file_id).select(F.col("tag_id").alias("id"))
    at = F.instr(F.lower("name"), q)
    score = F.when(F.lower("name") == q, 0).when(at == 1, 1).otherwise(at + 1)
    hits = tags.join(own, "id", "left_anti").filter(at > 0).select("id", "name", score.alias("score"))
    if q and tags.filter(F.lower(F.trim("name")) == q).isEmpty():
        new = tags.sparkSession.createDataFrame([(None, text.strip(), 1_000_000)], "id long, name string, score int")
        hits = hits.unionByName(new)
    return hits.orderBy("score", "name")


def matches(query: str) -> Callable[[Column], Column]:
    return lambda name: tier(name, query).isNotNull()
