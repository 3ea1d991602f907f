"""Secret scans behind a trigram inverted index (DataFrame functions only).

Each rule's regex gives a Boolean query over trigrams: an OR of ANDs of the
trigrams that every match must contain. The index posts, for the trigrams of
the rules, the documents whose lower-cased text has them; a rule's candidates
are the intersection of the postings of one of its ANDs. Only candidates are
verified with the regex itself. A rule without mandatory trigrams scans all
texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.common import text_of

FEW = 8  # a character class of at most so many characters counts as alternatives


@dataclass(frozen=True)
class Rule:
    """``pattern`` must read alike in Java, Python and RE2. Matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = (*BASE, *MORE)


_CLASSES = frozenset("dDwWsSbBAZzGhHvVR")  # escapes that stand for a class or a place


class _Reader:
    """Reads a regex of literals, classes, groups, alternatives and repeats as alternatives of literal runs.

    Each alternative is the literal runs of a match in order; a run that may
    be followed by anything ends with an empty string. Whatever is not known
    for certain is taken for anything at all.
    """

    def __init__(self, pattern: str):
        self.rest = list(reversed(pattern))

    def peek(self) -> str:
        return self.rest[-1] if self.rest else ""

    def take(self) -> str:
        return self.rest.pop() if self.rest else ""

    @staticmethod
    def join(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
        return (*a[:-1], a[-1] + b[0], *b[1:])

    def whole(self) -> list[tuple[str, ...]]:
        """Alternatives up to the end or a closing parenthesis."""
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            out = out + self.sequence()
        return out

    def sequence(self) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = [("",)]
        while self.peek() and self.peek() not in "|)":
            out = list(dict.fromkeys(self.join(x, y) for x, y in product(out, self.repeated(self.one()))))
        return out

    def repeated(self, once: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        low, high = 1, 1
        if self.peek() in ("?", "*", "+"):
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[self.take()]
        elif self.peek() == "{":
            text = ""
            while text[-1:] != "}":
                text += self.take()
            first, _, second = text[1:-1].partition(",")
            low, high = int(first or 0), int(second) if second else None if "," in text else int(first)
        if self.peek() in ("?", "+") and (low, high) != (1, 1):
            self.take()  # lazy and possessive repeats match the same texts at most
        part: list[tuple[str, ...]] = [("",)]
        for _ in range(min(low, 3)):
            part = [self.join(x, y) for x, y in product(part, once)]
        return part if low == high and low <= 3 else [(*x, "") for x in part]

    def literal(self) -> str | None:
        """The character of an escape that was begun, if it is one."""
        c = self.take()
        if c == "x":
            return chr(int(self.take() + self.take(), 16))
        return None if c in _CLASSES or c.isdigit() else {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}.get(c, c)

    def one(self) -> list[tuple[str, ...]]:
        anything: list[tuple[str, ...]] = [("", "")]
        c = self.take()
        if c == "(":
            inside = self.group()
            self.take()
            return inside
        if c == "[":
            return self.members()
        if c == "\\":
            c = self.literal()
            return anything if c is None else [(c.lower(),)]
        return anything if c == "." else [("",)] if c in "^$" else [(c.lower(),)]

    def group(self) -> list[tuple[str, ...]]:
        if self.peek() != "?":
            return self.whole()
        self.take()
        head = self.take()
        if head in "=!<" and not (head == "<" and self.peek() not in "=!"):  # looks around: no part of the match
            self.whole()
            return [("", "")]
        while head not in (":", ">", ")"):
            head = self.take()
        return [("",)] if head == ")" else self.whole()

    def members(self) -> list[tuple[str, ...]]:
        """A class: its characters, if few and listed, else anything."""
        found, known = [], self.peek() != "^"
        while self.peek() and (self.peek() != "]" or not found):
            c = self.take()
            if c == "\\":
                c = self.literal()
            elif c == "-" and found and self.peek() != "]":
                known = False
            known = known and c is not None
            found.append((c or "").lower())
        self.take()
        return [(c,) for c in dict.fromkeys(found)] if known and len(found) <= FEW else [("", "")]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams that any match of ``pattern`` contains; None if it may have none."""
    clauses = [frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs in _Reader(pattern).whole()]
    if not all(clauses):
        return None
    return [c for c in dict.fromkeys(clauses) if not any(d < c for d in clauses)]


def _name(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with id and tag: what a row's postings name it by, so that rows without an id are told apart."""
    null = F.col("doc_id").isNull()
    return docs.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "tag": F.xxhash64("text", F.length("text"), null)})


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, id, tag) for each of ``trigrams`` in each lower-cased text."""
    low = docs.select("id", "tag", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("id", "tag", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, tag, kinds): the rules whose trigram query the document's postings satisfy."""
    clauses = [(r.kind, k, t, len(c)) for r in rules for k, c in enumerate(trigram_query(r.pattern) or []) for t in sorted(c)]
    wanted = docs.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, needed int")
    index = postings(docs, sorted({c[2] for c in clauses}))
    met = index.join(F.broadcast(wanted), "trigram").groupBy("id", "tag", "kind", "clause").agg(F.count_distinct("trigram").alias("have"), F.first("needed").alias("needed"))
    return met.filter("have = needed").groupBy("id", "tag").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Leftmost non-overlapping matches as array of struct (start, number, end), code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, 0)
    kept = F.regexp_extract_all(text, pattern, rule.group)
    each = F.arrays_zip(F.transform(F.slice(between, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("long"), F.transform(kept, F.length).alias("kept"))
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), (start + x["long"]).alias("end"))
        return F.struct((start + x["long"]).alias("at"), F.when(x["kept"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Return doc_id and ``spans``, array of struct (start, number, end) sorted, for every row of ``docs``.

    number is the rule's place in ``rules``; overlapping spans of different
    rules are all kept. Null text is empty; texts may be of any length. Rows
    that repeat or lack a doc_id are verified each. An empty table gives an
    empty result; further columns, of whatever names, are ignored.
    """
    docs = _name(docs.select("doc_id", text_of().alias("text")))
    marked = docs.join(candidates(docs, rules), ["id", "tag"], "left")
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    columns = []
    for number, rule in enumerate(rules):
        if trigram_query(rule.pattern) is not None:
            maybe = F.array_contains("kinds", rule.kind)
        elif re.fullmatch(r"\[[^\[\]\\]+\]\+", rule.pattern) and not rule.group:  # nothing but a run of one class: long ones only
            maybe = F.col("text").rlike(f"{rule.pattern[:-1]}{{{rule.least}}}")
        else:
            maybe = F.lit(True)
        columns.append(F.when(maybe, spans(F.col("text"), rule, number)).otherwise(none))
    return marked.select("doc_id", F.sort_array(F.concat(*columns)).alias("spans"))


def listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.lit([r.kind for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Return doc_id, n_assign, n_access, n_hex, base_sha256 (digest of the base spans) and spans (all), as text."""
    found = find_secrets(docs, rules)
    base = found.select("doc_id", "spans", F.filter("spans", lambda s: s["number"] < len(BASE)).alias("base"))

    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda s: s["number"] == n)).cast("long").alias(f"n_{BASE[n].kind}")

    return base.select("doc_id", *map(count, range(len(BASE))), F.sha2(listed(F.col("base"), rules), 256).alias("base_sha256"), listed(F.col("spans"), rules).alias("spans"))


def report_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The report in DuckDB SQL."""
    one = """SELECT doc_id, {n} AS k, '{kind}' AS kind, string_split_regex(x, '{p}') AS gaps,
            regexp_extract_all(x, '{p}', 0) AS hits, regexp_extract_all(x, '{p}', {g}) AS parts, {least} AS least FROM t"""
    each = " UNION ALL ".join(one.format(n=n, kind=r.kind, p=r.pattern.replace("'", "''"), g=r.group, least=r.least) for n, r in enumerate(rules))
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        m AS ({each}),
        e AS (SELECT doc_id, k, kind, gaps, hits, parts, least, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
        s AS (SELECT doc_id, k, kind, length(hits[i]) AS n,
                     list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                     + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start
              FROM e WHERE length(parts[i]) >= least),
        j AS (SELECT doc_id, k, start, concat(kind, ':', start, ':', start + n) AS span FROM s)
        SELECT t.doc_id,
               count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
               sha256(coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (k < {len(BASE)}), '')) AS base_sha256,
               coalesce(string_agg(span, ',' ORDER BY start, k), '') AS spans
        FROM t LEFT JOIN j ON t.doc_id = j.doc_id GROUP BY t.doc_id"""
