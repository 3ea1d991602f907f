"""Library filters, orders and pages as plans.

A :class:`FilterSpec` says what a request asks for; :func:`filtered` turns it
into one DataFrame plan (a conjunction that Catalyst pushes to the scan, semi
and anti joins for tags), :func:`page_of` orders and cuts it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions import formats
from galena.functions.scalars import color_distance_squared

COLOR_RADIUS = 85
PAGE_SIZE, PAGE_MOST = 100, 500


@dataclass(frozen=True)
class FilterSpec:
    """Fields that are None or empty ask for nothing."""

    query: str | None = None
    folder_id: int | None = None
    smart_view: str | None = None
    smart_seed: int | None = None
    file_types: tuple[str, ...] = field(default=())
    date_start: str | None = None
    date_end: str | None = None
    size_min: int | None = None
    size_max: int | None = None
    min_rating: int = 0
    tag_ids: tuple[int, ...] = field(default=())
    dominant_color: str | None = None

    def active(self) -> int:
        """How many of the structured filters are set."""
        own = (self.file_types and "all" not in self.file_types, self.date_start or self.date_end, self.size_min is not None or self.size_max is not None, self.min_rating > 0, self.tag_ids, self.dominant_color, (self.query or "").strip())
        return sum(map(bool, own))

    @staticmethod
    def of(payload: dict) -> FilterSpec:
        """From a request's fields, in snake or camel case; unknown ones are ignored."""
        snake = {"".join("_" + c.lower() if c.isupper() else c for c in k): v for k, v in payload.items()}
        known = {f.name: snake[f.name] for f in fields(FilterSpec) if snake.get(f.name) is not None}
        return FilterSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})


def folder_scope(smart_view: str | None, selected: int | None, override: int | None) -> int | None:
    """The folder a query is held to: none within a library-wide smart view; an override beats the selection."""
    if smart_view not in (None, "all"):
        return None
    return override if override is not None else selected


def is_active() -> Column:
    return F.col("deleted_at").isNull() & F.col("missing_at").isNull()


def name_contains(query: str) -> Column:
    """LIKE with the user's own wildcards, letters A to Z in either case."""
    ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    escaped = query.strip().replace("\\", "\\\\")
    return ascii_lower(F.col("name")).like(f"%{''.join(c.lower() if c.isascii() else c for c in escaped)}%")


def color_near(value: str) -> Column:
    """Within the color radius; nothing is near what is no color."""
    digits = value.strip().removeprefix("#")
    if len(digits) != 6 or any(c not in "0123456789abcdefABCDEF" for c in digits):
        return F.lit(False)
    r, g, b = (F.lit(int(digits[k : k + 2], 16)) for k in (0, 2, 4))
    own = (F.col("dominant_r"), F.col("dominant_g"), F.col("dominant_b"))
    return F.coalesce(color_distance_squared(own, (r, g, b)) <= COLOR_RADIUS**2, F.lit(False))


def predicate(spec: FilterSpec) -> Column:
    """The part of a filter that one file decides by itself."""
    test = is_active()
    if spec.query and spec.query.strip():
        test &= name_contains(spec.query)
    if spec.folder_id is not None:
        test &= F.col("folder_id") == spec.folder_id
    if spec.smart_view == "unclassified":
        test &= F.col("folder_id").isNull()
    if spec.smart_view == "recent":
        test &= F.col("last_accessed_at").isNotNull()
    exts = [e for t in spec.file_types for e in formats.BY_GROUP.get(t, [])]
    if exts:
        test &= F.lower("ext").isin(exts)
    if spec.date_start:
        test &= F.col("imported_at") >= spec.date_start
    if spec.date_end:
        test &= F.col("imported_at") <= spec.date_end
    if spec.size_min is not None:
        test &= F.col("size") >= spec.size_min
    if spec.size_max is not None:
        test &= F.col("size") <= spec.size_max
    if spec.min_rating > 0:
        test &= F.col("rating") >= spec.min_rating
    if spec.dominant_color:
        test &= color_near(spec.dominant_color)
    return test


def filtered(files: DataFrame, file_tags: DataFrame, spec: FilterSpec) -> DataFrame:
    out = files.filter(predicate(spec))
    if spec.smart_view == "untagged":
        out = out.join(file_tags.select(F.col("file_id").alias("id")), "id", "left_anti")
    if spec.tag_ids:
        out = out.join(file_tags.filter(F.col("tag_id").isin(list(spec.tag_ids))).select(F.col("file_id").alias("id")), "id", "left_semi")
    return out


def order_of(sort_by: str | None = None, direction: str | None = None, spec: FilterSpec | None = None) -> list[Column]:
    """Total orders: unknown fields sort by import time, any direction but "asc" descends; smart views override."""
    tail = [F.col("imported_at").desc(), F.col("id").asc()]
    if spec and spec.smart_view == "recent":
        return [F.col("last_accessed_at").desc(), *tail]
    if spec and spec.smart_view == "random":
        seed = abs(spec.smart_seed) + 1 if isinstance(spec.smart_seed, int) else 1
        mixed = F.col("id").cast("decimal(38,0)") * F.lit(seed).cast("decimal(19,0)") + F.lit(seed * 97 + 13).cast("decimal(22,0)")
        return [F.abs(mixed % F.lit(2147483647).cast("decimal(10,0)")).cast("long").asc(), F.col("id").asc()]
    by = {"name": F.lower("name"), "ext": F.lower("ext"), "size": F.col("size"), "rating": F.col("rating"), "created_at": F.col("created_at"), "imported_at": F.col("imported_at")}
    key = by.get(sort_by or "", F.col("imported_at"))
    first = key.asc() if direction == "asc" else key.desc()
    return [first, *([F.lower("name").asc()] if sort_by == "ext" else []), *tail]


def page_args(page: int | None = None, page_size: int | None = None) -> tuple[int, int, int]:
    """(page, page size, offset); a size of 0 or less asks for all rows on page 1 and is returned as 0."""
    if page_size is not None and page_size <= 0:
        return 1, 0, 0
    size = min(PAGE_MOST, max(1, page_size or PAGE_SIZE))
    at = max(1, page or 1)
    return at, size, (at - 1) * size


@dataclass
class Page:
    rows: DataFrame
    total: int
    page: int
    page_size: int

    @property
    def total_pages(self) -> int:
        return ceil(self.total / self.page_size) if self.page_size else 1


def page_of(rows: DataFrame, order: list[Column], page: int | None = None, page_size: int | None = None) -> DataFrame:
    """One page; a top-k plan, so no full sort unless all rows are asked for."""
    _, size, offset = page_args(page, page_size)
    ordered = rows.orderBy(*order)
    return ordered.offset(offset).limit(size) if size else ordered


def filter_files(files: DataFrame, file_tags: DataFrame, tags: DataFrame, spec: FilterSpec, sort_by: str | None = None, direction: str | None = None, page: int | None = None, page_size: int | None = None) -> Page:
    """A page of files with their tags nested, and the total count."""
    from galena.operators.library import attach_tags

    found = filtered(files, file_tags, spec)
    at, size, _ = page_args(page, page_size)
    rows = attach_tags(page_of(found, order_of(sort_by, direction, spec), page, page_size), file_tags, tags)
    return Page(rows, found.select(F.count_distinct("id")).first()[0], at, size)
