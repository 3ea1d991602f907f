"""Rows of trees moved among their siblings: both lists that a move touches are numbered anew, all others stay.

Moves of one call are made at once, each against the order before them; what
moves is no landmark for others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.operators.trees import closure, tag_tree


def _first(moves: DataFrame) -> DataFrame:
    """Of moves that repeat an id, the one of the least ``pos``."""
    rest = F.struct(*[c for c in moves.columns if c != "id"])
    return moves.filter("id IS NOT NULL").groupBy("id").agg(F.min_by(rest, "pos").alias("_m")).select("id", "_m.*")


def _numbered_lists(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` with their place (from 0) among those siblings that do not move."""
    order = Window.partitionBy("parent_id").orderBy("sort_order", "name", "id")
    stay = rows.join(moves.select("id"), "id", "left_anti")
    return stay.select("id", "parent_id", (F.row_number().over(order) - 1).alias("_place"))


def _placed(rows: DataFrame, stay: DataFrame, landed: DataFrame) -> DataFrame:
    """``rows`` with new parents and numbers: ``landed`` has id, parent_id, _at (between two places) and pos."""
    old = landed.select("id").join(rows.select("id", "parent_id"), "id").select("parent_id")
    touched = old.unionByName(landed.select("parent_id")).distinct().select(F.col("parent_id").alias("_touched"))
    lists = stay.select("id", "parent_id", F.col("_place").cast("double").alias("_at"), F.lit(None).cast("long").alias("pos")).unionByName(landed.select("id", "parent_id", "_at", F.col("pos").cast("long").alias("pos")))
    lists = lists.join(touched, F.col("parent_id").eqNullSafe(F.col("_touched")), "left_semi")
    order = Window.partitionBy("parent_id").orderBy("_at", "pos", "id")
    numbers = lists.select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent"), (F.row_number().over(order) - 1).alias("_n"))
    joined = rows.join(numbers, rows["id"] == numbers["_id"], "left")
    hit = F.col("_id").isNotNull()
    kind = rows.schema["sort_order"].dataType
    return joined.withColumns({"parent_id": F.when(hit, F.col("_parent")).otherwise(F.col("parent_id")), "sort_order": F.when(hit, F.col("_n")).otherwise(F.col("sort_order")).cast(kind)}).select(*rows.columns)


def _kept_out_of_itself(rows: DataFrame, landed: DataFrame) -> DataFrame:
    """Moves but those into the moved row's own subtree."""
    below = closure(tag_tree(rows)).select(F.col("ancestor").alias("id"), F.col("descendant").alias("parent_id"))
    return landed.join(below, ["id", "parent_id"], "left_anti")


def beside(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` after each of ``moves`` (id, target, before, pos) put a row before or after a target, among its siblings.

    A row or target that is not there, a row that is its own target, a target
    that moves as well, or one below the row, moves nothing. Rows put at one
    place come in the order of ``pos``.
    """
    wanted = _first(moves.select("id", "target", "before", "pos")).join(rows.select("id"), "id", "left_semi")
    still = rows.join(wanted.select("id"), "id", "left_anti").select(F.col("id").alias("target"), "parent_id")
    landed = _kept_out_of_itself(rows, wanted.join(still, "target"))
    stay = _numbered_lists(rows, landed)
    at = F.col("_place") + F.when(F.col("before"), -0.5).otherwise(0.5)
    found = landed.join(stay.select(F.col("id").alias("target"), "_place"), "target")
    return _placed(rows, stay, found.select("id", "parent_id", at.alias("_at"), "pos"))


def at_places(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` after each of ``moves`` (id, parent_id, place, pos) put a row at a place from 0 among a parent's other children.

    Places are held to those there are; a null one is the last. A row that is
    not there, or a parent at or below the row, moves nothing; a null parent is
    the root.
    """
    first = _first(moves.select("id", "parent_id", "place", "pos"))
    landed = _kept_out_of_itself(rows, first.join(rows.select("id"), "id", "left_semi"))
    stay = _numbered_lists(rows, landed)
    sizes = stay.groupBy("parent_id").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("parent_id", "_p")
    held = landed.join(sizes, F.col("parent_id").eqNullSafe(F.col("_p")), "left")
    n = F.coalesce("_n", F.lit(0))
    at: Column = F.greatest(F.least(F.coalesce("place", n), n), F.lit(0)) - 0.5
    return _placed(rows, stay, held.select("id", "parent_id", at.alias("_at"), "pos"))
