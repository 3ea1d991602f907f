"""Folder and tag trees as adjacency tables, walked level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.scalars import is_hidden
from galena.session import written


def walk(nodes: DataFrame, roots: Column, sort: str = "sort_order") -> DataFrame:
    """``nodes`` (id, parent_id, name, ``sort``) reachable from rows where ``roots`` holds.

    Adds depth (0 for roots), trail (ids from the root) and place (sort keys
    from the root: a depth-first order). One join a level until a level is
    empty, so neither depth nor size has a limit; what lies on a circle is not
    reachable.
    """
    own = F.struct(F.col(sort).alias("s"), F.col("name").alias("n"), F.col("id").alias("i"))
    marked = written(nodes.select("id", "parent_id", "name", sort, F.coalesce(roots, F.lit(False)).alias("_root")))
    level = marked.filter("_root").select("id", "parent_id", "name", sort, F.lit(0).alias("depth"), F.array("id").alias("trail"), F.array(own).alias("place"))
    below = marked.filter("not _root and parent_id is not null")
    tree = level = written(level)
    while not level.isEmpty():
        up = level.select(F.col("id").alias("_up"), "depth", "trail", "place")
        level = written(below.join(up, F.col("parent_id") == F.col("_up")).select("id", "parent_id", "name", sort, (F.col("depth") + 1).alias("depth"), F.concat("trail", F.array("id")).alias("trail"), F.concat("place", F.array(own)).alias("place")))
        tree = tree.unionByName(level)
    return tree


def folder_tree(folders: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Active folders from the roots down; what hangs below a deleted or unknown folder is not there."""
    live = folders.filter(F.col("deleted_at").isNull()).select("id", "parent_id", "name", F.coalesce("sort_order", F.lit(0)).alias("sort_order"))
    tree = walk(live, F.col("parent_id").isNull())
    if counts is None:
        return tree
    own = counts.select(F.col("folder_id").alias("_f"), "file_count")
    return tree.join(own, tree["id"] == own["_f"], "left").drop("_f").withColumn("file_count", F.coalesce("file_count", F.lit(0)))


def tag_tree(tags: DataFrame) -> DataFrame:
    """All tags; one whose parent is unknown is a root."""
    known = tags.select(F.col("id").alias("_p"))
    marked = tags.join(known, tags["parent_id"] == known["_p"], "left").select("id", "parent_id", "name", F.coalesce("sort_order", F.lit(0)).alias("sort_order"), F.col("_p").isNull().alias("orphan"))
    return walk(marked, F.col("orphan"))


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of a walked tree, a node being its own at distance 0."""
    step = tree.select(F.col("id").alias("descendant"), "depth", F.posexplode("trail").alias("at", "ancestor"))
    return step.select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def filter_tree(tree: DataFrame, match: Column) -> DataFrame:
    """Nodes that match, with all below and above them."""
    hits = tree.filter(match).select("id", "trail")
    above = hits.select(F.explode("trail").alias("id"))
    below = closure(tree).join(hits.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id"))
    return tree.join(above.unionByName(below).distinct(), "id", "left_semi")


def without_hidden(tree: DataFrame) -> DataFrame:
    """Without subtrees whose root's name begins with a dot."""
    hidden = tree.filter(is_hidden(F.col("name"))).select(F.col("id").alias("ancestor"))
    gone = closure(tree).join(hidden, "ancestor", "left_semi").select(F.col("descendant").alias("id"))
    return tree.join(gone.distinct(), "id", "left_anti")


def visible_items(tree: DataFrame, expanded: DataFrame) -> DataFrame:
    """Depth-first rows whose ancestors are all in ``expanded`` (id): adds has_children and is_expanded."""
    open_ = expanded.select(F.col("id").alias("_e")).distinct()
    shut = closure(tree).filter("distance > 0").join(open_, F.col("ancestor") == F.col("_e"), "left_anti").select(F.col("descendant").alias("id")).distinct()
    parents = tree.filter("parent_id is not null").select(F.col("parent_id").alias("_p")).distinct()
    rows = tree.join(shut, "id", "left_anti").join(parents, F.col("id") == F.col("_p"), "left").join(open_, F.col("id") == F.col("_e"), "left")
    return rows.withColumn("has_children", F.col("_p").isNotNull()).withColumn("is_expanded", F.col("_e").isNotNull()).drop("_p", "_e").orderBy("place")


def siblings(tree: DataFrame, node: int) -> DataFrame:
    """The node's siblings and itself, in order."""
    own = tree.filter(F.col("id") == node).select(F.col("parent_id").alias("_p")).limit(1)
    return tree.join(own, F.col("parent_id").eqNullSafe(F.col("_p")), "left_semi").orderBy("sort_order", "name", "id")


def is_descendant(tree: DataFrame, ancestor: int, node: int) -> bool:
    return not tree.filter((F.col("id") == node) & (F.col("id") != ancestor) & F.array_contains("trail", ancestor)).isEmpty()


def move_plan(sibling_ids: list[int], moved: int, index: int, source_ids: list[int] | None = None) -> dict:
    """New orders of the source and target siblings when ``moved`` goes to ``index`` of ``sibling_ids``."""
    target = [x for x in sibling_ids if x != moved]
    at = min(max(0, index), len(target))
    source = [x for x in (sibling_ids if source_ids is None else source_ids) if x != moved]
    return {"source": source, "target": [*target[:at], moved, *target[at:]], "sort_order": at}


def named_order(name: str = "name") -> list[Column]:
    """Siblings by place, then by name as Chinese dictionaries have it."""
    return [F.col("sort_order").asc(), F.collate(F.col(name), "zh").asc(), F.col("id").asc()]


def path_labels(tree: DataFrame, elided: int | None = None) -> DataFrame:
    """Nodes of a walked tree with label: the names from the root, slash-joined; ``elided`` has no row of its own."""
    label = F.array_join(F.transform("place", lambda p: p["n"]), "/")
    rows = tree.withColumn("label", label)
    return rows.filter(F.col("id") != elided) if elided is not None else rows
