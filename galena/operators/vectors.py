"""Embeddings: provenance, index work, exact search, and similarity clusters."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions import formats
from galena.functions.scalars import dot
from galena.operators.cells import SLACK, Group, choose_pivots, gaps_of, group_size, grouped, is_early, meetings, near, placed, read_group
from galena.operators.components import smallest_reachable
from galena.operators.ranking import numbered
from galena.plans.filters import is_active
from galena.session import written

THRESHOLD = 0.94
MEETINGS = 8  # of groups, that a task takes


def _hashes() -> tuple[Column, Column]:
    return F.nullif("content_hash", F.lit("")), F.nullif("source_content_hash", F.lit(""))


def is_current() -> Column:
    """Both hashes known and equal; or one unknown, and size and time equal. Null without an embedding row."""
    a, b = _hashes()
    known = a.isNotNull() & b.isNotNull()
    same = (F.col("size") == F.col("source_size")) & (F.col("fs_modified_at") == F.col("source_modified_at"))
    return (known & (a == b)) | (~known & same)


def is_outdated() -> Column:
    a, b = _hashes()
    known = a.isNotNull() & b.isNotNull()
    other = (F.col("size") != F.col("source_size")) | (F.col("fs_modified_at") != F.col("source_modified_at"))
    return (known & (a != b)) | (~known & other)


def candidates(files: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Active files with a ready embedding of their present content."""
    joined = files.join(embeddings, files["id"] == embeddings["file_id"])
    return joined.filter(is_active() & (F.col("status") == "ready") & F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimensions")) & is_current())


def index_state(files: DataFrame, embeddings: DataFrame, model_id: str) -> DataFrame:
    """Active searchable files with their embedding row of a model, if any, and what is to be done."""
    live = files.filter(is_active() & F.lower("ext").isin(formats.SEARCHABLE))
    own = embeddings.filter(F.col("model_id") == model_id)
    joined = live.join(own, live["id"] == own["file_id"], "left")
    outdated = F.coalesce(is_outdated(), F.lit(False))
    ready = (F.col("status") == "ready") & F.col("embedding").isNotNull()
    missing = ~F.coalesce(ready, F.lit(False)) | outdated
    failed = F.coalesce(F.col("status") == "error", F.lit(False)) & ~outdated
    return joined.withColumn("outdated", outdated).withColumn("unindexed", missing).withColumn("pending", missing & ~failed)


def index_counts(files: DataFrame, embeddings: DataFrame, model_id: str) -> DataFrame:
    """One row: total, ready, error, outdated, pending. Outdated wins over the others; pending is the rest."""
    s = index_state(files, embeddings, model_id)
    ready = (F.col("status") == "ready") & F.col("embedding").isNotNull() & ~F.col("outdated")
    counts = s.agg(F.count(F.lit(1)).alias("total"), F.count_if(ready).alias("ready"), F.count_if((F.col("status") == "error") & ~F.col("outdated")).alias("error"), F.count_if("outdated").alias("outdated"))
    rest = F.col("total") - F.col("ready") - F.col("error") - F.col("outdated")
    return counts.withColumn("pending", F.greatest(rest, F.lit(0)))


def query_vector(files: DataFrame, embeddings: DataFrame, file_id: int, model_id: str | None = None) -> tuple[str, list[float]] | None:
    """Model and vector of one file, if it is ready and current."""
    rows = candidates(files.filter(F.col("id") == file_id), embeddings.filter(F.col("file_id") == file_id))
    rows = rows.filter(F.col("model_id") == model_id) if model_id else rows
    found = rows.select("model_id", "embedding").limit(1).collect()
    return (found[0][0], list(found[0][1])) if found else None


def search(files: DataFrame, embeddings: DataFrame, model_id: str, vector: list[float], exclude: int | None = None) -> DataFrame:
    """All scored files, exactly, with ``score``; order by :func:`search_order` and cut a page for a top-k plan."""
    own = candidates(files, embeddings.filter((F.col("model_id") == model_id) & (F.col("dimensions") == len(vector))))
    own = own.filter(F.col("id") != exclude) if exclude is not None else own
    return own.withColumn("score", dot(F.col("embedding"), F.lit([float(x) for x in vector])))


def search_order() -> list[Column]:
    return [F.col("score").desc(), F.col("imported_at").desc(), F.col("id").asc()]


def best_forest(u: np.ndarray, v: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges (u, v) of a forest of best scores that connects what all edges of ``n`` nodes connect.

    In a round every tree takes the best edge that leaves it (the first of
    equals), and trees that meet are one; rounds are about log2 of n.
    """
    place = np.empty(len(score), np.int64)
    place[np.argsort(-score, kind="stable")] = np.arange(len(score))
    tree, chosen = np.arange(n), []
    live = np.arange(len(u))
    while True:
        live = live[tree[u[live]] != tree[v[live]]]
        if not len(live):
            return np.sort(np.concatenate([np.empty(0, np.int64), *chosen]))
        best = np.full(n, len(score), np.int64)
        for side in (u, v):
            np.minimum.at(best, tree[side[live]], place[live])
        edge = np.empty(len(score), np.int64)
        edge[place] = np.arange(len(score))
        own = np.unique(edge[best[best < len(score)]])
        chosen.append(own)
        for _ in range(n):  # trees joined by the chosen edges take their smallest number
            low = np.minimum(tree[u[own]], tree[v[own]])
            to = np.arange(n)
            np.minimum.at(to, tree[u[own]], low)
            np.minimum.at(to, tree[v[own]], low)
            if (to[tree] == tree).all():
                break
            tree = to[tree]


def without_copies(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` with one of each group of equal vectors, the smallest id, and (model_id, dimensions, a, b, score) that tie the others to it.

    Vectors too short to be similar to their own copy all stay.
    """
    key, own = ["model_id", "dimensions"], dot(F.col("embedding"), F.col("embedding"))
    ties = (own >= threshold) & ~F.isnan(own)
    firsts = written(rows.filter(ties).groupBy(*key, "embedding").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    crowds = firsts.filter("n > 1").select(*key, "embedding", "first")
    copies = rows.filter(ties).join(crowds, [*key, "embedding"]).filter(F.col("id") != F.col("first"))
    links = copies.select(*key, F.col("first").alias("a"), F.col("id").alias("b"), own.alias("score"))
    return firsts.select(*key, F.col("first").alias("id"), "embedding").unionByName(rows.filter(~ties)), links


def links_of(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of pairs (a, b) of labels (of_a, of_b): a forest of best scores that connects all labels that the pairs do, and the best pair within each label."""
    known, one = np.unique(np.concatenate([of_a, of_b]), return_inverse=True)
    u, v = one[: len(a)], one[len(a) :]
    within = np.flatnonzero(u == v)
    within = within[np.lexsort((-score[within], u[within]))]
    first = np.unique(u[within], return_index=True)[1]
    return np.concatenate([best_forest(u, v, score, len(known)), within[first]])


def similar_pairs(cands: DataFrame, threshold: float = THRESHOLD, block: int = 1024, links_only: bool = False, most_pivots: int = 2048) -> DataFrame:
    """(model_id, dimensions, a, b, score) of pairs at or above ``threshold``, a before b.

    Exact: no pair is missed. A product of at least ``threshold`` bounds the
    distance of two vectors by their lengths, so a vector meets only the cells
    of :mod:`galena.operators.cells` in its reach. Groups of cells lie in files
    of the shared folder; a task reads two groups and takes matrix products of
    blocks of what is in reach. Where vectors cluster and the threshold is
    high that is a small part of all pairs; where every cell is in reach the
    work is quadratic, but neither disk nor memory is. ``most_pivots`` bears
    on speed only: the numbers that the driver and each task hold are at most
    that many vectors.

    ``links_only`` gives the best pairs that connect all that are similar, and
    equal vectors are one, so a group of copies does not yield all its pairs.
    Every group's best pair is among them. Each group meets itself and a few
    others first, which give at most two pairs a row; what these connect
    counts as one in all other meetings, so these add what is new, and the
    best pair within each one. Vectors that hold a value that is not a number
    have no pair.
    """
    key = ["model_id", "dimensions"]
    square = dot(F.col("embedding"), F.col("embedding"))
    rows = cands.select(*key, "id", "embedding").filter(~F.isnan(square))
    rows, copies = without_copies(rows, threshold) if links_only else (rows, None)
    rows = written(rows.withColumn("square", square))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("most"))
    pivots = choose_pivots(rows, sizes, block, most_pivots)
    apart = F.col("square") + F.col("most")  # squared distance, but for twice the product
    reach = F.sqrt(F.greatest(apart - 2 * threshold, F.lit(0.0)) + SLACK * (apart + 1))
    # one row per model joins: small, but left to the planner
    cells = written(placed(rows.join(sizes, key).select(*key, "id", "embedding", reach.alias("reach")), pivots))
    size = group_size(sizes, block)

    def blocks(one: Group, two: Group, planes: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in both groups, and scores, of the pairs of two blocks after another; of a group with itself each pair once."""
        for c, s, s_end in one.parts:
            for d, t, t_end in two.parts:
                if one is two and t < s:
                    continue
                a, b = np.arange(s, s_end), np.arange(t, t_end)
                if planes and c != d:
                    a = a[near(one.x[s:s_end], one.reach[s:s_end], c, d, *planes)]
                    b = b[near(two.x[t:t_end], two.reach[t:t_end], d, c, *planes)] if len(a) else b[:0]
                if not len(a) or not len(b):
                    continue
                u, v = np.nonzero(one.x[a] @ two.x[b].T >= threshold - 1e-9)
                u, v = a[u], b[v]
                if one is two and s == t:
                    u, v = u[u < v], v[u < v]
                if not len(u):
                    continue
                exact = np.zeros(len(u))
                for k in range(one.x.shape[1]):  # left to right, as the scalar function adds
                    exact += one.x[u, k] * two.x[v, k]
                if (exact >= threshold).any():
                    yield u[exact >= threshold], v[exact >= threshold], exact[exact >= threshold]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = {k: (p, gaps_of(p)) for k, p in pivots.items()}
        for meeting in (m for frame in frames for m in frame.itertuples(index=False)):
            one = read_group(meeting.path, block)
            two = one if meeting.i == meeting.j else read_group(meeting.other, block)

            def told(u: np.ndarray, v: np.ndarray, score: np.ndarray) -> pd.DataFrame:
                a, b = one.ids[u], two.ids[v]  # noqa: B023  used before the next meeting
                return pd.DataFrame({"model_id": meeting.model_id, "dimensions": meeting.dimensions, "a": np.minimum(a, b), "b": np.maximum(a, b), "score": score})  # noqa: B023

            held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            for found in blocks(one, two, planes.get((meeting.model_id, meeting.dimensions))):
                if not links_only:
                    yield told(*found)
                else:
                    both = [np.concatenate(x) for x in zip(held, found, strict=True)]
                    chosen = links_of(one.ids[both[0]], two.ids[both[1]], one.labels[both[0]], two.labels[both[1]], both[2])
                    held = [x[chosen] for x in both]
            if len(held[0]):
                yield told(*held)

    def met(meetings: DataFrame) -> DataFrame:
        return meetings.repartition(tasks).mapInPandas(compare, "model_id string, dimensions int, a long, b long, score double")

    groups = grouped(cells, size)
    all_ = written(meetings(groups).select(*key, "i", "j", "path", "other", is_early().alias("early")))
    # a meeting's work is far more than its bytes tell, so the number of tasks follows that of meetings and is not to be coalesced
    n = all_.count()
    tasks = max(1, min(n, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n // MEETINGS))
    if not links_only:
        return met(all_)
    early = written(met(all_.filter("early")))
    if all_.filter("NOT early").isEmpty():
        return early.unionByName(copies)
    # ids of one model only are of one label: an id may have a vector of each
    labels = smallest_reachable(early.select(F.struct(*key, F.col("a").alias("id")).alias("a"), F.struct(*key, F.col("b").alias("id")).alias("b")))
    labels = labels.select(F.col("node.model_id").alias("model_id"), F.col("node.dimensions").alias("dimensions"), F.col("node.id").alias("id"), F.col("component.id").alias("_label"))
    labelled = grouped(cells.join(labels, [*key, "id"], "left").withColumn("label", F.coalesce("_label", "id")).drop("_label"), size)
    late = meetings(labelled).filter(~is_early())
    return early.unionByName(met(late)).unionByName(copies)


def similar_groups(cands: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, component, imported_at) of files in a similarity component of at least two."""
    cands = written(cands.select("id", "imported_at", "model_id", "dimensions", "embedding"))
    reach = smallest_reachable(written(similar_pairs(cands, threshold, links_only=True)))
    return cands.select("id", "imported_at").join(reach, F.col("id") == F.col("node")).select("id", "component", "imported_at")


def _first_shared(exact: DataFrame, similar: DataFrame) -> DataFrame:
    """(component, latest, lead) of ``exact`` (id, latest, lead): of the groups that share a member with a component the first, as only it gives others a place."""
    both = exact.select(F.col("id").alias("_id"), "latest", "lead").join(similar.select("id", "component"), F.col("_id") == F.col("id"))
    return both.groupBy("component").agg(F.max(F.struct("latest", (-F.col("lead")).alias("lead"))).alias("g")).select("component", "g.latest", (-F.col("g.lead")).alias("lead"))


def duplicate_or_similar(files: DataFrame, embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, rank) of the view of exact and similar files.

    Groups of equal content come first, latest import first, each followed by
    the members of every similarity group that shares a member with it; then
    the similarity groups that share none, best score first. An id counts where
    it comes up first.
    """
    cands = written(candidates(files, embeddings).select("id", "imported_at", "model_id", "dimensions", "embedding"))
    hashed = files.filter(is_active() & (F.coalesce("content_hash", F.lit("")) != ""))
    member_order = [F.col("imported_at").desc(), F.col("id").asc()]
    exact = hashed.select("id", "content_hash", "imported_at")
    groups = exact.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.max("imported_at").alias("latest"), F.max_by("id", F.struct("imported_at", -F.col("id"))).alias("lead")).filter("n > 1")
    exact = exact.join(groups, "content_hash").select("id", "imported_at", "latest", "lead")

    pairs = written(similar_pairs(cands, threshold, links_only=True))
    reach = smallest_reachable(pairs)
    similar = cands.select("id", "imported_at").join(reach, F.col("id") == F.col("node")).select("id", "component", "imported_at")
    best = pairs.join(reach, F.col("a") == F.col("node")).groupBy("component").agg(F.max("score").alias("best"))
    about = similar.groupBy("component").agg(F.max("imported_at").alias("latest"), F.max_by("id", F.struct("imported_at", -F.col("id"))).alias("lead")).join(best, "component")

    # places, smallest first: tier, group keys (descending ones negated or inverted by the order below), part, member
    own = exact.select("id", F.lit(0).alias("tier"), F.lit(0.0).alias("best"), "latest", "lead", F.lit(0).alias("part"), "imported_at")
    shared = _first_shared(exact, similar)
    absorbed = similar.join(shared, "component").select("id", F.lit(0).alias("tier"), F.lit(0.0).alias("best"), "latest", "lead", F.lit(1).alias("part"), "imported_at")
    alone = similar.join(shared, "component", "left_anti").join(about, "component").select("id", F.lit(1).alias("tier"), "best", "latest", "lead", F.lit(0).alias("part"), "imported_at")
    places = own.unionByName(absorbed).unionByName(alone)
    order = [F.col("tier").asc(), F.col("best").desc(), F.col("latest").desc(), F.col("lead").asc(), F.col("part").asc(), *member_order]
    first = places.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("_n = 1")
    return numbered(first, order).select("id", "rank")


def is_ready(files: DataFrame, embeddings: DataFrame, model_id: str) -> DataFrame:
    """(id, ready): whether a file has a ready embedding of its present content."""
    own = candidates(files, embeddings.filter(F.col("model_id") == model_id)).select(F.col("id").alias("_id")).distinct()
    return files.join(own, files["id"] == own["_id"], "left").select("id", F.col("_id").isNotNull().alias("ready"))


def index_job(files: DataFrame, embeddings: DataFrame, model_id: str, contents: DataFrame, encode: Callable[[], Callable[[bytes], list[float]]], at: str, again: bool = False, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``embeddings`` after an index run: what is to be done is encoded, results replace a file's row, failures become error rows.

    ``contents`` has id and content (bytes). ``encode()`` is called once per
    task and gives the encoder; one that raises is tried ``tries`` times, each
    after ``wait`` seconds more than the last. ``again`` drops all embeddings
    first. Files without content stay as they are.
    """
    from galena.operators.mutations import merge_last

    base = embeddings.limit(0) if again else embeddings
    todo = index_state(files, base, model_id).filter("pending").select("id", "size", "fs_modified_at", "content_hash").join(contents.select("id", "content"), "id")
    schema = "file_id long, model_id string, dimensions int, embedding array<float>, source_size long, source_modified_at string, source_content_hash string, indexed_at string, status string, last_error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encode()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                vector, error = None, None
                for n in range(tries):
                    try:
                        vector, error = [float(x) for x in encoder(row.content)], None
                        break
                    except Exception as e:  # noqa: BLE001  an encoder's failure is a result
                        error = str(e)
                        time.sleep(wait * (n + 1) if n + 1 < tries else 0)
                out.append((row.id, model_id, len(vector or []), vector, row.size, row.fs_modified_at, row.content_hash, at, "error" if error else "ready", error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    done = todo.mapInPandas(run, schema)
    return merge_last(base, written(done.select(*[c for c in done.columns if c in base.columns])), ["file_id"])
