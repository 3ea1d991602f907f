"""Moves among siblings, clipboard payloads and note addresses in small cases."""

import json

import pytest
from pyspark.sql import functions as F

from galena.functions import urls
from galena.operators import moves, records

TREE = [(1, None, 0), (2, None, 1), (3, None, 2), (4, 1, 0), (5, 1, 1), (6, 4, 5)]


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(k, f"n{k}", p, s, "extra") for k, p, s in TREE]
    return spark.createDataFrame(rows, "id long, name string, parent_id long, sort_order int, pos string")


def state(df):
    return {r.id: (r.parent_id, r.sort_order) for r in df.collect()}


BEFORE = {k: (p, s) for k, p, s in TREE}


@pytest.mark.parametrize(
    "wanted,changed",
    [
        ([(3, 1, True, 0)], {3: (None, 0), 1: (None, 1), 2: (None, 2)}),
        ([(1, 3, False, 0)], {2: (None, 0), 3: (None, 1), 1: (None, 2)}),
        ([(2, 5, True, 0)], {2: (1, 1), 5: (1, 2), 3: (None, 1)}),
        ([(2, 4, False, 1), (3, 4, False, 0)], {3: (1, 1), 2: (1, 2), 5: (1, 3)}),
        ([(2, 1, True, 1), (2, 5, False, 0)], {2: (1, 2), 3: (None, 1)}),  # of two moves of a row the first counts
        ([(1, 6, True, 0)], {}),  # below itself
        ([(1, 1, True, 0), (9, 1, True, 0), (2, 9, True, 0), (None, 2, True, 0), (3, None, True, 0)], {}),
        ([(1, 2, False, 0), (2, 3, False, 1)], {1: (None, 0), 3: (None, 1), 2: (None, 2)}),  # what moves is no landmark
        ([(5, 6, False, 0)], {5: (4, 1), 6: (4, 0)}),
        ([], {}),
    ],
)
def test_beside(spark, tree, wanted, changed):
    m = spark.createDataFrame(wanted, "id long, target long, before boolean, pos int")
    assert state(moves.beside(tree, m)) == BEFORE | changed
    assert moves.beside(tree.limit(0), m).count() == 0


@pytest.mark.parametrize(
    "wanted,changed",
    [
        ([(3, None, 0, 0)], {3: (None, 0), 1: (None, 1), 2: (None, 2)}),
        ([(1, None, None, 0)], {2: (None, 0), 3: (None, 1), 1: (None, 2)}),
        ([(2, 1, -5, 0)], {2: (1, 0), 4: (1, 1), 5: (1, 2), 3: (None, 1)}),
        ([(2, 1, 99, 0)], {2: (1, 2), 3: (None, 1)}),
        ([(2, 6, 3, 0)], {2: (6, 0), 3: (None, 1)}),
        ([(1, 6, 0, 0), (1, 1, 0, 1)], {}),
        ([(8, 1, 0, 0)], {}),
    ],
)
def test_at_places(spark, tree, wanted, changed):
    m = spark.createDataFrame(wanted, "id long, parent_id long, place int, pos int")
    assert state(moves.at_places(tree, m)) == BEFORE | changed


def test_clipboard(spark):
    item = {"sourcePath": " /a.png ", "ext": ".PNG", "rating": 3.5, "description": "d", "sourceUrl": "u", "tagIds": [1, 2.0, 2.5, "3", True, None]}
    texts = [
        json.dumps({"version": 1, "items": [item, None, 7, {"sourcePath": "", "ext": "x"}, {"sourcePath": 5, "ext": "gif", "rating": "4", "description": 1, "tagIds": {}}, {"sourcePath": "/b", "ext": " . "}]}),
        json.dumps({"version": 1.0, "items": [item]}),
        json.dumps({"version": "1", "items": [item]}), json.dumps({"version": 2, "items": [item]}), json.dumps({"version": True, "items": [item]}),
        json.dumps({"version": 1, "items": []}), json.dumps({"version": 1, "items": {}}), json.dumps([1]), "{", "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", records.clipboard_items(F.col("t")).alias("i"))
    got = {r.k: r.i and [tuple(x) for x in r.i] for r in rows.collect()}
    one = ("/a.png", "png", 3.5, "d", "u", [1, 2])
    assert got == {0: [one, ("5", "gif", 0.0, "", "", [])], 1: [one]} | dict.fromkeys(range(2, len(texts)))


def test_note_urls(spark):
    base = "https://www.xiaohongshu.com/explore/1"
    cases = {"/explore": f"{base[:-2]}", "2?a=b": "https://www.xiaohongshu.com/explore/2?a=b", "/explorer": None, "/user/1": None, "http://x.org/explore/1": None, "": None, " ": None, None: None, "javascript:1": None, "/search_result/": "https://www.xiaohongshu.com/search_result/"}
    rows = spark.createDataFrame([(h,) for h in cases], "h string").select("h", urls.note_url(F.lit(base), F.col("h")).alias("u"))
    assert {r.h: r.u for r in rows.collect()} == cases
