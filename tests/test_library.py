"""Small cases with known results."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.functions import formats, media, scalars
from galena.operators import cells, fuzzy, library, mutations, sync, tasks, trees, vectors
from galena.plans import filters
from galena.plans.filters import FilterSpec
from galena.sources import scan
from galena.sources.library import SCHEMAS
from galena.streaming import events

DAY = "2026-04-25 10:0{}:00"


def files(spark, rows):
    names = SCHEMAS["files"].names
    base = {"ext": "png", "width": 100, "height": 100, "rating": 0, "description": "", "source_url": "", "dominant_color": "", "color_distribution": "[]", "thumb_hash": ""}
    full = [base | {"path": f"/l/{r.get('name')}", "normalized_path": f"/l/{r.get('name')}", "fs_modified_at": DAY.format(0), "imported_at": DAY.format(0), "size": 1} | r for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], SCHEMAS["files"])


def similar_library(spark):
    f = files(
        spark,
        [
            {"id": 1, "name": "exact-a.png", "size": 10, "imported_at": DAY.format(1), "content_hash": "hash_exact"},
            {"id": 2, "name": "exact-b.png", "size": 11, "imported_at": DAY.format(2), "content_hash": "hash_exact"},
            {"id": 3, "name": "similar-a.png", "size": 12, "imported_at": DAY.format(3), "content_hash": "hash_a"},
            {"id": 4, "name": "similar-b.png", "size": 13, "imported_at": DAY.format(4), "content_hash": "hash_b"},
            {"id": 5, "name": "different.png", "size": 14, "imported_at": DAY.format(5), "content_hash": "hash_c"},
        ],
    )
    vecs = {2: [1.0, 0.0, 0.0], 3: [1.0, 0.0, 0.0], 4: [0.95, 0.3122499, 0.0], 5: [0.0, 1.0, 0.0]}
    hashes = {2: "hash_exact", 3: "hash_a", 4: "hash_b", 5: "hash_c"}
    rows = [(k, "clip-test", 3, v, 9 + k, DAY.format(0), hashes[k], DAY.format(9), "ready", None) for k, v in vecs.items()]
    return f, spark.createDataFrame(rows, SCHEMAS["file_visual_embeddings"])


def test_duplicate_or_similar(spark):
    f, e = similar_library(spark)
    assert [r.id for r in vectors.duplicate_or_similar(f, e).orderBy("rank").collect()] == [2, 1, 4, 3]
    model, vector = vectors.query_vector(f, e, 3)
    found = vectors.search(f, e, model, vector, exclude=3).orderBy(*vectors.search_order())
    assert [r.id for r in found.collect()] == [2, 4, 5]
    assert vectors.query_vector(f, e, 3, "other-model") is None


def test_a_similar_group_that_bridges_two_exact_groups_goes_with_the_first(spark):
    f = files(spark, [{"id": k, "name": f"{k}.png", "size": k, "imported_at": DAY.format(k), "content_hash": h} for k, h in ((1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "z"))])
    e = spark.createDataFrame([(k, "m", 2, [1.0, 0.0], k, DAY.format(0), h, "", "ready", None) for k, h in ((1, "x"), (3, "y"), (5, "z"))], SCHEMAS["file_visual_embeddings"])
    assert [r.id for r in vectors.duplicate_or_similar(f, e).orderBy("rank").collect()] == [4, 3, 5, 1, 2]


def test_pairs_in_blocks_equal_pairs_at_once(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = spark.createDataFrame([("m", 8, k, [float(v) for v in r]) for k, r in enumerate(x)], "model_id string, dimensions int, id long, embedding array<float>")
    at_once, blocks = ({(r.a, r.b) for r in vectors.similar_pairs(c, 0.5, b).collect()} for b in (1000, 7))
    y = x.astype(np.float32).astype(float)
    assert at_once == blocks == {(i, j) for i in range(60) for j in range(i + 1, 60) if y[i] @ y[j] >= 0.5}


def test_a_vector_visits_only_cells_in_its_reach():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 50, axis=0) + 0.02 * rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = x[::50]
    home, visits = cells.homes_and_visits(x, np.full(len(x), np.sqrt(2 - 2 * 0.94)), pivots, cells.gaps_of(pivots))
    assert visits.mean() < 0.05  # clusters apart: next to no visits
    near = np.argwhere(np.triu(x @ x.T >= 0.94, 1))
    meets = (home[near[:, 0]] == home[near[:, 1]]).astype(int) + visits[near[:, 0], home[near[:, 1]]] + visits[near[:, 1], home[near[:, 0]]]
    assert (meets == 1).all()
    wide = cells.homes_and_visits(x, np.full(len(x), np.inf), pivots, cells.gaps_of(pivots))[1]
    assert wide.sum() == sum((home == i).sum() for i in range(40) for j in range(40) if i != j and ((i + j) % 2 == 1) == (i < j))


@pytest.mark.parametrize("block,most", [(1000, 2048), (5, 2048), (5, 6), (9, 0), (2, 2048), (3, 4)])
def test_pairs_of_clusters_copies_and_unequal_lengths(spark, block, most):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(6, 4)), 12, axis=0) + 0.2 * rng.normal(size=(72, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::7] *= rng.uniform(0.5, 3, size=(len(x[::7]), 1))
    x[40:52] = x[40]  # copies
    x[60:64] = 0.1 * x[60]  # copies that are not like each other
    x[70], x[71, 0] = 0, np.nan
    y = x.astype(np.float32)
    shape = "model_id string, dimensions int, id long, embedding array<float>"
    c = spark.createDataFrame([("mn"[k % 5 == 0], 4, k, [float(v) for v in r]) for k, r in enumerate(y)], shape)
    z = y.astype(float)
    for t in (0.94, 0.2):
        want = {(i, j) for i in range(72) for j in range(i + 1, 72) if (i % 5 == 0) == (j % 5 == 0) and z[i] @ z[j] >= t}
        got = [(r.a, r.b) for r in vectors.similar_pairs(c, t, block, most_pivots=most).collect()]
        assert sorted(got) == sorted(want)
        links = vectors.similar_pairs(c, t, block, True, most).collect()
        assert {(r.a, r.b) for r in links} <= want and all(abs(r.score - z[r.a] @ z[r.b]) < 1e-12 for r in links)
        assert parts_of(want) == parts_of([(r.a, r.b) for r in links])
        for group in parts_of(want):
            assert max(z[i] @ z[j] for i, j in want if i in group) == pytest.approx(max(r.score for r in links if r.a in group), abs=1e-12)
    assert vectors.similar_pairs(c.limit(0), 0.5, block, True, most).count() == vectors.similar_pairs(c.limit(0), 0.5, block).count() == 0


def parts_of(pairs):
    """Connected sets of the numbers in ``pairs``."""
    sets = {k: frozenset([k]) for p in pairs for k in p}
    for a, b in pairs:
        both = sets[a] | sets[b]
        sets |= {k: both for k in both}
    return set(sets.values())


def test_fuzzy_within_a_folder(spark):
    f = files(spark, [{"id": 1, "name": "Music Player.png", "folder_id": 1}, {"id": 2, "name": "Design Pattern.jpg", "folder_id": 1}, {"id": 3, "name": "Music Player.png"}])
    inside = f.filter(filters.predicate(FilterSpec(folder_id=1)))
    assert [r.id for r in fuzzy.fuzzy_files(inside, "mpy").collect()] == [1]
    assert [r.id for r in fuzzy.fuzzy_files(inside, "desip").collect()] == [2]


SOUNDS = {"网": ["wang"], "页": ["ye"], "设": ["she"], "计": ["ji"], "文": ["wen"], "档": ["dang"], "管": ["guan"], "理": ["li"], "我": ["wo"], "的": ["de"], "件": ["jian"], "女": ["nv"]}


def test_pinyin(spark):
    rows = spark.createDataFrame([(1, "我的网页"), (2, "网页设计"), (3, "文档管理"), (4, "Music Player"), (5, None)], "id long, name string")

    def found(q):
        hits = fuzzy.with_tiers(rows, q, F.col("name"), sounds=SOUNDS)
        return [r.id for r in hits.orderBy(*fuzzy.fuzzy_order()).collect()]

    assert found("wangye") == [2, 1]
    assert found("wdgl") == [3]
    assert found("wendang") == [3]
    assert found("mp") == [4]


@pytest.mark.parametrize("name,query,tier", [("Music Player", "Music Player", 7), ("Music Player", "music player", 6), ("Café Noir", "cafe", 5), ("Straße", "x", None), ("ab", "b", 3), ("abc", "z", None), ("a-b c", "abc", 2), ("Music Player", "mus", 5), ("Music Player", "play", 4), ("Music Player", "sic", 3), ("Music Player", "mp", 2), ("Music Player", "mspr", 1), ("Music Player", "xyz", None), ("a.b", "a.b", 7), ("A.b", "a.b", 6), ("axb", "a.b", None)])
def test_tiers(spark, name, query, tier):
    assert spark.range(1).select(fuzzy.tier(F.lit(name), query)).first()[0] == tier


def test_sync_truth_tables(spark):
    rows = spark.createDataFrame([("d", None, False), (None, None, True), (None, None, False), (None, "m", True)], "d string, m string, u boolean")
    kinds = rows.select(sync.kind_of_known(F.col("d"), F.col("m"), F.col("u"))).collect()
    assert [r[0] for r in kinds] == ["skipped", "skipped", "updated", "added"]


def test_sync_moves_content_whose_path_is_gone(spark):
    catalog = files(spark, [{"id": 1, "name": "old.png", "content_hash": "h"}, {"id": 2, "name": "here.png", "content_hash": "k"}, {"id": 3, "name": "lost.png", "content_hash": "m", "missing_at": "2026"}])
    snap = spark.createDataFrame([("/l/new.png", "png", 1, DAY.format(0), "h"), ("/l/here.png", "png", 1, DAY.format(0), "k"), ("/l/copy.png", "png", 1, DAY.format(0), "k"), ("/l/lost2.png", "png", 1, DAY.format(0), "m")], "path string, ext string, size long, mtime string, content_hash string")
    got = {(r.path, r.kind, r.id) for r in sync.sync_diff(catalog, snap).collect()}
    assert got == {("/l/new.png", "moved", 1), ("/l/here.png", "skipped", 2), ("/l/copy.png", "added", None), ("/l/lost2.png", "moved", 3)}


def test_folder_sort_order(spark):
    f = spark.createDataFrame([(1, None, -1, None), (2, None, 0, None), (3, 1, 4, None), (4, 1, -10, "2026")], "id long, parent_id long, sort_order int, deleted_at string")
    assert {r.parent_id: r.sort_order for r in mutations.prepend_sort_order(f).collect()} == {None: -2, 1: 3}


def test_trash_preview_takes_the_deepest_folder(spark):
    f = files(spark, [{"id": 1, "name": "a.png", "normalized_path": "/l/parent/child/image.png", "deleted_at": "2026"}, {"id": 2, "name": "b.png", "deleted_at": "2026"}, {"id": 3, "name": "c.png", "normalized_path": "/l/parently/c.png", "deleted_at": "2026"}])
    folders = spark.createDataFrame([(1, "/l/parent"), (2, "/l/parent/child")], "id long, normalized_path string")
    entries = spark.createDataFrame([(1, "/hold/1", "2026", 1, 1), (2, "/hold/2", "2026", 1, 0)], SCHEMAS["folder_trash_entries"])
    assert {r.id: r.preview_path for r in sync.trash_preview(f, entries, folders).collect()} == {1: "/hold/2/image.png", 2: "/l/b.png", 3: "/l/parently/c.png"}


def test_upsert_is_idempotent_and_keeps_what_users_set(spark):
    f = files(spark, [{"id": 1, "name": "a.png", "rating": 4, "content_hash": "old", "missing_at": "2026", "dominant_color": ""}])
    new = spark.createDataFrame([("/l/a.png", "/l/a.png", "A.PNG", "PNG", 7, None, 1), ("/l/b.png", "/l/b.png", "b.png", "png", 8, "h", 2)], "normalized_path string, path string, name string, ext string, size long, content_hash string, rating int")
    once = mutations.upsert_files(f, new)
    rows = {r.id: r for r in once.collect()}
    assert (rows[1].rating, rows[1].content_hash, rows[1].missing_at, rows[1].ext, rows[1].size) == (4, "old", None, "png", 7)
    assert rows[2].normalized_path == "/l/b.png"
    assert sorted(map(tuple, mutations.upsert_files(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_tag_links_and_cascades(spark):
    tags = spark.createDataFrame([(1, "a", None, 0), (2, "b", 1, 0), (3, "c", 2, 0), (4, "d", 99, 0)], "id long, name string, parent_id long, sort_order int")
    links = spark.createDataFrame([(7, 2, 1), (7, 4, 2)], SCHEMAS["file_tags"])
    assert mutations.link_tags(links, links).count() == 2
    left, own = mutations.delete_tags(tags, links, [1])
    assert [r.id for r in left.collect()] == [4]
    assert [r.tag_id for r in own.collect()] == [4]
    assert mutations.unlink_tags(links, links).count() == 0


def test_trees(spark):
    tags = spark.createDataFrame([(1, "visual", None, 0), (2, "photo", 1, 0), (3, "travel", 2, 0), (4, ".shot", 1, 1), (5, "text", None, 1), (6, "stray", 77, 2)], "id long, name string, parent_id long, sort_order int")
    tree = trees.tag_tree(tags)
    assert [r.id for r in tree.orderBy("place").collect()] == [1, 2, 3, 4, 5, 6]
    assert sorted(r.id for r in trees.filter_tree(tree, F.col("name") == "photo").collect()) == [1, 2, 3]
    assert sorted(r.id for r in trees.without_hidden(tree).collect()) == [1, 2, 3, 5, 6]
    seen = trees.visible_items(tree, spark.createDataFrame([(1,)], "id long")).collect()
    assert [(r.id, r.has_children, r.is_expanded) for r in seen] == [(1, True, True), (2, True, False), (4, False, False), (5, False, False), (6, False, False)]
    assert trees.is_descendant(tree, 1, 3) and not trees.is_descendant(tree, 3, 1)
    assert [r.id for r in trees.siblings(tree, 4).collect()] == [2, 4]
    folders = tags.withColumn("deleted_at", F.when(F.col("id") == 2, "2026"))
    assert sorted(r.id for r in trees.folder_tree(folders).collect()) == [1, 4, 5]
    assert trees.move_plan([1, 2, 3], 3, 0) == {"source": [1, 2], "target": [3, 1, 2], "sort_order": 0}


def test_pages_and_scopes():
    assert filters.page_args() == (1, 100, 0)
    assert filters.page_args(3, 9999) == (3, 500, 1000)
    assert filters.page_args(5, 0) == (1, 0, 0)
    assert filters.folder_scope("similar", 12, 12) is None
    assert filters.folder_scope(None, 12, None) == 12
    assert filters.folder_scope("all", 12, None) == 12
    assert FilterSpec.of({"fileTypes": ["image"], "min_rating": 2, "unknown": 1}) == FilterSpec(file_types=("image",), min_rating=2)
    assert FilterSpec(min_rating=1, tag_ids=(1,)).active() == 2


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_formats(spark):
    text = lambda c, *xs: values(spark, *(c(F.lit(x)) for x in xs))
    assert text(formats.import_extension, ".JPG", "  png  ", "") == ["jpg", "png", "bin"]
    assert values(spark, formats.import_extension(F.lit(None).cast("string"))) == ["bin"]
    types = ("text/html; charset=utf-8", "image/apng", "image/jpg", "application/vnd.rar", "application/octet-stream")
    assert text(formats.extension_for_content_type, *types) == ["html", "png", "jpg", "rar", None]
    assert text(formats.preview_mode, "jpg", "heic", "mp4", "pdf", "md", "exe") == ["image", "thumbnail", "video", "thumbnail", "text", "none"]
    assert set("jfif jpe heic docx mp3 zip 3g2 m2ts".split()) <= set(formats.SCAN_SUPPORTED)
    assert set("ai eps raw cr2 cr3 nef arw dng".split()) <= set(formats.BLOCKED)
    assert formats.dimension(spark).count() == len({r[0] for r in formats.ROWS})
    raw = [bytes.fromhex(x) for x in ("00000018667479703367326100", "89504E470D0A", "FFD8FFE0", "424D00", "FFFE00")]
    raw += [b"RIFF....WEBPVP8 ", b"  \n<svg xmlns", b"%PDF-1.7", b"\x1aE\xdf\xa3....webm", b"8BPS", b""]
    assert text(formats.sniff_extension, *raw) == ["3g2", "png", "jpg", "bmp", None, "webp", "svg", "pdf", "webm", "psd", None]


def test_scalars(spark):
    one = lambda c: values(spark, c)[0]
    lit = F.lit
    size = lit(1000).cast("long")
    ranges = [one(scalars.byte_range(lit(h), size)) for h in ("bytes=0-99", "bytes=500-", "bytes=-200", "bytes=900-1200", "bytes=5-1", "bytes=1-2,4-5", "bytes=-", "bytes=1000-")]
    assert [tuple(r) if r else None for r in ranges] == [(0, 99), (500, 999), (800, 999), (900, 999), None, None, None, None]
    assert one(scalars.cache_key(lit("/a"), lit(" content-hash "), size, lit("t"))) == "content-hash"
    keys = {one(scalars.cache_key(lit("/a"), lit(h), s, lit(m))) for h, s, m in ((None, size, "t"), ("", size, "u"), ("", lit(None).cast("long"), "t"), (" ", size, ""))}
    assert len(keys) == 3
    assert [one(scalars.is_newer(lit(a), lit(b))) for a, b in (("v1.2.0", "1.1.9"), ("1.2", "1.2.0"), ("1.2.0-beta", "1.2.0"), ("2", "10"))] == [True, False, False, False]
    assert one(scalars.sanitize_stem(lit(' a/b:*c\t "d" '), lit("x"))) == "a b c d"
    assert one(scalars.sanitize_stem(lit("??"), lit("x"))) == "x"
    assert tuple(one(scalars.parse_hex_color(lit("#10fF00")))) == (16, 255, 0)
    assert one(scalars.parse_hex_color(lit("10f"))) is None
    assert one(scalars.normalize_path(lit("\\a\\.\\b//../c/"))) == "/a/c"
    assert [one(scalars.has_prefix(lit(p), lit("/a/b/"))) for p in ("/a/b", "/a/b/c", "/a/bc")] == [True, True, False]
    assert one(scalars.clean_tags(F.array(*map(lit, (" A ", "a", "", "b", "c", "d", "e", "f"))))) == ["A", "b", "c", "d", "e"]
    assert [one(scalars.clean_rating(lit(v), lit(2))) for v in ("4", " 5 stars", "9", "x", "-3")] == [4, 5, 2, 2, 2]
    assert one(scalars.json_object(lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'
    assert one(scalars.response_text(lit('{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}'))) == "ab"
    assert [one(scalars.format_size(lit(n))) for n in (0, 1023, 1536, 5 * 1024**3)] == ["0 B", "1023 B", "1.5 KB", "5 GB"]
    assert one(scalars.tag_color(lit("ab"))) == scalars.TAG_COLORS[(97 + 98) % 8]
    assert one(scalars.folder_name(lit(" .. "))) is None
    assert one(scalars.name_stem(lit(".hidden"))) == ".hidden"


def test_media(spark):
    rgb = bytes([255, 0, 0] * 30 + [0, 0, 255] * 10)
    got = spark.createDataFrame([(rgb,), (b"",), (None,)], "b binary").select(media.palette("b")).collect()
    assert [(p.color, p.percentage) for p in got[0][0]] == [("#FF0000", 75.0), ("#0000FF", 25.0)]
    assert got[1][0] == [] and got[2][0] is None
    import hashlib

    want = hashlib.sha256((2).to_bytes(4, "little") + (300).to_bytes(4, "little") + rgb).hexdigest()
    assert spark.range(1).select(media.visual_hash(F.lit(2), F.lit(300), F.lit(rgb))).first()[0] == want
    blobs = spark.createDataFrame([(np.array([1, 2.5], "<f4").tobytes(), 2), (b"abc", 2)], "b binary, d int")
    assert [r[0] for r in blobs.select(media.decode_vector("b", "d")).collect()] == [[1.0, 2.5], None]
    image = bytes([200, 100, 50, 255] * 64)
    one = spark.createDataFrame([(8, 8, image)], "w int, h int, b binary").select(media.thumb_hash_text("w", "h", "b").alias("t"))
    row = one.select("t", media.thumb_hash_ratio(F.col("t"))).first()
    assert row[1] == 1.0 and len(row[0]) >= 20
    vocabulary = "\n".join(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "red", "##dish", "cat", "图", "片", ","])
    ids = spark.createDataFrame([("Reddish cat,图片 zebra", vocabulary)], "t string, v string").select(media.word_pieces("t", "v")).first()[0]
    assert ids[:9] == [2, 4, 5, 6, 9, 7, 8, 1, 3] and len(ids) == 52


def test_scans(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "x.dat").write_bytes(b"\x89PNG\r\n")
    (tmp_path / "a" / "y.JPG").write_bytes(b"nothing known")
    (tmp_path / "a" / ".git" / "z.png").write_bytes(b"\x89PNG")
    (tmp_path / "raw.nef").write_bytes(b"1")
    got = scan.directory(spark, str(tmp_path))
    assert {(r.name, r.ext) for r in got.collect()} == {("x.dat", "png"), ("y.JPG", "jpg")}
    assert [r.relative_dir for r in scan.relative(got, str(tmp_path)).collect()] == ["a", "a"]
    assert scan.directories(got).count() == 1
    pages = spark.createDataFrame([("http://p/2", "<img class=x src='https://i/a.png'><div data-src=\"https://i/b.png\" style=\"background:url(https://i/c.png)\"><img src='/rel.png'>"), ("http://p/1", "<img data-original=https://i/a.png>"), ("http://p/3", None)], "url string, html string")
    assert {(r.image_url, r.source_url) for r in scan.page_images(pages).collect()} == {("https://i/a.png", "http://p/1"), ("https://i/b.png", "http://p/2"), ("https://i/c.png", "http://p/2"), ("http://p/rel.png", "http://p/2")}


def test_move_candidates_prefer_missing(spark):
    f = files(spark, [{"id": 1, "name": "a", "content_hash": "h"}, {"id": 2, "name": "b", "content_hash": "h", "missing_at": "2026"}, {"id": 3, "name": "c", "content_hash": "k"}])
    marked = f.withColumn("present", F.col("path") == "/l/c")
    assert [(r.content_hash, r.id) for r in library.move_candidates(marked).collect()] == [("h", 2)]


def test_streams(spark, tmp_path):
    t = lambda ms: datetime(2026, 1, 1) + timedelta(milliseconds=ms)
    src = str(tmp_path / "in")
    rows = [("a", "change", t(m)) for m in (0, 500, 3000, 5900, 6000, 6100, 9000, 20000)]
    spark.createDataFrame(rows, "path string, kind string, ts timestamp").coalesce(1).write.parquet(src)
    static = spark.read.parquet(src)
    assert [r.accepted for r in events.spaced_batch(static, ["path"]).orderBy("ts").collect()] == [True, False, True, False, True, False, True, True]
    assert events.debounced(static).count() == 5
    stream = events.read_events(spark, src, "path string, kind string, ts timestamp")
    for name, df in (("spaced", events.spaced_stream(stream)), ("bursts", events.debounced(stream)), ("sums", events.summaries(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    assert spark.table("spaced").count() == 5
    assert spark.table("bursts").count() in (3, 4, 5)  # the watermark holds back what is open at the end
    seen = spark.createDataFrame([("a", t(0), 1, "x"), ("a", t(250), 2, "x"), ("a", t(500), 2, "x"), ("b", t(0), 1, "x")], "path string, ts timestamp, size long, mtime string")
    assert [(r.path, r.ts) for r in events.stable_files(seen).collect()] == [("a", t(500))]


def test_suggestions(spark):
    f = files(spark, [{"id": 1, "name": "a.b.png", "rating": 2, "description": "own"}, {"id": 2, "name": "c.png", "rating": 3}])
    good = '{"choices":[{"message":{"content":"Sure: {\\"filename\\":\\" Sea/side \\",\\"rating\\":\\"5\\",\\"tags\\":[\\"Sea\\",\\"sea\\",\\"Sun\\"]} ."}}]}'
    bad = '{"choices":[{"message":{"content":"no json"}}]}'
    got = tasks.suggestions(f, spark.createDataFrame([(1, good), (2, bad)], "id long, response string"))
    rows = {r.id: tuple(r)[1:] for r in got.collect()}
    assert rows == {1: ("Sea side.png", "own", 5, ["Sea", "Sun"]), 2: ("c.png", "", 3, [])}
    tags = spark.createDataFrame([(7, " SUN", "#1", None), (8, "old", "#2", None)], "id long, name string, color string, parent_id long")
    links = spark.createDataFrame([(1, 8, 0), (2, 8, 0)], SCHEMAS["file_tags"])
    all_, own = tasks.apply_tags(tags, links, got)
    assert {(r.id, r.name) for r in all_.collect()} == {(7, " SUN"), (8, "old"), (9, "Sea")}
    assert sorted((r.file_id, r.tag_id) for r in own.collect()) == [(1, 7), (1, 9), (2, 8)]


def test_gaps_are_filled_and_nothing_else(spark):
    f = files(spark, [{"id": 1, "name": "a", "content_hash": "", "thumb_hash": "t"}, {"id": 2, "name": "b", "content_hash": "h"}])
    new = spark.createDataFrame([(1, "n", "[1]", "x"), (2, "n", "[2]", "y")], "id long, content_hash string, color_distribution string, thumb_hash string")
    got = {r.id: (r.content_hash, r.color_distribution, r.thumb_hash) for r in tasks.fill_gaps(f, new).collect()}
    assert got == {1: ("n", "[1]", "t"), 2: ("h", "[2]", "y")}


def test_index_job_retries_and_records_failures(spark):
    f = files(spark, [{"id": k, "name": f"{k}.png", "content_hash": f"h{k}"} for k in (1, 2, 3)])
    empty = spark.createDataFrame([], SCHEMAS["file_visual_embeddings"])
    contents = spark.createDataFrame([(1, b"ok"), (2, b"bad"), (3, b"flaky")], "id long, content binary")

    def make():
        seen = []

        def encode(content):
            seen.append(content)
            if content == b"bad" or (content == b"flaky" and seen.count(content) < 3):
                raise ValueError(content.decode())
            return [1.0, float(len(content))]

        return encode

    rows = {r.file_id: r for r in vectors.index_job(f, empty, "m", contents, make, "2027", wait=0.0).collect()}
    assert [(rows[k].status, rows[k].dimensions, rows[k].last_error) for k in (1, 2, 3)] == [("ready", 2, None), ("error", 0, "bad"), ("ready", 2, None)]
    assert rows[1].source_content_hash == "h1"
    again = vectors.index_job(f, spark.createDataFrame(list(rows.values()), SCHEMAS["file_visual_embeddings"]), "m", contents, make, "2028", wait=0.0)
    assert {r.file_id: r.indexed_at for r in again.collect()} == {1: "2027", 2: "2027", 3: "2027"}  # nothing is pending


def test_fuzzy_keys_and_order(spark):
    rows = spark.createDataFrame([(1, "zeta beta", ["x", None]), (2, None, ["beta", "b"]), (3, "Beta", None), (4, "a-beta", []), (5, "none", [])], "id long, name string, tags array<string>")
    hits = fuzzy.with_tiers(rows, "Beta", F.col("name"), F.col("tags")).orderBy(*fuzzy.fuzzy_order()).collect()
    assert [(r.id, r.tier, r.key) for r in hits] == [(3, 7, "Beta"), (2, 6, "beta"), (1, 4, "zeta beta"), (4, 3, "a-beta")]


def test_best_forest_connects_what_all_edges_do():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, m = 40, int(rng.integers(0, 120))
        u, v = rng.integers(n, size=m), rng.integers(n, size=m)
        u, v = u[u != v], v[u != v]
        score = rng.integers(5, size=len(u)) / 5

        def parts(edges, u=u, v=v):
            root = list(range(n))

            def find(k):
                while root[k] != k:
                    k = root[k]
                return k

            for e in edges:
                root[find(u[e])] = find(v[e])
            return {frozenset(k for k in range(n) if find(k) == r) for r in {find(k) for k in range(n)}}

        chosen = vectors.best_forest(u, v, score, n)
        whole = parts(range(len(u)))
        assert parts(chosen) == whole and len(chosen) == n - len(whole)
        best = lambda edges, p: max((score[e] for e in edges if u[e] in p), default=None)
        assert all(best(chosen, p) == best(range(len(u)), p) for p in whole)


def test_spaced_batch_against_a_loop(spark):
    rng = np.random.default_rng(6)
    rows = [(f"p{int(rng.integers(3))}" if k % 9 else None, datetime(2024, 1, 1) + timedelta(milliseconds=int(x)), k) for k, x in enumerate(rng.integers(0, 60_000, 300))]
    got = {r.id: r.accepted for r in events.spaced_batch(spark.createDataFrame(rows, "path string, ts timestamp, id long"), ["path"], 3000).collect()}
    last = {}
    for path, ts, k in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        ok = path not in last or ts - last[path] >= timedelta(seconds=3)
        last[path] = ts if ok else last[path]
        assert got[k] == ok


def test_repeated_incoming_rows_count_once(spark):
    f = files(spark, [{"id": 1, "name": "a.png"}])
    new = spark.createDataFrame([("/l/a.png", 5), ("/l/a.png", 7), ("/l/b.png", 1), ("/l/b.png", 2)], "normalized_path string, size long")
    assert sorted((r.normalized_path, r.size) for r in mutations.upsert_files(f, new, [F.col("size").desc()]).collect()) == [("/l/a.png", 7), ("/l/b.png", 2)]
    assert sorted((r.normalized_path, r.size) for r in mutations.upsert_files(f, new).collect()) == [("/l/a.png", 7), ("/l/b.png", 2)]


def test_text_search_falls_back_to_names_without_a_model(spark):
    from galena.operators import search

    f, e = similar_library(spark)
    tags = spark.createDataFrame([], SCHEMAS["tags"])
    links = spark.createDataFrame([], SCHEMAS["file_tags"])
    named = search.search_by_text(f, links, tags, e, FilterSpec(), "exact", None, configured=False)
    assert [r.id for r in named.rows.orderBy("rank").collect()] == [1, 2] and named.total == 2
    by_vector = search.search_by_text(f, links, tags, e, FilterSpec(), "x", ("clip-test", lambda t: [1.0, 0.0, 0.0]), configured=True, page_size=2)
    assert [r.id for r in by_vector.rows.orderBy("rank").collect()] == [3, 2] and (by_vector.total, by_vector.total_pages) == (4, 2)
    with pytest.raises(ValueError):
        search.search_by_text(f, links, tags, e, FilterSpec(), "x", None, configured=True)


def test_scratch_tables_go(spark, tmp_path):
    from pathlib import Path

    from galena.session import scratch, written

    with scratch(spark) as folder:
        own = Path(folder.removeprefix("file:"))
        written(written(spark.range(5)).filter("id > 1")).write.parquet(f"{tmp_path}/out")
        assert len(list(own.iterdir())) == 2
    assert not own.exists() and spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_batches_of_ids_by_spans_of_time(spark):
    """A group is no single task's, and its batches are those of session windows: across spans, ties, nulls."""
    import random

    from galena.streaming import events

    draw = random.Random(3)
    rows = [(g, draw.choice([draw.randrange(3000), 86_400 + draw.randrange(60), 500]), draw.choice("abc"), draw.random() < 0.1) for g in ("x", None, "y") for _ in range(300)] + [("z", 7, None, None), ("z", None, "a", True)]
    raw = spark.createDataFrame(rows, "group string, s long, id string, again boolean")
    for kind in ("timestamp", "timestamp_ntz"):
        table = raw.select("group", F.timestamp_seconds("s").cast(kind).alias("ts"), "id", "again")
        got = events.batches_of_ids(table, "20 seconds")
        # Spark's windows go on over a pause of just their gap, the SQL's do not
        want = table.filter("ts IS NOT NULL").groupBy("group", F.session_window("ts", "19 seconds 999999 microseconds").alias("w")).agg(F.sort_array(F.collect_set("id")).alias("ids"), F.bool_or(F.coalesce("again", F.lit(False))).alias("again"))
        known = lambda rs: sorted((str(r[0]), r[1], r[2], r[3], r[4]) for r in rs)
        assert known(got.collect()) == known(want.select("group", "w.start", F.col("w.end") + F.expr("INTERVAL 1 microsecond"), "ids", "again").collect())
        assert "Sessions" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_row_for_each_component_that_shares_groups(spark):
    """Its members times the groups would be all of both where one component holds most files."""
    exact = spark.createDataFrame([(k, f"2026-0{1 + k // 2 % 3}", k - k % 2) for k in range(200)], "id long, latest string, lead long")
    similar = spark.createDataFrame([(k, 0) for k in range(0, 200, 3)] + [(k, 1) for k in range(1, 200, 3)], "id long, component long")
    assert sorted(tuple(r) for r in vectors._first_shared(exact, similar).collect()) == [(0, "2026-02", 2), (1, "2026-03", 4)]


def test_tasks_follow_the_meetings_of_blocks(spark):
    rows = spark.range(160).select("id", F.lit("m").alias("model_id"), F.lit(2).alias("dimensions"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    pairs = vectors.similar_pairs(rows, 0.0, block=8, most_pivots=1)
    assert pairs.rdd.getNumPartitions() >= 20 * 21 / 2 / 8
    assert pairs.count() == sum(np.cos(a - b) >= 0 for a in range(160) for b in range(a))


def plain_palette(pixels):
    """One image at a time."""
    x = pixels.astype(float)
    centers = x[: min(7, len(x))].copy()
    nearest = lambda: ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
    for _ in range(20):
        own = nearest()
        moved = np.array([x[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centers)])
        shift, centers = np.sqrt(((moved - centers) ** 2).sum(axis=1)), moved
        if (shift <= 1).all():
            break
    share, colors, merged = np.bincount(nearest(), minlength=len(centers)) / len(x) * 100, np.floor(centers + 0.5), []
    for k in [k for k in np.argsort(-share, kind="stable") if share[k] > 0]:
        near = next((m for m in merged if np.sqrt(((m[0] - colors[k]) ** 2).sum()) < 30), None)
        if near is None:
            merged.append([colors[k], share[k]])
        else:
            near[1] += share[k]
    return [("#" + "".join(f"{int(c):02X}" for c in m[0]), round(float(m[1]), 2)) for m in sorted(merged, key=lambda m: -m[1])]


def test_palettes_of_a_batch(monkeypatch):
    """Images of several sizes taken together have the palettes that each has by itself, however many fit at once."""
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, (n, 3)).astype(np.uint8) // s * s for n in (1, 2, 6, 7, 8, 40, 300, 40, 8) for s in (1, 16, 64) for _ in range(6)]
    want = [plain_palette(i) for i in images]
    for room in (media.ROOM, 500):
        monkeypatch.setattr(media, "ROOM", room)
        assert media.palettes_of([None, b"", *(i.tobytes() for i in images)]) == [None, [], *want]


def test_palettes_are_dealt_to_tasks(spark, sf_dir):
    from galena.queries import QUERIES
    from galena import queries_more  # noqa: F401

    assert QUERIES["color_palettes"](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def shuffled(spark, run):
    """Bytes that ``run`` writes to shuffles."""
    from time import sleep

    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        sleep(1)  # counts arrive a moment after a job ends
        executors = store.executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    before = written()
    run()
    return written() - before


def test_vectors_are_not_sent_to_each_group_they_meet(spark):
    """Without pivots all 20 groups meet; a row goes through few shuffles, not to 20 groups."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[300] = x[7] + np.float32(0.01)
    c = spark.createDataFrame([("m", 64, k, r.tolist()) for k, r in enumerate(x)], "model_id string, dimensions int, id long, embedding array<float>")
    for links_only in (False, True):
        found = []
        sent = shuffled(spark, lambda: found.extend(vectors.similar_pairs(c, 0.9, 30, links_only, 1).collect()))  # noqa: B023
        assert [(r.a, r.b) for r in found] == [(7, 300)]
        assert sent < 8 * x.nbytes


def test_texts_are_not_shuffled_for_their_digests(spark, sf_dir):
    import pyarrow.parquet as pq

    from galena.sources.library import view

    texts = sum(len(t) for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist())
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, *wanted in (("files", "content_hash", "rating"), ("file_visual_embeddings", "source_content_hash")):
            hashes = view(spark, sf_dir, name).select(*wanted)
            sent = shuffled(spark, lambda: hashes.write.format("noop").mode("overwrite").save())  # noqa: B023
            assert sent < texts / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
