"""Directory trees, their changes, and contents by key."""

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from galena.sources import contents, listing, scan


@pytest.fixture
def made(tmp_path):
    root = tmp_path / "tree"
    for name in ("a/b/c", "a/.hidden/x", "empty/below", "d"):
        (root / name).mkdir(parents=True)
    for name, data in {"a/1.txt": b"1", "a/b/c/2.jpg": b"\xff\xd8\xff2", "a/.hidden/x/3.png": b"3", "d/.4.png": b"4", "5.bin": b""}.items():
        (root / name).write_bytes(data)
    os.symlink(root / "a", root / "d" / "loop")
    return root


def below(rows, root):
    return sorted((r.kind, r.path.removeprefix(f"{root}/"), r.size) for r in rows)


@pytest.mark.parametrize("splits", [1, 3, 64])
def test_tree(spark, made, splits):
    got = below(listing.tree(spark, f"file:{made}", splits=splits).collect(), made)
    assert got == [("dir", "a", None), ("dir", "a/b", None), ("dir", "a/b/c", None), ("dir", "d", None), ("dir", "empty", None), ("dir", "empty/below", None), ("file", "5.bin", 0), ("file", "a/1.txt", 1), ("file", "a/b/c/2.jpg", 4)]
    hidden = below(listing.tree(spark, str(made), hidden=True, splits=splits).collect(), made)
    assert [x for x in hidden if x not in got] == [("dir", "a/.hidden", None), ("dir", "a/.hidden/x", None), ("file", "a/.hidden/x/3.png", 1), ("file", "d/.4.png", 1)]
    assert sorted(r.path.removeprefix(f"{made}/") for r in scan.folders(spark, str(made)).collect()) == ["a", "a/b", "a/b/c", "d", "empty", "empty/below"]


def test_no_folder_and_an_empty_one(spark, tmp_path):
    assert listing.tree(spark, f"{tmp_path}/none").count() == 0
    assert listing.tree(spark, str(tmp_path)).count() == 0
    assert scan.directory(spark, str(tmp_path)).count() == 0


def test_data_folder_against_another_engine(spark, duck, sf_dir):
    root = str(Path(sf_dir).parent)
    want = {p for (p,) in duck.execute(f"SELECT file FROM glob('{root}/**')").fetchall()}
    got = listing.tree(spark, root).filter("kind = 'file'").collect()
    assert {r.path for r in got} == want and len(got) == len(want)
    assert all(r.size == os.path.getsize(r.path) for r in got)


@pytest.mark.parametrize("splits", [1, 3, 64])
@pytest.mark.parametrize("hidden", ["true", "false"])
def test_wide_folders_are_dealt_by_name(made, monkeypatch, splits, hidden):
    """The driver deals out no entries of a folder with many; tasks take them by their names, each once."""
    for k in range(30):
        (made / f"a/wide{k}/below").mkdir(parents=True)
        (made / f"a/wide{k}/below/{k}.txt").write_bytes(b"x")
    os.symlink(made / "d", made / "a" / "link")
    reader = listing.TreeReader({"path": str(made), "splits": str(splits), "hidden": hidden})
    paths = lambda parts: sorted(p for part in parts for b in reader.read(part) for p in b.column("path").to_pylist())
    want = paths(reader.partitions())
    monkeypatch.setattr(listing, "WIDE", 6, raising=False)
    parts = reader.partitions()
    assert paths(parts) == want and len(set(want)) == len(want) >= 90
    assert len({f for part in parts for f in part.whole + part.own}) < 20


def test_shares_of_a_folder_elsewhere(made, monkeypatch):
    """A store that is not the local one lists a folder whole, and has the same shares."""
    from pyarrow import fs

    local, other = fs.LocalFileSystem(), fs.SubTreeFileSystem(str(made), fs.LocalFileSystem())
    monkeypatch.setattr(listing, "WIDE", 2)
    assert listing.is_wide(local, str(made)) and listing.is_wide(other, "") and not listing.is_wide(local, f"{made}/none") and not listing.is_wide(other, "none")
    for store, folder in ((local, str(made)), (other, "")):
        shares = [[i.base_name for i in listing.share_of(store, folder, False, k, 3)] for k in range(3)]
        assert sorted(n for s in shares for n in s) == ["5.bin", "a", "d", "empty"]
    assert listing.share_of(local, f"{made}/none", False, 0, 1) == []


def test_files_are_dealt_to_tasks_by_number(spark, tmp_path):
    """Rows of a few bytes come in one task and are few bytes to a shuffle, but as many files as large ones."""
    rows = spark.range(400).selectExpr("concat('d', id % 7, '/', id) AS path", "cast('x' AS binary) AS content").coalesce(1)
    spark.sparkContext.setJobGroup("written", "")
    try:
        assert listing.write_files(rows, str(tmp_path)) == 400
        spark.sparkContext.setJobGroup("copied", "")
        paths = [F.concat(F.lit(f"{tmp_path}{top}"), "path") for top in ("/", "/copy/")]
        assert listing.copy_files(rows.select(paths[0].alias("source"), paths[1].alias("target"))) == 400
        spark.sparkContext.setJobGroup("removed", "")
        assert listing.remove_files(rows.select("path"), f"{tmp_path}/copy") == 400
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    for group in ("written", "copied", "removed"):
        stages = [status.getStageInfo(k) for j in status.getJobIdsForGroup(group) for k in status.getJobInfo(j).stageIds]
        assert max(s.numCompletedTasks for s in stages if s) == 4
    found = listing.with_heads(listing.tree(spark, str(tmp_path)).filter("kind = 'file'"))
    assert found.rdd.getNumPartitions() == 4 and {bytes(r.head) for r in found.collect()} == {b"x"}


def test_heads_longer_than_the_first_read(spark, tmp_path):
    for n in (0, 4095, 4096, 4097, 9000):
        (tmp_path / f"{n}.bin").write_bytes(bytes(k % 251 for k in range(n)))
    for size in (10, 4096, 4097, 6000, 1 << 20):
        got = listing.with_heads(listing.tree(spark, str(tmp_path)), size).collect()
        assert {r.size: bytes(r.head) for r in got} == {n: bytes(k % 251 for k in range(min(n, size))) for n in (0, 4095, 4096, 4097, 9000)}


def test_heads_read_no_more(spark, tmp_path):
    """A file of 50 GB, all holes, would take minutes to read whole; one that went is null."""
    with open(tmp_path / "large.jpg", "wb") as file:
        file.write(b"\xff\xd8\xff\xe0")
        file.truncate(50 << 30)
    began = time.time()
    (row,) = listing.with_heads(listing.tree(spark, str(tmp_path))).collect()
    assert row.size == 50 << 30 and row.head == b"\xff\xd8\xff\xe0" + bytes(4092) and time.time() - began < 30
    assert [(r.ext, r.size) for r in scan.directory(spark, str(tmp_path)).collect()] == [("jpg", 50 << 30)]
    gone = spark.createDataFrame([(f"{tmp_path}/none",)], "path string")
    assert listing.with_heads(gone).first().head is None


def told(reader, start, end):
    parts = reader.partitions({"listing": start}, {"listing": end})
    return sorted((r[1], r[0].rpartition("/tree/")[2], r[3]) for p in parts for r in reader.read(p))


@pytest.mark.parametrize("depth", [1, 2])
def test_changes(made, tmp_path, depth):
    make = lambda **more: listing.ChangeReader({"path": f"file:{made}", "state": f"{tmp_path}/s{len(more)}", "buckets": "3", "depth": str(depth), **more})
    reader = make()
    assert reader.latestOffset() == {"listing": 1} and told(reader, 0, 1) == []  # what is there at first is silent
    assert [k for k, *_ in told(make(initial="true"), 0, 1)].count("add") == 3
    assert reader.latestOffset() == {"listing": 2}
    (made / "a/1.txt").write_bytes(b"11")
    (made / "a/b/c/2.jpg").unlink()
    (made / "a/b/c").rmdir()
    (made / "new/n").mkdir(parents=True)
    (made / "new/n/6.png").write_bytes(b"666")
    (made / ".7").write_bytes(b"7")
    (made / "5.bin").unlink()
    (made / "5.bin").mkdir()
    want = [("add", "new/n/6.png", 3), ("addDir", "5.bin", None), ("addDir", "new", None), ("addDir", "new/n", None), ("change", "a/1.txt", 2), ("unlink", "5.bin", None), ("unlink", "a/b/c/2.jpg", None), ("unlinkDir", "a/b/c", None)]
    assert told(reader, 1, 2) == want
    (made / "a/1.txt").unlink()
    again = make()  # a batch that runs once more, later, tells the same
    assert told(again, 1, 2) == want and again.latestOffset() == {"listing": 3}
    assert told(again, 2, 3) == [("unlink", "a/1.txt", None)]
    again.commit({"listing": 3})
    assert sorted(os.listdir(tmp_path / "s0")) == ["2", "3"]
    assert told(again, 3, 4) == []


def test_contents(spark, tmp_path):
    folder = f"file:{tmp_path}/store"
    rows = [("k1", b"one"), ("k1", b"one"), ("a/../b", b"slash"), ("", b"none"), (None, b"none"), ("k2", None)]
    contents.put_contents(spark.createDataFrame(rows, "key string, content binary").repartition(3), folder)
    contents.put_contents(spark.createDataFrame([("k1", b"other"), ("k3", b"")], "key string, content binary"), folder)
    files = [p for p in (tmp_path / "store").rglob("*") if p.is_file()]
    assert sorted(p.read_bytes() for p in files) == [b"", b"one", b"slash"]  # what is there stays
    keys = spark.createDataFrame([("k1", None), ("a/../b", "k3"), ("none", None), (None, None)], "key string, legacy string")
    assert [r.at is not None for r in contents.contents_of(keys, folder).collect()] == [True, True, False, False]
    assert contents.remove_contents(keys, folder) == 3
    assert not [p for p in (tmp_path / "store").rglob("*") if p.is_file()]


def test_attempts_that_do_not_count_leave_nothing(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    make = lambda job: contents.ContentWriter({"path": str(tmp_path), "job": job})
    batch = lambda *k: iter([pa.RecordBatch.from_pydict({"key": list(k), "content": [x.encode() for x in k]})])
    writer = make("j1")
    writer.write(batch("a", "b"))  # lost
    first, second = writer.write(batch("a", "b")), writer.write(batch("c", "a"))
    writer.commit([first, None, second])
    lost = make("j2")
    lost.abort([lost.write(batch("d"))])
    assert contents.publish(spark, str(tmp_path)) == 2
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.webp", "b.webp", "c.webp"]
    assert contents.publish(spark, str(tmp_path)) == 0


def test_write_and_remove(spark, tmp_path):
    rows = spark.createDataFrame([("x/1", b"1"), ("x/2", b""), ("y", None), (None, b"0")], "path string, content binary")
    assert listing.write_files(rows, f"file:{tmp_path}/t/") == 3
    assert below(listing.tree(spark, f"{tmp_path}/t").collect(), f"{tmp_path}/t") == [("dir", "x", None), ("dir", "y", None), ("file", "x/1", 1), ("file", "x/2", 0)]
    assert listing.remove_files(rows.select(F.col("path")), f"{tmp_path}/t") == 2


def test_contents_are_staged_in_small_batches_and_folders(tmp_path, monkeypatch):
    """A task stages into folders of a few files, remembers the keys of one, and publishing lists one at a time."""
    import pyarrow as pa

    monkeypatch.setattr(contents, "FILES", 4, raising=False)
    writer = contents.ContentWriter({"path": str(tmp_path), "job": "j"})
    rows = [pa.RecordBatch.from_pydict({"key": [f"k{k % 10}", None, ""], "content": [b"%d" % (k % 10), b"x", b"x"]}) for k in range(12)]
    staged = writer.write(iter(rows))
    sizes = [len(list(d.iterdir())) for d in sorted((tmp_path / staged.folder).iterdir())]
    assert sizes == [4, 4, 4] and staged.files == 12


def test_small_batches_end(spark):
    before = spark.conf.get(contents.RECORDS)
    with contents.small_batches(spark, 7):
        largest = spark.range(100).mapInArrow(lambda bs: (b for b in bs if b.num_rows > 7), "id long").count()
    assert largest == 0 and spark.conf.get(contents.RECORDS) == before
