"""Directly addressable codes: round trips, access by place, commits and aborts."""

import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from galena.llm import token_files
from galena.llm.tokens import WORD_BPE

SCHEMA = "doc_id long, text string, start long, n_tokens long, ids string, source string"
LONG = "an endless tale of letters, again and again " * 20_000
TEXTS = [(5, "Second text."), (2, "First text, é日本"), (2, "First text, é日本"), (2, "another of the same id"), (None, None), (9, ""), (None, "no id"), (12, LONG), (-3, " \n "), *[(40, "copy")] * 300]


def plain():
    whole = Tokenizer.from_file(WORD_BPE)
    return [(i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("bits", [3, 8, 12, 16, 20])
def test_codes(tmp_path, bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, [1 << b for b in rng.integers(1, 33, 5000)], dtype="uint64").astype("uint32")
    lengths = [0, 1, 1500, 2499, 0, 1000]
    (tmp_path / "x.dac").write_bytes(token_files.encoded([4, None, 6, 7, 8, -9], lengths, ids, bits))
    with token_files.TokenFile(str(tmp_path / "x.dac")) as file:
        assert (file.ids(0, 5000) == ids).all()
        for a, b in [(0, 0), (0, 1), (511, 514), (777, 3333), (4999, 5000), (5000, 5000)]:
            assert (file.ids(a, b) == ids[a:b]).all()
        assert [int(file.ids(k, k + 1)[0]) for k in range(0, 5000, 37)] == ids[::37].tolist()
        for room in (1, 2000, 1 << 20):
            rows = [tuple(r.values()) for b in file.batches(70, room) for r in b.to_pylist()]
            starts = np.cumsum([0, *lengths])
            assert rows == [(d, 70 + int(s), ids[s : s + n].astype("<u4").tobytes()) for d, s, n in zip([4, None, 6, 7, 8, -9], starts, lengths, strict=False)]


def test_report(docs, spark):
    got = token_files.token_report(docs, file_ids=1000)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=key) == sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in plain()), key=key)
    assert token_files.token_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tokens_at(docs, spark, tmp_path):
    folder = f"{tmp_path}/t"
    token_files.write_ids(docs, folder, file_ids=5000, bits=7)
    rows = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r.start)
    ids = np.frombuffer(b"".join(r.ids for r in rows), "<u4")
    places = [0, 1, 17, len(ids) // 2, len(ids) - 1, len(ids), -1, None, 17]
    got = token_files.tokens_at(spark.createDataFrame([(p, 0) for p in places], "place long, id long"), folder).collect()
    assert {r.place: r.id for r in got} == {p: int(ids[p]) if p is not None and 0 <= p < len(ids) else None for p in places}
    assert len(got) == len(places)


def test_only_files_of_the_commit_stay(tmp_path):
    writer = token_files.TokenWriter({"path": f"file:{tmp_path}"})
    for name in ("a.dac", "b.dac", "lost.dac"):
        (tmp_path / name).write_bytes(b"x")
    writer.commit([token_files.Files(2, [("b.dac", 1, 7, 1)]), None, token_files.Files(0, [("a.dac", 2, 5, 1)])])
    assert {p.name for p in Path(tmp_path).iterdir()} == {"a.dac", "b.dac", "manifest.json"}
    assert [(e["file"], e["start"]) for e in map(json.loads, (tmp_path / "manifest.json").read_text().splitlines())] == [("a.dac", 0), ("b.dac", 5)]
    writer.abort([None])
    assert not list(tmp_path.iterdir())
    (tmp_path / "bad.dac").write_bytes(b"not a token file")
    with pytest.raises(ValueError, match="no token file"):
        token_files.TokenFile(str(tmp_path / "bad.dac"))
