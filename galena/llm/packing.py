"""Sequence packing by the dot-product heuristic for vector bin packing.

Every example is a vector (tokens, segments, loss-bearing tokens). A bin takes,
again and again, the example whose vector has the largest dot product with
what the bin has left, among those that fit in every dimension. When none
fits whole, the best one is cut to fill the bin, which the contract allows.

Examples are packed where they are read: no shuffle, and a task holds a pool
of at most ``pool`` examples. A task's last bins, and bins closed by another
limit than tokens, are cut into sequences whose lengths are powers of two, so
they need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from galena.llm.common import batches_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs examples of one task; ``out`` holds finished pieces as tuples.

    An example is [doc_id, ids, loss, start, tokens]: ids are uint32 bytes,
    loss is None (all tokens bear loss) or the running count of loss-bearing
    tokens, with a leading 0.
    """

    def __init__(self, limits: tuple[int, int, int], pool: int, min_piece: int, first_id: int):
        self.limits, self.pool, self.min_piece = np.array(limits, float), pool, min_piece
        self.items: list[list] = []
        self.vectors = np.empty((0, 3))
        self.next_id, self.out = first_id, []

    @staticmethod
    def vector(item: list) -> tuple[int, int, int]:
        _, _, loss, start, tokens = item
        return tokens, 1, tokens if loss is None else int(loss[start + tokens] - loss[start])

    def add(self, doc_id: int | None, ids: bytes, loss: np.ndarray | None = None) -> None:
        item = [doc_id, ids, loss, 0, len(ids) // 4]
        most = int(min(self.limits[0], self.limits[2]))
        while item[4] >= most and self.fits(item, most):
            self.close([self.cut(item, most)])
        if item[4]:
            self.items.append(item)
        if len(self.items) >= 2 * self.pool:
            self.pack(self.pool)

    def fits(self, item: list, tokens: int) -> bool:
        return bool((np.array(self.vector([*item[:4], tokens])) <= self.limits).all())

    @staticmethod
    def cut(item: list, tokens: int) -> list:
        """Take ``tokens`` off the front of ``item``."""
        piece = [*item[:4], tokens]
        item[3] += tokens
        item[4] -= tokens
        return piece

    def pack(self, keep: int) -> None:
        """Fill bins until at most ``keep`` examples are left."""
        live = [x for x in self.items if x[4]]
        size = np.array([self.vector(x) for x in live], float).reshape(-1, 3)
        used, left = np.zeros(len(live), bool), len(live)
        while left > keep:
            room, bin_ = self.limits.copy(), []
            while True:
                fit = ~used & (size <= room).all(axis=1)
                if fit.any():
                    score = (size / self.limits) @ (room / self.limits)
                    score[~fit] = -1
                    k = int(score.argmax())
                    bin_.append(live[k])
                    used[k] = True
                    left -= 1
                    room -= size[k]
                    continue
                gap = int(min(room[0], room[2]))
                if left == 0 or room[1] < 1 or gap < self.min_piece and bin_:
                    break
                score = np.where(used, -1, (size / self.limits) @ (room / self.limits))
                k = int(score.argmax())
                piece = self.cut(live[k], min(gap, live[k][4] - 1) if live[k][4] > 1 else 1)
                bin_.append(piece)
                room -= self.vector(piece)
                size[k] = self.vector(live[k])
                if not live[k][4]:
                    used[k] = True
                    left -= 1
            self.close(bin_)
        self.items = [x for x, u in zip(live, used, strict=True) if not u]

    def close(self, bin_: list[list]) -> None:
        """Number a bin. One not full is cut into sequences of power-of-two length."""
        total, full = sum(x[4] for x in bin_), int(self.limits[0])
        if full - total < self.min_piece:
            return self.emit(bin_)
        rest = [list(x) for x in bin_]
        while total:
            want, own = 1 << (total.bit_length() - 1), []
            total -= want
            while want:
                n = min(want, rest[0][4])
                own.append(self.cut(rest[0], n))
                want -= n
                if not rest[0][4]:
                    rest.pop(0)
            self.emit(own)

    def emit(self, bin_: list[list]) -> None:
        at = 0
        for doc_id, ids, _, start, tokens in bin_:
            self.out.append((doc_id, start, tokens, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + tokens)]), len(ids) // 4, self.next_id, at))
            at += tokens
        self.next_id += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[]] * 7
        self.out = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[dict], tuple[bytes, np.ndarray | None]]],
    columns: list[str],
    max_tokens: int = 4096,
    max_segments: int = 512,
    max_loss: int = 4096,
    pool: int = 1024,
    min_piece: int = 8,
) -> DataFrame:
    """Pack every row of ``docs`` into sequences; one result row per piece.

    ``encoder()`` is called once per task and returns a function from a row
    (doc_id and ``columns``, as a dict) to (ids as uint32 bytes, loss), where
    loss is None or the running count of loss-bearing tokens with a leading 0.
    An example without tokens has no piece; null and empty texts have those of
    their end. Texts may be of any length: what fills a sequence by itself is
    cut off first, the rest is packed. Null ids, ties and repeated rows need
    no care: each row is packed by itself, and ``start`` counts within it. Of
    examples with equal scores the first read goes first. An empty table gives
    no piece; further columns, of whatever names, are ignored.
    sequence_id holds the task's number above bit 32, so reruns over the same
    partitions agree. Memory per task: ``2 * pool`` examples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        packer = Packer((max_tokens, max_segments, max_loss), pool, min_piece, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for row in batch.to_pylist():
                packer.add(row["doc_id"], *encode(row))
            yield packer.batch()
        packer.pack(0)
        yield packer.batch()

    return batches_of(docs.select("doc_id", *columns), run, SCHEMA)


def document_encoder(path: str, end_id: int):
    """Encoder of whole texts: ids of the text, then ``end_id``; all tokens bear loss."""

    def make():
        from galena.llm.tokens import word_ids

        words, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        return lambda row: (words.of(row["text"]) + end, None)

    return make


def chat_encoder(path: str, end_id: int, roles: tuple[str, ...] = ("assistant",)):
    """Encoder of conversations (``turns``: array of struct role, text): only ``roles`` bear loss."""

    def make():
        from galena.llm.tokens import word_ids

        words, end = word_ids(path), np.array([end_id], "<u4").tobytes()

        def encode(row: dict) -> tuple[bytes, np.ndarray]:
            parts = [(words.of(t["text"]) + end, t["role"] in roles) for t in row["turns"] or [] if t]
            mask = np.concatenate([np.zeros(1, int), *(np.full(len(b) // 4, int(on)) for b, on in parts)])
            return b"".join(b for b, _ in parts), np.cumsum(mask)

        return encode

    return make
