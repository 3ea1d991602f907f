"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces in a word; dynamic
programming keeps, for each end, the best score and how many pieces its path
has, never the pieces. Ties and unknowns follow the unigram model of the
``tokenizers`` library: at an end the earliest start wins unless a later one
scores strictly more; a character that no one-character piece matches may be
unknown, at the lowest score less ten; unknowns in a row are one piece.

Words never share a piece (each starts with the space mark), so counts are
kept by word. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from galena.llm.common import batches_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"


def unigram_vocabulary(path: str = PIECES) -> list[tuple[str, float]]:
    """Pieces of a SentencePiece file in rank order, scored by Zipf's law; the first is the unknown piece."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), -log(k + 1)) for k in range(model.get_piece_size())]


class WordCounts(dict):
    """Number of pieces of a word; keeps up to ``room`` words."""

    def __init__(self, vocabulary: list[tuple[str, float]], room: int = 1_000_000):
        from ahocorasick import Automaton

        super().__init__()
        self.automaton, self.room = Automaton(), room
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - 10.0

    def __missing__(self, word: str) -> int:
        count = self.viterbi(word)[1]
        if len(word) <= 40:
            if len(self) >= self.room:
                self.clear()
            self[word] = count
        return count

    def viterbi(self, word: str) -> tuple[float, int]:
        """Best score and its number of pieces."""
        n = len(word)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, best = 0, None

        def settle(end: int, best: tuple[float, int] | None, single: bool) -> None:
            """``best`` is (score, start) over pieces ending at ``end``."""
            if not single and (best is None or score[end - 1] + self.unknown > best[0]):
                score[end], count[end], unknown[end] = score[end - 1] + self.unknown, count[end - 1] + (not unknown[end - 1]), True
            else:
                score[end], count[end] = best[0], count[best[1]] + 1

        single = False
        for last, (length, own) in self.automaton.iter(word):  # of one end, longest pieces first
            end = last + 1
            while at < end - 1:
                at += 1
                settle(at, best, single)
                best, single = None, False
            total = score[end - length] + own
            if best is None or total > best[0]:
                best = (total, end - length)
            single = single or length == 1
        while at < n:
            at += 1
            settle(at, best, single)
            best, single = None, False
        return score[n], count[n]

    def of(self, text: str) -> int:
        """Pieces of a text: a mark for each space, one before the first word unless there is one."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        return sum(map(self.__getitem__, [MARK + w for w in (words[1:] if not words[0] else words)]))


@cache
def _counts(path: str) -> WordCounts:
    return WordCounts(unigram_vocabulary(path))


def token_counts(docs: DataFrame, path: str = PIECES) -> DataFrame:
    """Return doc_id, n_chars (code points) and n_tokens for every row of ``docs``.

    Null and empty texts have no token; texts may be of any length. Rows that
    repeat a doc_id or lack one are counted like others. An empty table gives
    an empty result; further columns, of whatever names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counts(path).of
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [np.array(list(map(f, texts)), np.int64) for f in (len, of)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts)], names=["doc_id", "n_chars", "n_tokens"])

    return batches_of(docs.select("doc_id", "text"), run, "doc_id long, n_chars long, n_tokens long")
