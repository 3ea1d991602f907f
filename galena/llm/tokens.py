"""Token ids of whole texts with a public word-level BPE, cached by word.

Ids are kept as native 32-bit unsigned integers, little-endian on all machines
that Spark's Arrow exchange supports.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import public_tokenizers

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Latin letters, then ASCII punctuation other than an apostrophe: words that need no normaliser but lower case.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class Parts(dict):
    """Ids (little-endian uint32 bytes) by key, made by ``make``; starts anew past ``room`` keys."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key: str) -> bytes:
        ids = array("I", self.make(key)).tobytes()
        if len(key) <= 40:
            if len(self) >= self.room:
                self.clear()
            self[key] = ids
        return ids


class WordIds(dict):
    """Maps a word to its ids, little-endian uint32 bytes.

    The tokenizer drops white space and never joins pieces across it, so the
    ids of a text are those of its words in order. It also parts letters from
    punctuation: plain words are cached as the two. ``room`` bounds the entries
    of each cache; past it the cache starts anew.
    """

    def __init__(self, path: str = WORD_BPE, room: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        whole = Tokenizer.from_file(path)
        model, bytes_of = whole.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def letters(word: str) -> list[int]:
            mapped = word if word.isascii() else bytes_of.pre_tokenize_str(word)[0][0]
            return [t.id for t in model.tokenize(mapped)]

        def full(word: str) -> list[int]:
            return whole.encode(word, add_special_tokens=False).ids

        self.letters, self.other, self.room = Parts(letters, room), Parts(full, room), room

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain is None:
            return self.other[word]
        ids = self.letters[plain[1].lower()]
        if plain[2]:
            ids += self.other[plain[2]]
        if len(word) <= 40:
            if len(self) >= self.room // 2:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


@cache
def word_ids(path: str = WORD_BPE) -> WordIds:
    """One cache for all tasks of a Python worker: at most about 150 MB."""
    return WordIds(path)
