"""Token ids of whole texts by the tokenizers library, a word at a time, with the ids of words met before kept.

The word tokenizer never makes a token across white space, so a text's ids are those of its words in a row. Words are
found and hashed a batch at a time; the ids of words seen before are taken from a table of fixed size, and only the
others, each once a batch, go to the tokenizer. A word stays in the table if its place was free: common words come
early. The table's memory is bounded (about 40 MB a Python worker), however many words there are.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from . import common


class Encoder:
    """encode(column) -> (ids, first): the ids of all rows, 16 bits each, and where each row's begin (rows + 1)."""

    def __init__(self, path: str, bits: int = 21, longest: int = 16):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids over 16 bits")
        self.shift, self.longest = np.uint64(64 - bits), longest
        self.key = np.zeros(1 << bits, np.uint64)
        self.at = np.zeros(1 << bits, np.int32)
        self.size = np.zeros(1 << bits, np.uint8)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def _ids(self, words: list[str], some: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one word after the other, and how many each has: many words are one text, whose offsets tell them apart."""
        ids, size = [], []
        for k in range(0, len(words), some):
            part = words[k : k + some]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *map(len, part)])[:-1] + np.arange(len(part))
            begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
            ids.append(np.array(found.ids, np.uint16))
            size.append(np.bincount(np.searchsorted(starts, begins, side="right") - 1, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(size)

    def _learn(self, words: list[str], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of new words at the pool's end and keeps those that fit the table: (where each word's are, how many)."""
        flat, size = self._ids(words)
        place = (h >> self.shift).astype(np.int64)
        kept = (self.key[place] == 0) & (size <= self.longest)
        kept &= np.isin(np.arange(len(h)), np.unique(np.where(kept, place, -1), return_index=True)[1])
        # kept words first: what is behind them may be overwritten
        order = np.argsort(~kept, kind="stable")
        start = np.empty(len(h), np.int64)
        start[order] = self.used + np.cumsum(size[order]) - size[order]
        need = self.used + len(flat)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(need - self.used + (need >> 2), np.uint16)])
        self.pool[np.arange(len(flat)) + np.repeat(start - np.cumsum(size) + size, size)] = flat
        self.key[place[kept]], self.at[place[kept]], self.size[place[kept]] = h[kept], start[kept], size[kept]
        self.used += int(size[kept].sum())
        return start, size

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        raw, starts, ends, first = common.word_places(column)
        h = np.maximum(common.word_hashes(raw, starts, ends), np.uint64(1))
        place = (h >> self.shift).astype(np.int64)
        at, size = self.at[place].astype(np.int64), self.size[place].astype(np.int64)
        miss = np.flatnonzero(self.key[place] != h)
        if len(miss):
            new, one, which = np.unique(h[miss], return_index=True, return_inverse=True)
            text = raw.tobytes()
            words = [text[a:b].decode() for a, b in zip(starts[miss[one]].tolist(), ends[miss[one]].tolist())]
            new_at, new_size = self._learn(words, new)
            at[miss], size[miss] = new_at[which], new_size[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.arange(upto[-1]) + np.repeat(at - upto[:-1], size)]
        return ids, upto[first]


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)
