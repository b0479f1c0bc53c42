"""Edit-aware token counts: a table of segment trees of token counts, one a document, updated where edits touch them.

build() encodes each document once and keeps its tree as a row: the leaves' texts and the sums. edit() takes such a
table and gives the next one, encoding nothing but the leaves that edits touch; the count of a document is its tree's root.

A text is cut into leaves at places where no token of the byte-level tokenizer can cross: before a space that stands
between a sign that isn't white space and one that isn't either (the space belongs to the word after it). A leaf has
about ``leaf`` characters. The tree holds the sum of each pair of nodes below; its last row is the leaves' counts.

An edit changes the leaves it lies in, and the leaf before or after where it comes within two characters of their
border, since the cut there may no longer hold. Only their text is cut and encoded again; the sums above them follow, and are
added up anew (from the leaves' counts) if the number of leaves changes.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


class Counter:
    """How many tokens texts have. Words and what is around them up to single spaces are counted once a worker, then looked up."""

    def __init__(self, code, most: int = 500_000):
        self.code, self.most = code, most
        self.spaced: dict[str, int] = {}  # by the word after a space
        self.uneven = re.compile(r" \s|\s |\s\Z").search

    def __call__(self, texts: list[str]) -> list[int]:
        known, out = self.spaced, []
        split = [None if self.uneven(x) else x.split(" ") for x in texts]
        new = list({w for ws in split if ws for w in ws[1:]}.difference(known))
        fresh = {w: len(self.code.encode_ordinary(" " + w)) for w in new}
        if len(known) < self.most:
            known.update(fresh)
            fresh = known
        elif new:
            fresh = fresh | {w: known[w] for ws in split if ws for w in ws[1:] if w in known}
        else:
            fresh = known
        for x, ws in zip(texts, split):
            if ws is None:
                out.append(len(self.code.encode_ordinary(x)))
            else:
                out.append((len(self.code.encode_ordinary(ws[0])) if ws[0] else 0) + sum(map(fresh.__getitem__, ws[1:])))
        return out


@cache
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(tokenizer(path))


def tokenizer(path: str):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("edits", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, leaf: int) -> list[int]:
    """Where leaves begin, the first at 0."""
    out, at = [0], leaf
    while True:
        at = text.find(" ", at)
        if at < 0 or at + 1 >= len(text):
            return out
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            out.append(at)
            at += leaf
        else:
            at += 1


class Tree:
    """Leaves' texts and the sums of their counts: node k has children 2 k and 2 k + 1, leaves begin at half the nodes."""

    def __init__(self, texts: list[str], sums: np.ndarray, leaf: int):
        self.texts, self.sums, self.leaf, self.encoded = texts, sums, leaf, 0

    @classmethod
    def of(cls, text: str, count, leaf: int = 512) -> Tree:
        texts = cls._leaves(text, leaf)
        return cls(texts, cls._added(np.array(count(texts), np.int64)), leaf)

    @staticmethod
    def _leaves(text: str, leaf: int) -> list[str]:
        starts = cuts(text, leaf) if text else []
        return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]

    @staticmethod
    def _added(counts: np.ndarray) -> np.ndarray:
        size = 1 << max(0, (len(counts) - 1).bit_length())
        sums = np.zeros(2 * size, np.int64)
        sums[size : size + len(counts)] = counts
        while size > 1:
            sums[size // 2 : size] = sums[size : 2 * size].reshape(-1, 2).sum(axis=1)
            size //= 2
        return sums

    @property
    def size(self) -> int:
        return len(self.sums) // 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def _set(self, k: int, n: int) -> None:
        k += self.size
        change = n - self.sums[k]
        while k:
            self.sums[k] += change
            k >>= 1

    def _replace(self, low: int, high: int, region: str, count) -> None:
        """Leaves low to high - 1 become those of ``region``."""
        new = self._leaves(region, self.leaf)
        counts = count(new)
        self.encoded += len(new)
        if len(new) == high - low:
            self.texts[low:high] = new
            for k, n in enumerate(counts, low):
                self._set(k, int(n))
        else:
            old = self.sums[self.size : self.size + len(self.texts)]
            self.texts[low:high] = new
            self.sums = self._added(np.concatenate([old[:low], np.array(counts, np.int64), old[high:]]))

    def edit(self, at: int, removed: int, inserted: str, count) -> None:
        """Replaces ``removed`` characters from ``at`` by ``inserted``; places beyond the text are its end."""
        if not self.texts:
            return self._replace(0, 0, inserted, count)
        ends = np.cumsum([len(x) for x in self.texts])
        at = min(max(at, 0), int(ends[-1]))
        to = min(at + max(removed, 0), int(ends[-1]))
        low = min(int(np.searchsorted(ends, max(at - 2, 0), side="right")), len(ends) - 1)
        high = max(low, min(int(np.searchsorted(ends, to + 2, side="right")), len(ends) - 1))
        begin = int(ends[low - 1]) if low else 0
        region = "".join(self.texts[low : high + 1])
        region = region[: at - begin] + inserted + region[to - begin :]
        # the region's borders must still be cuts: else take in the leaf beyond
        while low and not self._cut(self._before(low), region):
            low -= 1
            region = self.texts[low] + region
        while high + 1 < len(self.texts) and not self._cut(region, self._after(high)):
            high += 1
            region += self.texts[high]
        self._replace(low, high + 1, region, count)

    def _before(self, k: int) -> str:
        """The end of the text before leaf k."""
        while k and not self.texts[k - 1]:
            k -= 1
        return self.texts[k - 1][-1:] if k else ""

    def _after(self, k: int) -> str:
        """Two characters after leaf k."""
        out = ""
        while len(out) < 2 and k + 1 < len(self.texts):
            k += 1
            out += self.texts[k][: 2 - len(out)]
        return out

    @staticmethod
    def _cut(left: str, right: str) -> bool:
        """Whether no token crosses: nothing on a side, or a space between two signs that aren't white space."""
        return not left or not right or right[0] == " " and not left[-1].isspace() and len(right) > 1 and not right[1].isspace()


def build(docs: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 512) -> DataFrame:
    """(doc_id, n_chars, n_tokens, leaves, sums) of each row: its tree, as a table in the shared folder.

    Null texts are empty: no leaves, the sums are 0. Repeated rows have trees each. An empty table gives an empty one;
    other columns don't matter, whatever their names.
    """
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches):
        count = counter(tokenizer_path)
        for whole in batches:
            for b in common.slices(whole, "text"):
                trees = [Tree.of(x or "", count, leaf) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), *_columns(trees)], ["doc_id", *TREE])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return common.staged(common.arrow_map(d, run, f"doc_id {kind}, {TREE_SCHEMA}"), "trees")


TREE = ("n_chars", "n_tokens", "leaves", "sums")
TREE_SCHEMA = "n_chars bigint, n_tokens bigint, leaves array<string>, sums array<bigint>"


def _columns(trees: list[Tree]) -> list[pa.Array]:
    return [
        pa.array([sum(map(len, t.texts)) for t in trees], pa.int64()),
        pa.array([t.total for t in trees], pa.int64()),
        pa.array([t.texts for t in trees], pa.list_(pa.string())),
        pa.array([t.sums for t in trees], pa.list_(pa.int64())),
    ]


def edit(trees: DataFrame, edits: Column, *, tokenizer_path: str, leaf: int = 512) -> DataFrame:
    """The trees of build() or edit() after edits: its columns, with n_edits, n_before (tokens) and n_encoded (leaves encoded again).

    ``edits`` is an array of (at, removed, inserted) over the trees' columns, done in order, each on the text the one
    before left. Null edits are none; null fields of an edit are 0 and ''. Trees without edits pass as they are.
    """
    kind = dict(trees.dtypes)["doc_id"]

    def run(batches):
        count = counter(tokenizer_path)
        for whole in batches:
            for k in range(0, len(whole), 256):
                b = whole.slice(k, 256)
                made, before, n = [], b.column(1), []
                sums = b.column(3)
                for i, (leaves, todo) in enumerate(zip(b.column(2).to_pylist(), b.column(4).to_pylist())):
                    tree = Tree(leaves, np.array(sums[i].values), leaf)
                    for e in todo or ():
                        tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "", count)
                    made.append(tree)
                    n.append(len(todo or ()))
                done = pa.array(n, pa.int64()), before, pa.array([t.encoded for t in made], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), *_columns(made), *done], ["doc_id", *TREE, "n_edits", "n_before", "n_encoded"])

    d = trees.select("doc_id", "n_tokens", "leaves", "sums", edits.alias("edits"))
    return common.arrow_map(d, run, f"doc_id {kind}, {TREE_SCHEMA}, n_edits bigint, n_before bigint, n_encoded bigint")


def sample_edits(n: Column, head: Column) -> Column:
    """Three edits that follow from a text's length and beginning: a deletion at a third, an insertion at two thirds, and a change of the end."""
    edit = lambda at, removed, inserted: F.struct(at.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    return F.array(edit(F.floor(n / 3), 17, F.lit("")), edit(F.floor(n * 2 / 3), 0, F.coalesce(F.substring(head, 1, 40), F.lit(""))), edit(F.greatest(n - 5, F.lit(0)), 9, F.lit(" the  end.\n")))
