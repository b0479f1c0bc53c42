"""What the corpus operators share: the word rule, Arrow maps, and word hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.tables import Scratch, shared_dir, staged  # noqa: F401

#: The white space of the word rule: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores where a column of ``df`` has one already (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow of a generator function; a task's end gives freed memory back, since Python workers live on."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(held, schema)


def release() -> None:
    """Gives memory that Arrow and the allocator keep for later back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def word_count(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(inner, GAP))).cast("long")


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")), F.lit(0)).cast("long")


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(1 << 12, _BASE, np.uint64)]), dtype=np.uint64)


def _power(n: np.ndarray) -> np.ndarray:
    """BASE ** n for any n."""
    low, high = n & 4095, n >> 12
    out = _POWERS[low]
    if high.any():
        step = _POWERS[4096:4097]
        far = np.ones_like(out)
        for k in range(int(high.max()).bit_length()):
            far = np.where(high >> k & 1, far * step, far)
            step = np.square(step)
        out = out * far
    return out


def word_places(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow string column (null: empty): (bytes, starts, ends, first): where each word is, and each row's first word (rows + 1).

    The rows' bytes are put apart by a space first, so that no word runs over two rows.
    """
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    gaps = np.unique(offsets[1:-1])
    raw = np.insert(raw, gaps, 32)
    rows = offsets + np.searchsorted(gaps, offsets, side="right")

    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return raw, starts, ends, np.searchsorted(starts, rows) if len(starts) else np.zeros(len(column) + 1, np.int64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes in BASE, scrambled. Done for about ``most`` bytes at a time."""
    size = ends - starts
    upto = np.cumsum(size)
    out, k = np.zeros(len(size), np.uint64), 0
    while k < len(size):
        to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + most, side="right")))
        n = size[k:to]
        before = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(starts[k:to] - before, n)
        terms = (raw[at].astype(np.uint64) + np.uint64(1)) * _power(at - np.repeat(starts[k:to], n))
        out[k:to] = mix(np.add.reduceat(terms, before) ^ (n.astype(np.uint64) << np.uint64(48)))
        k = to
    return out


def text_words(column) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow string column (null: empty): a 64-bit hash of each word, and each row's first word (rows + 1)."""
    raw, starts, ends, first = word_places(column)
    return word_hashes(raw, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``width`` words within a row, and each row's first run (rows + 1)."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    runs = np.concatenate([[0], np.cumsum(n)])
    if not runs[-1]:
        return np.zeros(0, np.uint64), runs
    at = np.arange(runs[-1]) + np.repeat(first[:-1] - runs[:-1], n)
    out = np.zeros(runs[-1], np.uint64)
    for k in range(width):
        out = mix(out ^ words[at + k]) if k else words[at]
    return out, runs


def slices(batch, column: str, most: int = 1 << 20):
    """Parts of an Arrow batch whose texts have about ``most`` bytes together; a longer text is a part by itself."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def list_array(values: np.ndarray, first: np.ndarray):
    """An Arrow list of 64-bit integers a row; row k has values[first[k]:first[k + 1]]."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int64)))
