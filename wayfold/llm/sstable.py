"""Sorted-string-table shards of token ids, keyed by document id.

Documents are range-partitioned and sorted by (id, hash of the text); each partition writes shards of about
``shard_bytes``. A shard is

    data blocks   entries of about ``block_bytes``: varints (key bytes shared with the entry before, further key
                  bytes, value bytes), the further key bytes, the value; the first key of a block is whole
    index         for each block: its first key, offset, length and crc32
    Bloom filter  ``BLOOM_BITS`` bits a key, ``BLOOM_HASHES`` hashes
    footer        offsets and lengths of index and filter, documents, tokens, magic

A key is 0 for a null id or 1 and the id with its sign bit flipped, then the hash of the text likewise, then the number of
the row among those alike in both, all big-endian: bytes sort as ids do, and a key is in one shard alone, since rows alike
in id and text are in one partition. A value is the ids, little-endian 16 bits each. ``Shard.get`` asks the filter (it
knows ids), searches the index by halves and reads the blocks of the id; ``get`` finds the shards by the manifest first.

Each attempt of a task writes files of a new name; only names in the manifest, which is the job's result, count. A
lost executor so costs a file nobody reads. Files are written and read by pyarrow's file systems, by URI.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .encode import encoder

MAGIC = b"WFSST001"
FOOTER = struct.Struct("<QQQQQQ8s")
ENTRY = struct.Struct("<QII")
BLOOM_BITS, BLOOM_HASHES = 10, 7


ID = struct.Struct(">BQ")  # the part of a key that names the document


def id_key(doc_id: int | None) -> bytes:
    return ID.pack(doc_id is not None, 0 if doc_id is None else doc_id + (1 << 63))


def key_of(doc_id: int | None, tie: int, number: int) -> bytes:
    return id_key(doc_id) + struct.pack(">QI", tie + (1 << 63), number)


def id_of(key: bytes) -> int | None:
    some, doc_id = ID.unpack_from(key)
    return doc_id - (1 << 63) if some else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        n |= (x & 127) << shift
        at, shift = at + 1, shift + 7
        if x < 128:
            return n, at


def bloom_places(key: bytes, size: int) -> list[int]:
    h = zlib.crc32(key), zlib.crc32(key[::-1], 0x9E3779B9) | 1
    return [(h[0] + k * h[1]) % size for k in range(BLOOM_HASHES)]


class Writer:
    """Writes entries, given in the order of their keys, to a stream."""

    def __init__(self, out, block_bytes: int):
        self.out, self.block_bytes = out, block_bytes
        self.block, self.last, self.first = bytearray(), b"", None
        self.index, self.keys, self.at, self.tokens = [], [], 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while self.last[shared] == key[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += value
        self.last = key
        self.keys.append(key)
        self.tokens += len(value) // 2
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append(varint(len(self.first)) + self.first + ENTRY.pack(self.at, len(self.block), zlib.crc32(self.block)))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        size = max(64, BLOOM_BITS * len(self.keys))
        bits = np.zeros(size, bool)
        for k in {k[: ID.size] for k in self.keys}:
            bits[bloom_places(k, size)] = True
        bloom = struct.pack("<Q", size) + np.packbits(bits).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.tokens, MAGIC))


class Shard:
    """Reads a shard from a random-access file (``read_at``, ``size``), a block at a time."""

    def __init__(self, file):
        self.file = file
        raw = file.read_at(FOOTER.size, file.size() - FOOTER.size)
        index_at, index_n, self.bloom_at, self.bloom_n, self.docs, self.tokens, magic = FOOTER.unpack(raw)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.keys, self.blocks, self.bloom = [], [], None
        raw, at = bytes(file.read_at(index_n, index_at)), 0
        while at < len(raw):
            n, at = read_varint(raw, at)
            self.keys.append(raw[at : at + n])
            self.blocks.append(ENTRY.unpack_from(raw, at + n))
            at += n + ENTRY.size

    def _entries(self, k: int):
        at, n, crc = self.blocks[k]
        b = bytes(self.file.read_at(n, at))
        if zlib.crc32(b) != crc:
            raise ValueError("a block is damaged")
        key, p = b"", 0
        while p < n:
            shared, p = read_varint(b, p)
            own, p = read_varint(b, p)
            size, p = read_varint(b, p)
            key = key[:shared] + b[p : p + own]
            p += own
            yield key, b[p : p + size]
            p += size

    def __iter__(self):
        for k in range(len(self.blocks)):
            yield from self._entries(k)

    def may_have(self, doc_id: int | None) -> bool:
        if self.bloom is None:
            raw = bytes(self.file.read_at(self.bloom_n, self.bloom_at))
            self.bloom = struct.unpack_from("<Q", raw)[0], np.frombuffer(raw, np.uint8, offset=8)
        size, bits = self.bloom
        return all(bits[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_places(id_key(doc_id), size))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of each document with this id, in the order of their keys."""
        if not self.may_have(doc_id):
            return []
        want, found = id_key(doc_id), []
        # the last block that begins before the id, and those that begin with it
        for k in range(max(0, bisect.bisect_left(self.keys, want) - 1), len(self.keys)):
            if self.keys[k][: ID.size] > want:
                break
            found += [np.frombuffer(value, "<u2") for key, value in self._entries(k) if key[: ID.size] == want]
        return found


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def _write(batches, root: str, tokenizer: str, end: int, block_bytes: int, shard_bytes: int):
    import pyarrow as pa

    system, folder = _open(root)
    system.create_dir(folder, recursive=True)
    tail = np.array([end], np.uint16)
    done, out, writer, name, number, last = [], None, None, None, 0, None

    def close():
        writer.close()
        out.close()
        done.append((f"{root}/{name}", writer.keys[0], writer.keys[-1], writer.tokens, len(writer.keys)))

    for whole in batches:
        for b in common.slices(whole, "text"):
            tokens, first = encoder(tokenizer).encode(b.column(2))
            for k, row in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                number = number + 1 if row == last else 0
                last = row
                if writer is None:
                    name = f"{uuid.uuid4().hex}.sst"
                    out = system.open_output_stream(f"{folder}/{name}")
                    writer = Writer(out, block_bytes)
                writer.add(key_of(*row, number), np.concatenate([tokens[first[k] : first[k + 1]], tail]).astype("<u2").tobytes())
                if writer.at >= shard_bytes:
                    close()
                    writer = None
    if writer is not None:
        close()
    cols = zip(*done) if done else [()] * 5
    kinds = pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], ["path", "first", "last", "n_tokens", "n_docs"])


def write(docs: DataFrame, *, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 10, shard_bytes: int = 64 << 20) -> DataFrame:
    """Writes the shards of ``docs`` and returns their manifest, one row a shard: (path, first, last, n_tokens, n_docs, start).

    first, last: its keys' ends; start: tokens of all shards before it. Null texts count as empty: their value is the
    end id alone. Null ids come first; rows with one id are in the order of their text's hash, and rows alike in both are
    numbered. An empty table has no shards. Other columns don't matter, whatever their names. ``tokenizer`` is a file the
    executors have, at the same path.
    """
    root = f"{common.shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.col("id").asc_nulls_first(), F.col("tie")
    d = d.select("id", F.xxhash64("text").alias("tie"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    files = common.arrow_map(d, lambda it: _write(it, root, tokenizer, end, block_bytes, shard_bytes), "path string, first binary, last binary, n_tokens bigint, n_docs bigint")
    files = common.staged(files, "manifest")  # one row a shard
    before = W.orderBy("first", "path").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _digest(batches):
    import pyarrow as pa

    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            system, name = _open(path)
            ids, starts, sizes, crcs = [], [], [], []
            with system.open_input_file(name) as f:
                for key, value in Shard(f):
                    n = len(value) // 2
                    ids.append(id_of(key))
                    starts.append(start)
                    sizes.append(n)
                    crcs.append(zlib.crc32(np.frombuffer(value, "<u2").astype("<u4").tobytes()))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(manifest: DataFrame) -> DataFrame:
    """Reads the shards of a manifest: (doc_id, start, n_tokens, ids_crc32) of each document, a block in memory at a time."""
    rows = manifest.select("path", "start").repartition("path")
    return common.arrow_map(rows, _digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def get(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The token ids of each document with this id: Spark finds the shards whose keys enclose it, each is searched."""
    low = F.lit(id_key(doc_id))
    near = manifest.filter((F.substring("first", 1, ID.size) <= low) & (F.substring("last", 1, ID.size) >= low)).orderBy("first")
    found = []
    for row in near.select("path").toLocalIterator():
        system, name = _open(row.path)
        with system.open_input_file(name) as f:
            found += Shard(f).get(doc_id)
    return found
