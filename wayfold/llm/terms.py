"""Terms: runs of digits, ASCII letters and characters beyond ASCII, with only A-Z put in lower case."""

from __future__ import annotations

import numpy as np


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    kept = (out >= 128) | ((out >= ord("0")) & (out <= ord("9"))) | ((out >= ord("a")) & (out <= ord("z")))
    out[~kept] = ord(" ")
    return out


_PLAIN = _table()


def folded(column):
    """The column with each byte outside terms as a space and A-Z in lower case, so that its words are the terms. Null stays null."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    valid, offsets, data = column.buffers()
    if data is None:
        return column
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    nulls = None
    if column.null_count:
        nulls = pa.py_buffer(np.packbits(column.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
    return pa.Array.from_buffers(pa.large_string(), len(column), [nulls, pa.py_buffer(ends - ends[0]), pa.py_buffer(_PLAIN[raw])])
