"""Vectorised tokenisation and hashing of Arrow string columns.

Words are found on the UTF-8 bytes of a whole batch at once; every word gets a 64-bit hash.
Nulls count as empty texts. Nothing here looks at a prefix only: texts may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

#: Bytes of words "[^\x20\x09-\x0D]+".
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+".
ALNUM_WORDS = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM_WORDS[_lo : _hi + 1] = False

_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row starts (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    base = int(offs[0])
    raw = np.frombuffer(data, np.uint8, int(offs[-1]) - base, base) if data is not None and offs[-1] > base else np.zeros(0, np.uint8)
    return raw, offs - base


def _lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered."""
    return raw | (raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)


def _inside(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a word."""
    if table is SPACE_WORDS:
        return (data != 32) & (data - np.uint8(9) >= 5)
    if table is ALNUM_WORDS:
        return (data >= 128) | (data - np.uint8(48) < 10) | ((data | np.uint8(32)) - np.uint8(97) < 26)
    return table[data]


class Words:
    """The words of a column: start and end byte of each, its hash, and the range of words of each row."""

    def __init__(self, column, table: np.ndarray, lower: bool = False, hashes: bool = True):
        raw, self.offsets = column_bytes(column)
        self.bytes = _lowered(raw) if lower else raw
        self._find(table)
        self.rows = np.searchsorted(self.start, self.offsets)
        self.hash = word_hashes(self.bytes, self.start, self.end) if hashes else None

    def _find(self, table: np.ndarray) -> None:
        inside = _inside(self.bytes, table)
        n = len(inside)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            return
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # a word starts or ends
        cut = np.unique(self.offsets[1:-1])
        cut = cut[(cut > 0) & (cut < n)]
        cut = cut[inside[cut - 1] & inside[cut]]  # a row ends within a stretch of words
        if len(cut):
            turns = np.insert(turns, np.repeat(np.searchsorted(turns, cut), 2), np.repeat(cut, 2))
        if inside[0]:
            turns = np.concatenate([[0], turns])
        if inside[-1]:
            turns = np.append(turns, n)
        self.start, self.end = turns[::2], turns[1::2]

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def text(self, first: int, last: int) -> bytes:
        """The bytes from word `first` up to word `last` (inclusive), white space between them as it was."""
        return self.bytes[self.start[first] : self.end[last]].tobytes()


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time."""
    size = end - start
    out = size.astype(U64) * U64(_STEP)
    if not len(out):
        return out
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)], padded[len(data) :] = data, 0
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    on, at, left = slice(None), start, size
    for _ in range(_LONG // 8):
        out[on] = mix((out[on] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)])) * U64(_STEP) + U64(1))
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        on = more if isinstance(on, slice) else on[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        piece = np.zeros(-(-int(size[i]) // 8) * 8, np.uint8)
        piece[: size[i]] = data[start[i] : end[i]]
        value = piece.view("<u8") + np.arange(len(piece) // 8, dtype=U64) * U64(_STEP)
        out[i] = mix(np.array([mix(value).sum(dtype=U64) + U64(size[i])]))[0]
    return out


def kgram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position (len(h) - k + 1 of them); rows are not told apart here."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, width = None, 0, h, 1
    while True:
        if k & width:
            part = power[done : done + n]
            out = mix(part * U64(3)) if out is None else mix(out * U64(0x9E3779B97F4A7C15) + (part ^ U64(width)))
            done += width
        width *= 2
        if width > k:
            return out
        power = mix(power[: len(power) - width // 2] * U64(0xC2B2AE3D27D4EB4F) + power[width // 2 :])


def window_starts(rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of words from which k words lie within one row; rows: first word of each row, and the end."""
    n = np.maximum(np.diff(rows) - k + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(n) - n
    return np.arange(total) + np.repeat(rows[:-1] - before, n)


def sliced(batches, rows: int, size: int = 1 << 23, column: int | None = None):
    """Record batches of at most so many rows and about so many bytes (of one column, where it is named), or one row."""
    for batch in batches:
        watched = batch.columns if column is None else [batch.column(column)]
        ends = sum((_row_ends(c) for c in watched), np.zeros(batch.num_rows, np.int64))
        i = 0
        while i < batch.num_rows:
            before = int(ends[i - 1]) if i else 0
            j = min(i + rows, max(i + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(i, j - i)
            i = j


def _row_ends(column) -> np.ndarray:
    """Bytes of strings, binaries and lists up to the end of each row; nothing for other kinds."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    if pa.types.is_list(kind):
        return np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64) * 8)
    return np.zeros(len(column), np.int64)
