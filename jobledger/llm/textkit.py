"""Vectorised byte-level text work shared by the operators (numpy over Arrow buffers).

Texts are taken as UTF-8 bytes straight from Arrow's buffers.  Work proceeds in
slices of a few hundred kilobytes that end between words, so that memory stays
bounded whatever the length of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one vectorised step looks at; a longer single word widens its own slice.
SLICE = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word bytes after lower-casing: digits, a-z and every non-ASCII byte.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.table = base, powers(base, 1 << 12)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            self.table = powers(self.base, max(n, 2 * len(self.table)))
        return self.table[:n]


_POW, _INV = _Powers(_BASE), _Powers(_BASE_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low bits depend on all of the input."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _slices(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at ends of texts or, in a long text, behind a byte that belongs to no word."""
    at, end = 0, len(buf)
    while at < end:
        to = min(end, at + SLICE)
        if to < end:
            k = int(np.searchsorted(offs, to, "right")) - 1
            if offs[k] > at:
                to = int(offs[k])
            else:  # inside one long text: on to the next byte outside words, or its end
                stop = int(offs[k + 1])
                while to < stop:
                    near = np.flatnonzero(~is_word[_LOWER[buf[to : to + 4096]]])
                    if len(near):
                        to = min(stop, to + int(near[0]) + 1)
                        break
                    to = min(stop, to + 4096)
        yield at, to
        at = to


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = ALNUM, stems: dict[int, list[np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: starts, ends, 64-bit hashes (of the lower-cased bytes), and for each text the index of its first word (one more at the end).

    `stems` maps lengths to lists, which get the hashes of the words' first so many bytes (0 for words that are not longer).
    """
    starts, ends, hashes = [], [], []
    for a, z in _slices(buf, offs, is_word):
        b = _LOWER[buf[a:z]]
        inside = is_word[b]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        cut = offs[np.searchsorted(offs, a) : np.searchsorted(offs, z)] - a
        before[cut] = False
        s = np.flatnonzero(inside & ~before)
        if not len(s):
            continue
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        e = np.flatnonzero(inside & ~after) + 1
        n = len(b)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POW.upto(n), out=total[1:])
        h = (total[e] - total[s]) * _INV.upto(n)[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        for k, found in (stems or {}).items():
            stem = mix((total[np.minimum(s + k, n)] - total[s]) * _INV.upto(n)[s] + np.uint64(k * 0xA24BAED4963EE407 & (1 << 64) - 1))
            found.append(np.where(e - s > k, stem, np.uint64(0)))
        starts.append(s + a)
        ends.append(e + a)
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, offs)


def batches(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each; one text at least."""
    _, offs = column_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to
