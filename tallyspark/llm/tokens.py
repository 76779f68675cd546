"""Word and hash kernels over the UTF-8 bytes of a batch of texts. Only numpy and Arrow; they run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are handled in slices of about so many bytes, so that a task's memory does not follow the length of its batch.
SLICE_BYTES = 1 << 21


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return splitmix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def whitespace_words() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric_words() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``: lower-case letters, digits and everything beyond ASCII."""
    table = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = True
    return table


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of at most ``limit`` bytes of text, or one row where that is longer."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offsets of each; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts (with A-Z lower-cased if ``fold``): the text each is in, its first byte, its length, its 64-bit hash."""
    low = lower_table()[data] if fold else data
    inside = member[low]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False  # a word ends with its text
    starts = np.flatnonzero(inside & ~before)
    held = np.flatnonzero(inside)
    first = np.searchsorted(held, starts)
    lengths = np.diff(np.append(first, len(held)))
    place = np.arange(len(held)) - np.repeat(first, lengths)
    power = odd_constants(int(lengths.max(initial=0)), 3)
    value = odd_constants(256, 5)[low[held]] * power[place]
    hashed = splitmix(np.add.reduceat(value, first) + lengths.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    return np.searchsorted(offsets, starts, side="right") - 1, starts, lengths, hashed


def window_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words, over all texts; runs across texts are the caller's to drop."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(width), np.uint64)
    for factor, j in zip(odd_constants(width, 7), range(width)):
        total += hashed[j : j + n] * factor
    return splitmix(total)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per text the distinct hashes of its ``width``-word shingles, ascending; of a shorter text its whole word sequence."""
    data, offsets = utf8(column)
    text, _, _, hashed = words(data, offsets, whitespace_words())
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    runs = window_hashes(hashed, width)
    out = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = end - begin
        if n >= width:
            out.append(np.unique(runs[begin : end - width + 1]))
        elif n:
            out.append(window_hashes(hashed[begin:end], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
