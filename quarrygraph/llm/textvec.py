"""Words of a batch of texts as numpy arrays: bounds, document numbers and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that belong to words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that belong to words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finalizer)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end (plus 8 of padding), and each text's offsets; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of the maximal runs of bytes in table; no run crosses two texts."""
    inside = table[buf]
    inside[off[-1] :] = False
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1], after[-1] = inside[1:], False
    cut = off[1:] - 1
    after[cut[cut >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, eight bytes at a time."""
    eight = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,))
    length = ends - starts
    out = mix(length.astype(U) + U(0x9E3779B97F4A7C15))
    live, at = np.arange(len(starts)), starts
    left = length
    while len(live):
        part = eight[at]
        short = left < 8
        part[short] &= (U(1) << (left[short] * 8).astype(U)) - U(1)
        out[live] = mix(out[live] * U(0x9E3779B97F4A7C15) ^ part)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def words(texts: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, words per text)."""
    buf, off = buffers(texts)
    if lower:
        buf = LOWER[buf]
    starts, ends, n = spans(buf, off, table)
    return hashes(buf, starts, ends), n
