"""Words of whole texts as 64-bit hashes, for kernels that run inside Spark tasks on Arrow batches.

A word is a maximal run of characters other than ``[\\x20\\x09-\\x0D]``, which is where Arrow's ASCII splitting splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a kernel turns into words at once; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
#: Multiplier of the rolling hash (odd, so that it can be undone modulo 2^64).
BASE = np.uint64(0x9E3779B97F4A7C15)


def texts(column: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return column.cast(pa.large_string()).fill_null("")


def raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of consecutive texts of at most ``limit`` bytes together, each with the index of its first text."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).tolist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, column.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, column.slice(start)


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of every word of the texts in a row, and the bounds of each text (length: texts + 1)."""
    lists = pc.ascii_split_whitespace(column)
    coded = lists.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:  # from white space at an end, or an empty text
        real = codes != empty
        before = np.concatenate([[0], np.cumsum(real)])
        codes, bounds = codes[real], before[bounds]
    return distinct, codes, bounds


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in a row, and the bounds of each text."""
    distinct, codes, bounds = split_words(column)
    if not len(codes):
        return np.zeros(0, np.uint64), bounds
    named = distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, named), np.uint64, len(named))[codes], bounds


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a polynomial hash over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, width: int, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive entries, by doubling (no entry crosses the end)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    power, block, step = np.array([base], np.uint64), h, 1
    rest = width
    while rest:
        if rest & 1:
            n = len(h) - (have + step) + 1
            out = block[:n].copy() if out is None else out[:n] * power + block[have:have + n]
            have += step
        rest >>= 1
        if rest:
            n = len(block) - step
            block = block[:n] * power + block[step:step + n]
            power = power * power
            step *= 2
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
