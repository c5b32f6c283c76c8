"""Words and shingles of Arrow text columns as 64-bit hashes, computed in numpy for many texts at once.

A text is worked on in pieces of at most about ``PIECE`` bytes that end at white
space, so memory is bounded by the piece (or by one word, if that is longer), not by
the text; only the hashes of a text, eight bytes a word, are held together.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
ENDING = np.uint64(0xFFFF)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)

_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(2 * n, _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def _hash_run(data: np.ndarray, bounds: np.ndarray, endings: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of adjacent texts, and the number of words of each text."""
    word = ~SPACE[data]
    head = word.copy()
    head[1:] &= ~word[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    head[inner] = word[inner]
    at = np.flatnonzero(head)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    index = np.flatnonzero(word)
    number = np.cumsum(head)[index] - 1
    inside = index - at[number]
    values = (LOWER[data[index]] + np.uint64(1)) * powers(int(inside.max()) + 1)[inside]
    first = np.flatnonzero(head[index])
    lengths = np.diff(np.append(first, len(index))).astype(np.uint64)
    hashes = mix(np.add.reduceat(values, first) + lengths * _GOLDEN)
    if endings:
        last = at + lengths.astype(np.int64) - 1
        before = np.where(lengths > 1, LOWER[data[np.maximum(last - 1, 0)]], np.uint64(0))
        hashes = hashes & ~ENDING | before << np.uint64(8) | LOWER[data[last]]
    return hashes, np.diff(np.searchsorted(at, bounds))


def _hash_long(data: np.ndarray, endings: bool = False) -> np.ndarray:
    found, start = [], 0
    while start < len(data):
        end = start + PIECE
        while end < len(data):
            gaps = np.flatnonzero(SPACE[data[end : end + PIECE]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += PIECE
        piece = data[start:end]
        found.append(_hash_run(piece, np.array([0, len(piece)]), endings)[0])
        start = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins and ends; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def runs(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of together at most PIECE bytes, or of one longer text."""
    start, n = 0, len(bounds) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + PIECE, side="right")) - 1)
        end = min(end, n, start + 20_000)
        yield start, end
        start = end


def word_hashes(column: pa.Array, endings: bool = False) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For each run of texts: its first and last row (exclusive) and each text's word hashes in order.

    With ``endings`` the low 16 bits of a hash (``ENDING``) are the word's last two bytes, lower-cased.
    """
    data, bounds = column_bytes(column)
    for start, end in runs(bounds):
        low, high = bounds[start], bounds[end]
        if end - start == 1 and high - low > PIECE:
            yield start, end, [_hash_long(data[low:high], endings)]
        else:
            hashes, counts = _hash_run(data[low:high], bounds[start : end + 1] - low, endings)
            yield start, end, np.split(hashes, np.cumsum(counts)[:-1])


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes, sorted, of all runs of k words; of the whole sequence if it is shorter; none for none."""
    n = len(hashes)
    k = min(k, n)
    if not k:
        return np.zeros(0, np.uint64)
    value = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        value = mix(value * _BASE + hashes[i : n - k + 1 + i])
    return np.unique(value)
