"""Words and windows of whole batches of texts as 64-bit hashes, with numpy only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard

_RANDOM = np.random.Generator(np.random.PCG64(0x5EED))
BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes and number of texts hashed at once; a longer text is a piece alone.
PIECE_BYTES, PIECE_ROWS = 1 << 19, 2048
#: Bytes of text whose words are hashed at once: of a longer text, only one byte in eight is held beside it. A longer word is hashed alone.
SEGMENT = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the 0, 1, ..., n - 1, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def pieces(texts: pa.Array):
    """Runs [a, b) of at most PIECE_ROWS texts that together have about PIECE_BYTES bytes."""
    ends = np.cumsum([0, *(0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist())])
    a = 0
    while a < len(texts):
        b = min(a + PIECE_ROWS, max(a + 1, int(np.searchsorted(ends, ends[a] + PIECE_BYTES, side="right")) - 1))
        yield a, b
        a = b


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and for each text the place of its first word (one more at the end).

    A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D; null texts have none.
    lower: A to Z count as a to z.
    """
    n = len(texts)
    joined = pa.array([t.as_py() or "" for t in texts], pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + n + 1]
    data = joined.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    border = offsets[1:-1]
    border = border[border < len(raw)]
    begins[border] = inside[border]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SEGMENT)))
        a, b = starts[i], starts[j] if j < len(starts) else len(raw)
        out[i:j] = _hashed(raw[a:b], inside[a:b], starts[i:j] - a)
        i = j
    return out, first


def _hashed(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at `starts`; the first one begins at 0."""
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    terms = BYTE[raw]
    terms *= powers(BASE, int(place[inside].max()) + 1)[np.where(inside, place, 0)]
    terms[~inside] = 0
    return mix(np.add.reduceat(terms, starts))


def windows_of(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each word on (not mixed); the last ones wrap into zeros and mean nothing."""
    out = np.zeros_like(words)
    factor = np.uint64(1)
    for j in range(length):
        out[: len(words) - j] += words[j:] * factor
        factor = np.uint64((int(factor) * int(STEP)) & (2**64 - 1))
    return out


def doubled(windows: np.ndarray, length: int) -> np.ndarray:
    """Hashes of twice the length from those of `length`."""
    out = windows.copy()
    factor = np.uint64(pow(int(STEP), length, 2**64))
    out[: len(out) - length] += windows[length:] * factor
    return out


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one zstandard frame."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpacked(data: bytes, *types: str) -> list[np.ndarray]:
    """The columns that `packed` has put together."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out
