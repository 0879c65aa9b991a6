"""Array helpers that work on all texts of an Arrow batch at once.

A batch of texts is one UTF-8 byte array plus row offsets.  Words and pieces
are spans of that array.  The bytes of a span are hashed eight at a time, all
spans together; a run of words is hashed by a prefix sum over their hashes.  No
step loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once; bounds the scratch arrays of a task.
CHUNK_BYTES = 2 << 20

#: Odd multipliers of the two hashes of runs, and seeds of the two hashes of bytes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 512

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that are not taken, whatever the case of letters."""
    lower, found = {c.lower() for c in taken}, []
    for name in wanted:
        while (name := f"_{name}").lower() in lower:
            pass
        found.append(name)
    return found


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and ``n + 1`` row offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, dtype=np.uint8)[low:high] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - low


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer text stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def lower_ascii(body: np.ndarray) -> np.ndarray:
    return _LOWER[body]


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and ``n + 1`` word offsets of the rows."""
    if len(body) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[body]
    first = np.zeros(len(body) + 1, dtype=bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up = base, np.ones(1, np.uint64)
        self.inverse, self.down = pow(base, -1, 1 << 64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            more = min(k, n - k)
            self.up = np.concatenate([self.up, self.up[:more] * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down[:more] * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS: dict[int, Powers] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _POWERS:
        _POWERS[which] = Powers(BASES[which])
    return _POWERS[which].get(n)


_LANE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time go through a mixing step that loses nothing.

    Spans of up to eight bytes and equal length never share a hash.  A sum of
    powers would not do here: modulo 2**64 it is equal for some pairs of long
    texts whatever its base (Thue-Morse words).
    """
    lengths = ends - starts
    h = mixed(lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(BASES[which]))
    lanes = np.ndarray(len(body) + 1, "<u8", np.concatenate([body, np.zeros(8, np.uint8)]).data, strides=(1,))
    at = np.flatnonzero(lengths <= LONG_SPAN)
    done = 0
    while len(at := at[lengths[at] > done]):
        h[at] = mixed(h[at] ^ (lanes[starts[at] + done] & _LANE_MASKS[np.minimum(lengths[at] - done, 8)]))
        done += 8
    for i in np.flatnonzero(lengths > LONG_SPAN).tolist():
        h[i] = xxhash.xxh3_64_intdigest(body[starts[i] : ends[i]].tobytes(), BASES[which])
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the value sequences in the given spans; equal sequences hash alike.

    Bytes may form long sequences; other values have to be hashes themselves, in short runs.
    """
    if values.dtype == np.uint8:
        return byte_hashes(values, starts, ends, which)
    up, down = _powers(which, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive word hashes (of one flat array)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(words, at, at + size, which)


def flat_ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for every length, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(before, lengths)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans ``values[s : s + l]`` one after the other."""
    return values[np.repeat(starts, lengths) + flat_ranges(lengths)]
