"""Split texts into the pieces of the byte-level pattern, for a whole batch at once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its pieces are runs of one character class, which may take one blank before
them; only an apostrophe that begins a run needs a second look.
"""

from __future__ import annotations

import unicodedata

import numpy as np

LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3

# The characters that \s stands for.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that an apostrophe takes with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_CLASSES: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _CLASSES:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = BLANK
        _CLASSES.append(table)
    return _CLASSES[0]


def byte_classes(body: np.ndarray) -> np.ndarray:
    """The character class of every byte; all bytes of a character share its class."""
    table = _class_table()
    classes = table[:128][body & 127]
    for size, low, high, mask in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
        leads = np.flatnonzero((body >= low) & (body < high))
        if len(leads):
            point = (body[leads] & mask).astype(np.int64)
            for k in range(1, size):
                point = (point << 6) | (body[leads + k] & 0x3F)
            for k in range(size):
                classes[leads + k] = table[point]
    return classes


def piece_starts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending byte starts of all pieces; a piece ends where the next begins."""
    n = len(body)
    if n == 0:
        return np.zeros(0, np.int64)
    classes = byte_classes(body)
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    row_start = row_start[:n]
    char_start = (body & 0xC0) != 0x80
    run = char_start & row_start
    run[1:] |= classes[1:] != classes[:-1]
    runs = np.flatnonzero(run | row_start)
    kind = classes[runs]
    ends = np.append(runs[1:], n)
    last = np.isin(ends, offsets)
    # the last character of a white run that something else follows in its row
    white = np.flatnonzero((kind == BLANK) & ~last)
    tail = ends[white] - 1
    while len(back := np.flatnonzero((body[tail] & 0xC0) == 0x80)):
        tail[back] -= 1
    taken = body[tail] == 32
    start = np.zeros(n + 1, bool)
    start[runs] = True
    start[tail] = True
    start[ends[white[taken]]] = False
    # an apostrophe that begins a piece and has an ending after it
    at = np.flatnonzero((body == 39) & start[:n])
    text_end = np.append(offsets, n)
    for p in at.tolist():
        if not start[p]:
            continue
        stop = int(text_end[np.searchsorted(text_end, p, side="right")])
        q = p
        while q < stop and body[q] == 39:
            after = bytes(body[q + 1 : min(q + 3, stop)]).decode("latin-1")
            ending = next((e for e in ENDINGS if after.startswith(e)), None)
            if ending is None:
                break
            start[q] = True
            start[q + 1 : q + 1 + len(ending)] = False
            q += 1 + len(ending)
            if q < stop:
                start[q] = True
    return np.flatnonzero(start[:n])
