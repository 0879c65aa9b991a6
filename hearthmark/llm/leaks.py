"""Operator 7: benchmark items that occur in documents, also slightly changed.

A window of a document that is as long as an item (the whole text, if that is
shorter) holds the item if their edit distance in words is at most a fifth of
the item's words.  Windows are embedded by a random walk that turns edits into
few differing places (CGK); samples of places are hashed, and windows that
agree with an item in one of many repetitions are verified by their exact edit
distance.

Embedding every window of every document would cost far more than it could
find, so only windows that can be within the distance are embedded.  Both
conditions for that are exact: if an item is cut into one more piece than edits
are allowed, one piece stays whole and moves by no more places than edits; and a
window lacks no more words of the item than edits.

Words are runs of letters, digits and non-ASCII characters in lower case.
Items without words match nothing, null texts hold nothing.  Items go to the
tasks in blocks of bounded size.  Rows of one doc_id are joined into one result
per item; the same holds for items of equal id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.llm import rowfilter, textops
from hearthmark.session import checkpointed

#: Differing words per item word.
EDITS = 0.2
#: Repetitions of the embedding and places that each samples.  Two sequences that agree in a third of
#: their embedded places meet with a probability of 1 - (1 - 1/9) ** 48 > 0.996 per window.
REPEATS, SAMPLED = 48, 2
#: Bytes of item texts that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
SEED_BITS = 22

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ``n + 1`` word offsets of the rows."""
    plain = np.where(_WORD_BYTE[body], body, np.uint8(32))
    starts, ends, at = textops.word_spans(plain, offsets)
    return textops.span_hashes(plain, starts, ends), at


class Items:
    """A block of benchmark items, laid out for seeding, counting, embedding and verifying."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        words, at = _words(*textops.text_bytes(pc.utf8_lower(pa.array(texts, pa.string()))))
        self.ids, self.size = ids, np.diff(at)
        self.edits = np.floor(EDITS * self.size + 1e-9).astype(np.int64)
        self.width = int(self.size.max(initial=0))
        self.words = np.zeros((len(ids), self.width), np.uint64)
        self.words[np.arange(self.width) < self.size[:, None]] = words
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item, (n, k) in enumerate(zip(self.size.tolist(), self.edits.tolist(), strict=True)):
            q = n // (k + 1)
            for piece in range(k + 1 if n else 0):
                found.setdefault(q, []).append((int(textops.window_hashes(self.words[item, piece * q : piece * q + q], q)[0]), item, piece * q))
        for q, rows in found.items():
            keys, items, places = (np.array([r[k] for r in rows], t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << SEED_BITS, bool)
            bits[(keys >> np.uint64(64 - SEED_BITS)).astype(np.int64)] = True
            self.seeds[q] = keys[order], items[order], places[order], bits
        owner = np.repeat(np.arange(len(ids)), self.size)
        self.member = np.sort(textops.mixed(words + owner.astype(np.uint64) * np.uint64(textops.BASES[1])))
        self._sample()

    def _sample(self) -> None:
        """Sampled places of each repetition and the keys of all items there."""
        rng = np.random.default_rng(7)
        self.sampled = [np.sort(rng.integers(0, np.maximum(3 * self.size, 1)[:, None], (len(self.ids), SAMPLED))) for _ in range(REPEATS)]
        self.keys = [self.embedded(np.arange(len(self.ids)), self.words, self.size, r) for r in range(REPEATS)]

    def embedded(self, item: np.ndarray, words: np.ndarray, size: np.ndarray, repeat: int) -> np.ndarray:
        """Words of the embedding of each sequence at the places sampled for its item.

        The walk writes the current word and moves on if a random bit of (step, word) is one.
        """
        line, at = np.arange(len(item)), np.zeros(len(item), np.int64)
        out = np.zeros((len(item), SAMPLED), np.uint64)
        wanted = self.sampled[repeat][item]
        for step in range(int(wanted.max(initial=-1)) + 1):
            inside = at < size
            word = np.where(inside, words[line, np.minimum(at, words.shape[1] - 1)], np.uint64(0))
            hit = wanted == step
            if hit.any():
                out = np.where(hit, word[:, None], out)
            coin = textops.mixed(word + np.uint64((repeat * 100_003 + step + 1) * 0x9E3779B1))
            at += (inside & ((coin >> np.uint64(17)) & np.uint64(1)).astype(bool)).astype(np.int64)
        return out

    def seeded(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, item, window start) around all whole pieces in the texts."""
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        parts = []
        for q, (keys, items, places, bits) in self.seeds.items():
            hashes = textops.window_hashes(words, q)
            near = np.flatnonzero(bits[(hashes >> np.uint64(64 - SEED_BITS)).astype(np.int64)] & (row[: len(hashes)] == row[q - 1 :][: len(hashes)]))
            low, high = np.searchsorted(keys, hashes[near]), np.searchsorted(keys, hashes[near], side="right")
            many = high - low
            seed = np.repeat(low, many) + textops.flat_ranges(many)
            place = np.repeat(near, many)
            item = items[seed]
            shifts = 2 * self.edits[item] + 1
            start = np.repeat(place - places[seed] - self.edits[item], shifts) + textops.flat_ranges(shifts)
            parts.append((np.repeat(row[place], shifts), np.repeat(item, shifts), start))
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        r, item, start = (np.concatenate([p[k] for p in parts]) for k in range(3))
        length = np.minimum(self.size[item], at[r + 1] - at[r])
        good = (start >= at[r]) & (start + length <= at[r + 1]) & (length + self.edits[item] >= self.size[item])
        found = np.unique(np.stack([r[good], item[good], start[good]], axis=1), axis=0)
        return found[:, 0], found[:, 1], found[:, 2]

    def windows(self, words: np.ndarray, at: np.ndarray, row: np.ndarray, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows as padded rows of word hashes, and their lengths."""
        size = np.minimum(self.size[item], at[row + 1] - at[row])
        place = start[:, None] + np.arange(self.width)
        inside = np.arange(self.width) < size[:, None]
        return np.where(inside, words[np.minimum(place, len(words) - 1)], np.uint64(0)), size

    def holds_words(self, item: np.ndarray, window: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether enough words of each window belong to the item."""
        key = textops.mixed(window + item.astype(np.uint64)[:, None] * np.uint64(textops.BASES[1]))
        there = self.member[np.minimum(np.searchsorted(self.member, key), len(self.member) - 1)] == key
        there &= np.arange(self.width) < size[:, None]
        return there.sum(axis=1) >= self.size[item] - self.edits[item]

    def collides(self, item: np.ndarray, window: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether a window meets its item in any repetition."""
        met = np.zeros(len(item), bool)
        for repeat in range(REPEATS):
            rest = np.flatnonzero(~met)
            if not len(rest):
                break
            own = self.embedded(item[rest], window[rest], size[rest], repeat)
            met[rest] = (own == self.keys[repeat][item[rest]]).all(axis=1)
        return met

    def distance(self, item: np.ndarray, window: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Edit distance in words between each item and window."""
        column = np.arange(self.width + 1)
        row = np.tile(column, (len(item), 1))
        out = np.where(self.size[item] == 0, size, 0)
        line = np.arange(len(item))
        for i in range(self.width):
            change = self.words[item, i][:, None] != window
            new = np.empty_like(row)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + change)
            row = np.minimum.accumulate(new - column, axis=1) + column
            out = np.where(self.size[item] == i + 1, row[line, size], out)
        return out

    def found(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, start and distance of all windows that hold an item."""
        words, at = _words(body, offsets)
        row, item, start = self.seeded(words, at)
        parts = []
        for k in range(0, len(row), 20_000):
            r, i, s = row[k : k + 20_000], item[k : k + 20_000], start[k : k + 20_000]
            window, size = self.windows(words, at, r, i, s)
            for test in (self.holds_words, self.collides):
                good = test(i, window, size)
                r, i, s, window, size = r[good], i[good], s[good], window[good], size[good]
            far = self.distance(i, window, size)
            good = far <= self.edits[i]
            parts.append((r[good], i[good], (s - at[r])[good], far[good]))
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))


FOUND = "doc_id long, item_id long, first_word long, edits long"


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items in blocks of bounded size, by id; one block is on the driver at a time."""
    block, held = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    yield block


def matches(df: DataFrame, items: DataFrame) -> DataFrame:
    """One row ``(doc_id, item_id, first_word, edits)`` per document and item it holds: its closest, then first window."""
    docs = df.select(F.col("doc_id").cast("long"), "text")
    context, parts = df.sparkSession.sparkContext, []
    for block in _blocks(items):
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Items([b[0] for b in shared.value], [b[1] for b in shared.value])
            for batch in batches:
                ids = batch.column(0)
                body, offsets = textops.text_bytes(pc.utf8_lower(batch.column(1)))
                for low, high in textops.chunks(offsets):
                    row, item, start, edits = own.found(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    if len(row):
                        columns = [ids.take(pa.array(low + row)), pa.array([own.ids[i] for i in item], pa.int64()), pa.array(start, pa.int64()), pa.array(edits, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "first_word", "edits"])

        parts.append(docs.mapInArrow(run, FOUND))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_word")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.first_word").alias("first_word"), F.col("b.edits").alias("edits"))


def without_leaks(df: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose document holds no item; rows without a doc_id stay."""
    held = checkpointed(matches(df.where(F.col("doc_id").isNotNull()), items).select("doc_id").distinct())
    return rowfilter.without(df, held, "doc_id")
