"""Operator 1: byte-level BPE encoding and decoding in padded matrices.

Distinct pieces of a chunk of texts are bucketed by length into matrices.  In
every round each row merges its leftmost pair of minimal rank; the pair ranks
come from a hash table, and rows without a pair left are compacted away.
Pieces longer than ``LONG_PIECE`` bytes make the same merges from a heap, as a
matrix round would cost their whole length.

Null and empty texts have no ids.  Every text is decoded again where it is
encoded; should two pieces ever share a 64-bit hash, the texts of that chunk
are encoded once more with exact piece comparison.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hearthmark.llm import pretokens, textops

NONE = np.int32(0x7FFFFFFF)
LONG_PIECE = 512
MATRIX_CELLS = 1 << 20


class Vocabulary:
    """Ranks of a byte-level BPE file: token bytes and the hash table of pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_length = np.array([len(t) for t in self.tokens], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self._hash_pairs(np.array(left, np.uint64), np.array(right, np.uint64), np.array(merged, np.int32))

    @classmethod
    def from_lines(cls, lines: bytes) -> Vocabulary:
        """From the text of a rank file: one base64 token and its rank a line."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a})

    def _hash_pairs(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        bits = max(8, int(4 * len(left)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        self.mask = (1 << bits) - 1
        key = ((left << np.uint64(32)) | right).astype(np.int64)
        slot, todo = self._slots(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            mine = todo[free]
            self.keys[slot[mine]] = key[mine]  # the last writer of a slot stays
            won = todo[self.keys[slot[todo]] == key[todo]]
            self.values[slot[won]] = merged[won]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, ``NONE`` where it does not merge; negative ids never merge."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slots(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def _merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a matrix padded with -1; returns the final ids and their number per row."""
        n, width = ids.shape
        done_ids, done_len = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        rows, length = np.arange(n), (ids >= 0).sum(axis=1)
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.zeros((n, 0), np.int32)
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                open_ = best != NONE
            else:
                open_ = np.zeros(len(rows), bool)
            if not open_.all():
                over = ~open_
                done_ids[rows[over], : ids.shape[1]] = ids[over]
                done_len[rows[over]] = length[over]
                ids, ranks, rows, length = ids[open_], ranks[open_], rows[open_], length[open_]
                if not len(rows):
                    break
                at, best = at[open_], best[open_]
            line = np.arange(len(rows))
            ids[line, at] = best
            moved = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, moved + (moved > at[:, None]), axis=1)
            moved = moved[:-1]
            ranks = np.take_along_axis(ranks, moved + (moved >= at[:, None]), axis=1)
            length = length - 1
            has = at < ranks.shape[1]
            ranks[line[has], at[has]] = self.pair_ranks(best[has], ids[line[has], at[has] + 1])
            has = at > 0
            ranks[line[has], at[has] - 1] = self.pair_ranks(ids[line[has], at[has] - 1], best[has])
        return done_ids, done_len

    def _merge_long(self, piece: np.ndarray) -> np.ndarray:
        """The same merges for one long piece: a heap by rank, then place, over a linked list."""
        ids = self.of_byte[piece].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        pairs: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in pairs:
                pairs[a, b] = int(self.pair_ranks(np.array([a], np.int32), np.array([b], np.int32))[0])
            return pairs[a, b]

        first = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(first[i]), i) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (x := rank(r, ids[after[i]])) != NONE:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank(ids[before[i]], r)) != NONE:
                heapq.heappush(heap, (x, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the given pieces and the number of ids of each."""
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        width = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for w in np.unique(width[lengths <= LONG_PIECE]).tolist():
            chosen = np.flatnonzero((width == w) & (lengths <= LONG_PIECE))
            step = max(1, MATRIX_CELLS // w)
            for k in range(0, len(chosen), step):
                rows = chosen[k : k + step]
                ids = np.full((len(rows), w), -1, np.int32)
                filled = np.arange(w) < lengths[rows][:, None]
                ids[filled] = self.of_byte[textops.gather(body, starts[rows], lengths[rows])]
                ids, counts[rows] = self._merge_rows(ids)
                parts.append((rows, ids[np.arange(w) < counts[rows][:, None]]))
        for row in np.flatnonzero(lengths > LONG_PIECE).tolist():
            ids = self._merge_long(body[starts[row] : starts[row] + lengths[row]])
            counts[row] = len(ids)
            parts.append((np.array([row]), ids))
        flat = np.zeros(int(counts.sum()), np.int32)
        begin = np.cumsum(counts) - counts
        for rows, ids in parts:
            flat[np.repeat(begin[rows], counts[rows]) + textops.flat_ranges(counts[rows])] = ids
        return flat, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, as one array."""
        return textops.gather(self.token_bytes, self.token_start[ids], self.token_length[ids])


def distinct_pieces(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index of one example of every distinct piece, and for each piece the number of its example."""
    if exact:
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(bytes(body[s:e]), len(seen)) for s, e in zip(starts, ends, strict=True)], np.int64)
        return np.unique(which, return_index=True)[1], which
    _, example, which = np.unique(textops.span_hashes(body, starts, ends), return_index=True, return_inverse=True)
    return example, which


class Encoded:
    """Ids of the texts of one chunk: ``flat`` with ``offsets`` per row, and the pieces they come from."""

    def __init__(self, vocabulary: Vocabulary, body: np.ndarray, offsets: np.ndarray, exact: bool = False) -> None:
        starts = pretokens.piece_starts(body, offsets)
        ends = np.append(starts[1:], len(body)).astype(np.int64)
        example, self.which = distinct_pieces(body, starts, ends, exact)
        self.piece_ids, self.piece_counts = vocabulary.encode_pieces(body, starts[example], (ends - starts)[example])
        self.piece_begin = np.cumsum(self.piece_counts) - self.piece_counts
        counts = self.piece_counts[self.which]
        self.flat = textops.gather(self.piece_ids, self.piece_begin[self.which], counts)
        self.pieces = np.searchsorted(starts, offsets)
        self.offsets = np.concatenate([[0], np.cumsum(counts)])[self.pieces]


def encode_chunk(vocabulary: Vocabulary, body: np.ndarray, offsets: np.ndarray) -> tuple[Encoded, np.ndarray]:
    """Ids of a chunk and the bytes that they decode to."""
    found = Encoded(vocabulary, body, offsets)
    decoded = vocabulary.decode(found.flat)
    if not np.array_equal(decoded, body):
        found = Encoded(vocabulary, body, offsets, exact=True)
        decoded = vocabulary.decode(found.flat)
    return found, decoded


def _shared(df: DataFrame, ranks: bytes) -> Callable[[], Vocabulary]:
    """The rank file goes to the executors once, as a broadcast of fixed size."""
    lines = df.sparkSession.sparkContext.broadcast(ranks)
    kept: list[Vocabulary] = []

    def vocabulary() -> Vocabulary:
        if not kept:
            kept.append(Vocabulary.from_lines(lines.value))
        return kept[0]

    return vocabulary


def encode(df: DataFrame, ranks: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the text column by its ids (array of int); all other columns stay."""
    vocabulary = _shared(df, ranks)
    kept = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = textops.text_bytes(batch.column(batch.num_columns - 1))
            for low, high in textops.chunks(offsets):
                part, _ = encode_chunk(vocabulary(), body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                column = pa.ListArray.from_arrays(pa.array(part.offsets, pa.int32()), pa.array(part.flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[:-1], column], names=[*kept, ids])

    return df.select(*kept, text).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Replace the id column by the bytes it stands for (binary); null ids give a null."""
    vocabulary = _shared(df, ranks)
    kept = [c for c in df.columns if c not in (ids, decoded)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if x is None else vocabulary().decode(np.array(x, np.int64)).tobytes() for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.binary())], names=[*kept, decoded])

    return df.select(*kept, ids).mapInArrow(run, schema)


def digests(df: DataFrame, ranks: bytes) -> DataFrame:
    """Per row of (doc_id, text): number and hash of the ids, and the hash of what they decode to."""
    vocabulary = _shared(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = textops.text_bytes(batch.column(1))
            for low, high in textops.chunks(offsets):
                local = offsets[low : high + 1] - offsets[low]
                part, decoded = encode_chunk(vocabulary(), body[offsets[low] : offsets[high]], local)
                words = [str(x) for x in part.piece_ids.tolist()]
                begin = part.piece_begin.tolist()
                decimal = [" ".join(words[s : s + n]) for s, n in zip(begin, part.piece_counts.tolist(), strict=True)]
                which, cut, at = part.which.tolist(), part.pieces.tolist(), part.offsets
                out, lengths = decoded.tobytes(), vocabulary().token_length[part.flat]
                ends = np.concatenate([[0], np.cumsum(lengths)])[at].tolist()
                rows = range(high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([hashlib.sha256(" ".join([decimal[p] for p in which[cut[i] : cut[i + 1]]]).encode()).hexdigest() for i in rows]),
                        pa.array([hashlib.sha256(out[ends[i] : ends[i + 1]]).hexdigest() for i in rows]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = T.StructType(
        [
            df.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return df.select("doc_id", "text").mapInArrow(run, schema)
