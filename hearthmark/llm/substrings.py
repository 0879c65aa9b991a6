"""Operator 5: remove passages that repeat across documents.

Every window of 50 words contains, wherever it lies in a document, one whole
block of 25 words of that document's fixed, non-overlapping blocks.  The blocks
are the index; every rolling window of 25 words probes it.  Probes and blocks
meet by hash in buckets of bounded size.  A place of a document is live if its
25 words are an indexed block and occur in another document too; only windows of
50 words around live places go on.  There the hits are extended: equal windows
of 50 words meet by a second, wider hash, and all but those of the smallest
doc_id are removed.  Chained windows make up the maximal repeats.

Nothing is listed in pairs: every place is sent once per step, however many
documents share it.  Windows count as equal if 64 bits of one hash and the
bucket, taken from an independent one, agree.

A null text has no words.  Rows without a doc_id keep all words and remove
nothing elsewhere.  Rows of one doc_id are one document and must agree in their
text; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.llm import packets, rowfilter, textops
from hearthmark.session import checkpointed

WINDOW = 50
BLOCK = WINDOW // 2
#: Bytes of text per bucket; a bucket's arrays take about ten times the sixth part of it.
BUCKET_BYTES = 8 << 20

INTERVALS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))]
)


class Windows:
    """Word windows of the texts of a chunk."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray) -> None:
        self.starts, self.ends, self.at = textops.word_spans(body, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.at))
        self.words = textops.span_hashes(body, self.starts, self.ends)

    def of(self, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of every window within one text, and the window's hash."""
        hashes = textops.window_hashes(self.words, size, which)
        inside = np.flatnonzero(self.row[: len(hashes)] == self.row[size - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        return inside, hashes[inside]


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    body, offsets = textops.text_bytes(batch.column(text))
    for low, high in textops.chunks(offsets):
        yield low, high, body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def _probes(docs: DataFrame, buckets: int, block: int) -> DataFrame:
    """Packets of all rolling windows; those at multiples of the block size are the indexed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packets.Packer(np.uint32)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, _, body, offsets in _chunks(batch, 1):
                found = Windows(body, offsets)
                first, hashes = found.of(block)
                row = found.row[first]
                bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                yield from packer.add(bucket, ids[low + row], first - found.at[row], hashes.astype(np.uint32))
        yield from packer.packets()

    return docs.mapInArrow(run, packets.SCHEMA)


def _runs(order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal keys in sorted order, and the run of every element."""
    ordered = keys[order]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return begins, np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))


def _by_document(found: DataFrame, buckets: int, reach: int) -> DataFrame:
    """Merge packets of places into intervals ``[start, end)`` per document; a place covers ``reach`` words."""

    def merge(table: pa.Table) -> pa.Table:
        doc, place, _ = packets.unpacked(table, None)
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + reach))
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(doc)) - 1
        owner = doc[begin]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        cuts = pa.array(np.append(first, len(owner)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in (place[begin], place[stop] + reach)]
        return pa.Table.from_arrays([pa.array(owner[first], pa.int64()), *lists], names=INTERVALS.names)

    return found.groupBy("bucket").applyInArrow(merge, INTERVALS)


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (textops.mixed(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _packed_places(doc: np.ndarray, place: np.ndarray, buckets: int) -> pa.Table:
    order = np.lexsort((place, doc))
    packer = packets.Packer(None)
    out = [*packer.add(_home(doc[order], buckets), doc[order], place[order]), *packer.packets()]
    names = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in packets.SCHEMA.names[2:]]])
    return pa.Table.from_batches(out, names)


def live_places(docs: DataFrame, buckets: int, block: int = BLOCK) -> DataFrame:
    """Intervals of places whose ``block`` words are an indexed block that two documents hold."""

    def meet(table: pa.Table) -> pa.Table:
        doc, place, hashes = packets.unpacked(table, np.uint32)
        order = np.argsort(hashes, kind="stable")
        begins, run = _runs(order, hashes)
        several = np.minimum.reduceat(doc[order], begins) != np.maximum.reduceat(doc[order], begins)
        indexed = np.logical_or.reduceat(place[order] % block == 0, begins)
        live = order[(several & indexed)[run]]
        return _packed_places(doc[live], place[live], buckets)

    found = _probes(docs, buckets, block).groupBy("bucket").applyInArrow(meet, packets.SCHEMA)
    return _by_document(found, buckets, 1)


def _extended(docs: DataFrame, live: DataFrame, buckets: int, window: int, block: int) -> DataFrame:
    """Packets of the windows that hold a live place whole."""
    bits = rowfilter.field(live, "doc_id")
    joined = rowfilter.possible(docs, "doc_id", bits).join(live, "doc_id").select("doc_id", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packets.Packer(np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, body, offsets in _chunks(batch, 1):
                found = Windows(body, offsets)
                first, hashes = found.of(window)
                _, other = found.of(window, 1)
                spans = batch.slice(low, high - low)
                counts = spans.column(2).value_lengths().to_numpy(zero_copy_only=False)
                base = np.repeat(found.at[:-1], counts)
                s, e = (base + spans.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
                # windows from window - block words before a live place up to the place itself
                edges = np.zeros(len(found.starts) + 1, np.int64)
                np.add.at(edges, np.maximum(s - (window - block), np.repeat(found.at[:-1], counts)), 1)
                np.add.at(edges, e, -1)
                chosen = np.cumsum(edges)[first] > 0
                first, hashes, other = first[chosen], hashes[chosen], other[chosen]
                row = found.row[first]
                yield from packer.add((other % np.uint64(buckets)).astype(np.int32), ids[low + row], first - found.at[row], hashes)
        yield from packer.packets()

    return joined.mapInArrow(run, packets.SCHEMA)


def repeated_words(docs: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """Intervals of the words that a smaller document repeats, per document with any."""
    block = window // 2
    docs = docs.where(F.col("doc_id").isNotNull())
    live = checkpointed(live_places(docs, buckets, block))

    def meet(table: pa.Table) -> pa.Table:
        doc, place, hashes = packets.unpacked(table, np.uint64)
        order = np.argsort(hashes, kind="stable")
        begins, run = _runs(order, hashes)
        least = np.minimum.reduceat(doc[order], begins)
        later = order[doc[order] > least[run]]
        return _packed_places(doc[later], place[later], buckets)

    found = _extended(docs, live, buckets, window, block).groupBy("bucket").applyInArrow(meet, packets.SCHEMA)
    return checkpointed(_by_document(found, buckets, window))


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def _finished(ids: pa.Array, texts: list, gone: list[tuple[list, list]] | None, keep_text: bool) -> pa.RecordBatch:
    """Result rows; ``gone`` holds the intervals of removed words of every row."""
    n_words, n_removed, last = [], [], []
    for row, text in enumerate(texts):
        words = (text or "").encode().split()
        n_words.append(len(words))
        if gone and gone[row][0]:
            for s, e in reversed([*zip(*gone[row], strict=True)]):
                del words[s:e]
        n_removed.append(n_words[-1] - len(words))
        kept = b" ".join(words)
        last.append(kept.decode() if keep_text else hashlib.sha256(kept).hexdigest())
    columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(last, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*RESULT.names[:3], "kept" if keep_text else "kept_sha256"])


def without_repeats(df: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Per row of (doc_id, text): word counts and the kept words, as text ``kept`` or as their hash ``kept_sha256``."""
    docs = df.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-size // BUCKET_BYTES))
    gone = repeated_words(docs, buckets, window)
    bits = rowfilter.field(gone, "doc_id")
    schema = T.StructType([*RESULT.fields[:3], T.StructField("kept" if keep_text else "kept_sha256", T.StringType())])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~rowfilter.passing(batch.column(2), bits())))
            yield _finished(rest.column(0), rest.column(1).to_pylist(), None, keep_text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [(s or [], e or []) for s, e in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield _finished(batch.column(0), batch.column(1).to_pylist(), spans, keep_text)

    plain = docs.withColumn("_slot", rowfilter.slot("doc_id")).mapInArrow(untouched, schema)
    touched = rowfilter.possible(docs, "doc_id", bits).join(gone, "doc_id", "left").select("doc_id", "text", "starts", "ends").mapInArrow(cut, schema)
    return plain.unionByName(touched)
