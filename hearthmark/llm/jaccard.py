"""Operator 6: documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more.

Equal sets are one node.  Tokens are put in one global order, rare ones first,
so that two similar sets must share one of their first tokens.  The sparse
token-group matrix has a row for every such token and the groups that hold it
in their token union:

1. every document is compared with the one it shares most first tokens with;
   what is similar forms the groups,
2. each document of a smaller group then queries the other groups that share a
   matrix row with it.  The place of the first shared token bounds the overlap
   with a whole group; a group that cannot reach the threshold is not opened.
   In an opened group, sizes, places and parity sketches (their bits differ in at
   most as many places as the sets) rule out members before the exact test.

The order uses a count sketch of fixed size over all tokens; any order gives
the same result, this one keeps the rows of the matrix short.

A null text and one without words have an empty set and link with nothing; so
do rows without a doc_id, whose component is null.  Rows of one doc_id are one
document and must agree in their text; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.llm import packets, rowfilter, textops
from hearthmark.operators.clusters import components
from hearthmark.session import checkpointed

WORDS = 4
#: Similarity in hundredths.
LEAST = 85
#: Counters of the order sketch: two megabytes.
SKETCH_BITS = 19
SLICES = 128
#: 64-bit words of the parity sketches: one goes with every matrix row, the wide one with every pair that is left.
PARITY_WORDS, WIDE_WORDS = 4, 32
BUCKET_BYTES = 8 << 20
#: Pairs of one document that a task compares at once.
CHUNK_PAIRS = 200


class Sets:
    """Distinct shingle hashes of the texts of a chunk, row after row."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, words: int) -> None:
        n = len(offsets) - 1
        body = textops.lower_ascii(body)
        starts, ends, at = textops.word_spans(body, offsets)
        hashes = textops.span_hashes(body, starts, ends)
        row = np.repeat(np.arange(n), np.diff(at))
        shingles = textops.window_hashes(hashes, words)
        inside = np.flatnonzero(row[: len(shingles)] == row[words - 1 :]) if len(shingles) else np.zeros(0, np.int64)
        counts = np.diff(at)
        short = np.flatnonzero((counts > 0) & (counts < words))
        if len(hashes):
            whole = textops.span_hashes(hashes, at[short], at[short + 1])
        else:
            whole = np.zeros(0, np.uint64)
        owner, token = np.append(row[inside], short), np.append(shingles[inside], whole)
        key = textops.mixed(token + owner.astype(np.uint64) * np.uint64(textops.BASES[1]))
        _, first = np.unique(key, return_index=True)
        order = np.lexsort((token[first], owner[first]))
        self.row, self.token = owner[first][order], token[first][order]
        self.at = np.searchsorted(self.row, np.arange(n + 1))
        self.size = np.diff(self.at)

    def of(self, row: int) -> np.ndarray:
        return self.token[self.at[row] : self.at[row + 1]]


def _chunks(texts: pa.Array, words: int) -> Iterator[tuple[int, int, Sets]]:
    body, offsets = textops.text_bytes(texts)
    for low, high in textops.chunks(offsets):
        yield low, high, Sets(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], words)


FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("sum1", T.LongType()),
        T.StructField("sum2", T.LongType()),
        T.StructField("parity", T.BinaryType()),
        T.StructField("wide", T.BinaryType()),
        T.StructField("slice", T.IntegerType()),
    ]
)


def _parities(sets: Sets, n: int, rows: int = 512) -> np.ndarray:
    """Whether an odd number of tokens falls into each place of a row's sketch; some rows at a time."""
    width, parts = 64 * WIDE_WORDS, [np.zeros((0, 8 * WIDE_WORDS), np.uint8)]
    for low in range(0, n, rows):
        high = min(n, low + rows)
        held = slice(sets.at[low], sets.at[high])
        cell = (sets.row[held] - low) * width + (sets.token[held] % np.uint64(width)).astype(np.int64)
        odd = np.bincount(cell, minlength=(high - low) * width) & 1
        parts.append(np.packbits(odd.reshape(-1, width).astype(bool), axis=1))
    return np.concatenate(parts)


def _features(docs: DataFrame, words: int) -> DataFrame:
    """Set size, two set hashes and parity sketch per row; and slices of the token counts of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        types = [pa.int64()] * 4 + [pa.binary(), pa.binary(), pa.int32()]
        for batch in batches:
            for low, high, sets in _chunks(batch.column(1), words):
                n = high - low
                sketch += np.bincount((sets.token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(textops.mixed(sets.token * np.uint64(2 * salt + 1)))])
                    sums.append((total[sets.at[1:]] - total[sets.at[:-1]]).astype(np.int64))
                wide = _parities(sets, n)
                parity = np.bitwise_xor.reduce(wide.reshape(n, WIDE_WORDS // PARITY_WORDS, 8 * PARITY_WORDS), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, n),
                        pa.array(sets.size, pa.int64()),
                        pa.array(sums[0], pa.int64()),
                        pa.array(sums[1], pa.int64()),
                        pa.array([p.tobytes() for p in parity], pa.binary()),
                        pa.array([p.tobytes() for p in wide], pa.binary()),
                        pa.nulls(n, pa.int32()),
                    ],
                    names=FEATURES.names,
                )
        parts = [(None, None, None, None, pa.compress(part.tobytes(), "zstd", asbytes=True), None, k) for k, part in enumerate(np.split(sketch, SLICES)) if part.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], names=FEATURES.names)

    return docs.mapInArrow(run, FEATURES)


def _token_counts(features: DataFrame) -> np.ndarray:
    """The sketch over all tasks; its size is fixed."""

    def add(table: pa.Table) -> pa.Table:
        size = 4 * (1 << SKETCH_BITS) // SLICES
        parts = [np.frombuffer(pa.decompress(p.as_py(), size, "zstd", asbytes=True), np.uint32) for p in table.column("parity")]
        total = np.sum(parts, axis=0, dtype=np.uint64)
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = features.where("slice is not null").select("slice", "parity").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint64)
    for row in rows:
        counts[row["slice"]] = np.frombuffer(bytes(row["counts"]), np.uint64)
    return counts.ravel()


def _least_overlap(n: np.ndarray, m: np.ndarray, least: int) -> np.ndarray:
    """Tokens that two sets of the given sizes must share."""
    return (least * (n + m) + 99 + least) // (100 + least)


def _first_tokens(docs: DataFrame, nodes: Callable[[], np.ndarray], counts: np.ndarray, buckets: int, words: int, least: int) -> DataFrame:
    """Packets of the first tokens of every node, with their places in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packets.Packer(np.uint32)
        for batch in batches:
            batch = batch.filter(pa.array(rowfilter.passing(batch.column(2), nodes())))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, _, sets in _chunks(batch.column(1), words):
                often = shared.value[(sets.token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((sets.token, often, sets.row))
                row, token = sets.row[order], sets.token[order]
                place = np.arange(len(row)) - sets.at[row]
                size = sets.size[row]
                first = place <= size - -(-least * size // 100)
                row, token, place = row[first], token[first], place[first]
                yield from packer.add(((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), ids[low + row], place, token.astype(np.uint32))
        yield from packer.packets()

    return docs.withColumn("_slot", rowfilter.slot("doc_id")).mapInArrow(run, packets.SCHEMA)


def _matrix(first_tokens: DataFrame) -> DataFrame:
    """Matrix rows ``(token, doc_id, place)`` of the tokens that several documents have among their first."""

    def meet(table: pa.Table) -> pa.Table:
        doc, place, hashes = packets.unpacked(table, np.uint32)
        order = np.lexsort((doc, hashes))
        doc, place, hashes = doc[order], place[order], hashes[order]
        again = np.append(False, (doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1]))
        doc, place, hashes = doc[~again], place[~again], hashes[~again]
        begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        size = np.diff(np.append(begins, len(hashes)))
        shared = np.repeat(size > 1, size)
        token = (table.column("bucket")[0].as_py() << 32) | hashes[shared].astype(np.int64)
        return pa.table({"token": pa.array(token, pa.int64()), "doc_id": pa.array(doc[shared], pa.int64()), "place": pa.array(place[shared], pa.int64())})

    return first_tokens.groupBy("bucket").applyInArrow(meet, "token long, doc_id long, place long")


class Row:
    """One bucket of matrix rows, sorted by token, then group."""

    def __init__(self, table: pa.Table) -> None:
        take = lambda c: table.column(c).to_numpy()
        order = np.lexsort((take("n"), take("doc_id"), take("grp"), take("token")))
        self.token, self.doc, self.place, self.n, self.group = (take(c)[order] for c in ("token", "doc_id", "place", "n", "grp"))
        raw = b"".join(table.column("parity").to_pylist())
        self.parity = np.frombuffer(raw, np.uint64).reshape(-1, PARITY_WORDS)[order]
        self.begins = np.flatnonzero(np.append(True, self.token[1:] != self.token[:-1]))
        self.sizes = np.diff(np.append(self.begins, len(self.token)))

    def possible(self, x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
        """Whether the pairs of records may be similar, by size, place and parity."""
        n, m = self.n[x], self.n[y]
        need = _least_overlap(n, m, least)
        fits = np.minimum(n - self.place[x], m - self.place[y]) >= need
        fits &= np.minimum(n, m) >= need
        where = np.flatnonzero(fits)
        apart = np.bitwise_count(self.parity[x[where]] ^ self.parity[y[where]]).sum(axis=1)
        fits[where] = apart <= n[where] + m[where] - 2 * need[where]
        return fits


PAIRS = "a long, b long"
#: Pairs that are weighed at once.
BLOCK_PAIRS = 1 << 20


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def _nearest(matrix: DataFrame, least: int) -> DataFrame:
    """For every document the document of smallest id that it shares most matrix rows with, if they can be similar."""

    def star(table: pa.Table) -> pa.Table:
        rows = Row(table)
        lowest = np.repeat(np.array([rows.begins[k] + int(np.argmin(rows.doc[b : b + s])) for k, (b, s) in enumerate(zip(rows.begins, rows.sizes, strict=True))], np.int64), rows.sizes)
        other = np.flatnonzero(rows.doc != rows.doc[lowest])
        other = other[rows.possible(lowest[other], other, least)]
        return _pairs(rows.doc[lowest[other]], rows.doc[other])

    found = matrix.groupBy("part").applyInArrow(star, PAIRS)
    counted = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    return counted.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b")


def _between_groups(matrix: DataFrame, least: int) -> DataFrame:
    """Pairs of documents of different groups that share a matrix row and can be similar."""

    def query(table: pa.Table) -> pa.Table:
        rows = Row(table)
        left, right = [], []
        for begin, size in zip(rows.begins.tolist(), rows.sizes.tolist(), strict=True):
            group = rows.group[begin : begin + size]
            cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), size)
            if len(cuts) == 2:
                continue
            # the overlap of a query with any group of this row is at most what follows its place
            bound = rows.n[begin : begin + size] - rows.place[begin : begin + size]
            opens = begin + np.flatnonzero(bound * 100 >= least * rows.n[begin : begin + size])
            owner = np.searchsorted(cuts, opens - begin, side="right")
            step = max(1, BLOCK_PAIRS // size)
            for k in range(0, len(opens), step):
                x = np.repeat(opens[k : k + step], len(opens))
                y = np.tile(opens, len(opens[k : k + step]))
                # the later of two groups asks the earlier
                asks = np.repeat(owner[k : k + step], len(opens)) > np.tile(owner, len(opens[k : k + step]))
                x, y = x[asks], y[asks]
                fits = rows.possible(x, y, least)
                left.append(rows.doc[x[fits]])
                right.append(rows.doc[y[fits]])
        if not left:
            return _pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))
        x, y = np.concatenate(left), np.concatenate(right)
        once = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return _pairs(once[0], once[1])

    return matrix.groupBy("part").applyInArrow(query, PAIRS).distinct()


def _worth_comparing(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs whose wide parity sketches differ in no more places than similar sets can."""
    left = nodes.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("wide").alias("wide_a"))
    right = nodes.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("wide").alias("wide_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, WIDE_WORDS) for k in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            good = apart <= n + m - 2 * _least_overlap(n, m, least)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good)).columns[:2], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(run, PAIRS)


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, buckets: int, words: int, least: int) -> DataFrame:
    """The pairs that are similar, by their whole sets.

    A document with many partners is sent to several tasks, each with a part of them.
    """
    pairs = checkpointed(_worth_comparing(pairs, nodes, least))
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    texts = rowfilter.possible(docs, "doc_id", rowfilter.field(ends, "doc_id"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK_PAIRS).alias("_parts"))
    cut = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("_parts"))).drop("_parts")
    right = cut.join(texts, F.col("b") == F.col("doc_id")).select("a", "part", "b", "text")
    left = cut.select("a", "part").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    sent = left.unionByName(right).withColumn("bucket", F.pmod(F.xxhash64("a", "part"), F.lit(buckets)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        a, part, b = (table.column(c).to_pylist() for c in ("a", "part", "b"))
        sets: list[np.ndarray] = []
        for low, high, found in _chunks(table.column("text"), words):
            sets += [found.of(i) for i in range(high - low)]
        head = {(a[i], part[i]): sets[i] for i in range(len(a)) if b[i] is None}
        good: list[tuple[int, int]] = []
        for i in range(len(a)):
            if b[i] is not None:
                x, y = head[a[i], part[i]], sets[i]
                if min(len(x), len(y)) >= _least_overlap(len(x), len(y), least):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= least * (len(x) + len(y) - both):
                        good.append((a[i], b[i]))
        return _pairs(np.array([g[0] for g in good], np.int64), np.array([g[1] for g in good], np.int64))

    return checkpointed(sent.groupBy("bucket").applyInArrow(compare, PAIRS).distinct())


def _stars(near: DataFrame) -> DataFrame:
    """Group label of every document that is linked to its nearest one: where four such links lead to.

    Any grouping of similar documents will do here; links between groups are found afterwards.
    """
    labels = near.select(F.col("b").alias("doc_id"), F.col("a").alias("label"))
    for _ in range(2):
        further = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("_next"))
        labels = labels.join(further, "label", "left").select("doc_id", F.coalesce("_next", "label").alias("label"))
    return labels


def _between(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between different groups, by their labels."""
    for end in ("a", "b"):
        label = groups.select(F.col("doc_id").alias(end), F.col("label").alias("_label"))
        links = links.join(label, end, "left").withColumn(end, F.coalesce("_label", end)).drop("_label")
    return links.where("a <> b").distinct()


def similar(df: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """Per row of (doc_id, text): ``n_shingles`` and ``component_id``, the smallest doc_id reachable by links."""
    docs = df.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-size // BUCKET_BYTES))
    features = checkpointed(_features(docs, words))
    rows = features.where("slice is null")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "sum1", "sum2").agg(F.min(F.struct("doc_id", "parity", "wide")).alias("first"))
    nodes = checkpointed(classes.select(F.col("first.doc_id").alias("doc_id"), "n", "sum1", "sum2", F.col("first.parity").alias("parity"), F.col("first.wide").alias("wide")))
    bits = rowfilter.field(nodes, "doc_id")
    places = checkpointed(_matrix(_first_tokens(docs, bits, _token_counts(features), buckets, words, least)))
    known = nodes.select("doc_id", "n", "parity")

    def matrix(groups: DataFrame | None) -> DataFrame:
        joined = places.join(known, "doc_id")
        if groups is None:
            joined = joined.withColumn("grp", F.col("doc_id"))
        else:
            joined = joined.join(groups, "doc_id", "left").withColumn("grp", F.coalesce("label", "doc_id"))
        return joined.select("token", "doc_id", "place", "n", "grp", "parity", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("part"))

    near = _linked(docs, nodes, _nearest(matrix(None), least), buckets, words, least)
    groups = checkpointed(_stars(near))
    far = _linked(docs, nodes, _between_groups(matrix(groups), least), buckets, words, least)
    found = components(_between(near.unionByName(far), groups))
    labelled = (
        nodes.join(groups, "doc_id", "left")
        .withColumn("node", F.coalesce("label", "doc_id"))
        .join(found, "node", "left")
        .select("n", "sum1", "sum2", F.coalesce("component", "node").alias("component_id"))
    )
    # equal sets share their node; empty sets and rows without an id stand alone
    keyed = rows.withColumn("n_shingles", F.col("n")).withColumn("n", F.when(F.col("doc_id").isNotNull(), F.col("n")))
    joined = keyed.join(labelled, ["n", "sum1", "sum2"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def without_copies(df: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The rows of the smallest doc_id of each component; rows without a doc_id and empty texts stay."""
    found = similar(df.where(F.col("doc_id").isNotNull()), words, least)
    copies = checkpointed(found.where("component_id <> doc_id").select("doc_id").distinct())
    return rowfilter.without(df, copies, "doc_id")
