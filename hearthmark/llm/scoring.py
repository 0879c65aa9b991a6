"""Operator 10: language-model scores by logistic context mixing.

The model predicts the bits of every byte, end included.  Bit counts in hashed
contexts of one to five bytes give one predictor each.  A gate, the amount of
evidence in the long contexts, selects the weights that mix the predictors in
the logistic domain; weights are learned online, one small step after the
other, and a table of adaptive probability maps refines what comes out.

Counts come from all training documents: equal six-byte strings are added up
first, so that a string costs the same however often it occurs.  Predictors
leave out the occurrence at hand while the weights are learned.  The learned
model has a fixed size and does not change while documents are scored, so a
score depends on no order of rows or tasks.

The base score counts words: words travel by hash in packed buckets, and each
bucket sends its share of the score back to the documents.  Words that are too
frequent for a bucket are found first; each task adds up their occurrences, and
their share is worked out where the documents are scored.

A null text counts as an empty one, whose end is still scored.  Rows of one
doc_id (and those without any) are one document and must agree in their text;
each repeated row counts in training.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.llm import packets, textops
from hearthmark.session import checkpointed

#: Documents with this remainder of the crc32 of their id are held out.
FOLDS, HELD_OUT = 7, 2
#: Bits of the number of table places for contexts of one to five bytes.
TABLE_BITS = (18, 19, 20, 21, 22)
RANGES = 16
END = 0xFF
PRIOR = 0.1
GATES = 64
MAP_STEPS = 32
MAP_LIMIT = 8.0
BATCH_GRAMS = 2048
EPOCHS = 3
RATE = 0.3
BUCKET_BYTES = 16 << 20
#: Bytes of text that are scored at once: the more, the fewer different strings there are to price.
SCORE_BYTES = 2 << 20
#: Steps of a predictor's unit in the packed tables.
UNIT = 256
#: Stands for a missing doc_id inside this operator.
NO_ID = -(1 << 63)


def in_training(ids: np.ndarray) -> np.ndarray:
    """Which documents are trained on."""
    texts = (b"" if i == NO_ID else str(i).encode() for i in ids.tolist())
    return np.fromiter((zlib.crc32(t) % FOLDS != HELD_OUT for t in texts), bool, len(ids))


# ---- words -------------------------------------------------------------------------

#: Buckets of sums that belong to no document: training words, training documents, distinct training words, frequent words.
WORDS, DOCS, DISTINCT, FREQUENT = -1, -2, -3, -4
#: A word with so many occurrences is frequent, or with more in a corpus where that would be more than so many words.
FREQUENT_TIMES, FREQUENT_WORDS = 200_000, 1_000_000


def _sum_row(bucket: int, n: int) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((bucket, n, b"", b"", b"", b""), types, strict=True)], names=packets.SCHEMA.names)


def _frequent_words(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of all words with ``FREQUENT_TIMES`` occurrences, and of some with half as many.

    Of such a word at least half of the occurrences lie in parts of the input
    where it has half of its average share or more; only from there it is
    reported. As a word takes a byte at least, the list has no more than twice
    ``FREQUENT_WORDS`` entries.
    """
    least = max(FREQUENT_TIMES, size // FREQUENT_WORDS) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        read = 0

        def out() -> pa.RecordBatch:
            words, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= least * read / size
            return pa.RecordBatch.from_arrays([pa.array(words[many].astype(np.int64)), pa.array(times[many], pa.int64())], names=["word", "n"])

        for batch in batches:
            body, offsets = textops.text_bytes(batch.column(1))
            for low, high in textops.chunks(offsets):
                part = textops.lower_ascii(body[offsets[low] : offsets[high]])
                starts, ends, _ = textops.word_spans(part, offsets[low : high + 1] - offsets[low])
                held.append(textops.span_hashes(part, starts, ends))
                read += len(part)
                if sum(map(len, held)) > packets.FLUSH:
                    yield out()
                    held, read = [], 0
        if held:
            yield out()

    found = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([row["word"] for row in found.collect()], np.int64).astype(np.uint64))


def _among(words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every word among the sorted known ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return place, known[place] == words


def _frequent_row(counts: np.ndarray) -> pa.RecordBatch:
    """Training occurrences of the frequent words as one row."""
    there = np.flatnonzero(counts)
    values = (FREQUENT, int(len(there)), packets.squeezed(there), b"", packets.squeezed(counts[there]), b"")
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=packets.SCHEMA.names)


def _frequent_counts(rows: list[dict], n: int) -> np.ndarray:
    counts = np.zeros(n, np.int64)
    for row in rows:
        counts[packets.unsqueezed(row["docs"])] += packets.unsqueezed(row["places"])
    return counts


def _doc_words(docs: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Packets of (document, times, word) of the words that are not frequent, and the training totals."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, words, trained = packets.Packer(np.uint64), 0, 0
        counts = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            body, offsets = textops.text_bytes(batch.column(1))
            for low, high in textops.chunks(offsets):
                part = textops.lower_ascii(body[offsets[low] : offsets[high]])
                starts, ends, at = textops.word_spans(part, offsets[low : high + 1] - offsets[low])
                row = np.repeat(np.arange(high - low), np.diff(at))
                word = textops.span_hashes(part, starts, ends)
                train = in_training(ids[low:high])
                words += int(np.diff(at)[train].sum())
                trained += int(train.sum())
                place, often = _among(word, shared.value)
                counts += np.bincount(place[often & train[row]], minlength=len(counts))
                row, word = row[~often], word[~often]
                key = textops.mixed(word + row.astype(np.uint64) * np.uint64(textops.BASES[1]))
                _, first, times = np.unique(key, return_index=True, return_counts=True)
                order = np.argsort(row[first], kind="stable")
                first, times = first[order], times[order]
                bucket = ((word[first] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                yield from packer.add(bucket, ids[low + row[first]], times, word[first])
        yield from packer.packets()
        yield _sum_row(WORDS, words)
        yield _sum_row(DOCS, trained)
        yield _frequent_row(counts)

    return docs.mapInArrow(run, packets.SCHEMA)


def _word_shares(docs: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Packets of (document, known words, sum of log10(c + 1)) and the totals."""
    n_frequent = len(frequent)

    def meet(table: pa.Table) -> pa.Table:
        names = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in packets.SCHEMA.names[2:]]])
        bucket = table.column("bucket")[0].as_py()
        if bucket == FREQUENT:
            return pa.Table.from_batches([_frequent_row(_frequent_counts(table.to_pylist(), n_frequent))], names)
        if bucket < 0:
            return pa.Table.from_batches([_sum_row(bucket, sum(table.column("n").to_pylist()))], names)
        doc, times, word = packets.unpacked(table, np.uint64)
        owners, owner = np.unique(doc, return_inverse=True)
        train = in_training(owners)[owner]
        _, which = np.unique(word, return_inverse=True)
        count = np.bincount(which, times * train)
        c = count[which]
        share = np.bincount(owner, times * np.log10(c + 1))
        known = np.bincount(owner, times * (c > 0)).astype(np.int64)
        home = (textops.mixed(owners.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        packer = packets.Packer(np.float64)
        out = [*packer.add(home, owners, known, share), *packer.packets(), _sum_row(DISTINCT, int((count > 0).sum()))]
        return pa.Table.from_batches(out, names)

    return _doc_words(docs, buckets, frequent).groupBy("bucket").applyInArrow(meet, packets.SCHEMA)


WORD_SUMS = T.StructType([T.StructField("_id", T.LongType()), T.StructField("known", T.LongType()), T.StructField("logs", T.DoubleType())])


def _word_sums(shares: DataFrame) -> DataFrame:
    """Known words and the sum of log10(c + 1) per document."""

    def add(table: pa.Table) -> pa.Table:
        doc, known, share = packets.unpacked(table, np.float64)
        owners, owner = np.unique(doc, return_inverse=True)
        columns = [pa.array(owners, pa.int64()), pa.array(np.bincount(owner, known).astype(np.int64), pa.int64()), pa.array(np.bincount(owner, share), pa.float64())]
        return pa.Table.from_arrays(columns, names=WORD_SUMS.names)

    return shares.where("bucket >= 0").groupBy("bucket").applyInArrow(add, WORD_SUMS)


# ---- bytes -------------------------------------------------------------------------


def _grams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text, and its end, the byte below the five before it; and its row."""
    lengths = np.diff(offsets) + 1
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    symbols = np.full(total, END, np.uint8)
    is_byte = np.ones(total, bool)
    is_byte[begin + lengths - 1] = False
    symbols[is_byte] = body
    grams = symbols.astype(np.uint64)
    for back in range(1, 6):
        before = symbols[:-back].astype(np.uint64)
        # nothing comes before the first bytes of a text
        first = (begin[:, None] + np.arange(back)).ravel() - back
        before[first[(first >= 0) & (first < len(before))]] = 0
        before <<= np.uint64(8 * back)
        grams[back:] |= before
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    return grams, row


def _counted(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _training_grams(docs: DataFrame) -> DataFrame:
    """All six-byte strings of the training documents with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            grams, counts = _counted(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(counts, pa.int64())], names=["gram", "n"])

        for batch in batches:
            train = in_training(batch.column(0).to_numpy(zero_copy_only=False))
            body, offsets = textops.text_bytes(batch.column(1).filter(pa.array(train)))
            for low, high in textops.chunks(offsets):
                grams = np.sort(_grams(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])[0])
                first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
                held.append((grams[first], np.diff(np.append(first, len(grams)))))
                if sum(len(h[0]) for h in held) > 2 * packets.FLUSH:
                    yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _context(grams: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` bytes before the last one."""
    before = (grams >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    return textops.mixed(before * np.uint64(2 * order + 1) + np.uint64(order))


def _range(context: np.ndarray) -> np.ndarray:
    return context >> np.uint64(60)


def _place(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Place within its range of the counter for a bit, given the bits of the byte before it."""
    return (((context ^ (node * np.uint64(textops.BASES[0]))) * np.uint64(textops.BASES[1])) >> np.uint64(64 - bits + 4)).astype(np.int64)


def _bits(grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits of the last byte: the bits before it, led by a one, and the bit."""
    last = grams & np.uint64(255)
    for b in range(7, -1, -1):
        yield (last | np.uint64(256)) >> np.uint64(b + 1), ((last >> np.uint64(b)) & np.uint64(1)).astype(np.int64)


def _tables(grams: DataFrame) -> list[np.ndarray]:
    """Bit counts ``[place, bit]`` of all contexts, one array per order; their sizes are fixed."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for order in range(1, len(TABLE_BITS) + 1):
                part = (order - 1) * RANGES + _range(_context(g, order)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", "gram", "n"])

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        order = part // RANGES + 1
        bits = TABLE_BITS[order - 1]
        g, n = table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy()
        context, size = _context(g, order), (1 << bits) // RANGES
        counts = np.zeros(2 * size)
        for node, bit in _bits(g):
            counts += np.bincount(2 * _place(context, node, bits) + bit, n, 2 * size)
        pairs = counts.reshape(size, 2)
        over = np.maximum(1.0, pairs.max(axis=1) / 65535)
        small = np.ceil(pairs / over[:, None]).astype(np.uint16)
        return pa.table({"part": pa.array([part], pa.int32()), "counts": pa.array([pa.compress(small.tobytes(), "zstd", asbytes=True)], pa.binary())})

    rows = grams.mapInArrow(explode, "part int, gram long, n long").groupBy("part").applyInArrow(count, "part int, counts binary").collect()
    tables = [np.zeros((RANGES, (1 << bits) // RANGES, 2), np.uint16) for bits in TABLE_BITS]
    for row in rows:
        target = tables[row["part"] // RANGES]
        size = target.shape[1]
        raw = pa.decompress(bytes(row["counts"]), size * 4, "zstd", asbytes=True)
        target[row["part"] % RANGES] = np.frombuffer(raw, np.uint16).reshape(size, 2)
    return [t.reshape(-1, 2) for t in tables]


def _evidence(seen: np.ndarray) -> np.ndarray:
    """Class of the number of occurrences: none, one or two, up to fifteen, more."""
    return (seen > 0).astype(np.int16) + (seen > 2) + (seen > 15)


def packed(table: np.ndarray) -> np.ndarray:
    """Predictor and evidence class of every place in one small number each."""
    counts = table.astype(np.float32)
    stretched = np.rint(UNIT * np.log((counts[:, 1] + PRIOR) / (counts[:, 0] + PRIOR))).astype(np.int16)
    return (stretched << 2) | _evidence(counts.sum(axis=1))


class Model:
    """Counters, mixing weights by gate, and probability maps."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray | None = None, maps: np.ndarray | None = None) -> None:
        self.tables = tables
        self.packed: list[np.ndarray] | None = None
        n = len(tables)
        self.weights = np.tile(np.append(np.full(n, 0.3), 0.0), (GATES, 1)) if weights is None else weights
        self.maps = maps

    def inputs(self, grams: np.ndarray, left_out: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit: its node, its value, the predictors in the logistic domain and the gate."""
        contexts = [_context(grams, order) for order in range(1, len(self.tables) + 1)]
        bases = [_range(c).astype(np.int64) * (len(t) // RANGES) for c, t in zip(contexts, self.tables, strict=True)]
        for node, bit in _bits(grams):
            stretched = np.ones((len(self.tables) + 1, len(grams)), np.float32)
            gate = np.zeros(len(grams), np.int16)
            for k, (context, base, table) in enumerate(zip(contexts, bases, self.tables, strict=True)):
                place = base + _place(context, node, TABLE_BITS[k])
                if left_out:
                    counts = table[place].astype(np.float32)
                    counts[np.arange(len(bit)), bit] -= 1
                    np.maximum(counts, 0, out=counts)
                    stretched[k] = np.log((counts[:, 1] + PRIOR) / (counts[:, 0] + PRIOR))
                    seen = _evidence(counts.sum(axis=1))
                else:
                    both = self.packed[k][place]
                    np.multiply(both >> 2, np.float32(1 / UNIT), out=stretched[k])
                    seen = both & 3
                if k >= len(self.tables) - 3:
                    gate = 4 * gate + seen
            yield node.astype(np.int64), bit, stretched, gate

    def mixed(self, stretched: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Mixed prediction in the logistic domain."""
        by_predictor = np.ascontiguousarray(self.weights.T, np.float32)
        total = np.zeros(len(gate), np.float32)
        for weights, values in zip(by_predictor, stretched, strict=True):
            total += weights[gate] * values
        return np.clip(total, -11.5, 11.5)

    def learn(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Online steps over the strings, in their order, on the bits of small batches."""
        squares = np.full(self.weights.shape, 1e-2)
        for _ in range(EPOCHS):
            for k in range(0, len(grams), BATCH_GRAMS):
                g, c = grams[k : k + BATCH_GRAMS], counts[k : k + BATCH_GRAMS].astype(np.float64)
                for _, bit, stretched, gate in self.inputs(g, left_out=True):
                    error = (bit - 1 / (1 + np.exp(-self.mixed(stretched, gate)))) * c
                    step = np.stack([np.bincount(gate, error * values, GATES) for values in stretched], axis=1)
                    mass = np.bincount(gate, c, GATES)[:, None]
                    step = step / np.maximum(mass, 1)
                    squares += step * step
                    self.weights = self.weights + RATE * step / np.sqrt(squares)

    def _steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = (np.clip(x, -MAP_LIMIT, MAP_LIMIT) + MAP_LIMIT) * (MAP_STEPS / (2 * MAP_LIMIT))
        low = np.minimum(scaled.astype(np.int64), MAP_STEPS - 1)
        return low, scaled - low

    def map_counts(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What the mixed predictions of each step turned out to be: weights of zeros and ones by node and step."""
        total = np.zeros(256 * (MAP_STEPS + 1) * 2)
        for k in range(0, len(grams), 1 << 16):
            g, c = grams[k : k + (1 << 16)], counts[k : k + (1 << 16)]
            for node, bit, stretched, gate in self.inputs(g, left_out=True):
                low, part = self._steps(self.mixed(stretched, gate))
                for step, weight in ((low, 1 - part), (low + 1, part)):
                    total += np.bincount((node * (MAP_STEPS + 1) + step) * 2 + bit, c * weight, len(total))
        return total

    def set_maps(self, total: np.ndarray) -> None:
        """Probabilities of the maps; a step without evidence keeps what it stands for."""
        pairs = total.reshape(256, MAP_STEPS + 1, 2)
        steps = np.arange(MAP_STEPS + 1) * (2 * MAP_LIMIT / MAP_STEPS) - MAP_LIMIT
        own = 1 / (1 + np.exp(-steps))
        self.maps = (pairs[:, :, 1] + 4 * own) / (pairs.sum(axis=2) + 4)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits that the last byte of every string costs."""
        if self.packed is None:
            self.packed = [packed(t) for t in self.tables]
        cost, flat = np.zeros(len(grams)), self.maps.ravel()
        for node, bit, stretched, gate in self.inputs(grams, left_out=False):
            x = self.mixed(stretched, gate)
            low, part = self._steps(x)
            cell = node * (MAP_STEPS + 1) + low
            refined = flat[cell]
            refined += (flat[cell + 1] - refined) * part
            one = (1 / (1 + np.exp(-x)) + refined) / 2
            cost -= np.log2(np.where(bit == 1, one, 1 - one))
        return cost


def fit(docs: DataFrame) -> Model:
    """The model of the training documents; what reaches the driver has a fixed size per task."""
    context = docs.sparkSession.sparkContext
    grams = checkpointed(_training_grams(docs))
    model = Model(_tables(grams))
    tables = context.broadcast(model.tables)

    def whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        g, n = (np.concatenate([p[k] for p in parts] or [np.zeros(0, t)]) for k, t in ((0, np.uint64), (1, np.int64)))
        order = np.argsort(textops.mixed(g))
        return g[order], n[order]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = whole(batches)
        own = Model(tables.value)
        own.learn(g, n)
        yield pa.RecordBatch.from_arrays([pa.array([float(n.sum())]), pa.array([own.weights.ravel().tolist()], pa.list_(pa.float64()))], names=["mass", "weights"])

    mass = F.sum("mass")
    size = model.weights.size
    averaged = grams.mapInArrow(learn, "mass double, weights array<double>").where("mass > 0")
    means = averaged.select(*[(F.col("weights")[k] * F.col("mass")).alias(f"w{k}") for k in range(size)], "mass")
    row = means.agg(mass.alias("mass"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(size)]).first()
    if row["mass"]:
        model.weights = np.array([row[f"w{k}"] / row["mass"] for k in range(size)]).reshape(model.weights.shape)
    weights = model.weights

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = whole(batches)
        total = Model(tables.value, weights).map_counts(g, n)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.float64())], names=["k", "x"])

    total = np.zeros(256 * (MAP_STEPS + 1) * 2)
    for cell in grams.mapInArrow(refine, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        total[cell["k"]] = cell["x"]
    model.set_maps(total)
    return model


SCORED = T.StructType(
    [
        T.StructField("_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("often_known", T.LongType()),
        T.StructField("often_logs", T.DoubleType()),
    ]
)


def _scored(docs: DataFrame, model: Model, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Tokens, bytes and log10 probability of every row, and what its frequent words add to the base score."""
    often = docs.sparkSession.sparkContext.broadcast((frequent, counts))
    shared = docs.sparkSession.sparkContext.broadcast(([packed(t) for t in model.tables], model.weights, model.maps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        own.packed = own.tables
        for batch in batches:
            body, offsets = textops.text_bytes(batch.column(1))
            for low, high in textops.chunks(offsets, SCORE_BYTES):
                part, local = body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                bits = np.zeros(high - low)
                for first in range(0, high - low, 1 << 16):
                    # strings and their rows in one number, so that a plain sort brings equal strings together
                    last = min(high - low, first + (1 << 16))
                    grams, row = _grams(part[local[first] : local[last]], local[first : last + 1] - local[first])
                    both = np.sort((grams << np.uint64(16)) | row.astype(np.uint64))
                    grams, row = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
                    begin = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
                    cost = np.concatenate([own.bits(grams[begin[k : k + (1 << 16)]]) for k in range(0, len(begin), 1 << 16)])
                    bits[first:last] += np.bincount(row, np.repeat(cost, np.diff(np.append(begin, len(grams)))), last - first)
                lower = textops.lower_ascii(part)
                starts, ends, at = textops.word_spans(lower, local)
                place, there = _among(textops.span_hashes(lower, starts, ends), often.value[0])
                c = often.value[1][place[there]]
                owner = np.repeat(np.arange(high - low), np.diff(at))[there]
                columns = [
                    batch.column(0).slice(low, high - low),
                    pa.array(np.diff(at) + 1, pa.int64()),
                    pa.array(np.diff(local), pa.int64()),
                    pa.array(-bits * np.log10(2), pa.float64()),
                    pa.array(np.bincount(owner, c > 0, high - low).astype(np.int64), pa.int64()),
                    pa.array(np.bincount(owner, np.log10(c + 1), high - low), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=SCORED.names)

    return docs.mapInArrow(run, SCORED)


def score(df: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): fold, word counts, base score, model score and bits per byte."""
    docs = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-size // BUCKET_BYTES))
    frequent = _frequent_words(docs, size)
    shares = checkpointed(_word_shares(docs, buckets, frequent))
    often = _frequent_counts([r.asDict() for r in shares.where(F.col("bucket") == FREQUENT).collect()], len(frequent))
    sums = {r["bucket"]: r["n"] for r in shares.where("bucket < 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    ends = sums.get(DOCS) or 0
    train_tokens = (sums.get(WORDS) or 0) + ends
    distinct = (sums.get(DISTINCT) or 0) + int((often > 0).sum()) + (1 if ends else 0)
    scored = _scored(docs, fit(docs), frequent, often)
    rows = docs.groupBy("_id").agg(F.count(F.lit(1)).alias("_rows"))
    words = _word_sums(shares).join(rows, "_id").select("_id", (F.col("known") / F.col("_rows")).cast("long").alias("known"), (F.col("logs") / F.col("_rows")).alias("logs"))
    joined = scored.join(words, "_id", "left")
    doc_id = F.when(F.col("_id") != NO_ID, F.col("_id"))
    held = F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS == HELD_OUT
    logs = F.coalesce(F.col("logs"), F.lit(0.0)) + F.col("often_logs") + F.log10(F.lit(float(ends + 1)))
    return joined.select(
        doc_id.alias("doc_id"),
        held.alias("held_out"),
        "n_tokens",
        (F.coalesce("known", F.lit(0)) + F.col("often_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(train_tokens + distinct + 1)))).alias("base_score"),
        "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
