"""Operator 8: token ids in compressed binary files.

Documents are range-partitioned by id, encoded by the tokenizer library and
written in ascending order through Spark's own writer, so that failed or
repeated tasks leave no trace.  A row of the files is a segment of whole
documents: their ids and token counts, one frequency table, and the
independently decodable blocks of ``rans`` with offsets and checksums.  All
blocks of a segment share its table; reading needs one segment at a time, and
a part of a segment can be decoded from its offsets alone.

The library sees every distinct piece of text once per worker process; pieces
are the spans that its own splitting rule yields, so their ids are those of the
whole text.  With ``added_tokens`` the added tokens of the vocabulary file are
matched in the texts as the library does by default: texts are cut at them
before they are split into pieces.  Without, they are text like any other.

A null text has no ids but the end id.  Rows without a doc_id come first.
Repeated rows are written as often as they occur, next to each other.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.llm import packets, pretokens, rans, textops
from hearthmark.sources.tables import shared_folder

#: Ids per segment; a longer document is a segment of its own.
SEGMENT = 2_000_000
#: Distinct pieces that a worker process remembers.
REMEMBERED = 1_500_000
PARTITION_BYTES = 64 << 20

FILE = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("before", T.LongType()),
        T.StructField("n", T.LongType()),
        *[T.StructField(c, T.BinaryType()) for c in ("docs", "null_docs", "counts", "symbols", "shares", "states", "words", "offsets", "checksums")],
    ]
)


class LibraryPieces:
    """Ids of pieces by the tokenizer library, remembered by the hash of a piece."""

    def __init__(self, tokenizer_json: bytes, added_tokens: bool = False) -> None:
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.added: dict[bytes, int] = {}
        if added_tokens:
            tokenizer = json.loads(tokenizer_json)
            entries, tokenizer["added_tokens"] = tokenizer["added_tokens"], []
            if tokenizer["normalizer"] or any(x[flag] for x in entries for flag in ("single_word", "lstrip", "rstrip")):
                raise ValueError("added tokens that take account of what is around them, or of a normaliser, are not known here")
            self.added = {x["content"].encode(): x["id"] for x in entries if x["content"]}
            tokenizer_json = json.dumps(tokenizer).encode()
        # of the tokens that begin at a place the longest counts
        self.added_pattern = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        # a token is written with one character for each of its bytes
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.forget()

    def forget(self) -> None:
        """Remember nothing but the added tokens."""
        sizes = np.array([len(x) for x in self.added], np.int64)
        ends = np.cumsum(sizes)
        hashes = textops.span_hashes(np.frombuffer(b"".join(self.added), np.uint8), ends - sizes, ends)
        self.begin = np.argsort(hashes)
        self.known, self.count = hashes[self.begin], np.ones(len(hashes), np.int64)
        self.ids = np.array(list(self.added.values()), np.int32)

    def _encoded(self, inputs: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the inputs, and how many belong to each piece of the given byte sizes."""
        found = self.tokenizer.encode_batch_fast(inputs, add_special_tokens=False)
        flat = np.concatenate([np.array(x.ids, np.int32) for x in found] or [np.zeros(0, np.int32)])
        ends = np.cumsum(self.bytes_of[flat])
        cuts = np.searchsorted(ends, np.cumsum(sizes)) + 1
        return flat, np.diff(np.append(0, cuts))

    def learn(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> None:
        """Encode pieces that are not known; words with their blank before them stay apart within one input."""
        if len(self.known) + len(hashes) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(~np.isin(hashes, self.known, assume_unique=True))
        order = np.append(new[word[new]], new[~word[new]])
        parts = [(self._text(raw, starts[new[word[new]]], ends[new[word[new]]], 50), order[: word[new].sum()])]
        parts.append((self._text(raw, starts[new[~word[new]]], ends[new[~word[new]]], 1), order[word[new].sum() :]))
        for inputs, pieces in parts:
            flat, count = self._encoded(inputs, (ends - starts)[pieces])
            begin = len(self.ids) + np.cumsum(count) - count
            self.ids = np.append(self.ids, flat)
            at = np.searchsorted(self.known, hashes[pieces])
            by = np.argsort(hashes[pieces])
            at, pieces, begin, count = at[by], pieces[by], begin[by], count[by]
            self.known = np.insert(self.known, at, hashes[pieces])
            self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    @staticmethod
    def _text(raw: bytes, starts: np.ndarray, ends: np.ndarray, together: int) -> list[str]:
        texts = [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        return ["".join(texts[k : k + together]) for k in range(0, len(texts), together)]

    def _added_spans(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the added tokens in all texts of a chunk."""
        raw = body.tobytes()
        spans = []
        if self.added and self.added_pattern.search(raw):
            spans = [m.span() for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.added_pattern.finditer(raw, low, high)]
        both = np.array(spans, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts of a chunk and their offsets."""
        first, stop = self._added_spans(body, offsets)
        starts = pretokens.piece_starts(body, np.sort(np.concatenate([offsets, first, stop])))
        # an added token is one piece
        starts = starts[(np.searchsorted(first, starts) == np.searchsorted(stop, starts, side="right"))]
        ends = np.append(starts[1:], len(body)).astype(np.int64)
        hashes, example, which = np.unique(textops.span_hashes(body, starts, ends), return_index=True, return_inverse=True)
        s = starts[example]
        follows = np.minimum(s + 1, max(0, len(body) - 1))
        word = (ends[example] - s > 1) & (body[s] == 32) & (pretokens.byte_classes(body)[follows] == pretokens.LETTER) if len(s) else np.zeros(0, bool)
        self.learn(hashes, body.tobytes(), s, ends[example], word)
        at = np.searchsorted(self.known, hashes)
        count = self.count[at][which]
        flat = textops.gather(self.ids, self.begin[at][which], count)
        return flat, np.append(0, np.cumsum(count))[np.searchsorted(starts, offsets)]


_PIECES: dict[tuple[int, bool], LibraryPieces] = {}


def _library(tokenizer_json: bytes, added_tokens: bool) -> LibraryPieces:
    """One memory of pieces per worker process and tokenizer."""
    key = zlib.crc32(tokenizer_json), added_tokens
    if key not in _PIECES:
        _PIECES[key] = LibraryPieces(tokenizer_json, added_tokens)
    return _PIECES[key]


def _segment(part: int, number: int, before: int, docs: list, ids: list[np.ndarray]) -> tuple:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    table = rans.Table.of(flat)
    blocks = rans.encode(flat, table)
    known = np.array([0 if d is None else d for d in docs], np.int64)
    return (
        part,
        number,
        before,
        len(flat),
        packets.squeezed(known),
        packets.squeezed(np.flatnonzero([d is None for d in docs])),
        packets.squeezed(np.array([len(x) for x in ids], np.int64)),
        packets.squeezed(table.symbols),
        packets.squeezed(table.shares),
        blocks.states.astype("<u4").tobytes(),
        blocks.words.astype("<u2").tobytes(),
        packets.squeezed(blocks.offsets),
        blocks.checksums.astype("<u4").tobytes(),
    )


def write(df: DataFrame, path: str, tokenizer_json: bytes, end_id: int, added_tokens: bool = False) -> None:
    """Write the ids of every row of (doc_id, text), with the end id after each, below ``path``."""
    docs = df.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = docs.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 9]

    def row(*args) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_segment(*args), types, strict=True)], names=FILE.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, held, docs, ids = TaskContext.get().partitionId(), 0, 0, 0, [], []
        for batch in batches:
            body, offsets = textops.text_bytes(batch.column(1))
            for low, high in textops.chunks(offsets):
                flat, at = _library(shared.value, added_tokens).encode(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                names = batch.column(0).slice(low, high - low).to_pylist()
                for k, name in enumerate(names):
                    one = np.append(flat[at[k] : at[k + 1]], np.int32(end_id))
                    if docs and held + len(one) > SEGMENT:
                        yield row(part, number, before, docs, ids)
                        number, before, held, docs, ids = number + 1, before + held, 0, [], []
                    docs.append(name)
                    ids.append(one)
                    held += len(one)
        if docs:
            yield row(part, number, before, docs, ids)

    ordered.mapInArrow(run, FILE).write.mode("errorifexists").option("compression", "uncompressed").parquet(path)


def _documents(part: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a segment with their ids, from its coded blocks."""
    table = rans.Table(packets.unsqueezed(part["symbols"]).astype(np.uint32), packets.unsqueezed(part["shares"]).astype(np.uint64))
    coded = rans.Blocks(
        part["n"],
        np.frombuffer(part["states"], "<u4").reshape(-1, rans.LANES),
        np.frombuffer(part["words"], "<u2"),
        packets.unsqueezed(part["offsets"]),
        np.frombuffer(part["checksums"], "<u4"),
    )
    ids = rans.decode(coded, table)
    none = set(packets.unsqueezed(part["null_docs"]).tolist())
    at = 0
    for k, (doc, n) in enumerate(zip(packets.unsqueezed(part["docs"]).tolist(), packets.unsqueezed(part["counts"]).tolist(), strict=True)):
        yield (None if k in none else doc), ids[at : at + n]
        at += n


def _with_starts(files: DataFrame) -> DataFrame:
    """Add the number of ids in all parts before; there is one row per part, as many as the writer had tasks."""
    parts = files.groupBy("part").agg(F.sum("n").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return files.join(F.broadcast(offsets), "part").withColumn("before", F.col("before") + F.col("_start"))


def _read(files: DataFrame, schema: T.StructType, last: pa.DataType, value) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1).to_pylist()[0]
                docs, starts, counts, values, at = [], [], [], [], part["before"]
                for doc, ids in _documents(part):
                    docs.append(doc), starts.append(at), counts.append(len(ids)), values.append(value(ids))
                    at += len(ids)
                columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, last)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _with_starts(files).select(FILE.names).mapInArrow(run, schema)


_HEAD = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())]


def read(df_files: DataFrame) -> DataFrame:
    """Documents of the files: ``(doc_id, start, n_tokens, ids)``."""
    return _read(df_files, T.StructType([*_HEAD, T.StructField("ids", T.ArrayType(T.IntegerType()))]), pa.list_(pa.int32()), lambda ids: ids.astype(np.int32))


def read_checksums(df_files: DataFrame) -> DataFrame:
    """As ``read``, with the crc32 of the ids as little-endian unsigned 32-bit integers in their place."""
    schema = T.StructType([*_HEAD, T.StructField("ids_crc32", T.LongType())])
    return _read(df_files, schema, pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def round_trip(df: DataFrame, tokenizer_json: bytes, end_id: int = 2, added_tokens: bool = False) -> DataFrame:
    """Write the files into the shared folder and read every document back."""
    path = shared_folder(df.sparkSession) + "/token-files"
    write(df, path, tokenizer_json, end_id, added_tokens)
    return read_checksums(df.sparkSession.read.schema(FILE).parquet(path))
