"""Packed exchange of many small records (row key, place, hash) between tasks.

A packet holds the records of one bucket from a few million records of a task:
row keys and places as compressed differences, hashes as they are.  A record
then takes little more than its hash in a shuffle, and a bucket is unpacked
into plain arrays.  Packets describe themselves, so a task that runs again
cannot mix up with what others have read before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("docs", "counts", "places", "hashes")]]
)
#: Records that a task gathers before it packs them.
FLUSH = 1_000_000


def squeezed(values: np.ndarray) -> bytes:
    """Little-endian 64-bit length, then the compressed differences of integers."""
    deltas = np.diff(values.astype(np.int64), prepend=0)
    narrow = deltas.astype(np.int16) if len(deltas) == 0 or (abs(deltas).max() < 1 << 15) else deltas
    kind = np.array([len(values), narrow.dtype.itemsize], np.int64).tobytes()
    return kind + pa.compress(narrow.tobytes(), "zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data[:16], np.int64).tolist()
    raw = pa.decompress(data[16:], n * width, "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.dtype(f"i{width}")), dtype=np.int64)


class Packer:
    """Collects records and hands them out as packets, bucket by bucket."""

    def __init__(self, hash_type: type | None, flush: int = FLUSH) -> None:
        self.hash_type, self.flush, self.held, self.parts = hash_type, flush, 0, []

    def add(self, bucket: np.ndarray, doc: np.ndarray, place: np.ndarray, hashes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.parts.append((bucket, doc, place, hashes))
        self.held += len(bucket)
        if self.held >= self.flush:
            yield from self.packets()

    def packets(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            bucket, doc, place = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
            hashes = np.concatenate([p[3] for p in self.parts]).astype(self.hash_type) if self.hash_type else None
            order = np.argsort(bucket, kind="stable")
            bucket, doc, place = bucket[order], doc[order], place[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            rows = []
            for low, high in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
                d = doc[low:high]
                first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                rows.append(
                    (
                        int(bucket[low]),
                        int(high - low),
                        squeezed(d[first]),
                        squeezed(np.diff(np.append(first, len(d)))),
                        squeezed(place[low:high]),
                        hashes[order[low:high]].tobytes() if hashes is not None else b"",
                    )
                )
            self.held, self.parts = 0, []
            columns = list(zip(*rows, strict=True))
            types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=SCHEMA.names)


def unpacked(table: pa.Table, hash_type: type | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Row keys, places and hashes of all packets of a bucket."""
    docs, places, hashes = [], [], []
    for packet in table.select(["docs", "counts", "places", "hashes"]).to_pylist():
        docs.append(np.repeat(unsqueezed(packet["docs"]), unsqueezed(packet["counts"])))
        places.append(unsqueezed(packet["places"]))
        if hash_type:
            hashes.append(np.frombuffer(packet["hashes"], hash_type))
    return np.concatenate(docs), np.concatenate(places), np.concatenate(hashes) if hash_type else None
