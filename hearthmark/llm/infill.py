"""Operator 11: fill-in-the-middle samples, cut with a learned rank index.

A cut is given as a number of code points, the text lies there as UTF-8.  For
all texts of a chunk the byte offsets of all code points form one rising
sequence, offset by rank.  A rank index of straight segments, each within
``REACH`` bytes of every offset that it covers, predicts the byte of a cut; the
stored residual corrects the prediction exactly.  Texts in one alphabet need
hardly more than one segment, and a lookup costs the same anywhere in a text.

An absent text is an empty one; an empty text stays plain.  A row without key
is cut as if its key were the empty word.  Equal rows give equal results, ties
of the two cuts give an empty middle.  A long text is worked on alone, its
index takes ten bytes a code point.  Input columns that have the name of an
added column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.llm.textops import chunks, text_bytes

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Largest residual in bytes; residuals are stored as 16-bit numbers.
REACH = 64


class RankIndex:
    """Exact positions of a rising sequence by piecewise linear prediction."""

    def __init__(self, offsets: np.ndarray, reach: int = REACH) -> None:
        self.n = len(offsets)
        starts, slopes = [], []
        at, step = 0, 1 << 12
        while at < self.n:
            end, slope = _longest(offsets, at, reach, step)
            starts.append(at)
            slopes.append(slope)
            at, step = end, max(64, 2 * (end - at))
        self.starts, self.slopes = np.array(starts, np.int64), np.array(slopes, np.float64)
        self.bases = offsets[self.starts] if self.n else np.zeros(0, np.int64)
        self.residuals = (offsets - self._predicted(np.arange(self.n))).astype(np.int16)

    def _predicted(self, ranks: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[piece] + np.rint(self.slopes[piece] * (ranks - self.starts[piece])).astype(np.int64)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        return self._predicted(ranks) + self.residuals[ranks]


def _longest(offsets: np.ndarray, at: int, reach: int, step: int) -> tuple[int, float]:
    """End and slope of the longest segment from ``at`` whose line stays within ``reach`` of every offset."""
    low, high, end = -np.inf, np.inf, at + 1
    while end < len(offsets):
        stop = min(end + step, len(offsets))
        run = np.arange(end - at, stop - at)
        rise = offsets[end:stop] - offsets[at]
        lows = np.maximum.accumulate(np.maximum((rise - reach) / run, low))
        highs = np.minimum.accumulate(np.minimum((rise + reach) / run, high))
        fits = int(np.searchsorted(lows > highs, True))
        if fits:
            low, high = lows[fits - 1], highs[fits - 1]
        if fits < len(run):
            end += fits
            break
        end, step = stop, 2 * step
    return end, 1.0 if np.isinf(low) else (low + high) / 2


def _starts(body: np.ndarray) -> np.ndarray:
    """Byte offsets of all code points, and of the end."""
    return np.append(np.flatnonzero((body & 0xC0) != 0x80), len(body))


def choices(key: Column, seed: int = 1) -> list[Column]:
    """Four 32-bit numbers that a row's key decides."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infilled(
    df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, rate: int = 90, spm_rate: int = 20, output: str = "output"
) -> DataFrame:
    """Every row with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the rearranged text.

    Of a hundred texts about ``rate`` are rearranged, of these about
    ``spm_rate`` in a hundred with the suffix first.  A text that holds one of
    the marks stays plain, so that every output can be read back.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = choices(F.col(key), seed)
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = F.when((whole == "") | marked | (h3 % 100 >= rate), F.lit("plain")).when(h4 % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm"))
    added = ("n", "form", "prefix_chars", "middle_chars", output)
    kept = [c for c in df.columns if c not in added]
    ready = df.select(
        F.struct(*[F.col(c) for c in kept]).alias("row"), whole.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2")
    )
    row = ready.schema["row"]
    long = T.LongType()
    schema = T.StructType(
        [row, T.StructField("n", long), T.StructField("form", T.StringType()), T.StructField("prefix_chars", long)]
        + [T.StructField("middle_chars", long), T.StructField("output", T.StringType())]
    )
    done = ready.mapInArrow(_rearranged, schema)
    return done.select("row.*", "n", "form", "prefix_chars", "middle_chars", F.col("output").alias(output))


def _rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = text_bytes(batch.column("text"))
        for low, high in chunks(offsets):
            part = batch.slice(low, high - low)
            yield _chunk(part, body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])


def _chunk(part: pa.RecordBatch, body: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    places = _starts(body)
    index = RankIndex(places)
    first = np.searchsorted(places, offsets)  # rank of every row's first code point
    n = np.diff(first)
    h = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for c in ("h1", "h2")]
    cut, end = np.minimum(*h), np.maximum(*h)
    one, two = index.at(first[:-1] + cut), index.at(first[:-1] + end)
    forms = part.column("form").to_pylist()
    raw, outputs = body.tobytes(), []
    for i, form in enumerate(forms):
        begin, stop, a, b = int(offsets[i]), int(offsets[i + 1]), int(one[i]), int(two[i])
        if form == "plain":
            outputs.append(raw[begin:stop])
            continue
        prefix, middle, suffix = raw[begin:a], raw[a:b], raw[b:stop]
        ahead = (PREFIX.encode(), prefix, SUFFIX.encode(), suffix)
        ordered = ahead if form == "psm" else (*ahead[2:], *ahead[:2])
        outputs.append(b"".join((*ordered, MIDDLE.encode(), middle)))
    plain = np.array([f == "plain" for f in forms], dtype=bool)
    columns = [
        part.column("row"),
        pa.array(n.astype(np.int64)),
        part.column("form"),
        pa.array(cut.astype(np.int64), mask=plain),
        pa.array((end - cut).astype(np.int64), mask=plain),
        pa.array(outputs, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of; null for an unknown form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)

    def part(i: int) -> Column:
        return F.element_at(parts, i)

    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part(2), part(4), part(3)))
        .when(form == "spm", F.concat(part(3), part(4), part(2)))
    )


def digests(df: DataFrame) -> DataFrame:
    """Cuts and hashes per document: of the output, and of the text rebuilt from it."""
    done = infilled(df.select("doc_id", "text"))
    again = restored(F.col("form"), F.col("output"))
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(again.cast("binary"), 256).alias("restored_sha256"),
    )
