"""Operator 4: secret scans through nested encodings.

Each text starts a worklist of layers.  A layer is scanned with the base
patterns; its URL escapes, Unicode escapes, base64 runs and compressed bodies
are unwrapped into new layers until none is left.  A layer that was seen before
at the same place is not taken up again, so a text that unwraps to itself ends
too; an equal layer of another place has finds of its own.  Every character of a
layer knows the part of the original text it comes from, which maps each find
back.

Compressed bodies are unpacked as streams, through every member and every
further compression, and scanned to their end in windows, so that memory stays
bounded whatever a short text unpacks to; time follows the unpacked size.  A
body that contains itself is met once: within one run the same body (for large
ones, the same first ``WINDOW`` bytes) is not unpacked again.  Windows overlap
and are cut at blanks; what a single unbroken run of more than ``WINDOW``
characters of an unpacked body encodes is looked at in pieces, and the span is
reported as kind "oversize" too.

A null text counts as an empty one: no spans.  Rows repeat if their input rows
repeat.  Texts without any candidate are passed by with one automaton per batch.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in their order, their patterns and the least length of what must be long.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

#: Bytes of an unpacked body that are held at once, bytes that windows share, and bytes unpacked in a step.
WINDOW, OVERLAP, STEP = 4 << 20, 1 << 16, 1 << 20
#: Memory that an xz body may ask for.
XZ_MEMORY = 64 << 20

_ASSIGN, _ACCESS = re.compile(ASSIGN, re.ASCII), re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}(?:\\u[dD][c-fC-F][0-9A-Fa-f]{2})?|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{2,7};|&#[xX][0-9A-Fa-f]{2,6};")
_BLOCK = re.compile(r"(?:[A-Za-z0-9+/]{48,128}\r?\n)+[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE = re.compile(r"[^\n]+")
#: A text that this finds nothing in has neither base spans nor layers.
CANDIDATE = (
    r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}|&#[0-9xX]|[A-Za-z0-9+/_-]{16}"""
)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base matches of one text."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


class Layer:
    """A text and where it comes from: a range for each character, or one for all of them."""

    def __init__(self, text: str, starts: np.ndarray | int, ends: np.ndarray | int) -> None:
        self.text, self.starts, self.ends = text, starts, ends
        self.whole = not isinstance(starts, np.ndarray)

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (self.starts, self.ends) if self.whole else (int(self.starts[start]), int(self.ends[end - 1]))

    def key(self) -> tuple[bytes, bytes]:
        """Digests of the text and of the places its characters come from."""
        places = hashlib.blake2b(digest_size=16)
        for part in (self.starts, self.ends):
            places.update(repr(part).encode() if self.whole else np.ascontiguousarray(part))
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), places.digest()


def _rewritten(layer: Layer, low: int, pieces: list[tuple[int, int, str]], high: int) -> Layer:
    """The part ``low:high`` with some ranges replaced by what they stand for."""
    text, starts, ends, at = [], [], [], low
    for s, e, new in pieces:
        text += [layer.text[at:s], new]
        if not layer.whole:
            begin, stop = layer.origin(s, e)
            starts += [layer.starts[at:s], np.full(len(new), begin)]
            ends += [layer.ends[at:s], np.full(len(new), stop)]
        at = e
    text.append(layer.text[at:high])
    if layer.whole:
        return Layer("".join(text), layer.starts, layer.ends)
    return Layer("".join(text), np.concatenate([*starts, layer.starts[at:high]]), np.concatenate([*ends, layer.ends[at:high]]))


def _escape_value(found: str) -> str | None:
    try:
        if found[0] == "\\":
            return found.encode("ascii").decode("unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16")
        code = int(found[3:-1], 16) if found[2] in "xX" else int(found[2:-1])
        return chr(code) if not 0xD800 <= code < 0xE000 else None
    except (ValueError, OverflowError):
        return None


def _unescaped(layer: Layer, pattern: re.Pattern, value) -> Iterator[Layer]:
    """One layer for every line that holds escapes, with the escapes replaced."""
    hits = [(m.start(), m.end(), v) for m in pattern.finditer(layer.text) if (v := value(m.group())) is not None]
    k = 0
    while k < len(hits):
        low = layer.text.rfind("\n", 0, hits[k][0]) + 1
        high = layer.text.find("\n", hits[k][1])
        high = len(layer.text) if high < 0 else high
        last = k
        while last < len(hits) and hits[last][0] < high:
            last += 1
        yield _rewritten(layer, low, hits[k:last], high)
        k = last


def _percent_value(found: str) -> str | None:
    try:
        return bytes.fromhex(found.replace("%", "")).decode()
    except ValueError:
        return None


def _readable(text: str) -> bool:
    """Whether a text looks like one."""
    good = sum(c.isprintable() or c in "\t\r\n" for c in text)
    return bool(text) and good >= 0.95 * len(text)


def _engine(head: bytes):
    """A new decompressor for data that begin like this, or none."""
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=XZ_MEMORY)
    return None


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What compressed chunks unpack to, member after member, in steps; ends where they are broken."""
    engine, held = None, b""
    for chunk in chunks:
        held += chunk
        while held:
            if engine is None and (engine := _engine(held)) is None:
                return
            try:
                if isinstance(engine, type(zlib.decompressobj())):
                    out, held = engine.decompress(held, STEP), b""
                    rest = engine.unconsumed_tail
                else:
                    out, rest = engine.decompress(held, STEP), b""
                    held = b""
                    while not engine.eof and not engine.needs_input:
                        yield out
                        out = engine.decompress(b"", STEP)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                return
            if out:
                yield out
            held = engine.unused_data if engine.eof else rest
            if engine.eof:
                engine = None


def _unpacked(chunks: Iterator[bytes], seen: set[tuple[int, bytes]]) -> Iterator[bytes]:
    """The chunks after every compression is undone; nothing if they were unpacked before."""
    while True:
        head = b""
        for chunk in chunks:
            head += chunk
            if len(head) > WINDOW:
                break
        key = (min(len(head), WINDOW + 1), hashlib.blake2b(head[:WINDOW], digest_size=16).digest())
        if key in seen:
            return
        seen.add(key)
        rest, chunks = chunks, itertools.chain([head], chunks)
        if _engine(head) is None:
            break
        inner = _inflated(chunks)
        first = next(inner, None)
        if first is None:  # it only begins like compressed data
            chunks = itertools.chain([head], rest)
            break
        chunks = itertools.chain([first], inner)
    yield from chunks


def _windows(chunks: Iterator[bytes], oversize: Callable[[], None]) -> Iterator[str]:
    """The text of the chunks in windows that end at a blank where there is one; ends where it stops being text."""
    decoder, held = codecs.getincrementaldecoder("utf-8")(), ""
    try:
        for chunk in chunks:
            held += decoder.decode(chunk)
            while len(held) > WINDOW:
                cut = max(held.rfind(" ", WINDOW - OVERLAP, WINDOW), held.rfind("\n", WINDOW - OVERLAP, WINDOW))
                if cut < 0:
                    cut = WINDOW
                    oversize()
                if not _readable(held[:cut]):
                    return
                yield held[:cut]
                # a find across the cut is whole in the next window
                held = held[cut - min(cut, OVERLAP) // 4 * 4 :]
        held += decoder.decode(b"", True)
    except UnicodeDecodeError:
        return
    if _readable(held):
        yield held


def _decoded(layer: Layer, oversize: list[Span]) -> Iterator[Layer]:
    """Layers of the base64 runs, unpacked as long as they are compressed."""
    for m in _BLOCK.finditer(layer.text):
        run = re.sub(r"\s", "", m.group()).rstrip("=").replace("-", "+").replace("_", "/")
        if len(run) % 4 == 1:
            continue
        try:
            data = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
        except binascii.Error:
            continue
        begin, stop = layer.origin(m.start(), m.end())
        for text in _windows(_unpacked(iter([data]), set()), lambda: oversize.append(("oversize", begin, stop))):  # noqa: B023
            yield Layer(text, begin, stop)


def _inside(layer: Layer, oversize: list[Span]) -> Iterator[Layer]:
    """The layers that one unwrapping of a layer gives."""
    yield from _unescaped(layer, _PERCENT, _percent_value)
    yield from _unescaped(layer, _ESCAPE, _escape_value)
    yield from _decoded(layer, oversize)


def scan_text(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans ``(kind, start, end, nested)`` of one text, by start, then kind, base finds first."""
    found = {(kind, s, e): False for kind, s, e in base_spans(text)}
    whole = Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))
    seen, oversize = {whole.key()}, []
    work = [_inside(whole, oversize)]  # one iterator per depth: a layer is dropped before the next one is made
    while work:
        unwrapped = next(work[-1], None)
        if unwrapped is None:
            work.pop()
        elif (key := unwrapped.key()) not in seen:
            seen.add(key)
            for kind, s, e in base_spans(unwrapped.text):
                found.setdefault((kind, *unwrapped.origin(s, e)), True)
            work.append(_inside(unwrapped, oversize))
    for span in oversize:
        found.setdefault(span, True)
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(((k, s, e, nested) for (k, s, e), nested in found.items()), key=lambda x: (x[1], order.get(x[0], len(KINDS)), x[3], x[2]))


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("nested", T.BooleanType()),
    ]
)


def _redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for _, s, e, _ in spans:
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, text: str = "text", spans: str = "spans", redacted: str | None = None) -> DataFrame:
    """Add the spans of every text, and the text without its secrets under the name ``redacted`` if one is given.

    ``redacted`` may be the text column itself; a null text stays null there.
    Input columns that have the name of an added column are replaced.
    """
    kept = [c for c in df.columns if c not in {spans, redacted} - {text}]
    added = [T.StructField(spans, T.ArrayType(SPAN)), *([T.StructField(redacted, T.StringType())] if redacted else [])]
    schema = T.StructType([*[df.schema[c] for c in kept if c != redacted], *added])
    place = kept.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("nested", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            worth = pc.fill_null(pc.match_substring_regex(texts, CANDIDATE), False).to_pylist()
            found, clean = [], []
            for row, candidate in enumerate(worth):
                spans_of = scan_text(texts[row].as_py()) if candidate else []
                found.append([{"kind": k, "start": s, "end": e, "nested": n} for k, s, e, n in spans_of])
                if redacted:
                    clean.append(_redacted(texts[row].as_py(), spans_of) if spans_of else texts[row].as_py())
            columns = [batch.column(i) for i, c in enumerate(kept) if c != redacted] + [pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(clean, pa.string())] if redacted else []), names=schema.names)

    return df.select(*kept).mapInArrow(run, schema)


def _count(spans, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind))


def digests(df: DataFrame) -> DataFrame:
    """Counts and hash of the base spans and the list of all spans, per row of (doc_id, text)."""
    found = scan(df.select("doc_id", "text"), spans="_spans")
    base = F.filter("_spans", lambda x: ~x["nested"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [_count(base, k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))
