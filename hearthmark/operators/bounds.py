"""Pairs of listings whose score can reach a threshold, found block by block.

A listing travels as one short row: its attributes, the sizes of its word and
trigram sets and a parity bit field of each set.  Two bit fields differ in no
more places than their sets have elements apart, which bounds the overlap from
above.  The listings of a scope are cut into pieces; every piece of one side
meets every piece of the other in one task, so what is shuffled and kept does
not depend on how many pairs are alike, and no pair is missed.  The pieces of
the probes take turns, so that one shuffle stays in proportion to the rows.

Inside a task both pieces are dealt into tiles of listings that are alike.  What
the ranges of two tiles allow at best decides first, then the attributes and
set sizes of every pair of the tiles left, then the bit fields of the pairs left.
"""

from __future__ import annotations

import zlib
from collections.abc import Collection, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.functions.geo import EARTH_RADIUS_M, NEAR_M
from hearthmark.functions.text import TRIGRAM_SHARE, WORD_SHARE, folded_gram_codes, folded_word_set
from hearthmark.session import checkpointed

#: Bits of a field per element of its set, at least; sizes are powers of two from ``LEAST_BITS`` on.
WORD_BITS, GRAM_BITS, LEAST_BITS = 16, 8, 256
#: Rows of a piece of either side.
PROBE_ROWS, OTHER_ROWS = 32_768, 8_192
#: Partitions for each group of pieces, and most of them.
GROUP_PARTITIONS, MOST_PARTITIONS = 4, 4_096
#: Rows of a tile of either side, and pairs that are looked at together.
PROBE_TILE, OTHER_TILE, CHUNK_PAIRS = 64, 8, 1 << 17
#: Words of 64 bits of a field that are compared first.
COARSE = 8
#: Pairs in a batch that a task hands over.
BATCH_PAIRS = 100_000
#: Pairs of a probe row that the first search returns; of a row with more of them in a piece, only the likeliest.
FIRST_PAIRS = 8
#: Points of the score that rounding of the arithmetic may cost; with single precision, as a share of the score.
SLACK = 1e-3
COARSE_SLACK = 1e-4

ATTRIBUTES = ("price", "surface_m2", "rooms", "lat", "lng")
#: What a row may have or lack; rows of a tile have the same of these, and are all blank or not.
GIVEN = ("price", "surface_m2", "rooms", "_kind", "_contact", "_place", "_images")
PRICE, SURFACE, ROOMS, KIND, CONTACT, PLACE, IMAGES, BLANK = (1 << n for n in range(8))


def _parity_of(codes: np.ndarray, share: int) -> bytes:
    """Bits that an odd number of elements falls on; half as many bits are the halves exclusive-ored."""
    bits = max(LEAST_BITS, 1 << (share * len(codes) - 1).bit_length())
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    places = (mixed & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


_SKETCH = ["n_words", "n_grams", "word_field", "gram_field"]


def _sketch(words: Collection[bytes], grams: np.ndarray) -> tuple[int, int, bytes, bytes]:
    codes = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    return len(words), len(grams), _parity_of(codes, WORD_BITS), _parity_of(grams, GRAM_BITS)


def _of_texts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_sketch(folded_word_set(x), folded_gram_codes(x)) for x in texts], columns=_SKETCH)


def _of_sets(words: pd.Series, grams: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_sketch([x.encode() for x in w], g) for w, g in zip(words, grams, strict=True)], columns=_SKETCH)


def outlines(listings: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One short row per ``comparable`` listing, or per listing with a folded text, whose sets need not be kept then."""
    folded = "_folded" in listings.columns
    sketch = F.pandas_udf(_of_texts if folded else _of_sets, "n_words bigint, n_grams bigint, word_field binary, gram_field binary")
    sketched = listings.withColumn("_sketch", sketch(*(["_folded"] if folded else ["_words", "_grams"])))
    return sketched.select(
        "id",
        *scope,
        *[F.col(c).cast("double").alias(c) for c in ATTRIBUTES],
        # equal hashes can only raise a bound
        F.when(F.col("property_type").isNotNull(), F.xxhash64("property_type")).alias("_kind"),
        F.when(F.col("_contact").isNotNull(), F.xxhash64("_contact")).alias("_contact"),
        F.transform("_hashes", lambda h: h["length"].cast("bigint")).alias("_lengths"),
        F.transform("_hashes", lambda h: F.coalesce(h["word"], F.lit(0))).alias("_codes"),
        "_blank",
        *[F.col("_sketch")[name].alias(f"_{name}") for name in _SKETCH],
    )


class _Fields:
    """Bit fields of the rows of a block; at a size all rows whose own field has that size or a larger one."""

    def __init__(self, column: pa.ChunkedArray):
        blobs = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
        at = np.frombuffer(blobs.buffers()[1], dtype=np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64) // 8
        data = np.frombuffer(blobs.buffers()[2], dtype="<u8", count=int(at[-1]))
        self.size = np.diff(at)
        self.own = {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            self.own[size] = rows, data[at[rows][:, None] + np.arange(size)]
        self.most = max(self.own)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of each row and the fields at this size."""
        if size not in self.levels:
            rows, fields = self.own.get(size, (np.empty(0, dtype=np.int64), np.empty((0, size), dtype="<u8")))
            at = np.full(len(self.size), -1, dtype=np.int64)
            at[rows] = np.arange(len(rows))
            if size < self.most:
                above, wide = self.level(2 * size)
                larger = np.flatnonzero(above >= 0)
                at[larger] = above[larger] + len(rows)
                fields = np.concatenate([fields, wide[:, :size] ^ wide[:, size:]])
            self.levels[size] = at, fields
        return self.levels[size]

    def differing(self, a: np.ndarray, other: _Fields, b: np.ndarray, most: int) -> np.ndarray:
        """Places where fields ``a`` differ from fields ``b`` of another block, at the smaller size and ``most`` words."""
        apart, sizes = np.empty(len(a), dtype=np.float64), np.minimum(np.minimum(self.size[a], other.size[b]), most)
        for size in np.flatnonzero(np.bincount(sizes, minlength=1)).tolist():
            which = np.flatnonzero(sizes == size)
            (at, mine), (there, theirs) = self.level(size), other.level(size)
            step = max(1, CHUNK_PAIRS // size)
            for start in range(0, len(which), step):
                some = which[start : start + step]
                bits = np.bitwise_count(mine[at[a[some]]] ^ theirs[there[b[some]]])
                apart[some] = bits.sum(axis=1, dtype=np.uint32)
        return apart


def _ratio_spread(values: np.ndarray) -> float:
    low, high = values.min(), values.max()
    return 0.0 if low == high else float(1.0 - low / high) if low > 0 else 1.0


def _tiles(pattern: np.ndarray, ratios: Sequence[tuple[float, np.ndarray]], steps: tuple[float, np.ndarray], codes: Sequence[tuple[float, np.ndarray]], place: tuple[float, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and the start of every tile.

    Rows with the same pattern are halved until a tile is left, each time by what
    could cost the pairs of a part most; what was used already counts for less.
    """
    order = np.argsort(pattern, kind="stable")
    edges = np.flatnonzero(np.diff(pattern[order])) + 1
    stack = [(part, (0,) * (len(ratios) + len(codes) + 2)) for part in reversed(np.split(order, edges))]
    leaves = []
    while stack:
        rows, used = stack.pop()
        if len(rows) <= size:
            leaves.append(rows)
            continue
        columns = [v[rows] for _, v in ratios] + [steps[1][rows]] + [v[rows] for _, v in codes]
        cost = [w * _ratio_spread(v) for (w, _), v in zip(ratios, columns, strict=False)]
        cost.append(steps[0] * min(1.0, float(np.ptp(columns[len(ratios)])) / 2))
        cost += [w * float(v[0] != v.max() or v[0] != v.min()) for (w, _), v in zip(codes, columns[len(ratios) + 1 :], strict=True)]
        spots = place[1][rows]
        extents = np.ptp(spots, axis=0)
        cost.append(place[0] * min(1.0, float(extents.max()) / NEAR_M))
        columns.append(spots[:, int(extents.argmax())])
        best = max(range(len(cost)), key=lambda n: cost[n] / (1 + used[n]))
        values, half = columns[best], len(rows) // 2
        by = np.argsort(values, kind="stable")
        if cost[best] > 0:
            # equal values stay together
            ordered = values[by]
            cuts = [c for c in (np.searchsorted(ordered, ordered[half], side) for side in ("left", "right")) if 0 < c < len(rows)]
            half = min(cuts, key=lambda c: abs(c - half))
        rows, used = rows[by], tuple(u + (n == best) for n, u in enumerate(used))
        stack += [(rows[half:], used), (rows[:half], used)]
    return np.concatenate(leaves), np.concatenate([[0], np.cumsum([len(x) for x in leaves])])


#: Numbers are compared between these; a bound can only rise by that.
LEAST_NUMBER, MOST_NUMBER = 1e-18, 1e30


def _usable(values: np.ndarray) -> np.ndarray:
    sign = np.where(values < 0, -1.0, 1.0)
    return np.where(np.isnan(values), 1.0, sign * np.clip(np.abs(values), LEAST_NUMBER, MOST_NUMBER))


class _Block:
    """Rows of one side as arrays, tile by tile."""

    def __init__(self, table: pa.Table, w: Mapping[str, float], tile: int):
        lengths = pc.fill_null(pc.list_value_length(table["_lengths"]), 0).to_numpy().astype(np.int64)
        given = [table[n].is_valid().to_numpy() for n in GIVEN[:5]] + [table["lat"].is_valid().to_numpy() & table["lng"].is_valid().to_numpy(), lengths > 0, table["_blank"].to_numpy()]
        pattern = sum(x.astype(np.int64) << n for n, x in enumerate(given))
        numbers = {n: table[n].fill_null(0).to_numpy() for n in (*GIVEN[:5], "_n_words", "_n_grams")}
        place = self._places(table)
        ratios = [(w["price"], "price"), (w["surface"], "surface_m2"), (w["text"] * WORD_SHARE, "_n_words"), (w["text"] * TRIGRAM_SHARE, "_n_grams")]
        order, self.starts = _tiles(
            pattern,
            [(weight, _usable(numbers[n].astype(np.float64))) for weight, n in ratios],
            (w["rooms"], _usable(numbers["rooms"])),
            [(w["property_type"], numbers["_kind"]), (w["contact"], numbers["_contact"])],
            (w["geo"], place),
            tile,
        )
        table = table.take(order)
        self.n, self.pattern, self.place = table.num_rows, pattern[order], place[order]
        self.price, self.surface, self.rooms, self.kind, self.contact, n_words, n_grams = (v[order] for v in numbers.values())
        self.n_words, self.n_grams = n_words.astype(np.float64), n_grams.astype(np.float64)
        self.word_field, self.gram_field = (_Fields(table[c]) for c in ("_word_field", "_gram_field"))
        self.ids = np.asarray(table["id"].to_pylist())
        self.hash_starts = np.concatenate([[0], np.cumsum(lengths[order])])
        self.lengths, self.codes = (pc.list_flatten(table[c]).to_numpy().astype(np.int64) for c in ("_lengths", "_codes"))
        self.codes = self.codes.view(np.uint64)
        self.table = table.select([c for c in table.column_names if c not in ("_word_field", "_gram_field")])
        # for the single precision of the first comparison
        self.size = {}
        for name, values in (("price", self.price), ("surface", self.surface), ("words", self.n_words), ("grams", self.n_grams)):
            lacks = np.zeros(self.n) if name in ("words", "grams") else self.pattern & {"price": PRICE, "surface": SURFACE}[name] == 0
            usable = _usable(np.where(values == 0, 1e-3, values) if name in ("words", "grams") else values)
            self.size[name] = [np.where(lacks, 0.0, x).astype(np.float32) for x in (usable, 1.0 / usable)]
        self.signed = {n: bool((v < 0).any()) for n, v in (("price", self.price), ("surface", self.surface))}
        self.low, self.high = {}, {}
        for name, values in (("price", _usable(self.price)), ("surface", _usable(self.surface)), ("rooms", _usable(self.rooms)), ("kind", self.kind), ("contact", self.contact),
                             ("words", np.maximum(self.n_words, 1e-3)), ("grams", np.maximum(self.n_grams, 1e-3)), ("place", self.place)):
            self.low[name] = np.minimum.reduceat(values, self.starts[:-1])
            self.high[name] = np.maximum.reduceat(values, self.starts[:-1])
        self.tile_pattern = self.pattern[self.starts[:-1]]

    @staticmethod
    def _places(table: pa.Table) -> np.ndarray:
        lat, lng = (np.radians(np.nan_to_num(table[c].fill_null(0).to_numpy())) for c in ("lat", "lng"))
        both = table["lat"].is_valid().to_numpy() & table["lng"].is_valid().to_numpy()
        return np.where(both[:, None], EARTH_RADIUS_M * np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1), 0.0)

    def hashes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of these rows as places in ``codes``, and for each the place of its row in ``rows``."""
        counts = self.hash_starts[rows + 1] - self.hash_starts[rows]
        return _spans(self.hash_starts[rows], counts), np.repeat(np.arange(len(rows)), counts)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of ``counts[n]`` numbers from ``starts[n]`` on."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class _Promoted:
    """Pairs of rows with hashes of one length that differ in few places."""

    def __init__(self, block: _Block, bits: int):
        self.block, self.bits = block, bits
        # hashes that differ in three bits at most share a quarter; longer hashes are not told apart here
        self.parts = 4 if bits < 4 else 1
        self.row = np.repeat(np.arange(block.n), np.diff(block.hash_starts))
        self.index = []
        for part in range(self.parts):
            keys = self._keys(block.lengths, block.codes, part)
            order = np.argsort(keys, kind="stable")
            self.index.append((keys[order], order))

    def _keys(self, lengths: np.ndarray, codes: np.ndarray, part: int) -> np.ndarray:
        codes = np.where(lengths <= 16, codes, np.uint64(0))
        quarter = (codes >> np.uint64(16 * part) & np.uint64(0xFFFF)).astype(np.int64) if self.parts > 1 else 0
        return (lengths << 16) + quarter

    def of(self, left: _Block, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, who = left.hashes(rows)
        found = []
        for part, (keys, order) in enumerate(self.index):
            wanted = self._keys(left.lengths[own], left.codes[own], part)
            low = np.searchsorted(keys, wanted)
            counts = np.searchsorted(keys, wanted, "right") - low
            here, there = np.repeat(np.arange(len(own)), counts), order[_spans(low, counts)]
            apart = np.where(left.lengths[own[here]] <= 16, np.bitwise_count(left.codes[own[here]] ^ self.block.codes[there]), 0)
            near = apart <= self.bits
            found.append(who[here[near]] * self.block.n + self.row[there[near]])
        pairs = np.unique(np.concatenate(found))
        return rows[pairs // self.block.n], pairs % self.block.n


class _Bounds:
    """Upper bounds of the scores of the rows of a tile against a block."""

    def __init__(self, left: _Block, right: _Block, weights: Mapping[str, float], bits: float):
        self.a, self.b, self.w, self.most_bits = left, right, weights, bits
        self.promoted = _Promoted(right, int(bits)) if len(left.codes) and len(right.codes) else None

    def _weight(self, both: np.ndarray) -> np.ndarray:
        """Weight of the factors that both sides have, without the image."""
        total = np.full(np.shape(both), self.w["text"])
        for bit, factor in ((PRICE, "price"), (SURFACE, "surface"), (ROOMS, "rooms"), (KIND, "property_type"), (CONTACT, "contact"), (PLACE, "geo")):
            total += self.w[factor] * (both & bit != 0)
        return total

    def _tiles_left(self, tile: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Tiles of the other side with pairs that may reach the share, and which of these are near enough to earn by place."""
        a, b, w = self.a, self.b, self.w
        both = b.tile_pattern & a.tile_pattern[tile]
        with np.errstate(divide="ignore", over="ignore"):

            def ratio(name: str) -> np.ndarray:
                low, high, own_low, own_high = b.low[name], b.high[name], a.low[name][tile], a.high[name][tile]
                if own_low <= 0:
                    return np.ones(len(low))
                return np.where(low > 0, np.minimum(1.0, np.minimum(own_high / low, high / own_low)), 1.0)

            sure = w["price"] * ratio("price") * (both & PRICE != 0) + w["surface"] * ratio("surface") * (both & SURFACE != 0)
            grams = ratio("grams")
            text = w["text"] * (WORD_SHARE * ratio("words") + TRIGRAM_SHARE * 2 * grams / (1 + grams))
        sure += np.where((b.tile_pattern ^ a.tile_pattern[tile]) & BLANK == 0, text, 0.0)
        gap = np.maximum(0.0, np.maximum(b.low["rooms"] - a.high["rooms"][tile], a.low["rooms"][tile] - b.high["rooms"]))
        sure += w["rooms"] * np.where(gap < 1, 1.0, np.where(gap == 1, 0.5, 0.0)) * (both & ROOMS != 0)
        for name, factor, bit in (("kind", "property_type", KIND), ("contact", "contact", CONTACT)):
            meet = (b.low[name] <= a.high[name][tile]) & (a.low[name][tile] <= b.high[name])
            sure += w[factor] * meet * (both & bit != 0)
        apart = np.maximum(0.0, np.maximum(b.low["place"] - a.high["place"][tile], a.low["place"][tile] - b.high["place"]))
        near = np.maximum(0.0, 1.0 - np.sqrt(np.square(apart).sum(axis=1)) / NEAR_M) * (both & PLACE != 0)
        sure += w["geo"] * near + (1.0 - share) * w["image"] * (both & IMAGES != 0)
        left = np.flatnonzero(sure >= share * self._weight(both) - COARSE_SLACK)
        return left, near[left] > 0

    def _sizes(self, name: str, weight: float, rows: np.ndarray, others: np.ndarray, blank: np.ndarray | None = None) -> np.ndarray:
        """Weight times the ratio of two numbers, for all pairs."""
        (mine, mine_inverse), (theirs, theirs_inverse) = ([x[at] for x in side.size[name]] for side, at in ((self.a, rows), (self.b, others)))
        if blank is not None:
            theirs, theirs_inverse = theirs * blank, theirs_inverse * blank
        found = (mine_inverse * np.float32(weight))[:, None] * theirs
        np.minimum(found, (mine * np.float32(weight))[:, None] * theirs_inverse, out=found)
        if self.a.signed.get(name) or self.b.signed.get(name):
            np.maximum(found, np.float32(0.0), out=found)
        return found

    def _alike(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """What rooms, type and contact earn, found once for each value."""
        a, b, w = self.a, self.b, self.w
        pattern, there = int(a.pattern[rows[0]]), b.pattern[others]
        earned = np.zeros((1, len(others)), dtype=np.float32)
        for name, factor, bit in (("rooms", "rooms", ROOMS), ("kind", "property_type", KIND), ("contact", "contact", CONTACT)):
            if not pattern & bit:
                continue
            mine, which = np.unique(getattr(a, name)[rows], return_inverse=True)
            theirs = getattr(b, name)[others]
            if name == "rooms":
                gap = np.abs(theirs - mine[:, None])
                alike = np.where(gap < 1, np.float32(1.0), np.where(gap == 1, np.float32(0.5), np.float32(0.0)))
            else:
                alike = theirs == mine[:, None]
            alike = alike * (np.float32(w[factor]) * (there & bit != 0))
            earned = earned + (alike if len(mine) == 1 else alike[which])
        return earned

    def _likely(self, rows: np.ndarray, others: np.ndarray, shares: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may reach their share by attributes, set sizes and words, in single precision."""
        a, b, w = self.a, self.b, self.w
        pattern, there = int(a.pattern[rows[0]]), b.pattern[others]
        blank = ((there ^ pattern) & BLANK == 0).astype(np.float32)
        words = self._sizes("words", w["text"] * WORD_SHARE, rows, others, blank)
        grams = self._sizes("grams", 1.0, rows, others, blank)
        np.divide(grams, grams + np.float32(1.0), out=grams)
        grams *= np.float32(2 * w["text"] * TRIGRAM_SHARE)
        room = self._alike(rows, others)
        for name, bit in (("price", PRICE), ("surface", SURFACE)):
            if pattern & bit:
                room = room + self._sizes(name, w[name], rows, others)
        if near:
            centre = a.place[rows[0]]
            mine, theirs = (a.place[rows] - centre).astype(np.float32), (b.place[others] - centre).astype(np.float32)
            apart = np.square(mine[:, 0, None] - theirs[:, 0])
            for axis in (1, 2):
                apart += np.square(mine[:, axis, None] - theirs[:, axis])
            np.sqrt(apart, out=apart)
            apart *= np.float32(-w["geo"] / NEAR_M)
            apart += np.float32(w["geo"])
            np.maximum(apart, np.float32(0.0), out=apart)
            apart *= (there & PLACE != 0).astype(np.float32)
            room = room + apart
        image = w["image"] * (there & pattern & IMAGES != 0)
        weight = (self._weight(there & pattern) + image).astype(np.float32)
        room = room + (image.astype(np.float32) - shares.astype(np.float32)[:, None] * weight)
        room += grams
        flat = np.flatnonzero((room + words >= -COARSE_SLACK).ravel())
        i, j = flat // len(others), flat % len(others)
        # what the words have to earn
        needed = -room.ravel()[flat].astype(np.float64) - COARSE_SLACK
        i, j = rows[i], others[j]
        for most in (COARSE, 1 << 30):
            union_free = a.n_words[i] + b.n_words[j]
            common = self._common(i, j, a.n_words, b.n_words, a.word_field, b.word_field, most)
            earned = np.where(union_free > common, common / np.maximum(union_free - common, 1), 1.0)
            enough = (w["text"] * WORD_SHARE * earned >= needed) & ((a.pattern[i] ^ b.pattern[j]) & BLANK == 0) | (needed <= 0)
            i, j, needed = i[enough], j[enough], needed[enough]
        return i, j

    @staticmethod
    def _common(i: np.ndarray, j: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, field_a: _Fields, field_b: _Fields, most: int = 1 << 30) -> np.ndarray:
        """Most elements that two sets can share: their bit fields differ in no more places than the sets."""
        differing = field_a.differing(i, field_b, j, most)
        return np.minimum(np.minimum(n_a[i], n_b[j]), np.floor((n_a[i] + n_b[j] - differing) / 2))

    def _images(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Fewest differing bits of each pair; -1 without a pair of hashes of one length."""
        a, b = self.a, self.b
        least = np.full(len(i), -1, dtype=np.int64)
        both = np.flatnonzero(a.pattern[i] & b.pattern[j] & IMAGES != 0)
        for start in range(0, len(both), CHUNK_PAIRS):
            pairs = both[start : start + CHUNK_PAIRS]
            bits = np.full(len(pairs), 1 << 20, dtype=np.int64)
            own, who = a.hashes(i[pairs])
            counts = (b.hash_starts[j[pairs] + 1] - b.hash_starts[j[pairs]])[who]
            own, there, who = np.repeat(own, counts), _spans(b.hash_starts[j[pairs]][who], counts), np.repeat(who, counts)
            # longer hashes are not told apart here
            apart = np.where(a.lengths[own] <= 16, np.bitwise_count(a.codes[own] ^ b.codes[there]).astype(np.int64), 0)
            np.minimum.at(bits, who, np.where(a.lengths[own] == b.lengths[there], apart, 1 << 20))
            least[pairs] = np.where(bits < 1 << 20, bits, -1)
        return least

    def _exact(self, i: np.ndarray, j: np.ndarray, shares: np.ndarray, promoted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that can reach their share or may be promoted, their bounds, and whether they may be promoted."""
        a, b, w = self.a, self.b, self.w
        both = a.pattern[i] & b.pattern[j]
        sure, weight = np.zeros(len(i)), self._weight(both)
        for values, other, factor, bit in ((a.price, b.price, "price", PRICE), (a.surface, b.surface, "surface", SURFACE)):
            mine, theirs = _usable(values[i]), _usable(other[j])
            with np.errstate(over="ignore"):
                sure += w[factor] * np.maximum(np.minimum(mine / theirs, theirs / mine), 0.0) * (both & bit != 0)
        gap = np.abs(a.rooms[i] - b.rooms[j])
        sure += w["rooms"] * np.where(gap < 1, 1.0, np.where(gap == 1, 0.5, 0.0)) * (both & ROOMS != 0)
        sure += w["property_type"] * ((a.kind[i] == b.kind[j]) & (both & KIND != 0))
        sure += w["contact"] * ((a.contact[i] == b.contact[j]) & (both & CONTACT != 0))
        placed = both & PLACE != 0
        near = np.maximum(0.0, 1.0 - np.sqrt(np.square(a.place[i] - b.place[j]).sum(axis=1)) / NEAR_M) * placed
        sure += w["geo"] * near
        seen = self._images(i, j)
        sure += w["image"] * np.where(seen >= 0, np.maximum(0.0, 1.0 - seen / 64.0), 0.0)
        weight += w["image"] * (seen >= 0)
        maybe = promoted & (seen >= 0) & (seen <= self.most_bits) & (~placed | (near >= 0.5 - 1e-6))
        words = self._common(i, j, a.n_words, b.n_words, a.word_field, b.word_field)
        grams = self._common(i, j, a.n_grams, b.n_grams, a.gram_field, b.gram_field)
        union = a.n_words[i] + b.n_words[j] - words
        by_words = np.where(union > 0, words / np.maximum(union, 1), 1.0)
        by_grams = 2.0 * grams / np.maximum(a.n_grams[i] + b.n_grams[j], 1)
        text = np.where((a.pattern[i] ^ b.pattern[j]) & BLANK == 0, WORD_SHARE * by_words + TRIGRAM_SHARE * by_grams, 0.0)
        earned = sure + w["text"] * text
        left = (earned >= shares * weight) | maybe
        return i[left], j[left], (100.0 * earned / weight)[left], maybe[left]

    def of(self, tile: int, least: np.ndarray, promoted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs ``(i, j)`` of a tile that can reach the ``least`` of their row or may be promoted, row by row."""
        a, b = self.a, self.b
        rows = np.arange(a.starts[tile], a.starts[tile + 1])
        shares = (least[rows] - SLACK) / 100.0
        met = []
        tiles, near = self._tiles_left(tile, float(shares.min()))
        step = max(1, CHUNK_PAIRS // len(rows))
        for place in (True, False):
            which = tiles[near == place]
            others = _spans(b.starts[which], b.starts[which + 1] - b.starts[which])
            met += [self._likely(rows, others[start : start + step], shares, place) for start in range(0, len(others), step)]
        if self.promoted and a.tile_pattern[tile] & IMAGES and promoted[rows].any():
            met.append(self.promoted.of(a, rows[promoted[rows]]))
        # a pair may be found both ways
        pairs = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *[i * b.n + j for i, j in met]]))
        i, j = pairs // b.n, pairs % b.n
        return self._exact(i, j, (least[i] - SLACK) / 100.0, promoted[i])


def _sizes(probes: DataFrame, others: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Number of pieces of both sides of every scope that has rows on both."""

    def pieces(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy(*scope).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    return pieces(probes, PROBE_ROWS, "_i_n").join(pieces(others, OTHER_ROWS, "_j_n"), list(scope))


def _cut(probes: DataFrame, others: DataFrame, scope: Sequence[str], sizes: DataFrame, turn: int, partitions: int = 0) -> GroupedData:
    """One piece of the probes and all pieces of the others below each other, every pair of pieces as one group ``(scope, _j)``."""
    sizes = sizes.where(F.col("_i_n") > turn)

    def piece(of: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(of)).cast("int")

    mine = probes.join(sizes, list(scope)).where(piece("_i_n") == turn).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_j_n") - 1)))
    theirs = others.join(sizes, list(scope)).withColumn("_j", piece("_j_n"))
    sides = [rows.drop("_i_n", "_j_n").withColumn("_probe", F.lit(side)) for rows, side in ((mine, True), (theirs, False))]
    met = sides[0].unionByName(sides[1], allowMissingColumns=True)
    return (met.repartition(partitions, *scope, "_j") if partitions else met).groupBy(*scope, "_j")


def _likeliest(i: np.ndarray, bound: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs the first search returns, in order of their rows, and which of them stand for more."""
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    counts = np.diff(np.append(starts, len(i)))
    more = np.repeat(counts > FIRST_PAIRS, counts)
    kept = ~more
    for start, count in zip(starts[counts > FIRST_PAIRS], counts[counts > FIRST_PAIRS], strict=True):
        some = slice(start, start + count)
        kept[start + int(np.argmax(bound[some]))] = True
        if maybe[some].any():
            kept[start + int(np.argmax(np.where(maybe[some], bound[some], -1.0)))] = True
    return kept, more


def pairs_within(
    probes: DataFrame, others: DataFrame, scope: Sequence[str], weights: Mapping[str, float], promoted_image: float, first: bool = False
) -> DataFrame:
    """Pairs ``(a, b, bound, maybe, more)`` of ``outlines`` whose score can reach the ``_least`` of the probe row.

    ``_own`` and ``_score`` name the best partner found so far: it is left out, as
    are pairs that cannot beat it (a lower id wins at equal scores).  ``maybe``
    marks pairs whose image may promote them; they need not reach ``_least``
    where ``_promoted`` is set.  ``first`` returns the highest bound of either
    kind per probe row and piece only where a row has more than ``FIRST_PAIRS``
    pairs in the piece, and marks these with ``more``.
    """
    id_type = {f.name: f.dataType for f in probes.schema}["id"], {f.name: f.dataType for f in others.schema}["id"]
    columns = zip(("a", "b", "bound", "maybe", "more"), (*id_type, T.DoubleType(), T.BooleanType(), T.BooleanType()), strict=True)
    schema = T.StructType([T.StructField(*c) for c in columns])
    weights, most_bits = dict(weights), (1.0 - promoted_image) * 64 + 1e-9

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        sides = [table.filter(side) for side in (table["_probe"], pc.invert(table["_probe"]))]
        del table
        if all(side.num_rows for side in sides):
            yield from found(_Block(sides[0], weights, PROBE_TILE), _Block(sides[1], weights, OTHER_TILE))

    def found(left: _Block, right: _Block) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(left, right, weights, most_bits)
        least, promoted = (left.table[c].to_numpy() for c in ("_least", "_promoted"))
        has_own, score = left.table["_own"].is_valid().to_numpy(), left.table["_score"].fill_null(0).to_numpy()
        own = np.asarray(left.table["_own"].fill_null(right.table["id"][0]).to_pylist())
        ids = left.table["id"].combine_chunks(), right.table["id"].combine_chunks()
        held, size = [], 0
        for tile in range(len(left.starts) - 1):
            i, j, bound, maybe = bounds.of(tile, least, promoted)
            if len(i) and has_own[left.starts[tile] : left.starts[tile + 1]].any():
                other = right.ids[j]
                kept = ~has_own[i] | (other != own[i]) & (bound >= score[i] + np.where(other < own[i], -0.5, 0.5) - SLACK)
                i, j, bound, maybe = i[kept], j[kept], bound[kept], maybe[kept]
            more = np.zeros(len(i), dtype=bool)
            if first and len(i):
                kept, more = _likeliest(i, bound, maybe)
                i, j, bound, maybe, more = i[kept], j[kept], bound[kept], maybe[kept], more[kept]
            held.append((i, j, bound, maybe, more))
            size += len(i)
            if size >= BATCH_PAIRS or tile == len(left.starts) - 2:
                a, b, value, flag, rest = (np.concatenate(x) for x in zip(*held, strict=True))
                arrays = [ids[0].take(pa.array(a)), ids[1].take(pa.array(b)), pa.array(value, pa.float64()), pa.array(flag, pa.bool_()), pa.array(rest, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                held, size = [], 0

    if not scope:
        probes, others, scope = probes.withColumn("_all", F.lit(0)), others.withColumn("_all", F.lit(0)), ["_all"]
    sizes = checkpointed(_sizes(probes, others, scope))
    turns, groups = (x or 1 for x in sizes.agg(F.max("_i_n"), F.sum("_j_n")).first())
    # few and heavy groups: with as many partitions as that hardly any task gets several
    partitions = min(GROUP_PARTITIONS * groups, MOST_PARTITIONS)
    parts = [_cut(probes, others, scope, sizes, turn, partitions).applyInArrow(search, schema) for turn in range(turns)]
    # a shuffle holds one piece of the probes per piece of the others, however many pieces there are
    return reduce(DataFrame.unionByName, [checkpointed(p) for p in parts] if turns > 1 else parts)
