"""Range asymmetric numeral system over arrays: a static table, independent blocks of interleaved states.

Block ``b`` holds ``LANES`` states.  Symbol ``i`` of a block belongs to state
``i % LANES``, so one step codes a symbol of every state of every block.  A
state is 32 bits wide and moves 16-bit words, at most one a symbol.  Words of a
block lie in the order in which its decoder asks for them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES = 32
STEPS = 512
BLOCK = LANES * STEPS
SCALE_BITS = 16
LOW = np.uint64(1 << 16)


@dataclass
class Table:
    """Symbols that occur and their shares of ``1 << SCALE_BITS``."""

    symbols: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Table:
        symbols, counts = np.unique(values, return_counts=True)
        if len(symbols) > 1 << SCALE_BITS:
            raise ValueError(f"more than {1 << SCALE_BITS} different symbols")
        room = (1 << SCALE_BITS) - len(symbols)
        shares = 1 + counts * room // max(1, counts.sum())
        if len(shares):
            shares[np.argmax(counts)] += (1 << SCALE_BITS) - shares.sum()
        return cls(symbols.astype(np.uint32), shares.astype(np.uint64))

    def begins(self) -> np.ndarray:
        return np.cumsum(self.shares) - self.shares


@dataclass
class Blocks:
    """Coded blocks: final states, words, word offsets (checkpoints) and checksums of the symbols."""

    n: int
    states: np.ndarray
    words: np.ndarray
    offsets: np.ndarray
    checksums: np.ndarray


def _checksums(values: np.ndarray) -> np.ndarray:
    flat = np.ascontiguousarray(values, dtype="<u4")
    return np.array([zlib.crc32(flat[k : k + BLOCK]) for k in range(0, len(flat), BLOCK)], np.uint32)


def _by_step(n: int) -> tuple[int, np.ndarray]:
    """Number of blocks, and how many symbols each has."""
    blocks = -(-n // BLOCK)
    return blocks, np.minimum(n - np.arange(blocks) * BLOCK, BLOCK)


def encode(values: np.ndarray, table: Table) -> Blocks:
    """Code the symbols; all of them must be in the table."""
    n = len(values)
    blocks, held = _by_step(n)
    index = np.zeros(blocks * BLOCK, np.int64)
    index[:n] = np.searchsorted(table.symbols, values)
    index = index.reshape(blocks, STEPS, LANES)
    share, begin = table.shares, table.begins()
    state = np.full((blocks, LANES), LOW, np.uint64)
    moved = np.zeros((blocks, STEPS, LANES), bool)
    words = np.zeros((blocks, STEPS, LANES), np.uint16)
    lane = np.arange(LANES)
    for step in range(STEPS - 1, -1, -1):
        live = held > step * LANES
        if not live.any():
            continue
        last = int(np.flatnonzero(live)[-1]) + 1
        x, i = state[:last], index[:last, step]
        f = share[i]
        there = step * LANES + lane < held[:last, None]
        over = (x >= f << np.uint64(16)) & there
        words[:last, step] = x.astype(np.uint16)
        moved[:last, step] = over
        x = np.where(over, x >> np.uint64(16), x)
        new = (x // f << np.uint64(SCALE_BITS)) + x % f + begin[i]
        state[:last] = np.where(there, new, x)
    offsets = np.concatenate([[0], np.cumsum(moved.reshape(blocks, -1).sum(axis=1))]) if blocks else np.zeros(1, np.int64)
    return Blocks(n, state.astype(np.uint32), words[moved], offsets.astype(np.int64), _checksums(values))


def decode(coded: Blocks, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Symbols of the blocks ``first`` to ``last``, which need no other block; checksums are compared."""
    blocks, held = _by_step(coded.n)
    last = blocks if last is None else last
    held = held[first:last]
    symbol_of = np.repeat(np.arange(len(table.symbols)), table.shares.astype(np.int64))
    share, begin, mask = table.shares, table.begins(), np.uint64((1 << SCALE_BITS) - 1)
    state = coded.states[first:last].astype(np.uint64)
    at = coded.offsets[first:last].copy()
    out = np.zeros((last - first, STEPS, LANES), np.uint32)
    padded = np.append(coded.words, np.uint16(0))
    lane = np.arange(LANES)
    for step in range(STEPS):
        live = held > step * LANES
        if not live.any():
            break
        n = int(np.flatnonzero(live)[-1]) + 1
        x = state[:n]
        slot = x & mask
        i = symbol_of[slot.astype(np.int64)]
        out[:n, step] = table.symbols[i]
        there = step * LANES + lane < held[:n, None]
        x = np.where(there, share[i] * (x >> np.uint64(SCALE_BITS)) + slot - begin[i], x)
        need = (x < LOW) & there
        place = at[:n, None] + np.cumsum(need, axis=1) - 1
        word = padded[np.where(need, place, len(coded.words))]
        state[:n] = np.where(need, (x << np.uint64(16)) | word, x)
        at[:n] += need.sum(axis=1)
    flat = out.reshape(-1)[np.repeat(np.arange(last - first) * BLOCK, held) + np.concatenate([np.arange(h) for h in held] or [np.zeros(0, int)])]
    if not np.array_equal(_checksums(flat), coded.checksums[first:last]):
        raise ValueError("a block does not match its checksum")
    return flat
