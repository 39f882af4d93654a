"""Static range asymmetric numeral system for token ids, vectorised over the lanes of all blocks of a segment.

A segment has one table of frequencies, shared by its blocks. A block has its own lanes and its own words, so each can be
decoded alone: its entry holds where its words begin, the lanes' states (the checkpoint) and two checksums.
"""

from __future__ import annotations

import zlib

import numpy as np
import zstandard

STEPS = 256
LANES = 256
#: Up to so many distinct ids a segment has 32-bit states and 16-bit words, beyond it 64-bit states and 32-bit words.
NARROW = 1 << 15


class Damaged(ValueError):
    """A checksum doesn't match."""


class Form:
    """Widths of a segment: scale bits of the frequencies, state and word types."""

    def __init__(self, distinct: int):
        narrow = distinct <= NARROW
        self.scale = 16 if narrow else 20
        self.state, self.word, bits = (np.uint32, np.uint16, 16) if narrow else (np.uint64, np.uint32, 32)
        self.low, self.bits = self.state(1 << bits), self.state(bits)
        self.shift, self.mask, self.top = self.state(self.scale), self.state((1 << self.scale) - 1), self.state(2 * bits - self.scale)


def scaled(counts: np.ndarray, scale: int) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 each. counts: positive, fewer than 2**scale of them."""
    total, room = int(counts.sum()), (1 << scale) - len(counts)
    freq = 1 + (counts.astype(np.float64) * (room / total)).astype(np.int64)
    freq[int(np.argmax(freq))] += (1 << scale) - int(freq.sum())
    return freq


def pack_table(symbols: np.ndarray, freq: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.concatenate([np.diff(symbols, prepend=0), freq]).astype("<u4").tobytes())


def unpack_table(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def shape_of(n: int) -> tuple[int, int, int]:
    """Blocks, steps and lanes of n ids."""
    lanes = min(LANES, max(1, -(-n // STEPS)))
    return -(-n // (STEPS * lanes)), STEPS, lanes


def encode(ids: np.ndarray) -> dict:
    """table, blocks (n, word offset, payload crc, ids crc), states and words of one segment. ids: not empty."""
    held = np.bincount(ids)
    symbols = np.flatnonzero(held)
    counts = held[symbols]
    rank = np.zeros(len(held), np.int32)
    rank[symbols] = np.arange(len(symbols))
    at = rank[ids]
    form = Form(len(symbols))
    freq = scaled(counts, form.scale)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]])
    blocks, steps, lanes = shape_of(len(ids))
    common = int(np.argmax(freq))
    grid = np.full(blocks * steps * lanes, common, np.int32)
    grid[: len(ids)] = at
    grid = grid.reshape(blocks, steps, lanes)
    f_all, c_all = freq.astype(form.state), start.astype(form.state)
    x = np.full(blocks * lanes, form.low, form.state)
    block_of = np.repeat(np.arange(blocks, dtype=np.int32), lanes)
    words, owners = [], []
    for k in range(steps - 1, -1, -1):
        s = grid[:, k, :].ravel()
        f = f_all[s]
        full = np.flatnonzero((x >> form.top) >= f)
        over = x[full]
        words.append(over.astype(form.word))
        owners.append(block_of[full])
        x[full] = over >> form.bits
        q = x // f
        x = (q << form.shift) + (x - q * f) + c_all[s]
    words.reverse()
    owners.reverse()
    flat, owner = np.concatenate(words), np.concatenate(owners)
    flat = flat[np.argsort(owner, kind="stable")].astype(np.dtype(form.word).newbyteorder("<"))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=blocks))])
    size = steps * lanes
    entries = []
    for b in range(blocks):
        part = ids[b * size : (b + 1) * size]
        entries.append((len(part), int(offsets[b]), zlib.crc32(flat[offsets[b] : offsets[b + 1]].tobytes()), zlib.crc32(part.astype("<u4").tobytes())))
    return {"table": pack_table(symbols, freq), "blocks": np.array(entries, "<u4").tobytes(), "states": x.astype(np.dtype(form.state).newbyteorder("<")).tobytes(), "words": flat.tobytes(), "n": len(ids)}


def decode(segment: dict, only: list[int] | None = None) -> np.ndarray:
    """Ids of a segment, or of some of its blocks. Raises Damaged where a checksum doesn't match."""
    symbols, freq = unpack_table(segment["table"])
    entries = np.frombuffer(segment["blocks"], "<u4").reshape(-1, 4).astype(np.int64)
    form = Form(len(symbols))
    words = np.frombuffer(segment["words"], np.dtype(form.word).newbyteorder("<"))
    _, steps, lanes = shape_of(segment["n"])
    ends = np.append(entries[1:, 1], len(words))
    take = np.arange(len(entries)) if only is None else np.array(only)
    for b in take:
        if zlib.crc32(words[entries[b, 1] : ends[b]].tobytes()) != entries[b, 2]:
            raise Damaged(f"block {b}: payload")
    x = np.frombuffer(segment["states"], np.dtype(form.state).newbyteorder("<")).reshape(-1, lanes)[take].ravel().astype(form.state)
    slot_to = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    f_all, c_all = freq.astype(form.state), (np.cumsum(freq) - freq).astype(form.state)
    at = entries[take, 1].copy()
    out = np.empty((len(take), steps, lanes), np.int32)
    for k in range(steps):
        slot = x & form.mask
        s = slot_to[slot]
        out[:, k, :] = s.reshape(-1, lanes)
        x = f_all[s] * (x >> form.shift) + slot - c_all[s]
        low = (x < form.low).reshape(-1, lanes)
        need = low.sum(axis=1)
        if need.any():
            first = np.repeat(at - np.concatenate([[0], np.cumsum(need)[:-1]]), need)
            got = words[first + np.arange(len(first))].astype(form.state)
            low = np.flatnonzero(low.ravel())
            x[low] = (x[low] << form.bits) | got
            at += need
    parts = []
    for i, b in enumerate(take):
        part = symbols[out[i].ravel()[: entries[b, 0]]].astype("<u4")
        if zlib.crc32(part.tobytes()) != entries[b, 3]:
            raise Damaged(f"block {b}: ids")
        parts.append(part)
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")
