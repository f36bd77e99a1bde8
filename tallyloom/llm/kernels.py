"""Numpy kernels over packed UTF-8 bytes, shared by the Arrow operators of this subpackage.

Texts stay in the Arrow buffer; no Python string is made per word. A null text counts as empty.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CHUNK_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def per_worker(key: str, make: Callable[[], object]):
    """A table that one Python worker makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("_tallyloom_kept", ModuleType("_tallyloom_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_values(seed: int = 0) -> np.ndarray:
    return per_worker(f"byte_values {seed}", lambda: mix(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=np.uint64) * BASE) | np.uint64(1))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for 0 <= i <= n, modulo 2**64."""
    kept = per_worker("powers", dict)
    if len(kept.get("up", ())) <= n:
        size = max(n, CHUNK_BYTES) + 1
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            kept[name] = np.multiply.accumulate(x)
    return kept["up"], kept["down"]


def prefix_hashes(buf: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """c with c[j] - c[i] = hash of buf[i:j] times BASE**i."""
    up, _ = powers(len(buf))
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((byte_values() if values is None else values)[buf] * up[: len(buf)], out=c[1:])
    return c


def span_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(c))
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def packed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return buf, at - at[0]


def groups(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about limit bytes together; a longer text is a range by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, offsets: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the words [^\\x20\\x09-\\x0D]+, or of what bytes with apart keep apart; a text's end ends a word."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~apart[buf]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def ramps(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
