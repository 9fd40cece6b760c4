"""Vectorised word tokenising and hashing over Arrow string arrays.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Words are hashed to 64 bits by a
non-linear chain over their bytes, and runs of words by a tree of such steps; texts are walked in
blocks of about half a megabyte so that memory follows the words of a block, not the length of a batch.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)

_libc = ctypes.CDLL(None) if os.name == "posix" else None


def give_back() -> None:
    """Returns what this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker holds no freed memory: workers live on beside the JVM, and the next stage's tasks would add theirs."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def pieces(batch: pa.RecordBatch, text_at: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows whose texts are about two blocks long, so that memory follows these, not the batch; every text lies in one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + 2 * BLOCK_BYTES, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Final mix of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One value of two, in order.  The shifts make it non-linear, so that no sum over places can cancel out."""
    x = a * _K1 + (b ^ (b >> U64(32))) * _K2
    return x ^ (x >> U64(29))


def _levels(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """Values of all runs of 1, 2, 4, ... symbols up to longest, at the place of their first symbol."""
    out = [symbols]
    while 2 << len(out) - 1 <= longest and len(out[-1]) > 1 << len(out) - 1:
        half = 1 << len(out) - 1
        out.append(_pair(out[-1][:-half], out[-1][half:]))
    return out


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of symbols[start:end] that do not depend on where a span lies: of the two runs of a power of two that cover it, and its length."""
    sizes = np.asarray(ends) - np.asarray(starts)
    out = np.full(len(sizes), _K2, dtype=U64)
    if not len(sizes) or not sizes.max():
        return mix(out)
    for level, value in enumerate(_levels(symbols, int(sizes.max()))):
        at = np.flatnonzero(sizes >> level == 1)
        if len(at):
            out[at] = _pair(value[starts[at]], value[ends[at] - (1 << level)])
    return mix(out + sizes.astype(U64) * _K3)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, at the position of its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    level = k.bit_length() - 1
    value = _levels(words, k)[level]
    return mix(_pair(value[:n], value[k - (1 << level) : k - (1 << level) + n]) + U64(k * int(_K3) % 2**64))


class Block:
    """Words of consecutive texts of a batch: hashes, byte ranges, and the word range of each text."""

    def __init__(self, first: int, data: np.ndarray, byte_offsets: np.ndarray, lower: bool):
        self.first, self.byte_offsets = first, byte_offsets
        self.data = _LOWER[data] if lower else data
        starts, ends, hashes = [], [], []
        at, n = 0, len(data)
        while at < n:  # one round, unless a text is longer than a block
            to = min(n, at + 2 * BLOCK_BYTES)
            while to < n and not _SPACE[data[to]]:
                spaces = np.flatnonzero(_SPACE[data[to : to + BLOCK_BYTES]])
                to = to + int(spaces[0]) if len(spaces) else min(n, to + BLOCK_BYTES)
            s, e, h = _words(self.data[at:to], byte_offsets[(byte_offsets > at) & (byte_offsets < to)] - at)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h)
            at = to
        self.starts, self.ends, self.words = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((starts, np.int64), (ends, np.int64), (hashes, U64)))
        self.offsets = np.searchsorted(self.starts, byte_offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[cuts] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, _word_hashes(data, starts, ends)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A chain of mixes over the eights of each word's bytes; of words beyond 1,024 bytes, 64 bits of a digest."""
    sizes = ends - starts
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    masks = np.concatenate([(U64(1) << np.arange(0, 64, 8, dtype=U64)) - U64(1), [~U64(0)]])
    out = (eights[starts] & masks[np.minimum(sizes, 8)]) * _K1 + sizes.astype(U64) * _K3
    out = (out ^ (out >> U64(32))) * _K2
    more, at = np.flatnonzero((sizes > 8) & (sizes <= 1024)), 8
    while len(more):
        left = sizes[more] - at
        out[more] = _pair(out[more], eights[starts[more] + at] & masks[np.minimum(left, 8)])
        more, at = more[left > 8], at + 8
    for i in np.flatnonzero(sizes > 1024):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(texts: pa.Array, lower: bool = False) -> Iterator[Block]:
    """The words of all texts, block by block; every text lies in one block."""
    data, offsets = text_bytes(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to
