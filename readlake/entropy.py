"""Entropy coding of symbol streams in numpy: many interleaved range-variant (rANS) states, tables by context.

A stream is cut into lanes of consecutive symbols; all lanes take a step at once, so the loop is over the
steps of one lane and not over symbols. Tables are counted over the block and stored beside the words;
a symbol's context is made of the symbols before it in its lane.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import zstandard

#: Bits of a table's scale, least state, lanes at most and steps of a lane at least.
BITS, LEAST, LANES, STEPS = 12, 1 << 16, 4096, 512

Context = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]
#: Contexts by name: (of the last symbol, the one before, the one before that, alphabet), and how many there are.
CONTEXTS: dict[str, tuple[Context, Callable[[int], int]]] = {
    "none": (lambda a, b, c, n: np.zeros_like(a), lambda n: 1),
    "last": (lambda a, b, c, n: a, lambda n: n),
    "quality": (lambda a, b, c, n: a * n + np.maximum(b, c), lambda n: n * n),
    # joint symbols: the last one, and the base of the one before (8 symbols a base, escapes from 40 on)
    "joint": (lambda a, b, c, n: a * 5 + np.where(b < 40, b >> 3, b - 40), lambda n: n * 5),
}


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Tables that sum to 1 << BITS, no symbol that occurs at 0."""
    total = counts.sum(1, keepdims=True)
    out = np.where(counts > 0, np.maximum(1, (counts << BITS) // np.maximum(1, total)), 0)
    for row in np.flatnonzero((total[:, 0] > 0) & (out.sum(1) != 1 << BITS)):
        off = (1 << BITS) - int(out[row].sum())
        while off:
            top = int(out[row].argmax())
            step = off if off > 0 else max(off, -(int(out[row, top]) // 2))
            out[row, top] += step
            off -= step
    return out


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def encode(symbols: np.ndarray, alphabet: int, context: str = "last") -> bytes:
    """``symbols`` below ``alphabet`` as bytes."""
    if not 0 < alphabet <= 1 << (BITS - 2):
        raise ValueError(f"alphabet of {alphabet}")
    n = len(symbols)
    if not n:
        return struct.pack("<QH", 0, alphabet)
    of, contexts = CONTEXTS[context][0], CONTEXTS[context][1](alphabet)
    lanes, steps = _lanes(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)  # a row is a step
    before = np.concatenate([np.zeros((3, lanes), np.int32), grid])
    flat = of(before[2:-1], before[1:-2], before[:-3], alphabet) * np.int32(alphabet) + grid
    counts = np.bincount(flat.ravel(), minlength=contexts * alphabet).reshape(contexts, alphabet)
    freq = _scaled(counts)
    start = (np.cumsum(freq, 1) - freq).ravel().astype(float)
    share, words = freq.ravel().astype(float), []
    # states below 2 ** 32 are exact as floats, and so are their quotients by at most 2 ** BITS, rounded down
    x = np.full(lanes, float(LEAST))
    for t in range(steps - 1, -1, -1):
        f = share[flat[t]]
        full = np.flatnonzero(x >= f * (1 << (32 - BITS)))
        high = np.floor(x[full] / 65536)
        words.append((x[full] - high * 65536).astype("<u2"))
        x[full] = high
        q = np.floor(x / f)
        x += q * ((1 << BITS) - f) + start[flat[t]]
    used = np.flatnonzero(counts.sum(1))
    table = zstandard.compress(used.astype("<u4").tobytes() + freq[used].astype("<u2").tobytes(), 9)
    return struct.pack("<QHII", n, alphabet, len(used), len(table)) + table + x.astype("<u4").tobytes() + np.concatenate(words[::-1]).tobytes()


def decode(data: bytes, context: str = "last") -> np.ndarray:
    n, alphabet = struct.unpack_from("<QH", data)
    if not n:
        return np.empty(0, np.uint16)
    rows, size = struct.unpack_from("<II", data, 10)
    table = zstandard.decompress(data[18 : 18 + size])
    of, contexts = CONTEXTS[context][0], CONTEXTS[context][1](alphabet)
    used = np.frombuffer(table[: 4 * rows], "<u4")
    freq = np.zeros((contexts, alphabet), np.int64)
    freq[used] = np.frombuffer(table[4 * rows :], "<u2").reshape(rows, alphabet)
    start = np.cumsum(freq, 1) - freq
    slots = np.zeros((contexts, 1 << BITS), np.uint16)
    for row in used:
        slots[row] = np.repeat(np.arange(alphabet, dtype=np.uint16), freq[row])
    lanes, steps = _lanes(n)
    x = np.frombuffer(data, "<u4", lanes, 18 + size).astype(np.int64)
    words, next_word = np.frombuffer(data, "<u2", offset=18 + size + 4 * lanes).astype(np.int64), 0
    out = np.zeros((steps + 3, lanes), np.int32)
    # of each slot its symbol, and of each symbol in its context the share, and how far the slot is past the start
    freq, start, slots = freq.ravel().astype(np.int32), start.ravel().astype(np.int32), slots.ravel()
    for t in range(steps):
        at = of(out[t + 2], out[t + 1], out[t], alphabet)
        slot = x & (1 << BITS) - 1
        symbol = slots[(at << BITS) + slot]
        where = at * np.int32(alphabet) + symbol
        x = freq[where] * (x >> BITS) + slot - start[where]
        low = np.flatnonzero(x < LEAST)
        x[low] = x[low] << 16 | words[next_word : next_word + len(low)]
        next_word += len(low)
        out[t + 3] = symbol
    return np.ascontiguousarray(out[3:].T).ravel()[:n].astype(np.uint16)
