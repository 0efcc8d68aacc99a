"""Anchored runs of windows: which windows of a text share their least gram.

Every window of `window` units (words or bytes) has one anchor, the least hashed gram of
`gram` units inside it. Consecutive windows with one anchor form a run. The anchor depends
on the window's content alone, so equal windows anywhere in the corpus meet under equal
anchors, and only about 2 / (window - gram + 2) of the positions are anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: units handled at a time; positions take the low 20 bits of a sort key
BLOCK = 1 << 20
#: bytes handled at a time, whatever the units; a block holds one window of units at least
BLOCK_BYTES = 1 << 20
LOW = np.uint64(BLOCK - 1)
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base, of its inverse mod 2^64, and a random number per byte."""
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.full(n, BASE, np.uint64))
        down = np.multiply.accumulate(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
    return up, down, np.random.default_rng(20).integers(1, MASK, 256, dtype=np.uint64, endpoint=True)


def gram_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[first:last]; equal bytes have equal hashes wherever they stand."""
    up, down, letters = _powers(1 << max(20, int(len(data) - 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(letters[data] * up[:len(data)], out=sums[1:])
        h = (sums[last] - sums[first]) * down[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive keys, by prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, MASK, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchored_runs(data: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray, window: int, gram: int
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start unit, windows, anchor hash) of the runs of a block.

    Unit i is data[first[i]:last[i]] and belongs to text owner[i]; windows that cross
    texts are left out.
    """
    n = len(first)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(data, first[:n - gram + 1], last[gram - 1:])
    keys = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_least(keys, window - gram + 1) & LOW).astype(np.int64)
    valid = owner[:n - window + 1] == owner[window - 1:]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:len(anchor)] != owner[:len(anchor) - 1]) | ~valid[:-1]
    new &= valid
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(anchor))
    stop = np.concatenate([[0], np.cumsum(valid)])
    return starts, stop[ends] - stop[starts], hashes[anchor[starts]].view(np.int64)


def packed_blocks(texts: list[bytes], units, window: int) -> Iterator[tuple]:
    """(data, first, last, owner, base) blocks of fewer than BLOCK units and about BLOCK_BYTES bytes.

    `units(text)` gives unit starts and ends. Short texts are laid end to end; a longer
    one is cut into blocks that overlap by window - 1 units. base[i] is the number of
    units of text i before its part of the block.
    """
    parts, held, held_bytes = [], 0, 0
    for k, text in enumerate(texts):
        first, last = units(text)
        at = 0
        while at + window <= len(first):
            fit = int(np.searchsorted(last, first[at] + BLOCK_BYTES, side="right"))
            stop = min(at + BLOCK - 1, len(first), max(fit, at + window))
            a, b = first[at:stop], last[at:stop]
            size = int(b[-1] - a[0])
            if parts and (held + len(a) >= BLOCK or held_bytes + size > BLOCK_BYTES):
                yield _join(parts)
                parts, held, held_bytes = [], 0, 0
            parts.append((k, at, text[int(a[0]):int(b[-1])], a - a[0], b - a[0], size))
            held, held_bytes = held + len(a), held_bytes + size
            if stop >= len(first):
                break
            at = stop - window + 1
    if parts:
        yield _join(parts)


def _join(parts: list[tuple]) -> tuple:
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    shift = np.cumsum([0] + [p[5] for p in parts[:-1]])
    first = np.concatenate([p[3] + s for p, s in zip(parts, shift)])
    last = np.concatenate([p[4] + s for p, s in zip(parts, shift)])
    counts = [len(p[3]) for p in parts]
    part = np.repeat(np.arange(len(parts)), counts)
    unit0 = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return data, first, last, part, np.array([p[0] for p in parts]), np.array([p[1] for p in parts]) - unit0


def word_units(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and ends of a text whose words are joined by single spaces."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(text)]])


def byte_units(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(text)), np.arange(1, len(text) + 1)


def text_runs(texts: list[bytes], units, window: int, gram: int, digests: bool = True) -> Iterator[tuple]:
    """(text numbers, start units, windows, anchors, two digest halves) arrays, block by block.

    A run's digest is the 128-bit hash of all bytes that its windows cover; without `digests` both halves are None.
    """
    import xxhash
    digest = xxhash.xxh3_128_digest
    for data, first, last, part, text_of, base in packed_blocks(texts, units, window):
        starts, count, anchor = anchored_runs(data, first, last, part, window, gram)
        if not len(starts):
            continue
        own = part[starts]
        if not digests:
            yield text_of[own], starts + base[own], count, anchor, None, None
            continue
        raw = data.tobytes()
        spans = zip(first[starts].tolist(), last[starts + count + window - 2].tolist())
        halves = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in spans]), "<i8").reshape(-1, 2)
        yield text_of[own], starts + base[own], count, anchor, halves[:, 0], halves[:, 1]
