"""Word shingles of whole texts as 64-bit hashes, computed over batches of bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE))
    return _powers


def chunks(texts: Iterable[str | None], limit: int = CHUNK) -> Iterator[list[bytes]]:
    """Texts as UTF-8, in lists of about ``limit`` bytes; a longer text makes a list of its own. NULL counts as empty."""
    held, size = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield held
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield held


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents in order, and the number of words of each document."""
    raw = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    data = LOWER[raw]
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]  # the last byte is a space, so every word ends
    up, down = powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * up[: len(data)])])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    limits = np.cumsum([len(d) + 1 for d in docs])
    return hashes, np.diff(np.searchsorted(start, limits), prepend=0)


def shingle_sets(docs: list[bytes], size: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its ``size``-word shingles; the whole sequence where it has fewer words."""
    words, counts = word_hashes(docs)
    k = np.uint64(0xD1342543DE82EF95)
    out, at = [], 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        width = min(n, size)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        rows = n - width + 1
        h = np.full(rows, width, np.uint64)
        for j in range(width):
            h = mix(h * k + w[j : j + rows])
        out.append(np.unique(h))
    return out
