"""Words and word shingles of many texts at once, as 64-bit hashes computed with numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits each depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, U)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def word_hashes(
    data: np.ndarray, starts: np.ndarray, solid: np.ndarray | None = None, block: int = 1 << 20
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of the texts that begin at ``starts`` in ``data``, ASCII letters lowered.

    Words are runs of ``solid`` bytes (all but white space if not given). The bytes are taken in blocks that end
    between words, so that one very long text needs no more memory for its temporaries than many short ones.
    """
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    solid = ~SPACE[data] if solid is None else solid
    hashes, places, ends, at = [], [], [], 0
    while at < len(data):
        end = min(len(data), at + block)
        while end < len(data) and solid[end] and not first[end]:
            # The rest of a word: look for its end a little further on.
            step = min(len(data), end + 4096)
            gap = np.flatnonzero(~solid[end:step] | first[end:step])
            end = end + int(gap[0]) if len(gap) else step
        part, body, cut = data[at:end], solid[at:end], first[at : end + 1].copy()
        cut[0] = True
        begin = body & cut[:-1]
        begin[1:] |= body[1:] & ~body[:-1]
        finish = body & np.append(cut[1:-1], True)
        finish[:-1] |= body[:-1] & ~body[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        up, down = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum((LOWER[part].astype(U) + U(1)) * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U)))
        places.append(s + at)
        ends.append(e + at)
        at = end
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(ends)


def combine(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, by the place of the first."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(size):
        total += mix(words[j : j + n] + U((_BASE * (2 * j + 3)) & _MASK))
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its word shingles; all words as one shingle if they are fewer."""
    words, places, _ = word_hashes(data, offsets[:-1])
    edges = np.searchsorted(places, offsets)
    runs = combine(words, size)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(combine(words[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out
