"""SetSketch registers of sets of 64-bit hashes, their bands, and joint estimation.

A register keeps the minimum, over the elements of a set, of an exponentially distributed value; the minimum is
stored on an exponential scale of base ``B``, truncated to 16 bits.  Registers of a union are the maxima of the stored
values, so sketches merge; two registers agree with a probability close to the Jaccard similarity, so they band.
The values of one element over all registers are drawn without replacement in ascending strata, which lets most sets
stop after a few draws per element.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

M, B, A, TOP = 256, 1.001, 20.0, 65_535
#: A pair at the threshold may share no band with this probability.
MISS = 1e-5
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Elements sketched at once.
CHUNK = 150_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; a shorter text is one run; no words, no run."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.full(max(1, len(words) - width + 1), min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        out = mix(out * GOLD + h[k : k + len(out)])
    return np.unique(out)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set the minimum of each register, as a quantile in [0, 1)."""
    n = len(sets)
    regs = np.ones((n, M))
    flat = regs.reshape(-1)
    h = np.concatenate(sets)
    at = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    first, step = (h & np.uint64(M - 1)).astype(np.int64), ((h >> np.uint64(8)) & np.uint64(M - 1)).astype(np.int64) | 1
    for j in range(M):
        u = (mix(h + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        np.minimum.at(flat, at * M + ((first + j * step) & (M - 1)), (j + u) / M)
        if j < 8 or j % 8 == 0:
            open_ = regs.max(axis=1) > (j + 1) / M
            if not open_.all():
                left = open_[at]
                if not left.any():
                    break
                h, at, first, step = h[left], at[left], first[left], step[left]
    return regs


def stored(quantiles: np.ndarray) -> np.ndarray:
    x = -np.log1p(-np.clip(quantiles, 1e-300, 1 - 1e-16)) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP).astype(np.uint16)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M registers for each non-empty set."""
    out, start = [], 0
    sizes = np.cumsum([len(s) for s in sets])
    while start < len(sets):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + CHUNK, "right")))
        out.append(stored(minima(sets[start:end])))
        start = end
    return np.concatenate(out) if out else np.empty((0, M), np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_rows(similarity: float) -> int:
    """The most registers a band can have for the threshold; more registers give fewer buckets of unlike sets."""
    return max(r for r in range(1, 17) if r == 1 or (1 - similarity**r) ** (M // r) <= MISS)


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """M // rows keys for each sketch, the band's number mixed in."""
    out = np.empty((len(regs), M // rows), np.uint64)
    for k in range(M // rows):
        key = np.full(len(regs), k + 1, np.uint64)
        for r in range(rows):
            key = mix(key * GOLD + regs[:, k * rows + r].astype(np.uint64))
        out[:, k] = key
    return out.view(np.int64)


GRID = np.linspace(0, 1, 401)


def estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches by maximum likelihood, given the sizes of the sets."""
    above, below = (ka > kb).sum(1), (ka < kb).sum(1)
    equal = ka.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = GRID[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    fit = above[:, None] * np.log(up + tiny) + below[:, None] * np.log(down + tiny) + equal[:, None] * np.log(np.maximum(1 - up - down, 0) + tiny)
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]
