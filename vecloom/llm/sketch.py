"""Shingle sets and one-permutation MinHash sketches of texts, in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Bins of a sketch, of which the first ROWS * BANDS make the bands.
BINS = 384
ROWS = 6
BANDS = 28

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACES = (np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_EDGES = np.array([(i << 64) // BINS for i in range(BINS)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    A-Z are lower-cased; words are runs of anything but space and U+0009 to U+000D. A text with fewer
    words than a shingle has its whole sequence as its one shingle; one without words has none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    if n < words:
        return mixed((h * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * _PLACES[32])
    out = h[: n - words + 1] * _PLACES[0]
    for i in range(1, words):
        out += h[i : n - words + 1 + i] * _PLACES[i]
    return np.unique(mixed(out))


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed numbers."""
    a, b = mixed(shingles ^ _PLACES[40]).sum(dtype=np.uint64), mixed(shingles * _PLACES[41]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def one_permutation(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of each bin, and which bins have one. The hash itself is the permutation."""
    at = np.searchsorted(shingles, _EDGES)
    last = np.append(at[1:], len(shingles))
    full = at < last
    return np.where(full, shingles[np.minimum(at, len(shingles) - 1)], np.uint64(0)), full


def densify(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Optimal densification: an empty bin tries bins by a hash of (bin, attempt), alike in all rows, until one is full."""
    out = values.copy()
    row, col = np.nonzero(~full)
    attempt = 0
    while len(row):
        attempt += 1
        source = (mixed(col.astype(np.uint64) * _PLACES[50] + np.array([attempt], np.uint64) * _PLACES[51]) % np.uint64(values.shape[1])).astype(np.int64)
        hit = full[row, source]
        out[row[hit], col[hit]] = values[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch (rows x BANDS)."""
    n = len(sketches)
    parts = sketches[:, : ROWS * BANDS].reshape(n, BANDS, ROWS) * _PLACES[:ROWS]
    return mixed(parts.sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACES[60])


def sketch_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Densified sketches of non-empty sets (rows x BINS)."""
    both = [one_permutation(s) for s in sets]
    return densify(np.stack([v for v, _ in both]), np.stack([f for _, f in both]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    na, nb = len(a), len(b)
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (na + nb - shared)
