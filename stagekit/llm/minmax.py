"""Shingle sets and min-max signatures of one text (numpy and Arrow)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash

from stagekit.llm.lookup import flat_words, hashes_of

WIDTH = 5
#: Similarity in hundredths from which two sets are linked.
PERCENT = 85
#: Slots a band, and the chance that a pair of just that similarity misses every band: 24 bands at 0.85, 36 at 0.80.
ROWS, MISS = 5, 1e-6
#: Permutations there are; each gives a minimum and a maximum, so twice as many signature slots.
PERMUTATIONS, MORE = 60, 440
BLOCK = 8192

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_C = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = np.concatenate([_A, _rng.integers(0, 1 << 63, MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
_B = np.concatenate([_B, _rng.integers(0, 1 << 63, MORE, dtype=np.uint64)])


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None) -> set:
    """The distinct runs of five words; a shorter text as one run; empty without words."""
    w = words(text)
    if len(w) < WIDTH:
        return {tuple(w)} if w else set()
    return set(zip(*[w[i:] for i in range(WIDTH)]))


def permutations(percent: int) -> int:
    """Permutations whose bands miss a pair of this similarity with chance ``MISS`` at most."""
    bands = math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)) if percent < 100 else 1
    need = ROWS * math.ceil(bands / 2)
    if need > len(_A):
        raise ValueError(f"similarity too low for the bands: {percent}")
    return need


def linked(a: set, b: set, percent: int = PERCENT) -> bool:
    """Similarity of ``percent`` or more; nothing is like an empty set."""
    if not a or not b:
        return False
    small, large = sorted((a, b), key=len)
    if 100 * len(small) < percent * len(large):
        return False
    both = len(small & large)
    return 100 * both >= percent * (len(a) + len(b) - both)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hash_lists(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingle set, for all texts at once."""
    flat, counts = flat_words(texts)
    coded = flat.dictionary_encode()
    ids = hashes_of(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    padded = np.concatenate([ids, np.zeros(WIDTH, np.uint64)])
    h, first = np.zeros(len(ids), np.uint64), np.cumsum(counts) - counts
    short = np.repeat(np.where(counts < WIDTH, counts, WIDTH), counts)  # words of the run that begins here
    for i in range(WIDTH):
        h += np.where(i < short, padded[i : i + len(ids)], np.uint64(WIDTH - i)) * _C[i]
        h ^= h >> np.uint64(29)
    h = mix(h)
    return [np.unique(h[f : f + (n - WIDTH + 1 if n >= WIDTH else min(n, 1))]) for f, n in zip(first.tolist(), counts.tolist())]


def shingle_hashes(text: str | None) -> np.ndarray:
    return shingle_hash_lists(pa.array([text], pa.string()))[0]


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """Minimum and maximum under each of ``n`` permutations of a set that isn't empty."""
    least, most = np.full(n, np.iinfo(np.uint64).max), np.zeros(n, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        seen = hashes[at : at + BLOCK] * _A[:n, None] + _B[:n, None]
        least, most = np.minimum(least, seen.min(axis=1)), np.maximum(most, seen.max(axis=1))
    return np.concatenate([least, most])


def bands(sig: np.ndarray) -> np.ndarray:
    """One int64 a band, different bands apart."""
    rows = sig.reshape(-1, ROWS)
    h = np.arange(len(rows), dtype=np.uint64)
    for i in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return h.view(np.int64)


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits of the whole set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())
