"""Shingle sets of many texts at once, in numpy: signatures, bands and exact Jaccard.

Texts of a batch are numbered; a set is a run of sorted keys ``number << BITS | hash``, so one
sort makes the sets of a whole batch and one merge counts what two batches share. Hashes have
48 bits: two of a text's n shingles are taken for one with a chance of about n^2 / 2^49.

A signature has bands * width values: for each of so many fixed points of the hash range the
first hash of the set at or after it (the smallest after the last). Two sets agree at a point
with a chance equal to their Jaccard. A band is a hash of width neighbouring values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

CHARS, WORDS = 8, 5
BITS = 48
#: Characters (bytes of word shingles) and texts that are hashed at once.
MOST_CHARS, MOST_TEXTS = 1 << 19, 1 << 15
_LOW = np.uint64((1 << BITS) - 1)
_M = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _short(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data)


def _sets(number: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    keys = np.sort(number.astype(np.uint64) << np.uint64(BITS) | hashes & _LOW)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def char_sets(texts: list[str]) -> np.ndarray:
    """Keys of the runs of CHARS characters at every position; a shorter text is one shingle."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    m = [np.uint64(pow(_M, k, 1 << 64)) for k in (1, 2, 4)]
    with np.errstate(over="ignore"):
        for k, step in enumerate((1, 2, 4)):
            c = c[:-step] * m[k] + c[step:] if len(c) > step else c[:0]
        h = _mix(c)
    # a run that goes on into the next text counts for none
    starts = np.cumsum(sizes) - sizes
    own = np.maximum(sizes - CHARS + 1, 0)
    at = np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    number, hashes = np.repeat(np.arange(len(texts)), own), h[at]
    if len(few := np.flatnonzero(own == 0)):
        number = np.concatenate([number, few])
        hashes = np.concatenate([hashes, np.array([_short(texts[k].encode("utf-8", "surrogatepass")) for k in few], dtype=np.uint64)])
    return _sets(number, hashes)


def word_sets(texts: list[bytes]) -> np.ndarray:
    """Keys of the runs of WORDS words of texts in UTF-8 that single blanks split; a shorter
    text is one shingle. Hashes of all runs come from one prefix sum of weighted bytes."""
    number, hashes = [], []
    for k, text in enumerate(texts):
        blanks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
        n = len(blanks) + 1 - WORDS + 1
        if n < 2:
            number.append(np.array([k]))
            hashes.append(np.array([_short(text)], dtype=np.uint64))
            continue
        starts = np.concatenate([[0], blanks[: n - 1] + 1])
        ends = np.append(blanks, len(text))[WORDS - 1 :]
        own = np.empty(n, dtype=np.uint64)
        first = 0
        while first < n:  # whole runs in pieces of bounded size; one run may be longer
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + MOST_CHARS, side="right")))
            a, b = starts[first:last] - starts[first], ends[first:last] - starts[first]
            up, down = _powers(int(b[-1]))
            with np.errstate(over="ignore"):
                data = np.frombuffer(text, dtype=np.uint8, count=int(b[-1]), offset=int(starts[first])).astype(np.uint64) + np.uint64(1)
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(data * up[: len(data)], dtype=np.uint64)])
                own[first:last] = _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            first = last
        number.append(np.full(n, k))
        hashes.append(own)
    return _sets(np.concatenate(number), np.concatenate(hashes)) if texts else np.zeros(0, dtype=np.uint64)


_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64; kept up to MOST_CHARS."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 14)
        with np.errstate(over="ignore"):
            made = [np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, x, dtype=np.uint64)]), dtype=np.uint64) for x in (np.uint64(_M), np.uint64(pow(_M, -1, 1 << 64)))]
        if n > 2 * MOST_CHARS:
            return made[0], made[1]
        _tables[:] = made
    return _tables[0], _tables[1]


def bounds(keys: np.ndarray, texts: int) -> np.ndarray:
    """Where the set of each text begins, and where the last one ends."""
    return np.searchsorted(keys, np.arange(texts + 1, dtype=np.uint64) << np.uint64(BITS))


def signatures(keys: np.ndarray, texts: int, bands: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes [texts, bands], sizes of the sets)."""
    at = bounds(keys, texts)
    points = np.arange(bands * width, dtype=np.uint64) * np.uint64((1 << BITS) // (bands * width))
    found = np.searchsorted(keys, (np.arange(texts, dtype=np.uint64)[:, None] << np.uint64(BITS) | points[None, :]).ravel()).reshape(texts, -1)
    values = keys[np.where(found < at[1:, None], found, at[:-1, None])] & _LOW
    with np.errstate(over="ignore"):
        out = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), (texts, bands)).copy()
        for k in range(width):
            out = _mix(out + values[:, k::width])
    return out.view(np.int64), np.diff(at)


def shared(x: np.ndarray, y: np.ndarray, texts: int) -> np.ndarray:
    """How many hashes the sets of each number have in common."""
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:][both[1:] == both[:-1]]
    return np.bincount((twice >> np.uint64(BITS)).astype(np.int64), minlength=texts)


def groups(sizes: list[int]) -> Iterator[slice]:
    """Slices of at most MOST_TEXTS texts and about MOST_CHARS characters; a longer text comes alone."""
    at = held = 0
    for k, n in enumerate(sizes):
        if k > at and (held + n > MOST_CHARS or k - at >= MOST_TEXTS):
            yield slice(at, k)
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def jaccard(a: list, b: list, sets: Callable[[list], np.ndarray]) -> Iterator[np.ndarray]:
    """For slices of pairs in turn: (shared, size of a's set, size of b's) as columns."""
    for s in groups([len(x) + len(y) for x, y in zip(a, b, strict=True)]):
        n = s.stop - s.start
        x, y = sets(a[s]), sets(b[s])
        yield np.stack([shared(x, y, n), np.diff(bounds(x, n)), np.diff(bounds(y, n))], axis=1)
