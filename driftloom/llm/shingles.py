"""Word and shingle hashes of many texts at once, in numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1 << 19
SEED = 20240229

_rng = np.random.default_rng(SEED)
_odd = lambda n: _rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = [0x20, *range(0x09, 0x0E)]
_BYTE = _odd(256)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[_SPACES] = True
_BASE = _odd(1)[0]
_PLACE = _odd(16)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256), _BASE, np.uint64))])
    return _powers


def texts_of(column) -> Iterator[bytes]:
    """The texts of an Arrow column in UTF-8, one at a time, so that a batch is never held twice."""
    return (x.as_py().encode() for x in column)


def chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, in lists of about CHUNK_BYTES; a longer text is a list of its own."""
    own, total = [], 0
    for text in texts:
        own.append(text)
        total += len(text)
        if total >= CHUNK_BYTES:
            yield own
            own, total = [], 0
    if own:
        yield own


def runs(joined: np.ndarray, outside: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Where each maximal run of bytes not marked in outside starts, its 64-bit hash, and one of each of its prefixes of so many bytes; the last byte must be outside."""
    out = outside[joined]
    starts = np.flatnonzero(~out & np.concatenate([[True], out[:-1]]))
    if not len(starts):
        return starts, *[np.zeros(0, np.uint64)] * (1 + len(prefixes))
    lengths = np.diff(np.append(starts, len(joined)))
    place = np.arange(starts[0], len(joined)) - np.repeat(starts, lengths)
    value = np.where(outside, np.uint64(0), _BYTE)[joined[starts[0] :]] * _power_table(int(lengths.max()))[place]
    sums = [np.add.reduceat(x, starts - starts[0]) + np.uint64(k) for k, x in ((0, value), *((k, value * (place < k)) for k in prefixes))]
    return starts, *map(mix, sums)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word of each text, the index where each text's words begin plus the total)."""
    starts, hashes = runs(np.frombuffer(b" ".join(texts) + b" ", np.uint8), _IS_SPACE)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingle_sets(texts: Iterable[bytes], words: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of windows of so many words, letters A-Z lowered; one for all words of a shorter text, none without words."""
    for own in chunks(texts):
        h, bounds = word_hashes([t.lower() for t in own])
        n = len(h) - words + 1
        if n > 0:
            windows = h[:n] * _PLACE[0]
            for k in range(1, words):
                windows += h[k : k + n] * _PLACE[k]
            windows = mix(windows)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                yield np.unique(windows[a : b - words + 1])
            elif b > a:
                yield mix((h[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _PLACE[8 + b - a])
            else:
                yield h[:0]
