"""Words of a text as 64-bit hashes, for whole arrays at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_SEQUENCE = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
#: Fixed value: the bytes of \x20 and \x09-\x0D.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
#: Multipliers of the places in a word, by seed.
_places: dict[int, np.ndarray] = {}


def _multipliers(n: int, seed: int) -> np.ndarray:
    """One number for each place, drawn by place and seed: a byte at another place, or the same bytes under another seed, weigh anew."""
    if len(_places.get(seed, ())) < n:
        _places[seed] = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(np.array([seed + 1], np.uint64)))
    return _places[seed]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes, fold: bool = False, seed: int = 0) -> np.ndarray:
    """One hash for each word, that is each run without blanks; fold: A-Z count as a-z.

    A multilinear hash: bytes as random numbers, times the random numbers of their places, summed. Words that clash under one seed need not under another.
    """
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(raw)]])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = (_FOLDED if fold else _BYTE)[raw[~blank]]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return mixed(np.add.reduceat(letters * _multipliers(int(lengths.max()), seed)[place], first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.full(m, np.uint64(n))
    for j in range(n):
        out += words[j : j + m] * _SEQUENCE[j]
    return mixed(out)
