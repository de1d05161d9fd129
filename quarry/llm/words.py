"""Words of many texts at once, as numpy arrays: where they lie in the joined bytes, and a 64-bit hash of each."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
U = np.uint64
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Longer words are hashed by blake2: a polynomial modulo 2**64 can't tell some long words apart, whatever its base.
LONG_WORD = 64
#: Texts are worked on together up to so many bytes; a longer one stands alone.
BATCH_BYTES = 1 << 20


@functools.lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """At least n + 1 powers of the base; one array a base is kept, and grows when it must."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) <= n:
        with np.errstate(over="ignore"):
            kept = _POWERS[base] = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, base, dtype=U)]), dtype=U)
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end], by differences of one running polynomial; of long ones, by blake2."""
    size = 1 << max(16, int(len(buf)).bit_length())
    up, down = _powers(size, MULTIPLIER), _powers(size, pow(MULTIPLIER, -1, 1 << 64))
    with np.errstate(over="ignore"):
        run = np.zeros(len(buf) + 1, dtype=U)
        np.cumsum(_bytes_table()[buf] * up[:len(buf)], out=run[1:])
        out = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def batches(texts: list[bytes]):
    """Slices (a, b) of texts that together hold about BATCH_BYTES."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_BYTES:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes, a newline after each text, and where each text begins (with one more for the end)."""
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), begins


def white_words(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space, and the number of them in each text."""
    inside = np.concatenate([[False], ~SPACES[buf], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.diff(np.searchsorted(starts, begins))


def token_words(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut at each single space between two non-spaces: starts, ends, the number in each text, and whether a space goes before.

    A byte next to the space that may belong to some other white space keeps
    the space from being a cut, so no white-space run is ever divided.
    """
    at = np.flatnonzero(buf == 0x20)
    at = at[(at >= 3) & (at < len(buf) - 1)]
    after, b1, b2, b3 = buf[at + 1], buf[at - 1], buf[at - 2], buf[at - 3]
    odd = (after <= 0x20) | (b1 <= 0x20) | np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))
    odd |= (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    odd |= np.isin(b3, (0xE1, 0xE2, 0xE3)) & np.isin(b2, (0x80, 0x81, 0x9A))
    cuts = at[~odd]
    # each text begins a word as well; its newline isn't part of its last word
    starts = np.concatenate([begins[:-1], cuts + 1])
    ends = np.concatenate([cuts, begins[1:] - 1])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.sort(ends)
    spaced = np.ones(len(starts), dtype=bool)
    first = np.searchsorted(starts, begins[:-1])
    spaced[first] = False
    return starts, ends, np.diff(np.append(first, len(starts))), spaced


class Known:
    """A sorted table from word hash to a row of values; it starts anew when it holds ``limit`` words."""

    def __init__(self, limit: int = 1 << 21):
        self.limit, self.keys, self.rows, self.n = limit, np.zeros(0, U), np.zeros(0, np.int64), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for a new one."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """New rows for new (distinct, sorted) keys."""
        rows = np.arange(self.n, self.n + len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows, self.n = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows), self.n + len(keys)
        return rows
