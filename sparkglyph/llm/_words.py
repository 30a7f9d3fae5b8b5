"""Words and shingles as 64-bit hashes, computed over whole Arrow buffers at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPAN = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + _SPAN, "right")))
        seg = data[base : int(ends[last - 1])].astype(np.uint64) + np.uint64(1)
        up, down = _power(max(len(seg) + 1, _SPAN + 1))
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(seg * up[: len(seg)], out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return out


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin in them (one entry more than texts).

    inside: which bytes belong to a word; by default all but space and 0x09-0x0D."""
    if inside is None:
        inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its shingles of `width` words, A-Z lower-cased; with fewer words the
    whole sequence is one shingle; without words the set is empty."""
    data = LOWER[data]
    starts, ends, of = words(data, offsets)
    w = hash_spans(data, starts, ends)
    many = max(0, len(w) - width + 1)
    s = np.zeros(many, np.uint64)
    for k in range(width):
        s = mix(s + w[k : k + many] * np.uint64(2 * k + 3))
    out = []
    for a, b in zip(of[:-1], of[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for v in w[a:b]:
                    x = mix(np.array([x * np.uint64(31) + v]))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class HashIndex:
    """Places of 64-bit hashes in an array of distinct ones, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, len(keys), np.int32)
        last, none = (1 << bits) - 1, len(keys)
        at = np.arange(len(keys))
        slot = (keys >> self.shift).astype(np.intp)
        while len(at):
            free = self.slots[slot] == none
            self.slots[slot[free]] = at[free]
            rest = self.slots[slot] != at
            at, slot = at[rest], (slot[rest] + 1) & last

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, the number of keys for those that aren't there."""
        none, last = len(self.keys) - 1, len(self.slots) - 1
        slot = (h >> self.shift).astype(np.intp)
        at = self.slots.take(slot)
        other = np.flatnonzero((self.keys.take(at) != h) & (at != none))
        while len(other):
            slot[other] = (slot[other] + 1) & last
            at[other] = now = self.slots.take(slot[other])
            other = other[(self.keys.take(now) != h[other]) & (now != none)]
        return at
