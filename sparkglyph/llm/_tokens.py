"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once per worker.

A text is cut into pieces at places where the byte-level pre-tokenizer begins a new word whatever stands around them, so
the ids of the pieces are the ids of the text:
  - before a space that something other than white space follows;
  - between a run of letters, of digits or of other signs and a run of another of these kinds, but not after an apostrophe
    (contractions begin with it);
  - before a line end that follows no white space, and after it if no white space follows.
Only ASCII and the letters U+00C0 to U+00FF count as known kinds; nothing is cut next to other characters, except before
such a space. Pieces of up to SHORT bytes are looked up by their bytes in a hash table of arrays, all of a step at once.
Texts with special tokens are cut at these first. Tokenizers of another kind encode each text as it is.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np
import pyarrow as pa

from ._base import buffers

#: The id that ends a document.
END = 2
#: Bytes of text that a worker encodes in one step.
STEP = 1 << 20
#: Bytes of a piece that the table of arrays holds; longer ones are in a dictionary.
SHORT = 23
_OTHER, _LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _LINE = range(7)
_KIND = bytearray(256)
_KIND[0x21:0x7F] = bytes([_SIGN]) * (0x7F - 0x21)
_KIND[0x30:0x3A] = bytes([_DIGIT]) * 10
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = bytes([_LETTER]) * 26
_KIND[0x27], _KIND[0x20], _KIND[0x0A] = _QUOTE, _SPACE, _LINE
_CUT = bytearray(256)
for _a, _bs in ((_LETTER, (_DIGIT, _SIGN, _QUOTE, _LINE)), (_DIGIT, (_LETTER, _SIGN, _QUOTE, _LINE)), (_SIGN, (_LETTER, _DIGIT, _LINE)), (_QUOTE, (_LINE,))):
    for _b in _bs:
        _CUT[_a << 3 | _b] = 1
#: Pieces that are one word of the pre-tokenizer.
_ONE_WORD = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
_MASKS = [np.array([(1 << 8 * min(8, max(0, n - 8 * k))) - 1 for n in range(SHORT + 1)], np.uint64) for k in range(3)]
_TIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin and the last one ends; every text's begin and end among them."""
    kind = np.frombuffer(bytearray(data.tobytes().translate(_KIND)), np.uint8)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
    pair = kind[:-1] << np.uint8(3)
    pair |= kind[1:]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = np.frombuffer(pair.tobytes().translate(_CUT), bool)
    known = (kind >= _LETTER) & (kind <= _QUOTE)
    spaces = np.flatnonzero(kind[:-1] == _SPACE)
    cut[spaces[known[spaces + 1]]] = True
    ends = np.flatnonzero(kind[1:-1] == _LINE) + 1
    cut[ends[known[ends - 1] & known[ends + 1]] + 1] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


class Pieces:
    """Ids of pieces met so far: open addressing over rows (bytes 0-7, 8-15, 16-22 and length, place and number of ids)."""

    def __init__(self, most: int):
        self.most = most
        self.size = 0
        self.rows = np.zeros((1 << 12, 4), np.uint64)  # row 0 stands for none
        self.seen = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0
        self.step = 0
        self._deal(14)

    def _deal(self, bits: int) -> None:
        """All rows into 2^bits slots."""
        self.shift, self.slots = np.uint64(64 - bits), np.zeros(1 << bits, np.int32)
        self._place(np.arange(1, self.size + 1), *(self.rows[1 : self.size + 1, k] for k in range(3)))

    def _slot(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = a * _TIMES[0]
        h ^= b * _TIMES[1]
        h ^= c * _TIMES[2]
        h ^= h >> np.uint64(32)
        h *= _TIMES[3]
        h >>= self.shift
        return h.astype(np.int64)

    def _place(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        slot, last = self._slot(a, b, c), len(self.slots) - 1
        while len(at):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = at[free]
            rest = self.slots[slot] != at
            at, slot = at[rest], (slot[rest] + 1) & last

    def find(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The row of each piece, 0 for those that aren't there."""
        slot, last = self._slot(a, b, c), len(self.slots) - 1
        at = self.slots.take(slot)
        rows = self.rows.take(at, axis=0)
        other = np.flatnonzero(((rows[:, 0] != a) | (rows[:, 1] != b) | (rows[:, 2] != c)) & (at != 0))
        while len(other):
            slot[other] = (slot[other] + 1) & last
            at[other] = now = self.slots.take(slot[other])
            rows = self.rows.take(now, axis=0)
            other = other[((rows[:, 0] != a[other]) | (rows[:, 1] != b[other]) | (rows[:, 2] != c[other])) & (now != 0)]
        return at

    def add(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct pieces that aren't there yet."""
        n = self.size + 1
        if n + len(a) > len(self.rows):
            more = max(len(self.rows), len(a))
            self.rows = np.concatenate([self.rows, np.zeros((more, 4), np.uint64)])
            self.seen = np.concatenate([self.seen, np.zeros(more, np.int32)])
        self.rows[n : n + len(a)] = np.stack([a, b, c, (np.cumsum(counts) - counts + self.used).astype(np.uint64) << np.uint64(16) | counts.astype(np.uint64)], axis=1)
        self.hold(ids)
        self.used += len(ids)
        self.size += len(a)
        if 2 * self.size > len(self.slots):
            self._deal((4 * self.size - 1).bit_length())
        else:
            self._place(np.arange(n, n + len(a)), a, b, c)

    def hold(self, ids: np.ndarray) -> int:
        """Puts ids behind those in use, where the next ones overwrite them; returns their place."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), 2 * len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        return self.used

    def shrink(self) -> None:
        """Beyond `most` pieces, the half that was met latest stays."""
        if self.size <= self.most:
            return
        seen = self.seen[1 : self.size + 1]
        keep = np.flatnonzero(seen > np.partition(seen, self.size // 2)[self.size // 2]) + 1
        rows = self.rows[keep]
        counts = (rows[:, 3] & np.uint64(0xFFFF)).astype(np.int64)
        ids = spread(self.ids, (rows[:, 3] >> np.uint64(16)).astype(np.int64), counts)
        seen = self.seen[keep]
        self.size = self.used = 0
        self._deal(14)
        self.add(rows[:, 0], rows[:, 1], rows[:, 2], ids, counts)
        self.seen[1 : self.size + 1] = seen


def spread(store: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """store[at : at + counts] of each, one after the other."""
    ends = np.cumsum(counts)
    place = np.repeat(at - ends + counts, counts)
    place += np.arange(len(place))
    return store.take(place)


class Encoder:
    """Ids by the library. A subclass may encode words, as the pre-tokenizer cuts them, in another way."""

    #: Distinct pieces a worker remembers, and longer ones.
    remembered, long_remembered = 2_000_000, 100_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        cutter = self.description["pre_tokenizer"] or {}
        model = self.description["model"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and model["type"] == "BPE"
        self.cuts = plain and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True) and not self.description["normalizer"]
        self.special = {t.content: k for k, t in self.library.get_added_tokens_decoder().items()}
        self.cuts = self.cuts and not any(t.lstrip or t.rstrip or t.single_word for t in self.library.get_added_tokens_decoder().values())
        self.cut_special = re.compile(f"({'|'.join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))})") if self.special else None
        self.letters = byte_letters()
        self.known, self.long = Pieces(self.remembered), {}

    @cached_property
    def description(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of the pre-tokenizer, one after the other, and how many each has."""
        tokenize, letters = self.library.model.tokenize, self.letters
        found = [[t.id for t in tokenize(w.decode("latin-1").translate(letters))] for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum())), counts

    def odd_ids(self, piece: bytes) -> list[int]:
        """Ids of a piece that may be several words."""
        return self.library.encode(piece.decode(), add_special_tokens=False).ids

    def piece_ids(self, many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        one = [_ONE_WORD.fullmatch(p) is not None for p in many]
        if all(one):
            return self.word_ids(many)
        ids, n = self.word_ids([p for p, ok in zip(many, one, strict=True) if ok])
        counts = np.zeros(len(many), np.int64)
        plain = np.array(one, bool)
        counts[plain] = n
        odd = [self.odd_ids(p) for p, ok in zip(many, one, strict=True) if not ok]
        counts[~plain] = [len(x) for x in odd]
        out = np.empty(int(counts.sum()), np.uint32)
        is_plain = np.repeat(plain, counts)
        out[is_plain] = ids
        out[~is_plain] = np.fromiter((i for x in odd for i in x), np.uint32)
        return out, counts

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, and where each text's begin (one entry more than texts)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        known = self.known
        known.shrink()
        known.step += 1
        at = pieces(data, offsets)
        size = np.diff(at)
        short = size <= SHORT
        every = bool(short.all())
        begin, n = (at[:-1], size) if every else (at[:-1][short], size[short])
        padded = np.concatenate([data, np.zeros(24, np.uint8)])
        loads = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        keys = [loads[begin + 8 * k] & _MASKS[k].take(n) for k in range(3)]
        keys[2] |= n.astype(np.uint64) << np.uint64(56)
        row = known.find(*keys)
        while len(new := np.flatnonzero(row == 0)):
            mixed = (keys[0][new] * _TIMES[1] + keys[1][new]) * _TIMES[2] + keys[2][new] * _TIMES[3]
            new = new[np.unique(mixed, return_index=True)[1]]
            new = new[np.argsort(begin[new], kind="stable")]
            raw = data.tobytes()
            ids, counts = self.piece_ids([raw[a : a + k] for a, k in zip(begin[new].tolist(), n[new].tolist(), strict=True)])
            known.add(keys[0][new], keys[1][new], keys[2][new], ids, counts)
            open_ = np.flatnonzero(row == 0)
            row[open_] = known.find(*(k[open_] for k in keys))
        known.seen[row] = known.step
        where = known.rows[:, 3].take(row)
        place, counts = (where >> np.uint64(16)).astype(np.int64), (where & np.uint64(0xFFFF)).astype(np.int64)
        if not every:
            all_place, all_counts = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            all_place[short], all_counts[short] = place, counts
            ids, counts = self._long([data[at[k] : at[k + 1]].tobytes() for k in np.flatnonzero(~short).tolist()])
            all_counts[~short] = counts
            all_place[~short] = np.cumsum(counts) - counts + known.hold(ids)
            place, counts = all_place, all_counts
        ends = np.concatenate([[0], np.cumsum(counts)])
        return spread(known.ids, place, counts), ends[np.searchsorted(at, offsets)]

    def _long(self, many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out = [self.long.get(p) for p in many]
        new = list({p for p, x in zip(many, out, strict=True) if x is None})
        if new:
            ids, counts = self.piece_ids(new)
            made = dict(zip(new, np.split(ids, np.cumsum(counts)[:-1]), strict=True))
            out = [made[p] if x is None else x for p, x in zip(many, out, strict=True)]
            if len(self.long) > self.long_remembered:
                self.long = {}
            self.long.update((p, x) for p, x in made.items() if len(p) <= 200)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string array's texts one after the other, and where each text's begin (one entry more than texts)."""
        data, offsets = buffers(col)
        if not self.cuts:
            found = [x.ids for x in self.library.encode_batch_fast(_strings(data, offsets), add_special_tokens=False)]
            return np.fromiter((i for x in found for i in x), np.uint32), np.cumsum([0, *map(len, found)])
        raw = data.tobytes()
        if not any(s.encode() in raw for s in self.special):
            return self._encode(data, offsets)
        cut, after, firsts = [], [], [0]
        for text in _strings(data, offsets):
            parts = self.cut_special.split(text)
            cut += parts[::2]
            after += [self.special[s] for s in parts[1::2]] + [-1]
            firsts.append(len(cut))
        ids, at = self._encode(*buffers(pa.array(cut, pa.large_string())))
        marks = np.array(after, np.int64)
        ids = np.insert(ids, at[1:][marks >= 0], marks[marks >= 0].astype(np.uint32))
        return ids, at[firsts] + np.concatenate([[0], np.cumsum(marks >= 0)])[firsts]


def _strings(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """One per worker process, so that it outlives a task."""
    key = f"{kind.__name__}:{path}"
    if key not in _encoders:
        _encoders[key] = kind(path)
        _encoders[key].__dict__.pop("description", None)  # parsed again if asked for
    return _encoders[key]


def ended_ids(path: str, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text, then id 2: all of them, and where each text's begin (one entry more than texts)."""
    ids, at = encoder(path).encode(col)
    return np.insert(ids, at[1:], np.uint32(END)), at + np.arange(len(at))
