"""Byte-pair encoding by speculation and verification, and decoding.

Of every distinct word greedy longest match proposes tokens. A sequence is what merging would give exactly if each pair of
neighbours is (a token alone has to be reachable by merges itself), so all adjacent pairs of a batch are tested at once:
the merges that made the two tokens are undone step by step, latest first, and a pair fails if at some step the two parts
that touch would have been merged before. Only words with a pair that fails are merged exactly, with a heap over linked
parts if they are long.

Words are those of the library's own pre-tokenizer; special tokens stand in the text as their strings and get their ids.

Defined cases: null text counts as empty, without ids; repeated rows each get a row; a null doc_id stays null. Extra columns
are ignored. Tokenizers that aren't byte-level BPE, or in which two merges make one token, raise ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._base import documents, id_text, table, text_steps, tidied
from ._tokens import STEP, Encoder, default_tokenizer, encoder, spread

#: Letters up to which a word's pairs are looked through for the best one each time.
PLAIN = 32


class SpeculativeBpe(Encoder):
    """Tokens are numbered by their making: 0 to 255 the bytes, then what each merge makes."""

    def __init__(self, path: str):
        super().__init__(path)
        if not self.cuts:
            raise ValueError(f"{path}: this isn't a byte-level BPE tokenizer")
        letters = {c: b for b, c in self.letters.items()}
        vocab: dict[str, int] = self.description["model"]["vocab"]
        self.made = {bytes([b]): b for b in range(256)}
        self.rank: dict[int, int] = {}
        left, right = list(range(256)), list(range(256))
        for merge in self.description["model"]["merges"]:
            a, b = (bytes(map(letters.__getitem__, x)) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            if a + b in self.made:
                raise ValueError(f"{path}: two merges make {a + b!r}")
            self.rank[self.made[a] << 32 | self.made[b]] = len(left)
            left.append(self.made[a])
            right.append(self.made[b])
            self.made[a + b] = len(left) - 1
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.strings = list(self.made)
        self.ids = np.array([vocab.get("".join(map(self.letters.__getitem__, s)), 0) for s in self.strings], np.uint32)
        self.longest: dict[bytes, int] = {}  # of tokens with the same first four bytes
        for s in self.strings:
            if len(s) >= 4:
                self.longest[s[:4]] = max(self.longest.get(s[:4], 4), len(s))
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.keys, self.products = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        self.whole = np.zeros(len(left), np.int8)  # 0: not known yet, 1: merging its bytes gives the token, 2: it doesn't
        self.whole[:256] = 1
        # what ids decode to, and their decimals with a comma behind each
        size = max([*vocab.values(), *self.special.values()], default=-1) + 1
        parts = [b""] * size
        for t, k in vocab.items():
            parts[k] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        for t, k in self.special.items():
            parts[k] = t.encode()
        self.part_size = np.array([len(x) for x in parts], np.int64)
        self.part_at = np.cumsum(self.part_size) - self.part_size
        self.part_bytes = np.frombuffer(b"".join(parts), np.uint8)
        decimals = [b"%d," % k for k in range(size)]
        self.decimal_size = np.array([len(x) for x in decimals], np.int64)
        width = int(self.decimal_size.max(initial=1))
        self.decimals = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in decimals), np.uint8).reshape(-1, width)

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of those."""
        parts = list(word)
        if len(parts) > PLAIN:
            return self._merged_long(parts)
        get, none = self.rank.get, 1 << 60
        ranks = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [best]
            del ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] << 32 | best, none)
            if k < len(ranks):
                ranks[k] = get(best << 32 | parts[k + 1], none)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        get, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := get(parts[k] << 32 | parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if parts[k] < 0 or j >= n or get(parts[k] << 32 | parts[j]) != rank:
                continue  # one of the two has been merged since
            parts[k], parts[j] = rank, -1
            after[k] = end = after[j]
            if end < n:
                before[end] = k
                if (r := get(rank << 32 | parts[end])) is not None:
                    heapq.heappush(heap, (r, k))
            if (b := before[k]) >= 0 and (r := get(parts[b] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, b))
        return [p for p in parts if p >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, made, longest = [], 0, len(word), self.made, self.longest
        while at < n:
            end = min(n, at + longest.get(word[at : at + 4], 3))
            while (found := made.get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps each pair of tokens apart as it is."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), len(self.left), np.int64)  # merges from here on come after those that made the two
        while len(live):
            key = a << 32 | b
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            early = (self.keys[k] == key) & (self.products[k] < limit)
            ok[live[early]] = False
            go = ~early & ((a >= 256) | (b >= 256))
            live, a, b = live[go], a[go], b[go]
            undo = a > b
            limit = np.where(undo, a, b + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok

    def reachable(self, tokens: np.ndarray) -> np.ndarray:
        for t in np.unique(tokens[self.whole[tokens] == 0]).tolist():
            self.whole[t] = 1 if self.merged(self.strings[t]) == [t] else 2
        return self.whole[tokens] == 1

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        guess = [self.proposed(w) for w in words]
        counts = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        wrong = np.zeros(len(words), bool)
        wrong[owner[~self.reachable(flat)]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        wrong[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        if wrong.any():
            for k in np.flatnonzero(wrong).tolist():
                guess[k] = self.merged(words[k])
            counts = np.fromiter(map(len, guess), np.int64, len(guess))
            flat = np.fromiter((t for g in guess for t in g), np.int64, int(counts.sum()))
        return self.ids[flat], counts

    def odd_ids(self, piece: bytes) -> list[int]:
        letters = {c: b for b, c in self.letters.items()}
        words = [bytes(letters[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece.decode())]
        return self.word_ids(words)[0].tolist()

    def decimal_texts(self, ids: np.ndarray, at: np.ndarray) -> list[memoryview]:
        """Each text's ids as decimals joined by commas."""
        signs = self.decimals.take(ids, axis=0).ravel()
        view = memoryview(signs[signs != 0])
        ends = np.concatenate([[0], np.cumsum(self.decimal_size.take(ids))])[at].tolist()
        return [view[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The text that each text's ids decode to; invalid UTF-8 becomes U+FFFD, as in the library."""
        size = self.part_size.take(ids)
        raw = spread(self.part_bytes, self.part_at.take(ids), size).tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[at].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


def _over(docs: DataFrame, tokenizer: str | None, ddl: str, left, right) -> DataFrame:
    """(doc_id, n_tokens, left of the decimals, right of the decoded text)."""
    tokenizer = tokenizer or default_tokenizer()
    names = [x.split(" ")[0] for x in ddl.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer, SpeculativeBpe)
        for batch in tidied(batches):
            for a, b in text_steps(batch.column("text"), STEP):
                ids, at = codec.encode(batch.column("text")[a:b])
                rows = (batch.column("doc_id")[a:b], np.diff(at), list(map(left, codec.decimal_texts(ids, at))), list(map(right, codec.decoded(ids, at))))
                yield table(dict(zip(names, rows, strict=True)), schema)

    return id_text(docs).mapInArrow(run, ddl)


def encode_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids as decimals joined by commas, the text that they decode to) for each row of docs (doc_id, text)."""
    return _over(docs, tokenizer, "doc_id long, n_tokens long, ids string, decoded string", lambda ids: bytes(ids).decode(), str)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _over(documents(spark, sf_dir), None, ddl, lambda ids: hashlib.sha256(ids).hexdigest(), lambda text: hashlib.sha256(text.encode()).hexdigest())


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
