"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch that aren't known yet form one ragged numpy
array of symbols.  In each round every sequence looks up the ranks of its
adjacent pairs, and all occurrences of its lowest-ranked pair merge at once,
for all sequences simultaneously.  A merge only makes pairs of higher rank than
its own, so this is the sequential order of merges.  What survives is counted.

For byte-level BPE files (.json); a file of another kind is counted by its own
library (tokenizers for .json, sentencepiece for .model).

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings
inside a text are one token each, as the library's default has it; repeated
rows are counted each; rows without an id and other
columns are left out.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import documents
from .encode import is_byte_level
from .words import Known, U, batches, hash_spans, join, mix, token_words

# The pre-token pattern of byte-level BPE.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words of other characters are cut by the library's own pre-tokenizer.
PLAIN = re.compile(r"[ -~\t\n\r¡-ɏ]*")
NONE = np.int64(1) << 40


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes: printable ones for themselves, the others counted from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ArrayMerger:
    """The merges of a byte-level BPE file as one sorted table of pairs."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        of_byte = byte_alphabet()
        self.of_byte = np.array([vocab[of_byte[b]] for b in range(256)], dtype=np.int64)
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """The symbols that survive in each token."""
        length = np.array([len(t) for t in tokens], dtype=np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), length)
        out = length.copy()
        while len(symbol) > 1:
            pair = np.where(seq[1:] == seq[:-1], symbol[:-1] * self.size + symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.append(np.where(self.key[at] == pair, self.rank[at], NONE), NONE)  # of the pair that begins here
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(seq)))
            merge = (rank < NONE) & (rank == np.repeat(lowest, sizes))
            where = np.flatnonzero(merge)
            if not len(where):
                break
            # a run of one pair with equal halves (aaa): every second one merges, from the left
            begins = np.append(True, np.diff(where) != 1)
            place = np.arange(len(where)) - np.maximum.accumulate(np.where(begins, np.arange(len(where)), 0))
            where = where[place % 2 == 0]
            symbol[where] = self.made[at[where]]
            np.subtract.at(out, seq[where], 1)
            keep = np.repeat(lowest < NONE, sizes)  # finished sequences leave
            keep[where + 1] = False
            symbol, seq = symbol[keep], seq[keep]
        return out


class Counter:
    """Counts of whole texts; distinct words and pre-tokens are counted once a worker."""

    def __init__(self, path: str):
        self.library = self.merger = None
        if path.endswith(".model"):
            import sentencepiece
            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not is_byte_level(spec):
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            return
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        self.merger = ArrayMerger(spec)
        self.byte_of = {c: b for b, c in byte_alphabet().items()}
        self.known, self.counts = Known(), np.zeros(0, np.int64)

    def pre_tokens(self, word: str) -> list[bytes]:
        if PLAIN.fullmatch(word):
            return [t.encode() for t in PRE_TOKEN.findall(word)]
        return [bytes(map(self.byte_of.__getitem__, t)) for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]

    def _words(self, words: list[str]) -> np.ndarray:
        """Tokens in each new word."""
        cut = [self.pre_tokens(w) for w in words]
        distinct = {t: i for i, t in enumerate({t for ts in cut for t in ts})}
        each = self.merger.counts(list(distinct)) if distinct else np.zeros(0, np.int64)
        n = np.array([len(ts) for ts in cut])
        run = np.concatenate([[0], np.cumsum(each[np.array([distinct[t] for ts in cut for t in ts], dtype=np.int64)])])
        ends = np.cumsum(n)
        return run[ends] - run[ends - n]

    def _fast(self, texts: list[bytes]) -> np.ndarray:
        buf, begins = join(texts)
        starts, ends, per_text, spaced = token_words(buf, begins)
        with np.errstate(over="ignore"):
            keys = mix(hash_spans(buf, starts, ends) + spaced.astype(U))
        keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if self.known.n > self.known.limit:
            self.known, self.counts = Known(), np.zeros(0, np.int64)
        rows = self.known.find(keys)
        new = rows < 0
        if new.any():
            raw, f = buf.tobytes(), first[new]
            words = [(" " if s else "") + raw[a:b].decode() for a, b, s in zip(starts[f].tolist(), ends[f].tolist(), spaced[f].tolist())]
            self.counts = np.append(self.counts, self._words(words))
            rows[new] = self.known.add(keys[new])
        run = np.concatenate([[0], np.cumsum(self.counts[rows[place]])])
        last = np.cumsum(per_text)
        return run[last] - run[last - per_text]

    def batch(self, texts: list[str]) -> list[int]:
        if self.merger is None:
            if self.library is not None:
                return [len(self.library.encode(t)) for t in texts]
            return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = np.zeros(len(texts), dtype=np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):  # an added token inside a text is one token, and cuts it
            cut = self.special.split(t)
            out[i] = len(cut) - 1
            parts += [p.encode() for p in cut]
            owner += [i] * len(cut)
        owner = np.array(owner, dtype=np.int64)
        for a, b in batches(parts):
            np.add.at(out, owner[a:b], self._fast(parts[a:b]))
        return out.tolist()


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; a map without a shuffle."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a:a + 512]
                texts = part["text"].tolist()
                n = np.array(c.batch(texts), dtype=np.int64)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_bytes": [len(t.encode()) for t in texts],
                                    "n_tokens": n, "over_limit": n > limit})
    return documents(docs).mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
