"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once a worker.

A byte-level BPE never merges across its pre-tokens, and a single space between
two non-spaces always starts a new one.  So the texts of a batch are cut at
those spaces, the distinct new words go to the library together (kept apart by
an added token), and the ids of all words are gathered by numpy.  Other kinds
of tokenizer, and texts that hold an added token themselves, go to the library
whole.
"""

from __future__ import annotations

import functools
import json

import numpy as np
from tokenizers import Tokenizer

from .words import Known, U, batches, hash_spans, join, mix, token_words


def is_byte_level(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and not spec["model"].get("ignore_merges") and bool(spec["added_tokens"])
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every span, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """``batch(texts)``: the library's ids (add_special_tokens=False) of each text, as arrays of ``dtype``."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.fast = is_byte_level(spec)
        if self.fast:
            self.special = [t["content"].encode() for t in spec["added_tokens"]]
            self.gap, self.gap_id = self.special[0], spec["added_tokens"][0]["id"]
            self._reset()

    def _reset(self) -> None:
        self.known = Known()
        self.starts, self.lengths, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words, joined, and how many each has."""
        ids = np.array(self.library.encode_batch_fast([(self.gap.join(words) + self.gap).decode()], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = np.flatnonzero(ids == self.gap_id)
        return ids[ids != self.gap_id].astype(self.dtype), np.diff(np.append(-1, ends)) - 1

    def _fast(self, texts: list[bytes]) -> list[np.ndarray]:
        buf, begins = join(texts)
        starts, ends, per_text, spaced = token_words(buf, begins)
        with np.errstate(over="ignore"):
            keys = mix(hash_spans(buf, starts, ends) + spaced.astype(U))
        keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if self.known.n > self.known.limit:
            self._reset()
        rows = self.known.find(keys)
        new = rows < 0
        if new.any():
            raw = buf.tobytes()
            f = first[new]
            ids, lengths = self._learn([b" " + raw[a:b] if s else raw[a:b] for a, b, s in zip(starts[f].tolist(), ends[f].tolist(), spaced[f].tolist())])
            rows[new] = self.known.add(keys[new])
            self.starts = np.append(self.starts, len(self.store) + np.cumsum(lengths) - lengths)
            self.lengths, self.store = np.append(self.lengths, lengths), np.append(self.store, ids)
        word = rows[place]
        lengths = self.lengths[word]
        ids = self.store[ragged(self.starts[word], lengths)]
        last = np.cumsum(per_text)
        return np.split(ids, np.concatenate([[0], np.cumsum(lengths)])[last][:-1])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if not self.fast:
            return self._whole(texts)
        out: list = [None] * len(texts)
        raw = [t.encode() for t in texts]
        plain = [i for i, t in enumerate(raw) if not any(s in t for s in self.special)]
        for i in set(range(len(texts))).difference(plain):
            out[i] = self._whole([texts[i]])[0]
        for a, b in batches([raw[i] for i in plain]):
            for i, ids in zip(plain[a:b], self._fast([raw[j] for j in plain[a:b]])):
                out[i] = ids
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)
