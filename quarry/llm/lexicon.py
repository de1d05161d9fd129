"""BPE encoding and decoding with a minimal acyclic transducer of the frequent words.

Words (what stands between white space once a text is normalized) are counted
over all documents.  Those above a frequency that the lexicon's size allows are
merged once, and compiled into a transducer: an acyclic automaton whose equal
suffixes are one state and whose edges give out token ids as early as they are
certain.  It is written to the shared folder and memory-mapped by the workers,
which walk all distinct words of a batch through it together, one byte a step.
Words that it doesn't hold are merged exactly, by the file's own merges.  The
lexicon's size changes the work and never the ids.

For files whose pre-tokens never reach over white space and that normalize by
NFC, white space to one space, and lower case (``word_bpe_49k.json``).

Defined cases: a null or empty text has no ids and decodes to an empty text; an
added token inside a text is its own id, as the library's default has it;
texts of any length are encoded whole, ``BATCH_BYTES`` of whole texts at a time;
equal words have equal ids in any order of rows, so ties decide nothing;
repeated rows are encoded each; rows without an id and other columns, whatever
their names, are left out; an empty table gives an empty lexicon and no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import documents, release, shared_path, stage
from .encode import ragged
from .token_files import open_folder
from .token_counts import byte_alphabet
from .words import batches

#: Words that the transducer holds at most, and the bytes of the longest one; so its size is bounded.
LEXICON_WORDS = 100_000
LEXICON_BYTES = 64
#: A task's word counts are handed on when they hold so many words.
COUNTED_WORDS = 300_000
#: Pre-tokens of unseen words that a worker remembers with their ids.
MERGED_WORDS = 200_000
#: Characters that NFC leaves alone and that lower-case one by one; other texts are normalized by the library.
SIMPLE = re.compile(r"[ -~\t\n\v\f\r¡-ɏ]*")
#: Pre-tokens of up to so many bytes are merged together.
SHORT_TOKEN = 200
NO_RANK = np.int64(1) << 40
#: The first byte of a word that is an added token.
ADDED = 0xFF


class WordBpe:
    """Normalizing, exact merges and decoding of one vocabulary file."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pre_token = regex.compile(split["pattern"]["Regex"])
        self.suffix = spec["model"]["end_of_word_suffix"]
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(merges)}
        self.size = max(vocab.values()) + 1
        pair = np.array([a * self.size + b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(pair)
        self.pair, self.pair_rank = pair[order], order
        self.pair_made = np.array([made for _, made in self.rank.values()], dtype=np.int64)[order]
        self.of_byte = byte_alphabet()
        self.byte_of = {c: b for b, c in self.of_byte.items()}
        self.inner = np.array([vocab[self.of_byte[b]] for b in range(256)])
        self.last = np.array([vocab[self.of_byte[b] + self.suffix] for b in range(256)])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.added = {c.encode(): i for c, i in added.items()}
        # every token's bytes with the space that follows it, joined
        content = {i: c for c, i in (vocab | added).items()}
        spelled = [content[i].encode() + b" " if i in content else b"" for i in range(max(content) + 1)]
        self.token_length = np.array([len(t) for t in spelled], dtype=np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def words(self, text: str) -> list[bytes]:
        """The words of a text; an added token is one, marked by a byte that no text holds."""
        if "<|" not in text:
            return self._plain_words(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [b"\xff" + part.encode()] if i % 2 else self._plain_words(part)
        return out

    def _plain_words(self, text: str) -> list[bytes]:
        normal = text.lower() if SIMPLE.fullmatch(text) else self.library.normalizer.normalize_str(text)
        return normal.encode().split()

    def pre_tokens(self, word: str) -> list[bytes]:
        if SIMPLE.fullmatch(word):
            return [t.encode() for t in self.pre_token.findall(word)]
        return [bytes(map(self.byte_of.__getitem__, t)) for t, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]

    def merge(self, tokens: list[bytes]) -> list[list[int]]:
        """The ids of pre-tokens: in each, the lowest-ranked pair of neighbours merges first, from the left.

        All short ones are merged together as one array; a merge only makes
        pairs of higher rank than its own, so every occurrence of a sequence's
        lowest pair may go at once.
        """
        out: list = [None] * len(tokens)
        short = []
        for i, t in enumerate(tokens):
            if len(t) > SHORT_TOKEN:
                out[i] = self._merge_long([*map(self.inner.__getitem__, t[:-1]), self.last[t[-1]]])
            else:
                short.append(i)
        if not short:
            return out
        length = np.array([len(tokens[i]) for i in short], dtype=np.int64)
        raw = np.frombuffer(b"".join([tokens[i] for i in short]), dtype=np.uint8)
        symbol, ends = self.inner[raw], np.cumsum(length) - 1
        symbol[ends] = self.last[raw[ends]]
        sequence = np.repeat(np.arange(len(short)), length)
        place = np.arange(len(symbol))  # live symbols keep their first place
        merged = symbol.copy()
        gone = np.zeros(len(symbol), dtype=bool)
        while len(symbol) > 1:
            pair = np.where(sequence[1:] == sequence[:-1], symbol[:-1] * self.size + symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            rank = np.append(np.where(self.pair[at] == pair, self.pair_rank[at], NO_RANK), NO_RANK)
            first = np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            lowest_here = np.repeat(lowest, np.diff(np.append(first, len(symbol))))
            where = np.flatnonzero((rank < NO_RANK) & (rank == lowest_here))
            if not len(where):
                break
            # of neighbouring places with one pair (aaa), every second merges, from the left
            begins = np.append(True, np.diff(where) != 1)
            along = np.arange(len(where))
            where = where[(along - np.maximum.accumulate(np.where(begins, along, 0))) % 2 == 0]
            symbol[where] = self.pair_made[at[where]]
            merged[place[where]] = symbol[where]
            gone[place[where + 1]] = True
            keep = lowest_here < NO_RANK  # finished sequences leave
            keep[where + 1] = False
            symbol, sequence, place = symbol[keep], sequence[keep], place[keep]
        ids = merged[~gone].tolist()
        n = np.add.reduceat(~gone, np.cumsum(length) - length, dtype=np.int64)
        stops = np.cumsum(n).tolist()
        for i, a, b in zip(short, [0, *stops], stops):
            out[i] = ids[a:b]
        return out

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges with a heap over a linked list, for long tokens."""
        n, rank, alive = len(symbols), self.rank, [True] * len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], i, r[1], a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank.get((symbols[x], symbols[y]))):
                    heapq.heappush(heap, (r[0], x, r[1], symbols[x], symbols[y]))
        return [s for s, a in zip(symbols, alive) if a]

    def word_ids(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words by exact merges, each distinct pre-token once."""
        cut = [self.pre_tokens(w.decode()) for w in words]
        distinct = list(dict.fromkeys(t for tokens in cut for t in tokens))
        of = dict(zip(distinct, self.merge(distinct)))
        return [[i for t in tokens for i in of[t]] for tokens in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the tokens' own spelling, a space between them."""
        return self.token_bytes[ragged(self.token_start[ids], self.token_length[ids])].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> WordBpe:
    return WordBpe(path)


def compile_transducer(entries: Iterable[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of words (distinct, in byte order) and their ids, as flat arrays.

    A state is (final, ids given out at a word's end, edges); an edge is (byte,
    next state, ids given out).  A word's ids move towards the start as far as
    all words beyond agree, which leaves long suffixes without output; states
    that no later word can change are looked up by content and kept once.
    """
    kept: dict[tuple, int] = {}
    states: list[tuple] = []

    def freeze(node: list) -> int:
        content = (node[0], node[1], tuple((b, t, out) for b, t, out in node[2]))
        found = kept.get(content)
        if found is None:
            found = kept[content] = len(states)
            states.append(content)
        return found

    # the path of the last word: nodes [final, ids at the end, edges [byte, state, ids]]; the last edge's state is still open
    path, last = [[False, (), []]], b""
    for word, ids in entries:
        rest = tuple(ids)
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        while len(path) > same + 1:
            state = freeze(path.pop())
            path[-1][2][-1][1] = state
        for depth in range(same):
            edge, node = path[depth][2][-1], path[depth + 1]
            k = next((i for i, (a, b) in enumerate(zip(edge[2], rest)) if a != b), min(len(edge[2]), len(rest)))
            moved, edge[2], rest = edge[2][k:], edge[2][:k], rest[k:]
            if moved:  # what the words before gave out here, and this one doesn't, goes on behind the edge
                if node[0]:
                    node[1] = moved + node[1]
                for e in node[2]:
                    e[2] = moved + e[2]
        for b in word[same:]:
            path[-1][2].append([b, -1, rest])
            path.append([False, (), []])
            rest = ()
        path[-1][0], path[-1][1] = True, rest
        last = word
    while len(path) > 1:
        state = freeze(path.pop())
        path[-1][2][-1][1] = state
    root = freeze(path[0])
    key, target, out_at, out_n, end_at, end_n, final, pool = [], [], [], [], [], [], [], []
    for s, (is_final, end, edges) in enumerate(states):
        final.append(is_final)
        end_at.append(len(pool))
        end_n.append(len(end))
        pool += end
        for b, t, out in edges:
            key.append(s << 8 | b)
            target.append(t)
            out_at.append(len(pool))
            out_n.append(len(out))
            pool += out
    order = np.argsort(np.array(key, dtype=np.int64), kind="stable")

    def edge(x: list) -> np.ndarray:
        return np.array(x, dtype=np.int64)[order]

    return {"root": np.array([root]), "key": edge(key), "target": edge(target), "out_at": edge(out_at), "out_n": edge(out_n), "final": np.array(final, dtype=np.int64),
            "end_at": np.array(end_at, dtype=np.int64), "end_n": np.array(end_n, dtype=np.int64), "pool": np.array(pool, dtype=np.int64)}


def write_transducer(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """One file: a line of names and lengths, then all arrays as 64-bit numbers."""
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    head = json.dumps([(k, len(v)) for k, v in arrays.items()]).encode()
    with system.open_output_stream(f"{root}/lexicon.bin") as f:
        f.write(head + b" " * (-len(head) - 1 & 7) + b"\n")
        for v in arrays.values():
            f.write(v.astype("<i8").tobytes())
    return f"{folder}/lexicon.bin"


class Transducer:
    """A transducer in a file that is memory-mapped; machines with another kind of shared store read it once."""

    def __init__(self, uri: str):
        folder, name = uri.rsplit("/", 1)
        system, root = open_folder(folder)
        if isinstance(system, fs.LocalFileSystem):
            with open(f"{root}/{name}", "rb") as f:
                self.bytes = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with system.open_input_file(f"{root}/{name}") as f:
                self.bytes = f.read()
        head = bytes(self.bytes[:1 << 12]).split(b"\n", 1)[0]
        at = len(head) + 1
        for k, n in json.loads(head):
            setattr(self, k, np.frombuffer(self.bytes, dtype="<i8", count=n, offset=at))
            at += 8 * n

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words at once, one byte a step: which words it holds, their numbers of ids, and their ids joined."""
        n = len(words)
        length = np.array([len(w) for w in words], dtype=np.int64)
        buf = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(length) - length
        state = np.full(n, int(self.root[0]), dtype=np.int64)
        given: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, place of its ids in the pool, how many
        live = np.flatnonzero(length > 0) if len(self.key) else np.zeros(0, np.int64)
        held = np.zeros(n, dtype=bool)
        depth = 0
        while len(live):
            key = state[live] << 8 | buf[start[live] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.target[at]
            some = self.out_n[at] > 0
            given.append((live[some], self.out_at[at[some]], self.out_n[at[some]]))
            depth += 1
            done = length[live] == depth
            ended = live[done]
            ended = ended[self.final[state[ended]] == 1]
            held[ended] = True
            given.append((ended, self.end_at[state[ended]], self.end_n[state[ended]]))
            live = live[~done]
        if not given:
            return held, np.zeros(n, np.int64), np.zeros(0, np.int64)
        word, place, count = (np.concatenate(x) for x in zip(*given))
        good = held[word]
        word, place, count = word[good], place[good], count[good]
        order = np.argsort(word, kind="stable")
        word, place, count = word[order], place[order], count[order]
        each = np.bincount(word, weights=count, minlength=n).astype(np.int64)
        return held, each, self.pool[ragged(place, count)]


@functools.lru_cache(maxsize=2)
def transducer(uri: str) -> Transducer:
    return Transducer(uri)


class LexiconEncoder:
    """``batch(texts)``: each text's ids, by the transducer, and by exact merges where it has no entry."""

    def __init__(self, path: str, uri: str):
        self.bpe, self.lexicon = bpe(path), transducer(uri)
        self.merged: dict[bytes, list[int]] = {}

    def _unseen(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that the lexicon doesn't hold: of their pre-tokens, by the lexicon again, or else merged."""
        cut = [[] if w[0] == ADDED else self.bpe.pre_tokens(w.decode()) for w in words]
        tokens = dict.fromkeys(t for c in cut for t in c)
        if len(self.merged) + len(tokens) > MERGED_WORDS:
            self.merged = {}
        new = [t for t in tokens if t not in self.merged]
        held, n, ids = self.lexicon.walk(new)
        stops = np.cumsum(n).tolist()
        ids = ids.tolist()
        self.merged.update((t, ids[a:b]) for t, a, b, h in zip(new, [0, *stops], stops, held.tolist()) if h)
        rest = [t for t, h in zip(new, held.tolist()) if not h]
        self.merged.update(zip(rest, self.bpe.merge(rest)))
        return [[self.bpe.added[w[1:]]] if w[0] == ADDED else [i for t in c for i in self.merged[t]] for w, c in zip(words, cut)]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        per_text = [self.bpe.words(t) for t in texts]
        sizes = np.array([len(w) for w in per_text], dtype=np.int64)
        flat = [w for words in per_text for w in words]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        place = np.fromiter(map(distinct.__getitem__, flat), dtype=np.int64, count=len(flat))
        words = list(distinct)
        held, n, ids = self.lexicon.walk(words)
        begin = np.cumsum(n) - n
        others = np.flatnonzero(~held)
        found = self._unseen([words[i] for i in others.tolist()])
        n[others] = [len(f) for f in found]
        begin[others] = len(ids) + np.cumsum(n[others]) - n[others]
        ids = np.concatenate([ids, np.array([i for f in found for i in f], dtype=np.int64)])
        out = ids[ragged(begin[place], n[place])]
        run = np.concatenate([[0], np.cumsum(n[place])])
        ends = np.cumsum(sizes)
        return [out[a:b] for a, b in zip(run[ends - sizes], run[ends])]


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word (binary) and n of all documents, but for words longer than the lexicon takes."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, held = bpe(path), Counter()
        for pdf in frames:
            for text in pdf["text"]:
                held.update(b.words(text))
                if len(held) >= COUNTED_WORDS:
                    yield handed(held)
                    held = Counter()
        yield handed(held)
        release()

    def handed(held: Counter) -> pd.DataFrame:
        kept = [(w, n) for w, n in held.items() if len(w) <= LEXICON_BYTES and w[0] != ADDED]
        return pd.DataFrame({"word": [w for w, _ in kept], "n": np.array([n for _, n in kept], dtype=np.int64)})

    return documents(docs).select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of all documents; returns the file's URI in the shared folder.

    The least frequency that keeps the lexicon within ``words`` is found from
    counts of counts in 1/8 octaves, so no task ranks the whole vocabulary.
    """
    spark = docs.sparkSession
    counted = stage(word_counts(docs, path).where("n > 1").withColumn("octave", F.floor(F.log2("n") * 8)), "lexicon-words")
    total, least = 0, None
    for row in counted.groupBy("octave").count().orderBy(F.desc("octave")).collect():
        total += row["count"]
        if total > words:
            break
        least = row["octave"]
    b = bpe(path)
    frequent = [] if least is None else sorted(bytes(r.word) for r in counted.where(F.col("octave") >= least).select("word").collect())
    return write_transducer(shared_path(spark, "lexicon"), compile_transducer(zip(frequent, b.word_ids(frequent))))


def encode_decode(docs: DataFrame, path: str, uri: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every document; the lexicon is built from these documents unless given."""
    uri = uri or build_lexicon(docs, path)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc_ids, ids, decoded in _encoded(frames, path, uri):
            yield pd.DataFrame({"doc_id": doc_ids, "ids": [i.astype(np.int32) for i in ids], "decoded": [d.decode() for d in decoded]})
    return documents(docs).mapInPandas(encode, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, uri: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, without handing the ids on."""
    uri = uri or build_lexicon(docs, path)

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc_ids, ids, decoded in _encoded(frames, path, uri):
            yield pd.DataFrame({"doc_id": doc_ids, "n_tokens": np.array([len(i) for i in ids], dtype=np.int64),
                                "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids],
                                "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded]})
    return documents(docs).mapInPandas(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(frames: Iterator[pd.DataFrame], path: str, uri: str) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[bytes]]]:
    enc = LexiconEncoder(path, uri)
    for pdf in frames:
        texts, doc_ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy()
        for a, b in batches(texts):
            ids = enc.batch(texts[a:b])
            yield doc_ids[a:b], ids, [enc.bpe.decode(i) for i in ids]
    release()
