"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

Two documents link when 100 * |intersection| >= 75 * |union| of their sets of
5-word shingles.  Sets that are so similar share a shingle within their
prefixes, the first n - ceil(0.75 n) + 1 shingles in any one order of all
shingles.  The order here goes by how many documents hold a shingle, rare ones
first (in classes of about equal counts), then by hash.  Unshared shingles
can't meet anything, so a document that is mostly its own needs no posting at
all; where every document has copies, what the copies share comes before what
they have in common with others, and passages that many share come last.

1. ``shingle``: sets of 64-bit hashes, in chunks of documents.  Only hashes of
   the lower half, which prefixes are taken from, are kept.
2. ``mark_shared``: chunks ask, range by range of the hashes, how many
   documents hold theirs; the answer is a byte each.
3. ``prefixes``; documents with the same prefix and size become one group.
4. Groups that share a prefix shingle are filtered by size and by what can
   still overlap behind it, and joined into clusters.  A shingle held by more
   than ``SHORT_LIST`` groups links them all to the smallest one instead, so
   no list gives more links than it has members.  Postings meet once, range by
   range of the hashes, packed; a list that is long within a task goes on as one.
5. Clusters are expanded to their different sets, and these are verified.  Texts
   travel, as sets are larger, and each task makes its sets again.  A
   large cluster is dealt into blocks: all meet one block first; only sets that
   are then outside the largest component meet all blocks.
6. Links of verified pairs make the components.

``linked_documents`` also counts every document's links.  A forest has too few
for that, so there all pairs of blocks of a large cluster meet, each pair as a
group of its own, and the components come from the same pairs.

Each step's table is deleted when the next one is written.

Nothing is capped: long lists, large clusters and copies of any number take
the same steps.  Sets are compared by 64-bit hashes of their shingles.

Defined cases: null and empty texts have an empty set and link with nothing;
fewer than five words are one shingle; rows that share a doc_id are joined each;
an empty table gives no rows; rows without an id and other
columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, release, stage
from .components import components
from .words import LOWER, U, batches, hash_spans, join, mix, white_words

WORDS = 5
PERCENT = 75
CHUNK_TOKENS = 400_000
RANGE_TOKENS = 500_000
POST_TOKENS = 400_000
MATCH_PAIRS = 400_000
SHORT_LIST = 64
CLUSTER_SETS, CLUSTER_TOKENS = 1200, 2_000_000
BLOCK_SETS, BLOCK_TOKENS = 600, 1_000_000
BROADCAST_ROWS = 500_000
HALF = U(1 << 47)  # kept hashes have 48 bits
UPPER = 255  # the class of hashes beyond HALF
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def need(n: np.ndarray) -> np.ndarray:
    """The least intersection with any set that links: ceil(0.75 n)."""
    return -(-PERCENT * n // 100)


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in batches(texts):
        buf, begins = join(texts[a:b])
        buf = LOWER[buf]
        starts, ends, per_text = white_words(buf, begins)
        word = hash_spans(buf, starts, ends)
        first = np.cumsum(per_text) - per_text
        place = np.arange(len(word)) - np.repeat(first, per_text)
        left = np.repeat(per_text, per_text) - place
        # full shingles, and the whole of a short text
        at = np.flatnonzero((left >= WORDS) | ((place == 0) & (left < WORDS)))
        owner = np.repeat(np.arange(b - a), per_text)[at]
        length = np.minimum(left[at], WORDS)
        with np.errstate(over="ignore"):
            value = length.astype(U)
            for k in range(WORDS):
                inside = k < length
                value = value + np.where(inside, word[np.minimum(at + k, len(word) - 1)], U(0)) * U(FACTORS[k]) if len(at) else value
            value = mix(value)
        order = np.argsort(value)
        order = order[np.argsort(owner[order].astype(np.uint16) if b - a <= 1 << 16 else owner[order], kind="stable")]
        value, owner = value[order], owner[order]
        fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])) if len(value) else np.zeros(0, bool)
        value, owner = value[fresh], owner[fresh]
        out += np.split(value, np.searchsorted(owner, np.arange(1, b - a)))
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set."""
    with np.errstate(over="ignore"):
        d0 = np.array([mix(s).sum(dtype=U) + U(len(s)) for s in sets], dtype=U)
        d1 = np.array([mix(s ^ U(FACTORS[4])).sum(dtype=U) for s in sets], dtype=U)
    return d0.view(np.int64), d1.view(np.int64)


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


CHUNK = "chunk long, doc_ids binary, sizes binary, kept binary, d0 binary, d1 binary, tokens binary, n_tokens long"


def shingle(docs: DataFrame) -> DataFrame:
    """Chunks of documents: ids, set sizes, digests, and the hashes that prefixes may be taken from."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0

        def flush() -> pd.DataFrame:
            ids, sets, low = zip(*held)
            d0, d1 = digests(list(sets))
            return pd.DataFrame([(uuid.uuid4().int >> 65, np.array(ids, np.int64).tobytes(), np.array([len(s) for s in sets], np.int32).tobytes(),
                                  np.array([len(x) for x in low], np.int32).tobytes(), d0.tobytes(), d1.tobytes(), pack48(np.concatenate(low)), sum(map(len, low)))],
                                columns=["chunk", "doc_ids", "sizes", "kept", "d0", "d1", "tokens", "n_tokens"])

        for pdf in parts:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a:a + 500]
                for doc_id, s in zip(part["doc_id"].tolist(), sets_of([t.encode() for t in part["text"]])):
                    n = len(s)
                    low = s[:np.searchsorted(s, U(1 << 63))]
                    if len(low) < n - int(need(np.int64(n))) + 1:
                        low = s  # a small set may need all of them
                    held.append((doc_id, s, low >> U(16)))
                    total += len(low)
                    if total >= CHUNK_TOKENS or len(held) >= 20_000:
                        yield flush()
                        held, total = [], 0
        if held:
            yield flush()
        held.clear()
        release()
    return documents(docs).mapInPandas(run, CHUNK)


def _range_bits(total: int) -> int:
    """Ranges, as a power of two, for so many hashes."""
    return min(15, max(6, int(total // RANGE_TOKENS).bit_length()))


def _cells(tokens: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and 32-bit place of hashes."""
    top = tokens >> U(shift)
    low = ((tokens & U((1 << shift) - 1)) >> U(shift - 32)).astype(np.uint32)
    return top, low


def _classes(count: np.ndarray) -> np.ndarray:
    """Classes 0 (for 1) to 254 of counts, which grow with them: one a count up to 8, then four to a doubling."""
    return np.where(count <= 8, count - 1, np.minimum(8 + np.floor(4 * np.log2(np.maximum(count, 8) / 8)), UPPER - 1)).astype(np.uint8)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as hold them all."""
    top = int(x.max(initial=0))
    return x.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // count}").astype(np.int64)


def mark_shared(chunks: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, range, classes): for the sorted distinct lower-half hashes of a chunk in a range, the class of the number of
    documents that hold them."""
    total = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    shift = 47 - _range_bits(total)  # of lower-half hashes

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for chunk, raw in zip(pdf["chunk"], pdf["tokens"]):
                t, held = np.unique(unpack48(raw), return_counts=True)
                t, held = t[t < HALF], held[t < HALF]
                top, low = _cells(t, shift)
                cut = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(top) else np.zeros(0, np.int64)
                yield pd.DataFrame({"range": top[cut].astype(np.int64), "chunk": chunk, "cells": [x.tobytes() for x in np.split(low, cut[1:])] if len(top) else [],
                                    "held": [_narrow(x) for x in np.split(held, cut[1:])] if len(top) else []})
        release()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = [np.frombuffer(x, np.uint32) for x in pdf["cells"]]
        held = np.concatenate([_wide(x, len(c)) for x, c in zip(pdf["held"], cells)])
        value, back = np.unique(np.concatenate(cells), return_inverse=True)
        count = np.bincount(back, weights=held, minlength=len(value)).astype(np.int64)
        classes = np.split(_classes(count)[back], np.cumsum([len(x) for x in cells])[:-1])
        return pd.DataFrame({"chunk": pdf["chunk"], "range": pdf["range"], "classes": [x.tobytes() for x in classes]})

    asked = chunks.select("chunk", "tokens").mapInPandas(ask, "range long, chunk long, cells binary, held binary")
    return asked.groupBy("range").applyInPandas(answer, "chunk long, range long, classes binary"), shift


PREFIXED = "doc_id long, n long, d0 long, gid long, prefix binary"


def prefixes(chunks: DataFrame, answers: DataFrame, shift: int) -> DataFrame:
    """Each document's set size and digest and the shared part of its prefix (null: it can't link with anything)."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for row in left.itertuples(index=False):
            ids, n, kept = np.frombuffer(row.doc_ids, np.int64), np.frombuffer(row.sizes, np.int32).astype(np.int64), np.frombuffer(row.kept, np.int32)
            tokens = unpack48(row.tokens)
            distinct, back = np.unique(tokens, return_inverse=True)
            top, _ = _cells(distinct[distinct < HALF], shift)
            edges = np.searchsorted(top, np.arange((1 << (47 - shift)) + 1, dtype=np.uint64))
            late = np.full(len(distinct), UPPER, np.uint8)  # upper hashes weren't asked about, and come last
            for r, raw in zip(right["range"].tolist(), right["classes"]):
                late[int(edges[r]):int(edges[r + 1])] = np.frombuffer(raw, np.uint8)
            late = late[back]
            shared = late > 0
            ends = np.cumsum(kept)
            owner = np.repeat(np.arange(len(ids)), kept)
            lonely = np.bincount(owner[~shared], minlength=len(ids))
            room = np.where(n > 0, n - need(n) + 1 - lonely, 0)  # of the prefix, behind the unshared
            out = []
            for a, b, k in zip((ends - kept).tolist(), ends.tolist(), room.tolist()):
                mine = shared[a:b]
                order = np.argsort(late[a:b][mine], kind="stable") if k > 0 else None
                out.append(pack48(tokens[a:b][mine][order][:k]) if k > 0 else None)
            frames.append(pd.DataFrame({"doc_id": ids, "n": n, "d0": np.frombuffer(row.d0, np.int64), "prefix": out}))
        release()
        out = pd.concat(frames, ignore_index=True)
        out["prefix"] = [p if p else None for p in out["prefix"]]
        # not by way of floats, which would round the names wherever one is null
        out["gid"] = pd.array([_group(p, n) if p else None for p, n in zip(out["prefix"], out["n"])], dtype="Int64")
        return out[["doc_id", "n", "d0", "gid", "prefix"]]

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, PREFIXED)


def _group(prefix: bytes, n: int) -> int:
    """A group's name: its prefix and size."""
    raw = unpack48(prefix)
    with np.errstate(over="ignore"):
        x = mix(raw).sum(dtype=U) + mix(np.array([n], U))[0] * U(FACTORS[0])
    return int(mix(np.array([x], U)).view(np.int64)[0])


def union_find(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that the pairs reach, for each of n."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all() and (label[i] == label[j]).all():
            break
    return label


POSTED = "range long, places binary, gids binary, n binary, pos binary, held binary, a binary, b binary"


def candidate_links(groups: DataFrame) -> DataFrame:
    """(a, b): links between groups that share a prefix shingle and pass the filters, at most one a member of a list."""
    total = groups.agg(F.sum(F.length("prefix"))).first()[0] or 0
    shift, short = 48 - _range_bits(total // 6), SHORT_LIST

    def flush(tokens: list, gids: list, sizes: list, places: list) -> pd.DataFrame:
        token, gid, n, pos = (np.concatenate(x) for x in (tokens, gids, sizes, places))
        order = np.lexsort((gid, token))
        token, gid, n, pos = token[order], gid[order], n[order], pos[order]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        held = np.diff(np.append(starts, len(token)))
        first, count = np.repeat(starts, held), np.repeat(held, held)
        keep = (count <= short) | (first == np.arange(len(token)))  # of a long list its smallest group, which the others link to
        a, b = gid[~keep], gid[first[~keep]]
        top, place = _cells(token[keep], shift)
        gid, n, pos, held = gid[keep], n[keep], pos[keep], np.where(count > short, count, 1)[keep]
        cut = np.append(np.flatnonzero(np.append(True, top[1:] != top[:-1])), len(top))
        rows = [(int(top[x]), place[x:y].tobytes(), gid[x:y].tobytes(), _narrow(n[x:y]), _narrow(pos[x:y]), _narrow(held[x:y]), None, None) for x, y in zip(cut, cut[1:])]
        rows[0] = (*rows[0][:-2], a.tobytes(), b.tobytes())
        return pd.DataFrame(rows, columns=[x.split()[0] for x in POSTED.split(", ")])

    def post(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = ([], [], [], []), 0
        for pdf in parts:
            lists = [unpack48(p) for p in pdf["prefix"]]
            k = np.array([len(x) for x in lists], np.int64)
            n = pdf["n"].to_numpy(np.int64)
            begin = n - need(n) + 1 - k  # unshared shingles stand before
            if not len(k):
                continue
            within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            for x, y in zip(held, (np.concatenate(lists), np.repeat(pdf["gid"].to_numpy(np.int64), k), np.repeat(n, k), np.repeat(begin, k) + within)):
                x.append(y)
            total += int(k.sum())
            if total >= POST_TOKENS:
                yield flush(*held)
                held, total = ([], [], [], []), 0
        if total:
            yield flush(*held)
        held = None
        release()

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        place = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["places"]])
        gid = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["gids"]])
        n, pos, held = (np.concatenate([_wide(x, len(p) // 4) for x, p in zip(pdf[c], pdf["places"])]) for c in ("n", "pos", "held"))
        order = np.lexsort((gid, place))
        place, gid, n, pos, held = place[order], gid[order], n[order], pos[order], held[order]
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        size = np.diff(np.append(starts, len(place)))
        long = np.repeat(np.add.reduceat(held, starts) > short, size)
        links = [(gid[long], gid[np.repeat(starts, size)[long]])]
        links += [tuple(np.frombuffer(x, np.int64) for x in both) for both in zip(pdf["a"], pdf["b"]) if both[0]]
        some = ~long & np.repeat(size > 1, size)
        links += _match(place[some], gid[some], n[some], pos[some])
        a, b = (np.concatenate(x) for x in zip(*links))
        release()
        return pd.DataFrame({"a": a, "b": b})[a != b].drop_duplicates()

    return groups.select("gid", "n", "prefix").mapInPandas(post, POSTED).groupBy("range").applyInPandas(match, LINK)


def _match(place: np.ndarray, gid: np.ndarray, n: np.ndarray, pos: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs within each list (sorted by place) that pass the filters, as one link from each member to the smallest it reaches;
    lists of some ``MATCH_PAIRS`` pairs at a time."""
    if not len(place):
        return []
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    sizes = np.diff(np.append(starts, len(place)))
    turn = np.cumsum(sizes * (sizes - 1) // 2) // MATCH_PAIRS
    out = []
    for some in np.split(np.arange(len(starts)), np.flatnonzero(turn[1:] != turn[:-1]) + 1):
        i, j = [], []
        base = starts[some[0]]
        for k in np.unique(sizes[some]).tolist():
            at = starts[some][sizes[some] == k] - base
            x, y = np.triu_indices(k, 1)
            i.append((at[:, None] + x).ravel())
            j.append((at[:, None] + y).ravel())
        i, j = np.concatenate(i), np.concatenate(j)
        end = starts[some[-1]] + sizes[some[-1]]
        m, p, g = n[base:end], pos[base:end], gid[base:end]
        # intersection * (100 + PERCENT) >= PERCENT * (sum of sizes)
        most = np.minimum(m[i] - p[i], m[j] - p[j])
        keep = (np.minimum(m[i], m[j]) * 100 >= PERCENT * np.maximum(m[i], m[j])) & (most * (100 + PERCENT) >= PERCENT * (m[i] + m[j]))
        label = union_find(len(g), i[keep], j[keep])
        linked = np.flatnonzero(label != np.arange(len(g)))
        out.append((g[linked], g[label[linked]]))
    return out


LINK = "a long, b long"


def linked_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the sets that link, from one matrix of intersections."""
    k = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(k), n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    sizes = np.diff(np.append(starts, len(tokens)))
    common = np.zeros((k, k), np.float32)
    for d in np.unique(sizes[(sizes > 1) & (sizes <= 12)]).tolist():  # rare ones pair by pair
        who = owner[starts[sizes == d][:, None] + np.arange(d)]
        for x in range(d):
            for y in range(x + 1, d):
                flat = np.bincount(who[:, x] * k + who[:, y]) if k * k < 1 << 16 else None
                if flat is None:
                    np.add.at(common, (who[:, x], who[:, y]), 1)
                else:
                    common.reshape(-1)[:len(flat)] += flat
    often = np.flatnonzero(sizes > 12)
    for a in range(0, len(often), 2048):  # frequent ones as products of 0/1 matrices
        part = often[a:a + 2048]
        m = np.zeros((k, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), sizes[part])
        m[owner[np.repeat(starts[part] - np.append(0, np.cumsum(sizes[part])[:-1]), sizes[part]) + np.arange(sizes[part].sum())], column] = 1
        common += np.triu(m @ m.T, 1)
    i, j = np.nonzero(np.triu(common, 1) > 0)
    both = common[i, j].astype(np.int64)
    keep = 100 * both >= PERCENT * (n[i] + n[j] - both)
    return i[keep], j[keep]


def different_sets(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The rows (node, text) whose text has the set that the node names, one a node (and cluster, if there), and their sets."""
    keys = [c for c in ("cluster", "node") if c in pdf]
    pdf = pdf.drop_duplicates([*keys, "text"])
    sets = sets_of([t.encode() for t in pdf["text"]])
    same = np.flatnonzero(digests(sets)[0] == pdf["node"].to_numpy(np.int64))  # others are another text under the same id
    same = same[~pdf[keys].iloc[same].duplicated().to_numpy()]
    return pdf.iloc[same], [sets[i] for i in same.tolist()]


def forest(node: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of the sets, as one from each to the smallest that it reaches."""
    if len(sets) < 2:
        return node[:0], node[:0]
    label = union_find(len(node), *linked_pairs(sets))
    linked = np.flatnonzero(label != np.arange(len(node)))
    return node[linked], node[label[linked]]


def verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of the sets of a pair of blocks, as a forest."""
    pdf, sets = different_sets(pdf)
    a, b = forest(pdf["node"].to_numpy(np.int64), sets)
    if len(pdf) >= BLOCK_SETS:
        release()
    return pd.DataFrame({"a": a, "b": b})


def verify_clusters(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the sets of each cluster, as a forest; rows (cluster, node, text) come sorted by cluster."""
    cluster, held = None, {}
    for pdf in parts:
        for x in range(0, len(pdf), 500):
            part, sets = different_sets(pdf.iloc[x:x + 500])
            links = []
            for c, node, s in zip(part["cluster"].tolist(), part["node"].tolist(), sets):
                if c != cluster:
                    links.append(forest(np.array(list(held), np.int64), list(held.values())))
                    cluster, held = c, {}
                held.setdefault(node, s)
            if links:
                a, b = (np.concatenate(v) for v in zip(*links))
                yield pd.DataFrame({"a": a, "b": b})
    a, b = forest(np.array(list(held), np.int64), list(held.values()))
    yield pd.DataFrame({"a": a, "b": b})
    held.clear()
    release()


def cluster_blocks(nodes: DataFrame) -> DataFrame:
    """(cluster, blocks) of each cluster of several sets; only a large one has more than one block."""
    size = nodes.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("tokens")).where("k > 1")
    return size.select("cluster", F.when((F.col("k") <= CLUSTER_SETS) & (F.col("tokens") <= CLUSTER_TOKENS), F.lit(1)).otherwise(
        F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS))).cast("long").alias("blocks"))


def verified_links(texts: DataFrame) -> DataFrame:
    """Links between the sets (cluster, blocks, block, node, text) of each cluster, as a forest of them."""
    links = (texts.where("blocks = 1").select("cluster", "node", "text")
             .repartition("cluster").sortWithinPartitions("cluster").mapInPandas(verify_clusters, LINK))
    dealt = texts.where("blocks > 1")
    if dealt.limit(1).count() == 0:
        return links
    # every block meets the first one
    meets = dealt.withColumn("meet", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))))
    first = stage(meets.select("cluster", "meet", "node", "text").groupBy("cluster", "meet").applyInPandas(lambda pdf: verify(pdf), LINK), "first-links")
    label = components(first).withColumnsRenamed({"node": "n0", "label": "l0"})
    named = dealt.select("cluster", "node", "blocks").join(label, F.col("node") == F.col("n0"), "left").select("cluster", "node", "blocks", F.coalesce("l0", "node").alias("part"))
    parts = named.groupBy("cluster", "part").agg(F.count("*").alias("k"))
    main = parts.groupBy("cluster").agg(F.max_by("part", F.struct("k", "part")).alias("main"))
    # what stays outside the largest component meets all blocks, some of it at a time
    outside = named.join(main, "cluster").where("part <> main").select("cluster", "node")
    turns = outside.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("turns"))
    outside = stage(outside.join(turns, "cluster").withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns"))), "outside")
    turns = outside.select("cluster", "turns").distinct()
    every = dealt.join(turns, "cluster").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).select("cluster", "node", "text", "block", "turn")
    these = (dealt.select("cluster", "node", "text", "blocks").join(outside.select("cluster", "node", "turn").distinct(), ["cluster", "node"])
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("cluster", "node", "text", "block", "turn"))
    second = every.unionByName(these).groupBy("cluster", "block", "turn").applyInPandas(lambda pdf: verify(pdf), LINK)
    return links.unionByName(first).unionByName(second)


def count_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, low, links) of the sets of one cluster or pair of blocks: the smallest set that each reaches, and how many
    documents hold a set that it links with.  Between two blocks, pairs within either are another group's."""
    pdf, sets = different_sets(pdf)
    node, copies, block = (pdf[c].to_numpy(np.int64) for c in ("node", "copies", "block"))
    if len(pdf) < 2:
        return pd.DataFrame({"node": node[:0], "low": node[:0], "links": node[:0]})
    i, j = linked_pairs(sets)
    if pdf["x"].iloc[0] != pdf["y"].iloc[0]:
        across = block[i] != block[j]
        i, j = i[across], j[across]
    if len(pdf) >= BLOCK_SETS:
        release()
    links = np.zeros(len(node), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    some = np.flatnonzero(links)
    return pd.DataFrame({"node": node[some], "low": node[union_find(len(node), i, j)[some]], "links": links[some]})


def counted_links(texts: DataFrame) -> DataFrame:
    """``count_links`` of every pair of sets (cluster, blocks, block, node, copies, text) of a cluster, each pair in one group."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = (texts.withColumn("other", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
           .select("cluster", "x", "y", "block", "node", "copies", "text"))
    return met.groupBy("cluster", "x", "y").applyInPandas(count_links, "node long, low long, links long")


def wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted sets (node, doc_id, cluster, blocks, block, copies) with the texts under their doc_id."""
    few = wanted.count() <= BROADCAST_ROWS
    return documents(docs).join(F.broadcast(wanted) if few else wanted, "doc_id").select("cluster", "blocks", "block", "node", "copies", "text")


def clustered_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, d0, gid) of every document, the different sets that can link (d0, doc_id, copies, n, cluster), and the texts
    of those of several to a cluster."""
    chunks = stage(shingle(docs), "chunks")
    answers, shift = mark_shared(chunks)
    answers = stage(answers, "answers")
    prefixed = stage(prefixes(chunks, answers, shift), "prefixes")
    discard(chunks, answers)
    groups = stage(prefixed.where("gid IS NOT NULL").groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "groups")
    rows = stage(prefixed.drop("prefix"), "rows")
    discard(prefixed)
    clusters = components(candidate_links(groups), "clusters").selectExpr("node AS gid", "label AS cluster")
    discard(groups)
    # one document stands for all equal sets
    nodes = rows.where("gid IS NOT NULL").groupBy("gid", "d0").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"))
    nodes = stage(nodes.join(clusters, "gid", "left").selectExpr("d0", "doc_id", "copies", "n", "coalesce(cluster, gid) AS cluster"), "nodes")
    wanted = nodes.join(cluster_blocks(nodes), "cluster").selectExpr("d0 AS node", "doc_id", "cluster", "blocks", "pmod(xxhash64(d0), blocks) AS block", "copies")
    wanted = stage(wanted, "wanted")
    texts = stage(wanted_texts(docs, wanted), "texts")
    discard(wanted)
    return rows, nodes, texts


def with_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The sets with the component_id that the links (a, b) give them."""
    label = components(links, "links").selectExpr("node AS d0", "label")
    named = nodes.join(label, "d0", "left").selectExpr("d0", "doc_id", "copies", "coalesce(label, d0) AS label")
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return stage(named.join(lowest, "label").select("d0", "copies", "component_id"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, nodes, texts = clustered_texts(docs)
    named = with_components(nodes, verified_links(texts))
    discard(nodes, texts)
    linked = rows.where("gid IS NOT NULL").select("doc_id", "n", "d0").join(named, "d0").selectExpr("doc_id", "n AS n_shingles", "component_id")
    alone = rows.where("gid IS NULL").selectExpr("doc_id", "n AS n_shingles", "doc_id AS component_id")
    return linked.unionByName(alone)


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (the other rows that it links with) of every document."""
    rows, nodes, texts = clustered_texts(docs)
    counted = stage(counted_links(texts), "counted")
    discard(texts)
    named = with_components(nodes, counted.selectExpr("node AS a", "low AS b"))
    links = counted.groupBy(F.col("node").alias("d0")).agg(F.sum("links").alias("links"))
    named = named.join(links, "d0", "left").selectExpr("d0", "component_id", "coalesce(links, 0) + copies - 1 AS n_links")
    linked = rows.where("gid IS NOT NULL").select("doc_id", "n", "d0").join(named, "d0").selectExpr("doc_id", "n AS n_shingles", "component_id", "n_links")
    alone = rows.where("gid IS NULL").selectExpr("doc_id", "n AS n_shingles", "doc_id AS component_id", "0L AS n_links")
    return linked.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component (the smallest id), with all its columns; rows without an id stay.

    Rows that share one id are one document here: they go if any of them
    belongs to a component with a smaller id, and stay together otherwise.
    """
    found = near_duplicates(docs).where("doc_id <> component_id")
    drop = stage(found.select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    return docs.join(drop, docs["doc_id"].cast("long") == drop["gone"], "left_anti")


SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
r(node, low) AS (SELECT x, x FROM l UNION SELECT l.y, r.low FROM r JOIN l ON l.x = r.node WHERE r.low < l.y),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(m.low, t.doc_id)) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = t.doc_id"""
#: The same components, and each document's links.
LINKS_SQL = SQL[:SQL.rindex("\nSELECT")] + r""",
d AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(m.low, t.doc_id)) AS component_id, coalesce(d.n_links, 0)::BIGINT AS n_links FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = t.doc_id LEFT JOIN d ON d.x = t.doc_id"""
