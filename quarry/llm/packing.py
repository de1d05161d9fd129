"""Packing by non-negative least squares.

A document is cut into full windows of ``WINDOW`` ids and a remainder; a full
window is a sequence of its own.  For the remainders:

1. their lengths are counted (at most WINDOW - 1 counts, whatever the input);
2. all combinations of up to ``DEPTH`` lengths that fill a window exactly are
   enumerated, and non-negative least squares finds how often to repeat each so
   that together they use up the counts;
3. the repeats are rounded, without ever using a length more often than it occurs;
4. what is left is packed greedily, longest first: pieces follow one another
   and are cut at window ends.  The last window's ids go to sequences of
   powers of two, so that no sequence needs padding.

The plan (steps 2 to 4) is small and made on the driver from the counts; every
remainder finds its place by its rank among those of its length.  Ranks are
made of buckets: a rank within the bucket and the counts of the buckets before.

Defined cases: null texts count as empty and have the end id alone; an empty
table gives no rows; repeated rows are packed each; rows without an id and other
columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, partitions, release, stage
from .encode import encoder

WINDOW = 1024
DEPTH = 3
ROUNDS = 400
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def combinations(lengths: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to ``depth`` of the given lengths (ascending, 0 for none) that sum to the window."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    rows = [(0,) * (depth - 2) + (int(a), window - int(a)) for a in lengths if 2 * a <= window and have[window - a]]
    if depth >= 3:
        for a in lengths[lengths * 3 <= window]:
            b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
            b = b[have[window - a - b]]
            rows += [(0,) * (depth - 3) + (int(a), int(x), int(window - a - x)) for x in b]
    return np.array(rows, dtype=np.int64).reshape(-1, depth)


def least_squares(combos: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeats x >= 0 that minimise |A x - counts|; column j of A counts the lengths of combination j.

    Projected gradient steps with momentum; A is never built, as a column has few entries.
    """
    if not len(combos):
        return np.zeros(0)
    used = combos > 0
    owner = np.broadcast_to(np.arange(len(combos))[:, None], combos.shape)[used]
    length = combos[used]
    apply = lambda x: np.bincount(length, weights=x[owner], minlength=len(counts))
    back = lambda r: np.bincount(owner, weights=r[length], minlength=len(combos))
    step = 1.0 / max(1.0, back(apply(np.ones(len(combos)))).max())  # bounds the largest eigenvalue
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, z - step * back(apply(z) - counts))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


@dataclass
class Plan:
    """Places of the remainders.  Slots of a length l are rows slot_from[l]:slot_from[l + 1] in order of their first rank."""
    slot_from: np.ndarray
    low: np.ndarray       # first rank of a slot
    sequence: np.ndarray  # of its first rank; later ranks follow
    offset: np.ndarray
    used: np.ndarray      # ranks of each length that slots take
    stream: np.ndarray    # where the others of each length begin in the greedy stream
    greedy: int           # first sequence of the greedy stream
    ends: np.ndarray      # ends of the stream's last sequences, after the full ones
    full: int             # ids in its full sequences


def make_plan(counts: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> Plan:
    """``counts[l]``: remainders of length l (0 < l < window)."""
    counts = counts.astype(np.int64)
    combos = combinations(np.flatnonzero(counts), window, depth)
    repeats = least_squares(combos, counts.astype(float))
    left, slots, n = counts.copy(), [], 0
    for j in np.argsort(-repeats, kind="stable"):
        want = int(np.floor(repeats[j] + 0.5))
        if want < 1:
            break
        parts = [int(x) for x in combos[j] if x]
        want = min([want, *(int(left[x]) // parts.count(x) for x in set(parts))])
        if want < 1:
            continue
        offset = 0
        for x in parts:
            slots.append((x, int(counts[x] - left[x]), n, offset))
            left[x] -= want
            offset += x
        n += want
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, 4)
    lengths = np.arange(window)
    tokens = left * lengths
    stream = tokens[::-1].cumsum()[::-1] - tokens  # longest first
    total = int(tokens.sum())
    full = total // window * window
    ends, at = [], full
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        ends.append(at)
    return Plan(np.searchsorted(table[:, 0], np.arange(window + 1)), table[:, 1], table[:, 2], table[:, 3], counts - left, stream, n, np.array(ends, dtype=np.int64), full)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray, window: int = WINDOW) -> pd.DataFrame:
    """The pieces that remainders become: row (index of the remainder), skip, length, sequence_id, offset."""
    slotted = np.flatnonzero(rank < plan.used[length])
    # the last slot of the length that begins at or before the rank, by one search over (length, low)
    big = np.int64(1) << 40
    key = np.repeat(np.arange(len(plan.slot_from) - 1), np.diff(plan.slot_from)) * big + plan.low
    s = np.searchsorted(key, length[slotted] * big + rank[slotted], side="right") - 1
    out = [pd.DataFrame({"row": slotted, "skip": 0, "length": length[slotted], "sequence_id": plan.sequence[s] + rank[slotted] - plan.low[s], "offset": plan.offset[s]})]
    rest = np.flatnonzero(rank >= plan.used[length])
    begin = plan.stream[length[rest]] + (rank[rest] - plan.used[length[rest]]) * length[rest]
    rows, skip, todo = rest, np.zeros(len(rest), np.int64), length[rest]
    while len(rows):  # each round places what fits before the next window's end
        at = begin + skip
        tail = np.searchsorted(plan.ends, at, side="right")
        ends = np.append(plan.ends, 0)
        in_full = at < plan.full
        end = np.where(in_full, (at // window + 1) * window, ends[tail])
        first = np.where(in_full, at // window * window, np.append(plan.full, plan.ends)[tail])
        seq = plan.greedy + np.where(in_full, at // window, plan.full // window + tail)
        fit = np.minimum(todo, end - at)
        out.append(pd.DataFrame({"row": rows, "skip": skip, "length": fit, "sequence_id": seq, "offset": at - first}))
        more = todo > fit
        rows, begin, skip, todo = rows[more], begin[more], (skip + fit)[more], (todo - fit)[more]
    return pd.concat(out, ignore_index=True)


def cut_documents(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Full windows and remainders of every document, with their ids; a map without a shuffle."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a:a + 1000]
                rows = []
                for doc_id, ids in zip(part["doc_id"].tolist(), enc.batch(part["text"].tolist())):
                    ids = np.append(ids, enc.dtype.type(end_id)).astype("<u4")
                    for s in range(0, len(ids), window):
                        piece = ids[s:s + window]
                        raw = piece.tobytes()
                        rows.append((doc_id, s, len(piece), zlib.crc32(raw), len(ids), piece.astype(enc.dtype).tobytes()))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        release()
    return documents(docs).mapInPandas(cut, PIECE + ", ids binary")


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    width = encoder(path).dtype
    pieces = stage(cut_documents(docs, path, end_id, window), "pieces")
    buckets = max(32, partitions(spark))
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets))
    rest = pieces.where(F.col("length") < window).withColumn("bucket", bucket)
    by_bucket = stage(rest.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bucket.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "bucket", "base")
    counts = np.zeros(window, dtype=np.int64)
    for length, n in by_bucket.groupBy("length").agg(F.sum("n")).collect():  # at most window - 1 rows
        counts[length] = n
    plan = make_plan(counts, window, depth)
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (rest.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket")
              .withColumn("r", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("r")).cast("long").alias("rank")))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = place(plan, pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64), window)
            row = pdf.iloc[got["row"].to_numpy()].reset_index(drop=True)
            yield pd.DataFrame({"doc_id": row["doc_id"], "start": row["start"], "of": row["length"], "ids_crc32": row["ids_crc32"], "doc_tokens": row["doc_tokens"],
                                "skip": got["skip"].astype(np.int64), "length": got["length"].astype(np.int64), "sequence_id": got["sequence_id"].astype(np.int64), "offset": got["offset"].astype(np.int64)})

    placed = stage(ranked.mapInPandas(put, "doc_id long, start long, of long, ids_crc32 long, doc_tokens long, skip long, length long, sequence_id long, offset long"), "placed")
    n_packed = plan.greedy + plan.full // window + len(plan.ends)

    # checksums of the pieces that the greedy step cut: from their ids
    key = ["doc_id", "start", "of", "ids_crc32", "doc_tokens"]
    cut = placed.where("length < of")
    ids = (pieces.withColumnRenamed("length", "of").join(cut.select(key).distinct(), key, "left_semi").dropDuplicates(key))

    def checksum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["ids_crc32"] = [zlib.crc32(np.frombuffer(x, width)[s:s + n].astype("<u4").tobytes()) for x, s, n in zip(pdf["ids"], pdf["skip"], pdf["length"])]
            pdf["start"] += pdf["skip"]
            yield pdf[OUT]

    OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    recut = cut.join(ids, key).mapInPandas(checksum, PIECE + ", sequence_id long, offset long")
    whole = placed.where("length = of").select(OUT)
    # full windows: numbered after the packed ones, bucket by bucket
    full = pieces.where(F.col("length") == window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").withColumn("bucket", bucket)
    full = full.withColumn("bucket", F.col("bucket") * 32 + F.pmod(F.xxhash64("start", "doc_id"), F.lit(32)))
    n_full = full.groupBy("bucket").agg(F.count("*").alias("n"))
    start_at = n_full.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "base")
    numbered = (full.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1).join(start_at, "bucket")
                .withColumn("sequence_id", (F.col("base") + F.col("r") + n_packed).cast("long")).withColumn("offset", F.lit(0).cast("long")).select(OUT))
    return whole.unionByName(recut).unionByName(numbered)
