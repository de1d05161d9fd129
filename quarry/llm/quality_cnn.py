"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector and a mark of whether it repeats what stood a
few bytes before.  Learned filters slide over overlapping chunks that cover the
whole document; each is max-pooled within a chunk.  The largest and the mean
value over the chunks are combined into one probability.

The network is fitted on a bounded sample of labelled documents (``SAMPLE`` of
each class, of a longer one ``SAMPLE_CHARS`` from a place that its hash gives)
and applied by a map without a shuffle.  Chunks of many documents
are worked on together, at most ``STEP_BYTES`` at a time, so memory does not
grow with a document's length.

Defined cases: null texts count as empty; an empty text is one chunk of padding
and gets a score like any other; without labels of both classes every score is
the share of label 1 (0 without labels); repeated rows are scored each; rows without an id and other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .labels import fold, training_rows

SAMPLE = (1500, 1500)
SAMPLE_CHARS = 1 << 16
CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE, CHANNELS, FILTERS = 8, 4, 8, 16
LAGS = range(2, 17)
STEP_BYTES = 1 << 19
EPOCHS = 8
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Net:
    embed: np.ndarray    # 257 x (CHANNELS - 1); 256 is padding
    filters: np.ndarray  # WIDTH * CHANNELS x FILTERS
    bias: np.ndarray
    out: np.ndarray      # 2 * FILTERS
    base: float


def new_net(seed: int = 7) -> Net:
    r = np.random.default_rng(seed)
    embed = r.normal(0, 0.5, (257, CHANNELS - 1)).astype(np.float32)
    embed[256] = 0
    return Net(embed, r.normal(0, 0.15, (WIDTH * CHANNELS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
               r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)


def repeats(raw: np.ndarray) -> np.ndarray:
    """Whether the four bytes from here also stood a few bytes earlier."""
    out = np.zeros(len(raw), np.float32)
    if len(raw) >= 4:
        gram = raw[:-3].astype(np.uint32) | raw[1:-2].astype(np.uint32) << 8 | raw[2:-1].astype(np.uint32) << 16 | raw[3:].astype(np.uint32) << 24
        same = np.zeros(len(gram), bool)
        for lag in LAGS:
            if lag < len(gram):
                same[lag:] |= gram[lag:] == gram[:-lag]
        out[:len(gram)] = same
    return out


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping chunks of a text: byte codes (256 for padding) and repeat marks."""
    data = np.frombuffer(raw, np.uint8)
    n = max(1, -(-(len(data) - OVERLAP) // (CHUNK - OVERLAP)))
    size = (n - 1) * (CHUNK - OVERLAP) + CHUNK
    codes, marks = np.full(size, 256, np.int16), np.zeros(size, np.float32)
    codes[:len(data)], marks[:len(data)] = data, repeats(data)
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, CHUNK)[::CHUNK - OVERLAP]
    return view(codes), view(marks)


def pooled(net: Net, codes: np.ndarray, marks: np.ndarray, keep: bool = False):
    """The largest value of each filter in each chunk (and, to learn, where it was and what it saw)."""
    x = np.empty((*codes.shape, CHANNELS), np.float32)
    x[:, :, :-1] = net.embed[codes]
    x[:, :, -1] = marks
    flat = x.reshape(len(x), -1)
    windows = np.lib.stride_tricks.as_strided(flat, (len(x), POSITIONS, WIDTH * CHANNELS), (flat.strides[0], STRIDE * CHANNELS * 4, 4))
    seen = np.ascontiguousarray(windows).reshape(-1, WIDTH * CHANNELS)
    value = (seen @ net.filters).reshape(len(x), POSITIONS, FILTERS)
    if not keep:
        return np.maximum(value.max(axis=1) + net.bias, 0)
    at = value.argmax(axis=1)
    top = np.take_along_axis(value, at[:, None, :], axis=1)[:, 0] + net.bias
    return np.maximum(top, 0), at, seen.reshape(len(x), POSITIONS, -1)


def logit(net: Net, tops: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.concatenate([tops, mean], axis=1) @ net.out + net.base


def scores(net: Net, texts: list[str]) -> np.ndarray:
    """One probability a text; chunks of several texts (or of one long text) are pooled in steps."""
    n = len(texts)
    top, total, count = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS)), np.zeros(n)
    held, owners, size = [], [], 0

    def flush() -> None:
        nonlocal held, owners, size
        if held:
            value = pooled(net, np.concatenate([c for c, _ in held]), np.concatenate([m for _, m in held]))
            owner = np.concatenate(owners)
            np.maximum.at(top, owner, value)
            np.add.at(total, owner, value)
            np.add.at(count, owner, 1)
        held, owners, size = [], [], 0

    for i, text in enumerate(texts):
        codes, marks = chunks(text.encode())
        step = STEP_BYTES // CHUNK
        for a in range(0, len(codes), step):
            part = codes[a:a + step], marks[a:a + step]
            held.append(part)
            owners.append(np.full(len(part[0]), i))
            size += len(part[0]) * CHUNK
            if size >= STEP_BYTES:
                flush()
    flush()
    z = logit(net, top, total / np.maximum(count, 1)[:, None])
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value, grad):
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * grad
        v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * grad * grad
        return value - self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + 1e-6)


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Backpropagation through both pools: a filter learns from the places that won."""
    net, adam, r = new_net(seed), Adam(0.01), np.random.default_rng(seed)
    data = [chunks(t.encode()) for t in texts]
    for _ in range(epochs):
        order, at = r.permutation(len(data)), 0
        while at < len(order):
            batch, size = [], 0
            while at < len(order) and len(batch) < 32 and (not batch or size + len(data[order[at]][0]) <= 1024):
                batch.append(order[at])
                size += len(data[order[at]][0])
                at += 1
            part = [data[i] for i in batch]
            owner = np.repeat(np.arange(len(batch)), [len(c) for c, _ in part])
            codes, marks = np.concatenate([c for c, _ in part]), np.concatenate([m for _, m in part])
            value, where, seen = pooled(net, codes, marks, keep=True)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            top = np.maximum.reduceat(value, starts)
            n = np.bincount(owner)[:, None]
            mean = np.add.reduceat(value, starts) / n
            p = 1 / (1 + np.exp(-np.clip(logit(net, top, mean), -30, 30)))
            g = ((p - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            first = value == top[owner]
            g_value = g[owner][:, None] * (first * net.out[:FILTERS] + net.out[FILTERS:] / n[owner])
            g_value *= value > 0
            picked = np.take_along_axis(seen, where[:, :, None], axis=1)  # chunk, filter, what it saw
            g_filters = np.einsum("cfw,cf->wf", picked, g_value)
            g_seen = g_value[:, :, None] * net.filters.T[None]
            byte = where[:, :, None] * STRIDE + np.arange(WIDTH)[None, None]
            code = np.take_along_axis(codes, byte.reshape(len(codes), -1), axis=1).reshape(byte.shape)
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, code, g_seen.reshape(*byte.shape, CHANNELS)[..., :-1])
            g_embed[256] = 0
            adam.t += 1
            net.filters = adam.step("filters", net.filters, g_filters + 1e-4 * net.filters).astype(np.float32)
            net.bias = adam.step("bias", net.bias, g_value.sum(axis=0)).astype(np.float32)
            net.out = adam.step("out", net.out, g @ np.concatenate([top, mean], axis=1) + 1e-3 * net.out).astype(np.float32)
            net.base = float(adam.step("base", net.base, float(g.sum())))
            net.embed = adam.step("embed", net.embed, g_embed).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, epochs: int = EPOCHS) -> Net:
    held_out = fold(F.col("doc_id"), 4) == 2
    rows, totals = training_rows(docs, labels, "quality", held_out, sample)
    # at most sum(sample) documents of SAMPLE_CHARS
    begin = F.expr(f"cast(1 + pmod(xxhash64(text), greatest(1, length(text) - {SAMPLE_CHARS} + 1)) as int)")
    got = rows.withColumn("text", F.substring("text", begin, F.lit(SAMPLE_CHARS))).orderBy("doc_id").toPandas()
    y = got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        net = new_net()
        share = totals[1] / max(1, sum(totals))
        net.out[:] = 0
        net.base = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return net
    # as many of either class count, whatever the sample has
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    return fit(got["text"].tolist(), y, weight, epochs)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a:a + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": scores(net, part["text"].tolist())})
    rows = documents(docs).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
    return (rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int")))
