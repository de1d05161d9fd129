import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing, token_counts, token_files
from quarry.llm.common import shared_path, vocabulary
from quarry.llm.encode import Encoder

from .helpers import EDGE, families, prose, table

PATH = vocabulary()
ALPHABET = " aab\n'sé1! 日\t-_A"


def texts():
    rng = random.Random(2)
    odd = ["".join(rng.choice(ALPHABET) for _ in range(80)) for _ in range(200)]
    return EDGE + odd + families(4, 4) + [prose(rng, 20_000), "ab" * 3000, "a" * 1023]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(library):
    t = [x or "" for x in texts()]
    for want, got in zip(library.encode_batch(t, add_special_tokens=False), Encoder(PATH).batch(t)):
        assert got.tolist() == want.ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_library(spark, name):
    t = texts()
    want = [len(e.ids) for e in Tokenizer.from_file(vocabulary(name)).encode_batch([x or "" for x in t], add_special_tokens=False)]
    rows = {r.doc_id: r for r in token_counts.count_tokens(table(spark, t), vocabulary(name)).collect()}
    assert [rows[10 + i].n_tokens for i in range(len(t))] == want
    assert [rows[10 + i].n_bytes for i in range(len(t))] == [len((x or "").encode()) for x in t]
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows.values())


def test_counts_of_a_sentencepiece_model(spark):
    import sentencepiece
    path = vocabulary("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    t = ["plain words here", None, "日本語 x"]
    rows = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, t), path).collect()}
    assert [rows[10 + i] for i in range(3)] == [len(p.encode(x or "")) for x in t]


def test_array_merges_equal_sequential_merges():
    import json
    spec = json.load(open(PATH, encoding="utf-8"))
    m = token_counts.ArrayMerger(spec)
    rng = random.Random(3)
    tokens = [bytes(rng.choice(b"aaabth e") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rank = {(a, b): (r, k) for (a, b), r, k in zip(zip(m.key // m.size, m.key % m.size), m.rank, m.made)}
    for t, got in zip(tokens, m.counts(tokens)):
        s = [int(m.of_byte[b]) for b in t]
        while True:
            found = [(rank[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in rank]
            if not found:
                break
            _, i = min(found)
            s[i:i + 2] = [int(rank[s[i], s[i + 1]][1])]
        assert got == len(s)


def test_token_files_round_trip(spark, library):
    t = texts()
    df = table(spark, t)
    folder = shared_path(spark, "tokens")
    manifest = token_files.write_tokens(df, folder, PATH, sequence=256)
    rows = {r.doc_id: r for r in token_files.read_tokens(manifest, folder).collect()}
    start, stream = 0, []
    for i, x in enumerate(t):
        ids = library.encode(x or "", add_special_tokens=False).ids + [2]
        r = rows[10 + i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
        stream += ids
    # random access: row k of a shard is that part of the stream
    for m in manifest.collect():
        shard = token_files.Shard(folder, f"{m['name']}.arrow")
        for k in range(0, -(-m.n_tokens // 256), 7):
            ids, mask = shard.row(k)
            a = m.start + k * 256
            b = min(a + 256, m.start + m.n_tokens)
            assert ids[mask].tolist() == stream[a:b] and mask[:b - a].all() and not mask[b - a:].any()


def test_token_files_of_nothing_and_of_repeated_rows(spark, library):
    assert token_files.token_output(table(spark, []), PATH).collect() == []
    df = table(spark, ["b c", None])
    rows = sorted(map(tuple, token_files.token_output(df.unionByName(df), PATH).collect()))
    n = len(library.encode("b c").ids) + 1
    assert [r[:3] for r in rows] == [(10, 0, n), (10, n, n), (11, 2 * n, 1), (11, 2 * n + 1, 1)]


def packed(df, want, window):
    rows = packing.pack(df, PATH, window=window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    assert padding == 0


@pytest.mark.parametrize("window", [1024, 64])
def test_packing(spark, library, window):
    t = texts()
    want = {10 + i: library.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(t)}
    packed(table(spark, t), want, window)


def test_packing_of_nothing_and_of_repeated_rows(spark):
    assert packing.pack(table(spark, []), PATH).collect() == []
    df = table(spark, ["one two three", None])
    rows = packing.pack(df.unionByName(df).unionByName(df), PATH).collect()
    assert sum(r.length for r in rows) == 3 * sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_plan_uses_combinations_first():
    counts = np.zeros(1024, np.int64)
    counts[[512, 300, 724, 100, 924]] = [1000, 400, 400, 70, 50]
    plan = packing.make_plan(counts)
    assert plan.used.sum() >= 0.95 * counts.sum() and (plan.used <= counts).all()
    x = packing.least_squares(packing.combinations(np.flatnonzero(counts)), counts.astype(float))
    assert (x >= 0).all()
