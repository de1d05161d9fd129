import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import lexicon, queries
from quarry.llm.common import shared_path, vocabulary

from .helpers import EDGE, families, prose, table

PATH = vocabulary("word_bpe_49k.json")
ODD = ["a<|startoftext|>b <|endoftext|><|endoftext|>c <| d", "<|endoftext|>", "İstanbul ΣΑΣ ſt", "it's" * 300, "é ạ̈ ̈x", "12345 3½ ²", "\x1c\x85\xa0  x"]


def texts():
    rng = random.Random(5)
    odd = ["".join(rng.choice(" aab\n'sé1! 日\t-_A̧ÅΣςİſ²½\x85\xa0 <|>") for _ in range(60)) for _ in range(200)]
    return EDGE + ODD + odd + families(4, 4) + [prose(rng, 20_000), "ab" * 3000, "a" * 1023]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(rows, texts, library):
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, w in enumerate(want):
        r = rows[10 + i]
        assert r.n_tokens == len(w.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(w.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(w.ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("words", [0, 40, lexicon.LEXICON_WORDS])
def test_any_lexicon_gives_the_librarys_ids(spark, library, words):
    t = texts()
    df = table(spark, t)
    uri = lexicon.build_lexicon(df, PATH, words)
    check({r.doc_id: r for r in lexicon.digests(df, PATH, uri).collect()}, t, library)


def test_query_over_the_whole_table(spark, library):
    rows = queries.op12_bpe_lexicon(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(docs)
    check({10 + ids.index(r.doc_id): r for r in rows}, [docs[i] for i in ids], library)
    assert len(rows) == len(docs)


def test_ids_and_decoded_text(spark, library):
    rows = lexicon.encode_decode(table(spark, ["Some Words, here", None, "<|endoftext|>x"]), PATH).collect()
    for r, t in zip(sorted(rows), ["Some Words, here", "", "<|endoftext|>x"]):
        assert list(r.ids) == library.encode(t, add_special_tokens=False).ids
        assert r.decoded == library.decode(list(r.ids), skip_special_tokens=False)


def test_nothing_repeated_rows_and_rows_without_an_id(spark):
    assert lexicon.digests(table(spark, []), PATH).collect() == []
    df = table(spark, ["b c", None])
    rows = sorted(map(tuple, lexicon.digests(df.unionByName(df), PATH).collect()))
    assert len(rows) == 4 and rows[0] == rows[1] and rows[2][1] == 0
    assert lexicon.digests(df.selectExpr("cast(null AS long) AS doc_id", "text"), PATH).collect() == []


def test_transducer_is_minimal_and_exact(spark):
    rng = random.Random(7)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(600)})
    entries = [(w, [rng.randrange(4) for _ in range(rng.randint(0, 3))]) for w in words]
    arrays = lexicon.compile_transducer(entries)
    t = lexicon.Transducer(lexicon.write_transducer(shared_path(spark, "lexicon-test"), arrays))
    probes = words + [w + b"a" for w in words] + [w[:-1] for w in words if len(w) > 1] + [b"zz", b"a" * 50]
    held, n, ids = t.walk(probes)
    at = np.concatenate([[0], np.cumsum(n)])
    want = dict(entries)
    for i, w in enumerate(probes):
        assert held[i] == (w in want)
        assert ids[at[i]:at[i + 1]].tolist() == want.get(w, [])
    # equal suffixes with equal output are one state: no two states have the same content
    contents = set()
    for s in range(len(t.final)):
        edges = np.flatnonzero(t.key >> 8 == s)
        contents.add((t.final[s], tuple(t.pool[t.end_at[s]:t.end_at[s] + t.end_n[s]]),
                      tuple((t.key[e] & 255, t.target[e], tuple(t.pool[t.out_at[e]:t.out_at[e] + t.out_n[e]])) for e in edges)))
    assert len(contents) == len(t.final)
    same = lexicon.compile_transducer([(w, []) for w in words])  # an automaton alone shares far more
    assert len(same["final"]) < len(arrays["final"]) <= sum(map(len, words)) + 1


def test_merges_equal_sequential_merges():
    b = lexicon.WordBpe(PATH)
    rng = random.Random(3)
    tokens = [bytes(rng.choice(b"aaabthe") for _ in range(rng.randint(1, 60))) for _ in range(300)] + [b"the" * 200, b"a" * 999]
    for t, got in zip(tokens, b.merge(tokens)):
        s = [*map(int, b.inner[list(t[:-1])]), int(b.last[t[-1]])]
        while True:
            found = [(b.rank[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in b.rank]
            if not found:
                break
            _, i = min(found)
            s[i:i + 2] = [b.rank[s[i], s[i + 1]][1]]
        assert got == s
