import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import collocations, queries

from .helpers import EDGE, prose, table


def brute(rows, longest, least, first):
    """Plain counting of every phrase; rows of (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        held = {}
        for g, a in counts.items():
            if a >= least:
                for size in range(2, len(g)):
                    for i in range(len(g) - size + 1):
                        held[g[i:i + size]] = max(held.get(g[i:i + size], 0), a)
        for g, a in counts.items():
            if a < least or len(g) < 2 or held.get(g, 0) >= a:
                continue
            cuts = [(1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for i, (s, a, g, x, y) in enumerate(sorted(found)[:first]):
            out.append((lang, i + 1, g.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def texts():
    rng = random.Random(8)
    vocabulary = prose(rng, 12).split(" ")
    out = [rng.choice([" ", "  ", "\t"]).join(rng.choice(vocabulary[:rng.randint(1, 12)]) + rng.choice(["", "", "", ".", ", x", "\n", "!?"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return EDGE + ["Same Line here again. Same line Here again"] * 9 + out + [" ".join(["round"] * 300)]


@pytest.mark.parametrize("chunk_words, mass, cells", [(50, 40, 30), (50, 1 << 22, 0), (collocations.CHUNK_WORDS, collocations.BLOCK_MASS, collocations.DENSE_CELLS)])
def test_equals_plain_counting(spark, monkeypatch, chunk_words, mass, cells):
    monkeypatch.setattr(collocations, "BLOCK_MASS", mass)
    monkeypatch.setattr(collocations, "PACKED_ROWS", 7 if cells == 30 else collocations.PACKED_ROWS)
    count = collocations.count_tile
    monkeypatch.setattr(collocations, "count_tile", lambda least: with_cells(count(least), cells))
    t = texts()
    df = table(spark, t).withColumn("lang", F.expr("CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END"))
    want = brute([(("en", "fr", None)[(10 + i) % 3], x) for i, x in enumerate(t)], 5, 3, 40)
    got = sorted(map(tuple, collocations.collocations(df, least=3, first=40, chunk_words=chunk_words).collect()))
    assert got == want and len(want) > 60


def with_cells(apply, cells):
    def run(table):
        collocations.DENSE_CELLS = cells  # in the worker
        return apply(table)
    return run


def test_empty_table_and_rare_words(spark):
    assert collocations.collocations(table(spark, [])).collect() == []
    assert collocations.collocations(table(spark, ["all of these are rare", None, ""])).collect() == []


def test_a_long_text_is_cut_between_words(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 40)
    text = " ".join(prose(random.Random(1), 40).split(" ")) + "\n" + "x" * 300 + " y.z " * 30
    parts = list(collocations.slices(text))
    assert b"".join(parts) == text.replace(".", "\n").encode() and len(parts) > 3
    assert all(p[-1:] in b" \n" for p in parts[:-1])


def test_tiles_equal_plain_counts(monkeypatch):
    monkeypatch.setattr(collocations, "TILE", 8)
    monkeypatch.setattr(collocations, "DENSE", 40)
    rng = np.random.default_rng(3)
    a, b = (np.minimum(rng.geometric(0.08, 4000) - 1, 59) for _ in range(2))
    want = Counter(zip(a.tolist(), b.tolist()))
    x, y, n = collocations.count_pairs(a, b, 60)
    assert len(n) == len(want) and dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) == dict(want)


def test_large_products_are_exact():
    import pandas as pd
    big = 10 ** 16 + 7
    frame = pd.DataFrame({"lang": ["x"], "phrase": ["a b"], "a": [big], "n": [10 ** 18 + 9], "firsts": [[big + 1]], "rests": [[big + 2]]})
    row = next(collocations.lowest_cut(iter([frame]))).iloc[0]
    assert row["score"] == 1000 * big * (10 ** 18 + 9) // ((big + 1) * (big + 2))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(collocations.SQL).fetchall())
    q = queries.op11_collocations(spark, sf)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in q.collect())
    assert got == want and want


def test_packed_numbers_come_back():
    rng = np.random.default_rng(5)
    for rows in (np.zeros((3, 0), np.int64), np.array([[7], [0], [2 ** 62]]), rng.integers(-2 ** 63, 2 ** 63 - 1, (4, 50)), np.cumsum(rng.integers(0, 9, (2, 3000)), axis=1)):
        assert np.array_equal(collocations.unpack(collocations.pack(rows), len(rows)), rows)
    assert len(collocations.pack(rows)) < rows.nbytes / 8


def tiles_of(folder, chunks, size, f, mass):
    """The packed tiles of random sequences, whose words fill blocks by their counts ``f``."""
    rng = np.random.default_rng(9)
    blocks = (np.cumsum(f) - f) // mass
    out = []
    for _ in range(chunks):
        local = rng.choice(len(f), size, p=f / f.sum()).astype(np.int32)
        out.append((local, collocations.neighbours(folder, np.arange(len(f)) * 3 + 5, blocks, f >= mass, local)))
    return out


def test_a_frequent_pair_is_one_row_whatever_the_chunks(tmp_path, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(collocations, "ROW_CHUNKS", 7)
    f = np.array([500, 120, 40, 30, 20, 10])
    made = tiles_of(str(tmp_path), 20, 300, f, 100)
    want, held = Counter(), defaultdict(set)
    for local, tiles in made:
        pairs = Counter(zip((local[:-1] * 3 + 5).tolist(), (local[1:] * 3 + 5).tolist()))
        want.update(pairs)
        for p in pairs:
            held[p].add(tiles["chunk"][0].as_py())
    tables = pa.concat_tables([t for _, t in made])
    for cells in (0, 1 << 22):
        monkeypatch.setattr(collocations, "DENSE_CELLS", cells)
        rows = []
        for key in {tuple(r.values()) for r in tables.select(["tile_left", "tile_right"]).to_pylist()}:
            mask = [tuple(r.values()) == key for r in tables.select(["tile_left", "tile_right"]).to_pylist()]
            rows += collocations.count_tile(100)(tables.filter(mask)).to_pylist()
        often = {p: n for p, n in want.items() if n >= 100}
        assert {(r["left"], r["right"]): r["f"] for r in rows} == often and often
        got = defaultdict(list)
        for r in rows:
            got[r["left"], r["right"]] += np.frombuffer(r["chunks"], "<i8").tolist()
        assert all(sorted(got[p]) == sorted(held[p]) for p in often)
        assert len(rows) == sum(-(-len(held[p]) // 7) for p in often)


def test_only_heavy_words_are_cut_by_right_blocks(tmp_path):
    f = np.array([5000, 300] + [60] * 200)
    (_, tiles), = tiles_of(str(tmp_path), 1, 20_000, f, 1000)
    rows = tiles.select(["tile_left", "tile_right"]).to_pylist()
    last = int((f.sum() - 60) // 1000)
    light = [r for r in rows if r["tile_left"] > 0]
    assert len(light) == len({r["tile_left"] for r in light}) <= last and all(r["tile_right"] == -1 for r in light)
    assert len(rows) - len(light) > 5
