import random
import zlib

import numpy as np
import pytest

from quarry.llm import quality_cnn, toxicity

from .helpers import EDGE, prose, table

BAD = ["wretched", "villain", "scoundrel", "pillock", "nincompoop"]


def corpus(kind, n=400, seed=6):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        t, y = prose(rng, rng.randint(5, 120)).split(" "), int(rng.random() < 0.3)
        if kind == "toxic" and y:
            for _ in range(rng.randint(1, 4)):
                t.insert(rng.randrange(len(t)), rng.choice(BAD))
        if kind == "quality" and not y:
            at = rng.randrange(len(t))
            t[at:at + 8] = [w + rng.choice(["%%%", "###", "$$$"]) for w in t[at:at + 8]]
        texts.append(" ".join(t))
        labels.append(y)
    return texts, labels


def labelled(spark, labels, name):
    other = "quality" if name == "toxic" else "toxic"
    return spark.createDataFrame([(10 + i, y, 0) for i, y in enumerate(labels)] + [(None, 1, 0), (10, None, None)], f"doc_id long, {name} int, {other} int")


def accuracy(rows, labels, held_out=True):
    got = [(rows[10 + i].predicted, y) for i, y in enumerate(labels) if rows[10 + i].held_out == held_out]
    return sum(a == b for a, b in got) / len(got)


def test_toxicity_held_out(spark):
    texts, labels = corpus("toxic")
    df = table(spark, texts + EDGE)
    model = toxicity.train(df, labelled(spark, labels, "toxic"))
    rows = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(rows) == len(texts) + len(EDGE)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert accuracy(rows, labels) >= 0.95
    assert all(rows[10 + len(texts) + i].predicted == 0 for i in range(len(EDGE)))


def test_misspelling_and_quotation(spark):
    texts, labels = corpus("toxic")
    df = table(spark, texts)
    s = toxicity.Scorer(toxicity.train(df, labelled(spark, labels, "toxic")))
    code = lambda w: s.code(w.encode())
    assert code("scoundrel,") and code("scoundrel,") % 2 == 0
    for near in ("socundrel", "scondrel", "scounndrel", "scoumdrel"):
        assert code(near) % 2 == 1, near
    assert code("xoundrel") == 0 and code("abc") == 0
    plain, quoted = s.features(["it is a scoundrel here now", 'he said "scoundrel" here now'])
    assert plain[0] > 0 and plain[3] == 0 and quoted[0] == 0 and quoted[3] > 0


def test_quality_held_out(spark):
    texts, labels = corpus("quality")
    df = table(spark, texts + EDGE)
    net = quality_cnn.train(df, labelled(spark, labels, "quality"), epochs=12)
    rows = {r.doc_id: r for r in quality_cnn.score(df, net).collect()}
    assert len(rows) == len(texts) + len(EDGE)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert accuracy(rows, labels) >= 0.95


def test_chunks_cover_the_whole_text():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 511, 512, 513, 960, 961, 5000):
        raw = rng.integers(1, 200, n, dtype=np.uint8).tobytes()
        codes, marks = quality_cnn.chunks(raw)
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        back = np.concatenate([codes[0], *[c[quality_cnn.OVERLAP:] for c in codes[1:]]])[:n]
        assert bytes(back.astype(np.uint8)) == raw and codes.shape == marks.shape
        assert len(codes) == max(1, -(-(n - quality_cnn.OVERLAP) // step))


def test_scores_do_not_depend_on_the_batch():
    net = quality_cnn.new_net()
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (1, 50, 3000)] + ["", "y" * 300_000]
    together = quality_cnn.scores(net, texts)
    assert np.allclose(together, [quality_cnn.scores(net, [t])[0] for t in texts], atol=1e-5)


@pytest.mark.parametrize("module,name", [(toxicity, "toxic"), (quality_cnn, "quality")])
def test_without_labels_or_rows(spark, module, name):
    texts, labels = corpus(name, 10)
    df = table(spark, texts)
    none = module.train(df, labelled(spark, [], name).limit(0))
    assert len({r.score for r in module.score(df, none).collect()}) == 1
    one = module.train(df, labelled(spark, [1] * 10, name))
    assert len({r.score for r in module.score(df, one).collect()}) == 1
    assert module.score(df.limit(0), one).collect() == []


def test_keep_clean(spark):
    texts, labels = corpus("toxic")
    df = table(spark, [*texts, None])
    model = toxicity.train(df, labelled(spark, labels, "toxic"))
    gone = {r.doc_id for r in toxicity.score(df, model).where("predicted = 1").collect()}
    out = toxicity.keep_clean(df, model)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in df.select("doc_id").collect()} - gone


def test_training_takes_a_bounded_part_of_long_texts(spark, monkeypatch):
    texts, labels = corpus("quality", 80)
    texts = [t * 3000 if i % 20 == 0 else t for i, t in enumerate(texts)]
    seen = []
    monkeypatch.setattr(quality_cnn, "fit", lambda texts, y, weight, epochs: seen.extend(texts) or quality_cnn.new_net())
    quality_cnn.train(table(spark, texts), labelled(spark, labels, "quality"))
    assert max(map(len, texts)) > 500_000 and max(map(len, seen)) == quality_cnn.SAMPLE_CHARS
    # a part of its text, from anywhere in it
    assert all(any(t in x for x in texts) for t in seen) and any(not any(x.startswith(t) for x in texts) for t in seen)


def test_scores_of_texts_stand_alone():
    """A text's score doesn't depend on the texts beside it."""
    rng = np.random.default_rng(4)
    net = quality_cnn.new_net()
    texts = ["abcabc \u00e9 " * 3, "", "z" * 700, "short"]
    assert np.allclose(quality_cnn.scores(net, texts), [quality_cnn.scores(net, [t])[0] for t in texts])
    assert all(0 <= s <= 1 for s in quality_cnn.scores(net, ["".join(map(chr, rng.integers(32, 127, 500))) for _ in range(5)]))
