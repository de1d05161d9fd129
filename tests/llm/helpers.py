"""Small tables and plain versions that the tests of this folder compare with."""
import random
import re

#: Two words that polynomial hashes modulo a power of two can't tell apart.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
EDGE = [None, THUE + " and five more words", THUE.translate({97: 98, 98: 97}) + " and five more words", "", " ", "one", "a b c d", "Tab\tand\nline  double  space ", "x" * 5000, "<|endoftext|> inside <|endoftext|>",
        "日本語 テスト é̀ \x1c \x85 odd\u2003space", "it's we'll don't 'S", "same words here and there again now", "same words here and there again now"]
#: Extra columns, named like what the operators use inside.
CLASH = "n int, pos string, token string, size int, node int, cluster string, ids string, rank string, h int, w string"


def words(text):
    """Lower-cased A-Z, split at the six white-space characters."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def shingles(text, size=5):
    w = words(text)
    return [tuple(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = prose(rng, 1) + "q"
    return " ".join(w)


def families(seed=1, n=12):
    """Texts with near and exact copies, shared passages and unrelated ones."""
    rng = random.Random(seed)
    passage, out = prose(rng, 60), []
    for i in range(n):
        base = prose(rng, rng.choice([30, 80, 200]))
        out.append(base)
        out += [edited(rng, base, rng.choice([0, 1, 2, 3, 6, 12])) for _ in range(rng.randint(0, 8))]
        if i % 3 == 0:
            out.append(prose(rng, 100) + " " + passage + " " + prose(rng, 80))
    rng.shuffle(out)
    return out


def table(spark, texts, extra=True):
    """documents with ids 10, 11, ... and clashing columns."""
    rows = [(10 + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if not extra:
        return df
    for c in CLASH.split(", "):
        name, kind = c.split(" ")
        df = df.selectExpr("*", f"cast(1 AS {kind}) AS {name}")
    return df
