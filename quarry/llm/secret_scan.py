"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions at its hits, then embedded checksums.

The automaton finds every keyword of a text in one pass; only there an
expression is tried, anchored at the hit.  Hits are tried in order and one
inside an earlier match is passed over, which gives the leftmost
non-overlapping matches.  Long hexadecimal runs have no keyword: their filter
looks at every 24th byte, as a run of 24 covers one.

Kinds: ``assign``, ``access`` and ``hex``, and those added by their checksum:
``checked``, a prefixed token (Fixed values: prefixes below) of 30 base-62
characters and 6 more that hold their CRC-32.

Defined cases: a null text counts as empty and has no spans; repeated rows are
scanned each; rows without an id and other
columns are left out; very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

# Keywords, and prefixes of tokens with an embedded checksum.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS_WORD = "AKIA"
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "checked")

def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join([*map(_either, ASSIGN_WORDS[:4]), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile("(?:" + "|".join(CHECKED_PREFIXES) + ")([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
HEX = np.zeros(256, dtype=bool)
HEX[list(b"0123456789abcdef")] = True
HEX_LEAST = 24
_AUTOMATON: list = []


def automaton() -> ahocorasick.Automaton:
    """Of the lower-cased keywords; made once a worker."""
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for word, kind in [*((w, "assign") for w in ASSIGN_WORDS), (ACCESS_WORD.lower(), "access"), *((p, "checked") for p in CHECKED_PREFIXES)]:
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def checksum_holds(body: str, check: str) -> bool:
    """The six characters are the body's CRC-32 in base 62, filled up with zeros."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0") == check


def hex_runs(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of the maximal runs of at least HEX_LEAST lower-case hexadecimal digits."""
    inside = HEX[np.frombuffer(raw, dtype=np.uint8)]
    sample = np.flatnonzero(inside[HEX_LEAST - 1::HEX_LEAST]) * HEX_LEAST + HEX_LEAST - 1
    out, end = [], -1
    for i in sample.tolist():
        if i < end or not (inside[i - 1] or inside[min(i + 1, len(raw) - 1)]):
            continue
        a, b = i, i + 1
        while a > 0 and inside[a - 1]:
            a -= 1
        while b < len(raw) and inside[b]:
            b += 1
        end = b
        if b - a >= HEX_LEAST:
            out.append((a, b))
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    lower = text.lower()
    if len(lower) != len(text):  # some letters become two; then only A-Z are lowered
        lower = "".join(c.lower() if c < "\x80" else c for c in text)
    hits = sorted((end + 1 - n, kind) for end, (n, kind) in automaton().iter(lower))
    found, done = [], dict.fromkeys(KINDS, -1)
    for at, kind in hits:
        if at < done[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind].match(text, at)
        if not m:
            continue
        done[kind] = m.end()
        if kind == "assign" and len(m[2]) >= 6 or kind == "access" and m.end() - at >= 20 or kind == "checked" and checksum_holds(m[1], m[2]):
            found.append((kind, at, m.end()))
    raw = text.encode()
    for a, b in hex_runs(raw):
        at = a if len(raw) == len(text) else len(raw[:a].decode())
        found.append(("hex", at, at + b - a))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every document; a map without a shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                spans = scan(text)
                base = [s for s in spans if s[0] != "checked"]
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])
    return documents(docs).mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced; ``n_chars`` follows where the table has it.  Rows and other columns stay."""
    def masked(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for _, a, b in sorted(scan(text), key=lambda s: (s[1], -s[2])):
            if b > at:
                out += [text[at:a], mask] if a >= at else []
                at = b
        return "".join(out) + text[at:]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            i = batch.schema.get_field_index("text")
            field = batch.schema.field(i)
            yield batch.set_column(i, field, pa.array([masked(t) for t in batch.column(i).to_pylist()], type=field.type))

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
