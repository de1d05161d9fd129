import hashlib
import re
import zlib

from quarry.llm import secret_scan

from .helpers import EDGE, table

# the contract's expressions, as they stand
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def checked(body="a" * 30):
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = secret_scan.BASE62[d] + out
    return "ghp_" + body + out.rjust(6, "0")


TEXTS = EDGE + [
    "Password: hunter22 and token=abc TOKEN = 'abcdef1'", "token=token=abcdefgh secret:short1", "passwordpassword=abcdefg",
    "api_key=abcdef apikey: \"x.y/z-1=\" api__key=abcdefg", "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "A1" * 8 + " AKIAAKIA" + "Z" * 12 + " AKIASHORT",
    "é日 " + "0123456789abcdef" * 2 + "g" + "a" * 23 + " " + "b" * 24, "f" * 24, "f" * 23, "İ İ token=abcdefgh", "token=" + "ab12" * 9 + " token = 'x'",
    f"{checked()} and {checked()[:-1]}0 x", "secret " * 2000 + "secret=abcdefgh", "deadbeef" * 800]


def brute(t):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_scan_equals_plain_expressions(spark):
    rows = {r.doc_id: r for r in secret_scan.find_secrets(table(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        want, r = brute(t or ""), rows[10 + i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(secret_scan.joined(want).encode()).hexdigest()
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{a}:{b}" for k, a, b in want}


def test_checksums_decide():
    good = checked()
    assert ("checked", 2, 42) in secret_scan.scan("x " + good)
    assert not [s for s in secret_scan.scan("x " + good[:-1] + ("1" if good[-1] == "0" else "0")) if s[0] == "checked"]


def test_redact(spark):
    df = table(spark, TEXTS + ["keep token=abcdefgh, this"])
    out = secret_scan.redact(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[10].text is None and rows[10 + len(TEXTS)].text == "keep [secret], this"
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows.values())
    assert not any(secret_scan.scan(r.text or "") for r in rows.values())


def test_empty_table(spark):
    assert secret_scan.find_secrets(table(spark, [])).collect() == []
