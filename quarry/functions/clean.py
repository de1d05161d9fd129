"""Scalar cleaning rules (F1–F16) as Spark SQL expressions.

Loose JSON fields arrive as VARIANT.  Each rule takes the SQL text of a value
``v`` and of its *kind* ``k`` — a short tag (``missing null bool int num str
arr obj obj0``) derived once from ``schema_of_variant`` — and returns the SQL
text of the cleaned value, reproducing the loose-typing rules of the source
data (truthiness, ``int()``-like parsing, string-or-list…) with built-in
functions.  Jobs apply a whole stage with one ``selectExpr`` (the JVM parses
it once; building the same trees call by call through py4j costs tens of
thousands of round trips), and ``col(rule(...))`` gives a ``Column``.

Computing the kind once per field matters: ``schema_of_variant`` walks the
whole value, so jobs stage ``value → kind`` as columns (``with_kinds``) and
the rules reference those attributes.

The one non-built-in step is HTML entity decoding (F1), which needs the full
HTML5 entity table: an Arrow-batched pandas UDF that only receives rows
holding an ``&`` (``strip_html`` works on Columns).
"""

from __future__ import annotations

import html
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scan import INT_TEXT

# Characters Python's str.strip() removes: every code point with str.isspace().
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
MAX_INT = 2147483647
MIN_INT = -2147483648
# Release-date formats tried in order (month abbreviations, day 1–2 digits).
RELEASE_DATE_FORMATS = ("MMM d, yyyy", "d MMM, yyyy", "MMM yyyy", "yyyy")
TAG_PATTERN = r"<[^>]+>"
# schema_of_variant type name (leading word, with "<>" for an empty object) → kind
KIND_BY_TYPE = {"MISSING": "missing", "VOID": "null", "BOOLEAN": "bool", "BIGINT": "int", "INT": "int",
                "SMALLINT": "int", "TINYINT": "int", "DECIMAL": "num", "DOUBLE": "num", "FLOAT": "num",
                "STRING": "str", "ARRAY": "arr", "OBJECT<>": "obj0", "OBJECT": "obj"}

_lambda_ids = itertools.count()


def q(s: str) -> str:
    """SQL string literal: quote and backslash escaped, non-printable or
    non-ASCII characters as ``\\uXXXX``."""
    out = []
    for ch in s:
        if ch in "\\'":
            out.append("\\" + ch)
        elif 32 <= ord(ch) < 127:
            out.append(ch)
        else:
            out.append("\\u%04x" % ord(ch))
    return "'" + "".join(out) + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(sql: str) -> Column:
    return F.expr(sql)


def _var() -> str:
    """A fresh lambda variable name (nested lambdas must not shadow each other)."""
    return f"x{next(_lambda_ids)}"


WS = q(PY_WHITESPACE)


# ------------------------------------------------------------------ kinds
def kind_of_schema(t: str) -> str:
    """``schema_of_variant`` text → kind tag; ``t`` is referenced once."""
    pairs = ", ".join(f"{q(a)}, {q(b)}" for a, b in KIND_BY_TYPE.items())
    return (f"coalesce(try_element_at(map({pairs}), "
            f"coalesce(regexp_extract({t}, '^[A-Z]+(<>)?', 0), 'MISSING')), 'other')")


def kind(v: str) -> str:
    """Kind tag of a VARIANT (inline; jobs stage it with ``with_kinds``)."""
    return kind_of_schema(f"schema_of_variant({v})")


def with_kinds(df: DataFrame, values: dict[str, str], keep: list | None = None) -> DataFrame:
    """Stage ``name → variant SQL`` columns and their kinds (``name__k``)."""
    keep = df.columns if keep is None else keep
    keep_sql = [ident(c) for c in keep]
    s1 = df.selectExpr(*keep_sql, *[f"{v} AS {ident(n)}" for n, v in values.items()])
    s2 = s1.selectExpr("*", *[f"schema_of_variant({ident(n)}) AS {ident(n + '__t')}" for n in values])
    return s2.selectExpr(*keep_sql, *[ident(n) for n in values],
                         *[f"{kind_of_schema(ident(n + '__t'))} AS {ident(n + '__k')}" for n in values])


def vk(name: str) -> tuple[str, str]:
    return ident(name), ident(name + "__k")


def vget(v: str, path: str, to: str = "variant") -> str:
    return f"try_variant_get({v}, {q(path)}, {q(to)})"


def pystrip(s: str) -> str:
    """``str.strip()``: trim every Unicode whitespace character."""
    return f"btrim({s}, {WS})"


def _k(v: str, k: str | None) -> str:
    return k if k is not None else kind(v)


def is_object(v: str, k: str | None = None) -> str:
    return f"({_k(v, k)} IN ('obj', 'obj0'))"


def is_array(v: str, k: str | None = None) -> str:
    return f"({_k(v, k)} = 'arr')"


def is_string(v: str, k: str | None = None) -> str:
    return f"({_k(v, k)} = 'str')"


# ------------------------------------------------------------------ F7 truthiness
def truthy(v: str, k: str | None = None) -> str:
    """``bool(x)`` of a JSON value: null/false/0/''/[]/{} and missing → false."""
    k = _k(v, k)
    return (f"coalesce(CASE WHEN {k} = 'bool' THEN {vget(v, '$', 'boolean')} "
            f"WHEN {k} IN ('int', 'num') THEN {vget(v, '$', 'double')} <> 0 "
            f"WHEN {k} = 'str' THEN length({vget(v, '$', 'string')}) > 0 "
            f"WHEN {k} = 'arr' THEN size({vget(v, '$', 'array<variant>')}) > 0 "
            f"WHEN {k} = 'obj' THEN true ELSE false END, false)")


# ------------------------------------------------------------------ int()/float() parsing
def int_text(s: str, to: str = "bigint") -> str:
    """``int(text)``: surrounding whitespace, sign, digits with single ``_``."""
    return f"CASE WHEN {s} RLIKE {q(INT_TEXT)} THEN try_cast(regexp_replace({pystrip(s)}, '_', '') AS {to}) END"


def variant_int(v: str, k: str | None = None, default=None) -> str:
    """``int(x)`` of a JSON value, ``default`` when it raises: bools → 0/1,
    numbers truncate toward zero, int-looking text parses, the rest fails."""
    k = _k(v, k)
    val = (f"CASE WHEN {k} = 'bool' THEN CAST({vget(v, '$', 'boolean')} AS BIGINT) "
           f"WHEN {k} IN ('int', 'num') THEN coalesce({vget(v, '$', 'bigint')}, {_saturated(vget(v, '$', 'double'))}) "
           f"WHEN {k} = 'str' THEN {_big_int_text(vget(v, '$', 'string'))} END")
    return f"coalesce({val}, CAST({int(default)} AS BIGINT))" if default is not None else val


def _saturated(x: str) -> str:
    """A number beyond bigint → the bigint at that end (Python's ints have no end; the caps come later)."""
    return f"CASE WHEN {x} >= 9.2e18D THEN 9223372036854775807L WHEN {x} <= -9.2e18D THEN -9223372036854775807L END"


def _big_int_text(s: str) -> str:
    """``int_text`` with values beyond bigint at its ends."""
    end = f"CASE WHEN {pystrip(s)} LIKE '-%' THEN -9223372036854775807L ELSE 9223372036854775807L END"
    return f"CASE WHEN {s} RLIKE {q(INT_TEXT)} THEN coalesce(try_cast(regexp_replace({pystrip(s)}, '_', '') AS BIGINT), {end}) END"


# What ``float(text)`` accepts; a cast alone would also take suffixes such as ``1.5f``.
FLOAT_TEXT = r"(?i)^[+-]?(([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)$"


def float_text(s: str) -> str:
    return f"CASE WHEN {pystrip(s)} RLIKE {q(FLOAT_TEXT)} THEN try_cast(regexp_replace({pystrip(s)}, '_', '') AS DOUBLE) END"


def variant_float(v: str, k: str | None = None, default: float | None = 0.0) -> str:
    """F6 ``float(x)``, ``default`` on failure (text such as ``' 0.52 '`` accepted)."""
    k = _k(v, k)
    val = (f"CASE WHEN {k} = 'bool' THEN CAST({vget(v, '$', 'boolean')} AS DOUBLE) "
           f"WHEN {k} IN ('int', 'num') THEN {vget(v, '$', 'double')} "
           f"WHEN {k} = 'str' THEN {float_text(vget(v, '$', 'string'))} END")
    return f"coalesce({val}, CAST({float(default)!r} AS DOUBLE))" if default is not None else val


def clamp_int(x: str) -> str:
    """cap at 2147483647 (and floor at the 32-bit minimum so the cast is safe)."""
    return f"CAST(greatest(least({x}, {MAX_INT}L), {MIN_INT}L) AS INT)"


def to_int32(x: str) -> str:
    """bigint → int, NULL when it does not fit (ANSI casts would raise)."""
    return f"try_cast({x} AS INT)"


# ------------------------------------------------------------------ F16 text
def item_text(v: str, k: str | None = None) -> str:
    """``str(x)`` of a JSON value: strings as is, booleans ``True``/``False``,
    JSON null → NULL, anything else its JSON text."""
    k = _k(v, k)
    return (f"CASE WHEN {k} = 'str' THEN {vget(v, '$', 'string')} "
            f"WHEN {k} = 'bool' THEN CASE WHEN {vget(v, '$', 'boolean')} THEN 'True' ELSE 'False' END "
            f"WHEN {k} IN ('null', 'missing') THEN CAST(NULL AS STRING) ELSE to_json({v}) END")


def text_or_empty(v: str, k: str | None = None) -> str:
    """F16 ``x or ''`` for a text field: falsy → ''; truthy → its text."""
    k = _k(v, k)
    return f"CASE WHEN {truthy(v, k)} THEN {item_text(v, k)} ELSE '' END"


def text_or_null(v: str, k: str | None = None) -> str:
    k = _k(v, k)
    return (f"CASE WHEN {k} IN ('null', 'missing') THEN CAST(NULL AS STRING) "
            f"WHEN {k} = 'str' THEN {vget(v, '$', 'string')} ELSE to_json({v}) END")


# ------------------------------------------------------------------ F1 HTML (Columns)
@F.pandas_udf(T.StringType())
def _unescape_strip(s: pd.Series) -> pd.Series:
    # per value: HTML entity decode, then str.strip(); NULL in → NULL out
    return s.map(lambda x: None if x is None else html.unescape(x).strip())


# Entities decoded natively, in single-pass order (``&amp;`` last).
NATIVE_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|amp);)[#A-Za-z]"


def strip_html(c: Column) -> Column:
    """falsy → ''; remove tags, then decode entities, then strip.

    The five common entities are decoded natively.  Only text holding any
    other entity-like sequence (``&`` + letter or ``#``, checked on the
    original text so nothing is decoded twice) goes to ``html.unescape`` in
    the Arrow UDF; every other row gets NULL there and takes the native path."""
    no_tags = F.regexp_replace(F.coalesce(c, F.lit("")), TAG_PATTERN, "")
    native = no_tags
    for ent, ch in NATIVE_ENTITIES:
        native = F.replace(native, F.lit(ent), F.lit(ch))
    needs_python = no_tags.rlike(OTHER_ENTITY)
    return F.coalesce(_unescape_strip(F.when(needs_python, no_tags)), F.btrim(native, F.lit(PY_WHITESPACE)))


def list_separators(s: str) -> str:
    """``', '`` → ``'; '``."""
    return f"replace({s}, ', ', '; ')"


# ------------------------------------------------------------------ F3 dates
def parse_release_date(s: str) -> str:
    """first matching format, missing parts = 1; blank or no match → NULL.
    Runs of whitespace count as one space, as in strptime."""
    blank = q("")
    t = f"regexp_replace({pystrip(f'coalesce({s}, {blank})')}, {q(r'\s+')}, ' ')"
    tries = ", ".join(f"try_to_timestamp({t}, {q(fmt)})" for fmt in RELEASE_DATE_FORMATS)
    return f"CAST(CASE WHEN {t} = '' THEN NULL ELSE coalesce({tries}) END AS TIMESTAMP_NTZ)"


# ------------------------------------------------------------------ F4 age
def required_age(v: str, k: str | None = None) -> str:
    """NULL → 0; int/bool clamp 0..21; text: int, else leading digits,
    else 0; numbers with a fraction: leading digits of their text."""
    k = _k(v, k)
    s = pystrip(vget(v, "$", "string"))
    lead = f"regexp_extract({s}, '^([0-9]+)', 1)"
    raw = (f"CASE WHEN {k} = 'bool' THEN CAST({vget(v, '$', 'boolean')} AS BIGINT) "
           f"WHEN {k} = 'int' THEN {vget(v, '$', 'bigint')} "
           f"WHEN {k} = 'num' THEN CASE WHEN {vget(v, '$', 'double')} < 0 THEN 0L ELSE {vget(v, '$', 'bigint')} END "
           f"WHEN {k} = 'str' THEN coalesce({int_text(s)}, "
           f"CASE WHEN {lead} <> '' THEN try_cast({lead} AS BIGINT) END, 0L) ELSE 0L END")
    return f"CAST(greatest(0, least(coalesce({raw}, 21L), 21L)) AS INT)"


# ------------------------------------------------------------------ F8 owners
def owners_range(v: str, k: str | None = None) -> tuple[str, str]:
    """F8: ``"20,000 .. 50,000"`` → (20000, 50000); exactly two parts, both ints, else (0, 0)."""
    parts = f"split({pystrip(text_or_empty(v, k))}, {q(r'\.\.')}, -1)"
    lo = int_text(pystrip(f"replace(try_element_at({parts}, 1), ',', '')"))
    hi = int_text(pystrip(f"replace(try_element_at({parts}, 2), ',', '')"))
    ok = f"(size({parts}) = 2 AND ({lo}) IS NOT NULL AND ({hi}) IS NOT NULL)"
    return (f"CASE WHEN {ok} THEN {lo} ELSE 0L END", f"CASE WHEN {ok} THEN {hi} ELSE 0L END")


# ------------------------------------------------------------------ arrays of variants
ITEM_TYPE = "array<struct<v:variant,k:string>>"


def variant_items(v: str, k: str | None = None) -> str:
    """Items of a JSON array with their kinds (``array<struct<v, k>>``); [] for anything else."""
    k = _k(v, k)
    x = _var()
    return (f"CASE WHEN {k} = 'arr' THEN transform({vget(v, '$', 'array<variant>')}, "
            f"{x} -> named_struct('v', {x}, 'k', {kind(x)})) ELSE CAST(array() AS {ITEM_TYPE}) END")


# ------------------------------------------------------------------ F9 F10 lists
def string_or_list(v: str, k: str | None = None) -> str:
    """a string → [it]; a list → its items as text (JSON nulls dropped);
    anything else → [].  Empty items are dropped, the rest stripped (so a
    whitespace-only item stays as '')."""
    k = _k(v, k)
    e, x, y = _var(), _var(), _var()
    items = (f"CASE WHEN {k} = 'str' THEN array({vget(v, '$', 'string')}) "
             f"WHEN {k} = 'arr' THEN transform({variant_items(v, k)}, {e} -> {item_text(e + '.v', e + '.k')}) "
             f"ELSE CAST(array() AS array<string>) END")
    return f"transform(filter({items}, {x} -> {x} IS NOT NULL AND length({x}) > 0), {y} -> {pystrip(y)})"


def join_list(arr: str) -> str:
    """``', '.join(items)``."""
    return f"array_join({arr}, ', ')"


def link_names(arr: str) -> str:
    """Names used for links: stripped, empty ones skipped."""
    x, y = _var(), _var()
    return f"filter(transform({arr}, {x} -> {pystrip(x)}), {y} -> {y} <> '')"


def id_name_items(v: str, k: str | None, name_keys: tuple[str, ...]) -> str:
    """``[{id, description|name}]`` → ``array<struct<id bigint, name string>>``;
    non-objects and non-int ids dropped; name = first truthy key else ''."""
    e1, e2, e3, s = _var(), _var(), _var(), _var()
    keys = ("id",) + tuple(name_keys)
    # stage 1: pull the fields of each object item; stage 2: their kinds; stage 3: the rules
    fields = ", ".join(f"'f{i}', CASE WHEN {e1}.k IN ('obj', 'obj0') THEN {vget(e1 + '.v', '$.' + n)} END"
                       for i, n in enumerate(keys))
    st1 = f"transform({variant_items(v, k)}, {e1} -> named_struct('obj', {e1}.k IN ('obj', 'obj0'), {fields}))"
    kinds = ", ".join(f"'f{i}', {e2}.f{i}, 'k{i}', {kind(f'{e2}.f{i}')}" for i in range(len(keys)))
    st2 = f"transform({st1}, {e2} -> named_struct('obj', {e2}.obj, {kinds}))"
    name = "''"
    for i in reversed(range(1, len(keys))):
        fv, fk = f"{e3}.f{i}", f"{e3}.k{i}"
        name = f"CASE WHEN {truthy(fv, fk)} THEN {item_text(fv, fk)} ELSE {name} END"
    st3 = (f"transform({st2}, {e3} -> named_struct('id', CASE WHEN {e3}.obj THEN "
           f"{variant_int(e3 + '.f0', e3 + '.k0')} END, 'name', {name}))")
    return f"filter({st3}, {s} -> {s}.id IS NOT NULL)"


# ------------------------------------------------------------------ F12 F14 F15 time
def epoch_to_ts(x: str) -> str:
    """epoch seconds → UTC wall-clock timestamp; ≤ 0 or NULL → NULL."""
    return (f"CASE WHEN {x} > 0 THEN TIMESTAMP_NTZ '1970-01-01 00:00:00' "
            f"+ make_dt_interval(0, 0, 0, CAST({x} AS DECIMAL(18, 6))) END")


def iso_date(ts: str) -> str:
    """F14 date part: ``YYYY-MM-DD``."""
    return f"date_format({ts}, 'yyyy-MM-dd')"


def iso_datetime(ts: str) -> str:
    """F14 ``isoformat()``: ``YYYY-MM-DDTHH:MM:SS`` plus ``.ffffff`` when non-zero."""
    whole = f"date_format({ts}, {q("yyyy-MM-dd'T'HH:mm:ss")})"
    frac = f"date_format({ts}, 'SSSSSS')"
    return f"CASE WHEN {ts} IS NULL THEN NULL WHEN {frac} = '000000' THEN {whole} ELSE concat({whole}, '.', {frac}) END"


def truncate_millis(ts: str) -> str:
    """cut to milliseconds (time-zone independent)."""
    return f"to_timestamp_ntz(date_format({ts}, 'yyyy-MM-dd HH:mm:ss.SSS'))"
