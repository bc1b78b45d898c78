"""Secret scans: assignments, access keys, long hex strings, and strings that pass for random.

Method: a battery of randomness tests. Each long token of a text is read in the smallest encoding that
holds all its characters (hex, letters, base32 and base36 of either case, letters and digits, base64) and tested for uniform use of the
alphabet (chi-squared), runs above and below its middle, and correlation of neighbours; Fisher's
method joins the three. A token that these do not reject, though it may be too short for them to
reject anything, must also be too unlikely for ordinary writing: the likelihood ratio of "uniform over
the encoding" against a model of words, numbers and identifiers is an e-value, which a longer token
can make large and a short one cannot. The e-values of a document's tokens go through the e-BH
procedure, which bounds the share of false discoveries whatever their dependence.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import add_columns, as_bytes

# Fixed patterns: kinds in the order of the report. A match that is too short is dropped after matching.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")

#: Shortest token the battery looks at, rejection level of the joined tests, share of false discoveries.
SHORTEST, REJECT, FALSE_SHARE = 20, 1e-4, 0.01
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
_SIGNS = ("+", "/", "_", "-")

_UP, _LOW, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", _DIGIT + "abcdef"), ("hex", _DIGIT + "ABCDEF"), ("letters", _LOW), ("letters", _UP),
    ("base32", _UP + "234567"), ("base32", _LOW + "234567"), ("base36", _DIGIT + _LOW), ("base36", _DIGIT + _UP),
    ("alnum", _UP + _LOW + _DIGIT), ("base64", _UP + _LOW + _DIGIT + "+/"), ("base64", _UP + _LOW + _DIGIT + "-_"),
    ("mixed", _UP + _LOW + _DIGIT + "+/-_"),
)
# Model of ordinary writing: chance of the next character's class, and of a character within its class:
# letters by how often English has them (per mille), a fifth of them being alike as in other tongues; digits and signs alike.
# Classes: lower, upper, digit, sign. Rows: class before (the last row: start of a token).
_NEXT = np.array([
    [0.93, 0.02, 0.01, 0.04],
    [0.15, 0.80, 0.02, 0.03],
    [0.04, 0.02, 0.84, 0.10],
    [0.50, 0.20, 0.20, 0.10],
    [0.70, 0.20, 0.08, 0.02],
])
_SIZE = np.array([26, 26, 10, 4])
_CLASS = np.full(128, 3, np.int64)
for _k, _letters in enumerate((_LOW, _UP, _DIGIT)):
    _CLASS[[ord(c) for c in _letters]] = _k
_OFTEN = np.array([82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.7])
_WITHIN = 1 / _SIZE[_CLASS]
for _letters in (_LOW, _UP):
    _WITHIN[[ord(c) for c in _letters]] = 0.8 * _OFTEN / _OFTEN.sum() + 0.2 / 26
_LOG_NEXT, _LOG_WITHIN = np.log(_NEXT), np.log(_WITHIN)
_PLACES = []
for _, _letters in ENCODINGS:
    _p = np.full(128, -1, np.int64)
    _p[[ord(c) for c in _letters]] = np.arange(len(_letters))
    _PLACES.append(_p)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(x: np.ndarray, k: int) -> float:
    """Chi-squared test over groups of neighbouring symbols, five expected in each (Wilson-Hilferty tail)."""
    groups = max(2, min(k, len(x) // 5))
    of = np.arange(k) * groups // k
    seen = np.bincount(of[x], minlength=groups)
    want = np.bincount(of, minlength=groups) * (len(x) / k)
    df = groups - 1
    stat = float(((seen - want) ** 2 / want).sum()) / df
    return _normal_tail((stat ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def runs(x: np.ndarray, k: int) -> float:
    high = x >= k / 2
    n, a = len(x), int(high.sum())
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    return min(1.0, 2 * _normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / spread))


def serial(x: np.ndarray) -> float:
    d = x - x.mean()
    total = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / total if total else 1.0
    return min(1.0, 2 * _normal_tail(abs(r) * math.sqrt(len(x))))


def battery(token: str) -> tuple[str, float, float]:
    """(encoding, joined p-value of being random in it, log e-value against ordinary writing)."""
    codes = np.frombuffer(token.encode("ascii"), np.uint8)
    which, x = next((i, p) for i, places in enumerate(_PLACES) if (p := places[codes]).min() >= 0)
    name, letters = ENCODINGS[which]
    k = len(letters)
    ps = [max(p, 1e-300) for p in (uniformity(x, k), runs(x, k), serial(x))]
    half = -sum(map(math.log, ps))
    joined = math.exp(-half) * (1 + half + half * half / 2)  # Fisher: chi-squared with six degrees, halved
    kinds = _CLASS[codes]
    text = float(_LOG_NEXT[np.concatenate(([4], kinds[:-1])), kinds].sum() + _LOG_WITHIN[codes].sum())
    return name, joined, -len(x) * math.log(k) - text


def _left(text: str, a: int, b: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the sorted spans ``base`` leave of [a, b), without a sign that sets it apart from them."""
    out, at = [], a
    for x, y in [s for s in base if s[0] < b and a < s[1]]:
        out.append((at, min(x, b)))
        at = max(at, y)
    out.append((at, b))
    trimmed = [(p + (p > a and text[p : p + 1] in _SIGNS), q - (q < b and text[q - 1 : q] in _SIGNS)) for p, q in out if p < q]
    return [(p, q) for p, q in trimmed if p < q]


def random_tokens(text: str, base: Iterable[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Spans of tokens that pass for random, false discoveries controlled over the text's tokens.

    Of a token that the sorted spans ``base`` touch, what they leave is tested too, and only that is given back.
    """
    base, at = list(base), 0
    tested: list[tuple[float, list[tuple[int, int]]]] = []

    def test(a: int, b: int, spans: list[tuple[int, int]]) -> None:
        _, p, log_e = battery(text[a:b].rstrip("="))
        tested.append((-math.inf if p < REJECT else log_e, spans))

    reach = list(accumulate((y for _, y in base), max))
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while at < len(base) and reach[at] <= a:
            at += 1
        touching = base[at : bisect_left(base, (b,), at)]
        if not any(x < b and a < y for x, y in touching):
            test(a, b, [(a, b)])
            continue
        left = _left(text, a, b, touching)
        if left:
            test(a, b, left)
        for p, q in left:
            if len(text[p:q].rstrip("=")) >= SHORTEST:
                test(p, q, [(p, q)])
    tested.sort(key=lambda t: -t[0])
    found = 0
    for k, (log_e, _) in enumerate(tested, 1):
        if log_e >= math.log(len(tested) / (k * FALSE_SHARE)):
            found = k
    return [*dict.fromkeys(s for _, spans in tested[:found] for s in spans)]


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind in the order of ``KINDS``."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted((a, b) for a, _, b in found)
    found += [(a, 3, b) for a, b in random_tokens(text, base)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def scan(df: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``df`` with ``out_col``: array of (kind, start, end), code points, end exclusive.

    Kinds ``assign``, ``access`` and ``hex`` are leftmost non-overlapping matches of their patterns;
    ``random`` are further tokens, or what is left of tokens that those touch, and overlap none of them. Null and empty texts have none. Texts are
    read whole, whatever their length; each row stands by itself, so repeated rows give repeated results. A column
    of ``df`` named ``out_col`` gives way.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        spans = (find_secrets(t.decode()) for t in as_bytes(batch.column(1)))
        return {out_col: pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in s] for s in spans], kind)}

    return add_columns(df, run, [text_col], f"`{out_col}` array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: Iterable[tuple[int, str, int]], mask: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by ``mask``."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with all secrets in ``text_col`` replaced by ``mask``, columns and their order kept; a null
    text stays null."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [None if t is None else masked(t, find_secrets(t), mask) for t in batch.column(1).to_pylist()]
        return {"redacted": pa.array(texts, pa.string())}

    named = [f"c{i}" for i in range(len(df.columns))]  # a table may have a column "redacted" of its own
    out = add_columns(df.toDF(*named), run, [named[df.columns.index(text_col)]], "redacted string")
    return out.select(*[F.col("redacted" if c == text_col else n).alias(c) for c, n in zip(df.columns, named)])
