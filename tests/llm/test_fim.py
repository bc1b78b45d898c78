"""Fill-in-middle: against a direct rewriting of each text, whatever the pieces."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tagloom.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def direct(key, text):
    """(n, form, prefix, middle, output) by the definition."""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("most", (1, 7, 4096))
def test_cut_and_restore_in_any_pieces(most):
    rnd = random.Random(3)
    letters = ["a", "Bc", " ", "\n", "é", "漢", "🙂", "<", ">", "P", "xyz" * 9]
    for i in range(300):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))
        (n, form, pre, mid), out = fim.cut(str(i), text.encode(), most=most)
        assert (n, form, pre, mid, b"".join(out).decode()) == direct(i, text)
        whole = b"".join(out)
        back, parts, at = fim.Restorer(form), [], 0
        while at < len(whole):  # cut otherwise than it was made, also through sentinels
            step = rnd.randrange(1, 6)
            parts += back.feed(whole[at : at + step])
            at += step
        parts += back.feed(b"", last=True)
        assert b"".join(d for _, d in sorted(parts)).decode() == text


def test_missing_sentinels_are_errors():
    for form, out in (("psm", b"<P>a<S>b"), ("psm", b"a<P><S><M>"), ("spm", b"")):
        back = fim.Restorer(form)
        with pytest.raises(ValueError):
            list(back.feed(out)) + list(back.feed(b"", last=True))


def test_odd_rows(odd, none):
    clashing = odd.withColumns({c: F.lit("own") for c in ("row", "at", "chunk", "form", "n_units", "output_sha256", "id", "kept")})
    pieces = fim.transform(clashing)
    got = [r.asDict(True) for r in fim.digests(fim.restore(pieces)).collect()]
    assert len(got) == 8 and all(r["kept"]["form"] == r["kept"]["kept"] == "own" for r in got)
    want = []
    for r in odd.collect():
        n, form, pre, mid, out = direct("" if r.doc_id is None else r.doc_id, r.text or "")
        want.append((str(r.doc_id), n, form, pre, mid, len(out.encode()), sha(out), sha(r.text or "")))
    keys = ("n_units", "form", "prefix_chars", "middle_chars", "output_bytes", "output_sha256", "restored_sha256")
    assert sorted(map(repr, want)) == sorted(repr((str(r["kept"]["doc_id"]), *[r[k] for k in keys])) for r in got)
    whole = {sha(r.output) for r in fim.texts(pieces).collect()}
    assert whole == {w[-2] for w in want}
    assert fim.digests(fim.restore(fim.transform(none))).count() == 0
    assert fim.digests(fim.restore(fim.transform(odd, keep=[]))).count() == 8


def test_pieces_are_small_and_moved_once(spark, odd):
    pieces = fim.transform(odd)
    assert pieces.agg(F.max(F.length("chunk"))).first()[0] <= fim.PIECE + 3
    plan = fim.digests(fim.restore(pieces))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
