"""Removal of repeated passages: against a table of all strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import repeats


def direct(rows, length):
    """[(n_bytes, removed spans, kept)] by the definition; a null id is larger than all others."""
    order = lambda i: (i is None, i or 0)
    first = {}
    texts = [(order(i), (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p + 1 : p + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((len(t), spans, bytes(c for c, g in zip(t, gone[1:]) if not g)))
    return out


def result(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, [(s["start"], s["end"]) for s in r.removed], bytes(r.kept)) for r in df.collect()]


def expected(rows, length):
    return [(i, n, sum(b - a for a, b in spans), spans, kept) for (i, _), (n, spans, kept) in zip(rows, direct(rows, length))]


def check(spark, rows, length, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted(map(repr, result(repeats.remove_repeats(df, length=length)))) == sorted(map(repr, expected(rows, length)))


def mixture(seed, docs, letters):
    """Texts of copied stretches of each other, some with changed characters, and of few letters."""
    rnd = random.Random(seed)
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rnd.randrange(6)):
            if rows and rnd.random() < 0.6:
                t = rnd.choice(rows)[1] or ""
                a = rnd.randrange(len(t) + 1)
                t = t[a : a + rnd.randrange(150)]
                if t and rnd.random() < 0.4:
                    k = rnd.randrange(len(t))
                    t = t[:k] + rnd.choice(letters) + t[k + 1 :]
            else:
                t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(120)))
            parts.append(t)
        rows.append((rnd.randrange(docs), "".join(parts)))
    return rows


@pytest.mark.parametrize("length, letters", [(50, "abcdé "), (50, "ab"), (7, "abc"), (2, "abcdefgh")])
def test_by_brute_force(spark, length, letters):
    check(spark, mixture(length, 120, letters), length)


def test_small_stretches_and_flushes(spark, monkeypatch):
    """Long texts cut anywhere, rows sent early, and anchors busy at once."""
    kept = {}
    for name, value in (("STRETCH", 64), ("FLUSH", 500), ("BUSY", 1)):
        kept[name] = getattr(repeats, name)
        monkeypatch.setattr(repeats, name, value)
    docs = mixture(9, 60, "abc ")
    texts = [(i, t.encode()) for i, t in docs]
    rows = []
    for part in range(3):  # as map tasks would, without Spark: workers don't see patched values
        for i, t in texts[part::3]:
            for at in range(0, max(0, len(t) - 49), 64):
                b = np.frombuffer(t[at : at + 64 + 49], np.uint8)
                key, run, start, stop = repeats.runs(b, np.arange(len(b), 0, -1), 50)
                rows.append((key, run, np.full(len(key), i, np.int64), repeats._place(i, start + at, stop - start - 49)))
        sent = repeats.condense(*map(np.concatenate, zip(*rows)), by_run=False)
        rows = rows[:0]
        kept.setdefault("sent", []).append(sent)
    key, run, doc, place, kind = map(np.concatenate, zip(*kept["sent"]))
    o = np.lexsort((place, doc, run, kind, key))
    key, run, doc, place, kind = (x[o] for x in (key, run, doc, place, kind))
    found, is_open = repeats.settle(key, run, doc, place, kind)
    want = {}
    for (i, t), (_, spans, _) in zip(docs, direct(docs, 50)):
        want.setdefault(i, []).append((t, spans))
    covered = {}
    for f, o in zip(found, is_open):
        a = int(place[f] >> 8 & 0x7FFFFFFF)
        covered.setdefault((int(doc[f]), bool(o)), []).append((a, a + int(place[f] & 255) + 50))
    for i, versions in want.items():
        if len(versions) > 1:
            continue
        inside = lambda x, y, spans: any(a <= x and y <= b for a, b in spans)
        assert all(inside(x, y, versions[0][1]) for x, y in covered.get((i, False), []))
        both = covered.get((i, False), []) + covered.get((i, True), [])
        either = repeats._union(*zip(*both)) if both else []
        assert all(inside(a, b, either) for a, b in versions[0][1])


def test_hot_passages(spark):
    """A passage in every document, in other surroundings each time, and large groups of copies."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    line = "this very common line of sixty bytes stands in every document"
    rows = [(i, f"{word()} {word()} {line} {word()} {word()}") for i in range(400)] + [(1000 + i, "the same text in many documents, " * 4) for i in range(200)]
    check(spark, rows, 50, parts=9)


def test_odd_rows(spark, odd, none):
    clashing = odd.withColumns({c: F.lit(7) for c in ("doc", "tag", "key", "run", "place", "kind", "spans", "start", "stop", "open", "removed", "kept", "n_bytes")})
    got = repeats.remove_repeats(clashing)
    assert {"doc", "tag", "kept", "removed", "lang", "n_chars"} <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(repr, result(got))) == sorted(map(repr, expected(rows, 50)))
    assert repeats.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(odd, length=1)


def test_rows_are_few(spark):
    """About a row for 17 bytes, and sorting on pairs in one exchange for each offset."""
    rnd = np.random.default_rng(1)
    b = rnd.integers(97, 123, 200_000).astype(np.uint8)
    key, _, start, stop = repeats.runs(b, np.arange(len(b), 0, -1), 50)
    assert len(key) < len(b) / 15 and stop.max() == len(b) and start.min() == 0
    assert (start[1:] == stop[:-1] - 49).all()
