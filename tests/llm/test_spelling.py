"""Spelling variants: against edits tried one by one."""

import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from tagloom.llm import spelling


def edits(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in letters} | {a + c + b[1:] for a, b in cut if b for c in letters}
    return out - {word}


def direct(words, times=5):
    """word -> (form, root, n, n_near, form_n) by the definition."""
    letters = {c for w in words for c in w}
    form, out = {}, {}
    for w in words:
        near = [x for x in edits(w, letters) if x in words]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = (best if best and words[best] >= times * words[w] else None, len(near))
    for w, (f, n_near) in form.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out[w] = (f, root, words[w], n_near, words[f] if f else None)
    return out


def table(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def some_words():
    rnd = random.Random(5)
    words = {}
    for _ in range(150):
        w = "".join(rnd.choice("abcé") for _ in range(rnd.randrange(6, 9)))
        words[w] = rnd.choice((5, 6, 30, 40, 900))
        for _ in range(3):
            w = rnd.choice(sorted(edits(w, "abcé")))
            if len(w) >= 6:
                words.setdefault(w, rnd.choice((5, 5, 30, 200)))
    return words


def test_variants_by_brute_force(spark):
    words = some_words()
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    assert table(spelling.variants(df).collect()) == direct(words)


def test_crowded_signatures_lose_no_pair(spark):
    words = {"".join(p): 5 for p in zip(*[iter("aabbccabcabcbacbaccabbac" * 6)] * 6)} | some_words()
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = {(r.a, r.b) for r in spelling.near_pairs(df, crowd=2).collect()}
    letters = {c for w in words for c in w}
    assert got == {(a, b) for a in words for b in edits(a, letters) if b in words and a < b}
    assert got == {(r.a, r.b) for r in spelling.near_pairs(df).collect()}


def test_chains_of_forms(spark):
    words = {"aaaaaa" + "b" * i: 5**i for i in range(1, 9)}
    got = table(spelling.variants(spark.createDataFrame(sorted(words.items()), "word string, n long")).collect())
    assert got == direct(words) and {r[1] for r in got.values()} == {"aaaaaa" + "b" * 8}


def test_occurrences_and_odd_rows(spark, odd, none):
    texts = [(i, f"Parlor ÀPARLOR parlör PARLOR-parlor x×÷y {'word' * i}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "sig", "id", "run", "h", "form")})

    def count(rows):
        seen = collections.Counter()
        for key, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
        return seen

    assert {r.word: r.n for r in spelling.occurrences(docs).collect()} == count(texts)
    want = {w: n for w, n in count([(r.doc_id, r.text) for r in odd.collect()]).items() if len(w) >= 6 and n >= 5}
    assert table(spelling.spelling_variants(odd).collect()) == direct(want)
    assert table(spelling.spelling_variants(docs).collect()) == direct({w: n for w, n in count(texts).items() if len(w) >= 6 and n >= 5})
    assert spelling.spelling_variants(none).count() == 0


def test_no_python_in_the_plan(spark, odd):
    plan = spelling.near_pairs(spelling.occurrences(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
