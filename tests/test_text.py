"""Masking, tokenising, quoting, hashing."""

import hashlib
import random
import re
from urllib.parse import quote as py_quote, unquote as py_unquote

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import tokens as TK


def mask(spark, text, word=X.WORD):
    return spark.createDataFrame([(text,)], "t string").select(X.mask_noncode(F.col("t"), word)).first()[0]


def words(blobs, path, content, **kw):
    got = TK.tokenize(blobs(path, content), **kw).orderBy("line").collect()
    return [(r.line, r.token) for r in got]


def test_mask_keeps_length_and_lines(spark):
    text = 'a /* x\ny */ b // c\n "s\\"t" d #include <e.h>\nf \'"\' g "h" i'
    got = mask(spark, text)
    assert len(got) == len(text) and got.count("\n") == text.count("\n")
    assert got.split() == ["a", "b", "d", "f", "'\"'", "g", "i"]


def test_quote_after_word_opens_no_string(spark):
    assert mask(spark, ' KERN"x" y').split() == ['KERN"x"', "y"]
    assert mask(spark, ' L"x" y').split() == ["y"]


def test_mask_survives_long_pieces(spark):
    text = " a /*" + "c" * 200_000 + '*/ b "' + "s" * 200_000 + '" ' + " " * 100_000 + "c \n"
    got = mask(spark, text)
    assert len(got) == len(text) and got.split() == ["a", "b", "c"]


def test_unterminated_pieces_are_code(spark):
    assert mask(spark, " a /* b").split() == ["a", "/*", "b"]
    assert mask(spark, ' a "b').split() == ["a", '"b']


def test_edge_words_are_no_tokens(blobs):
    assert words(blobs, "a.c", "one two\nthree") == [(1, "two")]
    assert words(blobs, "a.c", "one two\nthree\n") == [(1, "two"), (2, "three")]
    assert words(blobs, "a.c", "one two\nthree", edge_tokens="keep") == [(1, "one"), (1, "two"), (2, "three")]


def test_hyphens_belong_to_devicetree_words(blobs):
    assert words(blobs, "a.dts", " foo-bar baz;\n") == [(1, "foo-bar"), (1, "baz")]
    assert words(blobs, "a.c", " foo-bar;\n") == [(1, "foo"), (1, "bar")]


def test_ascii_words_only(blobs):
    assert words(blobs, "a.c", " cafés x\n") == [(1, "caf"), (1, "s"), (1, "x")]


def test_line_numbers_after_block_comment(blobs):
    assert words(blobs, "a.c", "\n/* a\nb\n*/ c\n d\n") == [(4, "c"), (5, "d")]


def test_spans(blobs):
    got = TK.token_spans(blobs("a.c", "int ab; /* x */ cd = ab;\n ef")).orderBy("line", "start").collect()
    assert [(r.line, r.start, r.end, r.token) for r in got] == [(1, 4, 6, "ab"), (1, 16, 18, "cd"), (1, 21, 23, "ab")]


def test_blob_hash(spark):
    data = "héllo\n"
    raw = data.encode()
    want = hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()
    assert spark.createDataFrame([(data,)], "t string").select(X.blob_hash(F.col("t"))).first()[0] == want


def test_decode(spark):
    rows = [(b"caf\xc3\xa9",), (b"caf\xe9",)]
    got = spark.createDataFrame(rows, "b binary").select(X.decode_text(F.col("b"))).collect()
    assert [r[0] for r in got] == ["café", "café"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=30), min_size=20, max_size=40))
def test_quote_is_pythons(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.quote(F.col("t")).alias("q"), X.unquote(X.quote(F.col("t"))).alias("u")).collect()
    assert all(r.q == py_quote(r.t) and r.u == py_unquote(r.q) for r in got)


def test_unquote_leaves_plus_and_broken_codes(spark):
    df = spark.createDataFrame([("a+b",), ("100%",)], "t string")
    assert [r[0] for r in df.select(X.unquote(F.col("t"))).collect()] == ["a+b", "100%"]


def test_line_lists(spark):
    df = spark.createDataFrame([([64, 64, 71],)], "l array<int>")
    got = df.select(X.line_list_text(F.col("l")).alias("t")).select("t", X.parse_line_list(F.col("t")).alias("l"))
    assert got.first() == ("64,64,71", [64, 64, 71])


def test_validation(spark):
    df = spark.createDataFrame([("ok_1.2",), ("no space",), (None,)], "t string")
    got = [r[0] for r in df.select(X.valid_version(F.col("t"))).collect()]
    assert got == [True, False, False]


def test_spans_of_short_and_long_lines(spark):
    rnd, rows = random.Random(6), []
    for n in (0, 1, 2, TK.LONG_LINE - 1, TK.LONG_LINE, TK.LONG_LINE + 1, 3 * TK.LONG_LINE):
        line = lambda: "".join(rnd.choice(["w%d" % k, "a-b", "-", "é", "日"]) + rnd.choice([" ", "  ", "(", "-+", "\t"]) for k in range(n))
        for family in "CD":
            rows.append((f"{family}{n}", family, line() + "\n" + rnd.choice(["", " ", "+"]) + line() + "\n" + line().strip()))
    df = spark.createDataFrame([("p", *r) for r in rows], "project string, blob_id string, family string, content string")
    got = sorted((r.blob_id, r.line, r.start, r.end, r.token) for r in TK.token_spans(df).collect())
    want = []
    for blob, family, text in rows:
        lines = text.split("\n")
        for i, line in enumerate(lines):
            for m in re.finditer("[A-Za-z0-9_-]+" if family == "D" else "[A-Za-z0-9_]+", line):
                if (i or m.start()) and (i < len(lines) - 1 or m.end() < len(line)):
                    want.append((blob, i + 1, m.start(), m.end(), m[0]))
    assert got == sorted(want)


def test_spans_do_not_sum_lengths_on_short_lines(blobs, capsys):
    """A nested sum over the parts of every line was most of the time; it is left to long lines."""
    TK.token_spans(blobs("a.c", "\nint a;\n")).explain(True)
    plan = capsys.readouterr().out
    assert re.search(r"size\(_words#\d+[^)]*\) > 64", plan) and "zip_with(_parts" not in plan


def test_blank_keeps_lengths_of_any_text(spark):
    texts = ["", "\n", "a\n\n\u00e9\U0001f600b", "no newline \U0001f600", "\r\n\t\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.blank(F.col("t"))).collect()
    assert [r[0] for r in got] == [re.sub(r"[^\n]", " ", t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab_9- \n\"'/*#\\<>include\u00e9\U0001f600", max_size=40), min_size=150, max_size=150))
def test_mask_cuts_as_single_characters_do(spark, texts):
    """The pieces are those of the pattern that takes ordinary characters one by one and steps through comments."""
    def plain(word):
        return (
            r"/\*[\s\S]*?\*/" r"|//[^\n]*\n" r"""|[^']"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+\"""" r"|# *include *<[^>]*>"
            rf"""|(?:[{word}][{word}]++|[{word}](?!")|'|[^{word}"/#'](?!"))++""" r"|[\s\S]"
        )

    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for ranges, word in (("A-Za-z0-9_", X.WORD), (r"A-Za-z0-9_\-", X.DTS_WORD)):
        pieces = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
        assert df.where(~pieces(plain(ranges)).eqNullSafe(pieces(X._pieces(word)))).count() == 0


def test_names_of_blobs_cross_the_network_as_bytes(spark):
    names = ["0f" * 20, "AB" * 20, "b1", "", None, "é", "0f" * 19, "ab" * 20 + "\n", "\0" * 20]
    packed = X.pack_id(F.col("t"))
    got = spark.createDataFrame([(t,) for t in names], "t string").select("t", packed.alias("p"), X.unpack_id(packed).alias("back")).collect()
    assert all(r.t == r.back for r in got) and len({bytes(r.p) for r in got if r.p is not None}) == len(names) - 1
    assert len(got[0].p) == 20
