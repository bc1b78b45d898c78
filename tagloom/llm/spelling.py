"""Spelling variants: words one inserted, deleted or replaced code point apart, and the form they follow.

Method: PartEnum. A word's multiset of code points is a binary vector: a dimension for each (code point, how many-th of its
kind). One edit changes at most two dimensions. Dimensions are dealt to ``PARTS`` parts by hash; two vectors that differ in
two dimensions at most agree on all parts but two, so for each choice of two parts left out the rest is an exact
signature, and near words share at least one. Signatures are equi-joined and pairs verified by edit distance. All is
built-in expressions.

Signatures that very many words share (anagrams, words of few different letters) don't pair all their words: there the
key also holds a half of the word. An edit leaves the front or the back half alone, so every near pair still meets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a run of letters is; shortest word, fewest occurrences; a form has so many times the word's occurrences.
LETTERS = "[A-Za-zÀ-ÿ]+"
SHORTEST, FEWEST, TIMES = 6, 5, 5
#: Of so many (document, run) pairs one loses a code point.
DROP_ONE_IN = 199

#: Parts of the dimensions; two are left out of each signature.
PARTS = 6
#: Words of a signature from which halves of the words join the key.
CROWD = 200


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, n) of all runs of letters of whole texts, lower-cased in A-Z, some robbed of a code point.

    Which run loses which code point follows from the CRC-32 of ``<id>:<run>``. Null texts have no runs, a null id is written as nothing;
    repeated rows count again. Counts are summed in the map tasks first, so a frequent word is a row per task.
    """
    runs = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    robbed = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % drop_one_in == 0, robbed).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _dimensions(word: Column) -> Column:
    """The multiset of a word's code points as an ordered array of (part, dimension)."""
    letters = F.array_sort(F.split(word, ""))
    kind = lambda c, i: F.concat(c, (i + 1 - F.array_position(letters, c)).cast("string"))
    dims = F.transform(letters, kind)
    return F.transform(dims, lambda d: F.struct(F.pmod(F.xxhash64(d), F.lit(PARTS)).alias("part"), d.alias("dim")))


def _signature(dims: Column, out: tuple[int, ...]) -> Column:
    rest = F.filter(dims, lambda d: ~d["part"].isin(*out))
    return F.xxhash64(F.lit(repr(out)), F.array_join(F.transform(rest, lambda d: d["dim"]), " "))


def signatures(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with a row for each signature ``sig``."""
    dims = words.withColumn("dims", _dimensions(F.col("word")))
    chosen = F.array(*[_signature(F.col("dims"), out) for out in combinations(range(PARTS), 2)])
    return dims.select("word", "n", F.explode(chosen).alias("sig"))


def _halves(word: Column) -> Column:
    """Keys of which two words one edit apart share at least one: the front half or the back half of the shorter one."""
    size = F.length(word)
    ends = lambda k: [F.concat(F.lit("<"), word.substr(F.lit(1), k)), F.concat(F.lit(">"), word.substr(size - k + 1, size))]
    half, less = (size / 2).cast("int"), ((size - 1) / 2).cast("int")
    return F.array_distinct(F.array(*ends(half), *ends(less)))


def _meet(keyed: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of words with equal ``key`` that are one edit apart, the one first in order as ``a``."""
    a = keyed.select(*key, F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = keyed.select(*key, F.col("word").alias("b"), F.col("n").alias("n_b"))
    one = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    return a.join(b, key).where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & one).drop(*key)


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of ``words`` (word, n; words distinct) exactly one edit apart."""
    signed = stored(signatures(words), "spelling-signatures")
    sizes = signed.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    shared = signed.join(sizes, "sig")
    few = _meet(shared.where(F.col("size") <= crowd), ["sig"])
    many = _meet(shared.where(F.col("size") > crowd).withColumn("half", F.explode(_halves(F.col("word")))), ["sig", "half"])
    return few.union(many).distinct()


def variants(words: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of each of ``words`` (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is at least
    ``times`` its own, else null. Roots follow forms to the last word; forms gain ``times`` at each step, so chains are
    short, and each round doubles how far a root looks. Without words there are no rows.
    """
    words = stored(words.select("word", "n"), "spelling-words")
    pairs = stored(near_pairs(words, crowd), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("top"))
    follows = -F.col("top.less") >= times * F.col("n")
    found = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(follows, F.col("top.near")).alias("form"), F.when(follows, -F.col("top.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    up = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = stored(up.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if up.where("moved").isEmpty():
            break
        up = up.select("word", "root")
    roots = up.select("word", "root")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, drop_one_in: int = DROP_ONE_IN
) -> DataFrame:
    """``variants`` of the words of ``docs`` with ``shortest`` code points and ``fewest`` occurrences or more. Other columns are not read."""
    words = occurrences(docs, id_col, text_col, drop_one_in).where((F.length("word") >= shortest) & (F.col("n") >= fewest))
    return variants(words)
