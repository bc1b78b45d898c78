"""Chat formatting of conversations, by Spark expressions only.

Method: the turns of a conversation are collected as structs and sorted; array functions merge adjacent
turns of the same role into one block and join everything into one string. Every step looks at a
turn's neighbours by position, so the work is linear in the length of a conversation.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>\\n`` for each block; inside a block the texts of
its turns are parted by ``<|im_turn|>``. Within roles and texts a backslash is doubled and ``<|``
becomes ``<\\|``, so no text can contain a control string, and reading back gives every turn as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>\n"
#: Roles whose texts are under the loss mask.
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Every backslash begins a pair; the pair stands for its second character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    learned: tuple[str, ...] = LEARNED,
) -> DataFrame:
    """A row per conversation: (conv_id, formatted, loss_spans), spans as (start, length) in code points
    of ``formatted``, one for each learned turn's text, ascending.

    Turns are ordered by number, then role, then text; null numbers come first, and repeated rows are
    turns of their own. Null roles and texts are empty. Rows with a null conversation id form one
    conversation. A conversation is one string, so it must fit in memory; nothing else is gathered.
    """
    col = lambda c: F.col(f"`{c}`")
    one = F.struct(col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))

    def piece(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.get(F.col("t"), i - 1)["role"] != t["role"])
        last = F.coalesce(F.get(F.col("t"), i + 1)["role"] != t["role"], F.lit(True))
        return F.struct(
            F.when(first, F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))).otherwise(F.lit(TURN)).alias("before"),
            escape(t["text"]).alias("text"),
            F.when(last, F.lit(END)).otherwise(F.lit("")).alias("after"),
            t["role"].isin(*learned).alias("learned"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("t", piece).alias("p"))
    whole = pieces.select(
        "conv_id",
        F.array_join(F.transform("p", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.transform("p", lambda p: F.struct(F.length(p["before"]).alias("b"), F.length(p["text"]).alias("l"), F.length(p["after"]).alias("a"), p["learned"].alias("learned"))).alias("p"),
    )
    ends = _running(F.col("p"), lambda p: p["b"] + p["l"] + p["a"])
    spans = F.filter(
        F.zip_with("p", ends, lambda p, e: F.struct((e - p["a"] - p["l"]).alias("start"), p["l"].alias("length"), p["learned"].alias("learned"))),
        lambda s: s["learned"],
    )
    return whole.select("conv_id", "formatted", F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("loss_spans"))


def _running(items: Column, size, chunk: int = 128) -> Column:
    """Running sums of ``size`` over an array: sums of whole chunks first, then within each chunk."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + size(x))
    places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(places(F.ceil(F.size(items) / chunk).cast("int")), lambda k: F.slice(items, k * chunk + 1, F.lit(chunk)))
    ahead = lambda sums: F.transform(sums, lambda _, k: F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda acc, x: acc + x))
    within = lambda part, base: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i + 1)))
    return _let(chunks, lambda c: F.flatten(F.zip_with(c, _let(F.transform(c, total), ahead), within)))


def _let(value: Column, use) -> Column:
    """``use(value)``, the value worked out once for a row however often ``use`` names it, within other lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def read_turns(formatted: Column) -> Column:
    """The turns, (role, text) in order, of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    parted = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(len(START) + 1), F.length(b)), r"<\|im_sep\|>"))
    return F.flatten(F.transform(
        parted,
        lambda b: F.transform(F.split(b[1], r"<\|im_turn\|>"), lambda text: F.struct(unescape(b[0]).alias("role"), unescape(text).alias("text"))),
    ))


def read_spans(formatted: Column, spans: Column) -> Column:
    """The unescaped text under each span."""
    # 4 bytes a code point: a span is cut out without counting from the start
    cut = lambda wide: F.transform(
        spans, lambda s: unescape(F.decode(F.substring(wide, s["start"] * 4 + 1, s["length"] * 4), "UTF-32"))
    )
    return _let(F.encode(formatted, "UTF-32"), cut)
