"""Removal of passages that also start in a document before, by distributed prefix doubling.

Method: names take the place of ranks. A text's strings of 1, 2, 4, ... bytes are named by pairs of names of half their length, at
growing offsets; Spark sorts (name pair, document, place) rows and reranks them: a pair's first document settles
all other places, pairs that stand alone go, and what is still open goes on to the next offset, until all are settled at ``length`` bytes.

So that a byte is not a row, only places chosen by content are sorted at first. Every string of ``length`` bytes has an anchor: the one of its
18-byte strings (``length`` 50) with the smallest name, the first of them if several. Neighbouring strings mostly share their
anchor, and such a run of strings is one row, with the pair (name of the anchor, name of the whole run); there is a row for about 17 bytes.

1. Runs equal to a run in an earlier document are settled whole. A run alone with its anchor has no equal strings elsewhere and goes.
   Others stay open: their anchor is known elsewhere in other surroundings, so some of their strings may be.
2. Open runs fall into two sides, by the half of their surroundings that all strings of a side hold (16 bytes before or after the
   anchor). Sides whose 34 bytes no other document has go.
3. The strings of the sides left are ranked one by one, by the pair (first 32 bytes, last 32 bytes).
4. Settled places, as spans by document, are taken out of the texts.

Skew: map tasks settle what they can among their own rows and send one document's rows for each pair, and rows of anchors in very many
surroundings are dealt by run instead of anchor, so that no group exceeds a few rows for each stretch of texts read.
Names have 64 bits, pairs 128; equal pairs are taken for equal strings.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.llm.common import _parts, as_bytes, give_back, stored

LENGTH = 50
#: Bytes named at once, and bytes of text whose rows a map task compares before it sends them.
STRETCH, FLUSH = 1 << 17, 12 << 20
#: Surroundings of an anchor, among the rows of one flush, from which its rows are dealt by run.
BUSY = 16
#: Kinds of rows: asks by anchor, asks by run, tells that an anchor is busy, settled already.
ASK, ASK_RUN, TELL, SETTLED = range(4)

_NULL_ID = np.iinfo(np.int64).max
_TAGS = 1 << 24
_ROWS = "key long, run long, doc long, place long, kind int"
_SPANS = "doc long, tag int, start long, stop long, open boolean"


def anchor_length(length: int) -> int:
    return max((length + 4) // 3, length - 255)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    return _mix(a * np.uint64(0xD6E8FEB86659FD93) + _mix(b + np.uint64(0x632BE59BD9B4E019)))


class Names:
    """Names of all strings of a length in a buffer, by doubling; level: the longest power of two that fits ``length``."""

    def __init__(self, buffer: np.ndarray, length: int) -> None:
        self.levels = {1: _mix(buffer.astype(np.uint64) + np.uint64(0xA0761D6478BD642F))}
        self.level = 1
        while self.level * 2 <= length:
            h = self.levels[self.level]
            self.levels[self.level * 2] = pair(h[: -self.level], h[self.level :]) if len(h) > self.level else h[:0]
            self.level *= 2

    def of(self, length: int) -> np.ndarray:
        size = max(s for s in self.levels if s <= length)
        h, by = self.levels[size], length - size
        return h if not by else pair(h[:-by], h[by:]) if len(h) > by else h[:0]

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Names of strings of one to four times the level."""
        h, free = self.levels[self.level], stop - start - self.level
        out = h[start] + (stop - start).astype(np.uint64)
        for j in (1, 2, 3):
            out = pair(out, h[start + free * j // 3])
        return out


def anchors(names: Names, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(names of all anchor-long strings, place of the anchor of each string of ``length`` bytes); buffers of up to 2 MB."""
    k = anchor_length(length)
    name = names.of(k)
    low_bits = np.uint64((1 << 21) - 1)
    low = (name & ~low_bits) | np.arange(len(name), dtype=np.uint64)  # 43 bits, then the first place
    width = 1
    while width * 2 <= length - k + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if by := length - k + 1 - width:
        low = np.minimum(low[:-by], low[by:])
    return name, (low & low_bits).astype(np.int64)


def runs(buffer: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor name, run name, start, stop) of all runs of strings of ``length`` bytes; ``left``: bytes from each place to its text's end."""
    whole = np.flatnonzero(left >= length)
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    names = Names(buffer, length)
    name, at = anchors(names, length)
    at = at[whole]
    first = np.ones(len(whole), bool)
    first[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)
    last = np.ones(len(whole), bool)
    last[:-1] = first[1:]
    start, stop = whole[first], whole[last] + length
    return name[at[first]], names.spans(start, stop), start, stop


def sides(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(which run, name, start, stop) of the sides of runs that lie in a buffer."""
    k = anchor_length(length)
    half = (length - k) // 2
    names = Names(buffer, length)
    at = anchors(names, length)[1][start]
    name = names.of(k + half)
    last = stop - length
    before, after = np.flatnonzero(start <= at - half), np.flatnonzero(last > at - half)
    which = np.concatenate((before, after))
    starts = np.concatenate((start[before], np.maximum(start, at - half + 1)[after]))
    ends = np.concatenate((np.minimum(last, at - half)[before], last[after])) + length
    return which, np.concatenate((name[(at - half)[before]], ~name[at[after]])), starts, ends


def strings(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(which run, first and second name, start) of the single strings of runs that lie in a buffer."""
    names = Names(buffer, length)
    h = names.levels[names.level]
    n = stop - start - length + 1
    which = np.repeat(np.arange(len(start)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[which]
    return which, h[at], h[at + length - names.level], at


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys changes."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = False
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    return first


def condense(key: np.ndarray, run: np.ndarray, doc: np.ndarray, place: np.ndarray, by_run: bool) -> tuple[np.ndarray, ...]:
    """What a map task sends of its rows: places with an earlier document among them are settled already."""
    o = np.argsort(key)
    key, run, doc, place = key[o], run[o], doc[o], place[o]
    group = _groups(key)
    alone = group.copy()
    alone[:-1] &= group[1:]
    some = np.flatnonzero(~alone)  # few keys have several rows
    o = some[np.lexsort((place[some], doc[some], run[some], key[some]))]
    run[some], doc[some], place[some] = run[o], doc[o], place[o]
    first = _groups(key, run)
    lowest = doc[first][np.cumsum(first) - 1]
    settled = doc > lowest
    kind = np.where(settled, SETTLED, ASK_RUN if by_run else ASK).astype(np.int32)
    told = key[:0]
    if not by_run and len(key):
        starts = np.flatnonzero(group)
        busy = (np.add.reduceat(first.astype(np.int64), starts) > BUSY) & (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))
        told = key[starts[busy]]
        many = (kind == ASK) & busy[np.cumsum(group) - 1]
        kind[many] = ASK_RUN
        key[many] = pair(key[many], run[many])
    key[settled], run[settled] = doc[settled].view(np.uint64), 0
    zeros = np.zeros(len(told), np.int64)
    return (
        np.concatenate((key, told)), np.concatenate((run, zeros.astype(np.uint64))), np.concatenate((doc, zeros)),
        np.concatenate((place, zeros)), np.concatenate((kind, np.full(len(told), TELL, np.int32))),
    )


def settle(key: np.ndarray, run: np.ndarray, doc: np.ndarray, place: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a result, whether it is open) for whole groups of rows sorted by (key, kind, run, doc)."""
    asks = kind < TELL
    group, first = _groups(key), _groups(key, kind, run)
    starts, g = np.flatnonzero(group), np.cumsum(group) - 1
    lowest = doc[first][np.cumsum(first) - 1]
    gone = (kind == SETTLED) | asks & (doc > lowest)
    least = np.minimum.reduceat(np.where(asks, doc, _NULL_ID), starts)
    most = np.maximum.reduceat(np.where(asks, doc, np.iinfo(np.int64).min), starts)
    told = np.maximum.reduceat((kind == TELL).astype(np.int8), starts) > 0
    rivals = told | (np.add.reduceat((first & asks).astype(np.int64), starts) > 1) & (least < most)
    open_ = asks & ~gone & ((kind == ASK_RUN) | rivals[g])
    found = np.flatnonzero(gone | open_)
    return found, open_[found]


def _batches(columns: tuple[np.ndarray, ...], names: list[str], step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), step):
        part = [c[i : i + step] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64) if p.dtype == np.uint64 else p) for p in part], names=names)


def _place(tag: int, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 8 | (windows - 1)) + (tag << 39)


def _ranked(rows: DataFrame, length: int, tag: str) -> DataFrame:
    """Rows of ``condense`` sorted and reranked: (doc, tag, start, stop, open), stored."""
    schema = StructType.fromDDL(_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.int32)]

        def made(upto: int) -> Iterator[pa.RecordBatch]:
            rows = [h[:upto] for h in held]
            if not upto:
                return
            found, open_ = settle(rows[0], rows[1], rows[2], rows[3], rows[4])
            doc, place = rows[2][found], rows[3][found]
            start, windows = (place >> 8) & 0x7FFFFFFF, (place & 0xFF) + 1
            yield from _batches((doc, (place >> 39).astype(np.int32), start, start + windows - 1 + length, open_), schema.fieldNames())

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            held = [np.concatenate(x) for x in zip(held, new)]
            ends = np.flatnonzero(held[0][1:] != held[0][:-1])
            if len(held[0]) >= 1 << 16 and len(ends):
                upto = int(ends[-1]) + 1
                yield from made(upto)
                held = [h[upto:].copy() for h in held]
        yield from made(len(held[0]))
        give_back()

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "kind", "run", "doc", "place")
    return stored(sorted_rows.mapInArrow(run, schema), tag)


def _texts(docs: DataFrame, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """(id, tag, text) and, as struct, all columns; ``tag`` tells rows with equal ids and different texts apart."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    all_of = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(True).alias("none")]).alias("kept")] if rest else []
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(_NULL_ID))).alias("doc"), F.pmod(F.hash(text), F.lit(_TAGS)).alias("tag"),
        (F.col(f"`{text_col}`").cast("string") if rest else text).alias("text"), *all_of,
    )


def _first_rows(texts: DataFrame, length: int) -> DataFrame:
    """Rows of all runs of all texts."""
    schema = StructType.fromDDL(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        size = 0
        buffers: list[np.ndarray] = []
        owners: list[tuple[int, int, int]] = []  # (doc, tag, place of the buffer's first byte)
        waiting = 0

        def name() -> None:
            nonlocal waiting, size
            if not waiting:
                return
            lengths = np.array([len(b) for b in buffers])
            ends = np.cumsum(lengths)
            left = np.repeat(ends, lengths) - np.arange(ends[-1])
            key, run_, start, stop = runs(np.concatenate(buffers), left, length)
            own = np.searchsorted(ends, start, "right")
            doc, tag, base = (np.array(x, np.int64) for x in zip(*owners))
            at = start - (ends - lengths)[own] + base[own]
            found.append((key, run_, doc[own], _place(0, at, stop - start - length + 1) + (tag[own] << 39)))
            size += waiting
            waiting = 0
            buffers.clear()
            owners.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            name()
            if found:
                rows = [np.concatenate(x) for x in zip(*found)]
                found.clear()
                yield from _batches(condense(*rows, by_run=False), schema.fieldNames())
            size = 0

        for batch in _parts(batches):
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                if len(text) < length:
                    continue
                b = np.frombuffer(text, np.uint8)
                for at in range(0, len(b) - length + 1, STRETCH):
                    part = b[at : at + STRETCH + length - 1]
                    if waiting + len(part) > STRETCH + length - 1:
                        name()
                    buffers.append(part)
                    owners.append((doc, tag, at))
                    waiting += len(part)
                    if size >= FLUSH:
                        yield from flush()
        yield from flush()
        give_back()

    return texts.mapInArrow(run, schema)


def _sides(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    which, name, x, y = sides(buffer, start, stop, length)
    return which, name, doc[which].astype(np.uint64), x, y - x - length + 1  # documents stand for runs: a side that two have stays open


def _strings(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    which, a, b, x = strings(buffer, start, stop, length)
    return which, a + b * np.uint64(0xE7037ED1A0B428DB), b, x, np.ones(len(x), np.int64)


def _open_rows(texts: DataFrame, spans: DataFrame, length: int, rows_of: Callable[..., tuple[np.ndarray, ...]], by_run: bool) -> DataFrame:
    """Rows that ``rows_of`` makes of the open runs: (which run, key, run, start, number of strings)."""
    schema = StructType.fromDDL(_ROWS)
    asked = spans.where("open").groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = texts.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "spans.start", "spans.stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        parts, owners, waiting, size = [], [], 0, 0

        def name() -> None:
            nonlocal waiting
            if not waiting:
                return
            lengths = np.array([len(p) for p in parts])
            stop = np.cumsum(lengths)
            start = stop - lengths
            doc, tag, base = (np.array(x, np.int64) for x in zip(*owners))
            which, key, run_, at, windows = rows_of(np.frombuffer(b"".join(parts), np.uint8), start, stop, doc, length)
            found.append((key, run_, doc[which], _place(0, at - start[which] + base[which], windows) + (tag[which] << 39)))
            waiting = 0
            parts.clear()
            owners.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            name()
            if found:
                rows = [np.concatenate(x) for x in zip(*found)]
                found.clear()
                yield from _batches(condense(*rows, by_run=by_run), schema.fieldNames())
            size = 0

        for batch in _parts(batches):
            for doc, tag, text, starts, stops in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                for x, y in set(zip(starts, stops)):
                    parts.append(text[x:y])
                    owners.append((doc, tag, x))
                    waiting += y - x
                    size += y - x
                    if waiting >= STRETCH:
                        name()
                    if size >= FLUSH // 8:
                        yield from flush()
        yield from flush()
        give_back()

    return joined.mapInArrow(run, schema)


def _union(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[list[int]] = []
    for x, y in sorted(zip(starts, stops)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def _let_go(spark: SparkSession) -> None:
    """Exchange files of finished jobs go once the driver's garbage is collected, so that a phase's files don't lie beside the next one's."""
    for _ in range(2):  # what Python lets go is garbage in the JVM only the next time
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def _settled(docs: DataFrame, id_col: str, text_col: str, length: int) -> list[DataFrame]:
    spark, texts = docs.sparkSession, lambda: _texts(docs, id_col, text_col)
    first = _ranked(_first_rows(texts(), length), length, "repeats-runs")
    _let_go(spark)
    second = _ranked(_open_rows(texts(), first, length, _sides, by_run=False), length, "repeats-sides")
    _let_go(spark)
    third = _ranked(_open_rows(texts(), second, length, _strings, by_run=True), length, "repeats-strings")
    _let_go(spark)
    return [first, third]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` without ``text_col``, with ``n_bytes``, ``n_removed``, ``removed`` (array of start, end in bytes, end exclusive) and ``kept`` (the remaining bytes).

    Removed is each byte covered by a string of ``length`` bytes of the text's UTF-8 that also starts in a document with a
    smaller id; strings never cross documents and are judged on the input. Ids are whole numbers. A null text is empty. A null id
    is larger than all others. Rows with equal ids don't take from each other: repeated rows have equal results, and rows with an equal id and other
    texts each their own (told apart by 24 bits of a hash of the text). Input columns with a name of the added ones give way to them.
    """
    if not 2 <= length <= 300:
        raise ValueError("lengths from 2 to 300")
    parts = _settled(docs, id_col, text_col, length)
    spans = parts[0].where("NOT open").select("doc", "tag", "start", "stop").union(parts[1].where("NOT open").select("doc", "tag", "start", "stop"))
    gone = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = _texts(docs, id_col, text_col, rest=True).join(gone, ["doc", "tag"], "left").select("kept", "text", "spans.start", "spans.stop")
    added = StructType.fromDDL("n_bytes long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept_bytes binary")
    schema = StructType([joined.schema["kept"], *added.fields])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sizes, counts, lists, outs = [], [], [], []
            for text, starts, stops in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                merged = _union(starts or [], stops or [])
                at, rest = 0, []
                for x, y in merged:
                    rest.append(text[at:x])
                    at = y
                rest.append(text[at:])
                sizes.append(len(text))
                counts.append(sum(y - x for x, y in merged))
                lists.append([{"start": x, "end": y} for x, y in merged])
                outs.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(lists, span), pa.array(outs, pa.binary())], names=schema.fieldNames())
        give_back()

    names = ("n_bytes", "n_removed", "removed", "kept")
    own = [c for c in docs.columns if c != text_col and c.lower() not in names]
    return joined.mapInArrow(run, schema).select(*[F.col(f"kept.`{c}`").alias(c) for c in own], "n_bytes", "n_removed", "removed", F.col("kept_bytes").alias("kept"))
