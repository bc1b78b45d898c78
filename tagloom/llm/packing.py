"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Method: hierarchical residual packing. Each task tokenizes its documents and packs their pieces
best-fit (largest first). Bins that are nearly full are final; all others, however many, go on to
further rounds. A round spreads them by hash over groups of bounded size, each with a mix of all tasks'
bins, and packs a group anew, by pieces or by whole bins, whichever takes fewer. Rounds end with
one group, or when one no longer lowers the number of bins. A round is a stored table, so a lost
executor never repacks what others have read already.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm.common import _parts, as_bytes, give_back, stored

CAPACITY = 4096
END_ID = 1
#: A bin with this many tokens free or fewer is nearly full.
SLACK = 24
#: About ``FAN_IN * CARRY`` underfull bins, of ``GO * CARRY`` pieces at most, meet in one task of a round.
FAN_IN = 8
CARRY = 4_000
#: Pieces that a task packs in one go are ``GO * CARRY``.
GO = 50
#: Words that a worker remembers, bytes of text whose words it looks up together, and new words in one call of the tokenizer.
REMEMBERED = 150_000
AT_ONCE = 1 << 20
TOGETHER = 1_000
#: Stands between words; a token of its own, which no word without it has.
MARK = "\x01"

_MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,place:bigint>"
_BINS = f"round int, grp bigint, bin bigint, used int, open boolean, members array<{_MEMBER}>"
_ARROW = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("place", pa.int64())])


class Words:
    """Ids of texts' words, packed. The tokenizer drops white space and never looks across it, so the
    ids of a text are those of its blank-separated words, and each distinct word is tokenized once; a
    letters-only word and the punctuation after it are apart, too. New letters-only words are
    tokenized together: each ends with its only end-of-word token. All other new words are, too, with a
    mark between them that none of them holds."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.mark = self._encode(MARK)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _one(self, word: str) -> bytes:
        return self._encode(word).tobytes()

    def _letters(self, stems: list[str]) -> list[bytes]:
        ids = self._encode(" ".join(stems))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(stems):
            return self._halved(self._letters, stems)
        packed, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [packed[a:b] for a, b in zip(at, at[1:])]

    def _any(self, others: list[str]) -> list[bytes]:
        ids = self._encode(f" {MARK} ".join(others))
        cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else []
        if len(cuts) != len(others) - 1 or any(MARK in w for w in others):
            return self._halved(self._any, others)
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(packed)])]

    def _halved(self, way: Callable[[list[str]], list[bytes]], some: list[str]) -> list[bytes]:
        if len(some) == 1:
            return [self._one(some[0])]
        half = len(some) // 2
        return way(some[:half]) + way(some[half:])

    def _tokenized(self, way: Callable[[list[str]], list[bytes]], some: dict[bytes, str]) -> dict[bytes, bytes]:
        out: list[bytes] = []
        texts = list(some.values())
        for at in range(0, len(texts), TOGETHER):
            out += way(texts[at : at + TOGETHER])
        return dict(zip(some, out))

    def _add(self, missing: set[bytes]) -> list[bytes]:
        """Adds the ids of these words to those known; what was added."""
        known = self.known
        parted: dict[bytes, bytes] = {}
        stems: dict[bytes, str] = {}
        others: dict[bytes, str] = {}
        for w in missing:
            stem = w.rstrip(b".,!?")
            s = stem.decode()
            if s.isalpha() and s.lower().isalpha():
                if len(stem) < len(w):
                    parted[w] = stem
                    tail = w[len(stem) :]
                    if tail not in known:
                        others[tail] = tail.decode()
                if stem not in known:
                    stems[stem] = s
            else:
                others[w] = w.decode()
        new = self._tokenized(self._letters, stems) | self._tokenized(self._any, others)
        known.update(new)
        for w, stem in parted.items():
            known[w] = known[stem] + known[w[len(stem) :]]
        return [*new, *parted]

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of each text; words that are new to several of them are tokenized once."""
        # ASCII letters are lowered; the tokenizer would, after composing marks (of which there are none).
        found = [(t if b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        known = self.known
        added = self._add(missing) if (missing := set().union(*found).difference(known)) else []
        out = [b"".join(map(known.__getitem__, some)) for some in found]
        if len(known) > REMEMBERED:  # once full it stays: frequent words have come by then
            for w in added:
                del known[w]
        return out

    def ids(self, text: bytes) -> bytes:
        return self.ids_of([text])[0]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms = 0  # bit r: some bin has r free
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            at, room = len(bins), capacity
            bins.append([i])
        left = room - size
        free[left].append(at)
        rooms |= 1 << left
    return bins


def _fitted(items: list[tuple[int, list[dict]]], capacity: int) -> list[tuple[int, list[dict]]]:
    items.sort(key=lambda x: (-x[0], [tuple(-1 if v is None else v for v in m.values()) for m in x[1][:1]]))
    return [(sum(items[i][0] for i in b), [*chain.from_iterable(items[i][1] for i in b)]) for b in best_fit([u for u, _ in items], capacity)]


def _packed(items: list[tuple[int, list[dict]]], level: int, group: int, capacity: int, slack: int, last: bool) -> pa.RecordBatch:
    """Items (used, members) packed into bins, by members or as they are; all underfull bins stay open but in the last round."""
    made = _fitted(items, capacity)
    if level:
        anew = _fitted([(m["length"], [m]) for _, members in items for m in members], capacity)
        made = min(anew, made, key=len)
    made.sort(key=lambda x: x[0])
    for _, members in made:
        place = 0
        for m in members:
            m["place"] = place
            place += m["length"]
    n = len(made)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([level] * n, pa.int32()), pa.array([group] * n, pa.int64()), pa.array(range(n), pa.int64()),
            pa.array([u for u, _ in made], pa.int32()),
            pa.array([not last and u < capacity - slack for u, _ in made], pa.bool_()),
            pa.array([m for _, m in made], pa.list_(_ARROW)),
        ],
        names=["round", "grp", "bin", "used", "open", "members"],
    )


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    slack: int = SLACK, fan_in: int = FAN_IN, carry: int = CARRY,
) -> DataFrame:
    """A row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids followed by ``end_id``; only longer ones than ``capacity`` are cut. A null or
    blank text is a piece with ``end_id`` alone. Rows are packed as they are: repeated rows, ids and
    null ids each get their own pieces. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(path)
        items: list[tuple[int, list[dict]]] = []
        end = np.array([end_id], "<u4").tobytes()
        group = TaskContext.get().partitionId() << 20
        for batch in _parts(batches, AT_ONCE):
            for doc, packed in zip(batch.column(0).to_pylist(), known.ids_of(as_bytes(batch.column(1)))):
                ids = packed + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    items.append((n, [{"doc_id": doc, "piece": piece, "start": at // 4, "length": n, "ids_crc32": zlib.crc32(part), "place": 0}]))
            if len(items) > GO * carry:  # a very large partition is packed in several goes
                yield _packed(items, 0, group, capacity, slack, False)
                items, group = [], group + 1
        if items:
            yield _packed(items, 0, group, capacity, slack, False)
        give_back()

    def merged(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, items = None, []
            for batch in batches:
                for g, used, members in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    if g != group and items:
                        yield _packed(items, level, group, capacity, slack, last)
                        items = []
                    group = g
                    items.append((used, members))
            if items:
                yield _packed(items, level, group, capacity, slack, last)

        return run

    level = 0
    bins = stored(docs.mapInArrow(local, _BINS), "packing")
    done = bins.where("NOT open")
    while True:
        waiting = bins.where("open")
        number, pieces = waiting.agg(F.count("*"), F.sum(F.size("members"))).first()
        if not number:
            break
        level += 1
        groups = max(-(-number // (fan_in * carry)), -(-pieces // (GO * carry)))
        meet = F.pmod(F.xxhash64("round", "grp", "bin"), F.lit(groups))
        bins = stored(
            waiting.select(meet.alias("grp"), "used", "members").repartition("grp").sortWithinPartitions("grp")
            .mapInArrow(merged(level, groups == 1), _BINS),
            "packing",
        )
        done = done.union(bins.where("NOT open"))
        if bins.count() >= number:
            done = done.union(bins.where("open"))
            break
    place = F.expr("IF(round = 0, 0L, (1L << 59) + (CAST(round AS BIGINT) << 44)) + (grp << 20) + bin")
    return done.select(place.alias("sequence_id"), F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", F.col("m.place").alias("offset")
    )
