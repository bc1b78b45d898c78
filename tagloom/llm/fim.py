"""Fill-in-middle: documents cut at two places of their units and put together anew, and back again.

Method: secondary sort. Map tasks cut each document into prefix, middle and suffix, and these into pieces of
whole units, keyed by document and place in the output. One exchange by document and a sort within partitions
bring the pieces into output order, so that digests are fed piece by piece and no text is ever whole in a task.
Restoring reads the sentinels back out of that stream, keys what stands between them by place in the
original, and sorts again within the same partitions, without a second exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.llm.common import _parts, as_bytes, give_back

# The sentinels.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Bytes of a piece, sentinel apart; more pieces than an Arrow batch holds never meet in a task's memory.
PIECE = 4096
#: Of 100 documents, how many are rearranged, and of those how many have the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20

_BLOCK = 1 << 16
#: Place of a part in the original: the part's rank above, the offset within the part below.
_RANK = 1 << 40
_RANKS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

_HEAD = "n_units long, form string, prefix_chars long, middle_chars long"


class Units:
    """Units (runs of ASCII letters, and single code points of any other kind) of a text in UTF-8."""

    def __init__(self, text: bytes) -> None:
        b = np.frombuffer(text, np.uint8)
        letter = ((b | 32) - 97).astype(np.uint8) < 26
        self.size = len(b)
        self.char = (b & 0xC0) != 0x80
        self.first = self.char.copy()
        self.first[1:] &= ~(letter[1:] & letter[:-1])
        counts = np.add.reduceat(self.first, np.arange(0, len(b), _BLOCK), dtype=np.int64) if len(b) else np.zeros(0, np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.n = int(self.before[-1])

    def place(self, k: int) -> int:
        """Byte at which unit ``k`` starts; the end for ``k = n``."""
        if k >= self.n:
            return self.size
        block = int(np.searchsorted(self.before, k, "right")) - 1
        at = block * _BLOCK
        return at + int(np.flatnonzero(self.first[at : at + _BLOCK])[k - int(self.before[block])])

    def chars(self, a: int, b: int) -> int:
        return int(np.count_nonzero(self.char[a:b]))

    def pieces(self, a: int, b: int, most: int = PIECE) -> Iterator[tuple[int, int]]:
        """[a, b) in stretches of at most ``most`` bytes that end with a unit, where a unit is not longer itself."""
        while b - a > most:
            ends = np.flatnonzero(self.first[a + 1 : a + most + 1])
            to = a + 1 + int(ends[-1]) if len(ends) else a + most
            yield a, to
            a = to
        if a < b:
            yield a, b


def choose(key: str, text: bytes, units: Units, salt: str = "1") -> tuple[str, int, int]:
    """(form, first and second cut in units) by the digest of ``salt:key``."""
    h = hashlib.sha256(f"{salt}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in _RANKS) or h3 % 100 >= REARRANGED:
        return "plain", 0, 0
    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm", a, b


def cut(key: str, text: bytes, salt: str = "1", most: int = PIECE) -> tuple[tuple, list[bytes]]:
    """(units, form, prefix and middle in code points) of a document, and its output in pieces."""
    units = Units(text)
    form, a, b = choose(key, text, units, salt)
    if form == "plain":
        return (units.n, form, None, None), [text[x:y] for x, y in units.pieces(0, units.size, most)]
    p, q = units.place(a), units.place(b)
    spans = {PREFIX: (0, p), MIDDLE: (p, q), SUFFIX: (q, units.size)}
    out = []
    for mark in _ORDERS[form]:
        chunks = [text[x:y] for x, y in units.pieces(*spans[mark], most)] or [b""]
        out += [mark + chunks[0], *chunks[1:]]
    return (units.n, form, units.chars(0, p), units.chars(p, q)), out


class Restorer:
    """Takes an output piece by piece, cut anywhere; gives (place in the original, bytes) for each."""

    def __init__(self, form: str) -> None:
        self.marks = list(_ORDERS.get(form, ()))
        self.place, self.held = (None if self.marks else 0), b""

    def feed(self, chunk: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        data, self.held = self.held + chunk, b""
        while self.marks and (i := data.find(self.marks[0])) >= 0:
            yield from self._put(data[:i])
            mark = self.marks.pop(0)
            self.place, data = _RANKS[mark] * _RANK, data[i + len(mark) :]
        if self.marks and not last:  # the start of a sentinel may stand at the end
            keep = next((k for k in (2, 1) if data.endswith(self.marks[0][:k])), 0)
            data, self.held = data[: len(data) - keep], data[len(data) - keep :]
        yield from self._put(data)
        if last and self.marks:
            raise ValueError(f"sentinel {self.marks[0]!r} is missing")

    def _put(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        if data:
            if self.place is None:
                raise ValueError("text before the first sentinel")
            yield self.place, data
            self.place += len(data)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, salt: str = "1") -> DataFrame:
    """The output of every row of ``docs``, in pieces, partitioned by ``row`` and sorted by (``row``, ``at``).

    Columns: ``row`` (a number of its own for each input row), ``at`` (place of the piece's first byte in the
    output; -1 for the head), ``chunk`` (bytes), and for heads only ``kept`` (struct of the columns ``keep``, by default all but
    the text), ``n_units``, ``form`` (plain, psm, spm), ``prefix_chars`` and ``middle_chars`` (null if plain).

    Every row counts, repeated rows and ids too: each has its own number. A null text is an empty one, and
    plain; a null id counts as an empty string in the digest. Kept columns stand inside the struct, so that none clashes.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    packed = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(True).alias("none")]).alias("kept"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    schema = StructType([*StructType.fromDDL("row long, at long, chunk binary").fields, packed.schema["kept"], *StructType.fromDDL(_HEAD).fields])
    schema["kept"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            rows, heads, at, chunks, which = [], [], [], [], []
            for i, (row, key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), as_bytes(batch.column(3)))):
                head, out = cut(key, text, salt)
                place = 0
                rows += [row] * (len(out) + 1)
                heads += [head] + [(None,) * 4] * len(out)
                which += [i] + [None] * len(out)
                at.append(-1)
                chunks.append(None)
                for c in out:
                    at.append(place)
                    chunks.append(c)
                    place += len(c)
            columns = list(zip(*heads)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()), pa.array(at, pa.int64()), pa.array(chunks, pa.binary()), batch.column(1).take(pa.array(which, pa.int64())),
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
                ],
                names=schema.fieldNames(),
            )
        give_back()

    return packed.mapInArrow(run, schema).repartition("row").sortWithinPartitions("row", "at")


def restore(pieces: DataFrame) -> DataFrame:
    """The originals of what ``transform`` gives, from output and form alone, in pieces sorted by (``row``, ``at``) in their partitions.

    ``at`` orders the pieces of a row; heads (-1) also have ``output_sha256`` and ``output_bytes``.
    """
    schema = StructType([*pieces.schema.fields, *StructType.fromDDL("output_sha256 string, output_bytes long").fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, row, digest, size, back = None, None, None, 0, None
        rows, places, chunks, heads = [], [], [], []

        def close() -> None:
            for place, data in back.feed(b"", last=True):
                put(place, data, None)
            put(-1, None, head | {"output_sha256": digest.hexdigest(), "output_bytes": size})

        def put(place: int, data: bytes | None, h: dict | None) -> None:
            rows.append(row)
            places.append(place)
            chunks.append(data)
            heads.append(h)

        def made() -> pa.RecordBatch:
            blank = dict.fromkeys(names)
            columns = {"row": rows, "at": places, "chunk": chunks}
            full = [blank if h is None else h for h in heads]
            arrays = [pa.array(columns[n] if n in columns else [h[n] for h in full], kinds[n]) for n in names]
            for x in (rows, places, chunks, heads):
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        kinds = None
        for batch in _parts(batches):
            kinds = kinds or {f.name: f.type for f in batch.schema} | {"output_sha256": pa.string(), "output_bytes": pa.int64()}
            at, data = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, r in enumerate(batch.column(0).to_pylist()):
                if at[i] < 0:
                    if row is not None:
                        close()
                    head, row, digest, size = batch.slice(i, 1).to_pylist()[0], r, hashlib.sha256(), 0
                    back = Restorer(head["form"])
                    continue
                digest.update(data[i])
                size += len(data[i])
                for place, d in back.feed(data[i]):
                    put(place, d, None)
            yield made()
        if row is not None:
            close()
            yield made()
        give_back()

    return pieces.mapInArrow(run, schema).sortWithinPartitions("row", "at")


def digests(restored: DataFrame) -> DataFrame:
    """A row per document of what ``restore`` gives: the kept columns as struct ``kept``, ``n_units``, ``form``, ``prefix_chars``, ``middle_chars``,
    ``output_bytes``, ``output_sha256`` and ``restored_sha256``, fed piece by piece."""
    schema = StructType([restored.schema["kept"], *StructType.fromDDL(f"{_HEAD}, output_bytes long, output_sha256 string, restored_sha256 string").fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, done = None, None, []
        for batch in _parts(batches):
            at, data = batch.column("at").to_pylist(), batch.column("chunk").to_pylist()
            own = batch.select(names[:-1])
            for i, place in enumerate(at):
                if place < 0:
                    if head is not None:
                        done.append((head, digest.hexdigest()))
                    head, digest = own.slice(i, 1), hashlib.sha256()
                else:
                    digest.update(data[i])
            if done:
                yield _joined(done, names)
                done = []
        if head is not None:
            yield _joined([(head, digest.hexdigest())], names)
        give_back()

    return restored.mapInArrow(run, schema)


def _joined(done: list[tuple[pa.RecordBatch, str]], names: list[str]) -> pa.RecordBatch:
    table = pa.Table.from_batches([h for h, _ in done]).combine_chunks()
    arrays = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([d for _, d in done], pa.string())], names=names)


def texts(pieces: DataFrame) -> DataFrame:
    """(``row``, ``output``): whole outputs, for documents that a task can hold. Not needed for digests or for writing pieces out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, parts = None, []
        for batch in _parts(batches):
            rows, outs = [], []
            for r, at, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at < 0:
                    if row is not None:
                        rows.append(row)
                        outs.append(b"".join(parts).decode())
                    row, parts = r, []
                else:
                    parts.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(outs, pa.string())], names=["row", "output"])
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([b"".join(parts).decode()], pa.string())], names=["row", "output"])

    return pieces.mapInArrow(run, "row long, output string")
