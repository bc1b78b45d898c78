"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Method: bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary
finds the longest token at every place of a piece in one pass. Encoding takes the longest match and
backtracks to shorter ones where two neighbours could not stand side by side after merging; which pairs
can is remembered, and a place found useless is never tried again, so a piece costs linear time. The
ids are exactly those of merging pair by pair, lowest rank first.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tagloom.llm.common import add_columns, as_bytes

#: Pieces, and pairs of tokens, that a worker remembers; once full it stays, as frequent ones come early.
REMEMBERED = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks of a rank file, and what encoding and decoding derive from them.

    Ids are ranks; the 256 single bytes must be among them and rank below all merges, as in public
    byte-level vocabularies.
    """

    def __init__(self, path: str) -> None:
        self.ids: dict[str, int] = {t.decode("latin-1"): i for t, i in read_ranks(path).items()}
        self.texts = {i: t for t, i in self.ids.items()}
        #: The two tokens whose merge gives a token; none for single bytes.
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in sorted(self.texts):
            text = self.texts[i]
            if len(text) > 1:
                for cut in range(1, len(text)):
                    a, b = self.ids.get(text[:cut], i), self.ids.get(text[cut:], i)
                    if a < i and b < i and self._reached(a) and self._reached(b) and self._stand(a, b, i):
                        self.parts[i] = (a, b)
                        break
                else:
                    continue  # no order of merges gives it: it only stands for a whole piece
            automaton.add_word(text, i)
        automaton.make_automaton()
        self.automaton = automaton
        #: The longest shorter token that a token starts with.
        self.shorter: dict[int, int | None] = {}
        for i, text in self.texts.items():
            self.shorter[i] = next(
                (k for n in range(len(text) - 1, 0, -1) if (k := self.ids.get(text[:n])) is not None and self._reached(k)), None
            )

    def _reached(self, i: int) -> bool:
        return len(self.texts[i]) == 1 or i in self.parts

    def _stand(self, a: int, b: int, bound: int = 1 << 62) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` by ranks below ``bound`` leaves these two tokens.

        Merges next to the boundary are undone from the last to the first; a merge across it must never
        rank before the one just undone. Of equal ranks, the left one comes first.
        """
        while True:
            across = self.ids.get(self.texts[a] + self.texts[b])
            if across is not None and across < bound:
                return False
            if a > b and a in self.parts:
                bound, a = a, self.parts[a][1]
            elif b in self.parts:
                bound, b = b + 1, self.parts[b][0]
            elif a in self.parts:
                bound, a = a, self.parts[a][1]
            else:
                return True

    def neighbours(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            known = self._stand(a, b)
            if len(self.pairs) < REMEMBERED:
                self.pairs[a << 32 | b] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        longest = [0] * len(text)
        size = self.texts
        for end, i in self.automaton.iter(text):
            longest[end + 1 - len(size[i])] = i  # ends come in order: the longest stays
        useless = bytearray(len(text) + 1)
        out: list[int] = []
        at, token = 0, longest[0] if text else None
        while at < len(text):
            while token is not None:
                end = at + len(size[token])
                if not useless[end] and (not out or self.neighbours(out[-1], token)):
                    break
                token = self.shorter[token]
            if token is None:  # nothing can follow here: go back and take a shorter token before
                useless[at] = 1
                token = out.pop()
                at -= len(size[token])
                token = self.shorter[token]
            else:
                out.append(token)
                at = end
                token = longest[at] if at < len(text) else None
        return out


class Codec:
    """Encodes whole texts: each match of ``pattern`` separately, no special tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        vocabulary = self.vocabulary = Vocabulary(path)
        self.split = regex.compile(pattern).findall

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = vocabulary.encode_piece(piece.encode())
                packed = b"".join(i.to_bytes(4, "little") for i in ids)
                if len(piece) <= 64 and len(self) < REMEMBERED:
                    self[piece] = packed
                return packed

        self.pieces = Pieces()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker: building the automaton takes about a second."""
    return Codec(path, pattern)


@lru_cache(maxsize=2)
def tokens(path: str) -> dict[int, bytes]:
    return {i: t for t, i in read_ranks(path).items()}


def decode_ids(ids: bytes, path: str) -> bytes:
    return b"".join(map(tokens(path).__getitem__, memoryview(ids).cast("I").tolist()))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``: the token ids of the whole text as little-endian unsigned 32-bit integers
    (binary, 4 bytes a token). Null and empty texts have no ids (empty binary). ``path`` must name the
    vocabulary on every executor."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        c = codec(path, pattern)
        return {ids_col: pa.array([c.encode(t.decode()) for t in as_bytes(batch.column(1))], pa.binary())}

    return add_columns(df, run, [text_col], f"`{ids_col}` binary")


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the bytes of the ids (binary: ids may end within a character). Null ids
    give empty bytes; an id that the vocabulary lacks is an error. A column named ``out_col`` gives way."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {out_col: pa.array([decode_ids(i or b"", path) for i in batch.column(1).to_pylist()], pa.binary())}

    return add_columns(df, run, [ids_col], f"`{out_col}` binary")
