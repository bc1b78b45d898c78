"""Media columns: baseline JPEG, written and read as luminance thumbnails.

Reading: markers are parsed, scans are Huffman-decoded, and only the DC coefficient of each 8x8 block is
kept: its dequantized value is the mean of the block, so the DCs of the luminance component are a
thumbnail of an eighth of the width and height. Restart segments are independent of each other and are
decoded side by side in numpy, one lane per segment, over all images of a batch that share their tables.

Writing stores bytes losslessly: one byte is the mean of one block (quantizer 8, no AC coefficients),
192 blocks to a row and a restart marker after each row. Payloads beyond the format's 8191 rows of
blocks become several frames, one after the other.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.common import add_columns, as_bytes

ROW = 192
#: Rows of blocks in a frame: heights are 16-bit numbers.
FRAME_ROWS = 65535 // 8
#: Rows that are coded at once; bounds the memory of a task whatever the size of a payload.
LANES = 8192

# Fixed: the format's typical Huffman table for luminance DCs (codes per length, then symbols), and one
# for ACs that holds the end of block alone.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
AC_COUNTS = (1, *[0] * 15)
AC_SYMBOLS = (0,)


def codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


_DC = codes(DC_COUNTS, DC_SYMBOLS)
_DC_CODE = np.array([_DC[k][0] for k in range(12)])
_DC_LEN = np.array([_DC[k][1] for k in range(12)])


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _coded_rows(rows: np.ndarray) -> list[bytes]:
    """The entropy-coded segment of each row of block means."""
    dc = rows.astype(np.int32) - 128
    diff = np.diff(dc, axis=1, prepend=0)
    size = np.frexp(np.abs(diff))[1]  # bits of the magnitude
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    value = ((_DC_CODE[size] << size) | extra) << 1  # the last bit is the end of block
    bits = _DC_LEN[size] + size + 1
    ends = np.cumsum(bits, axis=1)
    total = ends[:, -1]
    width = (total + 7) // 8
    start = np.concatenate(([0], np.cumsum(width)))
    place = (ends - bits) + 8 * start[:-1, None]
    pad = 8 * width - total
    flat_at = np.concatenate((place.ravel(), 8 * start[:-1] + total))
    flat_bits = np.concatenate((bits.ravel(), pad))
    flat = np.concatenate((value.ravel(), (1 << pad) - 1)) << (24 - flat_bits - (flat_at & 7))
    out = np.zeros(start[-1] + 3)
    for k in range(3):
        out += np.bincount((flat_at >> 3) + k, (flat >> (16 - 8 * k)) & 255, len(out))
    packed = out.astype(np.uint8).tobytes()
    return [packed[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def write_frames(payloads: list[bytes], notes: list[bytes] | None = None) -> list[bytes]:
    """JPEG bytes of each payload (a positive multiple of 192 bytes); ``notes`` go into comment segments."""
    coded: list[bytes] = []
    counts = [len(p) // ROW for p in payloads]
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    for at in range(0, len(data), LANES):
        coded += _coded_rows(data[at : at + LANES])
    tables = (
        _marker(0xDB, b"\x00" + bytes([8] + [1] * 63))
        + _marker(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS))
        + _marker(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
        + _marker(0xDD, struct.pack(">H", ROW))
    )
    out, at = [], 0
    for i, n in enumerate(counts):
        frames = []
        for first in range(0, n, FRAME_ROWS):
            rows = coded[at + first : at + min(n, first + FRAME_ROWS)]
            scan = b"".join(x for k, row in enumerate(rows) for x in (row, b"\xff" + bytes([0xD0 + k % 8])))[:-2]
            frames.append(
                b"\xff\xd8" + (_marker(0xFE, notes[i]) if notes else b"") + tables
                + _marker(0xC0, struct.pack(">BHHBBBB", 8, 8 * len(rows), 8 * ROW, 1, 1, 0x11, 0))
                + _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"
            )
        out.append(b"".join(frames))
        at += n
    return out


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    note: bytes = b""
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # component id, across, down, quantizer
    quant: dict[int, int] = field(default_factory=dict)  # DC entries
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component id, DC table, AC table
    restart: int = 0
    segments: list[bytes] = field(default_factory=list)


def parse(data: bytes) -> list[Frame]:
    """The frames of one or more baseline JPEGs. ``ValueError`` for other kinds and for broken markers."""
    frames, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at, f, done = at + 2, Frame(), False
        while not done:
            if at + 2 > len(data) or data[at] != 0xFF:
                raise ValueError("marker expected")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                at, done = at + 2, True
                continue
            (size,) = struct.unpack(">H", data[at + 2 : at + 4])
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    f.quant[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    f.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xC0:
                depth, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8:
                    raise ValueError("8-bit samples only")
                f.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif kind in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("baseline frames only")
            elif kind == 0xDD:
                (f.restart,) = struct.unpack(">H", body)
            elif kind == 0xFE:
                f.note = body
            elif kind == 0xDA:
                scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                end = at
                pieces, begun = [], at
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        raise ValueError("scan does not end")
                    after = data[end + 1]
                    if after == 0:
                        end += 2
                    elif 0xD0 <= after <= 0xD7:
                        pieces.append(data[begun:end])
                        end = begun = end + 2
                    elif after == 0xFF:
                        end += 1
                    else:
                        break
                pieces.append(data[begun:end])
                at = end
                if f.parts and scan[0][0] == f.parts[0][0]:  # the luminance scan
                    f.scan, f.segments = scan, [p.replace(b"\xff\x00", b"\xff") for p in pieces]
        frames.append(f)
    return frames


def _lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) by the next 16 bits; length 0: no code."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes(tuple(table[0]), tuple(table[1])).items():
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
    return length, symbol


def _dcs(segments: list[bytes], blocks: list[int], units: list[tuple[int, int, int]], tables: dict) -> list[np.ndarray]:
    """DC coefficients, in order, of each lane's first ``blocks`` blocks. ``units``: (component, DC table,
    AC table) of the blocks that repeat in each coded unit."""
    width = max(map(len, segments)) + 8
    data = np.zeros((len(segments), width), np.uint8)
    for i, s in enumerate(segments):
        data[i, : len(s)] = np.frombuffer(s, np.uint8)
    flat = data.ravel()
    lookups = {k: _lookup(t) for k, t in tables.items()}
    base = np.arange(len(segments), dtype=np.int64) * width
    limit = 8 * (width - 8)
    pos = np.zeros(len(segments), np.int64)
    want = np.asarray(blocks)
    last = {u[0]: np.zeros(len(segments), np.int64) for u in units}
    out = np.zeros((len(segments), max(blocks)), np.int32)

    def peek(lanes: np.ndarray | slice, at: np.ndarray) -> np.ndarray:
        if at.size and at.max() > limit:
            raise ValueError("scan ends early")
        b = base[lanes] + (at >> 3)
        word = (flat[b].astype(np.int64) << 16) | (flat[b + 1].astype(np.int64) << 8) | flat[b + 2]
        return (word >> (8 - (at & 7))) & 0xFFFF

    for block in range(out.shape[1]):
        component, dc_table, ac_table = units[block % len(units)]
        lanes = slice(None) if want.min() > block else np.flatnonzero(want > block)
        at = pos[lanes]
        code = peek(lanes, at)
        lengths, symbols = lookups[dc_table]
        n, size = lengths[code], symbols[code]
        if n.size and n.min() == 0:
            raise ValueError("no such code")
        at = at + n
        extra = peek(lanes, at) >> (16 - size)
        last[component][lanes] += np.where((extra << 1) >> size, extra, extra - (1 << size) + 1)
        out[lanes, block] = last[component][lanes]
        at = at + size
        lengths, symbols = lookups[0x10 | ac_table]
        code = peek(lanes, at)
        n, symbol = lengths[code], symbols[code]
        if n.min() == 0:
            raise ValueError("no such code")
        pos[lanes] = at + n + (symbol & 15)
        if symbol.any():  # coefficients before the end of block: skip them lane by lane
            index = np.arange(len(segments))[lanes]
            place = np.where(symbol == 0xF0, 16, np.where(symbol == 0, 64, (symbol >> 4) + 1))
            while (open_ := place < 63).any():
                index, place = index[open_], place[open_]
                code = peek(index, pos[index])
                n, symbol = lengths[code], symbols[code]
                if n.min() == 0:
                    raise ValueError("no such code")
                pos[index] += n + (symbol & 15)
                place = np.where(symbol == 0xF0, place + 16, np.where(symbol == 0, 64, place + (symbol >> 4) + 1))
    return [out[i, :n] for i, n in enumerate(blocks)]


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail (uint8, rows by columns) of each frame."""
    groups: dict[tuple, list[int]] = {}
    plans = []
    for i, f in enumerate(frames):
        parts = {p[0]: p for p in f.parts}
        first = f.parts[0]
        across, down = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
        if len(f.scan) == 1:  # not interleaved: a unit is one block
            columns = -(-f.width * first[1] // (8 * across))
            rows = -(-f.height * first[2] // (8 * down))
            units, h, v = [f.scan[0]], 1, 1
            grid = (rows, columns)
        else:
            units = [s for s in f.scan for _ in range(parts[s[0]][1] * parts[s[0]][2])]
            h, v = first[1], first[2]
            grid = (-(-f.height // (8 * down)), -(-f.width // (8 * across)))
        count = grid[0] * grid[1]
        step = f.restart or count
        blocks = [min(step, count - k) * len(units) for k in range(0, count, step)]
        if len(blocks) != len(f.segments):
            raise ValueError("restart segments are missing")
        plans.append((units, h, v, grid, blocks))
        groups.setdefault((tuple(units), tuple(sorted(f.tables.items()))), []).append(i)
    found: dict[int, list[np.ndarray]] = {i: [] for i in range(len(frames))}
    for (units, tables), members in groups.items():
        lanes = [(i, s, n) for i in members for s, n in zip(frames[i].segments, plans[i][4])]
        for at in range(0, len(lanes), LANES):
            part = lanes[at : at + LANES]
            for (i, _, _), dc in zip(part, _dcs([s for _, s, _ in part], [n for _, _, n in part], list(units), dict(tables))):
                found[i].append(dc)
    out = []
    for i, f in enumerate(frames):
        units, h, v, (rows, columns), _ = plans[i]
        dc = np.concatenate(found[i]).reshape(rows, columns, len(units))[:, :, : h * v]
        grid = dc.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
        mean = np.rint(grid * (f.quant[f.parts[0][3]] / 8) + 128)
        out.append(np.clip(mean, 0, 255).astype(np.uint8))
    return out


def thumbnail_hash(image: np.ndarray) -> str:
    """64 bits: which of 8x8 areas are brighter than all of them on average."""
    cells = image.astype(np.int64)
    for axis in (0, 1):
        n = cells.shape[axis]
        edges = np.arange(8) * n // 8
        sizes = np.maximum(np.diff(np.append(edges, n)), 1)
        cells = np.add.reduceat(cells, edges, axis) * (5040 // 8) // (sizes[:, None] if axis == 0 else sizes)
    bits = (cells > cells.mean()).ravel()
    return np.packbits(bits).tobytes().hex()


def _in_bounds(sizes: list[int], most: int = LANES * ROW):
    """Slices of a batch whose payloads have ``most`` bytes together, or one payload."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if sizes:
        yield slice(first, len(sizes))


def encode_media(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``df`` with ``media_col``: the text's bytes as a JPEG, padded with blanks to a positive multiple of
    192, the unpadded length in the comment. Null and empty texts are one row of blanks; equal texts give
    equal bytes."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = as_bytes(batch.column(1))
        out: list[bytes] = []
        for part in _in_bounds([len(t) for t in texts]):
            padded = [t + b" " * (-len(t) % ROW or ROW * (not t)) for t in texts[part]]
            out += write_frames(padded, [str(len(t)).encode() for t in texts[part]])
        return {media_col: pa.array(out, pa.binary())}

    return add_columns(df, run, [text_col], f"`{media_col}` binary")


def decode_media(df: DataFrame, media_col: str = "media", payload_col: str = "payload") -> DataFrame:
    """``df`` with what the stored bytes hold: ``note``, ``width`` and ``height`` (of the first frame), the
    thumbnail as bytes in ``payload_col`` (all frames, row by row), and its hash. Null media give nulls;
    bytes that are no baseline JPEG are an error. Columns with the names of the added ones give way."""
    names = ["note", "width", "height", payload_col, "thumb_hash"]

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        media = batch.column(1).to_pylist()
        rows: list[tuple] = []
        for part in _in_bounds([len(m or b"") for m in media]):
            parsed = [parse(m) if m is not None else [] for m in media[part]]
            images = iter(thumbnails([f for frames in parsed for f in frames]))
            for frames in parsed:
                if not frames:
                    rows.append((None,) * 5)
                    continue
                own = [next(images) for _ in frames]
                rows.append((
                    frames[0].note.decode("latin-1"), frames[0].width, frames[0].height, b"".join(x.tobytes() for x in own),
                    thumbnail_hash(np.vstack(own) if len({x.shape[1] for x in own}) == 1 else own[0]),
                ))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        return {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))}

    return add_columns(df, run, [media_col], f"note string, width int, height int, `{payload_col}` binary, thumb_hash string")

