"""Media columns: progressive JPEG to full-resolution RGB tensors, and a lossless carrier for bytes.

Decoding accumulates every spectral-selection and successive-approximation scan into coefficient
arrays, dequantises, inverse-transforms in numpy, upsamples chroma and converts to RGB. Scans whose
code table holds one symbol (as the carrier writes) are read as arrays; all others bit by bit.

The carrier keeps bytes in the format's unit, the quantised coefficient: a byte is one coefficient,
64 bytes are one 8 x 8 block, and blocks are dealt to Y, Cb and Cr of a 4:2:0 frame. Coefficients
survive the format exactly, so reading them back gives the bytes back. Null and empty texts are one
block of zeros; a row is a task's unit, so memory is bounded by the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_rows, col, pieces

BLOCK = 64
#: MCUs in a row of the carrier's frame.
ROW_MCUS = 64
#: Spectral bands of the carrier's AC scans.
BANDS = {0: ((1, 31), (32, 63)), 1: ((1, 63),), 2: ((1, 63),)}


def _zigzag() -> np.ndarray:
    """Natural (row-major) index of each zigzag position."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


def _idct_matrix() -> np.ndarray:
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.kron(c, c).astype(np.float32)


IDCT = _idct_matrix()


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.id, self.h, self.v, self.table = ident, h, v, table
        self.wide = self.high = self.stride = self.rows = 0
        self.coef = np.zeros((0, 64), np.int32)


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(data: np.ndarray) -> bytes:
    at = np.flatnonzero(data == 0xFF)
    return (np.insert(data, at + 1, 0) if len(at) else data).tobytes()


def _bits(rows: np.ndarray) -> np.ndarray:
    """Rows of bits end to end, the last byte filled with ones."""
    flat = rows.reshape(-1)
    if len(flat) % 8:
        flat = np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])
    return np.packbits(flat)


def carry(payload: bytes, n_bytes: int) -> bytes:
    """A progressive JPEG whose coefficients are the payload (a multiple of 64 bytes)."""
    blocks = len(payload) // BLOCK
    mcus = -(-blocks // 6)
    wide = min(mcus, ROW_MCUS)
    high = -(-mcus // wide)
    mcus = wide * high
    data = np.zeros((mcus * 6, BLOCK), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    head = [
        b"\xff\xd8",
        _segment(0xFE, struct.pack(">QQ", n_bytes, len(payload))),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        # One-symbol code tables: DC size 7; AC 0 (no run, size 7); AC 1 (end of block).
        _segment(0xC4, b"".join(bytes([t, 1]) + bytes(15) + bytes([s]) for t, s in ((0x00, 7), (0x10, 7), (0x11, 0)))),
    ]
    parts = np.split(data, [4 * mcus, 5 * mcus])

    def scan(c: int, first: int, last: int, ah: int, al: int, table: int, body: bytes) -> bytes:
        return _segment(0xDA, bytes([1, c + 1, table, first, last, ah << 4 | al])) + body

    out = head
    out.append(_segment(0xDD, b"\0\1"))
    for c, part in enumerate(parts):
        n = len(part)
        dc = np.empty((n, 3), np.uint8)
        dc[:, 0], dc[:, 1], dc[:, 2] = part[:, 0] >> 1, 0xFF, 0xD0 + (np.arange(n) & 7)
        out.append(scan(c, 0, 0, 0, 1, 0x00, dc.tobytes()[:-2]))
    out.append(_segment(0xDD, b"\0\0"))
    for c, part in enumerate(parts):
        out.append(scan(c, 0, 0, 1, 0, 0x00, _stuffed(_bits(part[:, 0] & 1))))
        # Byte b is coefficient b - 255 below 128, else b: its size is 8, and less its last bit 7.
        odd = ((part & 1) ^ (part < 128)).astype(np.uint8)
        top = np.where(part < 128, 127 - ((255 - part) >> 1), part >> 1).astype(np.uint8)
        for first, last in BANDS[c]:
            out.append(scan(c, first, last, 0, 1, 0x00, top[:, first : last + 1].tobytes()))
        for first, last in BANDS[c]:
            rows = np.zeros((len(part), last - first + 2), np.uint8)
            rows[:, 1:] = odd[:, first : last + 1]
            out.append(scan(c, first, last, 1, 0, 0x01, _stuffed(_bits(rows))))
    out.append(b"\xff\xd9")
    return b"".join(out)


def carried(frame: "Frame") -> bytes:
    """The payload of a carrier, from its coefficients."""
    data = np.concatenate([c.coef[:, ZIGZAG] for c in frame.components])
    dc = data[:, :1]
    u = dc >> 1
    t = np.where(u < 0, u + 127, u)
    out = np.where(data < 0, data + 255, data)
    out[:, :1] = (t << 1) | (dc & 1)
    return out.astype(np.uint8).tobytes()[: frame.payload]


# ---------------------------------------------------------------- reading


class Frame:
    def __init__(self) -> None:
        self.width = self.height = self.payload = self.n_bytes = 0
        self.components: list[Component] = []
        self.quant: dict[int, np.ndarray] = {}


class _Table:
    """A canonical code: (length, code) to symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = next(((n, s) for (n, _), s in self.codes.items()), None) if len(symbols) == 1 else None


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, len(data) * 8

    def get(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | (self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1 if self.at < self.size else 0)
            self.at += 1
        return v

    def symbol(self, table: _Table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.get(1)
            if (length, code) in table.codes:
                return table.codes[length, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.get(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _bit_rows(segment: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.unpackbits(segment, count=n * width).reshape(n, width)


def _unstuff(segment: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(segment[:-1] == 0xFF)
    return np.delete(segment, at + 1) if len(at) else segment


def parse(data: bytes) -> Frame:
    """All scans of a progressive (or sequential Huffman) JPEG accumulated into coefficients."""
    raw, frame, tables, restart, i = np.frombuffer(data, np.uint8), Frame(), {}, 0, 2
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    marks = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while i < len(data) - 1:
        marker = data[i + 1]
        if marker == 0xD9:
            break
        length = struct.unpack_from(">H", data, i + 2)[0]
        body = data[i + 4 : i + 2 + length]
        i += 2 + length
        if marker == 0xFE and len(body) == 16:
            frame.n_bytes, frame.payload = struct.unpack(">QQ", body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                q = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                frame.quant[body[0] & 15] = q
                body = body[65 + 64 * bool(wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _Table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC2):
            _, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
            frame.components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
            hm, vm = max(c.h for c in frame.components), max(c.v for c in frame.components)
            mx, my = -(-frame.width // (8 * hm)), -(-frame.height // (8 * vm))
            for c in frame.components:
                c.wide, c.high = -(-frame.width * c.h // (8 * hm)), -(-frame.height * c.v // (8 * vm))
                c.stride, c.rows = mx * c.h, my * c.v
                c.coef = np.zeros((c.stride * c.rows, 64), np.int32)
        elif marker == 0xDA:
            k = np.searchsorted(marks, i)
            end = int(marks[k]) if k < len(marks) else len(data)
            chosen = [(next(c for c in frame.components if c.id == body[1 + 2 * j]), body[2 + 2 * j]) for j in range(body[0])]
            ss, se, a = body[-3:]
            _scan(raw[i:end], frame, chosen, tables, restart, ss, se, a >> 4, a & 15)
            i = end
        while i < len(data) - 1 and (data[i] != 0xFF or data[i + 1] in (0, 0xFF)):
            i += 1
    return frame


def _scan(raw, frame, chosen, tables, restart, ss, se, ah, al) -> None:
    c, picks = chosen[0]
    whole = len(chosen) == 1 and c.wide == c.stride and c.high == c.rows
    n = len(c.coef)
    dc, ac = tables.get(picks >> 4), tables.get(0x10 | (picks & 15))
    if whole and ss == 0 == se and not ah and restart == 1 and dc and dc.only == (1, 7) and len(raw) == 3 * n - 2:
        v = raw[::3].astype(np.int32)
        c.coef[:, 0] = np.where(v < 64, v - 127, v) << al
    elif whole and ss == 0 == se and ah and not restart:
        c.coef[:, 0] |= _bit_rows(_unstuff(raw), n, 1)[:, 0].astype(np.int32) << al
    elif whole and ss and not ah and not restart and ac and ac.only == (1, 7) and len(raw) == n * (se - ss + 1):
        v = raw.reshape(n, -1).astype(np.int32)
        c.coef[:, ZIGZAG[ss : se + 1]] = np.where(v < 64, v - 127, v) << al if al == 0 else np.where(v < 64, -((127 - v) << al), v << al)
    elif whole and ss and ah and not restart and ac and ac.only == (1, 0) and (c.coef[:, ZIGZAG[ss : se + 1]] != 0).all():
        more = _bit_rows(_unstuff(raw), n, se - ss + 2)[:, 1:].astype(np.int32) << al
        at = ZIGZAG[ss : se + 1]
        old = c.coef[:, at]
        c.coef[:, at] = np.where(old < 0, old - more, old + more)
    else:
        _scan_bits(raw, frame, chosen, tables, restart, ss, se, ah, al)


def _units(frame: Frame, chosen) -> Iterator[list[tuple[Component, int, int]]]:
    """(component, picks, block) of each MCU in order."""
    if len(chosen) == 1:
        c, picks = chosen[0]
        for y in range(c.high):
            for x in range(c.wide):
                yield [(c, picks, y * c.stride + x)]
        return
    mx, my = frame.components[0].stride // frame.components[0].h, frame.components[0].rows // frame.components[0].v
    for y in range(my):
        for x in range(mx):
            yield [(c, p, (y * c.v + v) * c.stride + x * c.h + h) for c, p in chosen for v in range(c.v) for h in range(c.h)]


def _scan_bits(raw, frame, chosen, tables, restart, ss, se, ah, al) -> None:
    """Any scan, bit by bit."""
    rst = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if len(raw) > 1 else []
    bounds = [0, *[int(x) + 2 for x in rst], len(raw) + 2]
    segments = iter([_unstuff(raw[a : b - 2]).tobytes() for a, b in zip(bounds, bounds[1:])])
    bits, run, last = _Bits(next(segments)), 0, {}
    for k, unit in enumerate(_units(frame, chosen)):
        if restart and k and k % restart == 0:
            bits, run, last = _Bits(next(segments, b"")), 0, {}
        for c, picks, block in unit:
            row = c.coef[block]
            k0 = ss
            if ss == 0:
                if ah:
                    row[0] |= bits.get(1) << al
                else:
                    diff = bits.value(bits.symbol(tables[picks >> 4]))
                    last[c.id] = last.get(c.id, 0) + diff
                    row[0] = last[c.id] << al
                if se == 0:
                    continue
                k0 = 1
            table = tables[0x10 | (picks & 15)]
            run = _refine(bits, row, table, k0, se, al, run) if ah else _first(bits, row, table, k0, se, al, run)


def _first(bits, row, table, k, se, al, run) -> int:
    if run:
        return run - 1
    while k <= se:
        rs = bits.symbol(table)
        r, s = rs >> 4, rs & 15
        if s == 0:
            if r < 15:
                return (1 << r) + bits.get(r) - 1
            k += 16
            continue
        k += r
        v = bits.value(s)
        row[ZIGZAG[k]] = v << al if v >= 0 else -(-v << al)
        k += 1
    return 0


def _refine(bits, row, table, k, se, al, run) -> int:
    one = 1 << al

    def correct(at: int) -> None:
        if bits.get(1) and not abs(int(row[at])) & one:
            row[at] += one if row[at] > 0 else -one

    if not run:
        while k <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            new = 0
            if s:
                new = one if bits.get(1) else -one
            elif r < 15:
                run = (1 << r) + bits.get(r)
                break
            while k <= se:
                at = ZIGZAG[k]
                if row[at]:
                    correct(at)
                elif r == 0:
                    if new:
                        row[at] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
    if run:
        while k <= se:
            if row[ZIGZAG[k]]:
                correct(ZIGZAG[k])
            k += 1
        run -= 1
    return run


def rgb(frame: Frame) -> np.ndarray:
    """Height x width x 3 bytes at full resolution."""
    hm, vm = max(c.h for c in frame.components), max(c.v for c in frame.components)
    planes = []
    for c in frame.components:
        natural = np.ones(64, np.float32)
        natural[ZIGZAG] = frame.quant[c.table]
        spatial = (c.coef * natural).astype(np.float32) @ IDCT
        plane = spatial.reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
        if vm // c.v > 1:
            plane = plane.repeat(vm // c.v, 0)
        if hm // c.h > 1:
            plane = plane.repeat(hm // c.h, 1)
        planes.append(np.clip(plane[: frame.height, : frame.width] + 128, 0, 255))
    if len(planes) == 1:
        return np.rint(planes[0]).astype(np.uint8)[..., None].repeat(3, 2)
    y, cb, cr = planes
    cb, cr = cb - 128, cr - 128
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + 1.402 * cr + 0.5, 0, 255)
    out[..., 1] = np.clip(y - 0.344136 * cb - 0.714136 * cr + 0.5, 0, 255)
    out[..., 2] = np.clip(y + 1.772 * cb + 0.5, 0, 255)
    return out


def decode(data: bytes) -> np.ndarray:
    return rgb(parse(data))


def feature(tensor: np.ndarray) -> str:
    """Size, and the mean of each channel in whole units and 256ths."""
    h, w, _ = tensor.shape
    means = tensor.reshape(-1, 3).sum(0, dtype=np.int64) * 256 // (h * w)
    return f"{w}x{h}:" + ",".join(f"{m // 256}.{m % 256}" for m in means.tolist())


# ---------------------------------------------------------------- on DataFrames


def tensors(media: DataFrame) -> DataFrame:
    """media(id, data binary) to (id, height, width, rgb binary); undecodable or null data give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "data"):
            for ident, data in zip(col(batch, "id"), col(batch, "data").to_pylist()):
                try:
                    t = decode(data) if data else None
                except (ValueError, IndexError, KeyError, struct.error):
                    t = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ident.as_py()], pa.int64()), pa.array([None if t is None else t.shape[0]], pa.int32()), pa.array([None if t is None else t.shape[1]], pa.int32()), pa.array([None if t is None else t.tobytes()], pa.binary())],
                    ["id", "height", "width", "rgb"],
                )

    return media.select(media["id"], media["data"]).mapInArrow(run, "id long, height int, width int, rgb binary")


def carry_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """docs(doc_id, text) stored as carrier images, read back and featurised."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if keep_media:
        schema += ", media binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_media
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            body, at = byte_rows(col(batch, "text"))
            rows = []
            for k, doc in enumerate(col(batch, "doc_id").to_pylist()):
                text = body[at[k] : at[k + 1]].tobytes()
                payload = text + bytes(-len(text) % BLOCK or BLOCK * (not text))
                media = carry(payload, len(text))
                frame = parse(media)
                back = carried(frame)
                rows.append((doc, frame.n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb(frame)), *[media] * keep_media))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, schema)
