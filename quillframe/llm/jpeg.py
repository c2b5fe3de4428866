"""Media columns: progressive JPEG in numpy.

The decoder takes any Huffman-coded progressive JPEG: it accumulates all scans
into coefficient arrays, transforms them back, brings chroma to full
resolution and gives RGB tensors. The encoder stores bytes without loss: a
byte is one quantised coefficient, which is the format's own unit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillframe.llm.common import map_batches, pieces

UNIT = 192
PAD = 32


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Rows: what each coefficient in zigzag order adds to the 64 samples, in 2**-13; whole numbers keep sums exact."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.round(np.kron(one, one) * 8192)[ZIGZAG].astype(np.float64)


BASIS = _basis()


@dataclass
class _Huffman:
    """Canonical code: for each 16-bit window the symbol and the code's length (0: none)."""

    symbols: list[int]
    lengths: list[int]
    symbol_at: np.ndarray = field(init=False)
    length_at: np.ndarray = field(init=False)

    def __post_init__(self):
        self.symbol_at, self.length_at = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
        code = size = 0
        for s, n in zip(self.symbols, self.lengths, strict=True):
            code <<= n - size
            size = n
            at = code << 16 - n
            self.symbol_at[at : at + (1 << 16 - n)], self.length_at[at : at + (1 << 16 - n)] = s, n
            code += 1


@lru_cache(maxsize=64)
def _huffman(counts: bytes, symbols: bytes) -> _Huffman:
    return _Huffman(list(symbols), [k for k, c in enumerate(counts, 1) for _ in range(c)])


class _Bits:
    """The entropy-coded bytes of one restart interval, read from the highest bit on; past the end come ones."""

    def __init__(self, data: bytes):
        self.n = len(data) * 8
        self.raw = np.frombuffer(data + b"\xff" * 4, dtype=np.uint8)
        self._words = None
        self.at = 0

    @property
    def words(self) -> np.ndarray:
        """24 bits from each byte on."""
        if self._words is None:
            raw = self.raw.astype(np.uint32)
            self._words = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        return self._words

    def window(self, p: np.ndarray) -> np.ndarray:
        """The 16 bits from each of the positions."""
        if len(p) and p.max() > self.n + 8:
            p = np.minimum(p, self.n + 8)
        return self.words[p >> 3] >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF

    def peek(self) -> int:
        p = min(self.at, self.n + 8)
        return int.from_bytes(self.raw[p >> 3 : (p >> 3) + 3].tobytes(), "big") >> 8 - (p & 7) & 0xFFFF

    def take(self, n: int) -> int:
        v = self.peek() >> 16 - n if n else 0
        self.at += n
        return v

    def symbol(self, h: _Huffman) -> int:
        w = self.peek()
        if not h.length_at[w]:
            raise ValueError("a code that the table doesn't have")
        self.at += int(h.length_at[w])
        return int(h.symbol_at[w])

    def ones(self, n: int) -> np.ndarray:
        """The next n bits, one each."""
        a, self.at = self.at, self.at + n
        got = np.unpackbits(self.raw[a >> 3 : self.at + 7 >> 3])[a & 7 : (a & 7) + n]
        return got if len(got) == n else np.concatenate((got, np.ones(n - len(got), dtype=np.uint8)))


@dataclass
class _Component:
    id: int
    h: int
    v: int
    table: int
    rows: int = 0  # of blocks, as coded in scans of this component alone
    cols: int = 0
    stride: int = 0  # of blocks a row, with those that fill up the last unit
    coefs: np.ndarray | None = None


@dataclass
class Image:
    width: int
    height: int
    components: list[_Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""

    def rgb(self) -> np.ndarray:
        """height x width x 3 bytes; one component gives grey."""
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        planes = []
        for c in self.components:
            s = samples(c.coefs * self.quant[c.table][None, :])
            rows = len(c.coefs) // c.stride
            plane = s.reshape(rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, c.stride * 8)
            planes.append(np.repeat(np.repeat(plane, v // c.v, axis=0), h // c.h, axis=1)[: self.height, : self.width])
        return colours(np.stack(planes * 3 if len(planes) == 1 else planes, axis=-1), grey=len(planes) == 1)


def samples(coefs: np.ndarray) -> np.ndarray:
    """Blocks of 64 dequantised coefficients in zigzag order to 64 samples from 0 to 255."""
    return np.clip(np.floor((coefs.astype(np.float64) @ BASIS + 4096) / 8192) + 128, 0, 255).astype(np.int32)


def colours(ycc: np.ndarray, grey: bool = False) -> np.ndarray:
    """... x 3 samples of Y, Cb, Cr to R, G, B bytes, in whole numbers of 2**-16."""
    if grey:
        return ycc.astype(np.uint8)
    y, cb, cr = ycc[..., 0] << 16, ycc[..., 1] - 128, ycc[..., 2] - 128
    out = np.stack((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb), axis=-1)
    return np.clip((out + 32768) >> 16, 0, 255).astype(np.uint8)


def parse(data: bytes) -> Image:
    """The coefficients of a progressive JPEG, after all its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, image, quant, tables, restart, comment = 2, None, {}, {}, 0, b""
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                quant[n] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                tables[body[0]] = _huffman(counts, body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC2:
            image = _frame(body, quant)
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            comment = body
        elif kind == 0xDA:
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            _scan(image, body, tables, restart, data[at:end])
            at = end
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only Huffman-coded progressive frames are read")
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _frame(body: bytes, quant: dict[int, np.ndarray]) -> Image:
    _, height, width, n = struct.unpack_from(">BHHB", body)
    parts = [_Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
    h, v = max(c.h for c in parts), max(c.v for c in parts)
    for c in parts:
        c.cols, c.rows = -(-width * c.h // (8 * h)), -(-height * c.v // (8 * v))
        c.stride = -(-width // (8 * h)) * c.h
        c.coefs = np.zeros((c.stride * -(-height // (8 * v)) * c.v, 64), dtype=np.int32)
    return Image(width, height, parts, quant)


def _scan(image: Image, body: bytes, tables: dict[int, _Huffman], restart: int, data: bytes) -> None:
    n = body[0]
    parts = [(next(c for c in image.components if c.id == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if n > 1:
        h, v = max(c.h for c in image.components), max(c.v for c in image.components)
        wide, tall = -(-image.width // (8 * h)), -(-image.height // (8 * v))
        unit = np.arange(wide * tall)
        blocks = [
            (k, (unit // wide * c.v + y) * c.stride + unit % wide * c.h + x) for k, (c, _) in enumerate(parts) for y in range(c.v) for x in range(c.h)
        ]
    else:
        c = parts[0][0]
        unit = np.arange(c.rows * c.cols)
        blocks = [(0, unit // c.cols * c.stride + unit % c.cols)]
    at, step = 0, restart or len(unit)
    chunks = _split_restarts(data) if restart else [data]
    for raw in chunks:
        bits, some = _Bits(raw.replace(b"\xff\x00", b"\xff")), [(k, b[at : at + step]) for k, b in blocks]
        at += step
        if not len(some[0][1]):
            break
        if first == 0:
            _dc(bits, parts, some, tables, high, low)
        elif high == 0:
            _ac_first(bits, parts[0][0].coefs, some[0][1], tables[16 | parts[0][1] & 15], first, last, low)
        else:
            _ac_refine(bits, parts[0][0].coefs, some[0][1], tables[16 | parts[0][1] & 15], first, last, low)


def _split_restarts(data: bytes) -> list[bytes]:
    out, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    return [*out, data[start:]]


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Values of so many bits; those with a leading 0 are negative."""
    v = v.astype(np.int64)
    return np.where((size > 0) & (v < 1 << np.maximum(size, 1) - 1), v - (1 << size) + 1, v)


def _dc(bits: _Bits, parts: list, blocks: list, tables: dict[int, _Huffman], high: int, low: int) -> None:
    n = len(blocks[0][1])
    if high:
        found = bits.ones(n * len(blocks)).reshape(n, len(blocks)).astype(np.int32)
        for j, (k, b) in enumerate(blocks):
            parts[k][0].coefs[b, 0] |= found[:, j] << low
        return
    used = [tables[parts[k][1] >> 4] for k, _ in blocks]
    every = bits.window(np.arange(bits.n + 1))
    steps = {}
    for t in used:
        if id(t) not in steps:
            steps[id(t)] = (np.arange(bits.n + 1) + t.length_at[every] + t.symbol_at[every]).tolist()
    at, place, last = 0, np.zeros((n, len(blocks)), dtype=np.int64), bits.n
    chain = [steps[id(t)] for t in used]
    where = []
    for _ in range(n):
        for s in chain:
            where.append(at)
            at = s[at] if at <= last else at
    place = np.array(where, dtype=np.int64).reshape(n, len(blocks))
    diffs: dict[int, list[np.ndarray]] = {}
    for j, (k, _) in enumerate(blocks):
        w = bits.window(place[:, j])
        size = used[j].symbol_at[w].astype(np.int64)
        head = place[:, j] + used[j].length_at[w]
        diffs.setdefault(k, []).append(_signed(bits.window(head).astype(np.int64) >> 16 - size, size))
    for k, d in diffs.items():
        value = np.cumsum(np.stack(d, axis=1).ravel()).reshape(n, len(d))
        for i, b in enumerate(x for j, x in blocks if j == k):
            parts[k][0].coefs[b, 0] = value[:, i] << low


def _ac_first(bits: _Bits, coefs: np.ndarray, blocks: np.ndarray, h: _Huffman, first: int, last: int, low: int) -> None:
    if len(h.symbols) == 1 and 0 < h.symbols[0] < 16:
        # one symbol for all: no coefficient is zero and each has as many bits
        size, step, n = h.symbols[0], h.symbols[0] + h.lengths[0], len(blocks) * (last - first + 1)
        if step == 8 and bits.at == 0 and n * 8 <= bits.n:
            v = bits.raw[:n] & np.uint8((1 << size) - 1)
        else:
            v = bits.window(bits.at + np.arange(n) * step + h.lengths[0]) >> np.uint32(16 - size)
        value = v.astype(np.int32)
        value -= ((1 << size) - 1) * (value < 1 << size - 1).astype(np.int32)
        coefs[blocks, first : last + 1] = value.reshape(len(blocks), -1) << low
        bits.at += n * step
        return
    run = 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = bits.symbol(h)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                v = bits.take(size)
                coefs[b, k] = (v if v >> size - 1 else v - (1 << size) + 1) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _ac_refine(bits: _Bits, coefs: np.ndarray, blocks: np.ndarray, h: _Huffman, first: int, last: int, low: int) -> None:
    def correct(some: np.ndarray, start: int) -> None:
        """One bit for every coefficient that isn't zero, from start on in the first of the blocks."""
        part = coefs[some, first : last + 1]
        on = part != 0
        if start > first:
            on[0, : start - first] = False
        n = int(np.count_nonzero(on))
        got = bits.ones(n).astype(np.int32) << low
        if n == part.size:
            part += np.sign(part) * got.reshape(part.shape)
        else:
            part[on] += np.sign(part[on]) * got
        coefs[some, first : last + 1] = part

    at = 0
    while at < len(blocks):
        b, k, run = int(blocks[at]), first, 0
        while k <= last:
            s = bits.symbol(h)
            zeros, size = s >> 4, s & 15
            new = 0
            if size:
                new = (1 if bits.take(1) else -1) << low
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= last:
                if c := int(coefs[b, k]):
                    if bits.take(1):
                        coefs[b, k] += (1 if c > 0 else -1) << low
                elif zeros:
                    zeros -= 1
                else:
                    coefs[b, k] = new
                    k += 1
                    break
                k += 1
        if run:
            correct(blocks[at : at + run], k)
        at += run or 1


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _pack(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Single bits of values of so many bits each."""
    owner = np.repeat(np.arange(len(values)), sizes)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (values[owner] >> (sizes[owner] - 1 - inside) & 1).astype(np.uint8)


def _close(bits: np.ndarray) -> bytes:
    """Bits to stuffed bytes, the last filled up with ones."""
    spare = -len(bits) % 8
    return np.packbits(np.concatenate((bits, np.ones(spare, dtype=np.uint8)))).tobytes().replace(b"\xff", b"\xff\x00")


_TABLES = (
    _segment(0xC4, bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)]))  # sizes of DC differences: four bits each
    + _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0x07]))  # a coefficient of seven bits: one bit
    + _segment(0xC4, bytes([0x11, 0, 0, 0, 15, *[0] * 12, *(k << 4 for k in range(15))]))  # ends of block runs
)
_BANDS = ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63))  # component, first and last coefficient


def store_bytes(payload: bytes) -> bytes:
    """payload, of a positive multiple of 192 bytes, as a progressive JPEG without subsampling.

    Byte b becomes the coefficient b, or b - 255 if below 128: all take eight
    bits and none is zero. Three blocks make a unit; units that fill up the
    last row hold spaces. The comment has payload's length.
    """
    n = len(payload) // UNIT
    if n < 1 or len(payload) % UNIT:
        raise ValueError(f"a positive multiple of {UNIT} bytes is wanted")
    wide = min(8191, max(1, int(np.ceil(np.sqrt(n)))))
    tall = -(-n // wide)
    if tall > 8191:
        raise ValueError("beyond the largest picture")
    raw = np.frombuffer(payload + bytes([PAD]) * ((wide * tall - n) * UNIT), dtype=np.uint8).reshape(-1, 3, 64)
    head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(payload)) + _segment(0xDB, bytes([0, *[1] * 64]))
    head += _segment(0xC2, struct.pack(">BHHB", 8, tall * 8, wide * 8, 3) + b"".join(bytes([k, 0x11, 0]) for k in (1, 2, 3))) + _TABLES
    out = [head]

    def scan(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> None:
        body = bytes([len(parts), *(x for p in parts for x in p), first, last, high << 4 | low])
        out.extend((_segment(0xDA, body), data))

    dc = raw[:, :, 0].astype(np.int64)
    value = np.where(dc >= 128, dc, dc - 255)
    diff = np.diff(value >> 1, axis=0, prepend=0).ravel()
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)  # bits of the magnitude
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    scan([(1, 0x00), (2, 0x00), (3, 0x00)], 0, 0, 0, 1, _close(_pack(size << size | extra, size + 4)))
    for k, a, b in _BANDS:
        scan([(k + 1, 0x00)], a, b, 0, 1, (raw[:, k, a : b + 1] >> 1).tobytes())
    scan([(1, 0x00), (2, 0x00), (3, 0x00)], 0, 0, 1, 0, _close((value & 1).astype(np.uint8).ravel()))
    flip = (raw & 1) ^ (raw < 128)
    for k, a, b in _BANDS:
        parts = []
        for at in range(0, len(raw), 32767):
            some = flip[at : at + 32767, k, a : b + 1]
            e = len(some).bit_length() - 1
            parts += [_pack(np.array([e << e | len(some) - (1 << e)]), np.array([4 + e])), some.ravel()]
        scan([(k + 1, 0x01)], a, b, 1, 0, _close(np.concatenate(parts)))
    return b"".join([*out, b"\xff\xd9"])


def stored_payload(image: Image) -> bytes:
    """What store_bytes() was given, out of the coefficients."""
    n = int(image.comment.removeprefix(b"payload "))
    c = np.stack([c.coefs for c in image.components], axis=1)
    return np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()[:n]


def padded(text: bytes | None) -> bytes:
    """text with spaces after it, up to the least positive multiple of 192 bytes."""
    text = text or b""
    return text + bytes([PAD]) * (UNIT - len(text) if not text else -len(text) % UNIT)


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the stored form of every row's text as a binary column.

    Null texts count as empty ones, which are stored as 192 spaces; repeated
    rows and null doc_ids are kept, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            media = [store_bytes(padded(t)) for t in texts]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def decode_media(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows of media with height, width and rgb (height x width x 3 bytes) in place of the JPEG column; null stays null."""
    from pyspark.sql import types as T

    rest = [f for f in media.schema.fields if f.name not in (column, "height", "width", "rgb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, column):
            found = [None if x is None else parse(x).rgb() for x in part.column(column).to_pylist()]
            size = [[None if x is None else x.shape[k] for x in found] for k in (0, 1)]
            yield pa.record_batch(
                [*(part.column(f.name) for f in rest), pa.array(size[0], pa.int32()), pa.array(size[1], pa.int32()), pa.array([None if x is None else x.tobytes() for x in found], pa.binary())],
                [*(f.name for f in rest), "height", "width", "rgb"],
            )

    new = [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())]
    return map_batches(media.select(*(f"`{f.name}`" for f in rest), column), run, T.StructType([*rest, *new]))


def feature(rgb: np.ndarray) -> str:
    """Size and sums of the colours of a tensor."""
    total = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{total[0]}:{total[1]}:{total[2]}"


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every row of docs.

    Texts are stored by encode_texts() and all else is computed from the
    stored bytes. A null text counts as empty, and an empty one is stored as
    192 spaces. Repeated rows and null doc_ids are kept; other columns are not
    read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "media"):
            rows = []
            for m in part.column("media").to_pylist():
                image = parse(m)
                p = stored_payload(image)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(image.rgb())))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch(
                [part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return map_batches(encode_texts(docs), run, schema)
