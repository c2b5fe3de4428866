import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import jpeg
from quillframe.llm.queries import op3_progressive_jpeg


class Writer:
    """A plain progressive encoder: codes of eight bits for all symbols, bits as a list."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def signed(self, v):
        n = abs(v).bit_length()
        return n, v if v > 0 else v + (1 << n) - 1

    def close(self):
        self.bits += [1] * (-len(self.bits) % 8)
        data = bytes(int("".join(map(str, self.bits[k : k + 8])), 2) for k in range(0, len(self.bits), 8))
        self.bits = []
        return data.replace(b"\xff", b"\xff\x00")


SYMBOLS = sorted({*range(12), 0xF0, *(r << 4 | s for r in range(16) for s in range(11)), *(r << 4 for r in range(15))})
CODE = {s: k for k, s in enumerate(SYMBOLS)}  # eight bits each


def segment(kind, body):
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def dc_scan(order, coefs, low, high):
    w, last = Writer(), {}
    for k, b in order:
        v = int(coefs[k][b][0]) >> low
        if high:
            w.put(v & 1, 1)
            continue
        n, bits = w.signed(v - last.get(k, 0)) if v != last.get(k, 0) else (0, 0)
        w.put(CODE[n], 8)
        w.put(bits, n)
        last[k] = v
    return w


def shifted(v, low):
    return (abs(v) >> low) * (1 if v > 0 else -1)


def ac_first(blocks, first, last, low):
    w, run = Writer(), 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.put(CODE[n << 4], 8)
            w.put(run - (1 << n), n)
            run = 0

    for b in blocks:
        zeros = 0
        for k in range(first, last + 1):
            if v := shifted(int(b[k]), low):
                flush()
                while zeros > 15:
                    w.put(CODE[0xF0], 8)
                    zeros -= 16
                n, bits = w.signed(v)
                w.put(CODE[zeros << 4 | n], 8)
                w.put(bits, n)
                zeros = 0
            else:
                zeros += 1
        run += zeros > 0
        if run == 0x7FFF:
            flush()
    flush()
    return w


def ac_refine(blocks, first, last, low):
    """An end-of-band code for each block that needs one: correction bits follow it."""
    w = Writer()
    for b in blocks:
        mags = [abs(int(b[k])) >> low for k in range(first, last + 1)]
        end = max((k for k, m in enumerate(mags) if m == 1), default=-1)
        zeros, pending = 0, []
        for k, m in enumerate(mags):
            if m > 1:
                pending.append(m & 1)
            elif m == 1:
                while zeros > 15:
                    # sixteen zeros end before this place; corrections among them go along
                    seen, cut = 0, 0
                    for x in range(start, k):  # noqa: F821
                        if mags[x] == 0:
                            seen += 1
                            if seen == 16:
                                cut = x + 1
                                break
                    w.put(CODE[0xF0], 8)
                    some = [mags[x] & 1 for x in range(start, cut) if mags[x] > 1]
                    w.bits += some
                    pending = pending[len(some) :]
                    start, zeros = cut, zeros - 16
                w.put(CODE[zeros << 4 | 1], 8)
                w.put(int(b[first + k] > 0), 1)
                w.bits += pending
                zeros, pending, start = 0, [], k + 1
            else:
                zeros += 1
            if k == 0 and m != 1:
                start = 0
        if end < len(mags) - 1:
            w.put(CODE[0], 8)
            w.bits += pending
    return w


def picture(width, height, factors, coefs, quant, restart=0):
    """A progressive JPEG of coefficients (component, row of blocks, column of blocks, 64 in zigzag order)."""
    h, v = max(a for a, _ in factors), max(b for _, b in factors)
    out = [b"\xff\xd8", segment(0xDB, bytes([0, *quant]))]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([k + 1, a << 4 | b, 0]) for k, (a, b) in enumerate(factors))))
    counts = bytes([0] * 7 + [len(SYMBOLS)] + [0] * 8)
    for where in (0x00, 0x10):
        out.append(segment(0xC4, bytes([where]) + counts + bytes(SYMBOLS)))
    if restart:
        out.append(segment(0xDD, struct.pack(">H", restart)))
    wide, tall = -(-width // (8 * h)), -(-height // (8 * v))
    units = [
        [(k, (uy * b + y, ux * a + x)) for k, (a, b) in enumerate(factors) for y in range(b) for x in range(a)] for uy in range(tall) for ux in range(wide)
    ]

    def scan(parts, first, last, high, low, chunks):
        out.append(segment(0xDA, bytes([len(parts), *(x for p in parts for x in (p + 1, 0)), first, last, high << 4 | low])))
        for n, c in enumerate(chunks):
            out.append((bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + c.close())

    step = restart or 10**9
    every = range(len(factors))
    for high, low in ((0, 1), (1, 0)):
        scan(every, 0, 0, high, low, [dc_scan([x for u in units[at : at + step] for x in u], coefs, low, high) for at in range(0, len(units), step)])
        for k, (a, b) in enumerate(factors):
            rows, cols = -(-height * b // (8 * v)), -(-width * a // (8 * h))
            blocks = [coefs[k][y, x] for y in range(rows) for x in range(cols)]
            for first, last in ((1, 5), (6, 63)):
                f = ac_refine if high else ac_first
                scan([k], first, last, high, low, [f(blocks[at : at + step], first, last, low) for at in range(0, len(blocks), step)])
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize(("width", "height", "factors", "restart"), [(40, 24, [(1, 1)] * 3, 0), (37, 21, [(2, 2), (1, 1), (1, 1)], 0), (50, 9, [(2, 1), (1, 1), (1, 1)], 2), (17, 33, [(1, 1)], 3)])
def test_scans_accumulate(width, height, factors, restart):
    rng = np.random.default_rng(width)
    h, v = max(a for a, _ in factors), max(b for _, b in factors)
    coefs = []
    for a, b in factors:
        shape = (-(-height // (8 * v)) * b, -(-width // (8 * h)) * a, 64)
        c = np.where(rng.random(shape) < 0.15, rng.integers(-60, 61, shape), 0)
        c[..., 0] = rng.integers(-200, 200, shape[:2])
        # blocks that only fill up the last unit aren't in scans of one component
        c[-(-height * b // (8 * v)) :, :, 1:] = 0
        c[:, -(-width * a // (8 * h)) :, 1:] = 0
        coefs.append(c)
    quant = rng.integers(1, 9, 64).tolist()
    image = jpeg.parse(picture(width, height, factors, coefs, quant, restart))
    for c, found in zip(coefs, image.components, strict=True):
        assert (found.coefs == c.reshape(-1, 64)).all()
    rgb = image.rgb()
    assert rgb.shape == (height, width, 3)
    # samples by the transform's definition
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    planes = []
    for (a, b), c in zip(factors, coefs, strict=True):
        natural = np.zeros(c.shape)
        natural[..., jpeg.ZIGZAG] = c * np.array(quant)
        s = np.einsum("yxuv,ui,vj->yixj", natural.reshape(*c.shape[:2], 8, 8), basis, basis)
        s = np.clip(s.reshape(c.shape[0] * 8, -1) + 128, 0, 255)
        planes.append(np.kron(s, np.ones((v // b, h // a)))[:height, :width])
    if len(planes) == 3:
        y, cb, cr = planes
        want = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=-1)
    else:
        want = np.stack(planes * 3, axis=-1)
    assert np.abs(rgb - np.clip(want, 0, 255)).max() <= 2.5


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG.tolist()) == list(range(64))


@pytest.mark.parametrize("n", [1, 2, 7, 100, 5000])
def test_any_bytes_round_trip(n):
    rng = random.Random(n)
    for payload in (rng.randbytes(n * 192), b"\xff" * (n * 192), b"\0" * (n * 192), bytes([127, 128, 255, 0] * (n * 48))):
        image = jpeg.parse(jpeg.store_bytes(payload))
        assert jpeg.stored_payload(image) == payload
    with pytest.raises(ValueError):
        jpeg.store_bytes(payload + b"x")


def test_refused():
    for bad in (b"", b"GIF89a", jpeg.store_bytes(b"x" * 192).replace(b"\xff\xc2", b"\xff\xc0", 1), b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.parse(bad)


def expected(text):
    raw = (text or "").encode()
    payload = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, "a"), (4, "x" * 192), (5, "é" * 97), (None, "null"), (6, "again"), (6, "again"), (7, "long " * 60_000), (8, "\0\x7f\u0080ÿ")]
    out = jpeg.media_digests(docs(rows)).collect()
    assert sorted(repr(tuple(r)[:5]) for r in out) == sorted(repr((i, *expected(t))) for i, t in rows)
    by = {}
    for r in out:
        by.setdefault(r["payload_sha256"], set()).add(tuple(r)[3:])
    assert all(len(x) == 1 for x in by.values()) and jpeg.media_digests(docs([])).count() == 0


def test_media_table(docs):
    media = jpeg.encode_texts(docs([(1, "hello"), (2, None)]))
    out = jpeg.decode_media(media.unionByName(media.selectExpr("9L as doc_id", "n_bytes", "cast(null as binary) as media").limit(1))).collect()
    assert sorted((r["doc_id"], r["height"], r["width"]) for r in out if r["doc_id"] != 9) == [(1, 8, 8), (2, 8, 8)]
    assert [r["rgb"] for r in out if r["doc_id"] == 9] == [None] and all(len(r["rgb"]) == 192 for r in out if r["doc_id"] != 9)


def test_query(spark, small):
    out = {r["doc_id"]: r for r in op3_progressive_jpeg(spark, "/root/testdata/sf0.001").collect()}
    assert {i: tuple(r)[1:5] for i, r in out.items()} == {r[0]: expected(r[1]) for r in small("documents")}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in jpeg.decode_media(jpeg.encode_texts(docs).select("doc_id", "media", F.col("media").alias("stored")), "media").collect():
        rgb, m = np.frombuffer(r["rgb"], np.uint8).reshape(-1, 3), bytes(r["stored"])
        sums = ":".join(str(int(x)) for x in rgb.sum(axis=0, dtype=np.int64))
        got = out[r["doc_id"]]
        assert (got["media_bytes"], got["media_sha256"], got["feature"]) == (len(m), hashlib.sha256(m).hexdigest(), f"{r['width']}x{r['height']}:{sums}")
