"""Suffix-array dedup: every byte that a repeated 400-byte string covers goes.

Suffixes are sampled at anchors: each window of 400 bytes picks the least
8-byte hash among its first 256 places, so equal windows pick equal anchors at
equal offsets, and a window is its anchor's left and right context. Anchors
whose right context occurs once settle at once, and so do groups of anchors
with one whole context. The suffixes of the others are sorted by a distributed
merge: sorted, front-coded runs are exchanged by ranges and combined with
loser trees that never compare known prefixes again. Neighbours' common
prefixes, to the right and (within a group) to the left, then say exactly
which windows repeat.

Passages of over 50 words that another document holds too are told beside
that, as they may have fewer than 400 bytes: windows of 51 words pick anchors
in the same way, and hashes of the windows around anchors that repeat decide.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import drop_table, map_batches, pieces, table
from quillframe.llm.decontam import mixed, shingle_hashes, word_hashes

LENGTH = 400
#: Words of a passage, and places of such a window that may be its anchor.
PASSAGE = 51
PLACES = 40
#: Places of a window that may be its anchor; the rest of it is right context whatever the place.
SPREAD = 256
CORE = LENGTH - SPREAD + 1
#: A group of more different contexts is settled by hashes of its windows, dealt out over all tasks.
MAX_GROUP = 4096
#: Rows from which the ranges of the exchange are read.
SAMPLE = 20_000
#: Bytes of suffixes in one sorted run.
RUN_BYTES = 24 << 20
_CHUNK = 8 << 20


def anchors(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: place, and the least and greatest offset of the windows that picked it."""
    parts = [_anchors(b[at : at + _CHUNK + LENGTH - 1], at) for at in range(0, max(1, len(b) - LENGTH + 1), _CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(b: bytes, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(b)
    if n < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 3
    v = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=b, strides=(1,)).copy()
    v *= np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    # 40 bits of the hash, then the place: the least is the leftmost of equals
    v &= np.uint64(0xFFFFFFFFFF000000)
    v |= np.arange(n - 7, dtype=np.uint64)
    k = 1
    while k < SPREAD:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    at = (v[: n - LENGTH + 1] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    place = at[first]
    return place + base, place - last, place - first


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, known up to some length."""
    n = min(len(a), len(b))
    if (x := int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")) == 0:
        return n
    return n - (x.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> bytes:
    """Sorted suffixes as common-prefix lengths and remaining tails, compressed."""
    shared, tails, last = [], [], b""
    for s in suffixes:
        k = common(last, s)
        shared.append(k)
        tails.append(s[k:])
        last = s
    body = np.array(shared, dtype="<u2").tobytes() + np.array([len(t) for t in tails], dtype="<u2").tobytes() + b"".join(tails)
    return struct.pack("<I", len(suffixes)) + zstandard.compress(body, 1)


def front_decode(blob: bytes) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the one before, suffix) of a run."""
    n, body = struct.unpack_from("<I", blob)[0], zstandard.decompress(blob[4:])
    shared, sizes = np.frombuffer(body, "<u2", n).tolist(), np.frombuffer(body, "<u2", n, 2 * n).tolist()
    at, last = 4 * n, b""
    for k, size in zip(shared, sizes, strict=True):
        last = last[:k] + body[at : at + size]
        at += size
        yield k, last


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, suffix).

    Each run's head carries the length it shares with the last suffix given
    out. Of two heads the one that shares more is the smaller; only if they
    share equally are bytes compared, from there on, and the loser keeps what
    it shares with the winner.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.head: list[bytes | None] = [None] * self.k
        self.shared = [-1] * self.k
        for i in range(len(runs)):
            self._next(i)
            if self.head[i] is not None:
                self.shared[i] = 0
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._enter(i)

    def _next(self, i: int) -> None:
        self.shared[i], self.head[i] = next(self.runs[i], (-1, None))

    def _enter(self, i: int) -> None:
        """First round: a head waits at the first free node on its way up."""
        node = (i + self.k) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            i = self._play(node, i)
            node //= 2
        self.winner = i

    def _play(self, node: int, i: int) -> int:
        """The winner of i against who waits at node; the loser stays there."""
        j = self.tree[node]
        a, b = self.shared[i], self.shared[j]
        if a > b or j == i:
            return i
        if a == b and a >= 0:
            x, y = self.head[i], self.head[j]
            k = common(x, y, a)
            if (k == len(x), i) < (k == len(y), j) if x == y else (k == len(x) or (k < len(y) and x[k] < y[k])):
                self.shared[j] = k
                return i
            self.shared[i] = k
        elif a < 0 and b < 0:
            return i
        self.tree[node] = i
        return j

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(run, common prefix with the one before, suffix) in order."""
        if not self.runs:
            return
        while (s := self.head[w := self.winner]) is not None:
            yield w, self.shared[w], s
            self._next(w)
            i, node = w, (w + self.k) // 2
            while node:
                i = self._play(node, i)
                node //= 2
            self.winner = i


def repeated_offsets(rights: list[int], lefts: list[bytes], low: list[int], high: list[int], many: list[bool]) -> Iterator[tuple[int, int, int]]:
    """(member, first, last offset) of the windows that repeat within a group of different contexts in suffix order.

    rights: common prefix of each member's right context with the member
    before (the first one's doesn't count); lefts: left contexts, nearest byte
    first; low, high: offsets of each member's windows; many: the whole
    context occurs more than once.
    """
    m = len(lefts)
    if m == 2:
        a, b = max(LENGTH - rights[1], low[0], low[1]), min(common(lefts[0], lefts[1]), high[0], high[1])
        for i in (0, 1):
            if many[i]:
                yield i, low[i], high[i]
            elif a <= b:
                yield i, a, b
        return
    order = sorted(range(m), key=lefts.__getitem__)
    shared = np.array([0, *(common(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False))])
    back = np.empty(m, dtype=np.int64)
    back[order] = np.arange(m)
    lo, hi, right = np.array(low), np.array(high), np.array(rights)
    right[0] = 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(int(lo.min()), int(hi.max()) + 1, step := max(1, 1_000_000 // m)):
        d = np.arange(a, min(a + step, int(hi.max()) + 1))
        rc = np.cumsum(right[None, :] < (LENGTH - d)[:, None], axis=1)
        lc = np.cumsum(shared[None, :] < d[:, None], axis=1)[:, back]
        row, col = np.nonzero((d[:, None] >= lo) & (d[:, None] <= hi))
        key = (row * (m + 1) + rc[row, col]) * (m + 1) + lc[row, col]
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        on = count[group] > 1
        found.append((col[on], d[row[on]]))
    col, d = (np.concatenate(x) for x in zip(*found, strict=True))
    sort = np.lexsort((d, col))
    col, d = col[sort], d[sort]
    cut = np.flatnonzero(np.concatenate(([True], (col[1:] != col[:-1]) | (d[1:] != d[:-1] + 1)))) if len(col) else np.zeros(0, dtype=np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(col)], strict=False):
        if not many[i := int(col[a])]:
            yield i, int(d[a]), int(d[b - 1])
    for i in range(m):
        if many[i]:
            yield i, low[i], high[i]


def _ranges_hashed(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of the words a to b of hashes w, equal for equal words: a sum by powers, with the first one's power taken out."""
    base = 0x9E3779B97F4A7C15
    powers, back = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(len(w), x, np.uint64)]) for x in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(w * powers[:-1], dtype=np.uint64)))
    return mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))


def passage_anchors(w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of PASSAGE words: text, place (from the first word of all on), least and greatest offset of the windows that picked it.

    w, sizes: hashes of the words of texts one after the other, and how many
    each text has. A window picks the least hash of four words among its
    first PLACES places.
    """
    first = np.concatenate([np.arange(a, a + n - PASSAGE + 1) for a, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True) if n >= PASSAGE] or [np.zeros(0, dtype=np.int64)])
    if not len(first):
        return (np.zeros(0, dtype=np.int64),) * 4
    text, out = np.repeat(np.arange(len(sizes)), np.maximum(sizes - PASSAGE + 1, 0)), []
    for at in range(0, len(first), _WINDOWS):
        some = first[at : at + _WINDOWS]
        low = int(some[0])
        v = shingle_hashes(w[low : int(some[-1]) + PASSAGE], 4) & np.uint64(0xFFFFFFFFFF000000)
        v |= np.arange(len(v), dtype=np.uint64)  # the place below: the least is the leftmost of equals
        k = 1
        while k < PLACES:
            step = min(k, PLACES - k)
            v = np.minimum(v[:-step], v[step:])
            k += step
        place = (v[some - low] & np.uint64(0xFFFFFF)).astype(np.int64) + low
        cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (some[1:] != some[:-1] + 1))))
        last = np.concatenate((cut[1:] - 1, [len(some) - 1]))
        out.append((text[at + cut], place[cut], place[cut] - some[last], place[cut] - some[cut]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Windows of words that are looked at together.
_WINDOWS = 1 << 22


def _passage_rows(docs: DataFrame) -> DataFrame:
    """d, h, x (hash of the words that every window of an anchor has), c (of all their words), p, low, high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "t"):
            w, sizes = word_hashes([str(t, "utf-8") for t in part.column("t").to_pylist()])
            text, place, low, high = passage_anchors(w, sizes)
            x, c = _ranges_hashed(w, place, place + PASSAGE - PLACES + 1), _ranges_hashed(w, place - high, place - low + PASSAGE)
            ids, p = part.select(["d", "h"]).take(pa.array(text)), place - (np.cumsum(sizes) - sizes)[text]
            columns = [*(v.view(np.int64) for v in (x, c)), p.astype(np.int32), low.astype(np.int16), high.astype(np.int16)]
            yield pa.record_batch([*ids.columns, *map(pa.array, columns)], ["d", "h", "x", "c", "p", "low", "high"])

    return map_batches(docs.select("d", "h", "t"), run, "d long, h long, x long, c long, p int, low short, high short")


def _windows_of(contexts: DataFrame) -> DataFrame:
    """x, c, off, w1, w2, d, many: the windows of words of each class by its first text, with 128 bits of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "t", 1 << 20):
            w, sizes = word_hashes([str(t, "utf-8") for t in part.column("t").to_pylist()])
            lists = part.column("k")
            k, text = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            p, low, high = (k.field(n).to_numpy().astype(np.int64) for n in ("p", "low", "high"))
            n = high - low + 1
            of = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
            first = (np.cumsum(sizes) - sizes)[text[of]] + p[of] - off
            one, two = (_ranges_hashed(v, first, first + PASSAGE).view(np.int64) for v in (w, w ^ np.uint64(0x5BD1E995)))
            at = pa.array(of)
            x, c, d, many = (k.field(n).take(at) for n in ("x", "c", "d", "many"))
            yield pa.record_batch([x, c, pa.array(off.astype(np.int16)), pa.array(one), pa.array(two), d, many], ["x", "c", "off", "w1", "w2", "d", "many"])

    return map_batches(contexts, run, "x long, c long, off short, w1 long, w2 long, d long, many boolean")


def passages(docs: DataFrame) -> DataFrame:
    """d, h, p, mask: where bit k of mask is set, the window of PASSAGE words that begins k words before p stands in another document too."""
    every, doc = table(_passage_rows(docs)), F.struct("d", "h")
    groups = table(every.groupBy("x").agg((F.min(doc) != F.max(doc)).alias("more"), (F.min("c") != F.max("c")).alias("mixed")).filter("more").drop("more"))
    hits = table(every.join(groups, "x"))
    drop_table(every)
    drop_table(groups)
    classes = table(hits.groupBy("x", "c", "mixed").agg((F.min(doc) != F.max(doc)).alias("many"), F.min(F.struct("d", "h", "p", "low", "high")).alias("r")).select("x", "c", "mixed", "many", "r.*"))
    lists = classes.filter("mixed").groupBy("d", "h").agg(F.collect_list(F.struct("x", "c", "p", "low", "high", "d", "many")).alias("k"))
    windows = table(_windows_of(docs.select("d", "h", "t").dropDuplicates(["d", "h"]).join(lists, ["d", "h"]).select("t", "k")))
    shared = windows.groupBy("w1", "w2").agg((F.max("many") | (F.min("d") != F.max("d"))).alias("more")).filter("more").select("w1", "w2")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(k).cast("int"))
    found = windows.join(shared, ["w1", "w2"], "left_semi").select("x", "c", bit("off").alias("mask"))
    found = found.unionByName(classes.filter("many").select("x", "c", (bit("high") * 2 - bit("low")).alias("mask")))
    # a table, so that Spark can split a frequent class in the join below
    masks = table(found.groupBy("x", "c").agg(F.bit_or("mask").alias("mask")))
    out = table(hits.join(masks, ["x", "c"]).select("d", "h", "p", "mask"))
    for t in (hits, classes, windows, masks):
        drop_table(t)
    return out


_META = np.dtype([("x", "<i8"), ("c", "<i8"), ("low", "<i2"), ("high", "<i2"), ("many", "?")])
_SPANS = "x long, c long, low int, high int"


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """d, h, x (hash of the right context that every window has), c (of the whole context), p, low, high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for part in pieces(batches, "t"):
            at, columns = [], ([], [], [], [], [])
            for k, t in enumerate(part.column("t").to_pylist()):
                p, low, high = anchors(t or b"")
                at += [k] * len(p)
                pl, ll, hl = p.tolist(), low.tolist(), high.tolist()
                columns[0].extend(digest(t[i : i + CORE]) for i in pl)
                columns[1].extend(digest(t[i - b : i - a + LENGTH], b << 16 | a) for i, a, b in zip(pl, ll, hl, strict=True))
                for c, x in zip(columns[2:], (pl, ll, hl), strict=True):
                    c += x
            rows = part.select(["d", "h"]).take(pa.array(at, pa.int64()))
            hashes = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in columns[:2]]
            yield pa.record_batch(
                [*rows.columns, *hashes, pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())],
                ["d", "h", "x", "c", "p", "low", "high"],
            )

    return map_batches(docs.select("d", "h", "t"), run, "d long, h long, x long, c long, p long, low int, high int")


def _contexts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """t and, for each document, the list k of the classes that it stands for; repeated rows give the same classes again, which changes nothing."""
    lists = reps.groupBy("d", "h").agg(F.collect_list(F.struct("x", "c", "p", "low", "high", "n", "big")).alias("k"))
    one = docs.select(F.col("d").alias("_d"), F.col("h").alias("_h"), "t")
    return lists.join(one, (lists["d"] == one["_d"]) & (lists["h"] == one["_h"])).select("t", "k")


def _each(part: pa.RecordBatch) -> Iterator[tuple[bytes, dict]]:
    for t, ks in zip(part.column("t").to_pylist(), part.column("k").to_pylist(), strict=True):
        for k in ks:
            yield t, k


def _ranges(contexts: DataFrame, n: int) -> list[bytes]:
    """Up to n - 1 bounds of right contexts, from a sample; only the part that a whole group shares, so none is cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "t"):
            found = [t[k["p"] : k["p"] + CORE] for t, k in _each(part)]
            found.sort()
            yield pa.record_batch([pa.array(found[:: max(1, len(found) // 64)], pa.binary())], ["s"])

    rows = map_batches(contexts, run, "s binary").orderBy(F.xxhash64("s")).limit(SAMPLE).collect()
    s = sorted(bytes(r["s"]) for r in rows)
    return sorted({s[len(s) * k // n] for k in range(1, n)}) if s else []


def _sorted_spans(contexts: DataFrame, bounds: list[bytes]) -> DataFrame:
    """x, c, low, high: repeated offsets of each class, by the merge sort."""
    n = len(bounds) + 1

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[tuple]) -> pa.RecordBatch:
            held.sort(key=lambda r: r[:3])
            by: dict[int, list[tuple]] = {}
            for r in held:
                by.setdefault(bisect_right(bounds, r[0][:CORE]), []).append(r)
            rows = []
            for part, rs in by.items():
                left = b"".join(r[5] for r in rs)
                meta = np.array([(r[1], r[2], r[3], r[4], r[6]) for r in rs], dtype=_META).tobytes()
                rows.append((part, front_code([r[0] for r in rs]), zstandard.compress(struct.pack("<I", len(rs)) + meta + left, 1)))
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "suffixes", "rest"])

        held, size = [], 0
        for part in pieces(batches, "t"):
            for t, k in _each(part):
                p, low, high = k["p"], k["low"], k["high"]
                held.append((t[p : p + LENGTH - low], k["x"], k["c"], low, high, t[p - high : p][::-1], k["n"] > 1))
                size += LENGTH + SPREAD
            if size > RUN_BYTES:
                yield close(held)
                held, size = [], 0
        if held:
            yield close(held)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        metas, lefts = [], []
        for blob in group["rest"]:
            body = zstandard.decompress(blob)
            count = struct.unpack_from("<I", body)[0]
            meta = np.frombuffer(body, _META, count, 4)
            ends = 4 + count * _META.itemsize + np.concatenate(([0], np.cumsum(meta["high"].astype(np.int64))))
            metas.append(meta)
            lefts.append([body[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        place, out, held = [0] * len(metas), [], []

        def settle() -> None:
            if len(held) < 2 and not (held and metas[held[0][1]]["many"][held[0][2]]):
                return
            ms = [metas[r][i] for _, r, i in held]
            spans = repeated_offsets([s for s, _, _ in held], [lefts[r][i] for _, r, i in held], [int(m["low"]) for m in ms], [int(m["high"]) for m in ms], [bool(m["many"]) for m in ms])
            out.extend((int(ms[i]["x"]), int(ms[i]["c"]), a, b) for i, a, b in spans)

        for r, shared, _ in LoserTree([front_decode(b) for b in group["suffixes"]]):
            if shared < CORE:
                settle()
                held = []
            held.append((shared, r, place[r]))
            place[r] += 1
        settle()
        return pd.DataFrame(out, columns=["x", "c", "low", "high"]).astype({"x": "int64", "c": "int64", "low": "int32", "high": "int32"})

    exchanged = map_batches(contexts, runs, "part int, suffixes binary, rest binary")
    return exchanged.repartitionById(n, F.col("part")).groupBy("part").applyInPandas(merge, _SPANS)


def _hashed_spans(contexts: DataFrame) -> DataFrame:
    """x, c, low, high as _sorted_spans() has it, by 128-bit hashes of all windows: nothing is gathered but equal windows' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "t", 1 << 20):
            rows = []
            for t, k in _each(part):
                for d in range(k["low"], k["high"] + 1):
                    w = xxhash.xxh128_digest(t[k["p"] - d : k["p"] - d + LENGTH])
                    rows.append((k["x"], k["c"], d, w, k["n"]))
                    if len(rows) >= 50_000:
                        yield _window_rows(rows)
                        rows = []
            if rows:
                yield _window_rows(rows)

    windows = map_batches(contexts, run, "x long, c long, off int, w binary, n long")
    repeated = windows.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").select("w")
    return windows.join(repeated, "w", "left_semi").select("x", "c", F.col("off").alias("low"), F.col("off").alias("high"))


def _window_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["x", "c", "off", "w", "n"])


def repeated_spans(docs: DataFrame, max_group: int = MAX_GROUP, partitions: int | None = None) -> DataFrame:
    """d, h, start, stop: stretches of bytes of documents (d, h, t) that repeated 400-byte strings cover. d, h: 128 bits that name a document."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = table(_anchor_rows(docs))
    # a table, not a plan: an aggregate right below the join would keep Spark from splitting a frequent x
    groups = table(every.groupBy("x").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")).filter("n > 1").drop("n"))
    hits = table(every.join(groups, "x"))
    drop_table(every)
    drop_table(groups)
    mixed = hits.filter("mixed")
    classes = table(mixed.groupBy("x", "c").agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "p", "low", "high")).alias("r")).select("x", "c", "n", "r.*"))
    large = table(classes.groupBy("x").count().filter(F.col("count") > max_group).select("x", F.lit(True).alias("big")))
    flagged = classes.join(large, "x", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    contexts = table(_contexts(docs, flagged))
    small = contexts.select("t", F.filter("k", lambda k: ~k["big"]).alias("k"))
    spans = _sorted_spans(small, _ranges(small, n))
    if not large.isEmpty():
        spans = spans.unionByName(_hashed_spans(contexts.select("t", F.filter("k", lambda k: k["big"]).alias("k"))))
    spans = table(spans)
    drop_table(contexts)
    some = mixed.select("x", "c", "d", "h", "p").join(spans, ["x", "c"])
    whole = hits.filter("not mixed").select(*some.columns)
    return some.unionByName(whole).select("d", "h", (F.col("p") - F.col("high")).alias("start"), (F.col("p") - F.col("low") + LENGTH).alias("stop")).distinct()


def _merged(spans: Iterator[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, those that touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _bit_runs(p: int, mask: int) -> Iterator[tuple[int, int]]:
    """The words that windows cover which begin as many words before p as set bits of mask say, run by run of bits."""
    low = 0
    while mask >> low:
        if mask >> low & 1:
            high = low
            while mask >> high + 1 & 1:
                high += 1
            yield p - high, p - low + PASSAGE
            low = high
        low += 1


def suffix_dedup(docs: DataFrame, max_group: int = MAX_GROUP, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words (and kept, the remaining bytes, if asked for) for every row of docs.

    Each byte goes that is covered by a 400-byte string of its text (as UTF-8)
    that starts anywhere else, in the same text too; texts are judged as they
    come, and no string crosses documents. Null texts count as empty; texts
    under 400 bytes lose nothing. Rows with the same doc_id and the same text
    repeat each other, so both lose all that is in a 400-byte string.
    n_passages counts the maximal stretches under 51 words that another
    document (another doc_id or text) has one after the other too, and
    n_passage_words their words; words are lower-cased runs of letters, digits
    and underscores. Those count whatever their bytes, and are not removed
    unless their bytes are. Null doc_ids are kept; other columns are not read; an empty table gives an empty one.
    """
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("d"), F.xxhash64(F.lit(7), "doc_id", "text").alias("h"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t")
    )
    found = passages(base).select("d", "h", F.col("p").cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), "mask")
    found = found.unionByName(repeated_spans(base, max_group).withColumn("mask", F.lit(None).cast("long")))
    spans = found.groupBy(F.col("d").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("start", "stop", "mask")).alias("s"))
    both = base.join(spans, (base["d"] == spans["_d"]) & (base["h"] == spans["_h"]), "left").select("doc_id", "t", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "t"):
            rows = []
            for t, s in zip(part.column("t").to_pylist(), part.column("s").to_pylist(), strict=True):
                merged = _merged((x["start"], x["stop"]) for x in s or [] if x["mask"] is None)
                told = _merged(y for x in s or [] if x["mask"] is not None for y in _bit_runs(x["start"], x["mask"]))
                at, kept = 0, []
                for a, b in merged:
                    kept.append(t[at:a])
                    at = b
                left = b"".join([*kept, t[at:]])
                rows.append((len(t), len(t) - len(left), len(merged), hashlib.sha256(left).hexdigest(), len(told), sum(b - a for a, b in told), left if with_text else None))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.record_batch([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words", "kept"])

    out = map_batches(both, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long, kept binary")
    return out if with_text else out.drop("kept")
