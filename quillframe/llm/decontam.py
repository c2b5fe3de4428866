"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A window is as many words as an item has. Every window of every document gets
a fingerprint for each size that items have; those within the radius of an
item's fingerprint are candidates, and the exact weighted-shingle similarity
decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import map_batches, pieces

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of windows and items may differ in so many of 64 bits. At
#: similarity 0.8 a share of 8/9 of the shingles is common, so that a bit
#: differs with a chance of acos(8/9) / pi = 0.152; more than 24 of 64
#: independent bits do so in fewer than 1 of 100,000 such windows.
RADIUS = 24
#: Words and different sizes of the items that one pass holds; more items are taken in blocks.
BLOCK_WORDS = 500_000
BLOCK_SIZES = 256
#: Fingerprints of one size that are compared one by one; more have tables of blocks.
DIRECT = 16
#: Windows whose fingerprints are made at once.
_STEP = 8192
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def shingles(w: list[str], n: int = SHINGLE) -> list[tuple[str, ...]]:
    """Runs of n words with repeats; the whole sequence if there are fewer; none without words."""
    if len(w) < n:
        return [tuple(w)] if w else []
    return list(zip(*(w[k:] for k in range(n)), strict=False))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity: sum of least over sum of largest weights."""
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@cache
def _in_words() -> np.ndarray:
    """Of each code point, whether words() takes it."""
    table = np.fromiter((chr(k).isalnum() for k in range(0x110000)), dtype=bool, count=0x110000)
    table[ord("_")] = True
    return table


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for each word of each text in order, and how many words each text has; what words() cuts, without its strings."""
    lower = [t.lower() if t else "" for t in texts]
    ends = np.cumsum(np.fromiter(map(len, lower), dtype=np.int64, count=len(lower)) + 1)
    code = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le"), "<u4")
    inside = _in_words()[code]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    weights = np.cumprod(np.full(int(size.max()), 0xD6E8FEB86659FD93, dtype=np.uint64), dtype=np.uint64)
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(before.astype(np.int32), size)
    sums = np.add.reduceat(code[inside].astype(np.uint64) * weights[place], before)
    return mixed(sums + size.astype(np.uint64)), np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """64 bits for each run of n words, of their hashes in order; none if there are fewer."""
    m = len(w) - n + 1
    if m < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + m]
    return mixed(h)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _sum(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of numbers whose binary digits lie in arrays, the least digit first: 64 numbers in one element."""
    out, carry = [], None
    for k in range(max(len(a), len(b))):
        x, y = (v[k] if k < len(v) else None for v in (a, b))
        x, y = (y, x) if x is None else (x, y)
        digit, over = (x, None) if y is None else (x ^ y, x & y)
        if carry is not None:
            digit, again = digit ^ carry, digit & carry
            over = again if over is None else over | again
        out.append(digit)
        carry = over
    return out if carry is None else [*out, carry]


def _counts(h: np.ndarray, n: int) -> list[np.ndarray]:
    """How often each bit is set in every run of n hashes, as digits."""
    if n == 1:
        return [h]
    half = _counts(h, n // 2)
    two = _sum([x[: len(x) - n // 2] for x in half], [x[n // 2 :] for x in half])
    return two if n % 2 == 0 else _sum([x[:-1] for x in two], [h[n - 1 :]])


def window_prints(h: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, fingerprints of the runs of n hashes that begin at the first len(h) - sizes[-1] + 1 places) for each of the ascending sizes.

    All bits are counted side by side, from one size to the next: a size that
    is one more adds one hash to each window.
    """
    m = len(h) - sizes[-1] + 1
    n, digits = sizes[0], [x[:m].copy() for x in _counts(h, sizes[0])]
    carry, spare, out = (np.empty(m, dtype=np.uint64) for _ in range(3))
    for size in sizes:
        if size - n > 16:
            digits = [x.copy() for x in _sum(digits, [x[n : n + m] for x in _counts(h, size - n)])]
            n = size
        while n < size:
            carry[:] = h[n : n + m]
            for d in digits:
                np.bitwise_and(d, carry, out=spare)
                np.bitwise_xor(d, carry, out=d)
                carry, spare = spare, carry
            n += 1
            if n & (n - 1) == 0:
                digits.append(carry.copy())
        # more than half: digit by digit against n // 2, from the least on
        out[:] = 0
        for k, d in enumerate(digits):
            (np.bitwise_and if n // 2 >> k & 1 else np.bitwise_or)(out, d, out=out)
        yield n, out


class HammingIndex:
    """All stored fingerprints within radius of those asked for.

    64 bits are cut into four blocks. A table for each block has, for each of
    its values, the least distance of a stored fingerprint's block. The sum of
    a fingerprint's four entries is no more than its distance to any stored
    one, so those above the radius are passed over and none within it is
    missed. Up to DIRECT stored fingerprints are compared themselves.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.tables = prints.astype(np.uint64), radius, []
        if len(prints) > DIRECT:
            values = np.arange(1 << 16, dtype=np.uint16)
            for k in range(4):
                least = np.full(1 << 16, 16, dtype=np.uint8)
                for x in np.unique((self.prints >> np.uint64(16 * k)).astype(np.uint16)):
                    np.minimum(least, np.bitwise_count(values ^ x), out=least)
                self.tables.append(least)

    def near(self, asked: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (in asked, in the stored ones) of the pairs within the radius; only where allowed holds."""
        if not self.tables:
            least, d, apart = np.full(len(asked), 64, dtype=np.uint8), np.empty(len(asked), dtype=np.uint8), np.empty(len(asked), dtype=np.uint64)
            for p in self.prints:
                np.bitwise_count(np.bitwise_xor(asked, p, out=apart), out=d)
                np.minimum(least, d, out=least)
        else:
            blocks = np.ascontiguousarray(asked, "<u8").view("<u2").reshape(-1, 4)
            least = self.tables[0][blocks[:, 0]]
            for k in (1, 2, 3):
                least += self.tables[k][blocks[:, k]]
        possible = least <= self.radius
        at = np.flatnonzero(possible if allowed is None else possible & allowed)
        rows, found = [], []
        for k in range(0, len(at), step := max(1, 1_000_000 // len(self.prints))):
            x, y = np.nonzero(np.bitwise_count(asked[at[k : k + step], None] ^ self.prints[None, :]) <= self.radius)
            rows.append(at[k : k + step][x])
            found.append(y)
        return (np.concatenate(rows), np.concatenate(found)) if rows else _NONE


_NONE = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


class _Known:
    """A set of hashes, looked up by 20 of their bits first."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.flags = np.zeros(1 << 20, dtype=bool)
        self.flags[self.sorted >> np.uint64(44)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self.flags[h >> np.uint64(44)]
        at = np.flatnonzero(out)
        some = h[at]
        out[at] = self.sorted[np.minimum(np.searchsorted(self.sorted, some), len(self.sorted) - 1)] == some
        return out


class Items:
    """What a pass over documents needs of a block of items."""

    def __init__(self, items: list[tuple[object, str]], radius: int = RADIUS):
        # items go by a running number: ids may be null or repeated
        self.ids = [i for i, _ in items]
        self.words = {t: w for t, (_, x) in enumerate(items) if (w := words(x))}
        self.bags = {t: Counter(shingles(w)) for t, w in self.words.items()}
        hashes = {t: shingle_hashes(word_hashes([x])[0], min(SHINGLE, len(self.words[t]))) for t, (_, x) in enumerate(items) if t in self.words}
        by: dict[int, list[int]] = defaultdict(list)
        for t, w in self.words.items():
            by[len(w)].append(t)
        self.sizes = {m: np.array(ts) for m, ts in sorted(by.items())}
        prints = {t: fingerprint(h) for t, h in hashes.items()}
        self.index = {m: HammingIndex(np.array([prints[t] for t in ts.tolist()], dtype=np.uint64), radius) for m, ts in self.sizes.items()}
        kinds = sorted({min(SHINGLE, m) for m in self.sizes})
        self.known = {n: _Known(np.concatenate([h for t, h in hashes.items() if min(SHINGLE, len(self.words[t])) == n])) for n in kinds}

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """For each text (number of the item, similarity, windows, word at which the best one starts) of each item that some window is similar to."""
        w, sizes = word_hashes(texts)
        start = np.concatenate(([0], np.cumsum(sizes)))
        total = int(start[-1])
        end = np.repeat(start[1:], sizes)
        at, item = [_NONE[0]], [_NONE[0]]
        for n, known in self.known.items():
            h, windows = shingle_hashes(w, n), [m - n + 1 for m in self.sizes if min(SHINGLE, m) == n]
            if not len(h):
                continue
            widest = windows[-1]
            sums = np.zeros(len(h) + widest + 1, dtype=np.int32)
            np.cumsum(known.has(h), dtype=np.int32, out=sums[1 : len(h) + 1])
            sums[len(h) + 1 :] = sums[len(h)]
            padded = np.concatenate((h, np.zeros(widest, dtype=np.uint64)))
            for k in range(0, len(h), _STEP):
                m = min(_STEP, len(h) - k)
                room = (end[k : k + m] - np.arange(k, k + m)).astype(np.int32)
                for per, prints in window_prints(padded[k : k + m + widest - 1], windows):
                    # a similar window lies in one text and has 8/9 of its shingles from items
                    inside = room >= per + n - 1
                    inside &= sums[k + per : k + per + m] - sums[k : k + m] >= math.ceil(2 * SIMILARITY / (1 + SIMILARITY) * per - 1e-9)
                    x, y = self.index[per + n - 1].near(prints, inside)
                    at.append(x + k)
                    item.append(self.sizes[per + n - 1][y])
            for d in np.flatnonzero((sizes >= SHINGLE) & (sizes < widest + n - 1)).tolist() if n == SHINGLE else []:
                # all of a text that is shorter than an item
                own, per = np.array([fingerprint(h[start[d] : start[d + 1] - n + 1])], dtype=np.uint64), int(sizes[d]) - n + 1
                for m in self.sizes:
                    if sizes[d] < m and per >= SIMILARITY * (m - n + 1) - 1e-9:
                        _, y = self.index[m].near(own)
                        at.append(np.full(len(y), start[d]))
                        item.append(self.sizes[m][y])
        place, which = np.concatenate(at), np.concatenate(item)
        text = np.searchsorted(start, place, side="right") - 1
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        if total and len(place):
            order, last = np.lexsort((place, which, text)), -1
            place, which, text = place[order], which[order], text[order]
            cut = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (which[1:] != which[:-1]))))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(text)], strict=True):
                d, t = int(text[a]), int(which[a])
                if d != last:
                    last, split = d, words(texts[d])
                if best := self._best(split, t, (place[a:b] - start[d]).tolist()):
                    out[d].append((t, *best))
        return out

    def _best(self, w: list[str], t: int, at: list[int]) -> tuple[float, int, int] | None:
        """Similarity of the best of the candidates, how many are similar enough, and where the first best one starts."""
        size, best, count = min(len(self.words[t]), len(w)), None, 0
        for p in at:
            s = similarity(Counter(shingles(w[p : p + size])), self.bags[t])
            if s >= SIMILARITY - 1e-12:
                count += 1
                if best is None or s > best[0]:
                    best = (s, p)
        return (best[0], count, best[1]) if best else None


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str]]]:
    """The distinct pairs of id and text in blocks of about block_words words and BLOCK_SIZES sizes, read partition by partition; null texts are left out.

    A block is what is broadcast: its words and tables bound it, whatever the
    number of items. One item is never cut.
    """
    block, n, sizes = [], 0, set()
    rows = benchmark.filter("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        m = len(words(r["text"]))
        if block and (n + m > block_words or len(sizes | {m}) > BLOCK_SIZES):
            yield block
            block, n, sizes = [], 0, set()
        block.append((r["item_id"], r["text"]))
        n += m
        sizes.add(m)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, similarity, n_windows, first_word: one row for each document and item it holds a passage of.

    A document holds an item if a window of as many words as the item has (all
    its words, if it has fewer) reaches similarity 0.8 by shingles of five
    words, counted with repeats; items of fewer words are one shingle. Words
    are lower-cased runs of letters, digits and underscores. first_word is
    where the first of the most similar windows starts. Null and wordless
    texts and items match nothing; without items the result is empty. Rows
    with a null doc_id and repeated rows give a row each. Every distinct text
    under an item_id is an item, and so is one under a null id; item rows of
    the same id and text count as one. item_id may be of any type.
    """
    kind = {n: t for n, t in docs.dtypes}["doc_id"]
    item = benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item.simpleString()}, similarity double, n_windows long, first_word long"
    out = None
    for block in item_blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block))
        ids = docs.sparkSession.createDataFrame(list(enumerate(i for i, _ in block)), T.StructType([T.StructField("_q_item", T.IntegerType()), T.StructField("item_id", item)]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for part in pieces(batches, "text"):
                found = items.matches(part.column("text").to_pylist())
                rows = [(d, *m) for d, ms in enumerate(found) for m in ms]
                d, *rest = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64())
                arrays = [part.column("doc_id").take(pa.array(d, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))]
                yield pa.record_batch(arrays, ["doc_id", "_q_item", "similarity", "n_windows", "first_word"])

        one = map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, _q_item int, similarity double, n_windows long, first_word long")
        one = one.join(F.broadcast(ids), "_q_item").select("doc_id", "item_id", "similarity", "n_windows", "first_word")
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that hold no item of benchmark, with all their columns."""
    for block in item_blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, "text"):
                yield part.filter(pa.array([not m for m in shared.value.matches(part.column("text").to_pylist())], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs
