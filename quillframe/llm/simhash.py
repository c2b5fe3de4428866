"""SimHash near-dedup with BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import components, map_batches, pieces, table

SHINGLE = 3
RADIUS = 3
#: A shard with more fingerprints is cut again by the bits its key leaves open.
SHARD = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """64 bits: each is 1 if set in over half of the XXH64 values of the n-word shingles; 0 without words."""
    w = (text or b"").translate(_LOWER).split()  # at bytes 32 and 9 to 13
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < n else list(map(b" ".join, zip(*(w[k:] for k in range(n)), strict=False)))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, 42) for g in grams), dtype="<u8", count=len(grams))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            fp = np.array([fingerprint(t, n) for t in part.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


class BKTree:
    """Children hang by their integer Hamming distance to the parent.

    Built and searched in rounds over arrays: a round moves every key that is
    still under way one edge down, or follows for every pair of a query and a
    node only the edges whose distance is within radius of the query's own.
    """

    def __init__(self, keys: np.ndarray):
        """keys: distinct uint64 values; the first is the root."""
        n = len(keys)
        self.keys = keys
        self.edges = np.zeros(0, dtype=np.int64)  # parent * 65 + distance, sorted
        self.child = np.zeros(0, dtype=np.int64)
        found_e, found_c = [], []
        todo, parent = np.arange(1, n), np.zeros(max(0, n - 1), dtype=np.int64)
        while len(todo):
            edge = parent * 65 + np.bitwise_count(keys[todo] ^ keys[parent])
            e, first, group = np.unique(edge, return_index=True, return_inverse=True)
            heads = todo[first]
            found_e.append(e)
            found_c.append(heads)
            rest = np.ones(len(todo), dtype=bool)
            rest[first] = False
            todo, parent = todo[rest], heads[group[rest]]
        if found_e:
            e, c = np.concatenate(found_e), np.concatenate(found_c)
            order = np.argsort(e, kind="stable")
            self.edges, self.child = e[order], c[order]

    def within(self, queries: np.ndarray, radius: int, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, key index) at most radius apart, in bounded pieces."""
        for at in range(0, len(queries), max(1, step // 64)):
            ask = np.arange(at, min(len(queries), at + max(1, step // 64)))
            stack = [(ask, np.zeros(len(ask), dtype=np.int64))]
            while stack:
                q, node = stack.pop()
                if len(q) > step:
                    stack.append((q[step:], node[step:]))
                    q, node = q[:step], node[:step]
                d = np.bitwise_count(queries[q] ^ self.keys[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                lo = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 1))
                hi = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right")
                count = np.maximum(hi - lo, 0)
                if total := int(count.sum()):
                    offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                    stack.append((np.repeat(q, count), self.child[np.repeat(lo, count) + offset]))


def shard_links(keys: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among one shard's distinct keys: fewer pairs than keys, same components."""
    tree, up = BKTree(keys), np.arange(len(keys))
    for a, b in tree.within(keys, radius):
        a, b = a[a < b], b[a < b]
        while len(a):
            a, b = up[a], up[b]
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            np.minimum.at(up, b, a)
            while (up[up] != up).any():
                up = up[up]
    hung = np.flatnonzero(up != np.arange(len(keys)))
    return keys[up[hung]], keys[hung]


def _blocks(mask: int, n: int) -> list[int]:
    """Masks of n blocks of the bits that mask leaves open, each together with mask; none if there are fewer bits."""
    free = [k for k in range(64) if not mask >> k & 1]
    cut = [len(free) * k // n for k in range(n + 1)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cut, cut[1:], strict=False)] if len(free) >= n else []


def _dealt(keys: DataFrame, n: int) -> DataFrame:
    """fp, mask, bits: every key (fp, mask) in one shard for each block of the bits that its mask leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, mask = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            for m in np.unique(mask):
                of = fp[mask == m]
                for to in map(np.uint64, _blocks(int(m), n)):
                    columns = of, np.full(len(of), to), of & to
                    yield pa.record_batch([pa.array(c.view(np.int64)) for c in columns], ["fp", "mask", "bits"])

    return map_batches(keys.select("fp", "mask"), run, "fp long, mask long, bits long")


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """a, b: pairs of distinct fingerprints that join every two within radius through a chain, at most one pair less than keys a shard.

    Two values at most radius apart agree in at least one of radius + 1 blocks
    of bits, so each value goes to one shard for every block. A shard above the
    size is dealt out again by radius + 1 blocks of the bits left open, in
    which two of its values also differ in radius bits at most, and so on: with
    every round fewer bits are open, so no shard stays above the size. Trees
    are built where their shard's keys come together: a copy on every executor
    would pass all fingerprints through the driver and grow with the corpus.
    """
    n = radius + 1
    todo, dealt = prints.select("fp").distinct().withColumn("mask", F.lit(0).cast("long")), None
    while True:
        keyed = table(_dealt(todo, n))
        over = keyed.groupBy("mask", "bits").count().filter((F.col("count") > shard) & (F.bit_count("mask") <= 64 - n))
        large = table(over.select("mask", "bits"))
        if large.isEmpty():
            dealt = keyed if dealt is None else dealt.unionByName(keyed)
            break
        cold = keyed.join(large, ["mask", "bits"], "left_anti").select(*keyed.columns)
        dealt = cold if dealt is None else dealt.unionByName(cold)
        todo = keyed.join(large, ["mask", "bits"], "left_semi")
    dealt = dealt.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(keys: list[np.ndarray]):
            found = shard_links(np.concatenate(keys).view(np.uint64), radius)
            return pa.record_batch([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

        now, held = None, []
        for batch in batches:
            fps, mask, bits = (batch.column(c).to_numpy() for c in ("fp", "mask", "bits"))
            if not len(fps):
                continue
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(fps)], strict=True):
                if (mask[a], bits[a]) != now:
                    if sum(map(len, held)) > 1:
                        yield close(held)
                    now, held = (mask[a], bits[a]), []
                held.append(fps[a:b])
        if sum(map(len, held)) > 1:
            yield close(held)

    return map_batches(dealt, run, "a long, b long")


def _rooted(docs: DataFrame, n: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp for every row of docs; and fp, least (doc_id), root (the component's least fingerprint) for every fingerprint."""
    prints = table(fingerprints(docs, n))
    least = table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    # components run over fingerprints, so that ids may be null or repeated
    found = components(links(least.select("fp"), radius))
    return prints, least.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )


def _named(prints: DataFrame, named: DataFrame) -> DataFrame:
    """prints with the columns of named (fp, n, ...), where a fingerprint that very many rows share moves none of them."""
    often = max(100_000, prints.count() // 10_000)  # so 10,000 such fingerprints at most are broadcast
    hot = F.broadcast(named.filter(F.col("n") > often).drop("n"))
    cold = prints.join(F.broadcast(named.filter(F.col("n") > often).select("fp")), "fp", "left_anti")
    return prints.join(hot, "fp").unionByName(cold.join(named.filter(F.col("n") <= often).drop("n"), "fp"))


def _hexed():
    return F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")


def near_groups(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    Documents whose fingerprints differ in at most radius bits are linked, and
    component_id is the least doc_id that links reach. Texts without words,
    null ones among them, have the fingerprint 0 and are linked like others.
    Rows with a null doc_id are kept; a component of such rows only has a null
    id. Repeated rows are kept. An empty table gives an empty one; other
    columns are not read.
    """
    prints, rooted = _rooted(docs, n, radius)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = table(rooted.join(ids, "root").select("fp", "n", "component_id"))
    return _named(prints, named).select("doc_id", _hexed(), "component_id")


def keep_one(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of docs, with all columns, for each near-duplicate group: that of its least doc_id.

    Nulls count as larger than any id. Where rows repeat that doc_id within
    the group, the one with the least fingerprint and then the least columns
    stays.
    """
    prints, rooted = _rooted(docs, n, radius)
    # a component_id may stand for several components: ids may be null or repeated
    groups = _named(prints, table(rooted.select("fp", "n", "root"))).select("doc_id", _hexed(), "root")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint")).alias("x"))
    kept = best.select(F.col("x.doc_id").alias("_q_id"), F.conv("x.fingerprint", 16, -10).cast("long").alias("_q_fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            fp = np.array([fingerprint(t, n) for t in part.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([*part.columns, pa.array(fp.view(np.int64))], [*part.schema.names, "_q_print"])

    # fingerprints are made again here: a table of them beside whole texts would be a copy of the corpus
    rows = map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField("_q_print", T.LongType())]))
    same = rows["doc_id"].eqNullSafe(kept["_q_id"]) & (rows["_q_print"] == kept["_q_fp"])
    one = rows.join(kept, same, "left_semi").groupBy("doc_id", "_q_print").agg(F.min(F.struct(*(f"`{c}`" for c in docs.columns))).alias("_q_row"))
    return one.select(*(F.col("_q_row")[c].alias(c) for c in docs.columns))
