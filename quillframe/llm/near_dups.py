"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash with BK-trees first, then a set join over prefixes, so no similar pair is missed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm import simhash
from quillframe.llm.common import components, drop_table, map_batches, pieces, table

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
SIMILARITY = (4, 5)
#: Frequent shingles stand last in every prefix's order; which ones are held to be so bears on time only.
FREQUENT = 32
MOST_FREQUENT = 1 << 16
SAMPLE = 16
#: Orders in which texts of one shingle are compared with their neighbours before all pairs are.
ORDERS = 8
#: Texts of one shingle that one task looks through, about.
SALTED = 8192
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of all words where there are fewer, which is none in a null text.

    Words stand between bytes 32 and 9 to 13, A-Z lower-cased.
    """
    words = (text or b"").translate(_LOWER).split()
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    m = len(w) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h = _mix(h + w[k : k + m])
    return np.unique(h)


def _texts(part: pa.RecordBatch) -> Iterator[tuple[int, bytes | None]]:
    return zip(part.column("node").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True)


def _frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in many of a sample of texts, the most frequent ones, and in how many of all they stand, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            h, count = np.unique(np.concatenate([shingles(t, n) for _, t in _texts(part)]), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(count.astype(np.int64))], ["h", "n"])

    sample = texts.filter(F.pmod("node", F.lit(SAMPLE)) == 0)
    counted = map_batches(sample, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= max(2, FREQUENT // SAMPLE)).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    h = np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["n"] * SAMPLE for r in top], dtype=np.int64)[order]


def _prefixes(texts: DataFrame, n: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, salt, node, size, at: the first shingles of each text in an order that all texts share, so many that similar texts have one of them in common.

    salt is -1, or for a shingle that very many texts have one of as many
    numbers as it takes to deal them out.
    """
    num, den = SIMILARITY
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (last, count), seen = shared.value, set()
        for part in pieces(batches, "text"):
            rows = []
            for v, t in _texts(part):
                if v in seen:
                    continue
                seen.add(v)
                h = shingles(t, n)
                p = len(h) - -(-num * len(h) // den) + 1
                salt = np.full(p, -1, dtype=np.int32)
                if len(last):
                    at = np.minimum(np.searchsorted(last, h), len(last) - 1)
                    late = last[at] == h
                    deal = np.concatenate((np.zeros(int((~late).sum()), dtype=np.int64), count[at[late]] // SALTED))[:p]
                    h = np.concatenate((h[~late], h[late]))
                    salt = np.where(deal > 0, v % (deal + 1), -1).astype(np.int32)
                rows.append((h[:p].view(np.int64), salt, np.full(p, v, dtype=np.int64), np.full(p, len(h), dtype=np.int32), np.arange(p, dtype=np.int32)))
            if rows:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["key", "salt", "node", "size", "at"])

    return map_batches(texts, run, "key long, salt int, node long, size int, at int")


def _possible(l: str, r: str):  # noqa: E741
    """Sizes and places leave room for the similarity, if this is the first shingle in common."""
    num, den = SIMILARITY
    left = F.least(F.col(f"{l}.size") - F.col(f"{l}.at"), F.col(f"{r}.size") - F.col(f"{r}.at"))
    return left * (num + den) >= (F.col(f"{l}.size") + F.col(f"{r}.size")) * num


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs a, b whose sets reach the similarity; texts has each node once. Texts move, as their sets would be larger."""
    num, den = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for part in pieces(batches, "y"):
            a, ys, keep = part.column("a").to_pylist(), part.column("y").cast(pa.binary()).to_pylist(), []
            for k, (v, t) in enumerate(zip(a, ys, strict=True)):
                if v != last:  # pairs come sorted by a
                    last, x = v, shingles(part.column("x")[k].cast(pa.binary()).as_py(), n)
                y = shingles(t, n)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * (num + den) >= (len(x) + len(y)) * num)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return table(map_batches(both.select("a", "b", "x", "y"), run, "a long, b long"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _guessed(texts: DataFrame, n: int) -> DataFrame:
    """a, b: pairs of nodes that BK-trees of n-word fingerprints link, as a forest."""
    prints = table(simhash.fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), n).select(F.col("doc_id").alias("node"), "fp").distinct())
    first = table(prints.groupBy("fp").agg(F.min("node").alias("first")))
    same = prints.join(first, "fp").filter("node <> first").select(*_ordered("node", "first"))
    near = simhash.links(first.select("fp"))
    l, r = (first.select(F.col("fp").alias(x), F.col("first").alias(f"n{x}")) for x in "ab")  # noqa: E741
    return table(same.unionByName(near.join(l, "a").join(r, "b").select(*_ordered("na", "nb"))).distinct())


def _apart(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """keyed with the root of each node's component by the links."""
    return table(keyed.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))


def _open_pairs(named: DataFrame) -> DataFrame:
    """l, r: rows of a shingle whose texts are in different components and may be similar."""
    l, r = named.alias("l"), named.alias("r")  # noqa: E741
    return l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.root") < F.col("r.root")) & _possible("l", "r"))


def _many(named: DataFrame) -> bool:
    """Whether more pairs are open than there are texts, by a sample of the shingles; bears on time only."""
    return _open_pairs(named.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0)).count() * SAMPLE > named.agg(F.approx_count_distinct("node")).first()[0]


def links(texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    """a, b: pairs of nodes at the similarity or above, which join every two such nodes through a chain.

    texts has node and text. Pairs that fingerprints and their BK-trees find
    are verified first; they join large groups with fewer pairs than texts.
    As fingerprints this close don't find every similar pair, prefixes of the
    shingle sets complete them: similar texts share a shingle of their
    prefixes. Of one prefix shingle's texts each is compared with the smallest
    where they were not grouped before, then with some that come before it in
    several different orders, as long as that brings groups together and many
    pairs are open. At last all pairs that are still in different groups are.
    """
    guess = _guessed(texts, n)
    hint = table(components(guess))
    per = Window.partitionBy("key", "salt")
    around = _prefixes(texts, n, _frequent(texts, n)).select(
        "*", F.min(F.struct("size", "node", "at")).over(per).alias("c"), (F.min("node").over(per) == F.max("node").over(per)).alias("alone")
    )
    # a shingle of one text only joins nothing
    keyed = table(around.filter("salt >= 0 or not alone").drop("alone").dropDuplicates(["key", "node"]))
    held = table(texts.join(keyed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    centred = keyed.select(F.struct("node", "size", "at").alias("r"), "c").filter("c.node <> r.node").filter(_possible("c", "r")).select(*_ordered("c.node", "r.node")).distinct()
    l, r = (hint.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")  # noqa: E741
    other = centred.join(l, "a", "left").join(r, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    tried = table(guess.unionByName(other).distinct())
    drop_table(guess)
    drop_table(hint)
    found = _verified(tried, held, n)
    named = _apart(keyed, found)
    for k in range(ORDERS):
        if not _many(named):
            break
        by = Window.partitionBy("key", "salt").orderBy(F.xxhash64("node", F.lit(k)), "node")
        one = F.struct("node", "size", "at", "root")
        near = F.array(*(F.lag(one, j).over(by) for j in range(1, (1 << min(k, 4)) + 1)))
        beside = named.select(one.alias("r"), near.alias("ls")).select("r", F.explode(F.filter("ls", lambda x: x["root"] != F.col("r.root"))).alias("l")).filter(_possible("l", "r"))
        pairs = table(beside.select(*_ordered("l.node", "r.node")).distinct().join(tried, ["a", "b"], "left_anti"))
        more = _verified(pairs, held, n)
        tried = tried.unionByName(pairs)
        if more.isEmpty():
            break
        found = found.unionByName(more)
        drop_table(named)
        named = _apart(keyed, found)
    rest = table(_open_pairs(named).select(*_ordered("l.node", "r.node")).distinct().join(tried, ["a", "b"], "left_anti"))
    drop_table(named)
    drop_table(keyed)
    out = found.unionByName(_verified(rest, held, n))
    drop_table(held)
    return out


def keep_one(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """One row of docs, with all columns, for each near-duplicate group: that of its least doc_id.

    Texts whose sets of n-word shingles have a Jaccard similarity of 0.8 or
    more are linked, and groups are what links reach. Words stand between
    bytes 32 and 9 to 13, A-Z count as a-z; texts of fewer than n words are
    linked to texts of the same words, texts without words and null ones to
    each other. Nulls count as larger than any id. Where rows repeat the least
    doc_id within the group, the one with the least hash of its text and then
    the least columns stays. 64-bit hashes stand for texts and shingles.
    """
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("node"))
    found = components(links(marked.select("node", "text"), n))
    rooted = marked.select("doc_id", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("x"))
    kept = best.select(F.col("x.doc_id").alias("_q_id"), F.col("x.node").alias("_q_node"))
    rows = docs.withColumn("_q_print", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(kept["_q_id"]) & (rows["_q_print"] == kept["_q_node"])
    one = rows.join(kept, same, "left_semi").groupBy("doc_id", "_q_print").agg(F.min(F.struct(*(f"`{c}`" for c in docs.columns))).alias("_q_row"))
    return one.select(*(F.col("_q_row")[c].alias(c) for c in docs.columns))
