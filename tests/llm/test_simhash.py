import random

import brute
import numpy as np

from quillframe.llm import simhash
from quillframe.llm.queries import op2_simhash


def corpus(n=160, seed=5):
    """Texts, near copies and chains of near copies."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    while k < n:
        w = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((k, rng.choice([" ", "\t", "\x0b "]).join(w)))
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(words).upper()
            k += 1
    return rows


def test_fingerprint_of_odd_texts():
    for t in (None, "", " \t\r\n", "One", "one TWO", "a b c", "É ÀB C d", "x " * 5000, "\x1c\x1d a b", "Straße İ ǅ groß"):
        assert simhash.fingerprint(None if t is None else t.encode()) == brute.fingerprint(t)


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    keys = np.unique((rng.integers(0, 1 << 12, 500, dtype=np.uint64) << np.uint64(20)) ^ rng.integers(0, 1 << 6, 500, dtype=np.uint64))
    for radius in (0, 3, 7):
        want = {(a, b) for a in range(len(keys)) for b in range(len(keys)) if (int(keys[a]) ^ int(keys[b])).bit_count() <= radius}
        got = [(int(x), int(y)) for a, b in simhash.BKTree(keys).within(keys, radius, step=128) for x, y in zip(a, b, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_small_shards_lose_no_link(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    keys = set(base)
    for b in base:
        for _ in range(15):
            for _ in range(rng.randrange(1, 4)):
                b ^= 1 << rng.randrange(64)
            keys.add(b)
    want = brute.groups(keys, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = [(k - (1 << 64) if k >> 63 else k,) for k in keys]
    for shard in (4, 4096):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), shard=shard).collect()
        pairs = {(a % (1 << 64), b % (1 << 64)) for a, b in edges}
        assert all((a ^ b).bit_count() <= 3 or want[a] == want[b] for a, b in pairs)
        assert brute.groups(keys, lambda a, b: (a, b) in pairs or (b, a) in pairs) == want  # noqa: B023


def test_groups_against_brute_force(docs):
    rows = [*corpus(), (900, None), (901, ""), (902, "  "), (903, "lone"), (904, "far " * 30_000)]
    got = {(r["doc_id"]): (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs(rows)).collect()}
    assert got == {k[0]: v for k, v in brute.near_groups(rows).items()}
    assert got[902][1] == 900


def test_repeats_nulls_and_empty_tables(docs):
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "something else"), (7, "far from it all")]
    out = simhash.near_groups(docs(rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out) == sorted([("7", "3"), ("7", "3"), ("None", "3"), ("3", "3"), ("None", "None"), ("7", "7")])
    assert simhash.near_groups(docs([])).count() == 0 and simhash.keep_one(docs([])).count() == 0


def test_one_of_each_group_stays(docs):
    rows = [*corpus(90), (900, None), (901, ""), (None, "a b c"), (902, "A B C"), (902, "A B C"), (None, "only null")]
    df = docs(rows)
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    groups = brute.near_groups([r for r in rows if r[0] is not None])
    want = {g for _, g in groups.values()}
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1


def test_groups_that_share_an_id_or_have_none_keep_one_each(docs):
    rows = [(None, "only null"), (None, "far from it all"), (7, "a b c d"), (7, "something else again"), (7, "A b c d")]
    out = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(docs(rows)).collect())
    assert out == [("7", "A b c d"), ("7", "something else again"), ("None", "far from it all"), ("None", "only null")]


def test_query(spark, small):
    rows = [(r[0], r[1]) for r in small("documents")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op2_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k[0]: v for k, v in brute.near_groups(rows).items()}
