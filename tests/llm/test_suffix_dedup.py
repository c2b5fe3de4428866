import random

import brute
import pytest

from quillframe.llm import suffix_dedup
from quillframe.llm.queries import op6_suffix_dedup


def texts(seed):
    """Texts with passages in common: whole, cut, with a changed byte, overlapping, periodic."""
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [draw(rng.choice([380, 395, 400, 401, 420, 700, 1500])) for _ in range(12)]
    out = []
    for _ in range(45):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(0, 60)
            p = rng.choice([p, p, p[a:], p[: len(p) - a], p[:300] + "#" + p[301:], p + p[:420]])
            parts += [draw(rng.randrange(40)), p]
        out.append("".join(parts))
    return out


ODD = [
    None, "", "short", "a" * 399, "b" * 400, "c" * 401, "ab" * 900, "abc" * 500 + "ab" * 400, "z" * 3000, "x" * 400, "y" * 500 + "x" * 399,
    "long unique é " + "".join(random.Random(3).choice("0123456789") for _ in range(40_000)),
]


def check(docs, rows, **options):
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.suffix_dedup(docs(rows), **options).collect()}
    want = dict(zip([i for i, _ in rows], brute.repeated_bytes([t for _, t in rows]), strict=True))
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    check(docs, list(enumerate([*texts(seed), *ODD])))


def test_large_groups_by_hashes(docs):
    check(docs, list(enumerate([*texts(4), *ODD])), max_group=2)


def test_repeats_nulls_and_empty_tables(docs):
    a, b = "q" * 100 + texts(5)[0], "r" * 600
    rows = [(1, a), (1, a), (None, b), (None, "x" + b), (None, None)]
    out = suffix_dedup.suffix_dedup(docs(rows), with_text=True).collect()
    want = brute.repeated_bytes([t for _, t in rows])
    assert sorted(tuple(r)[1:5] for r in out) == sorted(want)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in out)
    assert suffix_dedup.suffix_dedup(docs([])).count() == 0


def test_passages_against_brute_force(docs):
    rng = random.Random(7)
    draw = lambda n: [rng.choice(["a", "be", "Cé", "dd", "no", "ox"]) + rng.choice(["", "", "x", "1"]) for _ in range(n)]
    passages = [draw(n) for n in (49, 50, 51, 52, 60, 90, 200)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            parts += draw(rng.randrange(70)) + rng.choice([p, p[rng.randrange(9) :], p[: len(p) - rng.randrange(9)], p + p])
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(parts + draw(rng.randrange(70)))))
    rows += [(100, None), (101, ""), (102, "one " * 50), (103, "two " * 300), (104, rows[5][1]), (105, rows[5][1].upper()), (6, rows[6][1]), (None, "three " * 51), (None, "three " * 52)]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_passages"], r["n_passage_words"]) for r in suffix_dedup.suffix_dedup(docs(rows)).collect())
    want = [(str(i), len((t or "").encode()), *x) for (i, t), x in zip(rows, brute.passages(rows), strict=True)]
    assert got == sorted(want) and sum(x[2] > 0 for x in want) > 20 and sum(x[2] == 0 for x in want) > 10


def test_runs_round_trip_and_merge():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode() for _ in range(500)]
    runs = [sorted(words[k::7]) for k in range(7)]
    for r in runs:
        assert [s for _, s in suffix_dedup.front_decode(suffix_dedup.front_code(r))] == r
    merged = list(suffix_dedup.LoserTree([suffix_dedup.front_decode(suffix_dedup.front_code(r)) for r in runs]))
    assert [s for _, _, s in merged] == sorted(words)
    for (_, _, a), (_, k, b) in zip(merged, merged[1:], strict=False):
        assert k == suffix_dedup.common(a, b)
    assert list(suffix_dedup.LoserTree([])) == [] and list(suffix_dedup.LoserTree([iter([]), iter([])])) == []


def test_query(spark, small):
    rows = small("documents")
    got = {r["doc_id"]: tuple(r)[1:5] for r in op6_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip([r[0] for r in rows], brute.repeated_bytes([r[1] for r in rows]), strict=True))
