import math
import random

import brute
import numpy as np

from quillframe.llm import decontam
from quillframe.llm.queries import op10_decontamination


def fixture(seed=4):
    """Items, and documents that hold them whole, changed a little, changed a lot, or not."""
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(300)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, draw(rng.choice([3, 6, 12, 25, 40, 70]))) for k in range(25)]
    items.append((90, ["same"] * 30))
    rows = []
    for k in range(70):
        t, w = rng.choice(items)
        part = list(w)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], draw(1), draw(2)])
            part = part or draw(1)
        body = draw(rng.randrange(60)) + part + draw(rng.randrange(60))
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(body).upper() if k % 3 else " ".join(body)))
    return rows, [(t, " ".join(w).capitalize() + ".") for t, w in items]


def bench(spark, items):
    return spark.createDataFrame([(t, x, "doc") for t, x in items], "item_id long, text string, doc_id string")


def found(df):
    return {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in df.collect()}


def test_against_brute_force(spark, docs):
    rows, items = fixture()
    rows += [(900, None), (901, ""), (902, "!?"), (903, "same " * 31), (904, "word1 word2"), (905, " ".join(["filler"] * 20_000 + [items[4][1]]))]
    items += [(950, None), (None, "null id"), (951, ""), (952, "...")]
    want = {k: round(s, 9) for k, s in brute.contaminated(rows, [x for x in items if x[0] is not None]).items()}
    assert len(want) > 20
    for words in (decontam.BLOCK_WORDS, 60):
        assert found(decontam.contaminated(docs(rows), bench(spark, items), words)) == want
        kept = decontam.drop_contaminated(docs(rows), bench(spark, items), words)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[0] for r in rows} - {k[0] for k in want})


def test_index_finds_all_within_the_radius():
    rng = random.Random(1)
    for count in (1, 7, 16, 17, 200):
        prints = [rng.getrandbits(64) for _ in range(count)]
        for radius in (0, 1, 7, 24, 28):
            index = decontam.HammingIndex(np.array(prints, dtype=np.uint64), radius)
            asked = []
            for _ in range(50):
                p = rng.choice(prints)
                for _ in range(rng.randrange(35)):
                    p ^= 1 << rng.randrange(64)
                asked.append(p)
            near = {(k, t) for k, p in enumerate(asked) for t, q in enumerate(prints) if (p ^ q).bit_count() <= radius}
            got = index.near(np.array(asked, dtype=np.uint64))
            assert set(zip(*(x.tolist() for x in got), strict=True)) == near and len(got[0]) == len(near)
            odd = np.arange(50) % 2 == 1
            assert set(zip(*(x.tolist() for x in index.near(np.array(asked, dtype=np.uint64), odd)), strict=True)) == {x for x in near if x[0] % 2}


def test_window_prints_against_counting():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for sizes in ([1], [2], [1, 2, 3, 4, 5, 9, 16, 17], [3, 40, 41, 200], [64, 128, 129]):
        got = {n: p.copy() for n, p in decontam.window_prints(h, sizes)}
        assert list(got) == sizes
        for n, p in got.items():
            assert len(p) == len(h) - sizes[-1] + 1
            for k in (0, 1, len(p) // 2, len(p) - 1):
                assert int(p[k]) == decontam.fingerprint(h[k : k + n]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[k : k + n]) > n)


def test_words_without_strings_are_the_words():
    texts = [None, "", "...", "İstanbul ǅ_9 naïve e\u0301 中文 ½ x²", "A a\nb", "same same", "ß" * 300]
    hashes, sizes = decontam.word_hashes(texts)
    assert sizes.tolist() == [len(decontam.words(t)) for t in texts]
    every = [w for t in texts for w in decontam.words(t)]
    assert len({(w, int(h)) for w, h in zip(every, hashes, strict=True)}) == len(set(every)) == len(set(hashes.tolist()))


def changed(rng, n):
    """An item of n words, and a copy with one or a few words changed."""
    w = [f"w{rng.randrange(5000)}" for _ in range(n)]
    v = list(w)
    v[rng.randrange(n)] = "changed"
    if n >= 80:
        v[rng.randrange(n)] = "again"
    return w, v


def test_radius_holds_what_the_exact_check_accepts():
    """Windows at similarity 0.8 or more of items of all lengths keep within the radius."""
    rng = random.Random(8)
    far = 0
    for _ in range(3000):
        w, v = changed(rng, rng.choice([9, 14, 20, 40, 80, 200]))
        if decontam.similarity(brute.weighted(w), brute.weighted(v)) >= 0.8:
            a, b = (decontam.fingerprint(decontam.shingle_hashes(decontam.word_hashes([" ".join(x)])[0], 5)) for x in (w, v))
            far = max(far, (a ^ b).bit_count())
    assert 0 < far <= decontam.RADIUS
    assert sum(math.comb(64, k) * 0.1515**k * 0.8485 ** (64 - k) for k in range(decontam.RADIUS + 1, 65)) < 1e-5


def test_repeats_nulls_and_empty_tables(spark, docs):
    items = [(1, "one two three four five six seven"), (1, "zzz one two three four five six seven")]
    rows = [(None, "x one two three four five six seven y"), (5, "one two three four five six seven"), (5, "one two three four five six seven")]
    out = decontam.contaminated(docs(rows), bench(spark, items[:1])).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["5", "5", "None"] and all(r["similarity"] == 1.0 and r["item_id"] == 1 for r in out)
    assert decontam.contaminated(docs(rows), bench(spark, [])).count() == 0 and decontam.drop_contaminated(docs(rows), bench(spark, [])).count() == 3
    assert decontam.contaminated(docs([]), bench(spark, items)).count() == 0 and decontam.drop_contaminated(docs([]), bench(spark, items)).columns == docs([]).columns
    for words in (decontam.BLOCK_WORDS, 1):
        assert decontam.contaminated(docs(rows), bench(spark, items), words).count() == 3
        assert decontam.drop_contaminated(docs(rows), bench(spark, items), words).count() == 0


def test_item_ids_of_other_types(spark, docs):
    rows = [(1, "one two three four five six seven"), (2, "other")]
    items = spark.createDataFrame([("a-7", "one two three four five six seven"), (None, "one two three four five six seven")], "item_id string, text string")
    out = decontam.contaminated(docs(rows), items)
    assert out.schema["item_id"].dataType.simpleString() == "string"
    assert sorted((r["doc_id"], str(r["item_id"])) for r in out.collect()) == [(1, "None"), (1, "a-7")]


def test_items_with_one_id_and_with_none_count(spark, docs):
    items = [(1, "a b c d e f g h"), (1, "i j k l m n o p"), (1, "i j k l m n o p"), (None, "q r s t u v w x")]
    rows = [(1, "a b c d e f g h"), (2, "i j k l m n o p"), (3, "q r s t u v w x"), (4, "none of it"), (5, "a b c d e f g h i j k l m n o p")]
    for words in (decontam.BLOCK_WORDS, 1):
        out = decontam.contaminated(docs(rows), bench(spark, items), words).collect()
        assert sorted((r["doc_id"], str(r["item_id"])) for r in out) == [(1, "1"), (2, "1"), (3, "None"), (5, "1"), (5, "1")]
        assert [r["doc_id"] for r in decontam.drop_contaminated(docs(rows), bench(spark, items), words).collect()] == [4]


def test_query(spark, small):
    want = brute.contaminated([r[:2] for r in small("documents")], small("benchmark"))
    assert found(op10_decontamination(spark, "/root/testdata/sf0.001")) == {k: round(s, 9) for k, s in want.items()}
