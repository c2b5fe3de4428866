import random

import brute

import corpus_pipeline
from quillframe.llm import near_dups


def corpus(n=240, seed=3):
    """Texts with a common head, copies edited more and more, and a large group of copies."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    head = [rng.choice(words) for _ in range(30)]
    rows, k, big = [], 0, [rng.choice(words) for _ in range(90)]
    while k < n:
        w = list(big) if k % 3 == 0 else [*head, *(rng.choice(words) for _ in range(rng.randrange(1, 150)))]
        for _ in range(rng.choice([1, 2, 5])):
            rows.append((k, rng.choice([" ", "\n"]).join(w)))
            w = list(w)
            for _ in range(rng.choice([1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
            k += 1
    return rows


def test_stage_against_brute_force(spark, docs):
    rows = [*corpus(), (900, None), (901, ""), (902, "one two"), (903, "ONE\ttwo"), (904, "one two three")]
    df = docs(rows)
    out = corpus_pipeline.near(spark, df, "")
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == brute.similar(rows)
    assert len(brute.similar(rows)) < len(rows) - 40


def test_given_copies_fold(spark, small):
    rows = [(r[0], r[1]) for r in small("documents")]
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near(spark, df, "").collect())
    # 6/145 and 1/177 are similar, and 7 and 11 bits apart as fingerprints
    assert got == brute.similar(rows) and not {145, 177} & set(got)


def test_order_bears_on_time_only(spark, docs, monkeypatch):
    rows = corpus(90, 8)
    for least, most in ((0, 1 << 16), (0, 7), (10**9, 1 << 16)):
        monkeypatch.setattr(near_dups, "FREQUENT", least)
        monkeypatch.setattr(near_dups, "MOST_FREQUENT", most)
        monkeypatch.setattr(near_dups, "SAMPLE", 1)
        assert sorted(r["doc_id"] for r in near_dups.keep_one(docs(rows)).collect()) == brute.similar(rows)


def test_nulls_repeats_and_empty_tables(docs):
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (7, "m n o p q r"), (7, "s t u v w x"), (7, "m n o p q r"), (None, "M N O P Q R")]
    out = sorted((str(r["doc_id"]), r["text"]) for r in near_dups.keep_one(docs(rows)).collect())
    assert out == [("7", "m n o p q r"), ("7", "s t u v w x"), ("None", "a b c d e f"), ("None", "g h i j k l")]
    assert near_dups.keep_one(docs([])).count() == 0


def test_pairs_that_only_later_orders_or_the_last_step_find(spark, docs, monkeypatch):
    """A group in which few pairs are similar: the result doesn't hang on how many orders are tried, or on the fingerprints."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(80):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([2, 3, 4])):
            w[at] = f"x{k}-{at}"
        rows.append((k, " ".join(w)))
    want = brute.similar(rows)
    for orders, salted in ((0, 8192), (8, 8192), (2, 10)):
        monkeypatch.setattr(near_dups, "ORDERS", orders)
        monkeypatch.setattr(near_dups, "SALTED", salted)
        monkeypatch.setattr(near_dups, "SAMPLE", 1)
        assert sorted(r["doc_id"] for r in near_dups.keep_one(docs(rows)).collect()) == want
