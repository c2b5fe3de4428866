import random

import brute
import duckdb

from quillframe.llm.line_dedup import SQL, line_dedup
from quillframe.llm.queries import op8_line_dedup


def table(df):
    return {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in df.collect()}


def test_against_brute_force(docs):
    rng = random.Random(3)
    for letters in ("ab", "abcdef"):
        rows = [(k, "\n".join(rng.choice([*letters, "", "long line " * 5]) for _ in range(rng.randrange(14)))) for k in range(120)]
        rows += [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "a\nb"), (None, "a\nb\na\nb"), (504, "x\ny\nz\n" * 4000), (505, "x\ny\nz\r\nx\ny\nz")]
        rng.shuffle(rows)
        assert table(line_dedup(docs(rows))) == brute.line_dedup(rows)


def test_repeated_rows_count_once(docs):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "a\nb\nc"), (1, "a\nb\nc"), (None, "q\nr\ns"), (None, "q\nr\ns")]
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"], r["n_removed"]) for r in line_dedup(docs(rows)).collect())
    one = [x for x in got if x[1] == 1]
    # the two equal rows are one document; of the two texts of document 1, one stays whole
    assert len(got) == 6 and [x for x in got if not x[0]] == [(False, 0, "q\nr\ns", 0)] * 2 and [x[2] for x in got if x[1] == 2] == [""]
    assert sorted(x[3] for x in one) in ([0, 0, 3], [0, 3, 3])


def test_other_columns_stay(docs):
    rows = [(1, "a\nb\nc"), (2, None)]
    before = docs(rows)
    out = line_dedup(before)
    assert set(out.columns) == set(before.columns) | {"n_removed"}
    keep = [c for c in before.columns if c not in ("n_lines", "text")]
    assert sorted(map(repr, out.select(keep).collect())) == sorted(map(repr, before.select(keep).collect()))
    assert line_dedup(docs([])).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(SQL)
    got = op8_line_dedup(spark, "/root/testdata/sf0.001").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
