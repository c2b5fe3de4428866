import hashlib

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillframe.llm import quality
from quillframe.llm.bpe import default_path


@pytest.fixture
def tables(spark, tmp_path, small):
    """A folder of tables: the smallest documents with some odd rows."""

    def make(extra=(), rows=None):
        base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        if rows is not None:
            base = base.limit(rows)
        more = spark.createDataFrame([(i, t, None, None, None) for i, t in extra], base.schema)
        base.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(10**6 if rows is None else rows).write.parquet(f"{tmp_path}/{t}.parquet")
        return str(tmp_path)

    return make


def test_each_stage_against_brute_force(spark, tables, small):
    item = small("benchmark")[0][1]
    text = small("documents")[1][1]
    d = tables([(10_000, text), (10_001, f"{text[:900]} {item} {text[:900]}"), (10_002, None), (10_003, ""), (None, text[::-1])])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, model = docs.columns, quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, d)
        if name != "bpe":
            assert out.columns == columns
            got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        if name == "quality":
            assert got == sorted((r for r in before if model.score((r[1] or "").encode()) >= 0.3), key=repr)
        elif name == "line_dedup":
            assert got == sorted(((i, x[2]) for i, x in brute.line_dedup(before).items()), key=repr)
            assert all(r["n_chars"] is None if r["text"] is None else r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "simhash":
            # five words and a similarity of 0.8, as all near-duplicate stages have them
            assert sorted(10**9 if i is None else i for i, _ in got) == brute.similar([(10**9 if i is None else i, t) for i, t in before])
        elif name == "decontamination":
            held = {i for i, _ in brute.contaminated(before, small("benchmark"))}
            assert held and got == sorted((r for r in before if r[0] not in held), key=repr)
        else:
            library = Tokenizer.from_file(default_path())
            for r in out.collect():
                ids = library.encode(dict(before)[r["doc_id"]] or "", add_special_tokens=False).ids
                assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert out.count() == len(before)
            break
        path = f"{d}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)


def test_run_is_the_stages(spark, tables):
    d = tables()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    assert sorted(map(repr, corpus_pipeline.run(spark, d).collect())) == sorted(map(repr, docs.collect()))


def test_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables(rows=0)).count() == 0
