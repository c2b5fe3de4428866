import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillframe.llm import token_store
from quillframe.llm.bpe import default_path
from quillframe.llm.queries import op9_token_store


@pytest.mark.parametrize("values", [[], [0], [255], [256], [2**32 - 1], list(range(3000)), [2**24, 1, 2**16, 300, 7] * 700, [50256] * 1025, [0] * 512 + [70000] * 513])
def test_codes_give_any_value(values):
    codes = token_store.DirectCodes.of(token_store.DirectCodes.encode(np.array(values, dtype=np.uint32)))
    assert len(codes) == len(values) and codes.slice(0, len(values)).tolist() == values
    rng = random.Random(1)
    for i in rng.sample(range(len(values)), min(200, len(values))):
        assert codes[i] == values[i]
    for _ in range(100):
        a, b = sorted((rng.randrange(len(values) + 1), rng.randrange(len(values) + 1)))
        assert codes.slice(a, b).tolist() == values[a:b]
    with pytest.raises(IndexError):
        codes[len(values)]


def test_codes_refuse_damage():
    blob = token_store.DirectCodes.encode(np.arange(1000, dtype=np.uint32))
    for bad in (b"XXXX" + blob[4:], blob + b"\0", blob[:-4]):
        with pytest.raises(ValueError):
            token_store.DirectCodes.of(bad)


def test_one_token_reads_a_few_bytes_of_its_file(spark, small):
    rows = [(i, t) for i, t, *_ in small("documents")[:40]] + [(10_000, "long text " * 20_000)]
    store = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), partitions=2)
    library = Tokenizer.from_file(default_path())
    for i, t in rows[::7] + rows[-1:]:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        assert token_store.tokens(store, i) == ids and token_store.tokens(store, i, 3, 9) == ids[3:9] and token_store.tokens(store, i, len(ids) - 1) == [2]
    assert token_store.tokens(store, -1) == []
    row = store.filter("array_contains(doc_ids, 10000)").first()
    with token_store.TokenFile(row["file"]) as file:
        codes, read = file.block(row["at"], row["size"]), []
        inner = codes.read
        codes.read = lambda at, n: read.append(n) or inner(at, n)
        place = sum(row["lengths"][: row["doc_ids"].index(10_000)]) + 5000
        assert codes[place] == token_store.tokens(store, 10_000, 5000, 5001)[0]
    assert sum(read) < 300 and row["size"] > 10_000


def want(rows):
    """doc_id: (start, n_tokens, crc) in the order of rows."""
    library, at, out = Tokenizer.from_file(default_path()), 0, []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_odd_rows(docs):
    rows = [(None, "null comes first"), (-5, "negative"), (1, None), (2, ""), (3, "<|endoftext|> x"), (4, "long text " * 50_000), (7, "same"), (7, "same"), (9, "é\n\n  z")]
    shuffled = rows[::-1]
    for n in (1, 3, 20):
        got = token_store.read_store(token_store.write_store(docs(shuffled), partitions=n)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want(rows)))
    assert token_store.token_digests(docs([])).count() == 0


def test_one_id_with_different_texts(docs):
    rows = [(1, "a"), (5, "first text"), (5, "second"), (5, "third one here"), (8, "z")]
    got = sorted(tuple(r)[1:] for r in token_store.token_digests(docs(rows)).collect())
    ends = [s + n for s, n, _ in got]
    assert [s for s, _, _ in got] == [0, *ends[:-1]] and ends[-1] == want(rows)[-1][1] + want(rows)[-1][2]


def test_query(spark, small):
    got = sorted(map(tuple, op9_token_store(spark, "/root/testdata/sf0.001").collect()))
    assert got == want(sorted(r[:2] for r in small("documents")))
