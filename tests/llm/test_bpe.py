import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillframe.llm import bpe
from quillframe.llm.queries import op4_bpe

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n\n b", "\t\tx", "don't we'll I'M you'Re", "aaaaaaaaaaaaaaaa", "x" * 5000, "naïve café ÀÉ", "日本語のテキスト 中文", "👍🏽 emoji 👨‍👩‍👧",
    "1234567890 3.14 1e-9", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> <|endof", " nbsp em", "\r\n\r\n x", "a\x00b\x1c c", "ſt İ ß ǆ", "é combining", "﻿bom", "…—“quoted”",
    "   lead", "trail   ", "tab\t space \t mix", "\u0085next", "ab " * 3000, "!!!???", " 's 't", "_a_b_ c_d", "𝔘𝔫𝔦 𝟙𝟚", "​zero‍", "a　b 　 c",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_same_ids_as_the_library(library):
    own = bpe.load()
    rng = random.Random(6)
    parts = [*ODD, *"abc XYZ.,'\n\t0é日", "the", " and", "'s"]
    texts = ODD + ["".join(rng.choice(parts)[:40] for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x2000, 0x2070), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(200)]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_decode_of_any_ids(library):
    own, rng = bpe.load(), random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, dtype=np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 500)
    own = bpe.Bpe(bpe.default_path())
    texts = ["one two three", "four five six seven", "one two"]
    assert [own.encode_batch([t])[0].tolist() for t in texts * 2] == [x.tolist() for x in bpe.load().encode_batch(texts * 2)]


def test_odd_rows(docs, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(900, None), (None, "null id"), (901, "twice"), (901, "twice"), (902, "very long " * 60_000)]
    out = sorted(map(repr, map(tuple, bpe.digests(docs(rows)).collect())))
    assert out == sorted(repr((i, *want(library, t))) for i, t in rows)
    assert bpe.digests(docs([])).count() == 0


def test_encode_and_decode_tables(docs):
    rows = [(1, "a b"), (2, None), (None, "ç"), (3, "")]
    ids = bpe.encode(docs(rows))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(ids.withColumn("extra", ids["doc_id"])).collect()}
    assert back == {1: "a b", 2: "", None: "ç", 3: ""}


def test_query(spark, small, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in op4_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r[0]: want(library, r[1]) for r in small("documents")}
