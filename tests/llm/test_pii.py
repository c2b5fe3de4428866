import re
from collections import defaultdict

import brute

from quillframe.llm import pii
from quillframe.llm.queries import op5_pii_surrogates

TEXTS = [
    "Write to ann.lee@example.com or ANN.LEE@EXAMPLE.COM, not bob@mail.example.org.",
    "Mr John Smith met Mrs John Smith and Dr. Smith; Mr Smith left. Господин Иван Петров тоже.",
    "Call +1 415 555 2671 or (415) 555-2671 or 415.555.2671; other 415-555-2672.",
    "Card 4111 1111 1111 1111 and 4111111111111111, bad 4111111111111112.",
    "Hosts 10.1.2.3 and 10.1.2.4 and 10.1.2.3; version 1.2.3.4.5 stays.",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password: hunter2secret',
    "DE89 3704 0044 0532 0130 00 is DE89370400440532013000; SSN 123-45-6789.",
    "Nothing here.", "", None, "An e-mail: ann.lee@example.com again, and 10.1.2.3.",
]


def run(docs, rows, key="k"):
    return {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.replace_pii(docs(rows), key).collect()}


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10


def test_surrogates(docs):
    rows = list(enumerate(TEXTS))
    out = run(docs, rows)
    text = {k: v[0] for k, v in out.items()}
    for secret in ("ann.lee", "ANN.LEE", "bob@", "John", "Smith", "Иван", "Петров", "555", "4111", "10.1.2", "24be64", "hunter2", "0532", "123-45-6789"):
        assert not any(secret in (t or "") for t in text.values()), secret
    # coreference: one value has one surrogate, in each mention's own format and in all documents
    mail = re.findall(r"\S+@[\w.]+\w", text[0])
    assert mail[0].upper() == mail[1] and mail[0] != mail[2] and mail[0] in text[10] and mail[0].endswith("@example.com")
    names = re.findall(r"(Mr|Mrs|Dr\.) (\w+)(?: (\w+))?", text[1])
    assert names[0][2] == names[1][2] == names[2][1] == names[3][1] and names[0][1] != names[1][1]
    assert re.search(r"Господин [А-Яа-я]+ [А-Яа-я]+ тоже", text[1])
    phones = re.findall(r"\+1 \d{3} \d{3} \d{4}|\(\d{3}\) \d{3}-\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}", text[2])
    digits = [re.sub(r"\D", "", p)[-10:] for p in phones]
    assert len(phones) == 4 and digits[0] == digits[1] == digits[2] != digits[3]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", text[3])
    assert len(cards) == 3 and cards[0].replace(" ", "") == cards[1] and [luhn(c) for c in cards] == [0, 0, 1]
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+(?!\.\d)", text[4])
    assert ips[0] == ips[2] != ips[1] and "1.2.3.4.5" in text[4] and ips[0] in text[10]
    assert re.search(r'token = "[0-9a-f]{40}" password: [a-z0-9]{13}$', text[5])
    assert re.search(r"^DE\d\d(?: \d{4}){4} \d\d is DE\d{20}; SSN \d{3}-\d\d-\d{4}\.$", text[6])
    a, b = re.findall(r"DE[\d ]+\d", text[6])
    assert a.replace(" ", "") == b
    assert out[7] == ("Nothing here.", 0) and out[8] == ("", 0) and out[9] == (None, 0)


def test_every_title(docs):
    titles = [t for ts in pii._TITLES.values() for t in ts]
    out = run(docs, [(k, f"heute kam {t} Müller an.") for k, t in enumerate(titles)])
    for k, t in enumerate(titles):
        assert out[k][1] == 1 and "Müller" not in out[k][0] and out[k][0].startswith(f"heute kam {t} "), t


def test_other_mentions_of_a_detected_name(docs):
    rows = [(1, "Smith wrote. Mr John Smith called. Smith said so; John Smith left, Smith's hat, Smithson and Blacksmith stayed. JohnSmith"), (2, "Smith alone")]
    out = run(docs, rows)
    m = re.fullmatch(r"(\w+) wrote\. Mr (\w+) (\w+) called\. (\w+) said so; (\w+) (\w+) left, (\w+)'s hat, Smithson and Blacksmith stayed\. JohnSmith", out[1][0])
    assert m and len({m[1], m[3], m[4], m[6], m[7]}) == 1 and m[2] == m[5] and "Smith" != m[1] and m[2] != "John"
    assert out[1][1] == 6 and out[2] == ("Smith alone", 0)


def test_keys_decide(docs):
    rows = list(enumerate(TEXTS))
    assert run(docs, rows) == run(docs, rows[::-1]) and run(docs, rows)[0] != run(docs, rows, "other")[0]


def test_distinct_values_stay_distinct(docs):
    """So many addresses and names that surrogates collide and are drawn again; none is a real value."""
    ips = [f"10.{a}.{b}.7" for a in range(40) for b in range(30)]
    names = [f"Mr {a}{b} Olsen" for a in ("Ka", "Lo", "Mi", "Nu", "Pe", "Ra", "Si", "To") for b in ("ba", "de", "fi", "go", "lu", "mar", "nel", "per", "ro", "sti", "tan", "vel", "wen", "kor", "hal", "bri")]
    rows = [(k, f"from {x} on") for k, x in enumerate(ips)] + [(10_000 + k, f"and {x} too") for k, x in enumerate(names)]
    out = run(docs, rows)
    new = [out[k][0][5:-3] for k in range(len(ips))]
    assert len(set(new)) == len(ips) and not set(new) & set(ips)
    other = [out[10_000 + k][0][4:-4] for k in range(len(names))]
    assert len(set(other)) == len(names) and not set(other) & set(names) and all(x.startswith("Mr ") and x.split()[1].endswith("us") for x in other)


def test_repeats_nulls_and_empty_tables(docs):
    rows = [(None, "a@b.example.org"), (None, "a@b.example.org"), (1, "a@b.example.org"), (1, "a@b.example.org"), (2, "x " * 200_000 + "10.0.0.1")]
    df = docs(rows)
    out = pii.replace_pii(df, "k")
    found = out.collect()
    assert out.columns == [*df.columns, "n_entities"] and len(found) == 5 and len({r["text"] for r in found if r["doc_id"] != 2}) == 1
    assert all(r["n_entities"] == 1 for r in found) and pii.replace_pii(docs([]), "k").count() == 0


def test_query(spark, small):
    df = op5_pii_surrogates(spark, "/root/testdata/sf0.001")
    out = {r["doc_id"]: r for r in df.collect()}
    assert len(out) == len(small("documents")) and "Python" not in df._jdf.queryExecution().executedPlan().toString()
    finder = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[a-z]{2,}|\b\d{3}-\d{2}-\d{4}\b")
    seen = 0
    for i, text, *_ in small("documents"):
        for m in finder.findall(text):
            seen += 1
            assert m not in out[i]["text"]
        if not out[i]["n_entities"]:
            assert out[i]["text"] == text
    assert seen


KINDS = [
    ("email", pii._EMAIL), ("secret", pii._SECRET), ("ip", pii._IP), ("iban", pii._IBAN), ("card", pii._CARD), ("ssn", pii._SSN), ("phone", pii._PHONE),
]


def test_query_against_brute_force(spark, small):
    """All that isn't a mention stays; one value has one surrogate everywhere, of its format; no two values share one; none is a real value."""
    rows = {r[0]: r[1] for r in small("documents")}
    out = {r["doc_id"]: r for r in op5_pii_surrogates(spark, "/root/testdata/sf0.001").collect()}
    assert out.keys() == rows.keys()
    to, real, count = defaultdict(set), defaultdict(set), 0
    for i, text in rows.items():
        found = brute.mentions(text, KINDS)
        new, at, last = out[i]["text"], 0, 0
        assert out[i]["n_entities"] == len(found) and (found or new == text)
        for a, b, kind, norm in found:
            between = text[last:a]
            assert new[at : at + len(between)] == between
            at += len(between)
            # a surrogate's length is its mention's, but for addresses
            size = len(re.match(r"[\w.@%+\-]+\w" if kind == "email" else r"[\d.]+\d", new[at:])[0]) if kind in ("email", "ip") else b - a
            mine = new[at : at + size]
            if kind in ("phone", "card", "ssn"):
                assert re.sub(r"\d", "0", mine) == re.sub(r"\d", "0", text[a:b])
            if kind == "card":
                assert luhn(mine) == luhn(text[a:b])
            (_, _, again, value), *more = brute.mentions(f" {mine} " if kind != "secret" else f"token = {mine} ", KINDS)
            assert not more and (again == kind or kind == "card")
            to[kind, norm].add(value)
            real[kind].add(norm)
            at, last, count = at + size, b, count + 1
        assert new[at:] == text[last:]
    assert count > 20 and all(len(v) == 1 for v in to.values())
    for kind in real:
        given = [next(iter(v)) for (k, _), v in to.items() if k == kind]
        assert len(set(given)) == len(given) and not set(given) & real[kind]


def test_names_after_other_words_than_titles(docs):
    rows = [
        (1, "Hello, my name is John Smith. Mr John Smith and Smith"), (2, "Dear Maria,\nDear Customer, Dear Sir"), (3, "Contact: Jane Doe, jane@example.com"),
        (4, "Kind regards,\nErika Mustermann"), (5, "name: lower case; rename: Title; Sincerely, Ann"),
    ]
    out = run(docs, rows)
    assert out[1][1] == 3 and "John" not in out[1][0] and "Smith" not in out[1][0]
    a, b = re.search(r"my name is (\w+ \w+)\. Mr (\w+ \w+) and", out[1][0]).groups()
    assert a == b
    assert "Maria" not in out[2][0] and out[2][0].endswith("Dear Customer, Dear Sir") and out[2][1] == 1
    assert "Jane" not in out[3][0] and "Doe" not in out[3][0] and out[3][0].startswith("Contact: ")
    assert "Erika" not in out[4][0] and out[4][0].startswith("Kind regards,\n")
    assert out[5][0].startswith("name: lower case; rename: Title; Sincerely, ") and out[5][1] == 1
