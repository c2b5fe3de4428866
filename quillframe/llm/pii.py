"""Personal data: keyed surrogates of the same type, gender, script and format, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import table

_TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Doña", "Госпожа"],
    "n": ["Dr", "Prof"],
}
_TITLE = "|".join(t for ts in _TITLES.values() for t in ts)
#: What a name without a title follows; and, before a colon, labels of one.
_LEAD = r"[Mm]y name is|[Rr]egards,|Sincerely,|Dear(?! (?:Sirs?|Madam|All|Everyone|Customers?|Team|Friends?|Colleagues?|Editors?|Readers?|Members?|Users?|Mrs?|Ms|Miss|Dr|Prof)\b)"
_LABEL = r"(?<![\p{L}\p{N}])(?i:name|contact|author|signed|attn)"
_FIRST = "".join(sorted({t[0] for ts in _TITLES.values() for t in ts} | {*"MmRrSD"}))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}"
_NAMED = r"(?i:token|secret|password|passwd|pwd|api[_\-]?key|access[_\-]?key)['\"]? {0,2}"
_SECRET = (
    r"(?<![A-Za-z0-9])(?:(?=[a-f]*[0-9])[0-9a-f]{32,128}|(?=[A-F]*[0-9])[0-9A-F]{32,128})(?![A-Za-z0-9])"
    r"|(?<=[=: '\"])(?<=[=:] {0,2}['\"]?)"  # both follow from what comes next, and rule out most places at once
    rf"(?<={_NAMED}[=:] {{0,2}}['\"]?)[A-Za-z0-9_+/=\-]{{8,256}}(?![A-Za-z0-9_+/=\-])"
    r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"
)
_IP = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CARD = r"(?<![\w.+])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?!\w)"
_SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
_PHONE = (
    r"(?<![\w.+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<![\w.+])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w.+\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"
)
_NAME = r"\p{Lu}[\p{Ll}'’\-]+(?: \p{Lu}[\p{Ll}'’\-]+)?(?!\p{L})"
_PERSON = rf"(?=[{_FIRST}])(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? |(?:{_LEAD})[ \n]){_NAME}"
_LABELLED = rf": {_NAME}"
#: Every kind of entity; at one place the earlier kind wins.
PATTERN = "|".join(f"(?:{p})" for p in (_EMAIL, _SECRET, _IP, _IBAN, _CARD, _SSN, _PHONE, _PERSON, rf"(?<={_LABEL}){_LABELLED}"))
#: Holds wherever PATTERN can match: each alternative begins at a rare character, so that most of prose is passed over at once.
_MAYBE = (
    rf"(?=[@0-9=:{_FIRST}_A\-])(?:[@0-9]|[=:](?<={_NAMED}[=:])|:(?<={_LABEL}:) \p{{Lu}}|(?:(?:{_TITLE})\.?|{_LEAD})[ \n]\p{{Lu}}|_(?<=gh[pousr]_)|-(?<=sk-)|AKIA)"
)

_SOUNDS = {
    "latin": (["ba", "de", "fi", "go", "lu", "mar", "nel", "per", "ro", "sti", "tan", "vel", "wen", "kor", "hal", "bri"], {"m": "us", "f": "ia", "n": "en", "s": "er"}),
    "cyrillic": (["ба", "де", "фи", "го", "лу", "мар", "нел", "пер", "ро", "сти", "тан", "вел", "вин", "кор", "хал", "бри"], {"m": "ан", "f": "ия", "n": "ен", "s": "ов"}),
    "greek": (["βα", "δε", "φι", "γο", "λου", "μαρ", "νελ", "περ", "ρο", "στι", "ταν", "βελ", "βεν", "κορ", "χαλ", "μπρι"], {"m": "ος", "f": "ια", "n": "εν", "s": "ης"}),
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _kind(m: Column) -> Column:
    """The type of a mention, which PATTERN matched."""
    full = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(full(_EMAIL), "email").when(full(_IP), "ip").when(full(_IBAN), "iban").when(full(_CARD), "card")
        .when(full(_SSN), "ssn").when(full(_PHONE), "phone").when(full(f"{_PERSON}|{_LABELLED}"), "person").otherwise("secret")
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _gender(m: Column) -> Column:
    of = lambda g: m.rlike(f"^(?:{'|'.join(_TITLES[g])})(?:\\.| )")
    return F.when(of("m"), "m").when(of("f"), "f").otherwise("n")


def _key(*parts) -> Column:
    return F.concat_ws("\u0001", *parts)


#: What stands before the name in a mention of a person.
_BEFORE = rf"^(?:(?:{_LEAD})[ \n]|\S+ )"


def _units(m: Column) -> Column:
    """What stands behind a mention, as type\\x01norm: one for most types, a name's words for a person.

    The norm is free of format, so that mentions of one thing share it: digits
    for numbers (the last ten of a phone), lower case for e-mail and hex.
    """
    words = F.split(F.regexp_replace(m, _BEFORE, ""), " ")
    last, first = F.element_at(words, -1), F.element_at(words, 1)
    surname = _key(F.lit("surname"), _script(last), last)
    given = _key(F.lit("given"), F.concat(_gender(m), F.lit("/"), _script(first)), first)
    one = (
        F.when(_kind(m) == "email", _key(F.lit("email"), F.lit(""), F.lower(m)))
        .when(_kind(m) == "phone", _key(F.lit("phone"), F.lit(""), F.right(_digits(m), F.lit(10))))
        .when(_kind(m).isin("card", "ssn"), _key(_kind(m), F.lit(""), _digits(m)))
        .when(_kind(m) == "iban", _key(F.lit("iban"), F.lit(""), F.replace(m, F.lit(" "), F.lit(""))))
        .when(_kind(m) == "ip", _key(F.lit("ip"), F.lit(""), m))
        .otherwise(_key(F.lit("secret"), F.lit(""), F.when(m.rlike("^[0-9A-F]+$"), F.lower(m)).otherwise(m)))
    )
    return F.when(_kind(m) == "person", F.when(F.size(words) > 1, F.array(given, surname)).otherwise(F.array(surname))).otherwise(F.array(one))


def _letters(s: Column, seed: Column, keep: int = 0) -> Column:
    """s with each digit and letter replaced by another of its class; the first keep characters stay."""
    def one(c: Column, i: Column) -> Column:
        h = F.xxhash64(seed, i)
        pick = lambda a: F.substr(F.lit(a), F.pmod(h, F.lit(len(a))).cast("int") + 1, F.lit(1))
        return (
            F.when(i < keep, c).when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        )

    return F.array_join(F.transform(F.split(s, ""), one), "")


def _hex(s: Column, seed: Column) -> Column:
    one = lambda c, i: F.substr(F.lit("0123456789abcdef"), F.pmod(F.xxhash64(seed, i), F.lit(16)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.split(s, ""), one), "")


def _checksum(digits: Column) -> Column:
    """The Luhn sum of digits, mod 10."""
    def add(total: Column, x: Column) -> Column:
        d, odd = x["c"].cast("int"), F.pmod(x["i"], F.lit(2)) == 1
        twice = d * 2
        return total + F.when(odd, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    numbered = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.pmod(F.aggregate(numbered, F.lit(0), add), F.lit(10))


def _surrogate(kind: Column, detail: Column, norm: Column, seed: Column, attempt: int) -> Column:
    """The surrogate of a unit out of a keyed seed: same length and classes, and what the type asks for; names grow with the attempts."""
    card = F.concat(F.substr(_letters(norm, seed, 1), F.lit(1), F.length(norm) - 1))
    # the last digit leaves the checksum as it was: valid numbers stay valid
    card = F.concat(card, F.pmod(_checksum(norm) - _checksum(F.concat(card, F.lit("0"))) + 10, F.lit(10)).cast("string"))
    user, domain = F.split_part(norm, F.lit("@"), F.lit(1)), F.split_part(norm, F.lit("@"), F.lit(2))
    known = F.regexp_extract(domain, r"(example\.(?:com|net|org))$", 1)
    host = F.regexp_replace(F.regexp_replace(domain, r"example\.(?:com|net|org)$", ""), r"[^.]+$", "")
    email = F.concat(_letters(user, seed), F.lit("@"), _letters(host, F.concat(seed, F.lit("@"))), F.when(known != "", known).otherwise("example.org"))
    octet = lambda k: (F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(254)) + 1).cast("string")
    name = F.lit(None).cast("string")
    for script, (sounds, ends) in _SOUNDS.items():
        body = F.concat(*(F.element_at(F.array(*(F.lit(x) for x in sounds)), F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(16)).cast("int") + 1) for i in range(3 + attempt // 4)))
        end = F.when(kind == "surname", ends["s"])
        for g in "mfn":
            end = end.when(F.substr(detail, F.lit(1), F.lit(1)) == g, ends[g])
        # the ending of a given name says its gender, and another number of sounds keeps it from surnames
        name = F.when(detail.endswith(script), F.initcap(F.concat(body, end))).otherwise(name)
    return (
        F.when(kind == "email", email)
        .when(kind == "card", card)
        .when(kind == "ip", F.concat_ws(".", *(octet(k) for k in range(4))))
        .when(kind == "iban", _letters(norm, seed, 2))
        .when(kind.isin("given", "surname"), name)
        .when((kind == "secret") & norm.rlike("^[0-9a-f]{32,}$"), _hex(norm, seed))
        .otherwise(_letters(norm, seed))
    )


def surrogates(units: DataFrame, key: str, attempts: int = 64) -> DataFrame:
    """unit, surrogate for every distinct unit: no two of a type share one, and none is a real value of the type.

    Where a surrogate is taken, the unit with the least text keeps it and the
    others try again with the next attempt in the seed.
    """
    every = table(
        units.select("unit").distinct()
        .select("unit", *(F.split_part("unit", F.lit("\u0001"), F.lit(k)).alias(n) for k, n in ((1, "kind"), (2, "detail"), (3, "norm"))))
    )
    real = every.select(F.concat_ws("\u0001", "kind", "norm").alias("taken")).distinct()
    pending, done = every, None
    for attempt in range(attempts):
        seed = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(str(attempt)), "unit"), 256)
        tried = pending.withColumn("seed", seed).withColumn("surrogate", _surrogate(F.col("kind"), F.col("detail"), F.col("norm"), F.col("seed"), attempt)).drop("seed")
        tried = tried.withColumn("taken", F.concat_ws("\u0001", "kind", "surrogate"))
        used = real if done is None else real.unionByName(done.select("taken"))
        first = tried.groupBy("taken").agg(F.min("unit").alias("unit")).join(used, "taken", "left_anti").select("unit", F.lit(True).alias("won"))
        tried = table(tried.join(first, "unit", "left"))
        fresh = tried.filter("won").select("unit", "surrogate", "taken")
        done = fresh if done is None else done.unionByName(fresh)
        pending = tried.filter("won is null").select(*every.columns)
        if pending.isEmpty():
            return done.select("unit", "surrogate")
    raise RuntimeError("some values found no free surrogate")


def _render(m: Column, found: Column) -> Column:
    """The surrogate of a mention in the mention's own format; found maps units to surrogates."""
    units = _units(m)
    one = F.element_at(found, F.element_at(units, 1))
    # digits go to the digits' places from the right, so that separators and a country code stay
    places = F.split(F.reverse(m), "")
    counted = F.aggregate(
        places, F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda a, c: F.when(
            c.rlike("[0-9]") & (a["k"] <= F.length(one)),
            F.struct(F.concat(a["out"], F.substr(F.reverse(one), a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k")),
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
    )
    numbers = F.reverse(counted["out"])
    spaced = F.when(m.contains(" "), F.trim(F.regexp_replace(one, "(.{4})", "$1 "))).otherwise(one)
    # a given name whose title the document has elsewhere is that person's
    known = lambda u, g: F.try_element_at(found, F.replace(u, F.lit("\u0001n/"), F.lit(f"\u0001{g}/")))
    names = F.array_join(F.transform(units, lambda u: F.coalesce(known(u, "m"), known(u, "f"), F.element_at(found, u))), " ")
    upper = (F.upper(m) == m) & m.rlike("[A-Z]")
    return (
        F.when(_kind(m) == "person", F.concat(F.regexp_extract(m, _BEFORE, 0), names))
        .when(_kind(m).isin("card", "ssn", "phone"), numbers)
        .when(_kind(m) == "iban", spaced)
        .when(_kind(m) == "email", F.when(upper, F.upper(one)).otherwise(one))
        .when((_kind(m) == "secret") & m.rlike("^[0-9A-F]{32,}$"), F.upper(one))
        .otherwise(one)
    )


def _bare(name: Column) -> Column:
    """A name's word without a genitive ending or marks at its end."""
    return F.regexp_replace(name, r"(?:['’]s?|-)+$", "")


def _names(found: Column) -> Column:
    """word, surrogate of each name that found maps; the first of several for one word holds: surnames, and whole words, before others."""
    people = F.filter(F.map_entries(found), lambda e: F.split_part(e["key"], F.lit("\u0001"), F.lit(1)).isin("given", "surname"))

    def one(e: Column) -> Column:
        norm = F.split_part(e["key"], F.lit("\u0001"), F.lit(3))
        given = F.split_part(e["key"], F.lit("\u0001"), F.lit(1)) == "given"
        return F.struct((-F.length(_bare(norm))).alias("n"), (norm != _bare(norm)).alias("cut"), given.alias("given"), e["key"].alias("unit"), _bare(norm).alias("word"), e["value"].alias("to"))

    return F.array_sort(F.transform(people, one))


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """All columns of docs with surrogates in text, and n_entities, the number of mentions replaced.

    Found are e-mail and IPv4 addresses, phone, card, account (IBAN) and
    social security numbers, secrets, names after a title, a salutation, a
    closing, "my name is" or a label such as "Name:", and all other whole-word
    mentions of those names in the same document; names that nothing of that
    kind goes with are not. The same value
    has the same surrogate in all documents and formats; different values of a
    type have different ones, and no surrogate is a value that the corpus
    holds. Texts without an entity, empty and null ones (n_entities 0) among
    them, stay as they are and don't move. Rows with the same doc_id and the
    same text, and null doc_ids, get the same treatment as others; a column
    n_entities of docs is replaced.
    """
    keep = [c for c in docs.columns if c != "n_entities"]
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_q_row")
    maybe = F.coalesce(F.col("text").rlike(_MAYBE), F.lit(False))
    found = docs.select(row, "text", F.when(maybe, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("_q_found"))
    some = F.coalesce(F.size("_q_found"), F.lit(0)) > 0

    def out(df: DataFrame, text: Column, n: Column) -> DataFrame:
        return df.select(*((text if c == "text" else F.col("_q_row")[c]).alias(c) for c in keep), n.cast("int").alias("n_entities"))

    clean = out(found.filter(~some), F.col("text"), F.lit(0))
    dirty = found.filter(some).withColumn("_q_id", F.xxhash64(F.to_json("_q_row", {"ignoreNullFields": "false"})))
    dirty = table(dirty)
    units = dirty.select("_q_id", F.explode(F.array_distinct(F.flatten(F.transform("_q_found", _units)))).alias("unit")).distinct()
    named = units.join(surrogates(units, key), "unit")
    maps = named.groupBy("_q_id").agg(F.map_from_entries(F.collect_list(F.struct("unit", "surrogate"))).alias("_q_map"))
    known = dirty.join(maps, "_q_id").withColumn("_q_names", _names(F.col("_q_map")))
    # longer names come first; a document without names has a pattern that matches nothing
    words = F.array_join(F.transform("_q_names", lambda e: e["word"]), "|")
    again = F.when(F.size("_q_names") > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(r"(?!)"))

    def between(x: Column) -> Column:
        """Text between mentions, with surrogates for the names that the document's mentions hold."""
        hits = F.regexp_extract_all(x, F.col("_q_again"), F.lit(0))
        to = lambda w: F.get(F.filter("_q_names", lambda e: e["word"] == w), F.lit(0))["to"]
        return F.array_join(F.transform(F.split(x, F.col("_q_again")), lambda y, i: F.concat(y, F.coalesce(to(F.get(hits, i)), F.lit("")))), "")

    rest = F.split(F.col("text"), PATTERN)
    named_too = F.size("_q_names") > 0
    new = F.array_join(
        F.transform(rest, lambda x, i: F.concat(F.when(named_too, between(x)).otherwise(x), F.coalesce(_render(F.get("_q_found", i), F.col("_q_map")), F.lit("")))), ""
    )
    more = F.aggregate(rest, F.lit(0), lambda n, x: n + F.size(F.regexp_extract_all(x, F.col("_q_again"), F.lit(0))))
    return clean.unionByName(out(known.withColumn("_q_again", again), new, F.size("_q_found") + F.when(named_too, more).otherwise(0)))
