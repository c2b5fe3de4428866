"""URL filters: host and path rules, then a Bloom filter cascade over listed hosts.

All of it is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import lower_ascii


@dataclass(frozen=True)
class Rule:
    """verdict for urls whose host is rule's host or below it and whose path starts with rule's path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, empty for null or without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


@dataclass
class Cascade:
    """Levels of Bloom filters: odd levels hold listed keys, even levels the wrong hits of the level before.

    A key of the universe that first misses at an odd level is not listed, at
    an even level listed; past the last level, it is on the side of that level.
    Within the universe it was built over, the answer is exact.
    """

    levels: list[tuple[int, int, list[int]]] = field(default_factory=list)  # bits, hashes, 64-bit words

    def contains(self, key: Column) -> Column:
        """Whether key is listed, without a join: the words are one constant array a level."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels), 0, -1):
            answer = F.when(self.hit(key, n), answer).otherwise(F.lit(n % 2 == 0))
        return answer

    def hit(self, key: Column, level: int) -> Column:
        """Whether all of key's bits are set at this level."""
        bits, hashes, words = self.levels[level - 1]
        array = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
        found = F.lit(True)
        for p in _positions(key, level, bits, hashes):
            word = F.element_at(array, (F.floor(p / 64) + 1).cast("int"))
            found = found & (word.bitwiseAND(_bit(p)) != 0)
        return found


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int"))


#: Words of one level that the driver gathers and every task carries at most: 8 MB.
MAX_WORDS = 1 << 20


def build_cascade(universe: DataFrame, listed: DataFrame, key: str = "key", rate: float = 1 / 64, max_words: int = MAX_WORDS) -> Cascade:
    """A cascade that tells listed keys from all others of universe; an error if a level would pass max_words.

    universe and listed each have the column key; repeats and nulls don't
    count. The only things gathered on the driver are counts and the filters'
    words, whose number is checked before.
    """
    u = universe.select(F.col(key).alias("_q_key")).filter("_q_key is not null").distinct()
    wanted = listed.select(F.col(key).alias("_q_key")).filter("_q_key is not null").distinct()
    inside, outside, out = u.join(wanted, "_q_key", "left_semi"), u.join(wanted, "_q_key", "left_anti"), Cascade()
    inside, outside = inside.persist(), outside.persist()
    try:
        todo, other = inside, outside
        while (n := todo.count()) > 0 or not out.levels:
            r = rate if not out.levels else 0.5  # wrong hits are few, so deeper levels may be coarse
            bits = 64 * max(1, math.ceil(n * math.log2(1 / r) / math.log(2) / 64))
            hashes = max(1, round(math.log2(1 / r)))
            if bits // 64 > max_words:
                raise ValueError(f"level {len(out.levels) + 1} of the cascade needs {bits // 64} words, more than max_words")
            level = len(out.levels) + 1
            at = todo.select(F.explode(F.array(*_positions(F.col("_q_key"), level, bits, hashes))).alias("p"))
            rows = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(_bit(F.col("p"))).alias("v")).collect()
            words = [0] * (bits // 64)
            for w, v in rows:
                words[w] = v
            out.levels.append((bits, hashes, words))
            # next: those of the other side, among the ones that reached this level, that it takes for its own
            todo, other = other.filter(out.hit(F.col("_q_key"), level)), todo
        return out
    finally:
        inside.unpersist()
        outside.unpersist()


def url_verdicts(pages: DataFrame, rules: list[Rule], listed: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    Host and path are empty for a null url or one without "://". The longest
    fitting rule decides; where none fits, a host is blocked if it or a parent
    domain is in listed (column key), else allowed. Repeated rows and null
    page_ids are kept as they are; extra columns are not read. An empty listed
    table blocks nothing. A level of the cascade has about nine bits for each
    listed host, or for each host that the level before takes wrongly; one of
    more than max_words words is an error, and nothing is left out for it.
    """
    base = pages.select("page_id", F.col("url").alias("_q_url"))
    base = base.select("page_id", host_of(F.col("_q_url")).alias("host"), path_of(F.col("_q_url")).alias("path"))
    keys = base.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
    cascade = build_cascade(keys, listed, max_words=max_words)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    bad = F.exists(suffixes(F.col("host")), cascade.contains)
    return base.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
    )
