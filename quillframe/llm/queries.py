"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import bpe, decontam, jpeg, line_dedup, pii, quality, simhash, suffix_dedup, token_store, url_filter

RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
]
#: Domains that are blocked, with all below them, where no rule says otherwise.
LISTED = [
    "ads-track.example.org", "adult-x.example.net", "casino-win.example.org",
    "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"), RULES, listed)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_digests(read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


#: The key of the registered query; a deployment takes its own from a secret store.
PII_KEY = "registered query"


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digests(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _url_sql() -> str:
    rules = []
    for r in sorted(RULES, key=lambda r: -len(r.text)):
        rules.append(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then ")
    order = sorted(RULES, key=lambda r: -len(r.text))
    text = " ".join(c + f"'{r.text}'" for c, r in zip(rules, order, strict=True))
    verdict = " ".join(c + f"'{r.verdict}'" for c, r in zip(rules, order, strict=True))
    listed = " or ".join(f"host = '{x}' or ends_with(host, '.{x}')" for x in LISTED)
    return f"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from a
)
select page_id, host, path, case {text} end as rule, case {verdict} when {listed} then 'block' else 'allow' end as verdict from b
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_simhash": op2_simhash,
    "op3_progressive_jpeg": op3_progressive_jpeg,
    "op4_bpe": op4_bpe,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_store": op9_token_store,
    "op10_decontamination": op10_decontamination,
}
SQL: dict[str, str] = {"op1_url_filters": _url_sql(), "op8_line_dedup": line_dedup.SQL}
