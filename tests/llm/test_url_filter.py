import brute
import pytest

from quillframe.llm import url_filter
from quillframe.llm.queries import LISTED, RULES, op1_url_filters

URLS = [
    None, "", "no scheme", "http://", "http:///p", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "x://notexample.org/es/",
    "http://a.b.com/fr/", "http://a.b.com/de/1", "http://com/de/", "http://com?/de/", "http://spam-farm.example.org", "http://x.spam-farm.example.org/q",
    "http://xspam-farm.example.org/", "http://casino-win.example.org#a?b", "http://É.net/É", "a://b://c.org/", "http://casino-win.example.org/es/x", "http://free-bets.example.com/fr/1",
    "http://" + "a." * 3000 + "example.com/" + "p" * 50_000, "http://free-bets.example.com", "http://FREE-bets.example.com/x", "http://line\nbreak.net/a\nb?c",
]


@pytest.fixture
def pages(spark):
    def make(urls):
        rows = [(None if k == 3 else k, u, "<html>", "host", "key", "rule") for k, u in enumerate(urls)]
        return spark.createDataFrame(rows, "page_id long, url string, html string, host string, key string, rule string")

    return make


def listed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_against_brute_force(spark, pages):
    urls = URLS + URLS[5:8]
    out = url_filter.url_verdicts(pages(urls), RULES, listed(spark, LISTED)).collect()
    want = [(None if k == 3 else k, *brute.judge(u, RULES, LISTED)) for k, u in enumerate(urls)]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        url_filter.url_verdicts(pages(urls), RULES, listed(spark, LISTED), max_words=0)


def test_cascade_is_exact_in_its_universe(spark):
    keys = [f"k{k}.example.org" for k in range(6000)]
    wanted = keys[::7]
    universe = listed(spark, keys + keys[:50] + [None])
    cascade = url_filter.build_cascade(universe, listed(spark, [*wanted, *wanted, None, "not.in.universe"]), rate=0.5)
    assert len(cascade.levels) > 3
    found = universe.distinct().filter("key is not null").filter(cascade.contains(universe["key"])).collect()
    assert sorted(r["key"] for r in found) == sorted(wanted)


def test_empty_tables(spark, pages):
    assert url_filter.url_verdicts(pages([]), RULES, listed(spark, LISTED)).count() == 0
    out = url_filter.url_verdicts(pages(URLS), [], listed(spark, [])).collect()
    assert {r["verdict"] for r in out} == {"allow"} and all(r["rule"] is None for r in out)


def test_query(spark, small):
    got = {r["page_id"]: tuple(r)[1:] for r in op1_url_filters(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r[0]: brute.judge(r[1], RULES, LISTED) for r in small("pages")}


def test_no_python_on_the_executors(spark):
    plan = op1_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
