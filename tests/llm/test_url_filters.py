"""Wildcard rules against regular expressions, and the query against its SQL."""

import random
import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from fringeworks.llm import url_filters as m


def regex(glob: str):
    part = {"*": b"[^/]*", "**": b".*", "?": b"[^/]"}
    return re.compile(b"".join(part.get(x) or re.escape(bytes([x])) for x in m._tokens(glob)) + rb"\Z", re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/.*?é", max_size=20), max_size=30), st.lists(st.text("ab/.é\n", max_size=20), max_size=20), st.sampled_from([1, 2, 64]))
def test_automaton(globs, urls, words):
    """Rows of bits that lie over several words and several groups."""
    automaton = m.Automaton([m.Rule(g, "block") for g in globs], words)
    found = automaton.matches([u.encode() for u in urls])
    for u, row in zip(urls, found, strict=True):
        for rule, fits in zip(automaton.rules, row, strict=True):
            assert fits == bool(regex(rule.name).match(u.encode())), (u, rule.name)


def test_long_globs_and_urls():
    r = random.Random(4)
    text = "".join(r.choice("ab/") for _ in range(1000))
    rules = [m.Rule(text, "block"), m.Rule(text[:-1], "block"), m.Rule(f"**{text[300:600]}**", "block"), m.Rule("?" * 1000, "block"), m.Rule("**/**b*", "block")]
    automaton = m.Automaton(rules)
    for url in (text, text[:-1], "x" + text * 2, "", "c" * 1000):
        assert {automaton.rules[k].name for k, fits in enumerate(automaton.matches([url.encode()])[0]) if fits} == {x.name for x in rules if regex(x.name).match(url.encode())}


RULES = [m.site("block", "net/"), m.site("allow", "example.net/en/"), m.Rule("*spam*/**", "block"), m.Rule("**/ok", "allow"), m.Rule("**/o?", "block")]
URLS = {
    "http://a.NET": ("a.net", "", None, "allow", None),
    "http://a.NET/": ("a.net", "/", "net/", "block", None),
    "x://Example.net/en/1?q#f": ("example.net", "/en/1", "example.net/en/", "allow", None),
    "x://www.example.net/EN/": ("www.example.net", "/EN/", "net/", "block", None),
    "x://notexample.net/en/": ("notexample.net", "/en/", "net/", "block", None),
    "x://org/x.net/": ("org", "/x.net/", None, "allow", None),
    "x://a?b://net/": ("a", "", None, "allow", None),
    "x://spam.org/ok": ("spam.org", "/ok", None, "block", "*spam*/**"),
    "x://a.org/ok": ("a.org", "/ok", None, "allow", "**/ok"),
    "x://a.org/oz": ("a.org", "/oz", None, "block", "**/o?"),
    "x://ÉA.org/é\n": ("Éa.org", "/é\n", None, "allow", None),
    "net/": ("", "", None, "allow", None),
    "://net/": ("net", "/", "net/", "block", None),
    "": ("", "", None, "allow", None),
    None: ("", "", None, "allow", None),
    "x://a.org/" + "y" * 30_000: ("a.org", "/" + "y" * 30_000, None, "allow", None),
}


def test_judge(spark):
    pages = spark.createDataFrame([(k, u, "h", "p", "r") for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, path string, rule string")
    found = m.judge(pages, RULES).collect()
    want = [*URLS.values(), *URLS.values()]
    assert len(found) == len(want) and all(tuple(r)[1:6] == want[r.page_id] for r in found)
    odd = spark.createDataFrame([(None, "x://a.net/"), (None, None), (1, "x://a.net/"), (1, "x://a.net/")], "page_id long, url string")
    assert Counter((r.page_id, r.verdict) for r in m.judge(odd, RULES).collect()) == {(None, "block"): 1, (None, "allow"): 1, (1, "block"): 2}
    assert m.judge(odd, []).where("verdict = 'allow' and n_globs = 0").count() == 4
    assert m.judge(pages.limit(0), RULES).collect() == []


def test_sql_agrees(spark):
    from fringeworks.llm.queries import op12_url_filters, oracle_sql

    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"create view pages as from '{data}/pages.parquet'")
    want = db.sql(oracle_sql()["op12_url_filters"])
    got = op12_url_filters(spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
