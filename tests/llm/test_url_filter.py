import re

import pytest

from tieout.llm import url_filter

URLS = [
    None,
    "",
    "no scheme/en/",
    "http://",
    "http://example.com",
    "http://example.com?x=/en/",
    "http://Example.COM/en/",
    "http://www.EXAMPLE.com/en/x?u=http://b.net/es/",
    "http://notexample.com/en/",
    "http://example.com/EN/",
    "https://a.b.net/es/1#top",
    "https://net/fr/",
    "https://xnet/fr/",
    "ftp://casino-win.example.org/de/",
    "ftp://CASINO-WIN.example.org/de/",
    "ftp://casino-history.example.org/de/",
    "http://my-casino.example.org/x",
    "http://x.org/museum/casino/1",
    "http://x.org/a/casino/1",
    "http://adserver:8080/x",
    "http://adserver.org/x",
    "http://x.org/banner/a/b/ads/1",
    "http://x.org/banner/ads/1",
    "http://ads-x.y.org",
    "http://ünïcode.example.com/en/é",
    "http://x.org/" + "a/" * 5000 + "casino/",
    "http://line\nbreak.net/es/\n",
]


def pages(spark, urls, extra=""):
    rows = [(i, u, "h", "r", 1) for i, u in enumerate(urls)] + [(None, urls[6], "h", "r", 1), (3, urls[3], "h", "r", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, rule string, token string, n int")


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict, None
    subject = (host + path).translate({c: c + 32 for c in range(65, 91)})
    found = []
    for verdict, pattern in url_filter.PATTERN_RULES:
        body = "".join({"*": ".*", "^": r"(?:[^a-zA-Z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in pattern.strip("|"))
        if re.search((r"\A(?:[^/]*\.)?" if pattern.startswith("||") else "") + body, subject, re.DOTALL):
            found.append((-len(pattern), pattern, verdict))
    return (host, path, None, min(found)[2], min(found)[1]) if found else (host, path, None, "allow", None)


def test_against_each_rule_for_each_url(spark):
    table = pages(spark, URLS)
    want = sorted(str((r["page_id"], *by_hand(r["url"]))) for r in table.collect())
    assert sorted(str(tuple(r)) for r in url_filter.query(table).collect()) == want
    assert url_filter.query(table.limit(0)).count() == 0


def test_rules_by_merge_join_and_many_rules(spark, monkeypatch):
    """The same beyond the bound of what is sent to all tasks; thousands of rules, of which each url runs few."""
    rules = [(f"||site{i}.example^", "block") for i in range(3000)] + [("||example.org^", "allow")]
    made = url_filter.rule_table(spark, (), [(v, p) for p, v in rules])
    table = spark.range(200).selectExpr("id as page_id", "concat('http://a.site', id * 31, '.example/x') as url")
    want = {(i, f"||site{i * 31}.example^" if i * 31 < 3000 else None) for i in range(200)}
    for most in (url_filter.BROADCAST_RULES, 10):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        assert {(r["page_id"], r["rule"]) for r in url_filter.judge(table, made).collect()} == want


def test_the_rarest_literal_is_the_index(spark, monkeypatch):
    """'example' is in all urls, 'rare' in one: only that one runs the rule."""
    written = {}
    keep = url_filter.write_table
    monkeypatch.setattr(url_filter, "write_table", lambda df, name: written.setdefault(name, keep(df, name)))
    table = pages(spark, ["http://rare.example.org/", *[f"http://x{i}.example.org/" for i in range(30)]])
    url_filter.judge(table, url_filter.rule_table(spark, (), [("block", "||rare.example.org/"), ("block", "||*.example.")])).collect()
    assert {(r["pattern"], r["token"]) for r in written["url_index"].collect()} == {("||rare.example.org/", "rare"), ("||*.example.", "example")}


def test_a_rule_without_a_literal_is_refused(spark):
    for pattern in ("||*.", "casino", "*casino*", "|/", "casino-"):
        with pytest.raises(ValueError, match="literal"):
            url_filter.judge(pages(spark, URLS), url_filter.rule_table(spark, (), [("block", pattern)])).collect()


def test_no_python_on_the_main_path(spark):
    plan = url_filter.query(pages(spark, URLS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
