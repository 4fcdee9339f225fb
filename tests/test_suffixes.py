from pressgraph.functions import urls as U
from pressgraph.operators import suffixes as S

LINES = ["// a comment", "", "com.pl  // with a note", "co.uk", "*.ck", "!www.ck", "CO.UK", "*.kawasaki.jp", "!city.kawasaki.jp"]


def test_rules_meet_hosts(spark):
    rules = S.suffix_rules(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert rules.count() == 6
    want = {
        "http://a.com.pl/x": ("com.pl", "a.com.pl", "a", ""),
        "http://n.a.co.uk": ("co.uk", "a.co.uk", "a", "n"),
        "http://x.y.z.ck": ("z.ck", "y.z.ck", "y", "x"),
        "http://b.www.ck": ("ck", "www.ck", "www", "b"),
        "http://z.ck": ("z.ck", "z.ck", "z.ck", ""),
        "http://m.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp", "city", "m"),
        "http://a.b.c.kawasaki.jp": ("c.kawasaki.jp", "b.c.kawasaki.jp", "b", "a"),
        "http://news.example.org": ("org", "example.org", "example", "news"),
        "http://10.0.0.1/": ("", "10.0.0.1", "10.0.0.1", ""),
        "http://localhost/": ("localhost", "localhost", "localhost", ""),
        "http://a..b/": ("", "a..b", "a..b", ""),
    }
    pages = spark.createDataFrame([(u,) for u in want] * 2 + [(None,)], "url string")
    rows = S.with_suffixes(pages, rules).collect()
    assert len(rows) == 2 * len(want) + 1
    got = {r.url: (r.suffix, r.registered_domain, r.brand, r.subdomain) for r in rows if r.url}
    assert got == want


def test_no_rules_and_no_hosts(spark):
    none = S.fixed_suffix_rules(spark).limit(0)
    one = spark.createDataFrame([("http://n.a.co.uk",)], "url string")
    assert S.with_suffixes(one, none).first().suffix == "uk"
    assert S.with_suffixes(one.limit(0), S.fixed_suffix_rules(spark)).count() == 0


def test_agrees_with_the_column_form(spark):
    urls = spark.createDataFrame([(f"http://s{i}.paper.{x}/",) for i, x in enumerate(U.MULTI_LABEL_SUFFIXES)], "url string")
    both = S.with_suffixes(urls, S.fixed_suffix_rules(spark)).withColumns({"b": U.brand("url"), "s": U.suffix("url")})
    assert both.filter("b <> brand OR s <> suffix").count() == 0 and both.count() == len(U.MULTI_LABEL_SUFFIXES)
