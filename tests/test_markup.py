"""Untidy markup: one tag grammar, and ends found by matching opens and closes."""

import pytest
from pyspark.sql import functions as F

from pressgraph import schemas
from pressgraph.functions import html as H
from pressgraph.operators import media as V
from pressgraph.operators import meta as M
from pressgraph.operators import structure as S
from pressgraph.plans import articles as A


@pytest.fixture(scope="module")
def tidied(spark):
    def run(*pages):
        df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
        return [r.t for r in df.select("i", H.tidy("h").alias("t")).orderBy("i").collect()]

    return run


CASES = {
    '<a title="x > y" href=/q>q</a>': '<a title="x &gt; y" href="/q">q</a>',
    "<a href='/a\"b'>t</a>": '<a href="/a&quot;b">t</a>',
    '<p class=a id="b">x</p>': '<p class="a" id="b">x</p>',
    "<br/><img src=a/b/>": '<br/><img src="a/b">',
    "<p title=it's>z</p>": '<p title="it\'s">z</p>',
    '<a href="x">fine</a>': '<a href="x">fine</a>',
    "a < b <i": "a < b <i",
    '<script>if(a<b){x="<p c=1>"}</script><p c=1>': '<script>if(a<b){x="<p c=1>"}</script><p c="1">',
    "<input disabled value=3 />": '<input disabled value="3"/>',
    "<!-- <a b=c> --><b x=1>": '<!-- <a b=c> --><b x="1">',
    '<A HREF = "u" Class = c>k</A>': '<A HREF="u" Class="c">k</A>',
}


def test_tags_are_tidied(tidied):
    assert dict(zip(CASES, tidied(*CASES), strict=True)) == CASES
    assert tidied(*CASES.values()) == list(CASES.values())  # and stay so


def test_long_broken_tags_do_not_recurse(tidied):
    long = '<p title="' + "x>" * 60_000 + '">t</p>'
    assert tidied(long)[0].endswith('&gt;">t</p>')
    assert len(tidied("<p " + "a='b' " * 30_000)) == 1 and len(tidied("<p '" * 20_000)) == 1


def meta_of(spark, html):
    pages = spark.createDataFrame([(1, "http://www.site.example/2020/01/02/story.html", html)], schemas.PAGES)
    return M.with_head(pages)


def test_metadata_in_untidy_markup(spark):
    d = meta_of(spark, """<html lang=fr><head><meta property=og:title content='A > B'>
<meta name=keywords content="a, b"></head><body><span itemprop=name>Ann <span>van</span> Lee</span>
<a rel='nofollow tag' title="1 > 0" href=/tag/x>Tagged</a><time itemprop=datePublished datetime=2014-03-05T10:00:00Z>x</time></body></html>""")
    r = d.select(M.title().alias("title"), M.authors().alias("authors"), M.tags().alias("tags"), M.publish_raw().alias("at"),
                 M.meta_language().alias("lang")).first()
    assert (r.title, r.authors, r.tags, r["at"], r.lang) == ("A > B", ["Ann van Lee"], ["Tagged"], "2014-03-05T10:00:00Z", "fr")


def test_elements_end_at_the_matching_close(spark):
    html = ('<div><span class=note>a <span>b</span> c</span> d <SPAN class="note">e</Span><span class=note>open'
            '<blockquote class=twitter-tweet>x<blockquote>y</blockquote>z</blockquote>t</div>')
    d = spark.createDataFrame([(html,)], "h string").withColumn("h", H.drop_scripts("h"))
    r = d.select(H.elements("h", None, "class", "note").alias("e"), V.tweets("h").alias("t")).first()
    assert [x.split(">", 1)[1] for x in r.e[:2]] == ["a <span>b</span> c", "e"]
    assert r.t == ['<blockquote class="twitter-tweet">x<blockquote>y</blockquote>z</blockquote>']


def test_links_and_tokens_in_untidy_markup(spark):
    pages = spark.createDataFrame([(1, "http://s.example/a/", "<body><a title='y > x' href=/q>q</a> <a href='r?a=1&amp;b=2'>r</a></body>")], schemas.PAGES)
    got = [(r.href, r.text) for r in A.page_links(pages).orderBy("href").collect()]
    assert got == [("/q", "q"), ("r?a=1&b=2", "r")]
    t = S.tokens(pages).filter("tag = 'a' AND kind = 'open'").orderBy("pos").select(F.col("attrs")["title"].alias("t")).collect()
    assert [r.t for r in t] == ["y > x", None]


def test_flagged_inline_elements_go_whole(spark):
    page = ('<html><body><div><p>One <span class=socialtools>drop <span>this <span>and</span></span> too</span> two three.</p></div></body></html>')
    rows = S.segments(spark.createDataFrame([(1, "u", page)], schemas.PAGES)).filter("tag = 'p'").collect()
    assert rows[0].text == "One two three."
