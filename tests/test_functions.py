"""Golden rows for URL, text and metadata rules."""

from pyspark.sql import functions as F

from pressgraph.functions import dates as D
from pressgraph.functions import html as H
from pressgraph.functions import text as T
from pressgraph.functions import urls as U
from pressgraph.operators import meta as M
from pressgraph.operators import topics as P


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_article_url_reasons(spark):
    cases = {
        "http://x.c": "too_short",
        "ftp://example.com/a/b/c": "bad_structure",
        "http://example.com": "no_path",
        "http://example.com/a/car.jpg": "bad_file_type",
        "http://amazon.com/a/b/2014/01/02/x": "bad_domain",
        "http://example.com/a-b-c-d-e-f-g": "slug",
        "http://cnn.com/cnn-b-c-d-e-f-g": "few_chunks",
        "http://example.com/index.html": "few_chunks",
        "http://example.com/careers/2014/01/02": "bad_chunk",
        "http://careers.example.com/a/b": "bad_chunk",
        "http://example.com/2014/01/02/title.html": "date",
        "http://example.com/News/title": "good_path",
        "http://example.com/xyz/title": "default",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r["url"]: r["url_reason"] for r in U.with_url_verdict(df).collect()}
    assert got == cases


def test_url_parts(spark):
    df = spark.createDataFrame([("http://User@News.BBC.co.uk:80/a/b.html?x=1&url=http%3A%2F%2Fz.z%2F#f",)], "u string")
    row = df.select(
        U.netloc("u"), U.host("u"), U.brand("u"), U.subdomain("u"), U.registered_domain("u"),
        U.file_type("u"), U.query_param("u", "url"), U.remove_args("u", ["x"]), U.fragment("u")).first()
    assert list(row) == [
        "User@News.BBC.co.uk:80", "news.bbc.co.uk", "bbc", "news", "bbc.co.uk", "html", "http://z.z/",
        "http://User@News.BBC.co.uk:80/a/b.html?x=1", "f"]


def test_resolve(spark):
    base = "http://a.b/c/d;p?q#f"
    cases = {
        "g": "http://a.b/c/g", "./g": "http://a.b/c/g", "/g": "http://a.b/g", "//g": "http://g",
        "?y": "http://a.b/c/d;p?y", "#s": "http://a.b/c/d;p?q#s", "../g": "http://a.b/g",
        "../../../g": "http://a.b/g", "g/./h": "http://a.b/c/g/h", "": base, "mailto:x": "mailto:x",
        "g/../h?x=../y": "http://a.b/c/h?x=../y", "..": "http://a.b/",
    }
    df = spark.createDataFrame([(r,) for r in cases], "r string")
    got = {r["r"]: r["v"] for r in df.select("r", U.resolve(F.lit(base), "r").alias("v")).collect()}
    assert got == cases


def test_redirects_and_encoding(spark):
    assert one(spark, U.prepare_url(F.lit("http://pin.it/?url=http%3A%2F%2Fx.y%2F"), F.lit("http://cnn.com"))) == "http://x.y/"
    assert one(spark, U.prepare_url(F.lit("http://m.cnn.com/?url=1"), F.lit("http://cnn.com"))) == "http://m.cnn.com/?url=1"
    assert one(spark, U.quote_non_ascii(F.lit("http://x/é a"))) == "http://x/%C3%A9 a"
    assert one(spark, U.quote_spaces(F.lit("a b"))) == "a%20b"
    assert one(spark, U.is_absolute(F.lit("http://example.com/a"))) is True
    assert one(spark, U.is_absolute(F.lit("/a"))) is False
    for url in ("https://localhost/x", "FTP://10.0.0.1:21/", "http://[::1]:80/a", "http://a-b.c.example.?q=1"):
        assert one(spark, U.is_absolute(F.lit(url))) is True, url
    for url in ("http://host/a", "mailto:a@b.example", "http://-a.example/", "http://a..b/", "http://a.example/x y", "//a.example/", ""):
        assert one(spark, U.is_absolute(F.lit(url))) is False, url
    assert one(spark, U.seed_url(F.lit("https://x.y"))) == "https://x.y"
    assert one(spark, U.seed_url(F.lit("x.y"))) == "http://x.y"
    assert one(spark, U.urls_in_text(F.lit("<b>see</b> http://a.b/c?d=1, and https://e.f/g h"))) == [
        "http://a.b/c?d=1,", "https://e.f/g"]


def test_text(spark):
    assert one(spark, T.unescape(F.lit("&amp;lt; &#233;&#x41; &copy; &bogus; a & b"))) == "&lt; éA © &bogus; a & b"
    assert one(spark, T.inner_trim(F.lit(" a\t\n b  "))) == "a b"
    assert one(spark, T.title_case(F.lit("ou-yang o'brian"))) == "Ou-Yang O'Brian"
    assert one(spark, P.tokens(F.lit("U.S.A. well-known $12.40 82% ... end;"))) == [
        "U.S.A.", "well-known", "$12.40", "82", "...", "end", ";"]
    assert one(spark, P.phrases(F.lit("The New York Times said Bob-Lee went"))) == ["The New York Times", "Bob-Lee"]
    df = spark.createDataFrame([("en", "The cat, and a dog")], "lang string, t string").withColumn("w", T.words("t"))
    assert df.select(T.stop_word_count("w", "lang").alias("n")).first()["n"] == 3
    assert len(T.stop_words("en")) > 150 and T.stop_words("xx") == ()


def test_dates(spark):
    for text in ("2014-03-05", "2014/3/5", "March 5, 2014", "5 Mar 2014", "/2014/03/05/", "Wed, 5 Mar 2014"):
        assert str(one(spark, D.parse_date(F.lit(text)))).startswith("2014-03-05"), text
    for text in ("soon", "March 5, 2014 10:00 AM XYZ", "February 30th, 2014", "Marketing 5, 2014", "March 5, 2014 25:00 CET"):
        assert one(spark, D.parse_date(F.lit(text))) is None, text


def test_dates_in_words(spark):
    for text, want in {
        "March 5, 2014 10:00 AM EST": "2014-03-05 15:00:00", "Wednesday, March 5th, 2014 at 9:30 pm": "2014-03-05 21:30:00",
        "mar 5th, 2014": "2014-03-05 00:00:00", "mercredi 5 mars 2014 à 18h05": "2014-03-05 18:05:00",
        "1er août 2014": "2014-08-01 00:00:00", "Mittwoch, 5. März 2014, 7:00 Uhr CET": "2014-03-05 06:00:00",
        "5 de marzo de 2014": "2014-03-05 00:00:00", "5.3.2014": "2014-03-05 00:00:00",
        "March 5, 2014 12:00 am (PST)": "2014-03-05 08:00:00", "2014-03-05 10:00:30.25 +0530": "2014-03-05 04:30:30",
        "5 March 2014 10:00 GMT+2": "2014-03-05 08:00:00",
    }.items():
        assert str(one(spark, D.parse_date(F.lit(text)).cast("string"))) == want, text


def test_bylines_and_titles(spark):
    line = F.lit("<div>By: <strong>Lucas Ou-Yang</strong>, <strong>Alex Smith</strong></div>")
    assert one(spark, M.parse_byline(line)) == ["Lucas Ou-Yang", "Alex Smith"]
    titles = {
        "Site | A longer title": "A longer title", "Short - The long part": "The long part",
        "a_bcd": "bcd", "x: yz": "yz", "Plain": "Plain", "": "",
    }
    for raw, want in titles.items():
        assert one(spark, M.split_title_text(F.lit(raw))) == want, raw
    clean = M.clean_title(F.lit("| My title - www.x.com"), F.lit("Site"), F.lit("www.x.com"))
    assert one(spark, clean) == "My title"


def test_elements(spark):
    page = F.lit('<p class="a Date">x</p><a data-x="class=date" href=\'/u\'>y</a>')
    assert one(spark, F.size(H.elements(page, None, "class", "date"))) == 1
    assert one(spark, F.transform(H.elements(page, "a"), lambda e: H.attribute(H.open_tag(e), "href"))) == ["/u"]
    pattern = H.attribute_pattern(["id", "class"], ["^side$", "foot"])
    for tag, want in (('<p class="side">', True), ('<p class="sides">', False), ('<p id="x-footer">', True)):
        assert one(spark, F.lit(tag).rlike(pattern)) is want, tag
