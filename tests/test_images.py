"""Image search around the body, on hand-made pages."""

from pyspark.sql import functions as F

from pressgraph.operators import body as B
from pressgraph.operators import media as V
from pressgraph.plans import articles as A

LONG = "this is one of the long lines that we have and it was here for you"
BODY = f"<div><p>{LONG}</p><p>{LONG}</p>@</div>"


def pages(spark, *htmls, url="http://x.y/"):
    return spark.createDataFrame(
        [(i, f"{url}{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def sizes(spark):
    rows = [("big", 600, 400), ("wide", 301, 200), ("small", 200, 150), ("thin", 50, 50), ("banner", 900, 100)]
    d = [(f"http://x.y/{n}.jpg", 9000, w, h) for n, w, h in rows]
    return spark.createDataFrame(d + [("http://x.y/light.jpg", 100, 600, 400), ("http://x.y/button.jpg", 9000, 600, 400)],
                                 "src string, bytes long, width int, height int")


def searched(spark, *htmls):
    rows = B.scored(B.blocks(pages(spark, *htmls)))
    found = V.search_images(B.image_levels(rows), sizes(spark)).collect()
    return {r["page_id"]: (r["src"].split("/")[-1].removesuffix(".jpg"), r["level"] >> 32, r["level"] & 0xFFFFFFFF) for r in found}


def img(name):
    return f'<img src="/{name}.jpg">'


def test_nearest_level_that_accepts_an_image_decides(spark):
    inner = BODY.replace("@", img("small"))
    empty = BODY.replace("@", "")
    got = searched(
        spark,
        f"<div><div>{img('big')}</div>{inner}</div>",
        f"<div><div>{img('big')}</div><p>{img('small')}</p>{empty}</div>",
        f"<div><div>{img('big')}</div><p>{img('thin')}{img('banner')}{img('light')}{img('button')}{img('unknown')}</p>{empty}</div>",
        f"<div>{empty}<div>{img('small')}</div><div>{img('wide')}</div></div>",
        f"<div><div>{img('small')}</div><div><div><div>{empty}</div></div></div></div>",
        f"<div><div>{img('big')}</div><div><div><div><div>{empty}</div></div></div></div></div>",
        f"<div><div class=navbar>{img('big')}</div>{empty}</div>",
        f"<div>{img('small')}{empty}</div><div>{img('wide')}</div>",
        f"<div>{img('big')}</div>",
    )
    assert got == {0: ("small", 0, 0), 1: ("small", 0, 1), 2: ("big", 0, 2), 3: ("wide", 1, 0)}


def test_score_within_a_level(spark):
    page = BODY.replace("@", img("small") + img("wide") + img("big"))
    rows = B.scored(B.blocks(pages(spark, page)))
    r = V.search_images(B.image_levels(rows), sizes(spark)).first()
    # Third of three: a third of its share of 1.48 times the first area.
    assert r["src"].endswith("big.jpg") and r["confidence"] == 33
    assert abs(r["score"] - 600 * 400 / (200 * 150 * 1.48) / 3) < 1e-9


def test_articles_take_known_then_large_then_named_image(spark):
    head = '<head><meta property="og:image" content="/og.jpg"></head>'
    link = '<head><meta property="og:image" content="/og.jpg"><link rel="image_src" href="/link.jpg"></head>'
    with_image, without = BODY.replace("@", img("big")), BODY.replace("@", "")
    p = pages(
        spark, f'<html>{head}<body><div id="big_photo">{img("small")}</div>{with_image}</body></html>',
        f"<html>{head}<body>{with_image}</body></html>", f"<html>{head}<body>{without}</body></html>",
        f"<html>{link}<body>{without}</body></html>", f"<html><body>{without}</body></html>", None)
    p = p.filter("html IS NOT NULL").unionByName(p.filter("html IS NULL"))
    got = {r["page_id"]: r["top_image"] for r in A.parse_articles(p, images=sizes(spark)).select("page_id", "top_image").collect()}
    assert {k: v and (v["src"], v["extraction_type"]) for k, v in got.items()} == {
        0: ("http://x.y/small.jpg", "known"), 1: ("http://x.y/big.jpg", "bigimage"), 2: ("http://x.y/og.jpg", "opengraph"),
        3: ("http://x.y/link.jpg", "linktag"), 4: None, 5: None}


def test_containers_known_for_a_site(spark):
    classes = V.site_image_classes(spark)
    site = classes.orderBy("domain", "css").first()
    html = f'<body><div class="{site["css"]}">{img("big")}</div></body>'
    from pressgraph.operators import meta as M
    here = V.known_images(M.with_head(pages(spark, html, url=f"http://www.{site['domain']}/")), classes)
    assert here.select(F.regexp_extract("src", "[^/]+$", 0)).first()[0] == "big.jpg"
    assert V.known_images(M.with_head(pages(spark, html)), classes).count() == 0


def test_one_shuffle_of_the_page_for_the_search(spark):
    plan = B.image_levels(B.scored(B.blocks(pages(spark, "<p>a"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
