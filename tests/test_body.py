"""Body rules on hand-made pages."""

from pyspark.sql import functions as F

from pressgraph.operators import body as B
from pressgraph.operators import structure as S

LONG = "this is one of the long lines that we have and it was here for you"


def rows(spark, *htmls):
    return spark.createDataFrame(
        [(i, f"http://x.y/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def texts(spark, *htmls, lenient=False):
    df = B.body_text(B.kept_blocks(B.scored(B.blocks(rows(spark, *htmls), broad=lenient, use_known=not lenient)), lenient))
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_boilerplate_links_and_known_container(spark):
    p = f"<p>{LONG}</p>"
    pages = [
        f'<body class="footer"><div id="c">{p}<div class="comment">{p}</div>{p}</div></body>',
        f'<div>{p}{p}{p}</div><article class="footer">{p}<p>(the a of and to)</p><p>few words</p></article>',
        f'<div>{p}<ul><li><a href="/a">one</a><li><a href="/b">two</a></ul>{p}</div>',
        "<div>nothing here</div>",
        f'<div><p>{LONG}<br>and of the to</p>{p}',
    ]
    got = texts(spark, *pages)
    assert got[0] == f"{LONG}\n\n{LONG}"
    assert got[1] == LONG
    assert got[2] == f"{LONG}\n\n{LONG}"
    assert 3 not in got
    assert got[4] == f"{LONG}\n\nand of the to\n\n{LONG}"


def test_loose_text_and_adopted_siblings(spark):
    page = f"<div id=o><p>Lead of the day</p><div id=c><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div>"
    got = texts(spark, page, f"<div><img src=x> {LONG} <p>{LONG}</p></div>", lenient=True)
    assert got[0].startswith("Lead of the day\n\n")
    assert got[1] == f"{LONG}\n\n{LONG}"


def test_tail_penalty_and_boost(spark):
    page = "<div>" + f"<p>{LONG}</p>" * 20 + "</div>"
    r = B.scored(B.blocks(rows(spark, page)))
    ups = [x["up"] for x in r.filter("good").orderBy("pos").select("up").collect()]
    n = r.filter("good").select("n_stop").first()["n_stop"]
    # No boost without an earlier strong paragraph, then 50/k, then the tail.
    assert ups[0] == n and ups[1] == int(n + 50) and ups[2] == int(n + 25)
    assert ups[-5] == n and ups[-1] == n - 16
    top = B.top_containers(r).first()
    assert top["tag"] == "div" and top["score"] == sum(ups) and top["n_nodes"] == 20


def test_nesting_ignores_stray_closes_and_unclosed_paragraphs(spark):
    page = "</div></ul><div><p>a<p>b<div><p>c</div></div></div><div>d</div>"
    t = S.tokens(rows(spark, page))
    assert t.agg(F.min("depth")).first()[0] == 0
    c = {r["cid"]: r for r in S.containers(t).collect()}
    assert len(c) == 3 and sorted(r["depth"] for r in c.values()) == [1, 1, 2]
    assert all(r["close_pos"] is not None for r in c.values())


def test_one_shuffle_for_the_body(spark):
    plan = B.body_text(B.kept_blocks(B.scored(B.blocks(rows(spark, "<p>a"))))) \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
