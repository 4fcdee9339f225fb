"""Graph, crawl and plan invariants."""

from pyspark.sql import functions as F

from pressgraph.functions import text as T
from pressgraph.operators import crawl as C
from pressgraph.operators import graph as G
from pressgraph.operators import graph_queries as Q
from pressgraph.operators import media as V
from pressgraph.options import JobOptions, extend
from pressgraph.sources import tables as S


def test_upsert_is_idempotent(spark):
    schema = "id long, url string, text string, html string, raw_html string"
    old = spark.createDataFrame([(1, "u1", "t", "h", "r")], schema)
    new = spark.createDataFrame([(1, "x", "t2", None, "x"), (2, "u2", "t", "h", "r")], schema)
    once = G.upsert_text(old, new)
    assert sorted(map(tuple, once.collect())) == [(1, "u1", "t2", None, "r"), (2, "u2", "t", "h", "r")]
    assert sorted(map(tuple, G.upsert_text(once, new).collect())) == sorted(map(tuple, once.collect()))
    assert S.find_text(once, id=2).count() == 1 and S.find_text(once).count() == 0


def test_merges_keep_one_row_of_a_repeated_key(spark):
    schema = "url string, domain string, title string"
    old = spark.createDataFrame([("u", "d", "old")], schema)
    new = spark.createDataFrame([("u", None, "a"), ("u", None, "b"), ("v", "e", None), ("v", "e", None)], schema)
    once = G.merge_articles(old, new)
    assert sorted(map(tuple, once.collect())) == [("u", "d", "b"), ("v", "e", None)]
    assert sorted(map(tuple, G.merge_articles(once, new).collect())) == sorted(map(tuple, once.collect()))
    texts = "id long, url string, text string, html string, raw_html string"
    rows = spark.createDataFrame([(1, "u", "a", "h", "r"), (1, "u", "b", "h", "r")], texts)
    first = G.upsert_text(spark.createDataFrame([], texts), rows)
    assert [tuple(r) for r in G.upsert_text(first, rows).collect()] == [(1, "u", "b", "h", "r")]


def test_stubs_have_no_domain_edge_by_default(spark):
    arts = spark.createDataFrame([("http://a/1", "a")], "url string, domain string")
    cites = spark.createDataFrame([], "src_url string, dst_url string, text string")
    links = spark.createDataFrame(
        [("http://a/1", "http://b/2", "x"), ("http://a/1", "http://b/2", "x"), ("http://a/1", "/rel", "y"),
         ("http://a/1", "http://b/3.pdf", "z")], cites.schema)
    a, c, stub_from = G.merge_citations(arts, cites, links)
    assert c.count() == 1 and a.count() == 2 and stub_from.count() == 0
    assert G.merge_citations(arts, cites, links, True)[2].count() == 1


def test_strict_stats_need_both_directions(spark):
    edges = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "url string, domain string")
    cites = spark.createDataFrame([("1", "2"), ("2", "1"), ("1", "3")], "src_url string, dst_url string")
    loose = Q.domain_stats(cites, edges)
    assert {r["domain"] for r in Q.domain_stats(cites, edges, strict=True).collect()} == {"a", "b"}
    assert {r["domain"] for r in loose.collect()} == {"a", "b", "c"}


def test_frontier_and_memo(spark):
    links = spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "c"), ("a", "s")], "src_url string, dst_url string")
    seeds = spark.createDataFrame([("s",)], "url string")
    assert {tuple(r) for r in C.crawl_frontier(seeds, links).collect()} == {("s", 0), ("a", 1), ("b", 2)}
    seen = spark.createDataFrame([("d", "1"), ("d", "2"), ("e", "1")], "domain string, url string")
    cand = spark.createDataFrame([("d", "3", "t"), ("d", "1", "t")], "domain string, url string, title string")
    assert [r["url"] for r in C.fresh_articles(cand, seen).collect()] == ["3"]
    assert {tuple(r) for r in C.updated_memo(cand, seen, limit=1).collect()} == {("e", "1")}


def test_top_k_and_limits_stay_out_of_full_sorts(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("url"), (F.col("id") % 3).cast("string").alias("source_url"), F.col("id").alias("date"))
    plan = Q.top_nodes(df, "date", 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = C.sample_articles(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_stop_word_dimension_is_broadcast(spark):
    words = spark.range(1000).select(F.lit("en").alias("lang"), F.col("id").cast("string").alias("word"))
    plan = words.join(T.stop_word_table(spark), ["lang", "word"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_videos(spark):
    html = ('<object width="1"><param name="movie" value="http://vimeo.com/1"><embed src="http://vimeo.com/1"></object>'
            '<embed src="http://www.youtube.com/2"><iframe src="http://else.where/"></iframe><video src="youtube"></video>')
    got = spark.range(1).select(V.videos(F.lit(html)).alias("v")).first()["v"]
    assert [(v["embed_type"], v["provider"]) for v in got] == [("object", "vimeo"), ("embed", "youtube")]


def test_options_ignore_unknown_names():
    assert extend(JobOptions(), memoize=False, nothing=1) == JobOptions(memoize=False)
