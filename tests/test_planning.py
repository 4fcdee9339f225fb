"""Press pages are built once: no test of a computed value is copied down to the scan."""

import pytest

from pressgraph import session
from pressgraph.functions import html as H
from pressgraph.functions import text as T
from pressgraph.llm import minhash
from pressgraph.operators import graph as G
from pressgraph.operators import graph_queries as Q
from pressgraph.operators import structure as S
from pressgraph.registry import REGISTRY, load_all

DOCS = [(i, f"One two3 three; four\nfive & <six> seven {i}.", lang, "wire", 10) for i, lang in enumerate(["en", "fr", "de", "es"])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("press"))
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([*DOCS, (4, None, "en", "wire", 0)], docs).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 1.0)], "c_custkey long, c_acctbal double").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([], "p_partkey long, p_name string, p_size long").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.mark.parametrize("name", ["press_open_graph", "press_meta_tree", "best_images", "top_images", "press_top_container"])
def test_pages_are_built_once(spark, folder, name):
    load_all()
    plan = REGISTRY[name][0](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!DOCTYPE") == 1


def test_open_graph_rows(spark, folder):
    load_all()
    rows = REGISTRY["press_open_graph"][0](spark, folder).collect()
    assert sorted((r.page_id, r.value) for r in rows if r.key == "title") == [
        (i, "wire - One two three four five six") for i in range(4)]
    assert {r.page_id for r in rows} == {0, 1, 2, 3}


def test_citations_are_made_distinct_before_the_join(spark):
    articles = spark.createDataFrame([("u", "d", "t", "a", "x"), ("u", "d", "t", "a", "x"), ("v", "d", None, None, None)],
                                     "url string, domain string, title string, author string, date string")
    cites = spark.createDataFrame([("u", "v", "k"), ("u", "v", "k"), ("u", "v", None), ("v", "u", "k"), (None, "v", "k")],
                                  "src_url string, dst_url string, text string")
    for found, n in ((Q.sources(cites, articles), 4), (Q.citations(cites, articles), 3)):
        assert found.count() == n == found.distinct().count()
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("Aggregate")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_text_goes_past_the_patterns(spark):
    rows = spark.createDataFrame(
        [("a  b\t\n c ", "<p>x"), ("d &lt; e", '<p title="a > b">y'), ("f", "g <b>"), ("", "<>"), (None, None), ("h", "<p id='x")],
        "t string, e string")
    found = rows.select(T.inner_trim("t").alias("t"), T.unescape("t").alias("u"), H.open_tag("e").alias("o"))
    assert [tuple(r) for r in found.collect()] == [
        ("a b c", "a  b\t\n c ", "<p>"), ("d &lt; e", "d < e", '<p title="a > b">'), ("f", "f", ""), ("", "", "<>"),
        (None, None, None), ("h", "h", "")]
    plan = _plan(found)
    assert "Contains(" in plan and "StartsWith(" in plan


def test_segments_without_markup(spark):
    html = "<html lang=en><body><p>a &amp; b \u0085<p>c <br> d<img src=q.png></p><object data=1></object>end</body></html>"
    rows = S.segments(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [(r.text, r.has_media, r.first_image) for r in rows.orderBy("pos").collect() if r.text or r.has_media] == [
        ("a & b\u0085", False, None), ("c\nd", True, "q.png"), ("end", False, None)]
    assert "markup" in _plan(rows)


def test_rows_to_merge_are_carried_once(spark):
    rows = spark.createDataFrame([(1, "a", "z"), (1, "b", None), (1, "b", "c"), (None, None, "x")], "id long, text string, html string")
    found = G.one_per_key(rows, ["id"])
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "b", "c"), (None, None, "x")]
    assert "max_by" not in _plan(found)


def test_texts_are_not_shuffled_to_their_pairs(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = [b"a b c", b"a b c", b"x y z", None]
        rows = spark.createDataFrame([(i, minhash.zstandard.compress(t or b"")) for i, t in enumerate(words)], "id long, text binary")
        texts = session.bucketed(rows, "texts", "id")
        pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "a long, b long")
        found = minhash.confirmed(pairs, texts, 2)
        assert [tuple(r) for r in found.collect()] == [(0, 1)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2  # the pairs, once by each end
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
