"""The walk along the rows of a page."""

import pyarrow as pa
from pyspark.sql import functions as F

from pressgraph.operators import body as B
from pressgraph.operators import walk as P
from pressgraph.plans import articles as A
from pressgraph.schemas import PAGES

LONG = "this is one of the long lines that we have and it was here for you"
PAGE = f'<body><div id=o><p>Lead of the day {LONG}</p><div id=c><p>{LONG}</p><p>{LONG} <a href="/x">x</a></p></div></div></body>'


def scored(spark, *rows):
    return B.scored(B.blocks(spark.createDataFrame([(i, "http://x.y/", h) for i, h in rows], PAGES)))


def test_bodies_need_no_chain_of_windows(spark):
    rows = scored(spark, (1, PAGE))
    for found in (B.page_bodies(B.body_rows(B.with_image_levels(rows))), B.body_text(B.kept_blocks(rows))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("MapInArrow") == 1


def test_a_frame_of_other_origin_is_put_in_order(spark):
    rows = scored(spark, (1, PAGE), (2, PAGE))
    want = sorted(map(tuple, B.body_text(B.kept_blocks(rows)).collect()))
    mixed = rows.withColumn("_n", F.rand(3)).repartition(5).sortWithinPartitions("_n").drop("_n")
    assert sorted(map(tuple, B.body_text(B.kept_blocks(mixed)).collect())) == want and len(want) == 2


def test_pages_of_one_id_count_as_peers(spark):
    twice = scored(spark, (1, PAGE), (1, PAGE), (None, PAGE), (2, "<p>a"))
    found = {(r["page_id"], r["pos"]): r["n"] for r in twice.groupBy("page_id", "pos").agg(F.count("*").alias("n")).collect()}
    assert {n for (i, _), n in found.items() if i == 1} == {2}
    depths = {r["page_id"]: r["d"] for r in twice.groupBy("page_id").agg(F.max("depth").alias("d")).collect()}
    assert depths == {1: 6, None: 3, 2: 0}  # both opens at a place are counted


def test_pages_over_several_batches_stay_whole():
    def batch(*ids):
        return pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64()), "x": list(range(len(ids)))})

    found = [t.column("page_id").to_pylist() for t in P._whole_pages(iter([
        batch(1, 1), batch(1, 2), batch(2, 2), batch(), batch(2), batch(3), batch(4, 4, None), batch(None)]))]
    assert [x for t in found for x in t] == [1, 1, 1, 2, 2, 2, 2, 3, 4, 4, None, None]
    ends = [(t[0], t[-1]) for t in found]
    assert all(a[1] != b[0] for a, b in zip(ends, ends[1:]))


def test_metadata_and_bodies_read_one_exchange_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.y/", f"<html lang=en><title>T</title>{PAGE}"), (2, "http://x.y/", None)], PAGES)
    found = A.parse_articles(pages).select("page_id", "title", "cleaned_text")
    rows = {r["page_id"]: (r["title"], len(r["cleaned_text"]) > 60) for r in found.collect()}
    assert rows == {1: ("T", True), 2: ("", False)}
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
