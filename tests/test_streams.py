"""Streams over tables that are one file, a folder of files, or a folder without rows."""

import glob
import os

import pytest

from pressgraph import schemas
from pressgraph.registry import REGISTRY, load_all

PAGES = [(i, f"http://site{i % 3}.example/{i}", f"<html><title>Page {i}</title></html>") for i in range(12)]


@pytest.fixture(params=["file", "folder", "empty"])
def stored(request, spark, tmp_path):
    frame = spark.createDataFrame(PAGES if request.param != "empty" else [], schemas.PAGES)
    frame.repartition(3).write.parquet(f"{tmp_path}/{'parts' if request.param == 'file' else 'pages.parquet'}")
    if request.param == "file":
        frame.coalesce(1).write.parquet(f"{tmp_path}/one")
        os.link(glob.glob(f"{tmp_path}/one/*.parquet")[0], f"{tmp_path}/pages.parquet")
    return str(tmp_path), PAGES if request.param != "empty" else []


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_streamed_pages(spark, stored, request):
    folder, pages = stored
    load_all()
    sites = [f"site{i}.example" for i in range(3)] if pages else []
    assert rows(REGISTRY["stream_domain_counts"][0](spark, folder)) == [(s, 4) for s in sites]
    assert rows(REGISTRY["stream_graph_merge"][0](spark, folder)) == sorted(
        (url, f"site{i % 3}.example", f"Page {i}") for i, url, _ in pages)
    if "folder" in request.node.name:  # the whole merge plans for long
        assert rows(REGISTRY["stream_stored_articles"][0](spark, folder)) == sorted(
            (url, f"site{i % 3}.example") for i, url, _ in pages)
