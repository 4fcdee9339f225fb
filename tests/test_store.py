"""Stored tables: touched buckets, commits of all tables, repeated batches; a stream equals whole merges."""

import pytest
from pyspark.sql import functions as F

from pressgraph import schemas
from pressgraph.operators import graph as G
from pressgraph.plans import merge as M
from pressgraph.sources import store as S
from pressgraph.streaming import ingest as N

PAGE = """<html lang="en"><head><title>{title}</title></head><body><article>
<p>The house of {name} Smith was on the hill and it was the oldest of the houses that were there in the town, and
<a href="http://other.example/{name}">they say</a> that it is a house to see.</p>
<p>And the people of the town say that {name} Smith was the one who had it, and that there is no other like it.</p>
</article></body></html>"""


def pages(spark, numbers, edition=0):
    rows = [(1000 * edition + i, f"http://site{i % 3}.example/2020/01/0{1 + i % 9}/a-story-about-{i}",
             PAGE.format(title=f"Story {i} edition {edition}", name=f"Name{'abcdefghij'[i % 10]}")) for i in numbers]
    return spark.createDataFrame(rows, schemas.PAGES)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def by_whole_merges(spark, batches):
    tables = [empty(spark, s) for s in (schemas.ARTICLES, schemas.CITES, schemas.MENTIONS, schemas.ARTICLE_TEXT)]
    for batch in batches:
        out = M.merge_pages(batch, *tables)
        tables = [spark.createDataFrame(t.collect(), t.schema) for t in (
            out.articles.select(*schemas.ARTICLES.names), out.cites, out.mentions, out.texts)]
    return out, tables


def test_an_upsert_touches_its_buckets_only(spark, tmp_path):
    store = S.Store(spark, str(tmp_path), buckets=64)
    first = spark.createDataFrame([(i, f"u{i}", f"t{i}", None, f"raw{i}") for i in range(500)], schemas.ARTICLE_TEXT)
    store.commit(lambda c: c.upsert("texts", first, G.upsert_text))
    before = store.manifest()["tables"]["texts"]
    assert len(before) == 64
    new = spark.createDataFrame([(7, "other", "new text", "h", "other raw")] * 2, schemas.ARTICLE_TEXT)
    read = []

    def change(c):
        c.upsert("texts", new, lambda old, more: read.append(old) or G.upsert_text(old, more))

    store.commit(change)
    after = store.manifest()["tables"]["texts"]
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and len(after[changed[0]]) == 1
    assert all(f"/bucket={changed[0]}/" in f for f in read[0].inputFiles())
    assert rows(store.find("texts", 7)) == [(7, "u7", "new text", "h", "raw7")]
    assert store.read("texts").count() == 500
    assert [f for f in store.find("texts", 7).inputFiles() if f"/bucket={changed[0]}/" not in f] == []


def test_edges_are_added_once_and_buckets_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FOLDERS", 2)
    store = S.Store(spark, str(tmp_path), buckets=4)
    for i in range(5):
        new = spark.createDataFrame([("a", f"d{i}", "x"), ("a", "d0", None), ("a", "d0", None), ("b", "d0", "x")], schemas.CITES)
        store.commit(lambda c, new=new: c.append_new("cites", new, schemas.CITES.names))
    assert rows(store.read("cites")) == sorted([("a", f"d{i}", "x") for i in range(5)] + [("a", "d0", None), ("b", "d0", "x")], key=repr)
    assert all(len(f) <= 3 for f in store.manifest()["tables"]["cites"].values())
    assert store.vacuum(1) > 0 and store.read("cites").count() == 7


def test_commits_are_whole(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    one = spark.createDataFrame([("d.example",)], "domain string")

    def broken(c):
        c.append_new("domains", one, ["domain"])
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        store.commit(broken)
    assert store.version() == 0 and store.read("domains").count() == 0

    def late(c):
        c.append_new("domains", one, ["domain"])
        if store.version() == 0:  # another writer is faster
            S.Store(spark, str(tmp_path)).commit(lambda d: d.append_new("domains", one, ["domain"]))

    with pytest.raises(S.Conflict):
        store.commit(late)
    assert rows(store.read("domains")) == [("d.example",)]
    assert store.commit(lambda c: None, "s", 3) and not store.commit(lambda c: c.add("domains", one), "s", 3)
    assert store.read("domains").count() == 1


def test_rows_of_one_url_are_laid_over_in_order(spark):
    new = spark.createDataFrame([("u", 2, None, "b"), ("u", 1, "first", "a"), ("u", 3, None, None)], "url string, seen long, title string, author string")
    old = spark.createDataFrame([("u", "old", None), ("v", "kept", None)], "url string, title string, author string")
    assert rows(G.merge_articles(old, new, "seen")) == [("u", "first", "b"), ("v", "kept", None)]


def test_a_stream_with_a_repeated_batch_equals_whole_merges(spark, tmp_path):
    batches = [pages(spark, range(6)), pages(spark, range(4, 9), 1), pages(spark, range(2), 2)]
    out, (articles, cites, mentions, texts) = by_whole_merges(spark, batches)
    store = S.Store(spark, f"{tmp_path}/store", buckets=8)
    folder = f"{tmp_path}/in"
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
        N.merge_pages_stream(N.page_stream(spark, folder), store, f"{tmp_path}/checkpoint", once=True).awaitTermination()
    assert store.manifest()["streams"] == {"pages": 2}
    # The last batch once more, as after a failure between the commit and Spark's own log.
    assert not M.merge_into(store, batches[2], stream="pages", batch=2)
    assert rows(store.read("articles")) == rows(articles, *schemas.ARTICLES.names)
    assert rows(store.read("cites")) == rows(cites) and cites.count() > 0
    assert rows(store.read("mentions")) == rows(mentions, *schemas.MENTIONS.names) and mentions.count() > 0
    assert rows(store.read("texts")) == rows(texts, *schemas.ARTICLE_TEXT.names)
    assert {d for (d,) in rows(store.read("domains"))} == {f"site{i}.example" for i in range(3)}
    assert {u for u, _ in rows(store.read("frontier"))} >= {u for (u,) in rows(out.frontier, "url")}
