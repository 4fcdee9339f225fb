"""Stored texts leave no old versions behind."""

import os

from pressgraph import schemas
from pressgraph.registry import REGISTRY, load_all


def test_old_versions_are_deleted(spark, tmp_path):
    load_all()
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(2, "b", "en", "s", 1)], docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "u", "<p>"), (4, "v", "<p>")], schemas.PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    rows = REGISTRY["stored_texts"][0](spark, str(tmp_path))
    files = [f.removeprefix("file:") for f in rows.inputFiles()]
    root = files[0].split("/texts/")[0]
    # Only what the last commit names is there: a bucket that it did not touch stays where it was written.
    assert set(os.listdir(f"{root}/texts")) == {f.removeprefix(f"{root}/texts/").split("/")[0] for f in files}
    assert len(os.listdir(f"{root}/texts")) < 3 and all(f.endswith(".zstd.parquet") for f in files)
    assert sorted((r.id, r.text, r.html, r.raw_html) for r in rows.collect()) == [
        (2, None, "<p>", "b"), (4, None, "<p>", "<p>")]
