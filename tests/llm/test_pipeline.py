"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline
from tests.llm.test_neardup import plain_kept


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf)
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name != "shards":
            assert docs.columns == columns
        if name == "language":
            assert ids == {r.doc_id for r in before if any(map(str.isalpha, r.text or ""))}
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in after) == plain_kept([(r.doc_id, r.text) for r in before])
        if name == "benchmark":
            dirty = {r.doc_id for r in before if any(i in r.text for i in items)}
            assert ids == {r.doc_id for r in before} - dirty
        if name == "mixture":
            count = {}
            for r in after:
                count[r.doc_id] = count.get(r.doc_id, 0) + 1
            assert max(count.values()) <= 2 and ids <= {r.doc_id for r in before}
            words = lambda rows: sum(len(r.text.split()) for r in rows)
            assert 1.3 < words(after) / words(before) < 1.7
        if name == "shards":
            assert len(after) == len(before) and all(0 <= r.shard < 40 for r in after)


def test_odd_input(spark, sf):
    columns = "doc_id long, text string, lang string, source string, n_chars long, shard string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (None, "some words here", "en", "a", 1, None), (3, "some words here", "en", "a", 1, None), (3, "some words here", "en", "a", 1, None)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, columns)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "shards" or out.columns == docs.columns
            assert out.count() <= docs.count() * 2
