"""The pipeline's near copies go through operator 7's grid."""

import corpus_pipeline
from agentmeter.llm import simhash


def test_fingerprints_bring_candidates_that_are_checked(spark, sf, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "one text of its own"), (4, "another one that is unlike it"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met = []
    monkeypatch.setattr(simhash, "links", lambda prints, plain=simhash.links: met.append(prints.count()) or plain(prints))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert met == [len({simhash.fingerprint(text) for _, text in rows if text})]
    assert kept == [1, 3, 4, 5]
