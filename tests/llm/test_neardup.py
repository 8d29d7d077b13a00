"""Near copies of the pipeline's stage against all pairs of shingle sets."""

import itertools
import random
import re

import corpus_pipeline
import pytest

from agentmeter.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain_kept(rows):
    """The smallest ids of the classes of rows (id, text), by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(least.values())


def cloud(n, words, most, seed):
    """Copies of one text with up to most changed words: some are alike enough, some aren't."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(text)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_stage_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [4096, 40])
def test_stage_on_clouds(spark, sf, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = list(enumerate(cloud(150, 150, 8, 1) + cloud(60, 400, 20, 2) + cloud(40, 12, 1, 3) + ["short text", "Short  TEXT", "other text"]))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == plain_kept(rows)


def test_ids_do_not_decide(spark, sf):
    texts = {x: " ".join(f"{x}{i}" for i in range(50)) for x in "abcd"}
    rows = [(5, texts["a"]), (5, texts["b"]), (None, texts["c"]), (None, texts["c"]), (3, texts["a"] + " more"), (3, texts["a"] + " more"), (None, texts["d"]), (9, texts["d"]), (7, None), (8, " \n"), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    kept = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert kept == sorted([(5, texts["b"]), (0, texts["c"]), (3, texts["a"] + " more"), (9, texts["d"]), (7, "")])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_texts_around_a_template_are_no_group(spark, sf, monkeypatch):
    """Half of each text is the template's: nothing is near but the copies, and no pair is compared for the rest."""
    monkeypatch.setattr(neardup, "BLOCK", 40)
    template = [f"t{i}" for i in range(200)]
    texts = [" ".join(template + [f"own{k}x{i}" for i in range(100)]) for k in range(400)]
    copies = [" ".join(texts[k].split()[:-2] + [f"changed{k}", "end"]) for k in range(0, 400, 8)]
    rows = list(enumerate(texts + copies))
    seen = []
    real = neardup.refined
    monkeypatch.setattr(neardup, "refined", lambda *a: seen.append(real(*a)) or seen[-1])
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == list(range(400))
    assert seen[0].groupBy("root").count().agg({"count": "max"}).first()[0] == 2 and seen[0].count() <= 100


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_refined_groups_keep_each_link(spark, similarity):
    texts = cloud(60, 60, 12, 4) + cloud(30, 15, 4, 5) + ["a b c", "a b c d e", "a b c d e f"]
    df = spark.createDataFrame([(i, i % 1, len(plain_set(t)), t) for i, t in enumerate(texts)], "node long, root long, n long, text string")
    root = {r.node: r.root for r in neardup.refined(df.union(df), 5, similarity).collect()}
    for (i, a), (j, b) in itertools.combinations(enumerate(map(plain_set, texts)), 2):
        if len(a & b) >= similarity * len(a | b):
            assert root[i] == root[j]


def test_no_link_is_missed_on_the_larger_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    texts = {r.text: r.doc_id for r in docs.orderBy(docs.doc_id.desc()).collect()}
    ids, sets = zip(*[(i, neardup.shingles(t)) for t, i in texts.items()])
    root = {i: i for i in ids}
    for a, b in neardup.linked(list(ids), [0] * len(ids), list(sets), 0.8):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {i: new if r == old else r for i, r in root.items()}
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == sorted(set(root.values()))
