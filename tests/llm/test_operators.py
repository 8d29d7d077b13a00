"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows and odd columns."""

import fractions
import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from agentmeter.llm import components, decontaminate, langid, linededup, mixing, quality, secrets, sharding, simhash, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, white and very long texts, repeated rows, and columns with names the operators use."""
    long_text = "the quick brown fox jumps over the lazy dog again " * 4000
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 4),
        (4, long_text, "en", None, 1),
        (4, long_text, "en", None, 1),
        (5, "same line of more than twenty characters\nx", "en", "b", 1),
        (6, "same line of more than twenty characters\ny", None, "b", 1),
        (7, "SAME line of more than twenty characters \nz", "de", "b", 1),
        (None, "same line of more than twenty characters\nw", "de", "b", 1),
        (8, "ein Satz in deutscher Sprache mit Wörtern", "de", "c", 1),
        (9, "😀 123 !!", "de", "c", 1),
    ]
    df = spark.createDataFrame([(*r[:1], r[1].encode("utf-16", "surrogatepass").decode("utf-16") if r[1] else r[1], *r[2:]) for r in rows], SCHEMA)
    for name in ("size", "shard", "key", "range", "print", "drops", "rank", "copies", "held_out", "item_id", "count", "row", "part", "cell", "n", "start", "epochs", "label", "slice", "__region", "__id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# simhash


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(grams))


def plain_groups(prints):
    """(id, print) to the smallest id reachable at two or fewer differing bits."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if ((prints[i][1] ^ prints[j][1]) % 2**64).bit_count() <= 2:
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, f"{p:016x}", least[root(i)]) for i, (doc, p) in enumerate(prints)]


def test_simhash_equals_all_pairs(documents):
    rows = documents.select("doc_id", "text").collect()
    want = plain_groups([(r.doc_id, plain_print(r.text)) for r in rows])
    got = [tuple(r) for r in simhash.near_groups(documents).collect()]
    assert sorted(got) == sorted(want)


def test_links_lose_none_in_a_dense_cloud(spark):
    rng = random.Random(5)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(150):
        p = centre
        for _ in range(rng.randint(0, 3)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(100)} | {0, 1, 2**63, 2**64 - 1}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    found = components.components(simhash.links(spark.createDataFrame(signed, "print long"))).collect()
    root = {r.node % 2**64: r.root for r in found}
    want = plain_groups([(p, p) for p in sorted(prints)])
    classes = {}
    for p, _, least in want:
        classes.setdefault(least, set()).add(p)
    got = {}
    for p in prints:
        got.setdefault(root.get(p, ("alone", p)), set()).add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize(("dense", "short", "size"), [(4096, 16, 1000), (6, 2, 7), (3, 2, 1), (40, 4, 13)])
def test_cells_join_what_is_near_in_them(monkeypatch, dense, short, size):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = random.Random(4)
    rows = []
    for cell in range(40):
        prints = {rng.getrandbits(64) - 2**63}
        for _ in range(rng.choice([0, 1, 2, 5, 30])):
            prints.add(rng.choice(sorted(prints)) ^ 1 << rng.randrange(62) ^ 1 << rng.randrange(62))
        rows += [(cell, p) for p in sorted(prints)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], ["cell", "print"]) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
    found = [r for b in simhash._met(iter(batches)) for r in b.to_pylist()]
    edges = {(r["a"], r["b"]) for r in found if r["b"] is not None}
    assert all(((a ^ b) % 2**64).bit_count() <= 2 for a, b in edges)
    for cell in range(40):
        own = [p for c, p in rows if c == cell]
        left = [r["a"] for r in found if r["b"] is None and r["cell"] == cell]
        assert sorted(left) == (own if left else []) and (not left or len(own) > min(dense, 10**9))
        if not left:
            want = plain_groups([(p, p) for p in own])
            names = {p: p for p in own}
            for _ in own:
                for a, b in edges:
                    if a in names and b in names:
                        names[a] = names[b] = min(names[a], names[b])
            assert [names[p] for p in own] == [g for _, _, g in want]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, None)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(1000, 1100)} == {1000} and len(found) == 161
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(odd, none):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_groups(odd).collect()}
    assert got[1, "0" * 16] == got[2, "0" * 16] == got[3, "0" * 16] == 1
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id in (1, 2, 3, 4)").collect()) == [1, 4]
    assert simhash.near_groups(none).count() == simhash.keep_one(none).count() == 0


# line dedup


def plain_lines(rows, min_docs=3):
    holders = {}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders.get(key(x), ())) < min_docs or max(d for d in holders[key(x)] if d is not None) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_equal_brute_force(documents, odd, none):
    for docs in (documents, odd, documents.where("doc_id % 7 = 0").unionByName(odd.select(documents.columns))):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in linededup.dedup_lines(docs).collect()), key=str) == plain_lines(rows)
    assert linededup.dedup_lines(none).count() == 0


def test_hot_lines_are_split(documents, monkeypatch):
    """One line in all documents, and lines that reach several sub-shards: no group is larger than its share, and nothing changes."""
    docs = documents.withColumn("text", F.concat_ws("\n", "text", F.lit("a line that every document ends with")))
    want = sorted((tuple(r) for r in linededup.dedup_lines(docs).collect()), key=str)
    assert want == plain_lines([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    monkeypatch.setattr(linededup, "SPLIT", 5)
    monkeypatch.setattr(linededup, "SHARD_PAIRS", 50)
    assert sorted((tuple(r) for r in linededup.dedup_lines(docs).collect()), key=str) == want


def duck_rows(sql, tmp_path, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    found = con.sql(sql)
    return sorted((tuple(r) for r in found.select(*sorted(found.columns)).fetchall()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_sql_agrees_on_odd_rows(documents, odd, tmp_path):
    """Null and repeated ids, with the same text and with others."""
    few = documents.where("doc_id < 40")
    docs = odd.select(documents.columns).unionByName(few).unionByName(few.withColumn("text", F.concat("text", F.lit("\nmore")))).unionByName(few.withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.where("text IS NULL OR length(text) < 100000").select("doc_id", "text", "source")
    assert rows_of(linededup.dedup_lines(docs)) == duck_rows(linededup.ORACLE, tmp_path / "a", documents=docs)
    assert rows_of(sharding.shard(docs)) == duck_rows(sharding.ORACLE, tmp_path / "b", documents=docs)
    assert rows_of(mixing.mix(docs)) == duck_rows(mixing.ORACLE, tmp_path / "c", documents=docs)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 20_000, dtype=np.uint64))
    index = linededup.PerfectHash(keys)
    assert sorted(index.find(keys)) == list(range(len(keys)))
    assert not len(linededup.PerfectHash(keys[:0]).find(keys[:0])) and set(linededup.PerfectHash(keys[:0]).find(keys[:5])) == {-1}


# decontamination


def least_edits(pattern, text):
    """Edits of pattern against the best place of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        before, row[0], diagonal = row[:], i, i - 1
        for j, b in enumerate(text, 1):
            row[j] = min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination_equals_alignment(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(n) for n in (3, 8, 14, 20, 20, 22)]
    texts = []
    for i in range(60):
        noisy = list(items[i % len(items)])
        for _ in range(rng.choice([0, 1, 4, 8, 12, 20, 40])):
            at = rng.randrange(len(noisy))
            rng.choice([lambda: noisy.pop(at), lambda: noisy.insert(at, rng.choice("xyz")), lambda: noisy.__setitem__(at, "q")])()
        texts.append(prose(30) + " " + "".join(noisy).upper() + "\n" + prose(rng.randint(0, 30)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(docs, benchmark).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            size = decontaminate.PIECE
            ends = [len(item)] if len(item) <= size else [*range(size, len(item), size // 2), len(item)]
            pieces = [item[max(0, e - size) : e] for e in ends]
            edits = [least_edits(p, " ".join(text.lower().split())) for p in pieces]
            fine = [e for e, p in zip(edits, pieces, strict=True) if e <= len(p) // 10]
            if fine:
                want[d, i] = min(fine)
    assert got == want and len(want) > 20
    small = decontaminate.matches(docs, benchmark, block_chars=100)  # many blocks
    assert {(r.doc_id, r.item_id): r.edits for r in small.collect()} == want


def test_runs_and_rulers_stay_bounded():
    """A million characters of padding against a thousand items of code, within a second; wrapped and indented copies are found."""
    rng = random.Random(3)
    names = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    code = [(i, "\n".join(" " * rng.choice([8, 16, 24]) + f"{names(2)} = {names(1)}  # ----------------------------" for _ in range(5))) for i in range(1000)]
    index = decontaminate.Index(code)
    for text in (" " * 10**6, "-" * 10**6, "- " * 500_000, ("x" + " " * 99) * 10_000):
        began = time.time()
        assert not any(decontaminate.hits(index, [(1, text)])) and time.time() - began < 5
    padded = "\n\n".join(names(20) for _ in range(30)) + " " * 300_000 + code[7][1].replace(" ", "\n\t  ").upper() + "=" * 300_000
    rows = [r for part in decontaminate.hits(index, [(1, padded)]) for r in part]
    assert {r[1] for r in rows} == {7} and all(padded[r[4] : r[5]].strip("=\n ") for r in rows)
    kept = [[r for part in decontaminate.hits(index, [(1, padded)]) for r in part] for decontaminate.ENTRIES in (1, 50, 1 << 20)]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1])) == sorted(map(str, kept[2]))


def test_decontamination_of_planted_and_odd_rows(spark, documents, odd, none, sf, monkeypatch):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = decontaminate.matches(documents, benchmark).collect()
    assert {(d, i) for d in texts for i in items if items[i] in texts[d]} <= {(r.doc_id, r.item_id) for r in got}
    assert all(items[r.item_id].lower()[:40] in texts[r.doc_id][r.start : r.end].lower() for r in got if not r.edits)
    monkeypatch.setattr(decontaminate, "SLICE", 700)
    (index,) = decontaminate.blocks(benchmark)
    sliced = [r for part in decontaminate.hits(index, texts.items()) for r in part]
    assert {(r[0], r[1]) for r in sliced} == {(r.doc_id, r.item_id) for r in got}
    kept = decontaminate.clean(documents, benchmark)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {r.doc_id for r in got}
    mixed_ids = spark.createDataFrame([(None, "the quick brown fox jumps over the lazy dog"), (None, "clean"), (1, "clean too"), (1, "THE quick  brown fox\njumps over the lazy dog")], "doc_id long, text string")
    fox = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.clean(mixed_ids, fox).collect()) == ["clean", "clean too"]  # by row, not by id
    item = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (None, "x"), (3, "short")], "item_id long, text string")
    kept = decontaminate.clean(odd, item)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate.matches(none, item).count() == decontaminate.matches(odd, item.limit(0)).count() == 0


# sharding and mixing


def test_shards(documents, odd, none):
    rows = sharding.shard(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id for r in rows} == set(texts) and all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert all(r.grown_shard in (r.shard, 40) for r in rows) and any(r.grown_shard == 40 for r in rows)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own))) and 0 <= s < 40
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(none).count() == 0


def test_movement_is_confined(spark):
    ids = spark.range(3000).selectExpr("id AS doc_id")
    tree = [[[1.0, 2.0], [1.0]], [[1.0, 1.0], [3.0]]]
    heavier = [[[1.0, 2.0], [1.0]], [[1.0, 1.0], [6.0]]]
    at = lambda t: {r.doc_id: r.shard for r in sharding.place(ids, t).collect()}
    old, new = at(tree), at(heavier)
    assert all(new[d] >= 3 for d in old if old[d] != new[d]) and any(old[d] != new[d] for d in old)
    share = sum(s == 5 for s in old.values()) / len(old)
    assert abs(share - 3 / 9) < 0.04
    with pytest.raises(ValueError):
        sharding.place(ids, [[[0.0]]])


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / open_ for s in names}
        above = {s for s in names if s not in capped and target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mix(documents, odd, none):
    for docs in (documents, odd):
        rows = mixing.mix(docs).collect()
        sizes, taken = {}, {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
        want = plain_targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
        again = mixing.mixed(docs)
        assert again.columns == docs.columns
    assert {r.doc_id: r.size for r in mixing.mix(documents).collect()} == {r.doc_id: len(r.text.encode().split()) for r in documents.collect()}
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0
    first, second = (sorted(map(tuple, mixing.mix(documents.repartition(n)).collect())) for n in (2, 9))
    assert first == second


def test_mixed_rows_meet_their_targets(spark):
    """Rows with null, repeated and equal ids, and columns named as the operator's own: words of a source come within one row of its target."""
    rng = random.Random(8)
    text = lambda i, n: " ".join([f"w{i}"] * n)
    rows = [(None, text(i, rng.randint(1, 60)), "a", i) for i in range(600)] + [(7, text(i, rng.randint(1, 60)), "b", i) for i in range(300)] + [(None, "same words here", "c", 0)] * 400
    rows += [(i, text(i, rng.randint(1, 30)), None, i) for i in range(500)] + [(5, None, "d", 0), (6, "", "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size long").withColumns({"mix_row": F.lit("r"), "__mix_copy": F.lit(1), "mix_key": F.lit("k")})
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.where("mix_row <> 'r' OR mix_key <> 'k' OR __mix_copy <> 1").count() == 0
    count = lambda t: len((t or "").split())
    sizes, words = {}, {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + count(r.text)
    for s, target in plain_targets(sizes).items():
        assert abs(words.get(s, 0) - target) <= 60
    copies = {}
    for r in out.collect():
        copies[r.text, r.source] = copies.get((r.text, r.source), 0) + 1
    assert all(n <= 2 for (t, s), n in copies.items() if s != "c") and copies["same words here", "c"] <= 800
    planned = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("copies")).alias("n")).collect()
    assert {r.source: r.n for r in planned if r.n} == {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # texts aren't shuffled


# top-k


def test_top_k(spark):
    """Nulls, repeated and equal ids, and vectors so large that scores need more than doubles or don't fit a long."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(700)]
    rows += [(700, None), (800, [1.0, None]), (900, [float("nan")] * 6), (None, [1.0] * 6), (1000, [1.0, 2.0]), (1001, [0.5, 0.25])]
    rows += [(100, rows[100][1]), (300, [0.25] * 6), (12, rows[11][1]), (701, [3e6, 0.0, 0.0, 0.0, 0.0, 1.0]), (702, [1e17, 1.0, 0.0, 0.0, 0.0, 0.0]), (703, [-1e300] * 6), (704, [1e308] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    good = [(i, [int(fractions.Fraction(x) * 1024 // 1) for x in v]) for i, v in rows if i not in (None, 700, 800, 900)]
    want = []
    for q, v in {(q, tuple(v)) for q, v in good if q % 100 == 0}:
        clamp = lambda n: max(-(2**63), min(2**63 - 1, n))
        scored = sorted((-clamp(sum(a * b for a, b in zip(v, w, strict=True))), c) for c, w in good if c != q and len(w) == len(v))
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:10])]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_blocks_and_shards_do_not_matter(spark, sf, monkeypatch):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = sorted(map(tuple, topk.top_k(vectors, every=7).collect()))
    monkeypatch.setattr(topk, "BLOCK", 5)
    monkeypatch.setattr(topk, "SHARD", 17)
    assert sorted(map(tuple, topk.top_k(vectors, every=7).collect())) == want


def test_products_are_exact_beyond_doubles():
    a = np.array([[2.0**20, 3.0 / 1024], [1.0 / 1024, 2.0**19 + 1 / 1024]])
    assert topk.products(a, a, 1024).tolist() == [[2**60 + 9, 2**30 + 3 * 2**29 + 3], [2**30 + 3 * 2**29 + 3, 1 + (2**29 + 1) ** 2]]


# secrets


def plain_secrets(text):
    out = []
    for kind, pattern, group, least in (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(s for _, _, s in sorted(out))


def test_secrets(documents, odd, none, spark):
    hard = ["token=password=abcdef", "secret: token: 123456789", "Api_Key='AKIA" + "Z9" * 9 + "'", "f" * 23 + " " + "a1" * 12, "paſſword=abcdefgh toKen = 12345", 'é "password" : "x-1_2=.."']
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    for docs in (documents, odd, extra):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = [(r.doc_id, r.base_sha256) for r in secrets.digest(secrets.find_secrets(docs)).collect()]
        assert sorted(got, key=str) == sorted(((d, hashlib.sha256(plain_secrets(t).encode()).hexdigest()) for d, t in texts), key=str)
    assert secrets.find_secrets(none).count() == 0


def test_lexer_equals_written_assignments():
    """Texts written assignment by assignment, whose spans are known as they are written."""
    rng = np.random.default_rng(5)
    pick = lambda *of: of[rng.integers(len(of))]
    found = 0
    for _ in range(300):
        text, constants, want = "", {}, set()
        for _ in range(rng.integers(1, 30)):
            name, quote, operator = pick("db_password", "authKey", "cookie", "title", "token_count", "v0", "v1", "v2"), pick("'", '"'), pick(" = ", "=", ": ", " := ")
            literal = "".join(pick(*"abcXYZ0189/+") for _ in range(rng.integers(0, 30)))
            name_written = pick(name, f'"{name}"')
            kind = pick("literal", "constant", "words")
            if kind == "words":
                text += "plain words, (none of them given)\n"
                continue
            text += name_written + operator
            if kind == "literal":
                at = (len(text) + 1, len(text) + 1 + len(literal), literal)
                constants[name] = at
                text += quote + literal + quote
            else:
                source = pick("v0", "v1", "v2")
                text += source
                at = constants.get(source)
                if at and len(at[2]) >= secrets.LEXED_CHARS:
                    constants[name] = at
            text += pick("\n", ";\n", ",\n")
            score = secrets.name_score(name)
            if at and score >= 2 and secrets.literal_score(at[2]) and score + secrets.literal_score(at[2]) >= secrets.THRESHOLD:
                want.add(at[:2])
        assert {(a, b) for a, b, _ in secrets.lexed(text)} == want, text
        found += len(want)
    assert found > 300


def test_lexer_follows_constants():
    spans = lambda t: [t[a:b] for a, b, _ in secrets.lexed(t)]
    assert spans('K = "Zx81kQpLm2"\ndb_password = K') == ["Zx81kQpLm2"]
    assert spans('{"clientSecret": "9fK-22kdQmz1"}') == ["9fK-22kdQmz1"]
    assert spans("export AUTH_TOKEN=qT7rT1bb9sLq") == ["qT7rT1bb9sLq"]
    assert spans('part = "abcd1234"\nprivate_key = part + "WXYZ9876"')
    assert not spans('password = "changeme"\npassword_length = "12345678"\ncolour = "Zx81kQpLm2"\ntoken_type: bearer')
    assert spans("?user=bob&auth=Zx81kQ9vLm22&x=1") == ["Zx81kQ9vLm22"] and spans("key=abc123DEF==\n") == ["abc123DEF=="]
    assert spans('private_key = """\n  MIIabc9Z81\n  QQpz77xx\n"""') == ["\n  MIIabc9Z81\n  QQpz77xx\n"]
    assert spans('k0 = "abcd1234"\n' + "".join(f"k{i + 1} = k{i} + k{i}\n" for i in range(200)) + "token = k200") == ["abcd1234"]
    assert secrets.redact("token = abcdef1234 end") == "[secret] end" and secrets.redact(None) is None


@pytest.mark.parametrize("piece", ["a", "a.", "a-1", " ", 'a="', "a:", "a:b.", 'a["', "k=k+", 'a="""x', "Aa", "k=$", 'k="\\\\', "token=a + "])
def test_scans_take_time_in_proportion(piece):
    """A megabyte of whatever could be the start of an assignment."""
    began = time.time()
    secrets.scan("=" + piece * (10**6 // len(piece)) + "=")
    assert time.time() - began < 10


# classifiers


def agree(rows, labels, name):
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(p == l for p, l in known) / len(known)


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_classifiers_on_held_out_rows(spark, odd, none, module, label, least):
    top = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet").selectExpr("doc_id", f"{label} AS label")
    rows = module.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert agree(rows, {r.doc_id: r.label for r in labels.collect()}, label) >= least
    flipped = labels.withColumn("label", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("label")).otherwise(F.col("label")))
    assert sorted((r.doc_id, r.score) for r in module.classify(docs, flipped).collect()) == sorted((r.doc_id, r.score) for r in rows)  # held-out labels aren't seen
    assert module.classify(odd, labels).count() == odd.count() and module.classify(none, labels).count() == 0
    for part in (labels.limit(0), labels.where("label = 1")):
        assert module.classify(odd, part).count() == odd.count()


def test_misspellings_share_subwords():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(("an", "the", "or", "re", "ing")) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(40)) for _ in range(400)]
    labels = [i % 4 == 0 for i in range(400)]
    texts = [t.replace(" ", f" {rng.choice(('worthless', 'pathetic'))} ", 1) if y else t for t, y in zip(texts, labels, strict=True)]
    bag = toxicity.train(texts, [int(y) for y in labels])
    assert bag.score("an worthles the") > 0.3 > bag.score("an the ingre") and bag.score("the patheticc or") > 0.3


def known_texts():
    """Texts and labels of the small tables' labelled rows, those to learn from and all."""
    docs, labels = pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    m = docs.merge(labels, on="doc_id").dropna(subset=["text"])
    return m[[zlib.crc32(str(i).encode()) % 4 != 2 for i in m.doc_id]], docs


def test_quality_equals_plain_gaussians(spark):
    """The discriminant by numpy's covariances and determinants, all rows at once."""
    learned, docs = known_texts()
    x, y = np.array([quality.statistics(t) for t in learned.text]), learned.quality.to_numpy()
    scale, mean = x.std(axis=0), x.mean(axis=0)
    within = {k: np.cov(x[y == k].T, bias=True) / np.outer(scale, scale) for k in (0, 1)}
    pooled = sum(within[k] * (y == k).sum() for k in (0, 1)) / len(y)
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled))
    z = np.clip((np.array([quality.statistics(t) for t in docs.text]) - mean) / scale, -6, 6)
    density = []
    for k in (0, 1):
        cov = 0.7 * within[k] + 0.3 * pooled + 1e-3 * np.eye(x.shape[1])
        away = z - (x[y == k].mean(axis=0) - mean) / scale
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) + np.linalg.slogdet(cov)[1]))
    odds = 0.25 * (density[1] - density[0]) + np.log((y == 1).sum() / (y == 0).sum())
    want = dict(zip(docs.doc_id, 1 / (1 + np.exp(-odds)), strict=True))
    top = "/root/testdata/sf0.01"
    got = quality.classify(spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet").selectExpr("doc_id", "quality AS label")).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.7) for r in got)


def plain_subwords(word):
    """Buckets of a word and of its character n-grams, one by one in whole numbers."""
    mask, found = 2**64 - 1, [xxhash.xxh32_intdigest(word)]
    marked = f"<{word}>"
    for n in (3, 4, 5):
        for i in range(len(marked) - n + 1):
            h = 0
            for c in marked[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
            found.append(h + n)
    return [((h & mask) * 0xD6E8FEB86659FD93 & mask) >> 49 for h in found]


def test_toxicity_scores_equal_plain_ones(spark):
    """What the trained bag says of each text, word by word and window by window."""
    top = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet").selectExpr("doc_id", "toxic AS label")
    bag = toxicity.fit(docs.select("doc_id", "text"), labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    memo = {}
    for r in docs.collect():
        words = re.findall(r"[^\W_]+(?:['’*@$!1-9][^\W_]+)*", (r.text or "").lower())
        for w in set(words) - memo.keys():
            memo[w] = float(np.mean([bag.weights[b] for b in plain_subwords(w)], dtype=np.float64))
        values = [memo[w] for w in words]
        worst = max((sum(values[i : i + 3]) / 3 for i in range(max(1, len(values) - 2))), default=0.0)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(bag.bias + worst))), abs=1e-5)


def test_toxicity_gradients_are_those_of_the_loss():
    """The joint gradient of vectors, softmax and bias against small steps of each."""
    learned = toxicity.Training(["some", "worse", "words", "worst"], -1.0, np.random.default_rng(0))
    shares, words, target = np.array([[0.5, 0.5, 0.0, 0.0], [0.0, 0.25, 0.5, 0.25]]), np.arange(4), np.array([0.0, 1.0])

    def loss():
        vectors = np.stack([learned.vectors[learned.bucket[learned.starts[w] : learned.starts[w + 1]]].mean(axis=0) for w in words])
        z = shares @ vectors @ learned.softmax.T + learned.bias
        return float(sum(np.log(np.exp(r).sum()) - r[int(t)] for r, t in zip(z, target, strict=True)))

    def slope(array, at, step=1e-6):
        array[at] += step
        above = loss()
        array[at] -= 2 * step
        below = loss()
        array[at] += step
        return (above - below) / (2 * step)

    met, vectors, softmax, bias = learned.gradients(shares, words, target)
    assert all(slope(learned.softmax, (i, j)) == pytest.approx(softmax[i, j], abs=1e-6) for i in range(2) for j in range(toxicity.WIDTH))
    assert all(slope(learned.bias, i) == pytest.approx(bias[i], abs=1e-6) for i in range(2))
    assert all(slope(learned.vectors, (met[i], j)) == pytest.approx(vectors[i, j], abs=1e-6) for i in range(0, len(met), 3) for j in (0, 7))


def test_language_equals_plain_compression(spark, documents):
    """Dictionaries from the rows in order, and each piece compressed anew."""
    rows = [r for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    rows.sort(key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
    fold = lambda t: bytes(c for c in t.lower().encode() if c >= 127 or c <= 32 or chr(c).isalpha())
    plain = {lang: b"\n".join([fold(r.text) for r in rows if r.lang == lang and r.text][:64]) for lang in sorted({r.lang for r in rows if r.lang})}
    got = {r.doc_id: r for r in langid.train_and_identify(documents).collect()}
    for r in documents.limit(60).collect():
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id].lang_pred == "und"
            continue
        data = fold(r.text)
        data = (data + b"\n") * -(-256 // len(data)) if len(data) < 256 else data
        sizes = {}
        for lang, content in plain.items():
            parameters = zstandard.ZstdCompressionParameters.from_level(6, source_size=4000, dict_size=len(content), min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False)
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress(data[i : i + 4000])) for i in range(0, len(data), 4000))
        best, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
        assert got[r.doc_id].lang_pred == best[0] and got[r.doc_id].score == pytest.approx(min(1.0, 0.5 + 5 * (second[1] - best[1]) / best[1]))
        assert got[r.doc_id].rejected == (second[1] - best[1] < 0.004 * best[1])


def test_language(spark, documents, odd, none):
    rows = langid.train_and_identify(documents).collect()
    langs = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) >= 0.95
    dictionaries = langid.learn(documents)
    got = {r.doc_id: r for r in langid.identify(odd, dictionaries).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1, 2, 3, 9)) and got[8].lang_pred == "de"
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and not kept.where("doc_id in (1, 2, 3, 9)").count()
    assert langid.train_and_identify(none).count() == langid.keep_identified(none).count() == 0
