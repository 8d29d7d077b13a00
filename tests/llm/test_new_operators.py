"""Hard negatives, phrases and WARC files against brute force, SQL, and odd input."""

import base64
import collections
import gzip
import hashlib
import io
import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agentmeter.llm import hardnegatives, phrases, queries, warc
from tests.test_queries import rows as plain_rows

NAMES = ["op11_hardnegatives", "op12_phrases", "op13_warc"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    df = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain_rows(df.columns, [tuple(r) for r in df.collect()]) == plain_rows(want.columns, want.fetchall())


# hard negatives


def plain_mine(rows, every=100, scale=256, n_positives=5, n_negatives=10, low=30, high=90):
    rows = [(i, lab, [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, lab, v in {(r[0], r[1], tuple(r[2])) for r in rows if r[0] % every == 0}:
        scores = sorted((-clip(sum(p * q for p, q in zip(v, w, strict=True))), i, own) for i, own, w in rows if i != a and len(w) == len(v))
        for s, i, _ in [x for x in scores if x[2] == lab][:n_positives]:
            fits = [(n, -t) for t, n, own in scores if own != lab and low * -s <= 100 * -t <= high * -s][:n_negatives]
            out += [(a, i, rank, n, -s, t) for rank, (n, t) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, score string, dim string, anchor string, shard string, row string"


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], VECTORS)
    return sorted(tuple(r) for r in hardnegatives.mine(df, **options).collect())


def test_mining_equals_brute_force(spark):
    draw = random.Random(1)
    rows = [(i, i % 3, [draw.gauss(0, 0.3) + (i % 5) / 9 for _ in range(6)]) for i in range(160)]
    rows += [(200 + i, 1, [0.25] * 6) for i in range(40)] + [(300 + i, 2, [0.125] * 6) for i in range(60)]  # ties
    want = plain_mine(rows, every=20)
    assert want and mined(spark, rows, every=20) == want


def test_mining_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5]), (2, 2, [0.5, 0.5]), (3, 1, [1.0, -3.0]), (4, 2, [0.0, 0.0]), (5, None, [1.0, 1.0]), (None, 1, [1.0, 1.0])]
    rows += [(6, 1, None), (7, 1, []), (8, 2, [1.0, None]), (9, 2, [float("nan"), 1.0]), (10, 2, [float("inf"), 1.0]), (11, 2, [0.5, 0.5, 0.5]), (100, 7, [1.0, 1.0]), (-100, 2, [-1.0, 0.25])]
    assert mined(spark, rows) == plain_mine(rows)
    assert mined(spark, []) == []


def test_mining_of_huge_components(spark):
    rows = [(0, 1, [3e5, 1.0, 0.0]), (1, 1, [2e9, 5.0, 1.0]), (2, 2, [1e9, 3.5, -2.0]), (3, 2, [1.1e9, 0.0, 1e15]), (4, 1, [-1e200, 0.0, 0.0]), (5, 2, [1e18, -1e18, 7.0]), (6, 2, [1e3, 7.0, 1e300]), (100, 2, [1e250, 1e-9, 0.0])]
    assert mined(spark, rows) == plain_mine(rows)


@pytest.mark.parametrize("size", [0.1, 1, 3000])
def test_packed_products_are_exact(size):
    draw = np.random.default_rng(int(size))
    a, b = draw.normal(0, size, (7, 9)), draw.normal(size, 1, (33, 9))
    given, asked = hardnegatives.Packed(b, 256), hardnegatives.Packed(a, 256)
    want = [[sum(int(math.floor(x * 256)) * int(math.floor(y * 256)) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert given.wide(a) == want
    fast = given.scores(asked)
    if size < 3000:  # two fields or more fit into 53 bits
        assert 53 // given.width(asked) >= 2
        assert fast.tolist() == want
    else:
        assert fast is None


def test_packing_of_constant_and_negative_columns():
    for a, b in (([[-1.0, -2.0]], [[-3.0, -3.0]] * 5), ([[0.0, 0.0]], [[5.0, -5.0], [1.0, 1.0]]), ([[4.0, 4.0]], [[0.0, 0.0]] * 3)):
        a, b = np.array(a), np.array(b)
        assert hardnegatives.Packed(b, 1).scores(hardnegatives.Packed(a, 1)).tolist() == (a @ b.T).tolist() == hardnegatives.Packed(b, 1).wide(a)


# phrases


def plain_phrases(rows, min_count, limit=2000, cover=100, most=5):
    total, counts = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, most + 1) for i in range(len(words) - n + 1))
    wanted = {k: a for k, a in counts.items() if len(k[1]) >= 2 and a >= min_count}
    found = collections.defaultdict(list)
    for (lang, p), a in wanted.items():
        inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
        if any(g == lang and inside(q) and 100 * f >= cover * a for (g, q), f in wanted.items()):
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, each in found.items() for rank, (s, a, p, left, right) in enumerate(sorted(each)[:limit], 1))


def mined_phrases(spark, rows, **options):
    df = spark.createDataFrame([(t, g, "a", "b", "c", "d", "e") for t, g in rows], "text string, lang string, phrase string, a string, n string, rank string, prefix string")
    return sorted(tuple(r) for r in phrases.mine(df, **options).collect())


def babble(draw, words, n):
    return "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!"]) for _ in range(n))


def test_phrases_equal_brute_force(spark):
    draw = random.Random(3)
    rows = [(babble(draw, ["the", "The", "of", "New York", "é", "ß-1", "İ", "a b c d e f", "x"], 60), draw.choice(["en", "de", None])) for _ in range(60)]
    want = plain_phrases(rows, 12)
    assert len(want) > 30 and any(len(r[2].split()) == 5 for r in want)
    assert mined_phrases(spark, rows, min_count=12) == want


def test_phrases_of_small_rooms_and_slices(spark, monkeypatch):
    """Spilled subtrees, bursts, new vocabularies and slices of a long text change nothing."""
    draw = random.Random(4)
    rows = [(babble(draw, [f"w{i}" for i in range(12)] + ["of the best"], 400), draw.choice(["en", "de"])) for _ in range(12)] + [("same words again " * 300, "en")]
    want = plain_phrases(rows, 9)
    texts = [(lang, text.encode()) for text, lang in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts]), pa.array([t[1] for t in texts], pa.binary())], ["lang", "text"])
    every = collections.namedtuple("Every", "value")(phrases.Known(np.full(1, 2**64 - 1, np.uint64), 64))

    def counted(sizes, **options):
        out, runs = collections.Counter(), 0
        for b in phrases._runs(sizes, every, every, **options)(iter([batch])):
            found = [h + (b" " + t if t else b"") for h, t, p in zip(*(b[c].to_pylist() for c in ("head", "tail", "part")), strict=True) if p is None]
            assert [p.split() for p in found] == sorted(p.split() for p in found)
            runs += 1
            for key, n in zip(zip(b["lang"].to_pylist(), found, strict=False), b["count"].to_pylist(), strict=False):
                out[key] += n
        return out, runs

    for sizes in ((1,), (2,), (3, 4, 5)):
        plain, few = counted(sizes)
        for name, value in (("SLICE", 50), ("BATCH", 37), ("WORDS", 5), ("MANY", 1), ("RUN", 4), ("BURST", 3), ("PAIRS", 9)):
            monkeypatch.setattr(phrases, name, value)
        spilled, many = counted(sizes, room=20)
        monkeypatch.undo()
        assert many > few + 20 and spilled == plain
    assert mined_phrases(spark, rows, min_count=9, room=20, bits=1 << 10) == want  # bitmaps that are full of false hits


def test_trie_bursts_and_spills_whole_subtrees():
    trie, plain, draw = phrases.HatTrie(depth=2, burst=3), collections.Counter(), random.Random(5)
    for _ in range(40):
        some = [[draw.randrange(1, 4) for _ in range(n)] + [0] * (5 - n) for n in (draw.randrange(3, 6) for _ in range(50))]
        trie.add(np.array(some))
        plain.update(map(tuple, some))
    assert trie.size == len(plain) and trie.burst and any(p >> 42 for p in trie.containers)
    listed = lambda runs: [dict(zip(map(tuple, ids.tolist()), n.tolist(), strict=True)) for ids, n in runs]
    runs = listed(trie.spill(len(plain) // 2))
    assert trie.size <= len(plain) // 2
    firsts = [{p[0] for p in run} for run in runs]
    assert all(len(f) == 1 for f in firsts)
    rest = listed(trie.spill())
    assert trie.size == 0 and not {p[0] for run in rest for p in run} & set.union(*firsts)
    assert dict(itertools.chain(*(r.items() for r in runs + rest))) == plain


@pytest.mark.parametrize("least", [3, 300])
def test_sketches_add_up(least):
    draw = np.random.default_rng(least)
    hashes = draw.integers(0, 2**63, 400).astype(np.uint64)
    drawn = [np.repeat(hashes[:200], least // 2 + 1), hashes[::2], np.repeat(hashes[100:300], least // 2 + 1)]
    batches = []
    for some in drawn:
        sketch = phrases.Sketch(1 << 20, least)
        sketch.add(some)
        sketch.add(some[:5])
        batches += sketch.spill()
    rows = pa.Table.from_batches(batches).sort_by("part").to_batches()
    got = {}
    for b in phrases._added(1 << 20, least)(iter(rows)):
        for place in np.flatnonzero(np.unpackbits(np.frombuffer(b["ones"][0].as_py(), np.uint8), bitorder="little")):
            got[b["part"][0].as_py() * phrases.PART + int(place)] = True
    want = collections.Counter(int(h) % (1 << 20) for some in drawn for h in [*some, *some[:5]])
    assert set(got) == {h for h, n in want.items() if n >= least}


def test_phrases_of_odd_rows(spark):
    rows = [(None, None), ("", "en"), (" \t ", "en"), (".,;:!?", "de"), ("a" * 100_000, "en")] + [("one two", None)] * 6 + [("One  two", "und")] * 6 + [("one two three", "en")] * 11
    assert mined_phrases(spark, rows, min_count=12) == plain_phrases(rows, 12) == [("und", 1, "one two", 12, 12, 12, 24, 2000)]
    assert mined_phrases(spark, rows, min_count=11) == plain_phrases(rows, 11)
    assert mined_phrases(spark, rows, min_count=11, limit=1) == plain_phrases(rows, 11, limit=1)
    assert mined_phrases(spark, rows, min_count=11, cover=60) == plain_phrases(rows, 11, cover=60)
    assert mined_phrases(spark, []) == []


def test_scores_beyond_64_bits(spark):
    big = 2**52
    frequent = spark.createDataFrame([("en", "", 2**60), ("en", "a", big + 3), ("en", "b", big + 1), ("en", "a b", big)], "lang string, phrase string, count long")
    assert [r["score"] for r in phrases.scored(frequent).collect()] == [1000 * big * 2**60 // ((big + 3) * (big + 1))]


# WARC


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = "page_id long, url string, html string, digest string, shard string, kind string, payload string, bytes string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], PAGES)


def plain_archive(rows, least=0):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    first, out = {}, []
    for page_id, _, html in order:
        payload = (html or "").encode()
        again = payload in first and len(payload) >= least
        out.append((page_id, len(payload), digest(payload), "revisit" if again else "response", first[payload] if again else None))
        first.setdefault(payload, page_id)
    return sorted(out, key=str)


ODD = [(3, "http://b/", "same é"), (1, "http://a/ b\r\nc", "same é"), (2, None, None), (4, "http://c/", ""), (None, "http://d/", "x" * 5000), (None, None, "same é"), (7, "u", "y"), (7, "u", "y"), (7, "v", "y"), (2**53 + 1, "w", "z\r\n\r\nz"), (-5, "n", "neg"), (9, "long", "é" * 300_000)]


def test_archive_of_odd_rows(spark):
    got = sorted(map(tuple, warc.archive(pages(spark, ODD)).collect()), key=str)
    assert got == plain_archive(ODD)
    got = sorted(map(tuple, warc.archive(pages(spark, ODD), least=5).collect()), key=str)
    assert got == plain_archive(ODD, least=5)
    assert warc.archive(pages(spark, [])).collect() == []


def files_of(root):
    top = root.removeprefix("file://")
    return {f: open(f"{top}/{f}", "rb").read() for f in sorted(os.listdir(top)) if f.endswith(".warc.gz")}


def test_archives_are_deterministic_sharded_and_rolled(spark):
    draw = random.Random(6)
    rows = [(draw.randrange(400), f"http://h/{i}", f"page {draw.randrange(250)} " * draw.randrange(1, 200)) for i in range(600)] + [(None, f"u{i}", f"n{i}" * 500) for i in range(40)] + [(77, f"v{i}", f"m{i}" * 900) for i in range(40)]
    options = {"shard_bytes": 40_000, "roll_bytes": 3000}
    one = warc.write(pages(spark, rows).repartition(3), **options)
    draw.shuffle(rows)
    other = warc.write(pages(spark, rows).repartition(7, "url"), **options)
    files = files_of(one)
    assert files == files_of(other) and len(files) > 10
    assert not os.path.exists(f"{one.removeprefix('file://')}/_attempts")
    listed = {r["name"]: r for r in warc.manifest(spark, one).collect()}
    assert set(listed) == set(files)
    assert all(listed[n]["sha256"] == hashlib.sha256(data).hexdigest() and listed[n]["bytes"] == len(data) for n, data in files.items())
    assert any(r["file"] > 0 for r in listed.values()) and any(r["part"] > 0 for r in listed.values())
    shards = collections.defaultdict(int)
    for name in sorted(files):
        ids = [int(x) for x in re.findall(rb"WARC-Page-ID: (-?\d+)", gzip.decompress(files[name]))]
        assert ids == sorted(ids)
        shards[listed[name]["shard"]] += len(ids)
    assert len(shards) > 5
    got = sorted(map(tuple, warc.read(spark, one).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == plain_archive(rows)


def test_payloads_round_trip_and_revisits_point_at_their_response(spark):
    root = warc.write(pages(spark, ODD))
    found = warc.read(spark, root, with_payload=True).collect()
    responses = {r["record_id"]: r for r in found if r["record_type"] == "response"}
    assert len({r["record_id"] for r in found}) == len(found)
    assert sorted(bytes(r["payload"]) for r in responses.values()) == sorted({(h or "").encode() for _, _, h in ODD})
    data = b"".join(gzip.decompress(d) for d in files_of(root).values())
    refers = re.findall(rb"WARC-Refers-To: <(.*?)>", data)
    assert len(refers) == len(found) - len(responses) and all(r.decode() in responses for r in refers)
    assert b"WARC-Target-URI: http://a/%20b%0D%0Ac\r\n" in data and b"WARC-Target-URI: urn:page:2\r\n" in data


def test_reading_finds_damage(spark):
    root = warc.write(pages(spark, ODD))
    top = root.removeprefix("file://")
    name = sorted(files_of(root))[0]
    data = bytearray(files_of(root)[name])
    data[9] = 7  # the byte of the system in the first member's header: the content is still right
    with open(f"{top}/{name}", "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, root).collect()
    with pytest.raises(ValueError, match="archive already"):
        warc.write(pages(spark, ODD), root=root)


def test_commit_can_run_again_and_members_need_an_end(tmp_path):
    (tmp_path / "_attempts").mkdir()
    (tmp_path / "_attempts" / "f").write_bytes(b"abc")
    row = ("f.warc.gz", "_attempts/f", 0, 0, 0, 1, 3, "")
    for _ in range(2):
        assert [b.num_rows for b in warc._commit(str(tmp_path))(iter([warc._as_batch([row])]))] == [1]
    assert (tmp_path / "f.warc.gz").read_bytes() == b"abc"
    with pytest.raises(OSError, match="there already"):
        list(warc._commit(str(tmp_path))(iter([warc._as_batch([(*row[:6], 9, "")])])))
    packed = warc.member(b"one") + warc.member(b"two" * 1000)
    assert list(warc.members(io.BytesIO(packed), chunk=5)) == [(0, b"one"), (len(warc.member(b"one")), b"two" * 1000)]
    with pytest.raises(ValueError, match="no end"):
        list(warc.members(io.BytesIO(packed[:-4])))
    good = warc.record("response", "id", {"A": 1}, b"block")
    assert warc.parsed(good)[1] == b"block"
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(good.replace(b"block\r\n", b"clock\r\n"))


def test_ids_beyond_doubles_keep_their_shard(spark):
    rows = [(2**60 + i, "u", f"{i}" * 2000) for i in range(50)] + [(None, "u", "n")]
    root = warc.write(pages(spark, rows), shard_bytes=20_000)
    got = warc.read(spark, root)
    assert got.where(F.col("page_id").isNotNull()).count() == 50
    spans = got.where("page_id IS NOT NULL").groupBy(F.substring("file", 1, 12)).agg(F.min("page_id").alias("a"), F.max("page_id").alias("b")).orderBy("a").collect()
    assert len(spans) > 3 and all(x["b"] < y["a"] for x, y in itertools.pairwise(spans))


# secrets: whole literals


def spans(text):
    from agentmeter.llm import secrets

    return [text[a:b] for k, a, b in secrets.scan(text) if k == "lexed"]


def test_literals_are_scored_whole():
    draw = random.Random(8)
    noise = "".join(draw.choice("abcXYZ0189+/") for _ in range(5000))
    assert spans(f'signing_key = "{noise}"') == [noise]
    assert spans(f'signing_key = "{noise} and then plain words"') == []  # spaces beyond any prefix
    assert spans(f'signing_key = "{"x" * 5000}"') == spans(f'signing_key = "example {"y" * 70}"') == spans(f'signing_key = "your_{noise}"') == []
    assert spans(f'a = "{noise[:2500]}"\nb = a + a\nsigning_key = b + b + " "') == []


def test_constants_that_double_cost_little():
    import time

    lines = ['c0 = "Zx81kQ9vLm22pR7t"'] + [f"c{i} = c{i - 1} + c{i - 1}" for i in range(1, 3000)]
    began = time.time()
    assert spans("\n".join([*lines, "signing_key = c2999"])) == ["Zx81kQ9vLm22pR7t"]
    assert time.time() - began < 5


def test_values_add_up():
    from agentmeter.llm import secrets

    draw = random.Random(9)
    for _ in range(200):
        parts = ["".join(draw.choice("ab1Z é\n*x.") for _ in range(draw.randrange(60))) for _ in range(3)]
        value = secrets.Value()
        for p in parts:
            value = value.joined(secrets.Value(p))
        whole = secrets.Value("".join(parts))
        assert (value.size, value.head, value.counts) == (whole.size, whole.head, whole.counts)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("DB_PASS=Zx81kQ9vLm22", ["Zx81kQ9vLm22"]),
        ("Authorization: Bearer Zx81kQ9vLm22pR7t", ["Zx81kQ9vLm22pR7t"]),
        ('"Authorization": "Bearer Zx81kQ9vLm22pR7t"', ["Zx81kQ9vLm22pR7t"]),
        ('<add key="client_secret" value="Zx81kQ9vLm22"/>', ["Zx81kQ9vLm22"]),
        ("<entry name='db.password'\n   value='Zx81kQ9vLm22'>", ["Zx81kQ9vLm22"]),
        ('<add key="colour" value="Zx81kQ9vLm22"/>', []),
        ('password = os.environ["APP_PASSWORD_1"]', []),
        ("password = load_secret2(9)", []),
    ],
)
def test_forms_of_assignments(text, found):
    assert spans(text) == found


# decontamination: short items, and texts that repeat themselves


def found(items, *texts):
    from agentmeter.llm import decontaminate

    rows = [r for part in decontaminate.hits(decontaminate.Index(items), enumerate(texts)) for r in part]
    return {(r[0], r[1]) for r in rows}, rows


def test_short_items_match_as_words_of_their_own():
    items = [(1, "2+2=4?!"), (2, "Paris"), (3, "x"), (4, " \n "), (5, "the cat"), (6, "12345678"), (7, "123456789")]
    texts = ["so 2+2=4?! yes", "paris", "Comparison of parish", "is Paris, x.", "oTHE cats", "a: The\n cat!", "0123456780", "01234567890", "x" * 5000, ""]
    got, rows = found(items, *texts)
    assert got == {(0, 1), (1, 2), (3, 2), (3, 3), (5, 5), (6, 6), (7, 6), (7, 7)}
    assert all(texts[d][a:b].lower().split() == dict(items)[i].lower().split() for d, i, _, _, a, b in rows)


@pytest.mark.parametrize("length", [*range(8, 66, 3)])
def test_pieces_of_any_length_are_found_at_a_tenth_of_edits(length):
    draw = random.Random(length)
    item = "".join(draw.choice("abcdefghijklmnopqrstuvw") for _ in range(length))
    k = length // 10
    for _ in range(12):
        noisy = list(item)
        for at in draw.sample(range(length), k):
            noisy[at] = draw.choice(["", "#", "#" + item[at]])
        text = "%" * 30 + "".join(noisy) + "%" * 30
        assert found([(5, item)], text)[0] == {(0, 5)}


def test_repeating_texts_are_searched_at_the_ends_of_their_runs():
    import time

    from agentmeter.llm import decontaminate

    items = [(i, f"def f{i}(x):\n    return x + 1\n" * 3) for i in range(1000)]
    line = "    return x + 1\n"
    began = time.time()
    long, _ = found(items, line * 60_000)
    assert time.time() - began < 30
    assert long == found(items, line * 60)[0]
    templated = "".join(f"def f{7}(x):\n    return x + 1\n" for _ in range(3000))
    began = time.time()
    got, rows = found(items, "begin " + templated + "end")
    assert time.time() - began < 30 and (0, 7) in got
    mine = [r for r in rows if r[1] == 7]
    assert min(r[4] for r in mine) <= 12 and max(r[5] for r in mine) >= len(templated) - 60
    draw = random.Random(2)
    for _ in range(20):  # with and without the cut
        base = "".join(draw.choice("abcdef ") for _ in range(draw.randrange(20, 60)))
        some = [(i, "".join(draw.choice("abcdef ") for _ in range(40))) for i in range(3)] + [(9, (base * 3)[7:77])]
        text = "start of it " + base * draw.randrange(20, 60) + some[1][1] + base * 40
        index = decontaminate.Index(some)
        plain = [r for part in decontaminate.hits(index, [(1, text)]) for r in part]
        decontaminate.CROWDED, before = -1, decontaminate.CROWDED
        cut = [r for part in decontaminate.hits(index, [(1, text)]) for r in part]
        decontaminate.CROWDED = before
        ends = lambda rows: {i: (min(r[3] for r in rows if r[1] == i), min(r[4] for r in rows if r[1] == i), max(r[5] for r in rows if r[1] == i)) for i in {r[1] for r in rows}}
        assert ends(cut).keys() == ends(plain).keys() and {1, 9} <= ends(cut).keys()
        for i, (edits, a, b) in ends(plain).items():
            assert ends(cut)[i][0] == edits and abs(ends(cut)[i][1] - a) <= 6 and abs(ends(cut)[i][2] - b) <= 6


def test_runs_do_not_go_over_the_ends_of_texts():
    copies = ["a text that many documents hold, word for word, each of them once; "] * 400
    got, _ = found([(1, "that many documents hold, word for word")], *copies)
    assert got == {(i, 1) for i in range(400)}
