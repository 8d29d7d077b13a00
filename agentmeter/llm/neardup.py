"""Near copies by the Jaccard similarity of word shingles.

Texts get min-hash signatures in bands of five values. Texts that share a band are candidates, and candidates that reach each
other form a group. Inside a group every pair counts: parities of the shingles' hashes in 1,024 bits differ in no more places than
the two sets do, which rules out almost all pairs below the bound, and the rest are intersected exactly. Only links that
join two classes are returned.

Two texts of similarity s share no band with probability (1 - s**5)**25: 5 in 100,000 at 0.8, less above. Nothing else is approximate.

Scale: equal texts fold into one before anything is entered, and a bucket of m texts costs m links, not pairs. Groups of more than one
block are first cut by their rarest shingles (see refined), exactly: texts around one template fall apart there. What is still large is
cut into blocks and each pair of blocks is a unit of work; near copies of each other are linked after a few comparisons each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from agentmeter.llm.common import fresh, written
from agentmeter.llm.components import components

WIDTH, SIMILARITY = 5, 0.8
BANDS, BAND = 25, 5
#: Texts and shingles of a block of a group, about.
BLOCK, BLOCK_SHINGLES = 4096, 4_000_000
_SEED, _MAP, _RUN, _STEP, _ROWS = 42, 1024, 1024, 64, 512
_RANDOM = np.random.default_rng(_SEED)
_MIX, _MUL = (_RANDOM.integers(0, 2**64, BANDS * BAND, np.uint64) for _ in range(2))
_MUL |= np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted different hashes of the word shingles of a whole text; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, _SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    return np.unique(np.array([xxh64_intdigest(joined[a:b], _SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed long a band; equal sets have equal ones."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), _RUN):
        np.minimum(least, ((hashes[None, i : i + _RUN] ^ _MIX[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    found = [xxh64_intdigest(least[i * BAND : (i + 1) * BAND].tobytes(), i) for i in range(BANDS)]
    return [x - 2**64 if x >= 2**63 else x for x in found]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches in runs of rows, so that shingles of few texts are held at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            yield batch.slice(i, _ROWS)


def _signed(width: int, mark: Callable[[str | None], int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [x.as_py() for x in batch.column("text")]
            sets = [shingles(x, width) for x in texts]
            new = [pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array([mark(x) if mark else None for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("same"), batch.column("doc_id"), *new], ["row", "same", "doc_id", "n", "bands", "print"])

    return run


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of how many hashes fall on each place: two sets' parities differ in no more places than the sets have elements apart."""
    return np.packbits(np.bincount(hashes & np.uint64(_MAP - 1), minlength=_MAP).astype(np.uint8) & 1).view(np.uint64)


def linked(nodes: list[int], blocks: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join exactly the texts that pairs of the similarity join. With texts of two blocks only pairs across count."""
    order = np.argsort(np.array(blocks), kind="stable")
    own, sets = np.array(nodes)[order], [sets[i] for i in order]
    first = int((np.array(blocks) == min(blocks)).sum())
    across = first < len(own)
    n = np.array([len(s) for s in sets])
    maps = np.stack([parities(s) for s in sets])
    part, out = np.arange(len(own)), []
    for i in range(first):
        rest, step = np.arange(first if across else i + 1, len(own)), _STEP
        rest = rest[part[rest] != part[i]]
        while len(rest):  # a few first: near copies are soon in one class, and then nothing of it is left to compare
            some, rest, step = rest[:step], rest[step:], step * 4
            apart = np.bitwise_count(maps[some] ^ maps[i]).sum(axis=1, dtype=np.int64)
            both = n[some] + n[i]  # similarity s: at most (1 - s) / (1 + s) of both apart
            for j in some[apart * (1 + similarity) <= both * (1 - similarity) + 1e-6].tolist():
                if part[j] == part[i]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= similarity * (n[i] + n[j] - common) - 1e-9:
                    part[part == part[j]] = part[i]
                    out.append((int(own[i]), int(own[j])))
            rest = rest[part[rest] != part[i]]
    return out


def _links(width: int, similarity: float):
    def result(rows: list[tuple]) -> pa.RecordBatch:
        nodes, blocks, sets = zip(*rows, strict=True)
        found = linked(list(nodes), list(blocks), list(sets), similarity)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in _slices(batches):
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high")), strict=True)
            for key, node, block, text in zip(keys, batch.column("node").to_pylist(), batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != unit:
                    if len(rows) > 1:
                        yield result(rows)
                    unit, rows = key, []
                rows.append((node, block, shingles(text, width)))
        if len(rows) > 1:
            yield result(rows)

    return run


def _same() -> F.Column:
    """A digest of the text; one for all texts without words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.md5(text.cast("binary"))).otherwise("")


def _row() -> F.Column:
    """A digest of id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), _same()).cast("binary"))


def _hashes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(x.as_py(), width).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "n")), pa.array(sets, pa.list_(pa.int64()))], ["node", "root", "n", "hashes"])

    return run


def refined(texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Groups (node, root) of texts (node, root, n, text; n: its shingles) that are no larger than they must be.

    Two sets of the similarity share one of the n - ceil(similarity * n) + 1 rarest shingles of either, whatever the order of equally
    rare ones. Rarity is counted within the old group. Texts that have much in common but a part of their own each share none
    of them and are in no group; what shares one costs a link, not a pair.
    """
    held = texts.mapInArrow(_hashes(width), "node long, root long, n long, hashes array<long>").select("node", "root", "n", F.explode("hashes").alias("hash"))
    held = written(held.distinct(), "neardup-hashes")
    often = held.groupBy("root", "hash").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("node").orderBy("often", "hash")
    kept = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    rare = held.join(often, ["root", "hash"]).withColumn("k", F.row_number().over(rarest)).where((F.col("k") <= kept) & (F.col("often") > 1))
    rare = written(rare.select("node", "root", "hash"), "neardup-rare")
    stars = rare.join(rare.groupBy("root", "hash").agg(F.min("node").alias("b")), ["root", "hash"])
    return written(components(stars.select(F.col("node").alias("a"), "b").where("a <> b").distinct()), "neardup-refined")


def first_rows(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, mark: Callable[[str | None], int] | None = None, classes: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """row, the digest of id and text of the row with the smallest id of each class; rows with a null id come last.

    mark and classes bring further candidates: mark gives a text a print, and classes puts distinct prints (print) into classes (print, class: one of
    its prints), those that it leaves out being alone; texts of one print are in one class.
    """
    signed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _same().alias("same"), _row().alias("row")).mapInArrow(_signed(width, mark), "row string, same string, doc_id long, n long, bands array<long>, print long"), "neardup-bands")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    texts = signed.groupBy("same").agg(F.min(order).alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("print").alias("print"))
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), "neardup-texts")

    entered = texts.select("node", F.explode("bands").alias("value"))
    met = written(entered.groupBy("value").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1").select("value", "b"), "neardup-met")
    candidates = entered.join(met, "value").select(F.col("node").alias("a"), "b")
    if classes:
        owned = texts.where("n > 0").select("node", "print")
        named = owned.join(classes(owned.select("print").distinct()), "print", "left").select("node", F.coalesce("class", "print").alias("class"))
        named = written(named, "neardup-classes")
        candidates = candidates.unionByName(named.join(named.groupBy("class").agg(F.min("node").alias("b")), "class").select(F.col("node").alias("a"), "b"))
    groups = written(components(candidates.where("a <> b").distinct()), "neardup-groups")

    whole = docs.select(_row().alias("row"), F.col("text").cast("string").alias("text"))
    members = texts.select("node", F.col("first.row").alias("row"), "n").join(groups, "node")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts")
    large = written(members.groupBy("root").agg(parts).where("parts > 1").select("root"), "neardup-large")
    if not large.isEmpty():
        again = refined(whole.join(members.join(large, "root", "left_semi"), "row"), width, similarity)
        members = members.join(large, "root", "left_anti").unionByName(members.drop("root").join(again, "node"))
    sizes = members.groupBy("root").agg(parts)
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), "parts"))
    near = whole.join(dealt, "row")
    units = near.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    units = units.select("node", "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = units.repartition(tasks, "root", "low", "high").sortWithinPartitions("root", "low", "high")
    links = placed.mapInArrow(_links(width, similarity), "a long, b long")

    roots = components(links)
    named = texts.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("class"))
    return written(named.agg(F.min("first").alias("first")).select("first.row"), "neardup-first")


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, mark: Callable[[str | None], int] | None = None, classes: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with one row of each class of near copies, the one of the smallest id, in the columns of docs.

    docs: doc_id, text; other columns are kept. Words are runs without ASCII white space, A-Z lower-cased; shingles are width words,
    each counted once (fewer words: the whole sequence). Texts link if the shared part of their shingles is similarity or more;
    classes are what links reach. Texts without words, null ones too, are one class. Ids don't decide: different texts under one id,
    or without an id, are rows of their own, and a class without any id keeps one row. An empty table gives no rows. mark, classes: see first_rows.
    """
    (name,) = fresh(docs, "row")
    keep = first_rows(docs, width, similarity, mark, classes).withColumnRenamed("row", name)
    return docs.withColumn(name, _row()).join(keep, name, "left_semi").dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns])
