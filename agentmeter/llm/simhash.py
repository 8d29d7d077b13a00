"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint's 64 bits are cut into 21 segments, and the bit counts of the segments are a point on an integer grid.
Flipping a bit moves one count by one, so the Manhattan distance of two points is a lower bound of the fingerprints'
Hamming distance. Points within distance 2 share a grid cell that is at most 1 away from both: each point is
entered in its own cell and its 42 neighbours, and a range join on the cell finds every pair within 2.

The fingerprints of a cell are verified exactly, by the bits in which two of them differ. A cell of up to DENSE fingerprints is compared in the task that
has it, and only links that join two classes of the cell leave the task. A denser one (a cloud of near copies, thousands of
different fingerprints a few bits apart) is not paired up: two of its fingerprints differ in at most 2 bits exactly if some value
is within 1 bit of both, so each is entered at its 65 such values, and the 65 fingerprints that a value has at most are linked as a star.

Scale: texts are read once and not shuffled. Exact copies fold into one fingerprint by partial aggregation before
anything else, so a group of copies costs one row a task. The grid is one shuffle of 43 narrow rows for each different fingerprint; a task
streams through its cells and holds at most DENSE fingerprints of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from agentmeter.llm import neardup
from agentmeter.llm.common import written
from agentmeter.llm.components import components

#: Segments of 3 bits, the last of 4. Coarser ones need fewer cells, but more fingerprints meet there by chance.
SEGMENTS, SEGMENT_BITS, SEED = 21, 3, 42
#: The popcounts of a fingerprint lie in 0..4 and those of its neighbours in -1..5; with one added a digit needs 3 bits, so 21 of them fit in a long.
_DIGIT = 3
#: Fingerprints in a partition that is about to be entered in cells.
SPREAD = 100_000
#: Fingerprints of a cell that are compared with each other; and those of short cells, which are compared many cells at once.
DENSE, SHORT = 4096, 16
#: Hashes counted at once.
_RUN = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of a whole text, as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-width] + 1])
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _RUN):
        part = np.array(hashes[i : i + _RUN], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print, the fingerprint as a signed long; null, empty and white texts have 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, print long")


def _cells() -> F.Column:
    """The point's cell and those one step away, each as one long."""
    masks = [2**SEGMENT_BITS - 1] * (SEGMENTS - 1) + [2 ** (64 - SEGMENT_BITS * (SEGMENTS - 1)) - 1]
    digits = [F.bit_count(F.shiftrightunsigned("print", SEGMENT_BITS * i).bitwiseAND(m)).cast("long") + 1 for i, m in enumerate(masks)]
    own = sum((F.shiftleft(d, _DIGIT * i) for i, d in enumerate(digits[1:], 1)), digits[0])
    steps = [F.lit(s << (_DIGIT * i)) for i in range(SEGMENTS) for s in (1, -1)]
    return F.transform(F.array(F.lit(0).cast("long"), *[s.cast("long") for s in steps]), lambda s: own + s)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits signed longs differ; numpy would count those of a negative number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def verified(prints: np.ndarray, distance: int = 2) -> list[tuple[int, int]]:
    """Links that join exactly what pairs of prints within distance join."""
    part, out = np.arange(len(prints)), []
    for i in range(len(prints) - 1):
        near = (_apart(prints[i + 1 :], prints[i]) <= distance) & (part[i + 1 :] != part[i])
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((int(prints[i]), int(prints[j])))
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the cells, from rows (cell, print) in the order of cells; of dense cells the fingerprints (a, cell)."""

    def result(a, b, cell) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, cell)], ["a", "b", "cell"])

    rest_cell, rest, dense = None, [np.zeros(0, np.int64)], False
    for batch in batches:
        cell, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "print"))
        if not len(cell):
            continue
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        ends = np.append(starts[1:], len(cell))
        if cell[0] == rest_cell:  # a cell that goes on
            rest.append(own[: ends[0]])
            starts, ends = starts[1:], ends[1:]
        if len(starts) and rest_cell is not None:
            yield from _cell(rest_cell, np.concatenate(rest), dense, result)
            rest_cell = None
        if len(starts):
            short = ends[:-1] - starts[:-1]
            inside = np.repeat(short <= SHORT, short)
            few, mine = cell[starts[0] : ends[-2]][inside] if len(short) else cell[:0], own[starts[0] : ends[-2]][inside] if len(short) else own[:0]
            for lag in range(1, SHORT):
                same = np.flatnonzero(few[lag:] == few[:-lag])
                if not len(same):
                    break
                near = same[_apart(mine[same], mine[same + lag]) <= 2]
                if len(near):
                    yield result(mine[near], mine[near + lag], np.zeros(len(near), np.int64))
            for i in np.flatnonzero(short > SHORT).tolist():
                yield from _cell(int(cell[starts[i]]), own[starts[i] : ends[i]], False, result)
            rest_cell, rest, dense = int(cell[starts[-1]]), [own[starts[-1] :]], False
        if sum(map(len, rest)) > DENSE:
            held = np.concatenate(rest)
            yield result(held, [None] * len(held), np.full(len(held), rest_cell))
            rest, dense = [held[:0]], True
    if rest_cell is not None:
        yield from _cell(rest_cell, np.concatenate(rest), dense, result)


def _cell(cell: int, own: np.ndarray, dense: bool, result) -> Iterator[pa.RecordBatch]:
    if dense or len(own) > DENSE:
        yield result(own, [None] * len(own), np.full(len(own), cell))
    elif len(own) > 1:
        found = verified(own)
        yield result([a for a, _ in found], [b for _, b in found], [cell] * len(found))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join exactly what is within 2 bits of each other. prints: print, distinct."""
    entered = prints.select("print", F.explode(_cells()).alias("cell"))
    placed = entered.repartition("cell").sortWithinPartitions("cell")
    met = written(placed.mapInArrow(_met, "a long, b long, cell long"), "simhash-met")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = met.where("b IS NULL").select("cell", F.col("a").alias("print"), F.explode(F.transform(flips, lambda f: F.col("a").bitwiseXOR(f))).alias("value"))
    groups = near.groupBy("cell", "value").agg(F.sort_array(F.collect_list("print")).alias("g")).where(F.size("g") > 1)  # 65 at most
    stars = groups.select(F.explode(F.slice("g", 2, 65)).alias("a"), F.get("g", F.lit(0)).alias("b"))
    return met.where("b IS NOT NULL").select("a", "b").unionByName(stars).distinct()


def near_prints(prints: DataFrame) -> DataFrame:
    """(node, root) of each fingerprint that has another within 2 bits. prints: print, distinct; read twice."""
    spread = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() // SPREAD)
    return written(components(links(prints.repartition(spread, "print"))), "simhash-roots")


def near_groups(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and class.

    docs: doc_id, text; other columns are ignored. Words are runs without ASCII white space, A-Z lower-cased; shingles are 3
    words, repeats included (fewer words: the whole sequence; none: fingerprint 0, linked like any other). Fingerprints
    link at 2 or fewer differing bits. Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    that links reach. Rows with a null id have a class as well but never name it: component_id is null if no row
    of the class has an id. Repeated rows stay. An empty table gives no rows.
    """
    rows = written(fingerprints(docs), "simhash-prints")
    least = written(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = near_prints(least.select("print"))
    names = roots.join(least, roots.node == least.print).groupBy("root").agg(F.min("least").alias("name"))
    named = roots.join(names, "root").select(F.col("node").alias("print"), "name")
    named = written(least.join(named, "print", "left").select("print", F.coalesce("name", "least").alias("component_id")), "simhash-names")
    return rows.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = neardup.WIDTH, similarity: float = neardup.SIMILARITY) -> DataFrame:
    """docs with one row of each class of near copies by word shingles, the one of the smallest id, in the columns of docs.

    Candidates are the classes of fingerprints within 2 bits, found by the grid, and what shares a band of min-hashes; an exact check of every pair of a group
    follows in neardup. Fingerprints alone can't do: at a similarity of 0.8 two of them differ in about 10 of 64 bits, and a grid for such
    distances would enter each in millions of cells. Nulls, repeated rows and the like: see neardup.keep_one.
    """
    classes = lambda prints: near_prints(prints).select(F.col("node").alias("print"), F.col("root").alias("class"))
    return neardup.keep_one(docs, width, similarity, fingerprint, classes)
