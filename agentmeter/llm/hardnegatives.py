"""Hard-negative mining by Kronecker-packed products.

Vectors become integers, floor(scale * x). Each component of several candidates is made positive by a bias and put into its own
field of one integer, wide enough for any score of the tile, so that one multiplication by an anchor's component works for
all of them; the sum over the components holds one score in each field, and taking the fields apart and the biases off gives the
exact scores. While two fields or more fit into 53 bits the packed integers are held in doubles, which never round below
2 ** 53, and the multiplications are one matrix product; wider fields go into whole numbers of PACK fields each.

There are two passes. The first finds each anchor's positives, and multiplies anchors only with candidates of their label. The second
goes over all candidates with the score ranges that the positives allow, and keeps the best of each range from tile to tile.

Scale: anchors are dealt to blocks and candidates to shards, of UNIT components each at most, so a hot label or vector is spread; a
pair of a block and a shard is a task's unit. Lists of k rows come out of it and are merged as a tree. Nothing passes through the
driver. The work is anchors times candidates by definition.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.llm.common import written
from agentmeter.llm.topk import whole

EVERY, SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 100, 256, 5, 10, 30, 90
#: Components of a block or shard at most, and candidates of a shard that are worth a task of their own.
UNIT, SMALL = 1 << 23, 1024
ROW_TILE, TILE, PACK = 512, 2048, 1024
FAN_IN = 16
_EXACT = 53
_LEAST, _MOST = -(2**63), 2**63 - 1
#: Bits below a score that say where the candidate stands.
_PLACE = 24
_NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and x, the vector as doubles; rows with a null id or label, or null, empty or non-finite vectors, are left out."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    out = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False)))
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("x"))


class Packed:
    """Candidates' whole components, ready to be multiplied with anchors'."""

    def __init__(self, rows: np.ndarray, scale: int):
        self.rows, self.scale = rows, scale
        with np.errstate(over="ignore"):
            self.values = np.floor(rows * scale)
        self.fits = bool(np.isfinite(self.values).all() and np.abs(self.values).max(initial=0) < 2.0**_EXACT)
        self.held: dict[int, np.ndarray] = {}
        if self.fits:
            self.bias = float(self.values.min(initial=0))
            self.biased = self.values - self.bias
            self.top, self.sums = float(self.biased.max(initial=0)), self.biased.sum(axis=1)

    def width(self, anchors: Packed) -> int:
        """Bits that any score takes with both biases on; 0 if doubles aren't exact for all that is worked out."""
        if not (self.fits and anchors.fits):
            return 0
        most = float(anchors.sums.max(initial=0))
        if (most - anchors.bias * self.values.shape[1]) * (self.top - self.bias) >= 2.0**_EXACT:
            return 0
        return max(1, int(most * self.top).bit_length())

    def scores(self, anchors: Packed) -> np.ndarray | None:
        """Exact scores of anchors (rows) with these candidates (columns), or None where fields of doubles can't hold two of them."""
        width = self.width(anchors)
        fields = _EXACT // width if width else 0
        if fields < 2:
            return None
        if width not in self.held:
            padded = np.zeros((-(-len(self.biased) // fields), fields, self.biased.shape[1]))
            padded.reshape(-1, self.biased.shape[1])[: len(self.biased)] = self.biased
            self.held = {width: np.tensordot(2.0 ** (width * np.arange(fields)), padded, (0, 1))}
        product = (anchors.biased @ self.held[width].T).astype(np.int64)
        out = np.stack([product >> width * f & (1 << width) - 1 for f in range(fields)], axis=2).reshape(len(product), -1)[:, : len(self.biased)]
        off = self.bias * anchors.sums[:, None] + anchors.bias * self.sums[None, :] + self.bias * anchors.bias * self.biased.shape[1]
        return out + off.astype(np.int64)

    def wide(self, anchors: np.ndarray) -> list[list[int]]:
        """The same scores as whole numbers of any size: PACK candidates a number."""
        theirs = [[whole(x, self.scale) for x in row] for row in self.rows]
        ours = [[whole(x, self.scale) for x in row] for row in anchors]
        low, shift = min(map(min, theirs)), min(map(min, ours))
        ours = [[x - shift for x in row] for row in ours]
        highest = max(map(max, theirs)) - low
        top = highest * max(1, *map(sum, ours))
        size = top.bit_length() // 8 + 1  # bytes of a field
        out: list[list[int]] = [[] for _ in ours]
        for i in range(0, len(theirs), PACK):
            some = theirs[i : i + PACK]
            packed = [int.from_bytes(b"".join((x - low).to_bytes(size, "little") for x in column), "little") for column in zip(*some, strict=True)]
            sums = [sum(row) for row in some]
            for mine, scores in zip(ours, out, strict=True):
                product = sum(a * b for a, b in zip(mine, packed, strict=True)).to_bytes(size * len(some), "little")
                total = sum(mine) + shift * len(mine)  # field + low * (sum of mine, bias off) + shift * (sum of theirs, bias on)
                for j, s in enumerate(sums):
                    field = int.from_bytes(product[j * size : (j + 1) * size], "little")
                    scores.append(field + low * total + shift * (s - low * len(mine)))
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _ranges(anchors: pa.Table, own: bool, low: int, high: int) -> list[list[tuple[int, int, int]]]:
    """For each anchor (place, least score, most score): any score for positives, else what each positive allows."""
    if own:
        return [[(0, _LEAST, _MOST)]] * anchors.num_rows
    out = []
    for scores in anchors["scores"].to_pylist():
        ends = [(i, -(-low * p // 100), high * p // 100) for i, p in enumerate(scores)]
        out.append([e for e in ends if e[1] <= e[2]])
    return out


def _keep(best: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """The k largest of best and keys in each row, in no order."""
    both = np.hstack([best, keys])
    return np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if both.shape[1] > k else both


def _search(own: bool, k: int, scale: int, low: int, high: int):
    """The best k candidates of each anchor and score range; own: of the anchor's label (positives), else of others."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if anchors.num_rows and candidates.num_rows:
            candidates = candidates.sort_by("vec_id")  # of equal scores, the one that stands first is better
            given, ids, labels = _matrix(candidates["x"]), candidates["vec_id"].to_numpy(), candidates["label"].to_numpy()
            asked, names, kinds, numbers = _matrix(anchors["x"]), anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), anchors["anchor"].to_numpy()
            ranges = _ranges(anchors, own, low, high)
            tiles = [(j, Packed(given[j : j + TILE], scale)) for j in range(0, len(given), TILE)]
            for i in range(0, len(asked), ROW_TILE):
                rows = slice(i, min(i + ROW_TILE, len(asked)))
                for place, at, score, row in _tile_rows(asked[rows], names[rows], kinds[rows], ranges[rows], tiles, ids, labels, own, k, scale):
                    for column, values in zip(columns, (numbers[rows][row], place, ids[at], score), strict=True):
                        column.append(values)
        found = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
        branch = int(candidates["shard"][0].as_py()) // FAN_IN if candidates.num_rows else 0
        arrays = [pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2]), pa.array(found[3]), pa.array(np.full(len(found[0]), branch, np.int32))]
        return pa.Table.from_arrays(arrays, names=["anchor", "place", "vec_id", "score", "branch"])

    return run


def _tile_rows(asked, names, kinds, ranges, tiles, ids, labels, own, k, scale):
    """(places, positions, scores, rows) of the best candidates of some anchors."""
    mine = Packed(asked, scale)
    slots = max(map(len, ranges))
    place, least, most = np.zeros((3, len(asked), slots), np.int64)
    most -= 1  # unused slots ask for nothing
    for row, ends in enumerate(ranges):
        for slot, (p, a, b) in enumerate(ends):
            place[row, slot], least[row, slot], most[row, slot] = p, max(a, _LEAST), min(b, _MOST)
    wide: list[list[list[tuple[int, int]]]] | None = None
    best = [np.full((len(asked), 0), _NONE, np.int64) for _ in range(slots)]
    for first, tile in tiles:
        here = slice(first, first + len(tile.rows))
        right = (kinds[:, None] == labels[None, here]) == own
        right &= names[:, None] != ids[None, here]
        scores = tile.scores(mine)
        if scores is None or np.abs(scores).max(initial=0) >= 1 << 62 - _PLACE or len(ids) >= 1 << _PLACE:
            wide = wide or [[[] for _ in range(slots)] for _ in asked]
            _wide(wide, tile.wide(asked) if scores is None else scores.tolist(), right, first, least, most, k)
            continue
        keys = (scores << _PLACE) + ((1 << _PLACE) - 1 - np.arange(first, here.stop))
        for slot in range(slots):
            fits = right if own else right & (scores >= least[:, slot, None]) & (scores <= most[:, slot, None])
            best[slot] = _keep(best[slot], np.where(fits, keys, _NONE), k)
    for slot in range(slots):
        row, column = np.nonzero(best[slot] != _NONE)
        key = best[slot][row, column]
        at, score = (1 << _PLACE) - 1 - (key & (1 << _PLACE) - 1), key >> _PLACE
        if wide:
            found = [[(int(s), int(p)) for r, s, p in zip(row, score, at, strict=True) if r == n] for n in range(len(asked))]
            merged = [heapq.nsmallest(k, found[n] + wide[n][slot], key=_first) for n in range(len(asked))]
            row = np.repeat(np.arange(len(asked)), [len(m) for m in merged])
            score, at = (np.array([e[c] for m in merged for e in m], np.int64) for c in (0, 1))
        yield place[row, slot], at, score, row


def _first(entry: tuple[int, int]) -> tuple[int, int]:
    return -entry[0], entry[1]


def _wide(lists, scores, right, first, least, most, k) -> None:
    """Merges a tile's scores, as Python's whole numbers, into each anchor's lists; what is beyond a long counts as the nearest long."""
    for row, line in enumerate(scores):
        near = [(max(_LEAST, min(_MOST, s)), first + j) for j, s in enumerate(line) if right[row, j]]
        for slot, held in enumerate(lists[row]):
            a, b = int(least[row, slot]), int(most[row, slot])
            held[:] = heapq.nsmallest(k, held + [e for e in near if a <= e[0] <= b], key=_first)


def _dealt(anchors: DataFrame, candidates: DataFrame, keys: list[str]):
    """anchors and candidates as grouped units: each anchor in one block and all shards of its keys, each candidate in one shard and all blocks."""
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    parts = lambda n: F.ceil(F.col(n) * F.col("dim") / UNIT)
    shards = F.greatest(parts("n"), F.least(F.lit(tasks).cast("long"), F.ceil(F.col("n") / SMALL))).cast("int").alias("shards")
    plan = sizes.join(asked, keys).select(*keys, shards, parts("m").cast("int").alias("blocks"))
    dealt = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(plan, keys).withColumn("block", dealt("anchor", "blocks")).withColumn("shard", each("shards"))
    right = candidates.withColumn("row", F.monotonically_increasing_id()).join(plan, keys).withColumn("shard", dealt("row", "shards")).withColumn("block", each("blocks"))
    right = right.select(*[F.col(c).alias(c) for c in ("vec_id", "label", "x", "dim", "block", "shard")])  # both sides come from the same rows
    unit = [*keys, "block", "shard"]
    return left.drop("shards", "blocks").groupBy(*unit).cogroup(right.groupBy(*unit))


_SCHEMA = "anchor long, place int, vec_id long, score long, branch int"


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor and place, first within branches, then over them."""
    for keys in (["anchor", "place", "branch"], ["anchor", "place"]):
        lists = lists.withColumn("rank", F.row_number().over(_order(keys))).where(F.col("rank") <= k)
    return lists


def _order(keys: list[str]) -> Column:
    return Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")


def mine(vectors: DataFrame, every: int = EVERY, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Negatives whose scores are between low and high percent of a positive's, for each anchor and positive.

    vectors: vec_id, label, embedding (array of float or double); other columns are ignored. Anchors are the rows whose vec_id is divisible by
    every. A score is the integer inner product with the anchor, higher ones come first, ties by smaller vec_id. An anchor's positives are
    its first rows of the same label, rows with the anchor's own vec_id left out. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score and negative_score, the first negatives rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    Rows that usable() leaves out take no part; an anchor meets vectors of its own length only. Repeated rows are separate
    candidates (as positives they have a list each), but one anchor; rows of one id with different vectors or labels are anchors of their own. A
    score beyond a long is the nearest long. Anchors without a positive, positives without a negative and an empty table give no rows.
    """
    rows = usable(vectors).withColumn("dim", F.size("x"))
    anchors = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("anchor", F.xxhash64("vec_id", "label", "x"))
    near = _dealt(anchors, rows, ["dim", "label"]).applyInArrow(_search(True, positives, scale, low, high), _SCHEMA)
    chosen = _merged(near, positives).select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = written(chosen.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor"), "positives")
    lists = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("chosen"))
    asked = anchors.join(lists.select("anchor", F.col("chosen.positive_score").alias("scores")), "anchor")
    far = _dealt(asked, rows, ["dim"]).applyInArrow(_search(False, negatives, scale, low, high), _SCHEMA)
    out = _merged(far, negatives).join(chosen, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH whole AS (
  SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.embedding AS anchor, a.label AS anchor_label, c.vec_id, c.label,
         CAST(greatest(-9223372036854775808::HUGEINT, least(9223372036854775807::HUGEINT,
           CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS HUGEINT))) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, label, embedding, v FROM whole WHERE vec_id % 100 = 0) a JOIN whole c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
near AS (
  SELECT anchor_id, anchor, anchor_label, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id, anchor, anchor_label ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE label = anchor_label QUALIFY place <= 5),
far AS (
  SELECT n.anchor_id, n.positive_id, s.vec_id AS negative_id, n.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY n.anchor_id, n.anchor, n.anchor_label, n.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM near n JOIN scored s ON s.anchor_id = n.anchor_id AND s.anchor = n.anchor AND s.anchor_label = n.anchor_label AND s.label <> n.anchor_label
   AND 30::HUGEINT * n.positive_score <= 100::HUGEINT * s.score AND 100::HUGEINT * s.score <= 90::HUGEINT * n.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM far WHERE rank <= 10
"""
