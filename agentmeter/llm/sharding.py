"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A topology is a list of regions of racks of shard weights. A document descends it: at each level every child of the
chosen node draws -ln(u) / weight, u being a hash of the id and the child's place, and the smallest draw wins. A draw
depends on nothing but the id, the child and the child's weight, so a change of weights moves documents only into or
out of the subtrees whose weights change. A new shard opens a region of its own (grow), so that it takes documents only
into itself and none move between the shards that were there; a shard put into an existing rack would also move
documents within that region.

Scale: the draws need the id alone, no shuffle. Slots need two shuffles of narrow rows: rows alike are counted before they are
ordered, and a shard is spread over slices by the hash of id, checksum and size, so a hot id doesn't meet in one window. The only broadcast is the
table of slice offsets, at most shards times slices rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.llm.common import fresh, written

Topology = list[list[list[float]]]
#: Hex digits of the id's hash that form a slice of a shard: 16 ** 2 slices.
SLICE_DIGITS = 2
#: Weights of shards are positive; the offsets of this many shards, times the slices, are broadcast at most.
MAX_SHARDS = 4096


def topology(shards: int = 40, rack: int = 4, racks: int = 2) -> Topology:
    """Equal shards, rack of them a rack and racks of those a region; the last ones hold what is left."""
    weights = [1.0] * shards
    cells = [weights[i : i + rack] for i in range(0, shards, rack)]
    return [cells[i : i + racks] for i in range(0, len(cells), racks)]


def grow(tree: Topology, weight: float = 1.0) -> Topology:
    """tree with one more shard, in a region of its own. A tree that has grown is the one to grow again: topology() of as many shards differs."""
    return [*tree, [[weight]]]


def _draw(name: Column, place: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", name, place)), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(uniform) / weight


def _choose(name: Column, weights: Column, prefix: Column) -> Column:
    """The child with the smallest draw; ties go to the first."""
    draws = F.transform(weights, lambda w, i: F.struct(_draw(name, F.concat(prefix, i.cast("string")), w).alias("draw"), i.alias("child")))
    return F.array_min(draws)["child"]


def _literal(value) -> Column:
    """Nested lists of numbers as one constant; its size is that of the topology."""
    return F.array(*map(_literal, value)) if isinstance(value, list) else F.lit(value)


def place(docs: DataFrame, tree: Topology, column: str = "shard") -> DataFrame:
    """docs with the shard's number in column (written over if it is there), counted through the tree in order. Null ids share one place."""
    if not tree or min(w for r in tree for k in r for w in k) <= 0:
        raise ValueError("a topology needs shards, of positive weights")
    sizes = [len(k) for r in tree for k in r]
    if sum(sizes) > MAX_SHARDS:
        raise ValueError(f"{sum(sizes)} shards; MAX_SHARDS is {MAX_SHARDS}")
    racks = [[float(sum(k)) for k in r] for r in tree]
    shards = [[list(map(float, k)) for k in r] for r in tree]
    starts = iter(sum(sizes[:i]) for i in range(len(sizes)))
    first = [[next(starts) for _ in r] for r in tree]
    at = lambda table, i: F.get(table, F.col(i))
    name, region, rack = fresh(docs, "shard_name", "shard_region", "shard_rack")
    out = docs.withColumn(name, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    out = out.withColumn(region, _choose(F.col(name), _literal([sum(r) for r in racks]), F.lit("r")))
    out = out.withColumn(rack, _choose(F.col(name), at(_literal(racks), region), F.concat(F.lit("r"), F.col(region), F.lit("k"))))
    shards_there, first_there = F.get(at(_literal(shards), region), F.col(rack)), F.get(at(_literal(first), region), F.col(rack))
    leaf = _choose(F.col(name), shards_there, F.concat(F.lit("r"), F.col(region), F.lit("k"), F.col(rack), F.lit("s")))
    return out.withColumn(column, (leaf + first_there).cast("int")).drop(rack, region, name)


def shard(docs: DataFrame, tree: Topology | None = None) -> DataFrame:
    """Every document's shard, slot and the shard after growth by one.

    docs: doc_id, text; other columns are ignored. Returns doc_id, size (UTF-8 bytes plus 16; null text: 16), text_crc32
    (null text: that of the empty text), law ('key'), shard, slot (gapless from 0 in each shard) and grown_shard. The id
    and the tree alone decide the shard: repeated ids share it, null ids are one id. Slots follow the hash of id,
    checksum and size; rows alike in all of these may swap slots. An empty table gives no rows.
    """
    tree = tree or topology()
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = place(place(rows, tree), grow(tree), "grown_shard")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size"))
    rows = written(placed.withColumn("key", key).withColumn("slice", F.substring("key", 1, SLICE_DIGITS)), "shards")  # narrow rows, so that texts are read and draws made once
    alike = rows.groupBy("shard", "slice", "key", "doc_id", "size", "text_crc32", "grown_shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "slice").count().withColumn("offset", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    inside = Window.partitionBy("shard", "slice").orderBy("key", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return numbered.join(F.broadcast(offsets), ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("inner") + F.col("i")).cast("long").alias("slot"), "grown_shard"
    )


#: The same in SQL. The checksum goes through the text's bytes by half-bytes, the lower one first.
ORACLE = """
WITH entries AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(4), lambda a, s: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT)) AS c FROM range(16) r(i))),
halves AS (
  SELECT doc_id, text, list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS h FROM documents),
summed AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
         CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(list_transform(range(1, len(h) + 1), lambda i: CAST(h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END] AS BIGINT)),
           lambda a, x: xor(a >> 4, t[(xor(a, x) & 15) + 1]), CAST(4294967295 AS BIGINT))) END AS text_crc32
  FROM halves CROSS JOIN entries),
ids AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id FROM documents),
regions AS (
  SELECT doc_id, id, arg_min(r, draw) FILTER (r < 5) AS region, arg_min(r, draw) AS grown_region FROM (
    SELECT doc_id, id, r, -ln((CAST('0x' || substr(md5(id || ':r' || r), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / CASE WHEN r = 5 THEN 1 ELSE 8 END AS draw
    FROM ids CROSS JOIN range(6) t(r)) GROUP BY doc_id, id),
racks AS (
  SELECT doc_id, id, region, grown_region, arg_min(k, draw) AS rack FROM (
    SELECT *, -ln((CAST('0x' || substr(md5(id || ':r' || region || 'k' || k), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / 4 AS draw FROM regions CROSS JOIN range(2) t(k)) GROUP BY ALL),
shards AS (
  SELECT doc_id, id, grown_region, CAST(region * 8 + rack * 4 + arg_min(s, draw) AS INTEGER) AS shard FROM (
    SELECT *, -ln((CAST('0x' || substr(md5(id || ':r' || region || 'k' || rack || 's' || s), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS draw FROM racks CROSS JOIN range(4) t(s)) GROUP BY doc_id, id, grown_region, region, rack)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(id || ':' || text_crc32 || ':' || size), d.doc_id) - 1 AS slot,
       CASE WHEN grown_region = 5 THEN 40 ELSE shard END AS grown_shard
FROM summed d JOIN shards s ON s.doc_id IS NOT DISTINCT FROM d.doc_id
"""
