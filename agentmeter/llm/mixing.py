"""Mixing sources to target weights with DataFrame functions only.

Each document gets a hash-random key (md5 of its id; of its text where it has none). Within a source the documents are ranged by the
leading hex digits of the key, word counts are summed per range, prefix sums over the ranges give each range its offset, and a
window inside a range gives each document its own prefix. The source's budget then cuts that order at an exact word:
documents before the cut are taken whole, the one at the cut in part, and budgets above the source's size start
further epochs over the same order.

Scale: the only shuffles carry (id, source, size, key), not texts. Rows alike in these are counted before they are
ordered, and a source of any size is spread over RANGES windows, so neither a hot source nor a hot id meets in one task.
Only the table of sources (one row per distinct source) is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.llm.common import fresh, written

#: Hex digits of the key that form a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3
WEIGHTS = (5, 2, 1)
#: The table of cuts is broadcast up to this many sources.
MAX_SOURCES = 100_000
#: Bits of monotonically_increasing_id below the number of the partition.
_PART_BITS = 33


def source_targets(sizes: DataFrame, share: float = 1.5, cap: int = 2, weights=WEIGHTS) -> DataFrame:
    """Targets of each source: share times all sizes, split by weight, never above cap times the source's size.

    sizes: (source, source_size). Sources are ordered by code point, null last, and weigh weights in turn. What is above
    a cap goes to the others by weight until none is above, which is where all uncapped sources stand at one level of
    words per weight: sources are passed in the order in which they reach their cap, and the first that stays below
    it fixes the level. An empty table gives no rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("full_at", "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    levels = (
        ranked.withColumn("full_at", F.lit(cap) * F.col("source_size") / F.col("weight"))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
        .withColumn("position", F.row_number().over(by_cap))
    )
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("position", "level"))).over(everything)
    return levels.withColumn("fixed", first).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("position") >= F.col("fixed.position"), F.col("fixed.level") * F.col("weight"))
        .otherwise((F.lit(cap) * F.col("source_size")).cast("double"))
        .alias("target"),
    )


def _source() -> Column:
    return F.col("source").cast("string")


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key() -> Column:
    unnamed = F.md5(F.concat(F.lit("null"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.when(F.col("doc_id").isNull(), unnamed).otherwise(F.md5(F.col("doc_id").cast("string")))


def _placed(rows: DataFrame, share: float, cap: int, weights) -> DataFrame:
    """Different rows (source, key, doc_id, size), how many there are of each (n), and where they stand in their source's order.

    start is the number of words before the first of them; epochs how often the source is taken whole, and rest the words of its last epoch.
    """
    alike = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)).groupBy("source", "range", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    ranges = rows.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), share, cap, weights)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).alias("o").join(
        targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))
    ).select("o.source", "o.range", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).alias("r").join(
        offsets.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.range") == F.col("f.range"))
    )
    words = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    return placed.select(
        "r.source", "key", "doc_id", "size", "n", "source_size", "target", (F.col("offset") + F.col("inner")).alias("start"), epochs.alias("epochs"), (words - epochs * F.col("source_size")).alias("rest")
    )


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights=WEIGHTS) -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, text, source; other columns are ignored. Returns doc_id, size, source_size, target, taken, source and
    copies. size counts the runs without ASCII white space. taken sums to the source's target rounded to a word, and is
    at most cap times size. copies is taken as whole documents: the one at the cut counts if at least half of it is
    inside. Null and empty texts have size 0 and take 0 words; they have a copy in each epoch that reaches their place.
    Null sources form one source, the last. Rows without an id are placed by their text, and repeated rows count as rows; ties are
    ordered by id, then size, so rows alike in both may swap places and nothing else. An empty table gives no rows.
    """
    rows = written(docs.select("doc_id", _source().alias("source"), _size().alias("size"), _key().alias("key")), "mix-sizes")
    each = _placed(rows, share, cap, weights).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start, size = F.col("start") + F.col("i") * F.col("size"), F.col("size")
    taken = F.col("epochs") * size + F.greatest(F.lit(0), F.least(size, F.col("rest") - start))
    copies = F.when(size == 0, F.col("epochs") + (start < F.col("rest")).cast("long")).otherwise(F.floor((taken * 2 + size) / (size * 2)))
    return each.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", copies.cast("long").alias("copies"))


def _cuts(rows: DataFrame, share: float, cap: int, weights) -> DataFrame:
    """A row a source: epochs, and the place (key, doc_id, size, row) up to which its rows have a copy more.

    Of rows alike in key, id and size the first by number (row) come first. Where the cut falls among such rows, they are counted by
    partition, prefix sums find the partition that holds the last one taken, and only its rows are numbered.
    """
    size, rest = F.col("size"), F.col("rest") - F.col("start")
    whole = F.when(size > 0, F.floor((rest * 2 + size) / (F.greatest(size, F.lit(1)) * 2))).otherwise(F.when(rest > 0, F.col("n")).otherwise(0))
    ranked = _placed(rows, share, cap, weights).withColumn("j", F.greatest(F.lit(0), F.least(F.col("n"), whole)).cast("long"))
    at = F.struct("key", F.col("doc_id").isNull().alias("unnamed"), "doc_id", "size", "j", "n")
    cuts = ranked.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("j") > 0, at)).alias("at"))
    cuts = written(cuts.select("source", "epochs", "at.*"), "mix-cuts")
    tied = cuts.where("j < n").select(F.col("source").alias("s"), F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("z"), "j")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    among = rows.join(tied, same).select("s", "j", "row", F.shiftright("row", _PART_BITS).alias("part"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = among.groupBy("s", "j", "part").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    holding = counted.where("before < j AND before + m >= j").select(F.col("s").alias("s2"), F.col("part").alias("part2"), "before")
    own = among.join(holding, F.col("s").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("part2")))
    nth = own.withColumn("nth", F.col("before") + F.row_number().over(Window.partitionBy("s").orderBy("row"))).where("nth = j").select("s", "row")
    return cuts.join(nth, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "epochs", "key", "unnamed", "doc_id", "size", F.coalesce("row", F.lit(2**63 - 1)).alias("row"))


def mixed(docs: DataFrame, share: float = 1.5, cap: int = 2, weights=WEIGHTS) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (mix(): copies), in the columns of docs.

    Rows are told apart by a number, not by their ids, so each source's words come within one document of its target whatever
    ids are null or repeated. Texts are written once with that number and read again, not shuffled.
    """
    row, size, key = fresh(docs, "mix_row", "mix_size", "mix_key")
    kept = written(docs.select("*", F.monotonically_increasing_id().alias(row), _size().alias(size), _key().alias(key)), "mix-rows")
    narrow = kept.select("doc_id", _source().alias("source"), F.col(size).alias("size"), F.col(key).alias("key"), F.col(row).alias("row"))
    cuts = written(_cuts(narrow, share, cap, weights), "mix-cut-rows")
    few = F.broadcast(cuts) if cuts.count() <= MAX_SOURCES else cuts
    d, c = kept.alias("d"), few.alias("c")
    named = lambda *parts: F.struct(*[p.alias(n) for p, n in zip(parts, ("key", "unnamed", "doc_id", "size", "row"), strict=True)])
    place = named(F.col(f"d.{key}"), F.col("d.doc_id").isNull(), F.col("d.doc_id"), F.col(f"d.{size}"), F.col(f"d.{row}"))
    cut = named(*[F.col(f"c.{x}") for x in ("key", "unnamed", "doc_id", "size", "row")])
    more = F.coalesce(F.col("c.key").isNotNull() & (place <= cut), F.lit(False)).cast("int")
    joined = d.join(c, F.col("d.source").cast("string").eqNullSafe(F.col("c.source")))
    copies = F.array_repeat(F.lit(1), (F.col("c.epochs") + more).cast("int"))
    return joined.select(*[F.col(f"d.`{x}`") for x in docs.columns], F.explode(copies).alias(row)).drop(row)


ORACLE = r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CASE WHEN doc_id IS NULL THEN md5('null' || coalesce(text, '')) ELSE md5(CAST(doc_id AS VARCHAR)) END AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes),
weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
levels AS (
  SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS full_at,
         (1.5::DOUBLE * (SELECT CAST(sum(source_size) AS BIGINT) FROM sizes) - coalesce(CAST(sum(2 * source_size) OVER w AS BIGINT), 0))
           / ((SELECT CAST(sum(weight) AS BIGINT) FROM weighted) - coalesce(CAST(sum(weight) OVER w AS BIGINT), 0)) AS level,
         row_number() OVER (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), rank) AS position
  FROM weighted
  WINDOW w AS (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fixed AS (SELECT position, level FROM levels WHERE level <= full_at ORDER BY position LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN l.position >= f.position THEN f.level * weight ELSE CAST(2 * source_size AS DOUBLE) END AS target
  FROM levels l CROSS JOIN fixed f),
placed AS (
  SELECT r.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words,
         coalesce(CAST(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM placed),
taken_ AS (
  SELECT *, CAST(epochs * size + greatest(0, least(size, words - epochs * source_size - start)) AS BIGINT) AS taken FROM cut)
SELECT doc_id, size, source_size, target, taken, source,
       CAST(CASE WHEN size = 0 THEN epochs + CASE WHEN start < words - epochs * source_size THEN 1 ELSE 0 END
                 ELSE (taken * 2 + size) // (size * 2) END AS BIGINT) AS copies
FROM taken_
"""
