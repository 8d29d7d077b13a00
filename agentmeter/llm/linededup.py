"""Line dedup by a sharded minimal perfect hash.

Every distinct line key has a 128-bit hash: one half places it, the other is its fingerprint. Keys are dealt to shards
by the first half; a shard's task builds a minimal perfect hash over its keys (levels of bit arrays, each key set where
no other key of its level falls; a key's index is the rank of its bit) and lays out three arrays by that index:
fingerprints, document counts, and the largest document. The documents' line hashes of that shard then probe the arrays:
no line text is shuffled or joined.

Skew: a key that many documents hold has as many probes. Keys with more than SPLIT of them are a table of their own, which is joined
to the probes on the key (with no hint: Spark broadcasts it while it is small and splits skewed partitions beyond); their
probes are dealt to as many sub-shards as they need, by document, and each of these gets a copy of the shard's split keys. So a group has
SHARD_PAIRS probes on average, and SPLIT more for each hot key in it, at any input size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import SPACE, written

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_PAIRS, SPLIT = 50_000, 25_000

_SPACE = SPACE


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: find() gives each key its own index from 0 to n - 1."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.6):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        done, level = 0, 0
        while len(keys):
            size = int(len(keys) * gamma) + 8
            at = self._spread(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            ranks = np.cumsum(alone) - 1 + done
            self.levels.append((alone, ranks))
            done += int(alone.sum())
            keys, level = keys[~alone[at]], level + 1

    @staticmethod
    def _spread(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = keys ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        return ((mixed ^ (mixed >> np.uint64(33))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Indexes; for a key that is not of the set, -1 or any index, so that a fingerprint must decide."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, ranks) in enumerate(self.levels):
            at = self._spread(keys[open_], level, len(alone))
            hit = alone[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out


def _hashes(text: str, min_chars: int) -> Iterator[tuple[str, bytes | None]]:
    """Each line with its key's hash, None for keys too short to count."""
    seen: dict[str, bytes | None] = {}
    for line in text.split("\n"):
        if line not in seen:
            key = line.strip(_SPACE)  # lower-casing keeps its length, and bytes lower-case A-Z alone
            seen[line] = xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None
        yield line, seen[line]


def _pairs(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {h for _, h in _hashes(text.as_py() or "", min_chars) if h}
                ids += [doc] * len(own)
                found += own
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "place", "print"])

    return run


def _probe(min_docs: int):
    def run(probes: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        # The halves of different keys may agree in the placing half; such keys stay out of the perfect hash.
        place = keys["place"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(place, kind="stable")
        twin = np.zeros(len(place), bool)
        twin[1:] = place[order][1:] == place[order][:-1]
        single = order[~twin]
        index = PerfectHash(place[single])
        slot = index.find(place[single])
        prints, counts, last = (np.empty(len(single), np.int64) for _ in range(3))
        for array, name in ((prints, "print"), (counts, "n_docs"), (last, "last_doc")):
            array[slot] = keys[name].to_numpy(np.int64)[single]
        wanted, marks = probes["place"].to_numpy(np.int64).view(np.uint64), probes["print"].to_numpy(np.int64)
        doc = probes["doc_id"].to_numpy(np.int64)
        at = index.find(wanted)
        known = at >= 0
        known[known] = prints[at[known]] == marks[known]
        drop = np.zeros(len(doc), bool)
        drop[known] = (counts[at[known]] >= min_docs) & (last[at[known]] != doc[known])
        for i in order[twin]:  # at most a few in 2 ** 64
            same = (wanted == place[i]) & (marks == keys["print"].iloc[i])
            drop[same] = (keys["n_docs"].iloc[i] >= min_docs) & (doc[same] != keys["last_doc"].iloc[i])
        return pd.DataFrame({"doc_id": doc[drop], "place": wanted[drop].view(np.int64), "print": marks[drop]})

    return run


def _rewrite(min_chars: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            drops = batch.column("drops").to_pylist()
            for doc, text, drop in zip(batch.column("doc_id").to_pylist(), batch.column("text"), drops, strict=True):
                gone = set(drop or ())
                n, kept = 0, []
                for line, h in _hashes(text.as_py() or "", min_chars):
                    n += 1
                    if h is None or h not in gone:
                        kept.append(line)
                out = "\n".join(kept)
                rows.append((doc, n, n - len(kept), hashlib.sha256(out.encode("utf-8", "surrogatepass")).hexdigest(), *([out] if with_text else [])))
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", *(["kept_text"] if with_text else [])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    return run


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, place, print) of the keys that each document loses; place and print are the halves of the key's hash."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(_pairs(min_chars), "doc_id long, place long, print long")
    pairs = written(found.distinct(), "line-pairs")  # rows of one id are one document
    keys = pairs.groupBy("place", "print").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.max("doc_id"), F.lit(-1)).alias("last_doc"))
    keys = written(keys, "line-keys")
    total = keys.agg(F.sum("n_docs")).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod("place", F.lit(max(total // SHARD_PAIRS, 4 * partitions))).alias("shard")
    parts = F.ceil(F.col("n_docs") / SPLIT).cast("int")
    hot = written(keys.where(F.col("n_docs") > SPLIT).select("place", "print", parts.alias("parts")), "line-hot")
    of_doc = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0))
    probes = pairs.where("doc_id IS NOT NULL").join(hot, ["place", "print"], "left").select("doc_id", "place", "print", shard, of_doc.alias("part"))
    known = keys.select("place", "print", "n_docs", "last_doc", shard, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = probes.groupBy("shard", "part").cogroup(known.groupBy("shard", "part"))
    return dealt.applyInPandas(_probe(min_docs), "doc_id long, place long, print long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = False) -> DataFrame:
    """Drop repeated lines, except in the largest doc_id that holds them.

    docs: doc_id, text; other columns are ignored. A line's key is the line stripped of ASCII white space, A-Z lower-cased.
    Keys of min_chars code points or more that min_docs documents or more hold lose all their lines except in the largest
    doc_id. Returns doc_id, n_lines, n_dropped, kept_sha256 and, with_text, kept_text. Null and empty texts are one
    empty line. Repeated rows, having the same id, are one document: it counts once, and its rows keep or lose a line together.
    Rows with a null id count as one document between them, but lose no lines. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = drops(docs, min_chars, min_docs).groupBy("doc_id").agg(F.collect_list(F.concat(_little("place"), _little("print"))).alias("drops"))
    joined = docs.where("doc_id IS NOT NULL").join(lists, "doc_id", "left").select("doc_id", "text", "drops")
    unnamed = docs.where("doc_id IS NULL").withColumn("drops", F.lit(None).cast("array<binary>"))
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.unionByName(unnamed).mapInArrow(_rewrite(min_chars, with_text), schema)


def _little(column: str):
    """A long's eight bytes, the lowest first, as the hash has them."""
    digits = F.lpad(F.hex(column), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))


#: Rows are numbered, since rows of one id stay rows but count as one document.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs),
keyed AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
kept AS (
  SELECT k.r, k.doc_id, k.pos, k.line, coalesce(o.last_doc <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM kept GROUP BY r, doc_id
"""
