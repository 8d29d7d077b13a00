"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into pieces of at most PIECE characters, the stride being half of that. A piece of m characters that occurs
in a text with at most k edits shares at least m - q + 1 - k * q of its q-grams with that place, all of them on diagonals
(place in the text minus place in the piece) that lie within k of each other. So q-grams that a text shares with a piece
are counted in overlapping bands of diagonals, bands that reach the bound are kept, and a banded alignment decides. q is 8, or less for short
pieces, so that the bound asks for a shared q-gram at the full tenth of edits. Items of fewer than 10 characters have no edits; those of fewer than 8
match only between characters that don't go on as the item's own words do.

Texts and items are compared with letters lower-cased and each run of white space as one space, so that wrapped and indented copies are
found; spans point into the text as it is.

Scale: the benchmark is the query set. It is split into blocks of at most BLOCK_CHARS characters; each block's q-gram index is
broadcast and meets every text in one pass, without a shuffle. A task works on SLICE characters at a time and overlaps
slices by the longest reach of a match, and counts at most about ENTRIES pairs of a place and an index entry at once, so long texts and
common q-grams need no more memory than others. q-grams of rulers and padding, which would meet at each place of a run, aren't indexed: a piece
counts the q-grams it has beside them, and its edits are bounded by these. Equal pieces of different items are looked for once. A text that repeats
itself with some period, a line a thousand times, is searched as if it did so only at the ends of the run: each place in its middle is like one of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Q, PIECE, EDITS = 8, 64, 0.1
#: Items of fewer characters match only as words of their own.
WORDLIKE = 8
BLOCK_CHARS, SLICE, ENTRIES = 1_000_000, 1 << 20, 1 << 20
#: Diagonals a band is moved by; its width is twice that, so any run of BAND diagonals lies inside one band.
BAND = PIECE // 10 + 4
#: Shared entries a place, on average, from which a text's repetitions are looked for.
CROWDED = 16
_FACTOR = 0x9E3779B97F4A7C15
_FILTER_BITS = 22
_OUTSIDE = np.uint32(0x110000)


def _lower_table() -> np.ndarray:
    """Lower-case letters of the first plane, where one character becomes one; white space becomes a space."""
    table = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
        if chr(i).isspace():
            table[i] = 32
    return table


_LOWER: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """A text's code points, folded."""
    if not _LOWER:
        _LOWER.append(_lower_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x10000, _LOWER[0][np.minimum(points, 0xFFFF)], points)


def collapsed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """points with each run of spaces as one, and where each of them stood (None: in its place)."""
    again = points[1:] == 32
    again &= points[:-1] == 32
    if not again.any():
        return points, None
    kept = np.flatnonzero(np.concatenate([[True], ~again]))
    return points[kept], kept


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters at each place, of hashes of 1, 2, 4 and 8 characters."""
    n = max(0, len(points) - q + 1)
    block, factor, width, done, out = points.astype(np.uint64), _FACTOR, 1, 0, np.zeros(n, np.uint64)
    while n:
        if q & width:
            out = out * np.uint64(factor) + block[done : done + n]
            done += width
        if width * 2 > q:
            break
        block = block[:-width] * np.uint64(factor) + block[width:]
        factor, width = factor * factor % 2**64, width * 2
    return out ^ (out >> np.uint64(29))


def telling(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Places of the q-grams that count: those that don't repeat with a period up to q / 2 (rulers, padding)."""
    windows = np.lib.stride_tricks.sliding_window_view(points, q) if len(points) >= q else np.zeros((0, q), points.dtype)
    repeats = [(windows[:, p:] == windows[:, :-p]).all(axis=1) for p in range(1, q // 2 + 1)]
    return np.flatnonzero(~np.any(repeats, axis=0)) if repeats else np.arange(len(windows))


def gram_size(length: int, share: float = EDITS) -> int:
    """The q of a piece: the largest up to Q at which a place with all its edits still shares a q-gram."""
    return max(1, min(Q, length // (int(length * share) + 1)))


def edit_budget(length: int, grams: int, share: float = EDITS, q: int = Q) -> int:
    """Edits allowed for a piece with so many q-grams: its share of the length, as far as the lemma still asks for at least one shared q-gram."""
    return max(0, min(int(length * share), (grams - 1) // q))


def condensed(points: np.ndarray, reach: int) -> np.ndarray | None:
    """Places that are left when the middle of each long periodic run is taken out, whole periods of it; None if there is no such run.

    Any reach characters of a run's middle are also found in what is left of it, and runs don't go over the end of a text.
    """
    h = gram_hashes(points)
    if not len(h):
        return None
    order = np.argsort(h, kind="stable")
    back = np.zeros(len(h), np.int64)
    again = h[order][1:] == h[order][:-1]
    back[order[1:][again]] = (order[1:] - order[:-1])[again]  # how far back the same characters stood
    ends = np.concatenate([[0], np.cumsum(points == _OUTSIDE)])
    at = np.arange(len(h))
    back[ends[at + Q] > ends[at - back]] = 0
    edges = np.flatnonzero(np.append(True, back[1:] != back[:-1]))
    lengths = np.diff(np.append(edges, len(back)))
    kept = np.ones(len(points), bool)
    periods = back[edges]
    long = (periods > 0) & (lengths > 2 * reach + 3 * periods)
    for a, n, p in zip(edges[long].tolist(), lengths[long].tolist(), periods[long].tolist(), strict=True):
        side = reach + p
        kept[a + side : a + side + (n - 2 * side) // p * p] = False
    return None if kept.all() else np.flatnonzero(kept)


class Index:
    """The pieces of a block of benchmark items, in a part for each q."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDITS):
        self.items: list[list[tuple[int, int]]] = []  # (item, its piece's number) of each different piece
        pieces: dict[bytes, int] = {}
        sizes: dict[tuple[int, bool], list[tuple[int, np.ndarray]]] = {}
        number = 0
        for item_id, text in items:
            points = collapsed(codes(text))[0].astype(np.uint32)
            if len(points) < Q:  # spaces at its ends would have to stand in the text too
                points = collapsed(codes(text.strip()))[0].astype(np.uint32)
            ends = [len(points)] if len(points) <= PIECE else [*range(PIECE, len(points), PIECE // 2), len(points)]
            for end in ends if len(points) else ():
                part = points[max(0, end - PIECE) : end]
                key = part.tobytes()
                if key not in pieces:
                    pieces[key] = len(self.items)
                    self.items.append([])
                    sizes.setdefault((gram_size(len(part), share), len(points) < WORDLIKE), []).append((pieces[key], part))
                self.items[pieces[key]].append((item_id, number))
                number += 1
        self.parts = [Part(q, some, share, wordlike) for (q, wordlike), some in sorted(sizes.items(), key=lambda x: x[0])]
        self.reach = max((p.reach for p in self.parts), default=2 * BAND)

    def find(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(piece, edits, start, end) for the pieces that occur in points within their budget; starts and ends are those of the band."""
        return [row for part in self.parts for row in part.find(points, self.reach)]


def _goes_on(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a word goes on between the characters before and at each place."""
    inside = (at > 0) & (at < len(points))
    letters = lambda some: np.array([c < 0x110000 and chr(c).isalnum() for c in some.tolist()], bool)
    out = np.zeros(len(at), bool)
    out[inside] = letters(points[at[inside] - 1]) & letters(points[at[inside]])
    return out


class Part:
    """Pieces (number, characters) that have one q, with their q-grams sorted by hash. wordlike: they are of q characters and match as words of their own."""

    def __init__(self, q: int, pieces: list[tuple[int, np.ndarray]], share: float, wordlike: bool):
        self.wordlike = wordlike
        self.q, self.pieces = q, []
        number, hashes, piece, offset, need, edits = [], [], [], [], [], []
        for n, part in pieces:
            at = telling(part, q) if int(len(part) * share) else np.arange(len(part) - q + 1)  # without edits a q-gram or two are looked for
            if not len(at):
                continue
            k = edit_budget(len(part), len(at), share, q)
            hashes.append(gram_hashes(part, q)[at])
            piece.append(np.full(len(at), len(self.pieces), np.int32))
            offset.append(at.astype(np.int32))
            need.append(max(1, len(at) - k * q))
            edits.append(k)
            number.append(n)
            self.pieces.append(part)
        self.number, self.need, self.edits = np.array(number, np.int64), np.array(need, np.int64), np.array(edits, np.int64)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hash = flat[order]
        self.piece = np.concatenate(piece)[order] if hashes else np.zeros(0, np.int32)
        self.offset = np.concatenate(offset)[order] if hashes else np.zeros(0, np.int32)
        self.first = np.unique(self.hash, return_index=True)[1]
        self.distinct = self.hash[self.first]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.hash)] = True
        self.reach = int(self.lengths.max(initial=0) + self.edits.max(initial=0)) + 2 * BAND

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def find(self, points: np.ndarray, reach: int) -> list[tuple[int, int, int, int]]:
        """As Index.find(). A place that is met across the cut of a condensed run is given at both of its ends."""
        shared = self._shared(points)
        if self.wordlike:
            return self._words(points, shared[0], self.piece[shared[1]])
        kept = condensed(points, 2 * reach) if shared[2].sum() > CROWDED * len(points) else None
        if kept is not None:
            shared = self._shared(points[kept])
        text = points if kept is None else points[kept]
        out = []
        for p, edits, start, end in self._verify(text, *self._bands(len(text), *shared)):
            first = last = start
            if kept is not None:
                first, last = int(kept[min(start, len(kept) - 1)]), int(kept[end - 1]) + 1 - (end - start)
            out += [(int(self.number[p]), edits, at, at + end - start) for at in {first, last}]
        return out

    def _words(self, points: np.ndarray, place: np.ndarray, piece: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Places of whole pieces at whose ends no word goes on."""
        fine = ~_goes_on(points, place) & ~_goes_on(points, place + self.q)
        found = zip(place[fine].tolist(), piece[fine].tolist(), strict=True)
        return [(int(self.number[p]), 0, at, at + self.q) for at, p in found if (points[at : at + self.q] == self.pieces[p]).all()]

    def _shared(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose q-gram some piece has, with the first index entry of each and how many it has."""
        if not len(self.hash) or len(points) < self.q:
            return (np.zeros(0, np.int64),) * 3
        h = gram_hashes(points, self.q)
        place = np.flatnonzero(self.filter[self._slot(h)])
        at = np.searchsorted(self.distinct, h[place])
        real = at < len(self.distinct)
        real[real] = self.distinct[at[real]] == h[place[real]]
        place, at = place[real], at[real]
        return place, self.first[at], np.append(self.first[1:], len(self.hash))[at] - self.first[at]

    def _bands(self, length: int, place: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, band) wherever a band of diagonals holds as many shared q-grams as the piece needs.

        Places are walked in order, some ENTRIES entries at a time; counts of bands that later places can't reach are settled and dropped.
        """
        span = np.int64(length // BAND + 16)
        total = np.cumsum(many)
        key, count, kept, at = np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.int64)], 0
        while at < len(place):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + ENTRIES, side="right")))
            own = many[at:stop]
            entry = np.repeat(first[at:stop] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
            band = (np.repeat(place[at:stop], own) - self.offset[entry] + 4 * BAND) // BAND  # positive, for division
            new = self.piece[entry].astype(np.int64) * span + band
            # a shared q-gram counts in the two bands that hold its diagonal
            new, times = np.unique(np.concatenate([new, new - 1]), return_counts=True)
            if len(key):
                new, back = np.unique(np.concatenate([key, new]), return_inverse=True)
                times = np.bincount(back, np.concatenate([count, times])).astype(np.int64)
            done = np.ones(len(new), bool) if stop == len(place) else new % span < (place[stop] - PIECE + 4 * BAND) // BAND - 1
            enough = times >= self.need[new // span]
            kept.append(new[done & enough])
            key, count, at = new[~done], times[~done], stop
        found = np.concatenate(kept)
        return found // span, found % span

    def _verify(self, points: np.ndarray, piece: np.ndarray, band: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Alignments of each piece, ends and all, to the text inside its band of diagonals; text before and after is free."""
        out = []
        width = 2 * BAND
        for m in np.unique(self.lengths[piece]):
            own = np.flatnonzero(self.lengths[piece] == m)
            for i in range(0, len(own), 1024):
                some = own[i : i + 1024]
                pattern = np.stack([self.pieces[p] for p in piece[some]])
                low = band[some] * BAND - 4 * BAND  # the band's first diagonal
                d = np.zeros((len(some), width), np.int32)
                steps = np.arange(width, dtype=np.int32)
                for row in range(m):
                    at = low[:, None] + steps + row
                    inside = (at >= 0) & (at < len(points))
                    there = np.where(inside, points[np.clip(at, 0, len(points) - 1)], _OUTSIDE)
                    best = d + (there != pattern[:, row : row + 1])
                    best[:, :-1] = np.minimum(best[:, :-1], d[:, 1:] + 1)  # a character of the piece is missing
                    d = np.minimum.accumulate(best - steps, axis=1) + steps  # characters of the text are added
                least = d.min(axis=1)
                for j in np.flatnonzero(least <= self.edits[piece[some]]):
                    end = int(low[j] + d[j].argmin() + m)
                    out.append((int(piece[some[j]]), int(least[j]), max(0, end - int(m)), min(len(points), end)))
        return out


def _slices(texts: Iterator[tuple[int | None, str | None]], reach: int) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """Arrays of up to about SLICE characters with, for each text in them, (id, start in the array, start in the text, where the text's characters stood)."""
    parts, marks, size = [], [], 0
    for doc, text in texts:
        points, stood = collapsed(codes(text or ""))
        for a in range(0, max(1, len(points) - 2 * reach), SLICE):
            part = points[a : a + SLICE + 2 * reach]
            marks.append((doc, size, a, stood))
            parts += [part, np.array([_OUTSIDE])]
            size += len(part) + 1
            if size >= SLICE:
                yield np.concatenate(parts), marks
                parts, marks, size = [], [], 0
    if parts:
        yield np.concatenate(parts), marks


def hits(index: Index, texts: Iterator[tuple[int | None, str | None]]) -> Iterator[list[tuple]]:
    """(id, item, piece, edits, start, end) of each occurrence in texts (id, text), some texts at a time."""
    for points, marks in _slices(texts, index.reach):
        starts = np.array([m[1] for m in marks])
        rows = []
        for piece, edits, start, end in index.find(points):
            doc, first, offset, stood = marks[int(np.searchsorted(starts, (start + end) // 2, side="right")) - 1]
            a, b = max(0, start - first + offset), end - first + offset
            if stood is not None:
                a, b = int(stood[a]), int(stood[min(b, len(stood)) - 1]) + 1
            rows += [(doc, item, number, edits, a, b) for item, number in index.items[piece]]
        yield rows


def _match(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((doc, text.as_py()) for batch in batches for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for rows in hits(index.value, texts):
            names = ["doc_id", "item_id", "piece", "edits", "start", "end"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _clean(index):
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            fine = np.ones(len(part), bool)
            for rows in hits(index.value, enumerate(part)):
                fine[[r[0] for r in rows]] = False
            yield pd.Series(fine)

    clean.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return clean


def blocks(benchmark: DataFrame, share: float = EDITS, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of bounded parts of the benchmark, dealt by the hash of the items."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // block_chars
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Index([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], share)


def matches(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Benchmark items that documents hold, within a tenth of edits.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. An item is found in a document if one of its pieces is
    (items of up to PIECE characters are one piece). Returns one row for each pair: doc_id, item_id, pieces (how many
    different ones were found), edits (the least of one piece), start and end (code points, over all places, exact to the
    edits). Null and empty texts, and items without a telling q-gram, match nothing. Rows with a null id, and repeated
    rows, are reported under that id. Items with one id count as one. Empty tables give no rows.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, piece int, edits int, start long, end long"
    found = None
    for index in blocks(benchmark, share, block_chars):
        part = rows.mapInArrow(_match(spark.sparkContext.broadcast(index)), schema)
        found = part if found is None else found.unionAll(part)
    return found.groupBy("doc_id", "item_id").agg(
        F.count_distinct("piece").cast("int").alias("pieces"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end")
    )


def clean(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that hold a benchmark item. Each row is judged by its own text, whatever its id; nothing is shuffled."""
    for index in blocks(benchmark, share, block_chars):
        fine = F.pandas_udf(_clean(docs.sparkSession.sparkContext.broadcast(index)), "boolean")
        docs = docs.where(fine(F.col("text").cast("string")))
    return docs
