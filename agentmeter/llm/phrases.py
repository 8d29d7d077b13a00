"""Phrase collocation mining by HAT-trie counting.

A task counts word sequences in a shallow trie of word ids whose nodes have hash containers for the rest of each phrase: pairs
under their first word, longer phrases under their first two. A container that grows past BURST entries bursts into containers under one word
more. When a task holds more than ROOM phrases it spills whole subtrees, the largest first, as runs in the order of the words; what is
left is spilled at its end. Runs are dealt by (language, leading words), so the runs of one prefix meet in one partition, where
their counts are merged.

Phrases are counted in three passes: words, pairs of words, and three words or more. A phrase as frequent as asked for
holds only words and pairs that are as frequent, so a pass skips what the pass before found to be rare. What was frequent
is passed on as a bitmap of hashes of a fixed size (BITS). Pairs are thinned in the first pass already: occurrences of all pairs are added up by
hash, and a pair whose hash occurs too rarely isn't counted. A false hit of a bitmap only counts a phrase that is
then too rare; nothing is missed.

Scale: three scans of the texts, each shuffling only the different phrases of a task (of pairs in the first pass, 3 bytes each). Nothing is
held for a whole language in one place: the prefix partitions, the joins that look up parts of phrases and the ranking work
on (language, phrase) rows, and a language's ranking is cut to the limit in parts first. The bitmaps are the only thing that passes
through the driver. The more pairs there are to a bit, the fewer are thinned out, which costs time and no results.
"""

from __future__ import annotations

import re
from collections import _count_elements, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.llm.common import written

MIN_COUNT, MAX_WORDS, LIMIT, COVER = 100, 5, 2000, 100
#: Entries of a container before it bursts; phrases and words that a task holds.
BURST, ROOM, WORDS = 4096, 800_000, 400_000
#: Bytes of text split at once, words counted at once, and languages that a task keeps.
SLICE, BATCH, MANY = 1 << 20, 1 << 18, 64
#: Rows of a run, about: subtrees that are spilled together are sorted together. Pairs whose hashes a task holds.
RUN, PAIRS = 1 << 16, 1 << 22
#: Size of a bitmap of frequent phrases, 8 MB, and the share of it that is added up at once.
BITS, PART = 1 << 26, 1 << 16
#: Leading words that choose a phrase's partition.
PREFIX = 3
#: Parts in which a language's ranking is cut first.
PARTS = 64

_BREAK = b"."
_TABLE = bytes(ord(".") if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGE = re.compile(rb"[ \t.]")
#: Bits of a word id in a packed path or rest; ids are below WORDS + SLICE.
_ID = 21
_MASK = (1 << _ID) - 1
_SCHEMA = "lang string, head binary, tail binary, count long, part int, places binary, times binary"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some SLICE bytes at a time, with _BREAK between pieces (it is part of no word)."""
    folded, at = text.translate(_TABLE), 0
    while at < len(folded):
        edge = _EDGE.search(folded, at + SLICE) if len(folded) - at > SLICE else None
        end = edge.start() if edge else len(folded)
        part = folded[at:end].replace(b".", b" . ").replace(b"\t", b" ")
        yield [w for w in part.split(b" ") if w]
        at = end


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word, seed=42)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of two words' hashes."""
    h = first * np.uint64(0x9E3779B97F4A7C15) + second
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Known:
    """A bitmap of hashes of the phrases that can be frequent."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % np.uint64(self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class HatTrie:
    """Counts of sequences of word ids. A node is the packed ids of its path; its container counts the packed rests of phrases by hash."""

    def __init__(self, depth: int, burst: int | None = None):
        self.depth, self.limit, self.size = depth, BURST if burst is None else burst, 0
        self.containers: dict[int, dict[int, int]] = {}
        self.burst: set[int] = set()

    def add(self, phrases: np.ndarray) -> None:
        """Counts the rows of a matrix of word ids, padded with zeros."""
        paths, rests = self._packed(phrases, self.depth)
        if self.burst:
            deep = np.isin(paths, np.fromiter(self.burst, np.int64, len(self.burst)))
            if deep.any():
                paths[deep], rests[deep] = self._packed(phrases[deep], self.depth + 1)
        order = np.argsort(paths, kind="stable")
        paths, rests = paths[order], rests[order].tolist()
        edges = np.flatnonzero(np.append(True, paths[1:] != paths[:-1])) if len(paths) else np.zeros(0, np.int64)
        ends = [*edges[1:].tolist(), len(rests)]
        for path, a, b in zip(paths[edges].tolist(), edges.tolist(), ends, strict=False):
            container = self.containers.setdefault(path, {})
            before = len(container)
            _count_elements(container, rests[a:b])
            self.size += len(container) - before
            if len(container) > self.limit and path >> self.depth * _ID == 0 and phrases.shape[1] > self.depth + 1:
                self._burst(path)

    @staticmethod
    def _packed(phrases: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        pack = lambda columns: sum((c << (_ID * i) for i, c in enumerate(columns)), np.zeros(len(phrases), np.int64))
        return pack(phrases.T[:depth]), pack(phrases.T[depth:])

    def _burst(self, path: int) -> None:
        self.burst.add(path)
        for rest, count in self.containers.pop(path).items():
            self.containers.setdefault(path | (rest & _MASK) << self.depth * _ID, {})[rest >> _ID] = count

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes out the whole subtrees of first words, the largest first, until at most keep phrases are left: word ids (padded with zeros) and counts."""
        below: dict[int, list[int]] = defaultdict(list)
        for path in self.containers:
            below[path & _MASK].append(path)
        weights = sorted(((sum(len(self.containers[p]) for p in paths), word) for word, paths in below.items()), reverse=True)
        for weight, word in weights:
            if self.size <= keep:
                break
            self.size -= weight
            parts = [(p, self.containers.pop(p)) for p in below[word]]
            sizes = [len(c) for _, c in parts]
            path = np.repeat(np.array([p for p, _ in parts], np.int64), sizes)
            rest = np.fromiter((r for _, c in parts for r in c), np.int64, weight)
            ids = np.zeros((weight, 5), np.int64)
            deep = path >> self.depth * _ID > 0
            for rows, depth in ((~deep, self.depth), (deep, self.depth + 1)):
                for i in range(5):
                    ids[rows, i] = path[rows] >> _ID * i & _MASK if i < depth else rest[rows] >> _ID * (i - depth) & _MASK
            yield ids, np.fromiter((n for _, c in parts for n in c.values()), np.int64, weight)


class Vocabulary(dict):
    """Ids of words; 0 for breaks and for words that the pass before found rare. words and hashes are by id."""

    def __init__(self, lang: bytes, known: Known | None):
        self.lang, self.known, self.words, self.hashes = lang, known, [_BREAK], [0]

    def __missing__(self, word: bytes) -> int:
        found = 0
        if word != _BREAK:
            h = word_hash(self.lang, word)
            if self.known is None or int(self.known.words[h % self.known.bits >> 6]) >> (h & 63) & 1:
                found = len(self.words)
                self.words.append(word)
                self.hashes.append(h)
        self[word] = found
        return found


class Tally:
    """What a task has counted of one language. sizes: the numbers of words of the phrases that this pass counts."""

    def __init__(self, lang: str, sizes: tuple[int, ...], known: Known | None, pairs: Known | None):
        self.lang, self.key, self.sizes, self.known, self.pairs = lang, lang.encode("utf-8", "surrogatepass"), sizes, known, pairs
        self.total, self.carry, self.pending = 0, [], []
        self._renew()

    def _renew(self) -> None:
        self.vocabulary, self.times = Vocabulary(self.key, self.known), np.zeros(1, np.int64)
        self.trie, self.hashes = HatTrie(2 if self.sizes[0] > 2 else 1), np.zeros(1, np.uint64)

    def feed(self, words: list[bytes]) -> None:
        self.pending += map(self.vocabulary.__getitem__, words)

    @property
    def size(self) -> int:
        return self.trie.size

    @property
    def full(self) -> bool:
        """Whether the words are too many; words that wait to be counted have their ids still."""
        return len(self.vocabulary) > WORDS and not self.pending

    def count(self) -> np.ndarray | None:
        """Counts the pending words; the last ones stay as the beginning of phrases that go on. Returns the hashes of their pairs, in the first pass."""
        ids, before = np.array(self.carry + self.pending, np.int64), len(self.carry)
        if len(self.hashes) < len(self.vocabulary.hashes):
            self.hashes = np.array(self.vocabulary.hashes, np.uint64)
        hashes = None
        if self.sizes == (1,):
            times = np.bincount(ids[before:], minlength=len(self.hashes))
            times[: len(self.times)] += self.times
            self.times, self.total = times, self.total + int((ids[before:] > 0).sum())
            own = ids[max(0, before - 1) :]
            fine = (own[:-1] > 0) & (own[1:] > 0)
            hashes = pair_hash(self.hashes[own[:-1][fine]], self.hashes[own[1:][fine]])
        else:
            self._add(ids, before)
        last = ids[max(0, len(ids) - max(2, *self.sizes) + 1) :]
        self.carry, self.pending = last[np.append(np.flatnonzero(last == 0), -1).max() + 1 :].tolist(), []  # no phrase goes on over a break
        return hashes

    def _add(self, ids: np.ndarray, before: int) -> None:
        fine = (ids[:-1] > 0) & (ids[1:] > 0)
        fine[fine] = self.pairs.has(pair_hash(self.hashes[ids[:-1][fine]], self.hashes[ids[1:][fine]]))
        most = max(self.sizes)
        for n in self.sizes:
            first = max(0, before - n + 1)  # phrases of n words that end among the new ones
            if len(ids) - first < n:
                continue
            starts = first + np.flatnonzero(np.lib.stride_tricks.sliding_window_view(fine[first:], n - 1).all(axis=1))
            phrases = np.zeros((len(starts), most), np.int64)
            for i in range(n):
                phrases[:, i] = ids[starts + i]
            self.trie.add(phrases)

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Runs of whole subtrees in the order of the words, of all of them where the words are too many; the number of words goes as the phrase of no word."""
        if self.total:
            yield from self._runs(iter([(np.array([[0] * 5]), np.array([self.total]))]))
            self.total = 0
        if self.sizes == (1,):
            there = np.flatnonzero(self.times)
            there = there[there > 0]
            yield from self._runs(iter([(np.stack([there] + [np.zeros_like(there)] * 4, axis=1), self.times[there])]))
            self.times[:] = 0
        else:
            yield from self._runs(self.trie.spill(0 if self.full else keep))
        if self.full:
            carried = [self.vocabulary.words[i] for i in self.carry]
            self._renew()
            self.carry = [self.vocabulary[w] for w in carried]

    def _runs(self, subtrees: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ranks = np.zeros(len(self.vocabulary.words), np.int64)
        ranks[1 + np.array(sorted(range(len(ranks) - 1), key=self.vocabulary.words[1:].__getitem__), np.int64)] = np.arange(1, len(ranks))
        words = pa.array([b"", *self.vocabulary.words[1:]], pa.binary()), pa.array([b"", *[b" " + w for w in self.vocabulary.words[1:]]], pa.binary())
        held, size = [], 0
        for ids, counts in subtrees:
            held.append((ids, counts))
            size += len(ids)
            if size >= RUN:
                yield self._batch(held, ranks, words)
                held, size = [], 0
        if size:
            yield self._batch(held, ranks, words)

    def _batch(self, held: list[tuple[np.ndarray, np.ndarray]], ranks: np.ndarray, words: tuple[pa.Array, pa.Array]) -> pa.RecordBatch:
        ids, counts = np.concatenate([i for i, _ in held]), np.concatenate([n for _, n in held])
        order = np.lexsort(ranks[ids].T[::-1])
        ids, counts = ids[order], counts[order]
        join = lambda columns: pc.binary_join_element_wise(*[words[i > 0].take(pa.array(c)) for i, c in enumerate(columns)], pa.scalar(b"", pa.binary()))
        n = len(ids)
        columns = [pa.repeat(pa.scalar(self.lang, pa.string()), n), join(ids.T[:PREFIX]), join(ids.T[PREFIX:]), pa.array(counts)]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], _NAMES)


class Sketch:
    """Occurrences of pairs by their hashes, modulo bits."""

    def __init__(self, bits: int, least: int):
        self.bits, self.kind, self.top = bits, np.uint8 if least < 256 else np.uint32, 255 if least < 256 else 2**32 - 1
        self.held, self.size = [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(np.unique((hashes % np.uint64(self.bits)).astype(np.int64), return_counts=True))
        self.size += len(self.held[-1][0])

    def spill(self) -> Iterator[pa.RecordBatch]:
        """A row for each part of the bitmap: places and how often they occur, that clipped where it is enough anyway."""
        if not self.size:
            return
        at, back = np.unique(np.concatenate([a for a, _ in self.held]), return_inverse=True)
        times = np.bincount(back, np.concatenate([n for _, n in self.held]))
        self.held, self.size = [], 0
        times = np.minimum(times, self.top).astype(self.kind)
        part, first = np.unique(at // PART, return_index=True)
        ends = [*first[1:].tolist(), len(at)]
        places = [(at[a:b] % PART).astype(np.uint16).tobytes() for a, b in zip(first.tolist(), ends, strict=True)]
        counts = [times[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)]
        n = len(part)
        empty = [pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(part, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], _NAMES)


def _added(bits: int, least: int):
    """Rows of Sketch.spill(), sorted by part, to (part, ones): a bit for each place that occurs least times or more."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(PART, np.int64)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], ["part", "ones"])
        for batch in batches:
            for part, places, times in zip(batch["part"].to_pylist(), batch["places"].to_pylist(), batch["times"].to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, sums = part, np.zeros(PART, np.int64)
                sums[np.frombuffer(places, np.uint16)] += np.frombuffer(times, kind)
        if now is not None:
            yield done()

    return run


def _runs(sizes: tuple[int, ...], known, pairs, room: int = ROOM, bits: int = BITS, least: int = MIN_COUNT):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        sketch = Sketch(bits, least)
        waiting = 0

        def settle(some: list[Tally]) -> Iterator[pa.RecordBatch]:
            for tally in some:
                hashes = tally.count()
                if hashes is not None:
                    sketch.add(hashes)
            if sketch.size > PAIRS:
                yield from sketch.spill()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tally = tallies.get(lang)
                if tally is None:
                    tally = tallies[lang] = Tally(lang, sizes, known and known.value, pairs and pairs.value)
                for words in tokens(text.as_py()):
                    tally.feed(words)
                    waiting += len(words)
                    if len(tally.pending) >= BATCH:
                        waiting -= len(tally.pending)
                        yield from settle([tally])
                        yield from _relief(tallies, room, False)
                tally.feed([_BREAK])
                waiting += 1
                if waiting >= 4 * BATCH or len(tallies) > MANY:
                    waiting = 0
                    yield from settle([*tallies.values()])
                    yield from _relief(tallies, room, len(tallies) > MANY)
        yield from settle([*tallies.values()])
        for tally in tallies.values():
            yield from tally.spill(0)
        yield from sketch.spill()

    return run


def _relief(tallies: dict[str, Tally], room: int, many: bool) -> Iterator[pa.RecordBatch]:
    """Spills until the tries hold half of room between them, if they hold more than room; many: spills and forgets all languages, between documents."""
    held = sum(t.size for t in tallies.values())
    for lang, tally in list(tallies.items()):
        if held > room or tally.full or many:
            yield from tally.spill(0 if many else int(tally.size * room / 2 / held) if held > room else tally.size)
        if many:  # between documents nothing is carried on
            del tallies[lang]


def _frequent(runs: DataFrame, min_count: int, name: str) -> DataFrame:
    """(lang, phrase, count) of the frequent phrases of runs. The runs of one prefix meet in one partition."""
    merged = runs.select("lang", "head", "tail", "count").repartition("lang", "head").groupBy("lang", "head", "tail").agg(F.sum("count").alias("count"))
    phrase = F.concat("head", F.when(F.length("tail") > 0, F.concat(F.lit(b" "), "tail")).otherwise(F.lit(b""))).cast("string")
    return written(merged.where(F.col("count") >= min_count).select("lang", phrase.alias("phrase"), "count"), name)


def _places(bits: int):
    """(lang, phrase) of one or two words to (part, places) of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True):
                key = lang.encode("utf-8", "surrogatepass")
                hashes = [np.array([word_hash(key, w)], np.uint64) for w in phrase.split(b" ")]
                found.append(hashes[0] if len(hashes) == 1 else pair_hash(*hashes))
            at = (np.concatenate(found) % np.uint64(bits)).astype(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at.astype(np.uint64) & np.uint64(63))).view(np.int64))], ["word", "one"])

    return run


def bitmap(frequent: DataFrame, bits: int = BITS) -> Known:
    """A bitmap of the hashes of words or pairs: bits / 64 rows at most, whatever their number."""
    rows = frequent.where("phrase <> ''").select("lang", F.col("phrase").cast("binary").alias("phrase"))
    ones = rows.mapInArrow(_places(bits), "word long, one long").groupBy("word").agg(F.bit_or("one").alias("ones")).toArrow()
    words = np.zeros(-(-bits // 64), np.uint64)
    words[ones["word"].to_numpy()] = ones["ones"].to_numpy().view(np.uint64)
    return Known(words, bits)


def pair_bitmap(runs: DataFrame, bits: int, least: int) -> Known:
    """A bitmap of the hashes under which least pairs or more occur, from the sketches of the first pass."""
    parts = runs.where("part IS NOT NULL").select("part", "places", "times").repartition("part").sortWithinPartitions("part")
    rows = parts.mapInArrow(_added(bits, least), "part int, ones binary").toArrow()
    words = np.zeros(-(-bits // PART) * PART // 64, np.uint64)
    for part, ones in zip(rows["part"].to_pylist(), rows["ones"].to_pylist(), strict=True):
        words[part * PART // 64 : (part + 1) * PART // 64] = np.frombuffer(ones, np.uint64)
    return Known(words, bits)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, bits: int = BITS, room: int = ROOM) -> DataFrame:
    """(lang, phrase, count) of all phrases of up to max_words (2 to 5) words that occur min_count times or more in their language.

    The phrase of no word has the number of all words of its language (unless that is below min_count). bits: a multiple of 64.
    """
    spread = docs.sparkSession.sparkContext.broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    first = written(texts.mapInArrow(_runs((1,), None, None, room, bits, min_count), _SCHEMA), "phrases-runs")
    words = _frequent(first.where("part IS NULL"), min_count, "phrases-1")
    known = spread(bitmap(words, bits))
    pairs = _frequent(texts.mapInArrow(_runs((2,), known, spread(pair_bitmap(first, bits, min_count)), room), _SCHEMA), min_count, "phrases-2")
    found = words.unionByName(pairs)
    if max_words >= 3:
        runs = texts.mapInArrow(_runs(tuple(range(3, max_words + 1)), known, spread(bitmap(pairs, bits)), room), _SCHEMA)
        found = found.unionByName(_frequent(runs, min_count, "phrases-3"))
    return found


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def scored(frequent: DataFrame, cover: int = COVER) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words or more that no longer one covers.

    frequent: as frequent_phrases() gives. A phrase is cut in two where that gives it the lowest score, floor(1000 * a * n / (l * r)).
    It is covered if a frequent phrase one word longer holds it and has cover percent of its count; a still longer one can
    only do so if one of these does.
    """
    size = F.size(F.split("phrase", " "))
    phrases = frequent.where(F.col("phrase") != "").withColumn("words", size)
    longest = phrases.where("words >= 2").withColumnRenamed("count", "a")
    inner = F.expr("array(substring_index(phrase, ' ', words - 1), substring_index(phrase, ' ', 1 - words))")
    covers = longest.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = longest.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")
    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(part), F.col("count").alias(name)), ["lang", part])
    cuts = cuts.join(frequent.where("phrase = ''").select("lang", F.col("count").alias("n")), "lang")
    cuts = cuts.withColumn("above", 1000 * _exact("a") * _exact("n")).withColumn("below", _exact("l") * _exact("r"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "a", "l", "r", "n")).alias("cut"))
    return lowest.select("lang", "phrase", *[F.col(f"cut.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, limit: int = LIMIT, cover: int = COVER, bits: int = BITS, room: int = ROOM) -> DataFrame:
    """The collocations of each language, the best limit of them.

    docs: text, lang; other columns are ignored. A-Z are lower-cased, texts are split into pieces at . , ; : ! ? and line ends, pieces
    into words at spaces and tabs. Phrases of 2 to max_words words within a piece that occur min_count times or more in their language are
    scored at their weakest cut. Returns lang, rank (from 1), phrase (space-joined), a (its count), l and r (the counts of both parts),
    n (all words of the language) and score, by score, then a, both descending, then phrase in byte order. Null languages are 'und';
    null and empty texts have no words; repeated rows count each time. An empty table, or one without frequent phrases, gives no rows.
    """
    found = scored(frequent_phrases(docs, min_count, max_words, bits, room), cover)
    order = (F.col("score").desc(), F.col("a").desc(), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    for keys in (["lang", part], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m
  FROM (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM starts)),
counts AS (SELECT lang, phrase, m, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY lang, phrase, m HAVING count(*) >= 100),
parts AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, m, f AS a FROM counts WHERE m >= 2),
inside AS (
  SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS s FROM (SELECT lang, w, m, a, unnest(range(2, m)) AS k FROM parts))
  GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.phrase, p.a, l.f AS l, r.f AS r, t.n, p.k,
         CAST(1000::HUGEINT * p.a * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM parts) p
  JOIN counts l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:p.k], ' ')
  JOIN counts r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[p.k + 1:p.m], ' ')
  JOIN totals t ON t.lang = p.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT c.lang, CAST(row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS BIGINT) AS rank, c.phrase, c.a, c.l, c.r, c.n, c.score
  FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a)
SELECT * FROM ranked WHERE rank <= 2000
"""
