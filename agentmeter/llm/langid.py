"""Language identification by compression.

Each language has a dictionary of raw content: whole labelled texts. A text is cut into pieces; each piece is
compressed by zstandard with every language's dictionary, the sizes are summed over the whole text, and the language with the
smallest sum wins. A text is rejected when the runner-up is too close for its length, or when it has no letters.

Scale: one pass over the texts for scoring, no shuffle. A dictionary is made of at most SAMPLE_ROWS texts, chosen by the hash of their
ids; the number of rows is its only bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.llm.common import id_bucket, md5_key

#: The bound of what is learned: labelled rows for each language.
SAMPLE_ROWS = 64
#: Texts are compressed in pieces of PIECE bytes. Short ones are repeated up to LEAST bytes: zstandard stores what saves too
#: little, and only the first copy's matches with the dictionary make a difference.
PIECE, LEAST = 4000, 256
#: The runner-up's size must be this share larger than the winner's.
MARGIN = 0.004
UNKNOWN = "und"
#: ASCII characters that say nothing about a language are left out before compression; letters and white space stay.
_DROPPED = bytes(c for c in range(33, 127) if not chr(c).isalpha())


def plain(text: str) -> bytes:
    """The letters of a whole text, lower-cased, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _DROPPED)


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """A dictionary for each language of docs (text, lang): up to sample_rows whole texts.

    The sample is bounded: sample_rows rows a language, the first by the hash of doc_id. Their hashes are found first, so that only the chosen
    texts are moved. Rows whose lang or text is null, or whose text is empty, are left out.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    keyed = usable.select("lang", md5_key("doc_id").alias("key"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    order = Window.partitionBy("lang").orderBy("key", "digest")
    ranked = keyed.select("lang", "key", "digest").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_rows)
    few = ranked.groupBy("lang", "key", "digest").agg(F.min("rank").alias("rank"))
    picked = keyed.join(F.broadcast(few), ["lang", "key", "digest"]).dropDuplicates(["lang", "rank"])
    out: dict[str, list[bytes]] = {}
    for row in picked.orderBy("lang", "rank").select("lang", "text").collect():
        out.setdefault(row["lang"], []).append(plain(row["text"]))
    return {lang: b"\n".join(texts) for lang, texts in out.items()}


class Models:
    """Compressors for each language; made anew in each task from the dictionaries' bytes."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                6, source_size=PIECE, dict_size=len(dictionaries[lang]), min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False
            )
            content.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=content, compression_params=settings))

    def sizes(self, text: str) -> list[int]:
        data = plain(text)
        if 0 < len(data) < LEAST:
            data = (data + b"\n") * -(-LEAST // len(data))
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def predict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected. The score is 0 without letters; it grows with the margin."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(sizes) == 1:
            return self.langs[best], 1.0, False
        gap = (min(s for i, s in enumerate(sizes) if i != best) - sizes[best]) / max(1, sizes[best])
        return self.langs[best], min(1.0, 0.5 + gap * 5), gap < margin


def _predict(dictionaries: dict[str, bytes], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(dictionaries)
        for batch in batches:
            found = [models.predict(x.as_py(), margin) for x in batch.column(batch.schema.names.index("text"))]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and rejected for each document.

    docs: doc_id, text; other columns are ignored. Texts that are null or have no letter are 'und' with score 0 and
    rejected, as is every text if no language was learned. Equal sizes go to the first language by name, and are
    rejected. Repeated rows and null ids are treated like any other. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_predict(dictionaries, margin), "doc_id long, held_out boolean, text string, lang_pred string, score double, rejected boolean")
    return found.drop("text")


def train_and_identify(docs: DataFrame, **options) -> DataFrame:
    """identify() with dictionaries learned from the rows of docs whose crc32 modulo 5 is not 0."""
    return identify(docs, learn(docs.where(id_bucket("doc_id", 5) != 0)), **options)


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are rejected, in the columns of docs."""
    dictionaries = learn(docs.where(id_bucket("doc_id", 5) != 0))
    verdict = F.pandas_udf(_accepts(dictionaries, options.get("margin", MARGIN)), "boolean")
    return docs.where(verdict(F.col("text").cast("string")))


def _accepts(dictionaries: dict[str, bytes], margin: float):
    import pandas as pd

    def accepts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models = Models(dictionaries)
        for part in texts:
            yield pd.Series([not models.predict(x, margin)[2] for x in part], dtype=bool)

    accepts.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return accepts
