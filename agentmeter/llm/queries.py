"""The registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentmeter.llm import decontaminate, hardnegatives, langid, linededup, mixing, phrases, quality, secrets, sharding, simhash, topk, toxicity, warc
from agentmeter.llm.common import read


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, "labels").selectExpr("doc_id", f"{name} AS label")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), _labels(spark, sf_dir, "toxic"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train_and_identify(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), _labels(spark, sf_dir, "quality"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_hardnegatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hardnegatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_sharding": op3_sharding,
    "op4_topk": op4_topk,
    "op5_secrets": op5_secrets,
    "op6_langid": op6_langid,
    "op7_simhash": op7_simhash,
    "op8_linededup": op8_linededup,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_hardnegatives": op11_hardnegatives,
    "op12_phrases": op12_phrases,
    "op13_warc": op13_warc,
}

ORACLES = {
    "op3_sharding": sharding.ORACLE,
    "op4_topk": topk.ORACLE,
    "op8_linededup": linededup.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_hardnegatives": hardnegatives.ORACLE,
    "op12_phrases": phrases.ORACLE,
    "op13_warc": warc.ORACLE,
}
