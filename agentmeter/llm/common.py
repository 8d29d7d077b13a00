"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\x20\t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. A local session without one (tests) gets a temporary folder; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="agentmeter-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names that no column of df has, by underscores in front."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/agentmeter-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo buckets; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


def md5_key(column: str) -> Column:
    """A hash-random ordering key that other SQL engines can compute too."""
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("null")))
