"""As-of joins by one shuffle: both sides are put on one time line and a window carries the match along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line(rows: DataFrame, marks: DataFrame, keys: list[str], at: Column, mark_at: Column, mark: Column) -> DataFrame:
    left = rows.withColumn("__at", at).withColumn("__mark", F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType)).withColumn("__row", F.lit(True))
    right = marks.select(*keys, mark_at.alias("__at"), mark.alias("__mark"), F.lit(False).alias("__row"))
    return left.unionByName(right, allowMissingColumns=True)


def forward(rows: DataFrame, marks: DataFrame, keys: list[str], at: Column, mark_at: Column, mark: Column, tie: list[str] | None = None, name: str = "mark") -> DataFrame:
    """rows with the first of marks at or after each row's time, among those with its keys; null if none follows.

    mark is what is carried (a struct, say). tie orders fields of mark among marks of one time.
    """
    line = _line(rows, marks, keys, at, mark_at, mark)
    order = [F.col("__at").desc(), F.col("__row"), *[F.col(f"__mark.{t}").desc() for t in tie or []]]
    after = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # backwards in time: a frame that grows is kept up, one that shrinks is read anew for each row
    out = line.withColumn(name, F.last("__mark", ignorenulls=True).over(after)).where("__row")
    return out.drop("__at", "__mark", "__row")


def backward(rows: DataFrame, marks: DataFrame, keys: list[str], at: Column, mark_at: Column, mark: Column, tie: list[str] | None = None, name: str = "mark") -> DataFrame:
    """rows with the last of marks at or before each row's time, among those with its keys; null if none came before."""
    line = _line(rows, marks, keys, at, mark_at, mark)
    order = [F.col("__at"), F.col("__row"), *[F.col(f"__mark.{t}") for t in tie or []]]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = line.withColumn(name, F.last("__mark", ignorenulls=True).over(before)).where("__row")
    return out.drop("__at", "__mark", "__row")
