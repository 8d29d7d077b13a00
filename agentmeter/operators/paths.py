"""Directories and the repositories they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_repo(dirs: DataFrame, repos: DataFrame) -> DataFrame:
    """(dir, repo) for each distinct dir: its nearest ancestor, or itself, among repos; null if there is none.

    Ancestors of distinct directories are cut out and joined on equality.
    """
    distinct = dirs.select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = distinct.select("dir", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("repo"))
    found = ancestors.join(repos.distinct(), "repo").groupBy("dir").agg(F.max_by("repo", F.length("repo")).alias("repo"))
    return distinct.join(found, "dir", "left")
