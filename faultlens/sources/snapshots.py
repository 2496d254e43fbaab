"""Snapshots of a stored index: which version of each repo is live, named by one commit file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _text(spark: SparkSession, path: str, name: str) -> str:
    return "".join(r.value + "\n" for r in spark.read.text(f"{path}/commits/{name}").collect())


def latest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(number, snapshot) of the last commit, (0, None) before the first. A commit file that was not written to its end counts for nothing."""
    for name in reversed(_names(spark, path)):
        lines = _text(spark, path, name).split()
        if len(lines) == 2 and lines[1] == "end":
            return int(name), lines[0]
    return 0, None


def read(spark: SparkSession, path: str, snapshot: str | None = None) -> DataFrame:
    """(repo, version) of every live repo, as of the last commit or of the snapshot named."""
    name = snapshot or latest(spark, path)[1]
    if name is None:
        raise ValueError(f"no index was committed at {path}")
    return spark.read.schema("repo string, version string").parquet(f"{path}/snapshots/{name}")


def commit(spark: SparkSession, path: str, repos: DataFrame, version: str, tries: int = 10) -> str:
    """Make `version` the live one of repos(repo); the snapshot's name.

    The list of live versions is written aside, then one small file with the next number names it. That file is created only if no other has its
    number: of two writers one begins anew on the other's snapshot, so neither is lost.
    """
    fs, where = _folder(spark, path)
    fresh = repos.select(F.col("repo").cast("string").alias("repo"), F.lit(version).alias("version"))
    for _ in range(tries):
        number, last = latest(spark, path)
        name = uuid.uuid4().hex
        whole = fresh if last is None else read(spark, path, last).join(fresh.select("repo"), "repo", "left_anti").unionByName(fresh)
        whole.coalesce(1).write.parquet(f"{path}/snapshots/{name}")
        taken = _names(spark, path)
        number = max([number, *map(int, taken)])  # one cut short keeps its number
        try:
            out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(where, f"{number + 1:012d}"), False)
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" in str(e):
                continue
            raise
        out.write(bytearray(f"{name}\nend\n".encode()))
        out.close()
        return name
    raise RuntimeError(f"no commit at {path} after {tries} tries")
