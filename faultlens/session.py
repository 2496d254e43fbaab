"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def build_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faultlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; the cluster names it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once, for sessions whose executors can't import it from their own path."""
    sc = spark.sparkContext
    if getattr(sc, "_faultlens_shipped", False):
        return
    sc._faultlens_shipped = True
    top = os.path.dirname(os.path.abspath(__file__))
    tmp = os.path.realpath(tempfile.mkdtemp(prefix="spark-"))  # on the driver, whose file server hands it out
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    path = os.path.join(tmp, f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.relpath(at, os.path.dirname(top)))
    sc.addPyFile(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise to the shared folder so a lost executor never replays the whole loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """Materialise a round of a loop, or a large step, as a compressed table of the shared folder, read again.

    A checkpoint carries the constraints of its plan into the next one. Over rounds whose columns are worked out from those of the round before
    they multiply, until planning takes longer than the work and fills the driver. A table read again has none. A checkpoint's rows are not packed.
    """
    path = scratch_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 200_000


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when df has at most max_rows rows, for narrow rows of a few numbers or short words; reads no more than it needs to know that."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a plain scan with fewer splits than cores; larger scans stay as they are.

    Plans with a shuffle are left alone: asking for their partition count would run them.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(op in plan for op in ("Join", "Aggregate", "Repartition", "Window", "Sort")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def salted_join(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join that spreads each key of `big` over `salts` buckets and copies `side` to each."""
    other = [F.col(c) for c in big.columns if c not in on] or [F.col(on[0])]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*other), F.lit(salts)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def join_sized(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join left to the planner: a side is broadcast by its bytes, as planned or as measured at run time, never by a count of rows.

    Skewed keys are split at run time (spark.sql.adaptive.skewJoin), so one key may hold any share of `big`; left joins keep `big` whole.
    """
    return big.join(side, on, how)


def join_large(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join with a side that grows with the input: both sides are shuffled.

    Planned sizes come from compressed files and fixed widths per column, so strings built from a table of a few MB would be broadcast
    at hundreds of MB through the driver.
    """
    return big.join(side.hint("merge"), on, how)


def with_ordinal(df: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """1-based position in a total order, without one task seeing all rows.

    Rows are range-partitioned and written once; each partition is numbered on its own and shifted by
    the row count of the partitions before it (one small row per partition).
    """
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)))
    counts = parts.groupBy("_pid").agg(F.count("*").alias("_n"))
    ahead = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select("_pid", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return (parts.join(F.broadcast(shift), "_pid")
            .withColumn(name, F.col("_pos") + F.col("_before") + 1).drop("_pid", "_pos", "_before"))
