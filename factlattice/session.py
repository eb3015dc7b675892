"""Session helpers shared by all operators: reading tables, and cutting lineage safely on a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``root``; parquet file or folder, columns pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the session already has, else ``spark.checkpoint.dir``, else a local folder (tests only)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        master = sc.master or ""
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "factlattice-checkpoints")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def rows_of(df: DataFrame, limit: int) -> list:
    """The rows of a result whose size has a proven bound; refuses instead of growing past ``limit``."""
    got = df.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows where a bound was expected")
    return got


def small_copy(df: DataFrame, limit: int) -> DataFrame:
    """A local copy, to be broadcast, of a table whose size has a proven bound; refuses instead of growing past ``limit``."""
    return F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in rows_of(df, limit)], df.schema))


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def same_schema_empty(df: DataFrame) -> DataFrame:
    """No rows of the schema of ``df``."""
    return df.where(F.lit(False))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the session shuffles to, for work that costs far more than moving the rows.

    Large inputs have more partitions than that already and stay where they are.
    """
    n = max(parallelism(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that a query writes and reads again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"
