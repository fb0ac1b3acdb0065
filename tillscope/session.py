"""Session construction and the helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings a session of our own starts with. A session that the caller built is never changed.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "tillscope", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword arguments use ``__`` for dots."""
    b = SparkSession.builder.appName(app).master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset on one machine (tests) a folder of our own.

    A cluster must name one: a folder of one machine is none of the others'.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tillscope-checkpoints"))
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from what was written (survives the loss of executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder, and the table's path.

    Like ``cut``, but the size that the optimizer takes it for is that of the table. What ``cut`` gives keeps the estimate,
    and a loop of joins multiplies estimates until they have millions of digits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(done: DataFrame | str) -> None:
    """Delete what ``cut`` or ``stored`` wrote, which must not be used any more. Spark deletes other checkpoints when they are collected."""
    spark = SparkSession.active()
    if not isinstance(done, str):
        file = done._jdf.logicalPlan().rdd().getCheckpointFile()
        if file.isEmpty():
            return
        done = file.get()
    path = spark._jvm.org.apache.hadoop.fs.Path(done)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_side(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` and whether it has at most ``max_rows`` rows; with a broadcast hint only if so."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if few else df), few


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, computed once: a generator keeps the optimizer from pasting them into every later use."""
    return df.withColumn("_staged", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))).select(*df.columns, "_staged.*")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside the functions of arrays."""
    return F.get(F.transform(F.array(value), use), 0)


def lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
