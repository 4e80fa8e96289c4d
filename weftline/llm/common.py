"""Helpers shared by the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key of more rows than this, and than a thousandth of all rows, is joined by broadcast.
HOT_ROWS = 1_000
#: Rows of ids, hashes and numbers that a broadcast may hold; beyond it a join shuffles.
BROADCAST_ROWS = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets one of its own; a cluster must name it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        sc.setCheckpointDir(found)
    return str(found)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    It cuts lineage and survives lost executors, unlike cached blocks.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def prefix_sum(df: DataFrame, part: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``part`` that come before this row in ``order``, nulls last.

    Rows are dealt by ranges of (part, order), so a part that holds most rows spreads over many tasks and
    the order is the same at every size; only the ranges' totals meet in one window. Rows equal in
    ``order`` follow one another in any order, and may be dealt over several ranges. ``part`` columns
    must not be null; they may not be named _chunk, _value, _tie, _base or _within.
    """
    keys = [*part, *(F.col(c).asc_nulls_last() for c in order), "_tie"]
    marked = df.withColumn("_value", value.cast("long")).withColumn("_tie", F.monotonically_increasing_id())
    ranged = staged(marked.repartitionByRange(*keys).withColumn("_chunk", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*part, "_chunk").agg(F.sum("_value").alias("_total"))
    outer = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*part, "_chunk", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*part, "_chunk").orderBy(*keys[len(part) :]).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_within", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
        .join(bases, [*part, "_chunk"])
        .withColumn(out, (F.col("_base") + F.col("_within")).cast("long"))
        .drop("_chunk", "_value", "_tie", "_within", "_base")
    )


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined to the one row of ``keyed`` with its ``key``; ``count`` says how many of ``rows`` have that key and is dropped.

    Keys of more than HOT_ROWS rows and a thousandth of all are a thousand at most: they are broadcast,
    so their rows stay where they are, and only the rest is shuffled. ``keyed`` should be staged.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    most = max(HOT_ROWS, total // 1000)
    hot = keyed.where(F.col(count) > most).drop(count)
    if hot.isEmpty():
        return rows.join(keyed.drop(count), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(count) <= most).drop(count), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores after it until no column of ``df`` has that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def columns(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns by their very names, also those with dots."""
    return [df[f"`{c}`"] for c in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='weftline-')}/{package.name}", "zip", package.parent, package.name)
        sc.addPyFile(made)
        _shipped.add(sc.applicationId)
