"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; where none is set, one is made on a local master and any other is refused."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later uses don't repeat it and lost executors don't matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row (from 1) among those of its key, in an order. A key may be large: rows are sorted in ranges, and only the sizes of a key's ranges are summed up."""
    ranged = cut(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_range"), *(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.min("_id").alias("_start"), F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*(f"_by_{c}" for c in by)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before)
    same = part == F.col("_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    found = ranged.join(sizes, same).withColumn(name, F.col("_id") - F.col("_start") + 1 + F.col("_before"))
    return found.select(*df.columns, name)
