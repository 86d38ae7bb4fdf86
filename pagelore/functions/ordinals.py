"""Row numbers within a key that no single task has to count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = 4096


def ordinal(df: DataFrame, key: str, order: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... within ``key`` by the integer column ``order``.

    Rows are numbered within (key, order div bucket) and shifted by the counts of the
    buckets before, so a key with a third of all rows is numbered by many tasks."""
    d = df.withColumn("__b", F.expr(f"{order} div {bucket}"))
    counts = d.groupBy(key, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col(key).alias("__k"), F.col("__b").alias("__bb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    within = d.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__b").orderBy(order)))
    joined = within.join(shift, within[key].eqNullSafe(F.col("__k")) & within["__b"].eqNullSafe(F.col("__bb")))
    return joined.withColumn(out, (F.col("__r") + F.col("__s")).cast("long")).drop("__b", "__k", "__bb", "__s", "__r")
