"""Form fields under the roots of a field tree, by levels in place of one recursive query.

A recursive query has row and depth limits in Spark, and lists the whole way to every
field. Here a level is a job, and a way is kept only where it matters: a field that lies
on no cycle can't be entered twice, so nothing is remembered for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.streaming.resume import shared


class _Levels:
    """Tables written one after the other to a folder of the shared folder, which ends with the application."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.n = df.sparkSession, 0
        self.base = shared(self.spark, name)
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)

    def put(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _cyclic(edges: DataFrame, levels: _Levels) -> DataFrame:
    """The fields on cycles, or between cycles: what is left when edges from fields without
    a parent and edges to fields without a kid are dropped until none is."""
    left, n = edges.select("parent", "kid"), edges.count()
    while n:
        parents, kids = left.select(F.col("parent").alias("kid")).distinct(), left.select(F.col("kid").alias("parent")).distinct()
        left = levels.put(left.join(parents, "kid", "left_semi").join(kids, "parent", "left_semi").select("parent", "kid"))
        before, n = n, left.count()
        if n == before:
            break
    return left.select(F.explode(F.array("parent", "kid")).alias("kid")).distinct()


def field_count(field_edges: DataFrame) -> DataFrame:
    """Fields with an own or inherited type under each root, by walks that never enter a field twice.

    Of the same results as the rule's SQL, for every number of rows and levels. ``seen`` has the
    fields of a walk that a later step could enter again: those on cycles."""
    levels = _Levels(field_edges, "fields")
    typed = F.col("field_type").isNotNull()
    edges = field_edges.where("parent <> kid").groupBy("parent", "kid").agg(F.max(typed).alias("typed"))
    edges = levels.put(edges)
    cyclic = levels.put(_cyclic(edges, levels)).withColumn("cyclic", F.lit(True))
    edges = levels.put(edges.join(cyclic, "kid", "left").select("parent", "kid", "typed", F.coalesce("cyclic", F.lit(False)).alias("cyclic")))

    start = field_edges.where("parent = 'root'").groupBy(F.col("kid").alias("root")).agg(F.max(typed).alias("has_type"))
    start = start.join(cyclic.withColumnRenamed("kid", "root"), "root", "left")
    level = levels.put(start.select("root", F.col("root").alias("at"), "has_type", F.filter(F.array("root"), lambda _: F.coalesce("cyclic", F.lit(False))).alias("seen")))
    walk = level
    while not level.isEmpty():
        step = level.join(edges, F.col("at") == F.col("parent")).where(~F.expr("array_contains(seen, kid)"))
        seen = F.filter(F.array_sort(F.array_append("seen", F.col("kid"))), lambda _: F.col("cyclic"))
        level = levels.put(step.select("root", F.col("kid").alias("at"), (F.col("has_type") | F.col("typed")).alias("has_type"), seen.alias("seen")).distinct())
        walk = walk.union(level)
    found = walk.groupBy("root", "at").agg(F.max("has_type").alias("has_type"))
    return found.groupBy("root").agg(F.count("at").alias("visited"), F.count_if(F.col("has_type") & F.col("at").isNotNull()).alias("field_count"))
