"""Written intermediate tables, and connected components over them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.folders import fresh_folder


#: Rows of whole texts that go to a Python worker at once.
BATCH_ROWS = 500
#: Links that one task takes at least, if there are as many.
LINKS = 20_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are counted in rows; of whole texts, and of pairs of them, a few hundred fill one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame) -> DataFrame:
    """The rows of `df` from a new table in the shared folder: cuts the lineage and survives lost executors."""
    path = fresh_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A name made from `name` that no column has, whatever the case: for what is only used inside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, made: list[str], read: tuple[str, ...] = ()) -> DataFrame:
    """`df` without columns of the names that are about to be `made`, whatever the case; what is `read` can't be replaced."""
    names = {n.lower() for n in made}
    if clash := [c for c in read if c.lower() in names]:
        raise ValueError(f"read and made at once: {clash}")
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in names])


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by `written`, once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """Connected components: `vertex`, `component` (the least vertex) for every vertex in `links` (columns a, b).

    Alternates two steps until all links are stars: every vertex hands its least neighbour to its greater neighbours, then to its lesser
    ones. Each is a combined minimum and a join, so a vertex with very many links is split by the skew join. Rounds grow with the
    logarithm of the longest path. Few links are dealt to few tasks: the rounds are many and short.
    """
    ab = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    edges = written(ab.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    tasks = math.ceil(edges.count() / LINKS) or 1
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        # Below, every row points from a greater vertex to a lesser one.
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(tasks))
        drop(links.sparkSession, old)
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).coalesce(tasks).where("up > 1 or up + down > 1").count():
            break
    to = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return to.union(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
