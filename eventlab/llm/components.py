"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlab.sources.files import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): the smallest id reachable.
    Each round is written; the loop ends when no id stands on both sides, so that
    every component is one star, which takes about the logarithm of the longest
    path."""
    now = stage(links.where("a <> b"), "links")
    while not now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() or _repeated(now):
        now = stage(_small_star(_large_star(now)), "links")
    own = now.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("label"))
    return stage(own.unionByName(now.select(F.col("b").alias("id"), F.col("a").alias("label"))).distinct(), "component-labels")


def _repeated(links: DataFrame) -> bool:
    """Whether an id hangs on two others, or on a larger one."""
    per = links.groupBy("b").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    return not per.where("lo <> hi or lo > b").isEmpty()
