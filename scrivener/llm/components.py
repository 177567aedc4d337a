"""Connected components over edge tables by alternating large and small stars.

Every round writes its edges to the shared folder and removes the round before; nothing but two numbers a round
comes to the driver. A star's centre may have any number of neighbours: minima are aggregated before the shuffle, and
in tables of over SPLIT edges the rows of a large star are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import Written, dealt, hot_keys

SPLIT = 100_000


def _centred(e: DataFrame, split: bool) -> tuple[DataFrame, DataFrame]:
    """(u, v, m) with the least neighbour of u, and those alone."""
    m = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if not split:
        return e.join(m.drop("n"), "u"), m
    hot = hot_keys(m, "u")
    return dealt(e, hot, "u", F.xxhash64("v")).join(dealt(m.drop("n"), hot, "u"), ["u", "salt"]), m


def _large(e: DataFrame, split: bool) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _centred(both, split)[0].withColumn("m", F.least("u", "m"))
    return near.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame, split: bool) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    near, m = _centred(down, split)
    moved = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v): label is the least node that can be reached."""
    now = Written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(now.df)
    while was[0]:
        after = Written(_small(_large(now.df, split := was[0] > SPLIT), split), "edges")
        now.drop()
        now, old, was = after, was, mark(after.df)
        if was == old:
            break
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
