"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``, a node's root being the least node it reaches.

    Each round connects larger neighbours, then smaller ones, to a node's least neighbour; rounds are logarithmic in
    the longest path. Least neighbours are aggregates, so a node with many links is no group of its own; the links
    pass from round to round through written tables.
    """
    known = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    known, seen = save(known, "links"), None
    while True:
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return known.select("u", "v").union(known.select("v", "v").distinct()).toDF("node", "root")
        seen = now
        both = known.select("u", "v").union(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        known = save(small.union(low).distinct(), "links")
