"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.llm.scratch import discard, write_once


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two columns of longs); component is the smallest node reachable.

    Each round writes its links to the shared folder, so no lineage grows and a
    lost executor costs one round. A hub's neighbours are met by joins, which
    Spark may split, and by minima taken before the shuffle; they are never gathered.
    Null ends and loops are ignored; without links the result is empty.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    now = write_once(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, write_once(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(last)
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if state == seen:
            break
        seen = state
    # every remaining link leads to the root of its star
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.scratch = now.scratch
    return out
