"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than this share of the rows on the left, and at least so many.
HOT_SHARE, HOT_ROWS = 0.005, 10_000


def dealt_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined to right on a key. The left rows of a hot key are dealt to several parts,
    to each of which its right rows go; no task gets them all. Null keys match nothing.
    Inner and left joins, as right rows may stand in several parts."""
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be dealt")
    counts = left.select(key).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    bound = max(HOT_ROWS, int(HOT_SHARE * left.count()))
    hot = counts.filter(F.col("__n") > bound).select(F.col(key).alias("__hot"), F.ceil(F.col("__n") / bound).cast("int").alias("__parts"))
    hot = F.broadcast(hot)  # at most 1 / HOT_SHARE rows
    cold = F.coalesce("__parts", F.lit(1))
    a = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), cold).cast("int")).drop("__hot", "__parts")
    b = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), cold - 1))).drop("__hot", "__parts")
    return a.join(b, [key, "__part"], how).drop("__part")
