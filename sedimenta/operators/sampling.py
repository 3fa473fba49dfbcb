"""Deterministic samples. Rows are ordered by the md5 of seed and id, which does not depend
on partitioning or engine. A constant number per group lets Spark keep only that many rows
of a group in each task before any shuffle; where the number depends on the group's size,
rows are counted by ranges of the order first, so that no group is ranked as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "42"


def order_key(id_: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), id_.cast("string")))


def first_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    rn = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("__rn", rn).filter(F.col("__rn") <= n).drop("__rn")


def first_share(df: DataFrame, groups: list[str], cut: Column, order: list[Column], share: float, least: int = 1) -> DataFrame:
    """The first share of each group, at least `least` rows. cut: a column that rises with
    the order and takes a bounded number of values; only rows of one value are ranked."""
    rows = df.withColumn("__cut", cut)
    counts = rows.groupBy(*groups, "__cut").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*groups)
    upto = F.sum("n").over(w.orderBy("__cut"))
    take = F.greatest(F.lit(least), F.floor(F.sum("n").over(w) * share))
    named = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]
    cuts = counts.select(*named, F.col("__cut").alias("__at"), upto.alias("__upto"), take.alias("__take"), (upto - F.col("n")).alias("__before")).filter("__before < __take")
    cond = F.col("__cut").eqNullSafe(F.col("__at"))
    for i, g in enumerate(groups):
        cond &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    j = rows.join(cuts, cond).select(*df.columns, "__cut", "__upto", "__take", "__before")
    whole = j.filter("__upto <= __take").select(*df.columns)
    edge = j.filter("__upto > __take")
    rn = F.row_number().over(Window.partitionBy(*groups, "__cut").orderBy(*order))
    return whole.unionByName(edge.withColumn("__rn", rn).filter("__rn <= __take - __before").select(*df.columns))


def substantive_half(moves: DataFrame, group: str, text: str, id_: str, share: float = 0.5) -> DataFrame:
    """The longer half of each group's rows by text length, equal lengths by id."""
    n = F.coalesce(F.length(text), F.lit(0))
    return first_share(moves, [group], -n, [F.col(id_)], share)


def stratified(df: DataFrame, group: str, strata: list[str], id_: str, n: int, seed: str = SEED) -> DataFrame:
    """n rows of each group, spread evenly over its strata: an equal number of each stratum
    first, the rest from all in hash order. Groups of up to n rows are whole."""
    h = df.withColumn("__h", order_key(F.col(id_), seed))
    # no row behind the n-th of its stratum can be drawn
    near = first_per_group(h, [group, *strata], [F.col("__h"), F.col(id_)], n)
    rn = F.row_number().over(Window.partitionBy(group, *strata).orderBy("__h", id_))
    near = near.withColumn("__rn", rn)
    buckets = near.select(group, *strata).distinct().groupBy(group).agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.count("*"))).alias("__k"))
    buckets = buckets.withColumnRenamed(group, "__g")
    j = near.join(buckets, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    pick = F.row_number().over(Window.partitionBy(group).orderBy(F.when(F.col("__rn") <= F.col("__k"), 0).otherwise(1), "__h", id_))
    return j.withColumn("__pick", pick).filter(F.col("__pick") <= n).select(*df.columns)


def balanced(df: DataFrame, group: str, source: str, rare: str, id_: str, n: int, seed: str = SEED) -> DataFrame:
    """n rows of each group from two sources: half, rounded up, of the rare one as far as it
    has them, the rest of the other, shortfalls filled from what is left."""
    h = df.withColumn("__h", order_key(F.col(id_), seed)).withColumn("__rare", F.col(source) == rare)
    near = first_per_group(h, [group, "__rare"], [F.col("__h"), F.col(id_)], n)
    rn = F.row_number().over(Window.partitionBy(group, "__rare").orderBy("__h", id_))
    have = F.sum(F.when(F.col("__rare"), 1).otherwise(0)).over(Window.partitionBy(group))
    near = near.withColumn("__rn", rn).withColumn("__have", have)
    quota = F.least("__have", F.lit(n // 2 + n % 2))
    near = near.withColumn("__quota", F.when(F.col("__rare"), quota).otherwise(n - quota))
    pick = F.row_number().over(Window.partitionBy(group).orderBy(F.when(F.col("__rn") <= F.col("__quota"), 0).otherwise(1), "__h", id_))
    return near.withColumn("__pick", pick).filter(F.col("__pick") <= n).select(*df.columns)


def longest_per_year(df: DataFrame, year: str, text: str, id_: str, n: int, seed: str = SEED) -> DataFrame:
    """n rows, each year in proportion (at least one), its longest texts first; a surplus is
    cut from the last years, a shortfall filled in hash order."""
    size = F.coalesce(F.length(text), F.lit(0))
    d = df.withColumn("__len", size).withColumn("__h", order_key(F.col(id_), seed))
    shares = d.groupBy(year).agg(F.count("*").alias("__c"))
    shares = shares.withColumn("__k", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("__c") / F.sum("__c").over(Window.partitionBy()))))  # one row a year
    near = first_per_group(d, [year], [F.desc("__len"), F.col(id_)], n)
    near = near.withColumn("__rn", F.row_number().over(Window.partitionBy(year).orderBy(F.desc("__len"), id_)))
    first = near.join(shares, year).filter(F.col("__rn") <= F.col("__k"))
    base = first.orderBy(year, "__rn").limit(n)
    picked = base.select(id_)
    fill = d.join(picked, id_, "left_anti").orderBy("__h", id_).limit(n).select(*df.columns, F.lit(1).alias("__late"), "__h")
    both = base.select(*df.columns, F.lit(0).alias("__late"), "__h").unionByName(fill)
    return both.orderBy("__late", "__h", id_).limit(n).select(*df.columns)
