"""Passages of longer texts: splitting, numbering, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import cut

_TRIM = r"^\s+|\s+$"


def split_passages(docs: DataFrame, id_: str, text: str, least: int = 30) -> DataFrame:
    """(id, pos, passage): paragraphs of more than `least` characters, numbered from 0 among
    those kept. All inside the row, nothing is shuffled."""
    t = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\r", "\n")
    parts = F.transform(F.split(t, r"\n\s*\n"), lambda p: F.regexp_replace(p, _TRIM, ""))
    kept = F.filter(parts, lambda p: F.length(p) > least)
    return docs.select(id_, F.posexplode(kept).alias("pos", "passage"))


def with_context(passages: DataFrame, id_: str, near: int = 200, first: int = 100) -> DataFrame:
    """passages with context: the one before if shorter than `near`, and its own first
    sentence if shorter than `first`, joined by a bar."""
    before = F.lag("passage").over(Window.partitionBy(id_).orderBy("pos"))
    sentence = F.regexp_replace(F.substring_index("passage", ".", 1), _TRIM, "")
    parts = F.array(F.when(F.length(before) < near, before), F.when(F.length(sentence) < first, sentence))
    return passages.withColumn("context", F.array_join(F.array_compact(parts), " | "))


def global_numbers(df: DataFrame, order: list[Column | str], name: str = "no") -> DataFrame:
    """df with consecutive numbers from 1 in a total order. Rows are cut into ranges; each
    range is numbered by itself and moved by the rows of the ranges before it."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def running_total(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """df with the sum of a value up to each row of a total order, added up within ranges of
    the order and moved by the ranges before."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row a range
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def passage_ids(passages: DataFrame, id_: str) -> DataFrame:
    """passages with passage_id `source-001`, counted over all files, never cut off."""
    return global_numbers(passages, [id_, "pos"]).withColumn("passage_id", F.format_string("source-%03d", "no")).drop("no")
