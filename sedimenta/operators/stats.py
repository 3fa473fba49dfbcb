"""Conditional distributions and trends of labelled moves. Counts are summed before any
shuffle; what windows see are tables of categories, severities and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid(df: DataFrame, rows: str, columns: str, row_domain: list[str], column_domain: list[str]) -> DataFrame:
    """(rows, columns, cnt) of every pair of the two domains, zeros included."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(i, r, j, c) for i, r in enumerate(row_domain) for j, c in enumerate(column_domain)], f"row_ord int, {rows} string, column_ord int, {columns} string")
    n = df.groupBy(rows, columns).agg(F.count("*").alias("cnt"))
    return F.broadcast(cells).join(n, [rows, columns], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("bigint")))


def severity_by_category(df: DataFrame, categories: list[str], severities: list[str]) -> DataFrame:
    """For each category that occurs: total, share in percent of each severity, the dominant
    one (of equals the first in canonical order) and the rates of the first three."""
    g = grid(df, "category", "severity", categories, severities)
    per = [F.sum(F.when(F.col("severity") == s, F.col("cnt")).otherwise(0)).alias(s.replace("-", "_")) for s in severities]
    a = g.groupBy("category").agg(F.sum("cnt").alias("total"), F.max_by("severity", F.struct("cnt", -F.col("column_ord"))).alias("dominant_severity"), *per)
    pct = [F.round(100 * F.col(s.replace("-", "_")) / F.col("total"), 1).alias("pct_" + s.replace("-", "_")) for s in severities]
    return a.filter("total > 0").select("*", *pct)


def yearly_trends(df: DataFrame, year: str = "year", order: str = "move_id", reject: str = "reject") -> DataFrame:
    """For each year: total, share of rejects, and the most frequent category, of equals the
    one that occurs first."""
    d = df.filter(F.col(year).isNotNull())
    c = d.groupBy(year, "category").agg(F.count("*").alias("cnt"), F.min(order).alias("first"), F.sum(F.when(F.col("severity") == reject, 1).otherwise(0)).alias("rejects"))
    return c.groupBy(year).agg(F.sum("cnt").alias("total"), F.round(100 * F.sum("rejects") / F.sum("cnt"), 1).alias("reject_rate"), F.max_by("category", F.struct("cnt", -F.col("first"))).alias("top_category"))


def corpus_stats(df: DataFrame, severities: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """(what, label, cnt, pct): all rows, and shares of severities and categories; labels of the
    domains that don't occur have 0. An empty table gives no rows."""
    g = df.groupingSets([[], ["severity"], ["category"]], "severity", "category").agg(F.count("*").alias("cnt"), F.grouping_id().alias("gid"))
    what = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "severity").otherwise("category")
    n = g.select(what.alias("what"), F.when(F.col("gid") == 1, F.col("severity")).when(F.col("gid") == 2, F.col("category")).alias("label"), "cnt")
    domain = [("severity", x) for x in severities or []] + [("category", x) for x in categories or []]
    if domain:
        zeros = df.sparkSession.createDataFrame(domain, "what string, label string").withColumn("cnt", F.lit(0).cast("bigint"))
        n = n.unionByName(zeros).groupBy("what", "label").agg(F.sum("cnt").alias("cnt"))
    total = F.max(F.when(F.col("what") == "total", F.col("cnt"))).over(Window.partitionBy())  # one row a label
    return n.withColumn("__total", total).filter("__total > 0").select("what", "label", "cnt", F.round(100 * F.try_divide("cnt", "__total"), 1).alias("pct"))


#: Samples of words that hedge, that swear and that joke; a deployment has its own.
HEDGES, SWEARS, JOKES = r"(?i)\b(perhaps|maybe|might|unless)\b", r"(?i)\b(damn|hell|crap)\b", r"(?i)(\bjoking\b|\bkidding\b|:-\)|\bhaha)"


def voice(df: DataFrame, text: str, hedges: str = HEDGES, swears: str = SWEARS, jokes: str = JOKES) -> DataFrame:
    """How responses sound: mean words, and shares with hedging words, swear words, jokes, a
    question, a list mark at the beginning, and list lines among all lines."""
    from sedimenta.functions.text import lines, word_count

    t = F.coalesce(F.col(text), F.lit(""))
    share = lambda c, name: F.round(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), 1).alias(name)
    own = F.filter(lines(t), lambda x: F.trim(x) != "")
    bullets = F.filter(own, lambda x: x.rlike(r"^\s*[-*]"))
    return df.agg(
        F.round(F.avg(word_count(t)), 1).alias("mean_words"), share(t.rlike(hedges), "hedging_pct"), share(t.rlike(swears), "swearing_pct"), share(t.rlike(jokes), "humour_pct"), share(t.contains("?"), "question_pct"),
        share(t.rlike(r"^\s*[-*]"), "list_pct"), F.round(100 * F.try_divide(F.sum(F.size(bullets)), F.sum(F.size(own))), 1).alias("list_lines_pct"), F.count("*").alias("responses"),
    )


def hierarchy(df: DataFrame) -> DataFrame:
    """Categories ranked by their share of rejects."""
    a = df.groupBy("category").agg(F.count("*").alias("total"), F.round(100 * F.avg(F.when(F.col("severity") == "reject", 1.0).otherwise(0.0)), 1).alias("reject_rate"))
    return a.withColumn("place", F.row_number().over(Window.orderBy(F.desc("reject_rate"), "category")))  # one row a category
