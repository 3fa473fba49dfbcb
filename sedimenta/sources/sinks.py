"""Sinks: JSON lines, single JSON documents, versions that replace a path, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import year_text


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def to_document(df: DataFrame, key: str, values: list[str], most: int = 100_000) -> str:
    """A small table as one JSON object by key, for reports of some rows a label; a table of
    more than `most` rows raises, none are left out."""
    rows = df.select(key, F.to_json(F.struct(*values)).alias("v")).orderBy(key).take(most + 1)
    if len(rows) > most:
        raise ValueError(f"one document holds at most {most} rows; write the table instead")
    return json.dumps({r[key]: json.loads(r["v"]) for r in rows}, ensure_ascii=False, indent=1)


def swap_in(df: DataFrame, path: str, dry_run: bool = False) -> str:
    """Write a new version beside a path of any file system and put it in its place, the old
    one kept as `.bak`; a dry run writes nothing."""
    if dry_run:
        return path
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at, new, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".bak"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").json(path + ".new")
    if fs.exists(at):
        fs.delete(old, True)
        fs.rename(at, old)
    if not fs.rename(new, at):
        raise OSError(f"{path}.new could not be put in place")
    return path


def manifest(emails: DataFrame, instant: str = "utc_us", sender: str = "from_email") -> DataFrame:
    """One row: messages, first and last instant in ISO 8601, counts by year (unknown without
    an instant) and the number of senders. An empty archive has no messages and no dates."""
    years = emails.groupBy(year_text(F.col(instant)).alias("y")).agg(F.count("*").alias("n"), F.min(instant).alias("a"), F.max(instant).alias("b"))
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = years.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), iso(F.min("a")).alias("first_date"), iso(F.max("b")).alias("last_date"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("y", "n")))).alias("by_year"))
    return one.join(F.broadcast(emails.agg(F.count_distinct(sender).alias("senders"))))  # one row


def with_corpus(manifest_: DataFrame, corpus: DataFrame) -> DataFrame:
    """A manifest with what a conversion wrote: files (name, sha256, size_bytes), their number
    and bytes."""
    files = corpus.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.sort_array(F.collect_list(F.struct("name", "sha256", "size_bytes"))).alias("parts"))  # a row a file
    return manifest_.join(F.broadcast(files)).withColumn("corpus", F.struct("files", "bytes", "parts")).drop("files", "bytes", "parts")
