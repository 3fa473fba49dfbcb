"""Mails from whatever holds them, without those done or skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.operators.moves import to_do
from sedimenta.sources import jsonl, mail

CORPUS = "message_id string, from_name string, from_email string, date string, subject string, in_reply_to string, body string, to string, cc string"


def read_emails(spark: SparkSession, path: str, done: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """Mails of a .jsonl, .parquet or mbox path; done and skip are tables of keys."""
    if path.endswith((".jsonl", ".json")):
        e = jsonl.read_lenient(spark, path, CORPUS).filter("corrupt is null").drop("corrupt").withColumnsRenamed({"to": "to_addrs", "cc": "cc_addrs"})
    elif path.endswith(".parquet"):
        e = spark.read.parquet(path)
    else:
        e = mail.parsed(mail.read_mbox(spark, path))
    e = e.filter("coalesce(trim(message_id), '') <> ''")
    keys = [k.withColumnRenamed(k.columns[0], "message_id") for k in (done, skip) if k is not None]
    return to_do(e, "message_id", *keys)


def append_keys(keys: DataFrame, path: str) -> None:
    """Add keys to a key table, each once and in order; what was there stays."""
    keys.distinct().orderBy(keys.columns[0]).write.mode("append").text(path)
