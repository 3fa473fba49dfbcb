"""JSON lines, strict or lenient, JSON arrays, and key lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_RECORD = "skipped_ids array<string>, skipped_passages array<string>, email_message_id string, passage_id string"


def read_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of a fixed schema; a malformed line or a key that the schema lacks fails the read.
    Blank lines are skipped."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    extra = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(f.name) for f in kind.fields]))
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(extra, ", "))).cast("string")).otherwise(F.col("value"))
    return spark.read.text(path).filter(F.trim("value") != "").select(F.from_json(checked, kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def unknown_keys(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """(value, key) of top-level keys that a schema doesn't have."""
    keys = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, known)))
    return spark.read.text(path).filter(F.trim("value") != "").select("value", F.explode(keys).alias("key"))


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with a column `corrupt` that holds malformed lines; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, corrupt string", {"columnNameOfCorruptRecord": "corrupt"}).alias("r"))
    return parsed.select("r.*")


def read_array(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Elements of files that each hold one JSON array."""
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key) of a file of keys in any of its forms: plain lines, JSON strings, records with a
    key, records with a list."""
    v = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''")
    rec = F.from_json(F.when(F.startswith("v", F.lit("{")), F.col("v")), KEY_RECORD)
    text = F.get_json_object(F.concat(F.lit('{"k":'), F.when(F.startswith("v", F.lit('"')), F.col("v")), F.lit("}")), "$.k")
    plain = F.when(~F.col("v").rlike(r'^[\[{"]'), F.col("v"))
    lists = F.flatten(F.array_compact(F.array(rec["skipped_ids"], rec["skipped_passages"], F.array_compact(F.array(rec["email_message_id"], rec["passage_id"], text, plain)))))
    return v.select(F.explode(lists).alias("key")).distinct()


def keys_before_corrupt(lines: DataFrame) -> DataFrame:
    """(key) of lines (line_no, value) of JSON strings up to the first that isn't one, which
    an interrupted write leaves behind."""
    key = F.get_json_object(F.concat(F.lit('{"k":'), F.col("value"), F.lit("}")), "$.k")
    ok = F.col("value").rlike(r'^\s*".*"\s*$') & key.isNotNull()
    v = lines.filter(F.trim("value") != "").select("line_no", key.alias("key"), ok.alias("ok"))
    first = v.filter("not ok").agg(F.min("line_no").alias("stop"))
    return v.join(F.broadcast(first)).filter("stop is null or line_no < stop").select("key").distinct()  # one row
