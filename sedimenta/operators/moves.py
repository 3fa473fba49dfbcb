"""Nested and flat moves: flattening, canonical labels, migration, keys done and to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["trigger", "principle", "response", "severity", "category"]
SCHEMA = "email_message_id string, email_date string, email_subject string, moves array<struct<trigger:string,principle:string,response:string,quote:string,severity:string,category:string>>, error string"


#: Moves that one record holds at most; longer digests take several records.
RECORD_MOVES = 100


def nest(moves: DataFrame, key: str = "email_message_id", order: str = "move_id") -> DataFrame:
    """(key, part, first, moves): records of at most RECORD_MOVES ids with their moves in
    order, so that a digest that holds a share of the corpus is many records. first is the
    position, among all moves of the key, of the record's first one."""
    part = F.floor(F.col(order) / RECORD_MOVES).alias("part")
    records = moves.groupBy(key, part).agg(F.sort_array(F.collect_list(F.struct(order, *FIELDS))).alias("moves"))
    # a row a record passes through the sum, without its moves
    sizes = moves.groupBy(F.col(key).alias("__key"), part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("__key", "__part", F.coalesce(before, F.lit(0)).cast("int").alias("first"))
    return records.join(first, F.col(key).eqNullSafe(F.col("__key")) & (F.col("part") == F.col("__part"))).select(key, "part", "first", "moves")


def flatten(records: DataFrame, keys: list[str], lenient: bool = True, source: str | None = None) -> DataFrame:
    """One row for each move. Lenient: fields that a record lacks are null and a quote stands
    in for a missing response. Strict: rows with a null field raise."""
    kinds = {f.name for f in records.schema["moves"].dataType.elementType.fields}
    first = F.col("first") if "first" in records.columns else F.lit(0)
    m = records.select(*keys, first.alias("__first"), F.posexplode("moves").alias("__pos", "m")).withColumn("move_no", F.col("__first") + F.col("__pos"))
    get = lambda f: F.col(f"m.{f}") if f in kinds else F.lit(None).cast("string")
    cols = {f: get(f) for f in FIELDS}
    if lenient:
        cols["response"] = F.coalesce(cols["response"], get("quote"))
    else:
        for f in FIELDS:
            cols[f] = F.when(cols[f].isNull(), F.raise_error(F.lit(f"move without {f}")).cast("string")).otherwise(cols[f])
    out = m.select(*keys, "move_no", *[c.alias(f) for f, c in cols.items()])
    return out.withColumn("source", F.lit(source)) if source else out


def canonicalise(moves: DataFrame, category: Column, severity: Column, keep_unknown: bool = False) -> DataFrame:
    """moves with canonical labels; rows without one are dropped unless kept as null."""
    m = moves.withColumn("__c", category).withColumn("__s", severity)
    if not keep_unknown:
        m = m.filter("__c is not null and __s is not null")
    return m.withColumn("category", F.col("__c")).withColumn("severity", F.col("__s")).drop("__c", "__s")


def migrate(records: DataFrame, remap: dict[str, str], fixes: dict[tuple[str, int], str] | None = None, key: str = "email_message_id") -> DataFrame:
    """Records with categories renamed inside their moves and the number of moves changed.
    fixes name the category of a move by record key and position among the key's moves."""
    first = F.col("first") if "first" in records.columns else F.lit(0)
    pairs = F.create_map(*[F.lit(x) for kv in remap.items() for x in kv])
    fixed = F.create_map(*[F.lit(x) for (k, i), v in (fixes or {("", -1): ""}).items() for x in (f"{k}#{i}", v)])

    def one(m: Column, i: Column) -> Column:
        to = F.coalesce(F.try_element_at(fixed, F.concat(F.col(key), F.lit("#"), (first + i).cast("string"))), F.try_element_at(pairs, m["category"]), m["category"])
        return m.withField("category", to)

    new = F.transform("moves", one)
    changed = F.size(F.filter(F.arrays_zip(F.transform("moves", lambda m: m["category"]).alias("a"), F.transform(new, lambda m: m["category"]).alias("b")), lambda z: ~z["a"].eqNullSafe(z["b"])))
    return records.withColumn("changed", changed).withColumn("moves", new)


def to_do(rows: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """rows whose key none of the done tables (each with that column) holds."""
    for d in done:
        rows = rows.join(d.select(key).distinct(), key, "left_anti")
    return rows


def skip_keys(records: DataFrame, key: str) -> DataFrame:
    """Keys of records that came back empty and without error: not to be asked again."""
    return records.filter(F.col("error").isNull() & (F.coalesce(F.size("moves"), F.lit(0)) <= 0)).select(key).distinct()


def done_keys(records: DataFrame, key: str) -> DataFrame:
    """Keys of records without error; those with one are tried again."""
    return records.filter(F.col("error").isNull()).select(key).distinct()
