"""Queries over the mail archive: repeats and instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.keys import message_key
from sedimenta.operators import instants, repeats
from sedimenta.plans.instant_sql import instants as instants_sql
from sedimenta.plans.registry import Registry
from sedimenta.session import ship, table

registry = Registry()


def emails_source(sf_dir: str) -> repeats.Source:
    return repeats.Source("emails", f"{sf_dir}/emails.parquet", (message_key(F.col("message_id")),), F.col("delivery_id"))


def moves_source(sf_dir: str) -> repeats.Source:
    return repeats.Source("review_moves", f"{sf_dir}/review_moves.parquet", (message_key(F.col("email_message_id")), F.col("move_no")), F.col("move_id"))


def _key_sql(c: str) -> str:
    bare = rf"regexp_replace({c}, '^[\s<>]+|[\s<>]+$', '', 'g')"
    return f"case when {bare} = '' then null when contains({bare}, '@') then regexp_extract({bare}, '^(.*)@', 1) || '@' || lower(regexp_extract({bare}, '@([^@]*)$', 1)) else {bare} end"


FIRST_MOVES = f"""kept as (select * from (select *, {_key_sql("email_message_id")} as k,
    row_number() over (partition by {_key_sql("email_message_id")}, move_no order by move_id) as rn from review_moves) where k is null or move_no is null or rn = 1)"""

@registry.query("p2_found", f"""
select 'emails' as tab, delivery_id as row_id from (select delivery_id, k, row_number() over (partition by k order by delivery_id) as rn from (select delivery_id, {_key_sql("message_id")} as k from emails)) where k is not null and rn > 1
union all
select 'review_moves' as tab, move_id as row_id from (select move_id, k, move_no, row_number() over (partition by k, move_no order by move_id) as rn from (select move_id, move_no, {_key_sql("email_message_id")} as k from review_moves)) where k is not null and move_no is not null and rn > 1
""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(spark, [emails_source(sf_dir), moves_source(sf_dir)])


@registry.query("p2_kept_emails", f"""
select * exclude (k, rn) replace (epoch_us(received_at) as received_at) from (select *, {_key_sql("message_id")} as k, row_number() over (partition by {_key_sql("message_id")} order by delivery_id) as rn from emails) where k is null or rn = 1
""")
def p2_kept_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(spark, emails_source(sf_dir)).withColumn("received_at", F.unix_micros("received_at"))


@registry.query("p2_kept_moves", f"with {FIRST_MOVES} select * exclude (k, rn) replace (epoch_us(extracted_at) as extracted_at) from kept")
def p2_kept_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(spark, moves_source(sf_dir)).withColumn("extracted_at", F.unix_micros("extracted_at"))


_DATES = "select 'emails' as tab, delivery_id as id, date as dt, tz_name as tz from emails union all select 'review_moves', move_id, email_date, tz_name from review_moves"


@registry.query("p4_found", f"with {instants_sql(_DATES, keep='tab, id')} select tab, id as row_id, (utc_us - ((utc_us % 1000) + 1000) % 1000) // 1000 as utc_ms from inst where utc_us is not null")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    e = table(spark, sf_dir, "emails").select(F.lit("emails").alias("tab"), F.col("delivery_id").alias("row_id"), "date", "tz_name")
    m = table(spark, sf_dir, "review_moves").select(F.lit("review_moves").alias("tab"), F.col("move_id").alias("row_id"), F.col("email_date").alias("date"), "tz_name")
    t = instants.to_utc(e.unionByName(m), "date", "tz_name")
    return t.filter("utc_us is not null").select("tab", "row_id", F.expr("(utc_us - pmod(utc_us, 1000)) div 1000").alias("utc_ms"))
