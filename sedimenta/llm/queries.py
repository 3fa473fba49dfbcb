"""Queries over texts of the mail archive and the documents, and samples by target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import allocation, encoding, garble, packing, personal, quotes, sentences
from sedimenta.operators.repeats import drop_repeats
from sedimenta.plans.core_queries import FIRST_MOVES, moves_source
from sedimenta.plans.registry import Registry
from sedimenta.session import table

registry = Registry()


def _label_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g')"


_SUPPLY = f"""{FIRST_MOVES},
targets as (select t.*, (select count(*) from kept m where {_label_sql("m.category")} = {_label_sql("t.category")} and {_label_sql("m.severity")} = {_label_sql("t.severity")}) as supply from sample_targets t)"""


#: The same quotas as SQL for two levels, what the operator's report is compared with.
_QUOTAS = """
with want as (
  select category, severity, supply, min_rows, greatest(cast(min_rows as double), target_share * sample_rows) as target,
         cast(sample_rows as bigint) as n, cast(greatest(cast(min_rows as bigint), cast(floor(target_share * sample_rows) as bigint)) as bigint) as base,
         target_share * sample_rows - floor(target_share * sample_rows) as part
  from targets),
level0 as (
  select *, n - sum(base) over () as rest, base - cast(min_rows as bigint) as slack,
         row_number() over (order by part desc, category, severity) as place,
         sum(base - cast(min_rows as bigint)) over () as slacks,
         sum(base - cast(min_rows as bigint)) over (order by category, severity rows unbounded preceding) as slack_to
  from want),
quota as (
  select category, severity, supply, target,
         cast(case when rest >= 0 then base + floor(rest / count(*) over ()) + case when place <= rest - floor(rest / count(*) over ()) * count(*) over () then 1 else 0 end
                   when slacks = 0 then base
                   else base - (floor(least(-rest, slacks) * slack_to / slacks) - floor(least(-rest, slacks) * (slack_to - slack) / slacks)) end as bigint) as quota
  from level0),
own as (
  select *, greatest(0, quota - supply) as unmet, greatest(0, supply - quota) as spare from quota),
sib as (
  select *, sum(unmet) over (partition by category) as cat_unmet, sum(spare) over (partition by category) as cat_spare,
         sum(spare) over (partition by category order by severity rows unbounded preceding) as spare_to from own),
sib2 as (
  select *, case when cat_spare = 0 then 0 else
         cast(floor(least(cat_unmet, cat_spare) * spare_to / cat_spare) - floor(least(cat_unmet, cat_spare) * (spare_to - spare) / cat_spare) as bigint) end as from_siblings,
         case when row_number() over (partition by category order by severity) = 1 then greatest(0, cat_unmet - cat_spare) else 0 end as up
  from sib),
cous as (
  select *, sum(up) over () as all_up, spare - from_siblings as spare2, sum(spare - from_siblings) over () as all_spare,
         sum(spare - from_siblings) over (order by category, severity rows unbounded preceding) as spare2_to from sib2)
select category, severity, target, cast(supply as bigint) as supply, cast(quota as bigint) as quota, cast(unmet as bigint) as unmet,
       cast(from_siblings as bigint) as from_siblings,
       cast(case when all_spare = 0 then 0 else
         floor(least(all_up, all_spare) * spare2_to / all_spare) - floor(least(all_up, all_spare) * (spare2_to - spare2) / all_spare) end as bigint) as from_cousins
from cous
"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(spark, moves_source(sf_dir)).select("move_id", "category", "severity")


@registry.query("p3_found", f"with {_SUPPLY} select category, severity from targets where supply < greatest(cast(min_rows as double), target_share * sample_rows)")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.unmet_targets(p3_report(spark, sf_dir))


@registry.query("p3_report", f"with {_SUPPLY}, {_QUOTAS.strip()[5:]}")
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.quotas(allocation.supplied(_moves(spark, sf_dir), table(spark, sf_dir, "sample_targets")))


@registry.query("p3_sample", f"""
with {_SUPPLY}, plan as (with {_QUOTAS.strip()[5:]})
select category, severity, move_id from (
  select p.category, p.severity, m.move_id, least(p.supply, p.quota - p.unmet + p.from_siblings + p.from_cousins) as take,
         row_number() over (partition by p.category, p.severity order by md5('{allocation.SEED}|' || cast(m.move_id as varchar)), m.move_id) as rn
  from plan p join kept m on {_label_sql("m.category")} = {_label_sql("p.category")} and {_label_sql("m.severity")} = {_label_sql("p.severity")}) where rn <= take
""")
def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.proportional_sample(_moves(spark, sf_dir), table(spark, sf_dir, "sample_targets"), "move_id")[0]


@registry.query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_restored(spark, sf_dir).select("delivery_id", "field")


@registry.query("p1_restored")
def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.restore(table(spark, sf_dir, "emails"), "delivery_id", ["subject", "body"])


@registry.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.find_old_lines(table(spark, sf_dir, "emails"))


@registry.query("p5_new_text")
def p5_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.new_text(table(spark, sf_dir, "emails"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "emails").select(F.lit("emails").alias("tab"), F.col("delivery_id").alias("row_id"), F.col("body").alias("text"))
    m = table(spark, sf_dir, "review_moves").select(F.lit("review_moves").alias("tab"), F.col("move_id").alias("row_id"), F.col("response").alias("text"))
    return e.unionByName(m)


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "emails"), table(spark, sf_dir, "known_names")


@registry.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_mentions(_texts(spark, sf_dir), *_names(spark, sf_dir)).select("tab", "row_id", "kind", "start_pos")


@registry.query("p6_replaced")
def p6_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.replace(_texts(spark, sf_dir), *_names(spark, sf_dir))


@registry.query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(encoding.encode(table(spark, sf_dir, "documents"), only_lengths=True), table(spark, sf_dir, "pack_capacities"))


@registry.query("p8_placed")
def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


@registry.query("p8_report")
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_packed(spark, sf_dir), table(spark, sf_dir, "pack_capacities"))


@registry.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.find_sentences(table(spark, sf_dir, "documents"))


@registry.query("p9_sentences")
def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.find_sentences(table(spark, sf_dir, "documents"), with_text=True)
