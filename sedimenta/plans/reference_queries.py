"""Queries for distilling a corpus of reviews: statistics, samples, text rules, checks,
matching of findings. Each with SQL that another engine runs on the same tables, where SQL
can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import labels, text
from sedimenta.functions.keys import message_key
from sedimenta.operators import documents, enrich, findings, instants, mappers, moves, passages, quality, sampling, stats
from sedimenta.operators.joins import dealt_join
from sedimenta.plans.core_queries import _key_sql
from sedimenta.plans.instant_sql import instants as instants_sql
from sedimenta.plans.registry import Registry
from sedimenta.session import cut, table

registry = Registry()
query = registry.query


def _case(column: str, pairs: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items()) + " end"


_C = _case("category", {**labels.CALIBRATION_CATEGORY, **{c: c for c in labels.CALIBRATED}})
_S = _case("severity", {**labels.CALIBRATION_SEVERITY, **{s: s for s in labels.SEVERITIES}})
CANON = f"canon as (select move_id, email_message_id, {_C} as category, {_S} as severity, trigger, principle, response from review_moves where {_C} is not null and {_S} is not null)"
_YEAR_SQL = "cast(year(make_timestamp(utc_us)) as int)"
#: canon with the year of each move's instant.
DATED = f"""{instants_sql("select move_id as id, email_date as dt, tz_name as tz from review_moves")},
undated as ({CANON[len("canon as ("):]},
canon as (select undated.*, {_YEAR_SQL} as year from undated join inst on inst.id = undated.move_id)"""
_MAILS = instants_sql("select delivery_id as id, date as dt, tz_name as tz from emails")


def canon(spark: SparkSession, sf_dir: str, dated: bool = False) -> DataFrame:
    """Moves with canonical labels; dated: with the year of the instant that their date states."""
    m = table(spark, sf_dir, "review_moves")
    c = moves.canonicalise(m, labels.canonical(F.col("category"), labels.CALIBRATED, labels.CALIBRATION_CATEGORY), labels.canonical(F.col("severity"), labels.SEVERITIES, labels.CALIBRATION_SEVERITY))
    year = []
    if dated:
        c = instants.to_utc(c, "email_date", "tz_name")
        year = [instants.year_of(F.col("utc_us")).alias("year")]
    return c.select("move_id", "email_message_id", "category", "severity", *year, "trigger", "principle", "response")


def dated_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails with the instant that their date states and its year as text, or unknown."""
    e = instants.to_utc(table(spark, sf_dir, "emails"), "date", "tz_name")
    return e.withColumn("year", text.year_text(F.col("utc_us")))


# Statistics

_SEV = [s.replace("-", "_") for s in labels.SEVERITIES]
_ORD = _case("severity", {s: str(i) for i, s in enumerate(labels.SEVERITIES)})


@query("severity_by_category", f"""
with {CANON}, c as (select category, severity, count(*) as cnt, cast({_ORD} as int) as ord from canon group by 1, 2),
t as (select category, cast(sum(cnt) as bigint) as total, arg_max(severity, row(cnt, -ord)) as dominant_severity,
  {", ".join(f"cast(coalesce(sum(case when severity = '{s}' then cnt end), 0) as bigint) as {n}" for s, n in zip(labels.SEVERITIES, _SEV, strict=True))} from c group by 1)
select *, {", ".join(f"round(100 * {n} / total, 1) as pct_{n}" for n in _SEV)} from t
""")
def severity_by_category(spark, sf_dir):  # noqa: ANN001, ANN201
    return stats.severity_by_category(canon(spark, sf_dir), labels.CALIBRATED, labels.SEVERITIES)


@query("zero_filled_grid", f"""
with {CANON}, a(category) as (values {", ".join(f"('{c}')" for c in labels.CALIBRATED)}), b(severity) as (values {", ".join(f"('{s}')" for s in labels.SEVERITIES)})
select a.category, b.severity, count(canon.move_id) as cnt from a cross join b left join canon on canon.category = a.category and canon.severity = b.severity group by 1, 2
""")
def zero_filled_grid(spark, sf_dir):  # noqa: ANN001, ANN201
    return stats.grid(canon(spark, sf_dir), "category", "severity", labels.CALIBRATED, labels.SEVERITIES).select("category", "severity", "cnt")


@query("temporal_trends", f"""
with {DATED}, c as (select year, category, count(*) as cnt, min(move_id) as f, count(*) filter (severity = 'reject') as r from canon where year is not null group by 1, 2)
select year, cast(sum(cnt) as bigint) as total, round(100 * sum(r) / sum(cnt), 1) as reject_rate, arg_max(category, row(cnt, -f)) as top_category from c group by 1
""")
def temporal_trends(spark, sf_dir):  # noqa: ANN001, ANN201
    return stats.yearly_trends(canon(spark, sf_dir, dated=True))


@query("year_range", f"with {DATED} select min(year) as first_year, max(year) as last_year, count(distinct year) as years from canon")
def year_range(spark, sf_dir):  # noqa: ANN001, ANN201
    return canon(spark, sf_dir, dated=True).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("years"))


@query("corpus_stats", f"""
with {CANON}, n as (select count(*) as total from canon),
d(what, label) as (values {", ".join([f"('severity', '{x}')" for x in labels.SEVERITIES] + [f"('category', '{x}')" for x in labels.CALIBRATED])}),
c as (select 'severity' as what, severity as label, count(*) as cnt from canon group by 2 union all select 'category', category, count(*) from canon group by 2)
select 'total' as what, null as label, total as cnt, 100.0 as pct from n
union all select d.what, d.label, coalesce(cnt, 0), round(100 * coalesce(cnt, 0) / total, 1) from d cross join n left join c on c.what = d.what and c.label = d.label
""")
def corpus_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return stats.corpus_stats(canon(spark, sf_dir), labels.SEVERITIES, labels.CALIBRATED)


@query("source_breakdown", "select coalesce(doc_kind, 'unknown') as source, count(*) as documents, count(distinct lang) as langs from documents group by 1")
def source_breakdown(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("doc_kind", F.lit("unknown")).alias("source")).agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("langs"))


@query("pattern_stats", """
select 'category' as what, coalesce(category, 'unknown') as label, count(*) as cnt from review_moves group by 2
union all select 'severity', coalesce(severity, 'unknown'), count(*) from review_moves group by 2
""")
def pattern_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    m = table(spark, sf_dir, "review_moves").select(F.coalesce("category", F.lit("unknown")).alias("c"), F.coalesce("severity", F.lit("unknown")).alias("s"))
    g = m.groupingSets([["c"], ["s"]], "c", "s").agg(F.count("*").alias("cnt"), F.grouping("c").alias("g"))
    return g.select(F.when(F.col("g") == 0, "category").otherwise("severity").alias("what"), F.coalesce("c", "s").alias("label"), "cnt")


@query("archive_integrity", f"""
with {_MAILS} select cast(count(*) filter (coalesce(trim(from_email), '') = '') as bigint) as missing_from, count(*) filter (utc_us is null) as missing_date, count(*) filter (coalesce(trim(message_id), '') = '') as missing_id,
  count(*) filter (not coalesce(ends_with(from_email, '.example'), false)) as other_authors, count(*) as messages from emails join inst on inst.id = delivery_id
""")
def archive_integrity(spark, sf_dir):  # noqa: ANN001, ANN201
    return quality.archive_integrity(dated_emails(spark, sf_dir), F.endswith("from_email", F.lit(".example")))


@query("manifest_by_year", f"with {_MAILS} select coalesce(cast({_YEAR_SQL} as varchar), 'unknown') as year, count(*) as messages from inst group by 1")
def manifest_by_year(spark, sf_dir):  # noqa: ANN001, ANN201
    return dated_emails(spark, sf_dir).groupBy("year").agg(F.count("*").alias("messages"))


@query("manifest_senders", "select from_email, count(*) as messages, left(cast(min(received_at) as varchar), 10) as first_day, left(cast(max(received_at) as varchar), 10) as last_day from emails where coalesce(from_email, '') <> '' group by 1 order by 2 desc, 1 limit 10")
def manifest_senders(spark, sf_dir):  # noqa: ANN001, ANN201
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    g = table(spark, sf_dir, "emails").filter("coalesce(from_email, '') <> ''").groupBy("from_email").agg(F.count("*").alias("messages"), day(F.min("received_at")).alias("first_day"), day(F.max("received_at")).alias("last_day"))
    return g.orderBy(F.desc("messages"), "from_email").limit(10)


@query("voice_metrics", r"""
with t as (select coalesce(response, '') as r from review_moves),
l as (select r, list_filter(string_split(r, chr(10)), lambda x: trim(x) <> '') as a from t)
select round(avg(len(list_filter(regexp_split_to_array(r, '\s+'), lambda w: w <> ''))), 1) as mean_words,
  round(100 * avg(case when regexp_matches(r, '(?i)\b(perhaps|maybe|might|unless)\b') then 1.0 else 0.0 end), 1) as hedging_pct,
  round(100 * avg(case when regexp_matches(r, '(?i)\b(damn|hell|crap)\b') then 1.0 else 0.0 end), 1) as swearing_pct, round(100 * avg(case when regexp_matches(r, '(?i)(\bjoking\b|\bkidding\b|:-\)|\bhaha)') then 1.0 else 0.0 end), 1) as humour_pct,
  round(100 * avg(case when contains(r, '?') then 1.0 else 0.0 end), 1) as question_pct, round(100 * avg(case when regexp_matches(r, '^\s*[-*]') then 1.0 else 0.0 end), 1) as list_pct,
  round(100 * sum(len(list_filter(a, lambda x: regexp_matches(x, '^\s*[-*]')))) / sum(len(a)), 1) as list_lines_pct, count(*) as responses from l
""")
def voice_metrics(spark, sf_dir):  # noqa: ANN001, ANN201
    return stats.voice(table(spark, sf_dir, "review_moves"), "response")


@query("hierarchy_ranking", f"""
with {CANON}, a as (select category, count(*) as total, round(100 * avg(case when severity = 'reject' then 1.0 else 0.0 end), 1) as reject_rate from canon group by 1)
select *, cast(row_number() over (order by reject_rate desc, category) as int) as place from a
""")
def hierarchy_ranking(spark, sf_dir):  # noqa: ANN001, ANN201
    return stats.hierarchy(canon(spark, sf_dir))


_VARIATION = f"v as (select {_key_sql('email_message_id')} as k, stakes, risk from variations)"


@query("tone_by_stakes", f"""
with {CANON}, {_VARIATION}, j as (select coalesce(nullif(v.stakes, ''), 'medium') as stakes, c.severity from canon c join v on v.k = {_key_sql('c.email_message_id')})
select stakes, severity, count(*) as cnt, round(100 * count(*) / sum(count(*)) over (partition by stakes), 1) as pct from j group by 1, 2
""")
def tone_by_stakes(spark, sf_dir):  # noqa: ANN001, ANN201
    v = table(spark, sf_dir, "variations").select(message_key(F.col("email_message_id")).alias("k"), F.coalesce(F.expr("nullif(stakes, '')"), F.lit("medium")).alias("stakes"))
    # counted before the join: a digest is one row for each severity
    m = canon(spark, sf_dir).groupBy(message_key(F.col("email_message_id")).alias("k"), "severity").agg(F.count("*").alias("n"))
    g = m.join(v, "k").groupBy("stakes", "severity").agg(F.sum("n").alias("cnt"))
    return g.withColumn("pct", F.round(100 * F.col("cnt") / F.sum("cnt").over(Window.partitionBy("stakes")), 1))


@query("enrichment_join", f"""
with {_VARIATION}, m as (select {_key_sql('email_message_id')} as k, move_id from review_moves)
select m.move_id, v.stakes, v.risk from m left join v on v.k = m.k
""")
def enrichment_join(spark, sf_dir):  # noqa: ANN001, ANN201
    v = table(spark, sf_dir, "variations").select(message_key(F.col("email_message_id")).alias("k"), "stakes", "risk")
    return dealt_join(table(spark, sf_dir, "review_moves").select(message_key(F.col("email_message_id")).alias("k"), "move_id"), v, "k", "left").select("move_id", "stakes", "risk")


# Samples

_HASH = "md5('42|' || cast({id} as varchar))"


@query("substantive_half", f"""
with {CANON}, r as (select category, move_id, row_number() over (partition by category order by coalesce(length(response), 0) desc, move_id) as rn, count(*) over (partition by category) as n from canon)
select category, move_id from r where rn <= greatest(1, floor(n * 0.5))
""")
def substantive_half(spark, sf_dir):  # noqa: ANN001, ANN201
    return sampling.substantive_half(canon(spark, sf_dir), "category", "response", "move_id").select("category", "move_id")


def _stratified_sql(source: str) -> str:
    return f"""b as (select *, {_HASH.format(id='move_id')} as h from {source}),
s as (select *, row_number() over (partition by category, year, severity order by h, move_id) as rn from b),
k as (select category, greatest(1, floor(25 / count(distinct (coalesce(year, -1), severity)))) as kk from b group by category),
o as (select s.*, row_number() over (partition by s.category order by case when rn <= kk then 0 else 1 end, h, move_id) as pick from s join k on s.category = k.category)
select category, year, severity, move_id from o where pick <= 25"""


@query("stratified_sample", f"with {DATED}, {_stratified_sql('canon')}")
def stratified_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    return sampling.stratified(canon(spark, sf_dir, dated=True), "category", ["year", "severity"], "move_id", 25).select("category", "year", "severity", "move_id")


@query("cluster_sample", f"""
with {DATED}, r as (select *, row_number() over (partition by category order by coalesce(length(response), 0) desc, move_id) as rn0, count(*) over (partition by category) as n from canon),
half as (select category, year, severity, move_id from r where rn0 <= greatest(1, floor(n * 0.5))), {_stratified_sql('half')}
""")
def cluster_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    half = sampling.substantive_half(canon(spark, sf_dir, dated=True), "category", "response", "move_id")
    return sampling.stratified(half, "category", ["year", "severity"], "move_id", 25).select("category", "year", "severity", "move_id")


@query("balanced_source_sample", f"""
with d as (select doc_id, coalesce(lang, 'unknown') as lang, doc_kind, {_HASH.format(id='doc_id')} as h from documents where doc_kind in ('mail', 'interview')),
r as (select *, row_number() over (partition by lang, doc_kind order by h, doc_id) as rn, sum(case when doc_kind = 'interview' then 1 else 0 end) over (partition by lang) as have from d),
q as (select *, case when doc_kind = 'interview' then least(have, 13) else 25 - least(have, 13) end as quota from r),
p as (select *, row_number() over (partition by lang order by case when rn <= quota then 0 else 1 end, h, doc_id) as pick from q)
select lang, doc_kind, doc_id from p where pick <= 25
""")
def balanced_source_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    d = table(spark, sf_dir, "documents").filter("doc_kind in ('mail', 'interview')").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), "doc_kind")
    return sampling.balanced(d, "lang", "doc_kind", "interview", "doc_id", 25).select("lang", "doc_kind", "doc_id")


@query("longest_per_year_sample", f"""
with {_MAILS}, e as (select delivery_id, coalesce(cast({_YEAR_SQL} as varchar), 'unknown') as year, coalesce(length(body), 0) as n, {_HASH.format(id='delivery_id')} as h from emails join inst on inst.id = delivery_id),
c as (select year, greatest(1, floor(500 * count(*) / sum(count(*)) over ())) as k from e group by 1),
r as (select e.*, row_number() over (partition by year order by n desc, delivery_id) as rn from e),
f as (select r.* from r join c on c.year = r.year where rn <= k order by year, rn limit 500),
x as (select delivery_id, year, 0 as late, h from f union all select * from (select delivery_id, year, 1, h from e where delivery_id not in (select delivery_id from f) order by h, delivery_id limit 500))
select delivery_id, year from x order by late, h, delivery_id limit 500
""")
def longest_per_year_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    e = dated_emails(spark, sf_dir).select("delivery_id", "year", "body")
    return sampling.longest_per_year(e, "year", "body", "delivery_id", 500).select("delivery_id", "year")


@query("head_sample", "select move_id, trigger from review_moves order by move_id limit 50")
def head_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "review_moves").select("move_id", "trigger").orderBy("move_id").limit(50)


@query("first_last_subjects", "select delivery_id, left(subject, 72) as subject from (select * from (select * from emails order by delivery_id limit 5) union all select * from (select * from emails order by delivery_id desc limit 3))")
def first_last_subjects(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "emails").select("delivery_id", F.left("subject", F.lit(72)).alias("subject"))
    return e.orderBy("delivery_id").limit(5).unionByName(e.orderBy(F.desc("delivery_id")).limit(3))


# Text rules

_TRIM = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query("clean_body", rf"""
with l as (select delivery_id, string_split(body, chr(10)) as a from emails where body is not null),
f as (select *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: not starts_with(a[i], '>'))), 1000000000) as first from l),
s as (select *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: (i > first and {_TRIM.format(c='a[i]')} = '--') or starts_with(a[i], repeat('_', 47)))), len(a) + 1) as stop from f)
select delivery_id, {_TRIM.format(c="regexp_replace(array_to_string(list_filter(a[1:stop - 1], lambda x: not starts_with(x, '>')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')".replace('{{', '{').replace('}}', '}'))} as body from s
""")
def clean_body(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "emails").filter("body is not null").select("delivery_id", text.clean_body(F.col("body")).alias("body"))


_REVIEW = rf"""
e as (select delivery_id, {_TRIM.format(c="coalesce(subject, '')")} as s, coalesce(in_reply_to, '') as r, {_TRIM.format(c="coalesce(body, '')")} as b from emails),
lab as (select delivery_id, (r <> '' or starts_with(lower(s), 're:') or regexp_matches(s, '(?i)\bpatch\b'))
  and not regexp_matches(s, '(?i)^(linux\s+\d|git\s+pull|pull\s+request|merge\s+(branch|tag))') and not regexp_matches(s, '(?i)\[git\s+pull\]') and not regexp_matches(s, '(?i)\[rfc\]') and not regexp_matches(s, '(?i)^(re:\s*)*\[patch')
  and length(b) >= 100 and len(list_filter(list_transform(string_split(b, chr(10)), lambda x: {_TRIM.format(c='x')}), lambda x: length(x) > 30 and not regexp_matches(x, '(?i)^({"|".join(labels.TRAILERS)}):'))) > 0 as review from e)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "emails").select("delivery_id", labels.is_review(F.col("subject"), F.col("in_reply_to"), F.col("body")).alias("review"))


@query("review_filter", f"with {_REVIEW} select delivery_id from lab where review")
def review_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    return _labelled(spark, sf_dir).filter("review").select("delivery_id")


@query("review_label_counts", f"with {_REVIEW} select case when review then 'review' else 'other' end as label, count(*) as cnt from lab group by 1")
def review_label_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return _labelled(spark, sf_dir).groupBy(F.when(F.col("review"), "review").otherwise("other").alias("label")).agg(F.count("*").alias("cnt"))


@query("thread_phase", r"""
select case when coalesce(in_reply_to, '') = '' then 'initial_review' when regexp_matches(subject, '(?i)\b(applied|merged|rejected|acked|pulled)\b') then 'final_decision' else 'iteration_n' end as phase, count(*) as cnt from emails group by 1
""")
def thread_phase(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "emails").groupBy(labels.thread_phase(F.col("subject"), F.col("in_reply_to")).alias("phase")).agg(F.count("*").alias("cnt"))


@query("urgency", r"""
select case when coalesce(regexp_matches(subject, '(?i)(-rc|merge\s+window|release\s+blocker|critical\s+fix)'), false) or coalesce(regexp_matches(date, '(?i)-rc\d'), false) then 'release_blocker' else 'routine' end as urgency, count(*) as cnt from emails group by 1
""")
def urgency(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "emails").groupBy(labels.urgency(F.col("subject"), F.col("date")).alias("urgency")).agg(F.count("*").alias("cnt"))


@query("word_count_filter", r"""
select delivery_id, cast(n as int) as n from (select delivery_id, len(list_filter(regexp_split_to_array(coalesce(body, ''), '[\s\p{Z}\x{85}]+'), lambda w: w <> '')) as n from emails where coalesce(message_id, '') <> '') where n >= 50
""")
def word_count_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "emails").filter("coalesce(message_id, '') <> ''")
    return e.select("delivery_id", text.word_count(F.coalesce("body", F.lit(""))).alias("n")).filter("n >= 50")


@query("year_extract", f"with {DATED} select id as move_id, coalesce(cast({_YEAR_SQL} as varchar), 'unknown') as year_text, {_YEAR_SQL} as year from inst")
def year_extract(spark, sf_dir):  # noqa: ANN001, ANN201
    m = instants.to_utc(table(spark, sf_dir, "review_moves"), "email_date", "tz_name")
    return m.select("move_id", text.year_text(F.col("utc_us")).alias("year_text"), instants.year_of(F.col("utc_us")).alias("year"))


@query("header_projection", """
with h as (select delivery_id, case when coalesce(trim(from_name), '') = '' then from_email else from_name || ' <' || from_email || '>' end as h from emails)
select delivery_id, h as header, case when contains(h, '<') then trim(replace(regexp_extract(h, '^(.*)<[^<]*$', 1), '"', '')) when h is null then '' else '' end as name,
  case when contains(h, '<') then rtrim(regexp_extract(h, '<([^<]*)$', 1), '> ') else trim(h) end as address from h
""")
def header_projection(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "emails").select("delivery_id", text.from_header(F.col("from_name"), F.col("from_email")).alias("header"))
    return e.select("delivery_id", "header", text.header_name(F.col("header")).alias("name"), text.header_address(F.col("header")).alias("address"))


_CHAIN = [("ring buffer", "circular buffer"), ("buffer", "store"), ("lock", "guard"), ("takes the guard", "holds the guard")]


def _chain_sql(c: str) -> str:
    for old, new in _CHAIN:
        c = f"replace({c}, '{old}', '{new}')"
    return c


@query("literal_replace_chain", f"select move_id, {_chain_sql('response')} as response from review_moves")
def literal_replace_chain(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "review_moves").select("move_id", text.replaced(F.col("response"), _CHAIN).alias("response"))


@query("plain_punctuation", "select doc_id, translate(text, '" + text.TYPOGRAPHIC + "', '" + text.ASCII.replace("'", "''") + "') as text from documents")
def plain_punctuation(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").select("doc_id", text.plain_punctuation(F.col("text")).alias("text"))


@query("display_truncation", "select delivery_id, case when length(subject) > 40 then left(subject, 40) || '...' else subject end as subject from emails")
def display_truncation(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "emails").select("delivery_id", text.truncated(F.col("subject"), 40).alias("subject"))


_STOP = ["the", "and", "for", "that", "this", "with", "not"]


@query("content_words", rf"""
with w as (select unnest(regexp_extract_all(lower(principle), '([a-z_]+)', 1)) as word from review_moves)
select word, count(*) as cnt from w where length(word) >= 3 and word not in ({", ".join(f"'{s}'" for s in _STOP)}) group by 1
""")
def content_words(spark, sf_dir):  # noqa: ANN001, ANN201
    w = table(spark, sf_dir, "review_moves").select(F.explode(text.content_words(F.col("principle"), _STOP)).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("cnt"))


@query("code_fence_strip", r"""
with m as (select move_id, move_id % 4 as k, regexp_replace(principle, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as t, principle from review_moves where principle is not null)
select move_id, case k when 0 then t when 1 then t when 2 then principle else 'see' || chr(10) || '```' || chr(10) || t || chr(10) || '```' || chr(10) || 'and' end as principle from m
""")
def code_fence_strip(spark, sf_dir):  # noqa: ANN001, ANN201
    m, k, p = table(spark, sf_dir, "review_moves").filter("principle is not null"), F.col("move_id") % 4, F.col("principle")
    inner = F.concat(F.lit("see\n```\n"), text.strip(p), F.lit("\n```\nand"))
    answer = F.when(k == 0, F.concat(F.lit(" ```json\n"), p, F.lit("\n```\n"))).when(k == 1, F.concat(F.lit("```\n"), p)).when(k == 2, p).otherwise(F.concat(F.lit("```md\n"), inner, F.lit("\n```")))
    return m.select("move_id", text.without_fences(answer).alias("principle"))


@query("truncation_check", rf"""
with t as (select doc_id, {_TRIM.format(c='text')} as t from documents)
select doc_id, t is null or t = '' or length(t) / 4 < 100 or not (regexp_matches(t, '([.!?]|```|---)$') or regexp_matches(t, '#$') or regexp_matches(t, '[.!?)\]`]$')) as cut_off from t
""")
def truncation_check(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_truncated(F.col("text"), 100).alias("cut_off"))


@query("location_parse", r"""
with t as (select move_id, regexp_extract(trigger, '([\w./-]+\.\w+)', 1) as f from review_moves where trigger is not null),
l as (select move_id, case when f <> '' then f || ': lines ' || cast(move_id % 900 as varchar) || '-990' else 'lines ' || cast(move_id % 900 as varchar) || ', 5' end as loc from t)
select move_id, case when regexp_matches(loc, '^([\w./-]+\.\w+)\s*:\s*(.+)$') then regexp_extract(lower(regexp_extract(loc, '^([\w./-]+\.\w+)', 1)), '([^/]*)$', 1) end as file, cast(move_id % 900 as int) as line from l
""")
def location_parse(spark, sf_dir):  # noqa: ANN001, ANN201
    n = (F.col("move_id") % 900).cast("string")
    f = F.regexp_extract("trigger", r"([\w./-]+\.\w+)", 1)
    loc = F.when(f != "", F.concat(f, F.lit(": lines "), n, F.lit("-990"))).otherwise(F.concat(F.lit("lines "), n, F.lit(", 5")))
    return table(spark, sf_dir, "review_moves").filter("trigger is not null").select("move_id", text.location(loc).alias("at")).select("move_id", "at.file", "at.line")


# Passages

_PASSAGES = r"""
pp as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\r', chr(10), 'g'), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 30)) as passage,
  generate_subscripts(list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\r', chr(10), 'g'), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 30), 1) - 1 as p0 from documents),
p as (select doc_id, passage, cast(p0 as int) as pos from pp)"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.split_passages(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("passage_split", f"with {_PASSAGES} select doc_id, pos, passage from p")
def passage_split(spark, sf_dir):  # noqa: ANN001, ANN201
    return _passages(spark, sf_dir)


@query("passage_context", rf"""
with {_PASSAGES}, b as (select *, lag(passage) over (partition by doc_id order by pos) as before, regexp_replace(case when contains(passage, '.') then left(passage, position('.' in passage) - 1) else passage end, '^\s+|\s+$', '', 'g') as s from p)
select doc_id, pos, concat_ws(' | ', case when length(before) < 200 then before end, case when length(s) < 100 then s end) as context from b
""")
def passage_context(spark, sf_dir):  # noqa: ANN001, ANN201
    return passages.with_context(_passages(spark, sf_dir), "doc_id").select("doc_id", "pos", "context")


@query("passage_ids", rf"with {_PASSAGES} select doc_id, pos, printf('source-%03d', row_number() over (order by doc_id, pos)) as passage_id from p")
def passage_ids(spark, sf_dir):  # noqa: ANN001, ANN201
    return passages.passage_ids(_passages(spark, sf_dir).select("doc_id", "pos"), "doc_id")


_LEX = labels.Lexicon()


def _any_sql(words: list[str], whole: bool = True) -> str:
    return rf"regexp_matches(lower(text), '{chr(92) + 'b' if whole else ''}({'|'.join(words)}){chr(92) + 'b' if whole else ''}')"


@query("passage_reason", f"""
select case when {_any_sql(_LEX.promotional)} then 'promotional' when {_any_sql(_LEX.procedural)} then 'procedural' when {_any_sql(_LEX.personal)} then 'personal'
  when not {_any_sql(_LEX.authors)} then 'no_author_reference' when not {_any_sql(_LEX.technical, False)} then 'non_technical' else 'technical' end as reason, count(*) as cnt from passages where text is not null group by 1
""")
def passage_reason(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "passages").filter("text is not null").groupBy(labels.passage_reason(F.col("text"), _LEX).alias("reason")).agg(F.count("*").alias("cnt"))


# Nested records, keys, checks

_PART = "cast(floor(move_id / 100) as bigint)"


@query("explode_moves", f"select email_message_id, {_PART} as part, cast(row_number() over (partition by email_message_id order by move_id) - 1 as int) as move_no, trigger, severity, category from review_moves")
def explode_moves(spark, sf_dir):  # noqa: ANN001, ANN201
    n = moves.nest(table(spark, sf_dir, "review_moves"))
    return moves.flatten(n, ["email_message_id", "part"]).select("email_message_id", "part", "move_no", "trigger", "severity", "category")


_MIGRATED = _case("category", labels.MIGRATION_CATEGORY)


@query("nested_remap", f"""
select email_message_id, {_PART} as part, cast(count(*) filter ({_MIGRATED} is not null) as int) as changed, count(*) as moves, count(*) filter (coalesce({_MIGRATED}, category) = 'error-handling') as error_handling from review_moves group by 1, 2
""")
def nested_remap(spark, sf_dir):  # noqa: ANN001, ANN201
    r = moves.migrate(moves.nest(table(spark, sf_dir, "review_moves")), labels.MIGRATION_CATEGORY)
    hit = F.size(F.filter("moves", lambda m: m["category"] == "error-handling")).cast("bigint")
    return r.select("email_message_id", "part", "changed", F.size("moves").cast("bigint").alias("moves"), hit.alias("error_handling"))


@query("canonicalise_drop", f"select coalesce({_C}, 'dropped') as category, count(*) as cnt from review_moves group by 1")
def canonicalise_drop(spark, sf_dir):  # noqa: ANN001, ANN201
    m = table(spark, sf_dir, "review_moves").select(labels.canonical(F.col("category"), labels.CALIBRATED, labels.CALIBRATION_CATEGORY).alias("c"))
    return m.groupBy(F.coalesce("c", F.lit("dropped")).alias("category")).agg(F.count("*").alias("cnt"))


_MK = f"select distinct {_key_sql('email_message_id')} as k from review_moves"
_VK = f"select distinct {_key_sql('email_message_id')} as k from variations"


def _keys(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(message_key(F.col("email_message_id")).alias("k"))


@query("resume_anti_join", f"""
with e as (select delivery_id, {_key_sql('message_id')} as k from emails)
select delivery_id from e where not exists (select 1 from ({_MK}) m where m.k = e.k) and not exists (select 1 from ({_VK}) v where v.k = e.k)
""")
def resume_anti_join(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "emails").select("delivery_id", message_key(F.col("message_id")).alias("k"))
    return moves.to_do(e, "k", _keys(spark, sf_dir, "review_moves"), _keys(spark, sf_dir, "variations")).select("delivery_id")


@query("zero_move_skip_list", f"select distinct k from (select {_key_sql('message_id')} as k, date from emails) e where k is not null and coalesce(date, '') <> '' and not exists (select 1 from ({_MK}) m where m.k = e.k)")
def zero_move_skip_list(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "emails").select(message_key(F.col("message_id")).alias("k"), "date").filter("k is not null")
    has = _keys(spark, sf_dir, "review_moves").distinct().withColumn("moves", F.array(F.lit(1)))
    records = e.join(has, "k", "left").withColumn("error", F.when(F.coalesce("date", F.lit("")) == "", "no date"))
    return moves.skip_keys(records, "k")


@query("value_set_ops", f"""
with a as ({_MK}), b as ({_VK})
select 'both' as side, count(*) as keys from (select k from a intersect select k from b) union all select 'moves only', count(*) from (select k from a except select k from b) union all select 'variations only', count(*) from (select k from b except select k from a)
""")
def value_set_ops(spark, sf_dir):  # noqa: ANN001, ANN201
    a, b = _keys(spark, sf_dir, "review_moves").withColumn("a", F.lit(1)), _keys(spark, sf_dir, "variations").withColumn("b", F.lit(1))
    # one shuffle for all three
    g = a.unionByName(b, allowMissingColumns=True).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    side = F.when(F.col("b").isNull(), "moves only").when(F.col("a").isNull(), "variations only").otherwise("both")
    return g.groupBy(side.alias("side")).agg(F.count("*").alias("keys"))


@query("three_way_diff", """
with a as (select cast(doc_id as varchar) as name, sha256(coalesce(text, '')) as sha256 from documents where coalesce(doc_kind, '') <> 'report'),
b as (select cast(doc_id as varchar) as name, sha256(trim(coalesce(text, ''))) as sha256 from documents where coalesce(doc_kind, '') <> 'guide')
select coalesce(a.name, b.name) as name, case when b.name is null then 'missing' when a.name is null then 'new' when a.sha256 <> b.sha256 then 'mismatch' else 'ok' end as status from a full outer join b on a.name = b.name
""")
def three_way_diff(spark, sf_dir):  # noqa: ANN001, ANN201
    d, t = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    name, kind = F.col("doc_id").cast("string").alias("name"), F.coalesce("doc_kind", F.lit(""))
    return quality.compare_checksums(d.filter(kind != "report").select(name, F.sha2(t, 256).alias("sha256")), d.filter(kind != "guide").select(name, F.sha2(F.trim(t), 256).alias("sha256")))


@query("sha256_rows", "select doc_id, sha256(text) as sha256, octet_length(encode(text)) as size_bytes from documents")
def sha256_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"))


_RULES_SQL = [(f"missing_{f}", f"coalesce({f}, '') = ''") for f in ("trigger", "principle", "severity", "category")] + [
    (f"unknown_{f}", f"coalesce({f}, '') <> '' and {f} not in ({', '.join(chr(39) + x + chr(39) for x in d)})") for f, d in (("severity", labels.SEVERITIES), ("category", labels.CATEGORIES))
]


@query("schema_violations", " union all ".join(f"select move_id, '{c}' as code from review_moves where {w}" for c, w in _RULES_SQL))
def schema_violations(spark, sf_dir):  # noqa: ANN001, ANN201
    return quality.violations(table(spark, sf_dir, "review_moves"), "move_id", quality.move_rules(labels.SEVERITIES, labels.CATEGORIES))


@query("json_violations", " union all ".join(
    [f"select move_id as line_no, 'missing_key' as code, '{f}' as detail from review_moves where {f} is null" for f in ("email_message_id", "email_date")]
    + [f"select move_id, 'missing_field', '{f}' from review_moves where {f} is null" for f in ("category", "severity", "trigger", "principle")]
    + [f"select move_id, 'unknown_{f}', {f} from review_moves where {f} not in ({', '.join(chr(39) + x + chr(39) for x in d)})" for f, d in (("severity", labels.SEVERITIES), ("category", labels.CATEGORIES))]
))
def json_violations(spark, sf_dir):  # noqa: ANN001, ANN201
    m = table(spark, sf_dir, "review_moves")
    value = F.to_json(F.struct("email_message_id", "email_date", F.array(F.struct("trigger", "principle", "response", "severity", "category")).alias("moves")))
    return quality.json_violations(m.select(F.col("move_id").alias("line_no"), value.alias("value")), labels.SEVERITIES, labels.CATEGORIES)


# Lint of documents

_TERMS = ["racy", "clever", "accident", "bug"]
_QUOTED = quality.QUOTED.replace("'", "''")
_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)"


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.doc_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("forbidden_term_hits", rf"""
with {_LINES}, b as (select *, regexp_replace(regexp_replace(regexp_replace(line, '"[^"]*"', '', 'g'), '“[^”]*”', '', 'g'), '`[^`]*`', '', 'g') as bare from l where not regexp_matches(line, '^\s*> .*\S'))
{" union all ".join(f"select doc_id, cast(line_no as int) as line_no, '{t}' as term from b where contains(bare, '{t}')" for t in _TERMS)}
""")
def forbidden_term_hits(spark, sf_dir):  # noqa: ANN001, ANN201
    return quality.term_hits(_doc_lines(spark, sf_dir), "doc_id", _TERMS)


@query("table_lint", r"""
with t as (select delivery_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as line_no from emails),
b as (select *, lag(line) over (partition by delivery_id order by line_no) as header from t)
select delivery_id, cast(line_no as int) as line_no, line, header from b where regexp_matches(line, '^\s*\|.*\|---.*\|')
""")
def table_lint(spark, sf_dir):  # noqa: ANN001, ANN201
    return quality.table_lines(quality.doc_lines(table(spark, sf_dir, "emails"), "delivery_id", "body"), "delivery_id")


_SECTIONS, _PLACEHOLDERS = ["Locking rules", "Error paths", "Interfaces", "Open points"], [r"TODO", r"\bXXX\b"]


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_checks(table(spark, sf_dir, "documents"), "doc_id", "text", _SECTIONS, _PLACEHOLDERS, 100, 15000, 1)


_CHECKS = rf"""
t as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '{_QUOTED}', '', 'g') as bare from documents),
c as (select doc_id, 'word_count' as label, len(list_filter(regexp_split_to_array(t, '[\s\p{{Z}}\x{{85}}]+'), lambda w: w <> '')) between 100 and 15000 as passed from t
union all select doc_id, 'quotes', len(regexp_extract_all(t, '["“][^"”]{{20,}}["”]')) >= 1 from t
{" ".join(f"union all select doc_id, 'section_{s}', contains(lower(t), '{s.lower()}') from t" for s in _SECTIONS)}
{" ".join(f"union all select doc_id, 'placeholder_{i}', not regexp_matches(bare, '{p}') from t" for i, p in enumerate(_PLACEHOLDERS))})"""


@query("document_checks", f"with {_CHECKS} select * from c")
def document_checks(spark, sf_dir):  # noqa: ANN001, ANN201
    return _checks(spark, sf_dir)


@query("lint_totals", f"with {_CHECKS}, d as (select doc_id, bool_and(passed) as ok from c group by 1), n as (select count(*) filter (ok) as sound from d) select label, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, max(sound) as sound from c, n group by 1")
def lint_totals(spark, sf_dir):  # noqa: ANN001, ANN201
    c = _checks(spark, sf_dir)
    sound = c.groupBy("doc_id").agg(F.bool_and("passed").alias("ok")).agg(F.count_if("ok").alias("sound"))
    return c.groupBy("label").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")).join(F.broadcast(sound))  # one row


@query("heading_segmentation", rf"""
with {_LINES}, h as (select *, last_value(case when regexp_matches(line, '^#+ ') then line end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as heading from l)
select doc_id, coalesce(heading, '') as heading, count(*) as lines from h group by 1, 2
""")
def heading_segmentation(spark, sf_dir):  # noqa: ANN001, ANN201
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    h = _doc_lines(spark, sf_dir).withColumn("heading", F.last(F.when(F.col("line").rlike("^#+ "), F.col("line")), True).over(w))
    return h.groupBy("doc_id", F.coalesce("heading", F.lit("")).alias("heading")).agg(F.count("*").alias("lines"))


_BUDGET = "f as (select doc_id, coalesce(text, '') as t from documents where doc_kind = 'interview'), b as (select *, sum(length(t)) over (order by doc_id rows unbounded preceding) as upto from f)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_kind = 'interview'").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))


@query("context_budget", f"with {_BUDGET} select doc_id, t from b where upto <= 200000 or upto = length(t)")
def context_budget(spark, sf_dir):  # noqa: ANN001, ANN201
    return documents.within_budget(_files(spark, sf_dir), "doc_id", "t", 200_000)


@query("context_budget_cut", f"with {_BUDGET} select doc_id, left(t, cast(least(length(t), 50000 - (upto - length(t))) as bigint)) as t from b where upto - length(t) < 50000")
def context_budget_cut(spark, sf_dir):  # noqa: ANN001, ANN201
    return documents.within_budget(_files(spark, sf_dir), "doc_id", "t", 50_000, cut_last=True)


@query("prompt_blocks", f"""
with {DATED}, x as ({"with " + _stratified_sql('canon')}), n as (select x.category, x.move_id, row_number() over (partition by x.category order by x.move_id) as rn, c.principle from x join canon c on c.move_id = x.move_id)
select category, category || ' (' || cast(count(*) as varchar) || ')' as header, string_agg(cast(rn as varchar) || '. ' || coalesce(principle, ''), chr(10) order by rn) as block from n group by 1
""")
def prompt_blocks(spark, sf_dir):  # noqa: ANN001, ANN201
    s = sampling.stratified(canon(spark, sf_dir, dated=True), "category", ["year", "severity"], "move_id", 25)
    return documents.numbered_blocks(s, "category", ["move_id"], F.coalesce("principle", F.lit("")))


@query("prompt_header", f"""
with {DATED}, x as ({"with " + _stratified_sql('canon')}),
c as (select category as label, count(*) as n from x group by 1), v as (select severity as label, count(*) as n from x group by 1)
select (select cast(sum(n) as bigint) from c) as patterns, (select string_agg(label || ': ' || n, ', ' order by n desc, label) from c) as categories, (select string_agg(label || ': ' || n, ', ' order by n desc, label) from v) as severities
""")
def prompt_header(spark, sf_dir):  # noqa: ANN001, ANN201
    return documents.prompt_header(sampling.stratified(canon(spark, sf_dir, dated=True), "category", ["year", "severity"], "move_id", 25))


@query("calibration_lines", f"""
with {CANON}, a(category) as (values {", ".join(f"('{c}')" for c in labels.CATEGORIES)}), t as (select category, count(*) as n, round(100 * avg(case when severity = 'reject' then 1.0 else 0.0 end), 1) as r from canon group by 1)
select a.category, case when n is null then 'no data' else printf('%d moves, %.1f %% rejected', n, r) end as line from a left join t on t.category = a.category
""")
def calibration_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    t = canon(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.round(100 * F.avg(F.when(F.col("severity") == "reject", 1.0).otherwise(0.0)), 1).alias("r"))
    a = spark.createDataFrame([(c,) for c in labels.CATEGORIES], "category string")
    return a.join(t, "category", "left").select("category", F.when(F.col("n").isNull(), "no data").otherwise(F.format_string("%d moves, %.1f %% rejected", "n", "r")).alias("line"))


# Findings of several reviewers

_FINDINGS = f"""f as (select event_id as finding_id, event_type as model, cast(user_id as varchar) as file, cast(floor(value) as int) as line, {_case("(event_id // 4) % 4", {str(i): s for i, s in enumerate(findings.LEVELS)}).replace("when '0'", "when 0").replace("when '1'", "when 1").replace("when '2'", "when 2").replace("when '3'", "when 3")} as severity, hour(ts) < 12 as skill, props as title from events)"""
_PLACES = f"""{_FINDINGS}, g as (select *, case when line - lag(line) over (partition by file order by line, finding_id) <= 10 then 0 else 1 end as gap from f),
p as (select *, cast(sum(gap) over (partition by file order by line, finding_id rows unbounded preceding) as bigint) as place_no from g)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.element_at(F.array(*map(F.lit, findings.LEVELS)), (F.floor(F.col("event_id") / 4) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("finding_id"), F.col("event_type").alias("model"), F.col("user_id").cast("string").alias("file"), F.floor("value").cast("int").alias("line"), sev.alias("severity"), (F.hour("ts") < 12).alias("skill"), F.col("props").alias("title"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.by_place(_findings(spark, sf_dir))


@query("finding_places", f"with {_PLACES} select finding_id, file, line, place_no from p")
def finding_places(spark, sf_dir):  # noqa: ANN001, ANN201
    return _places(spark, sf_dir).select("finding_id", "file", "line", "place_no")


@query("severity_counts", f"with {_FINDINGS} select model, {', '.join(f'''count(*) filter (severity = '{s}') as {s.lower()}''' for s in findings.LEVELS)} from f group by 1")
def severity_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return _findings(spark, sf_dir).groupBy("model").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in findings.LEVELS])


@query("findings_by_file", f"with {_FINDINGS} select coalesce(nullif(file, ''), 'unspecified') as file, count(*) as findings, min(line) as first_line from f group by 1")
def findings_by_file(spark, sf_dir):  # noqa: ANN001, ANN201
    return _findings(spark, sf_dir).groupBy(F.coalesce(F.expr("nullif(file, '')"), F.lit("unspecified")).alias("file")).agg(F.count("*").alias("findings"), F.min("line").alias("first_line"))


_ANCHOR, _OTHERS = "purchase", ["view", "click", "signup", "error"]


def _groups_sql(words: bool) -> str:
    """Common table expressions ending in g(file, group_id, model, finding_id): one anchor after
    the other takes what no earlier one took."""
    row = "{'id': finding_id, 'line': nullif(line, 0), 'model': model, 'words': words}"
    title = rf"list_filter(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[\w]+')), lambda w: w not in ({', '.join(chr(39) + w + chr(39) for w in findings.TITLE_STOP)}))"
    fits = f"abs(x.line - a[i + 1].line) <= {findings.NEAR_LINES}" + (f" or len(list_intersect(x.words, a[i + 1].words)) >= {findings.COMMON_WORDS}" if words else "")
    picks = ", ".join(f"list_filter(o, lambda x: x.model = '{m}' and a[i + 1].line is not null and not list_contains(used, x.id) and coalesce({fits}, false))[1].id" for m in _OTHERS)
    return f"""{_FINDINGS}, t as (select *, {title if words else "[]::varchar[]"} as words from f),
fl as (select file, coalesce(list({row} order by finding_id) filter (model = '{_ANCHOR}'), []) as a, coalesce(list({row} order by finding_id) filter (model <> '{_ANCHOR}'), []) as o from t group by file),
r as (select file, a, o, 0 as i, []::bigint[] as used, []::struct(g bigint, id bigint)[] as got from fl
  union all select file, a, o, i + 1, list_concat(used, picks), list_concat(got, list_transform(picks, lambda x: {{'g': a[i + 1].id, 'id': x}})) from (select *, list_filter([{picks}], lambda x: x is not null) as picks from r where i < len(a))),
taken as (select file, unnest(got, recursive := true) from r where i = len(a)),
g as (select t.file, coalesce(taken.g, t.finding_id) as group_id, t.model, t.finding_id, t.severity from t left join taken on taken.file = t.file and taken.id = t.finding_id)"""


def _groups(spark: SparkSession, sf_dir: str, words: bool = True) -> DataFrame:
    f = _findings(spark, sf_dir)
    g = findings.match_groups(f, _ANCHOR, words=findings.COMMON_WORDS if words else None)
    return g.join(f.select("finding_id", "severity"), "finding_id")


@query("match_findings", f"with recursive {_groups_sql(False)} select file, group_id, model, finding_id from g")
def match_findings(spark, sf_dir):  # noqa: ANN001, ANN201
    return findings.match_groups(_findings(spark, sf_dir), _ANCHOR, words=None)


@query("match_findings_by_words", f"with recursive {_groups_sql(True)} select file, group_id, model, finding_id from g")
def match_findings_by_words(spark, sf_dir):  # noqa: ANN001, ANN201
    return findings.match_groups(_findings(spark, sf_dir), _ANCHOR)


@query("severity_disagreements", f"with recursive {_groups_sql(True)} select file, group_id, count(distinct model) as models, count(distinct severity) as severities from g group by 1, 2 having count(distinct model) >= 2 and count(distinct severity) > 1")
def severity_disagreements(spark, sf_dir):  # noqa: ANN001, ANN201
    return findings.disagreements(_groups(spark, sf_dir), ["file", "group_id"])


_CONSENSUS = f"""{_groups_sql(True)}, n as (select file, group_id, count(distinct model) as models from g group by 1, 2), d as (select distinct file, group_id, model from g),
cs as (select model, count(*) filter (models >= 2) as confirmed, count(*) filter (models = 1) as unique_groups, round(100 * avg(case when models >= 2 then 1.0 else 0.0 end), 0) as consensus_rate from d join n using (file, group_id) group by 1)"""


@query("consensus_counts", f"with recursive {_CONSENSUS} select * from cs")
def consensus_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return findings.consensus(_groups(spark, sf_dir), ["file", "group_id"])


@query("report_rows", f"""
with recursive {_groups_sql(True)}, x as (select file, group_id, string_agg(model || ' ' || severity, ', ' order by finding_id) as found, count(distinct model) as models from g group by 1, 2)
select cast(row_number() over (order by file, group_id) as bigint) as no, file, group_id, found, models from x
""")
def report_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    return findings.report_rows(_groups(spark, sf_dir))


_SETS = """w as (select distinct model, file, line from f where severity = 'CRITICAL' and skill and line is not null), b as (select distinct model, file, line from f where severity = 'CRITICAL' and not skill and line is not null),
ss as (select coalesce(w.model, b.model) as model, count(*) filter (b.model is null) as gained, count(*) filter (w.model is null) as lost, count(*) filter (w.model is not null and b.model is not null) as both from w full outer join b on w.model = b.model and w.file = b.file and w.line = b.line group by 1)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _findings(spark, sf_dir).filter("severity = 'CRITICAL'")
    return findings.score_sets(c.filter("skill"), c.filter("not skill"))


@query("skill_vs_baseline", f"with {_FINDINGS}, {_SETS} select * from ss")
def skill_vs_baseline(spark, sf_dir):  # noqa: ANN001, ANN201
    return _sets(spark, sf_dir)


@query("verdict_score", f"""
with recursive {_CONSENSUS}, {_SETS}, dg as (select file, group_id from g group by 1, 2 having count(distinct model) >= 2 and count(distinct severity) > 1),
dm as (select model, count(*) as disagreements from d join dg using (file, group_id) group by 1),
j as (select cs.model, confirmed, coalesce(gained, 0) as gained, coalesce(lost, 0) as lost, coalesce(disagreements, 0) as disagreements from cs left join ss on ss.model = cs.model left join dm on dm.model = cs.model)
select *, confirmed + gained - lost - disagreements as score, cast(rank() over (order by confirmed + gained - lost - disagreements desc) as int) as place from j
""")
def verdict_score(spark, sf_dir):  # noqa: ANN001, ANN201
    g, keys = cut(_groups(spark, sf_dir)), ["file", "group_id"]
    per = g.select(*keys, "model").distinct().join(findings.disagreements(g, keys), keys).groupBy("model").agg(F.count("*").alias("disagreements"))
    return findings.verdict(findings.consensus(g, keys).select("model", "confirmed"), _sets(spark, sf_dir).select("model", "gained", "lost"), per)


@query("top_triggers", "select trigger, count(*) as cnt from review_moves where coalesce(trigger, '') <> '' group by 1 order by 2 desc, 1 limit 3")
def top_triggers(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "review_moves").filter("coalesce(trigger, '') <> ''").groupBy("trigger").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "trigger").limit(3)


_LEVEL = "case severity when 'reject' then 'CRITICAL' when 'request-changes' then 'HIGH' when 'nitpick' then 'LOW' else 'MEDIUM' end"


@query("parse_reviews", rf"""
with t as (select move_id, {_LEVEL} as severity, trim(regexp_replace(trigger, '\s+', ' ', 'g')) as title, regexp_extract(trigger, '([\w./-]+\.\w+)', 1) as f, move_id % 500 as n, category from review_moves where trim(coalesce(trigger, '')) <> '')
select move_id, severity, title, case when f <> '' then f || ':' || n else 'lines ' || n end as location, coalesce(nullif(trim(category), ''), '-') as kind,
  case when f <> '' then regexp_extract(lower(f), '([^/]*)$', 1) else 'io/fallback.c' end as file, cast(n as int) as line from t
""")
def parse_reviews(spark, sf_dir):  # noqa: ANN001, ANN201
    m = table(spark, sf_dir, "review_moves").filter("trim(coalesce(trigger, '')) <> ''")
    f, n = F.regexp_extract("trigger", r"([\w./-]+\.\w+)", 1), (F.col("move_id") % 500).cast("string")
    loc = F.when(f != "", F.concat(f, F.lit(":"), n)).otherwise(F.concat(F.lit("lines "), n))
    kind = F.coalesce(F.expr(r"nullif(trim(category), '')"), F.lit("-"))
    one = F.concat_ws("\n", F.concat(F.lit("### ["), F.expr(_LEVEL), F.lit("] "), F.trim(F.regexp_replace("trigger", r"\s+", " "))), F.lit("- **Location:** none"), F.concat(F.lit("- **Location:** "), loc), F.concat(F.lit("- **Trigger:** "), F.col("move_id").cast("string")), F.concat(F.lit("- **Type**: "), kind))
    # five findings a document, which the section above all of them belongs to
    docs = m.groupBy(F.floor(F.col("move_id") / 5).alias("doc_no")).agg(F.array_sort(F.collect_list(F.struct("move_id", one.alias("t")))).alias("ts"))
    doc = F.concat(F.lit("# Review\n## io/fallback.c\n"), F.array_join(F.transform("ts", lambda x: x["t"]), "\n\nSome words between.\n"))
    r = findings.parse_reviews(docs.select("doc_no", doc.alias("doc")), "doc_no", "doc")
    return r.select(F.col("trigger").cast("bigint").alias("move_id"), "severity", "title", "location", "kind", "file", "line")


# Enrichment, manifests, assembly

@query("recipients", """
select delivery_id, 'to' as role, r as recipient from (select delivery_id, unnest(list_filter(list_transform(string_split(coalesce(to_addrs, ''), ','), lambda x: lower(trim(x))), lambda x: x <> '')) as r from emails)
union all select delivery_id, 'cc', r from (select delivery_id, unnest(list_filter(list_transform(string_split(coalesce(cc_addrs, ''), ','), lambda x: lower(trim(x))), lambda x: x <> '')) as r from emails)
""")
def recipients(spark, sf_dir):  # noqa: ANN001, ANN201
    return enrich.recipients(table(spark, sf_dir, "emails"))


@query("variation_enrichment", r"""
with e as (select message_id, coalesce(subject, '') as s, in_reply_to, date, lower(left(body, 2000)) as t from emails where coalesce(trim(message_id), '') <> '' and len(list_filter(regexp_split_to_array(coalesce(body, ''), '[\s\p{Z}\x{85}]+'), lambda w: w <> '')) >= 50),
r as (select *, case when contains(t, 'corrupt') or contains(t, 'leaks memory') then 'safety_critical' when contains(t, 'better name') then 'cosmetic' else 'correctness' end as risk from e)
select message_id as email_message_id, case when coalesce(in_reply_to, '') = '' then 'initial_review' when regexp_matches(s, '(?i)\b(applied|merged|rejected|acked|pulled)\b') then 'final_decision' else 'iteration_n' end as thread_phase,
  case when regexp_matches(s, '(?i)(-rc|merge\s+window|release\s+blocker|critical\s+fix)') or coalesce(regexp_matches(date, '(?i)-rc\d'), false) then 'release_blocker' else 'routine' end as urgency,
  case when contains(t, 'release') then 'high' when risk = 'cosmetic' then 'low' else 'medium' end as stakes, risk from r
""")
def variation_enrichment(spark, sf_dir):  # noqa: ANN001, ANN201
    return enrich.variations(table(spark, sf_dir, "emails"))


_TOLD = rf"""
e as (select message_id, lower(coalesce(from_email, '')) as s, coalesce(to_addrs, '') || ',' || coalesce(cc_addrs, '') as r, left(body, 2000) as t from emails where coalesce(trim(message_id), '') <> '' and len(list_filter(regexp_split_to_array(coalesce(body, ''), '[\s\p{{Z}}\x{{85}}]+'), lambda w: w <> '')) >= 50),
a as (select message_id, t, s, unnest(list_distinct(list_filter(list_transform(string_split(r, ','), lambda x: lower(trim(x))), lambda x: x <> ''))) as recipient from e),
told as (select message_id as email_message_id, recipient,
  case when s <> '' and regexp_extract(recipient, '@([^@]*)$', 1) = regexp_extract(s, '@([^@]*)$', 1) then 'peer' when ends_with(string_split(recipient, '@')[1], 'review') then 'maintainer' else 'newcomer' end as relationship,
  case when contains(t, 'not acceptable') then 'harsh' when contains(lower(t), 'please') then 'formal' else 'direct' end as tone from a)"""


@query("interlocutors", f"with {_TOLD} select email_message_id, recipient, relationship, tone from told")
def interlocutors(spark, sf_dir):  # noqa: ANN001, ANN201
    t = enrich.interlocutors(table(spark, sf_dir, "emails"))
    return t.select("email_message_id", F.explode("recipients").alias("r")).select("email_message_id", "r.*")


@query("tone_by_relationship", f"""
with {CANON}, {_TOLD}, k as (select distinct {_key_sql('email_message_id')} as k, relationship from told), j as (select k.relationship, c.severity from canon c join k on k.k = {_key_sql('c.email_message_id')})
select relationship, severity, count(*) as cnt, round(100 * count(*) / sum(count(*)) over (partition by relationship), 1) as pct from j group by 1, 2
""")
def tone_by_relationship(spark, sf_dir):  # noqa: ANN001, ANN201
    told = enrich.interlocutors(table(spark, sf_dir, "emails")).withColumn("k", message_key(F.col("email_message_id")))
    return enrich.tone_by_relationship(canon(spark, sf_dir).withColumn("k", message_key(F.col("email_message_id"))), told)


@query("enrichment_lines", """
with v as (select coalesce(nullif(trim(thread_phase), ''), 'unknown') as p, coalesce(nullif(trim(urgency), ''), 'unknown') as u, coalesce(nullif(trim(stakes), ''), 'unknown') as s, coalesce(nullif(trim(risk), ''), 'unknown') as r from variations)
select printf('- %s, %s: stakes %s, risk %s', p, u, s, r) as line, count(*) as n from v group by 1
""")
def enrichment_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    return enrich.enrichment_lines(table(spark, sf_dir, "variations"))


@query("archive_manifest", f"""
with {_MAILS}, y as (select from_email, utc_us, coalesce(cast({_YEAR_SQL} as varchar), 'unknown') as y from emails join inst on inst.id = delivery_id)
select count(*) as messages, strftime(make_timestamp(min(utc_us)), '%Y-%m-%dT%H:%M:%SZ') as first_date, strftime(make_timestamp(max(utc_us)), '%Y-%m-%dT%H:%M:%SZ') as last_date, count(distinct y) as years, count(distinct from_email) as senders from y
""")
def archive_manifest(spark, sf_dir):  # noqa: ANN001, ANN201
    from sedimenta.sources import sinks

    m = sinks.manifest(dated_emails(spark, sf_dir))
    return m.select("messages", "first_date", "last_date", F.size("by_year").cast("bigint").alias("years"), "senders")


@query("migration_summary", f"""
with r as (select email_message_id, {_PART} as part, count(*) filter ({_MIGRATED} is not null) as changed from review_moves group by 1, 2)
select count(*) filter (changed > 0) as records, cast(sum(changed) as bigint) as moves from r
""")
def migration_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    r = moves.migrate(moves.nest(table(spark, sf_dir, "review_moves")), labels.MIGRATION_CATEGORY)
    return r.agg(F.count_if(F.col("changed") > 0).alias("records"), F.sum("changed").cast("bigint").alias("moves"))


@query("model_metric_grid", f"""
with {_FINDINGS}, m as (select distinct model from f), s(severity) as (values {", ".join(f"('{x}')" for x in findings.LEVELS)})
select m.model, s.severity, count(f.finding_id) as cnt from m cross join s left join f on f.model = m.model and f.severity = s.severity group by 1, 2
""")
def model_metric_grid(spark, sf_dir):  # noqa: ANN001, ANN201
    f = _findings(spark, sf_dir)
    n = f.groupBy("model").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in findings.LEVELS])
    return n.unpivot("model", findings.LEVELS, "severity", "cnt")


@query("net_critical", f"""
with {_FINDINGS}, {_SETS} select model, gained - lost as net, case when gained > lost then 'better' when gained < lost then 'worse' else 'same' end as label from ss
""")
def net_critical(spark, sf_dir):  # noqa: ANN001, ANN201
    net = F.col("gained") - F.col("lost")
    return _sets(spark, sf_dir).select("model", net.alias("net"), F.when(net > 0, "better").when(net < 0, "worse").otherwise("same").alias("label"))


@query("sample_thresholds", f"""
with {CANON} select 'categories' as label, count(distinct category) >= 8 as passed from canon union all select 'severities', count(distinct severity) >= 3 from canon union all select 'patterns', count(*) >= 100 from canon
""")
def sample_thresholds(spark, sf_dir):  # noqa: ANN001, ANN201
    a = canon(spark, sf_dir).agg((F.count_distinct("category") >= 8).alias("categories"), (F.count_distinct("severity") >= 3).alias("severities"), (F.count("*") >= 100).alias("patterns"))
    return a.unpivot([], ["categories", "severities", "patterns"], "label", "passed")


_CITED = ["as described in", "the report", "design notes"]


@query("citation_counts", f"select passage_id, cast(len(regexp_extract_all(text, '(?i){'|'.join(f'(?:{p})' for p in _CITED)}')) as int) as n from passages where text is not null")
def citation_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "passages").filter("text is not null").select("passage_id", text.citations(F.col("text"), _CITED).alias("n"))


@query("text_from_rule", r"""
with p as (select delivery_id, body, position(chr(10) || '---' || chr(10) in chr(10) || body || chr(10)) as p0 from emails where body is not null)
select delivery_id, case when p0 > 0 then substr(body, p0) else '' end as text from p
""")
def text_from_rule(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "emails").filter("body is not null").select("delivery_id", text.from_rule(F.col("body")).alias("text"))


@query("merged_chunks", """
select source_file, string_agg(case when rn = 1 then string_split(text, '. ')[1] else text end, chr(10) order by rn) as text from
  (select source_file, text, row_number() over (partition by source_file order by passage_id) as rn from passages where text is not null) group by 1
""")
def merged_chunks(spark, sf_dir):  # noqa: ANN001, ANN201
    return documents.merged_chunks(table(spark, sf_dir, "passages").filter("text is not null"), "source_file", "passage_id", "text", ". ")


@query("json_response", "select move_id, case when move_id % 3 < 2 then severity end as severity, case when move_id % 3 < 2 then category end as category from review_moves")
def json_response(spark, sf_dir):  # noqa: ANN001, ANN201
    m, k = table(spark, sf_dir, "review_moves"), F.col("move_id") % 3
    value = F.to_json(F.struct("severity", "category"))
    broken = F.concat(F.left(value, F.length(value) - 1), F.lit(" and so on"))
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), value, F.lit("\n```"))).when(k == 1, value).otherwise(broken)
    return m.select("move_id", text.json_response(answer, "severity string, category string").alias("r")).select("move_id", "r.severity", "r.category")


# Pages, generated documents, mappers, mbox

@query("html_visible_text", rf"select passage_id, {_TRIM.format(c="regexp_replace(regexp_replace(regexp_replace(text, '\\.[\\s\\p{Z}]+', '.' || chr(10) || chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')".replace('{', '{{').replace('}', '}}')).replace('{{', '{').replace('}}', '}')} as text from passages where text is not null")
def html_visible_text(spark, sf_dir):  # noqa: ANN001, ANN201
    from sedimenta.sources.web import html_text

    coded = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    spans = F.regexp_replace(coded, r"(?U)\.\s+", ".</span><SPAN class='a>b'>")
    page = F.concat(F.lit("<html><head><title>x</title></head><body><script>if (a < b) { c('</p>'); }</script><nav>menu <form>f</form> more</nav><div><span>"), spans, F.lit("</span></div><!-- c <p> --></body></html>"))
    return table(spark, sf_dir, "passages").filter("text is not null").select("passage_id", html_text(page).alias("text"))


_SPANS = """'"[^"]*"|“[^”]*”|`[^`]*`'"""


@query("sanitise_outside_quotes", rf"""
select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: case when regexp_matches(l, '^[\s\p{{Z}}]*> ') then l else
  array_to_string(list_transform(list_zip(string_split_regex(l, {_SPANS}), regexp_extract_all(l, {_SPANS})), lambda z: {_chain_sql('z[1]')} || coalesce(z[2], '')), '') end), chr(10)) as text from documents
""")
def sanitise_outside_quotes(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").select("doc_id", documents.sanitised(F.col("text"), _CHAIN).alias("text"))


@query("strip_tables", r"""
select doc_id, '- **id**: ' || doc_id || chr(10) || '- **kind**: ' || coalesce(doc_kind, '-') || chr(10) || chr(10) || '- **id**: 2' || chr(10) || chr(10) || chr(10) || coalesce(text, '') || chr(10) || '- **a**: ' || doc_id || chr(10) || chr(10) as text from documents
""")
def strip_tables(spark, sf_dir):  # noqa: ANN001, ANN201
    n = F.col("doc_id").cast("string")
    doc = F.concat(F.lit("| id | kind |\n|---|:--|\n| "), n, F.lit(" | "), F.coalesce("doc_kind", F.lit("-")), F.lit(" | more |\n  | 2\n\n"), F.coalesce("text", F.lit("")), F.lit("\n| a |\n| - |\n|"), n, F.lit("|"))
    return table(spark, sf_dir, "documents").select("doc_id", documents.without_tables(doc).alias("text"))


_RULES = ((r"takes the lock twice", "concurrency", "reject"), (r"leaks memory", "memory-safety", "reject"), (r"needs a test", "testing", "request-changes"))


@query("rule_mapper_extract", f"""
with h as ({" union all ".join(f"select delivery_id, {i} as rule, unnest(regexp_extract_all(left(body, 8000), '{p}')) as trigger, '{c}' as category, '{v}' as severity from emails" for i, (p, c, v) in enumerate(_RULES))})
select cast(delivery_id as varchar) as key, cast(row_number() over (partition by delivery_id order by rule) - 1 as int) as move_no, trigger, category, severity from h
""")
def rule_mapper_extract(spark, sf_dir):  # noqa: ANN001, ANN201
    records = mappers.annotate(table(spark, sf_dir, "emails"), "delivery_id", "body", mappers.RuleMapper(_RULES))
    return moves.flatten(records, ["key"]).select("key", "move_no", "trigger", "category", "severity")


@query("mbox_text", r"""
with e as (select delivery_id, coalesce(message_id, '') as m, coalesce(from_name, '') as n, coalesce(from_email, '') as f, coalesce(date, '') as d, coalesce(subject, '') as s, coalesce(in_reply_to, '') as r, replace(coalesce(body, ''), chr(13) || chr(10), chr(10)) as b, received_at from emails)
select delivery_id, 'From ' || case when f = '' then 'unknown@invalid' else f end || ' ' || strftime(received_at, '%a %b %d %H:%M:%S %Y') || chr(10) || 'Message-ID: ' || m || chr(10) || 'From: ' || n || ' <' || f || '>' || chr(10) || 'Date: ' || d || chr(10) || 'Subject: ' || s || chr(10)
  || 'In-Reply-To: ' || r || chr(10) || 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(10) || chr(10)
  || array_to_string(list_transform(string_split(b, chr(10)), lambda l: case when regexp_matches(l, '^>*From ') then '>' || l else l end), chr(10)) || chr(10) as value from e
""")
def mbox_text(spark, sf_dir):  # noqa: ANN001, ANN201
    from sedimenta.sources.mail import to_mbox

    return to_mbox(table(spark, sf_dir, "emails"))


@query("stream_daily_trend", "select left(cast(date_trunc('day', ts) as varchar), 10) as day, event_type, count(*) as n from events group by 1, 2")
def stream_daily_trend(spark, sf_dir):  # noqa: ANN001, ANN201
    from sedimenta.streaming import streams

    schema = table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.into_memory(streams.windowed_counts(s, "ts", "event_type"), f"daily_{abs(hash(sf_dir))}", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("session_counts", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as gap from events),
s as (select *, sum(gap) over (partition by user_id order by ts rows unbounded preceding) as no from g)
select user_id, count(*) as n, cast(epoch_us(min(ts)) as bigint) as start_us from s group by user_id, no
""")
def session_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    from sedimenta.streaming import streams

    return streams.session_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id").select("user_id", "n", F.unix_micros("start").alias("start_us"))
