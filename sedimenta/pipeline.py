"""The stages of distilling reviews, each from tables to a table. Stages are plans; what an
external mapper answers is written once and everything else derived from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import labels, text
from sedimenta.operators import documents, enrich, instants, mappers, moves, passages, sampling, stats
from sedimenta.session import cut


def classify(emails: DataFrame) -> DataFrame:
    """Mails that review code."""
    return emails.filter(labels.is_review(F.col("subject"), F.col("in_reply_to"), F.col("body")))


def extract(reviews: DataFrame, mapper: mappers.Mapper, out: str, sample: int = 0, resume: bool = False, workers: int = 8) -> None:
    """Moves of reviews by a mapper, written as records with date and subject. With resume, keys
    answered without error are left out and records appended; without, out is written anew."""
    spark = reviews.sparkSession
    r = reviews if "tz_name" in reviews.columns else reviews.withColumn("tz_name", F.lit(None).cast("string"))
    r = r.withColumn("key", F.col("message_id"))
    if sample > 0:
        r = sampling.longest_per_year(instants.to_utc(r, "date", "tz_name").withColumn("year", text.year_text(F.col("utc_us"))), "year", "body", "delivery_id", sample)
    if resume:
        r = moves.to_do(r, "key", moves.done_keys(spark.read.parquet(out), "key"))
    mappers.annotate(r, "key", "body", mapper, workers=workers, keep=("date", "tz_name", "subject")).write.mode("append" if resume else "overwrite").parquet(out)


def extract_interviews(passages_: DataFrame, mapper: mappers.Mapper, out: str, resume: bool = False) -> None:
    """Moves of passages (passage_id, source_file, text) by a mapper, written as records."""
    p = passages_.withColumn("key", F.col("passage_id")).withColumn("source_file", F.col("source_file").cast("string"))
    if resume:
        p = moves.to_do(p, "key", moves.done_keys(p.sparkSession.read.parquet(out), "key"))
    mappers.annotate(p, "key", "text", mapper, keep=("source_file",)).write.mode("append" if resume else "overwrite").parquet(out)


def flat(records: DataFrame, source: str, key: str = "key") -> DataFrame:
    """Flat, canonical moves of records, with the year of the instant that a record's date
    states (null where it has none)."""
    dated = "date" in records.columns
    m = moves.flatten(records, [key, *(["date", "tz_name"] if dated else [])], source=source)
    m = moves.canonicalise(m, labels.canonical(F.col("category"), labels.CALIBRATED, labels.CALIBRATION_CATEGORY), labels.canonical(F.col("severity"), labels.SEVERITIES, labels.CALIBRATION_SEVERITY))
    if dated:
        m = instants.to_utc(m, "date", "tz_name").withColumn("year", instants.year_of(F.col("utc_us"))).drop("utc_us", "date", "tz_name")
    else:
        m = m.withColumn("year", F.lit(None).cast("int"))
    return m.withColumn("move_id", F.xxhash64(key, "move_no"))


def cluster(moves_: DataFrame, per_category: int = 25, seed: str = "42") -> DataFrame:
    """The longer half of each category's moves, and of it an even sample."""
    return sampling.stratified(sampling.substantive_half(moves_, "category", "response", "move_id"), "category", ["year", "severity"], "move_id", per_category, seed)


def cluster_sources(email_moves: DataFrame, interview_moves: DataFrame, per_category: int = 25, seed: str = "42") -> DataFrame:
    """A sample of both sources, balanced within each category."""
    both = email_moves.unionByName(interview_moves, allowMissingColumns=True)
    return sampling.balanced(both, "category", "source", "interview", "move_id", per_category, seed)


def calibrate(moves_: DataFrame) -> dict[str, DataFrame]:
    """Statistics of canonical moves by name."""
    return {"severity_by_category": stats.severity_by_category(moves_, labels.CALIBRATED, labels.SEVERITIES), "trends": stats.yearly_trends(moves_), "corpus": stats.corpus_stats(moves_, labels.SEVERITIES, labels.CALIBRATED)}


def classify_interviews(texts: DataFrame, id_: str = "id", body: str = "text", lexicon: labels.Lexicon | None = None) -> DataFrame:
    """Technical passages of interviews with their context and identifiers."""
    p = passages.with_context(passages.split_passages(texts, id_, body), id_)
    kept = p.filter(labels.passage_reason(F.col("passage"), lexicon or labels.Lexicon()) == "technical")
    return passages.passage_ids(kept, id_).select(F.col(id_).alias("source_file"), "passage_id", F.col("passage").alias("text"), "context")


def sources(moves_: DataFrame) -> DataFrame:
    """Moves by source."""
    return moves_.groupBy("source").agg(F.count("*").alias("moves"))


#: What writes a text: gets its name and a prompt.
Writer = Callable[[str, str], str]


def template(name: str, prompt_: str) -> str:
    """The prompt as the text; stands in for a service."""
    return f"# {name}\n\n{prompt_.strip()}\n\nEnd of {name}."


def prompts(patterns: DataFrame, top: int = 25) -> DataFrame:
    """(category, prompt): the patterns of each category, numbered."""
    s = sampling.first_per_group(patterns, ["category"], [F.col("move_id")], top)
    rows = documents.numbered_blocks(s, "category", ["move_id"], F.concat_ws(" | ", "severity", "trigger", "principle", "response"))
    return rows.select("category", F.concat(F.lit("## "), F.col("header"), F.lit("\n"), F.col("block")).alias("prompt"))


def prompt(patterns: DataFrame, top: int = 25) -> str:
    """The text that a distilling service gets: how many patterns there are, and those of each
    category."""
    head = documents.prompt_header(patterns).first()
    rows = prompts(patterns, top).orderBy("category").collect()  # a row a category
    return "\n\n".join([f"{head.patterns} patterns\ncategories: {head.categories}\nseverities: {head.severities}", *(r.prompt for r in rows)])


def written(prompts_: DataFrame, writer: Writer, fallback: Writer | None = None, least_tokens: int = 10, replacements: list[tuple[str, str]] | None = None) -> DataFrame:
    """(name, text, error) from prompts (name, prompt): what a writer makes of each. A text that
    seems cut off gets its tail from another writer; tables become bullets, and terms are
    replaced outside quotations. A failure is the row's error."""

    def by(writer: Writer) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for name, p in zip(b["name"], b["prompt"], strict=True):
                    try:
                        rows.append((name, p, writer(name, p), None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((name, p, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["name", "prompt", "text", "error"])

        return run

    kind = "name string, prompt string, text string, error string"
    # asked once: everything else is made of what was answered
    out = cut(prompts_.select("name", "prompt").repartition("name").mapInPandas(by(writer), kind))
    if fallback is not None:
        short = out.filter(F.col("error").isNotNull() | text.looks_truncated(F.col("text"), least_tokens))
        again = cut(short.select("name", "prompt").mapInPandas(by(fallback), kind)).select("name", F.col("text").alias("other"), F.col("error").alias("other_error"))
        out = out.join(again, "name", "left").withColumn("text", F.when(F.col("other").isNotNull(), documents.patched_tail(F.col("text"), F.col("other"))).otherwise(F.col("text")))
        out = out.withColumn("error", F.when(F.col("other").isNull(), F.col("error")))
    return out.select("name", documents.sanitised(documents.without_tables(F.col("text")), replacements or []).alias("text"), "error")


def distill(patterns: DataFrame, writer: Writer, fallback: Writer | None = None, top: int = 25, single_call: bool = False, replacements: list[tuple[str, str]] | None = None) -> str:
    """One document of all patterns: written in one go, or category by category and then put
    together. Categories that failed are left to the text as a whole."""
    spark = patterns.sparkSession
    if single_call:
        whole = prompt(patterns, top)
    else:
        parts = written(prompts(patterns, top).withColumnRenamed("category", "name"), writer, fallback, replacements=replacements)
        whole = "\n\n".join(r.text for r in parts.filter("text is not null").orderBy("name").collect())  # a row a category
    return written(spark.createDataFrame([("skill", whole)], "name string, prompt string"), writer, fallback, replacements=replacements).first().text


def persona(patterns: DataFrame, moves_: DataFrame, writer: Writer, told: DataFrame | None = None, interviews: DataFrame | None = None, fallback: Writer | None = None, key: str = "key") -> str:
    """A document of how the reviewer decides and speaks: ranked categories, voice, tone by whom
    is addressed, patterns, and interviews (name, text) as far as they fit."""
    spark = patterns.sparkSession
    parts = ["## Hierarchy", *(f"{r.place}. {r.category} ({r.reject_rate} %)" for r in stats.hierarchy(moves_).orderBy("place").collect())]  # a row a category
    parts += ["", "## Voice", *(f"{k}: {v}" for k, v in stats.voice(patterns, "response").first().asDict().items()), "", "## Interlocutors"]
    tone = [] if told is None else enrich.tone_by_relationship(moves_, told.withColumnRenamed("email_message_id", key), key).orderBy("relationship", "severity").collect()
    parts += [f"{r.relationship}: {r.severity} {r.pct} %" for r in tone] or ["Too little is known of whom mails address."]
    parts += ["", prompt(patterns)]
    if interviews is not None:
        kept = documents.within_budget(interviews, "name", "text", 50_000, cut_last=True)
        parts += ["", "## Interviews", *(r.text for r in kept.orderBy("name").collect())]  # 50,000 characters
    return written(spark.createDataFrame([("soul", "\n".join(parts))], "name string, prompt string"), writer, fallback).first().text


def evaluate(spark: SparkSession, files: dict[tuple[str, str], str]) -> DataFrame:
    """(model, mode, ...) findings of review files by model and mode."""
    from sedimenta.operators import findings

    docs = None
    for (model, mode), path in files.items():
        d = spark.read.text(path, wholetext=True).select(F.lit(model).alias("model"), F.lit(mode).alias("mode"), F.concat_ws("/", F.lit(model), F.lit(mode)).alias("doc"), "value")
        docs = d if docs is None else docs.unionByName(d)
    parsed = findings.parse_reviews(docs.select("doc", "value"), "doc", "value")
    return parsed.withColumn("model", F.substring_index("doc", "/", 1)).withColumn("mode", F.substring_index("doc", "/", -1)).drop("doc")
