"""Enrichment of mails: recipients, phase and urgency, stakes and risk by a mapper."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import labels
from sedimenta.functions.text import word_count

# Domains of stakes and risk, and what counts where a mapper fails.
STAKES, RISKS = ["high", "medium", "low"], ["safety_critical", "correctness", "cosmetic"]
DEFAULT_STAKES, DEFAULT_RISK = "medium", "correctness"


def addresses(c: Column) -> Column:
    """Addresses of a comma-separated list, trimmed, in lower case, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def recipients(emails: DataFrame, id_: str = "delivery_id") -> DataFrame:
    """(id, role, recipient) of each addressee."""
    each = F.concat(F.transform(addresses(F.col("to_addrs")), lambda x: F.struct(F.lit("to").alias("role"), x.alias("recipient"))), F.transform(addresses(F.col("cc_addrs")), lambda x: F.struct(F.lit("cc").alias("role"), x.alias("recipient"))))
    return emails.select(id_, F.explode(each).alias("r")).select(id_, "r.role", "r.recipient")


def by_words(body: Column) -> tuple[Column, Column]:
    """Stakes and risk by words; stands in for a service."""
    t = F.lower(body)
    risk = F.when(t.contains("corrupt") | t.contains("leaks memory"), "safety_critical").when(t.contains("better name"), "cosmetic").otherwise("correctness")
    return F.when(t.contains("release"), "high").when(risk == "cosmetic", "low").otherwise("medium"), risk


def variations(emails: DataFrame, assess: Callable[[str], tuple[str, str]] | None = None, least_words: int = 50, most_chars: int = 2000) -> DataFrame:
    """(email_message_id, thread_phase, urgency, stakes, risk) of mails with an identifier and
    enough words, by a service or, without one, by words. Answers outside the domains, and
    failures, count as the defaults."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            stakes, risks = [], []
            for body in b["body"]:
                try:
                    s, r = assess(body)
                except Exception:  # noqa: BLE001
                    s, r = DEFAULT_STAKES, DEFAULT_RISK
                stakes.append(s if s in STAKES else DEFAULT_STAKES)
                risks.append(r if r in RISKS else DEFAULT_RISK)
            yield b.drop(columns="body").assign(stakes=stakes, risk=risks)

    e = emails.filter((F.coalesce(F.trim("message_id"), F.lit("")) != "") & (word_count(F.coalesce("body", F.lit(""))) >= least_words))
    e = e.select(F.col("message_id").alias("email_message_id"), labels.thread_phase(F.coalesce("subject", F.lit("")), F.col("in_reply_to")).alias("thread_phase"), labels.urgency(F.col("subject"), F.col("date")).alias("urgency"), F.left("body", F.lit(most_chars)).alias("body"))
    if assess is None:
        stakes, risk = by_words(F.col("body"))
        return e.select("email_message_id", "thread_phase", "urgency", stakes.alias("stakes"), risk.alias("risk"))
    return e.mapInPandas(run, "email_message_id string, thread_phase string, urgency string, stakes string, risk string")


#: What a mapper tells of one addressee.
INTERLOCUTORS = "email_message_id string, recipients array<struct<recipient:string,relationship:string,tone:string>>, error string"
RELATIONSHIPS = ["maintainer", "newcomer", "peer"]


def by_addresses(sender: str, recipients: list[str], body: str) -> list[dict]:
    """Relationships by domains and tone by words; stands in for a service."""
    own = sender.rpartition("@")[2].lower()
    tone = "harsh" if "not acceptable" in body else "formal" if "please" in body.lower() else "direct"
    kind = lambda r: "peer" if own and r.rpartition("@")[2] == own else "maintainer" if r.partition("@")[0].endswith("review") else "newcomer"
    return [{"recipient": r, "relationship": kind(r), "tone": tone} for r in recipients]


def interlocutors(emails: DataFrame, assess: Callable[[str, list[str], str], list[dict]] = by_addresses, least_words: int = 50, most_chars: int = 2000) -> DataFrame:
    """Rows of INTERLOCUTORS for mails with an identifier and enough words: whom each addresses
    and how. A failure is the row's error, with no recipients."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, sender, to, body in zip(b["key"], b["sender"], b["to"], b["body"], strict=True):
                try:
                    rows.append((key, assess(sender, list(to), body), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((key, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["email_message_id", "recipients", "error"])

    e = emails.filter((F.coalesce(F.trim("message_id"), F.lit("")) != "") & (word_count(F.coalesce("body", F.lit(""))) >= least_words))
    to = F.array_distinct(F.concat(addresses(F.col("to_addrs")), addresses(F.col("cc_addrs"))))
    e = e.select(F.col("message_id").alias("key"), F.coalesce("from_email", F.lit("")).alias("sender"), to.alias("to"), F.left("body", F.lit(most_chars)).alias("body"))
    return e.mapInPandas(run, INTERLOCUTORS)


def tone_by_relationship(moves: DataFrame, told: DataFrame, key: str = "k") -> DataFrame:
    """(relationship, severity, cnt, pct): how moves (key, severity) are rated by whom their mail
    addresses (rows of INTERLOCUTORS with the key). Moves are counted by mail before the join."""
    m = moves.groupBy(key, "severity").agg(F.count("*").alias("n"))
    kinds = told.select(key, F.explode(F.array_distinct(F.transform("recipients", lambda r: r["relationship"]))).alias("relationship")).distinct()
    g = m.join(kinds, key).groupBy("relationship", "severity").agg(F.sum("n").alias("cnt"))
    return g.withColumn("pct", F.round(100 * F.col("cnt") / F.sum("cnt").over(Window.partitionBy("relationship")), 1))


def enrichment_lines(v: DataFrame) -> DataFrame:
    """(line, n): what a prompt says of variations, one bullet a combination."""
    miss = lambda c: F.coalesce(F.expr(f"nullif(trim({c}), '')"), F.lit("unknown"))
    g = v.groupBy(miss("thread_phase").alias("p"), miss("urgency").alias("u"), miss("stakes").alias("s"), miss("risk").alias("r")).agg(F.count("*").alias("n"))
    return g.select(F.format_string("- %s, %s: stakes %s, risk %s", "p", "u", "s", "r").alias("line"), "n")
