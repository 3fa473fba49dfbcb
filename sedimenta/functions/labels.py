"""Rules that label mails and passages. Word lists are parameters; the defaults are small
samples, for a deployment to replace."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.text import lines, strip

# Domains of labels, in canonical order, and how stray labels are read.
SEVERITIES = ["reject", "request-changes", "nitpick", "approve", "discussion"]
CATEGORIES = ["api-stability", "performance", "correctness", "complexity", "style", "process", "error-handling", "concurrency", "memory-safety", "abstraction", "testing", "documentation", "other", "security"]
CALIBRATED = CATEGORIES[:-1]
CALIBRATION_CATEGORY = {
    "security": "correctness", "reliability": "correctness", "debugging": "correctness", "api": "api-stability", "api-design": "api-stability", "compatibility": "api-stability", "stability": "api-stability",
    "maintainability": "complexity", "redundancy": "complexity", "readability": "style", "design": "abstraction",
}
CALIBRATION_SEVERITY = {"process": "discussion"}
MIGRATION_CATEGORY = {k: ("error-handling" if k == "reliability" else v) for k, v in CALIBRATION_CATEGORY.items() if k != "security"}
TRAILERS = "acked-by nacked-by signed-off-by reviewed-by tested-by reported-by suggested-by co-developed-by".split()

# How subjects and lines tell what a mail is.
ANNOUNCEMENT = r"(?i)^(linux\s+\d|git\s+pull|pull\s+request|merge\s+(branch|tag))"
PULL, COMMENTS, SUBMISSION, PATCH = r"(?i)\[git\s+pull\]", r"(?i)\[rfc\]", r"(?i)^(re:\s*)*\[patch", r"(?i)\bpatch\b"
DECISION = r"(?i)\b(applied|merged|rejected|acked|pulled)\b"
URGENT, CANDIDATE = r"(?i)(-rc|merge\s+window|release\s+blocker|critical\s+fix)", r"(?i)-rc\d"
TRAILER_LINE = rf"(?i)^({'|'.join(TRAILERS)}):"


@dataclass(frozen=True)
class Lexicon:
    """Word lists by which passages are kept or dropped."""

    promotional: list[str] = field(default_factory=lambda: ["sponsored", "subscribe", "discount", "webinar"])
    procedural: list[str] = field(default_factory=lambda: ["agenda", "minutes of the meeting", "next speaker"])
    personal: list[str] = field(default_factory=lambda: ["holiday", "hobby", "my family"])
    authors: list[str] = field(default_factory=lambda: ["we", "i", "you", "maintainer"])
    technical: list[str] = field(default_factory=lambda: ["lock", "buffer", "cache", "patch", "callback", "queue", "struct", "test"])

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Lexicon:
        """The lists of a JSON object in a file; a list it lacks is the default, another key an error."""
        lists = json.loads(spark.read.text(path, wholetext=True).first().value)
        if extra := lists.keys() - cls.__dataclass_fields__.keys():
            raise ValueError(f"no such lists: {sorted(extra)}")
        return cls(**lists)


def canonical(c: Column, domain: list[str], remap: dict[str, str]) -> Column:
    """c where the domain has it, else what it is read as, else null."""
    pairs = {**remap, **{d: d for d in domain}}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), c)


def is_review(subject: Column, reply_to: Column, body: Column, least_body: int = 100, least_line: int = 30, drop_patches: bool = True) -> Column:
    """Whether a mail reviews code: a reply or about a patch, no announcement, pull request,
    request for comments or patch submission, long enough, and with a line of substance that
    is no trailer. An empty reply identifier counts as none."""
    s = strip(F.coalesce(subject, F.lit("")))
    b = strip(F.coalesce(body, F.lit("")))
    reply = (F.coalesce(reply_to, F.lit("")) != "") | F.startswith(F.lower(s), F.lit("re:")) | s.rlike(PATCH)
    dropped = s.rlike(ANNOUNCEMENT) | s.rlike(PULL) | s.rlike(COMMENTS)
    if drop_patches:
        dropped |= s.rlike(SUBMISSION)
    stripped = F.transform(lines(b), lambda x: strip(x))
    substance = F.exists(stripped, lambda x: (F.length(x) > least_line) & ~x.rlike(TRAILER_LINE))
    return reply & ~dropped & (F.length(b) >= least_body) & substance


def thread_phase(subject: Column, reply_to: Column) -> Column:
    return (
        F.when(F.coalesce(reply_to, F.lit("")) == "", "initial_review")
        .when(subject.rlike(DECISION), "final_decision")
        .otherwise("iteration_n")
    )


def urgency(subject: Column, date: Column) -> Column:
    hit = subject.rlike(URGENT) | date.rlike(CANDIDATE)
    return F.when(hit, "release_blocker").otherwise("routine")


def any_word(c: Column, words: list[str], whole: bool = True) -> Column:
    """Whether c has any of the words; one pass over the text for the whole list."""
    body = "|".join(w.replace(".", r"\.") for w in words)
    return F.lower(c).rlike(rf"\b({body})\b" if whole else f"({body})")


def passage_reason(c: Column, lex: Lexicon) -> Column:
    """Why a passage is dropped, first match first, or technical."""
    return (
        F.when(any_word(c, lex.promotional), "promotional")
        .when(any_word(c, lex.procedural), "procedural")
        .when(any_word(c, lex.personal), "personal")
        .when(~any_word(c, lex.authors), "no_author_reference")
        .when(~any_word(c, lex.technical, whole=False), "non_technical")
        .otherwise("technical")
    )
