"""Findings of several reviewers: parsing, matching by place or words, consensus, scores."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import location
from sedimenta.operators.passages import global_numbers
from sedimenta.session import cut

#: Lines between findings that still mean the same place, and title words in common.
NEAR_LINES, COMMON_WORDS = 10, 2
# Words that titles share without meaning the same.
TITLE_STOP = "the a an is are and or but in on at to for of with".split()
LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


@dataclass(frozen=True)
class Layout:
    """How a reviewer writes Markdown: heading levels of findings and of sections."""

    finding: str = "#{3,4}"
    section: str = "#{2,3}"


def parse_reviews(docs: DataFrame, id_: str, text: str, layout: Layout = Layout(), aliases: dict[str, str] | None = None) -> DataFrame:
    """(id, finding_no, severity, title, location, trigger, kind, file, line) from Markdown.
    A heading `### [HIGH] title` opens a finding, fields `- **Location:** x` (colon inside or
    outside the stars) belong to it, of repeated ones the last counts; the last section
    heading that names a file stands in for a location without one."""
    lines = docs.select(id_, F.posexplode(F.split(text, "\r?\n")).alias("no", "line"))
    head = rf"^{layout.finding}\s+\[(CRITICAL|HIGH|MEDIUM|LOW)\]\s*(.*)$"
    sect = rf"^{layout.section}\s+`?([\w./-]+\.\w+)`?\s*$"
    w = Window.partitionBy(id_).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("is_head", F.col("line").rlike(head)).withColumn("sec", F.when(F.col("line").rlike(sect), F.regexp_extract("line", sect, 1)))
    marked = marked.withColumn("finding_no", F.sum(F.col("is_head").cast("int")).over(w)).withColumn("section", F.last("sec", True).over(w)).filter("finding_no > 0")
    field = lambda name: F.max_by(F.when(F.col("line").rlike(rf"^\s*[-*]\s+\*\*{name}:?\*\*:?\s*"), F.trim(F.regexp_replace("line", rf"^\s*[-*]\s+\*\*{name}:?\*\*:?\s*", ""))), F.when(F.col("line").rlike(rf"^\s*[-*]\s+\*\*{name}:?\*\*:?\s*"), F.col("no")))
    g = marked.groupBy(id_, "finding_no").agg(
        F.max(F.when(F.col("is_head"), F.regexp_extract("line", head, 1))).alias("severity"), F.max(F.when(F.col("is_head"), F.trim(F.regexp_extract("line", head, 2)))).alias("title"),
        field("Location").alias("location"), field("Trigger").alias("trigger"), field("Type").alias("kind"), F.max(F.when(F.col("is_head"), F.col("section"))).alias("section"),
    )
    at = location(F.coalesce("location", F.lit("")), aliases)
    return g.withColumn("file", F.coalesce(at["file"], F.lower("section"))).withColumn("line", at["line"]).drop("section")


#: How reviewers write: which files are whose, the first match counts.
LAYOUTS = {"baseline": Layout("#{2,4}", "#{1,2}"), "": Layout()}


def parse_files(docs: DataFrame, name: str, text: str, layouts: dict[str, Layout] = LAYOUTS, aliases: dict[str, str] | None = None) -> DataFrame:
    """As parse_reviews for files (name, text): the layout whose key a name holds; a file of no
    layout, or in which its layout finds nothing, is read by each until one finds something."""
    all_ = None
    for i, (part, layout) in enumerate(layouts.items()):
        first = F.when(F.lit(part != "") & F.col(name).contains(part), 0).otherwise(i + 1)
        p = parse_reviews(docs.select(name, text), name, text, layout, aliases).withColumn("__try", first)
        all_ = p if all_ is None else all_.unionByName(p)
    least = all_.groupBy(name).agg(F.min("__try").alias("__least"))  # a row a file
    return all_.join(least, name).filter(F.col("__try") == F.col("__least")).drop("__try", "__least")


def by_place(findings: DataFrame, near: int = NEAR_LINES) -> DataFrame:
    """findings with place_id: those of a file whose lines follow one another within `near`
    lines. Linear in the findings; no pairs are made."""
    w = Window.partitionBy("file").orderBy("line", "finding_id")
    gap = F.when(F.col("line") - F.lag("line").over(w) <= near, 0).otherwise(1)
    return findings.withColumn("__gap", gap).withColumn("place_no", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap")


def title_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(\w+)"), F.lit(1)), lambda x: ~x.isin(TITLE_STOP)))


def linked(findings: DataFrame, near: int, words: int | None) -> DataFrame:
    """findings with place_no, the smallest id of those that chains of near lines or of common
    title words join. Links go over what findings share (a place, a pair of words), never over
    pairs of findings; labels spread until none changes."""
    f = by_place(findings.filter("coalesce(line, 0) <> 0"), near).select("finding_id", F.xxhash64("file", F.lit("place"), "place_no").alias("key"))
    if words is not None:
        w = F.array_sort(title_words(F.coalesce("title", F.lit(""))))
        pairs = F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda y: F.concat_ws(" ", x, y)))) if words == 2 else w
        f = f.unionByName(findings.select("finding_id", F.explode(F.transform(pairs, lambda x: F.xxhash64("file", F.lit("word"), x))).alias("key")))
    shared = cut(f.distinct())
    labels = findings.select("finding_id", F.col("finding_id").alias("place_no"))
    while True:
        least = shared.join(labels, "finding_id").groupBy("key").agg(F.min("place_no").alias("least"))
        spread = shared.join(least, "key").groupBy("finding_id").agg(F.min("least").alias("least"))
        near_ = cut(labels.join(spread, "finding_id", "left").select("finding_id", "place_no", F.least("place_no", "least").alias("now")))
        if near_.filter("now <> place_no").isEmpty():
            return findings.join(labels, "finding_id")
        # a label's own label is as good, and halves the way
        ahead = near_.select(F.col("finding_id").alias("__at"), F.col("now").alias("__least"))
        labels = near_.join(ahead, F.col("now") == F.col("__at")).select("finding_id", F.col("__least").alias("place_no"))


class Pool:
    """Unused findings of a model, by line and by title word."""

    def __init__(self, rows: list[dict], near: int) -> None:
        self.near, self.rows, self.used = near, rows, set()
        self.by_line: dict[int, list[int]] = {}
        self.by_word: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            if r["line"]:
                self.by_line.setdefault(r["line"] // (near + 1), []).append(i)
            for w in r["words"]:
                self.by_word.setdefault(w, []).append(i)

    def first(self, line: int, words: set[str], common: int | None) -> dict | None:
        """The first unused finding near a line, or with enough words in common."""
        at = line // (self.near + 1)
        hits = [i for b in (at - 1, at, at + 1) for i in self.by_line.get(b, ()) if abs(self.rows[i]["line"] - line) <= self.near]
        if common is not None:
            # one that shares enough words is held by all lists but the longest
            lists = sorted((self.by_word[w] for w in words if w in self.by_word), key=len)
            for of in lists[: max(0, len(lists) - common + 1)]:
                hits += [i for i in of if len(words & self.rows[i]["words"]) >= common]
        free = [i for i in hits if i not in self.used]
        if not free:
            return None
        self.used.add(min(free))
        return self.rows[min(free)]


def match_groups(findings: DataFrame, anchor: str, near: int = NEAR_LINES, words: int | None = COMMON_WORDS) -> DataFrame:
    """(file, group_id, model, finding_id): each finding of the anchor model that names a line
    takes, of every other model, the first unused finding of its file within `near` lines or,
    with words, with so many title words in common; what is left stands alone. A group has the
    id of its first finding. The choice depends on the order of findings that are linked, so
    these are handled together; what nothing links goes to different tasks. Line 0 and null are
    no line, null titles have no words."""
    f = linked(findings.select("finding_id", "model", "file", "line", "title"), near, words)
    stop = set(TITLE_STOP)

    def match(rows: list[dict]) -> Iterator[tuple]:
        for r in rows:
            r["words"] = set(re.findall(r"\w+", (r["title"] or "").lower())) - stop if words is not None else set()
        pools = {m: Pool([r for r in rows if r["model"] == m], near) for m in sorted({r["model"] for r in rows} - {anchor})}
        for a in (r for r in rows if r["model"] == anchor):
            yield a["file"], a["finding_id"], a["model"], a["finding_id"]
            if a["line"]:
                for m, pool in pools.items():
                    if hit := pool.first(a["line"], a["words"], words):
                        yield a["file"], a["finding_id"], m, hit["finding_id"]
        for m, pool in pools.items():
            for i, r in enumerate(pool.rows):
                if i not in pool.used:
                    yield r["file"], r["finding_id"], m, r["finding_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Linked findings follow one another; they are matched when the next begin."""
        group: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if group and (r["file"], r["place_no"]) != (group[0]["file"], group[0]["place_no"]):
                    out += match(group)
                    group = []
                group.append(r)
            yield _matched(out, kind)
        yield _matched(list(match(group)), kind)

    kind = f.schema["file"].dataType.simpleString()
    order = f.select("finding_id", "model", "file", "line", "title", "place_no").repartition("file", "place_no").sortWithinPartitions("file", "place_no", "finding_id")
    return order.mapInArrow(run, f"file {kind}, group_id long, model string, finding_id long")


def _matched(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = [pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "group_id", "model", "finding_id"])


def report_rows(groups: DataFrame) -> DataFrame:
    """(no, file, group_id, found, models): groups of a report, numbered from 1 by file and
    group over all files. groups: (file, group_id, model, finding_id, severity)."""
    each = F.struct("finding_id", F.concat_ws(" ", "model", "severity").alias("t"))
    g = groups.groupBy("file", "group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), ", ").alias("found"), F.count_distinct("model").alias("models"))
    return global_numbers(g, ["file", "group_id"]).select("no", "file", "group_id", "found", "models")


def disagreements(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of at least two models that rate differently."""
    return groups.groupBy(*keys).agg(F.count_distinct("model").alias("models"), F.count_distinct("severity").alias("severities")).filter("models >= 2 and severities > 1")


def consensus(groups: DataFrame, keys: list[str]) -> DataFrame:
    """For each model: groups it shares with others, groups of its own, and their rate."""
    n = groups.groupBy(*keys).agg(F.count_distinct("model").alias("models"))
    per = groups.select(*keys, "model").distinct().join(n, keys)
    return per.groupBy("model").agg(F.count_if(F.col("models") >= 2).alias("confirmed"), F.count_if(F.col("models") == 1).alias("unique_groups"), F.round(100 * F.avg(F.when(F.col("models") >= 2, 1.0).otherwise(0.0)), 0).alias("consensus_rate"))


def verdict(confirmed: DataFrame, critical: DataFrame, disagreement_counts: DataFrame) -> DataFrame:
    """score = confirmed + gained - lost - disagreements for each model, ranked; what a model
    lacks counts as 0."""
    j = confirmed.join(critical, "model", "full_outer").join(disagreement_counts, "model", "full_outer").fillna(0)
    j = j.withColumn("score", F.col("confirmed") + F.col("gained") - F.col("lost") - F.col("disagreements"))
    return j.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))))  # one row a model


def score_sets(with_: DataFrame, without: DataFrame) -> DataFrame:
    """For each model: places found with a skill only, without it only, and both ways."""
    keys = ["model", "file", "line"]
    a = with_.dropna(subset=keys).select(*keys).distinct().withColumn("w", F.lit(1))
    b = without.dropna(subset=keys).select(*keys).distinct().withColumn("b", F.lit(1))
    j = a.join(b, keys, "full_outer")
    return j.groupBy("model").agg(F.count_if(F.col("b").isNull()).alias("gained"), F.count_if(F.col("w").isNull()).alias("lost"), F.count_if(F.col("w").isNotNull() & F.col("b").isNotNull()).alias("both"))


def render(report: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as Markdown, for reports of some rows a model; a longer one raises."""
    rows, cols = report.take(most + 1), report.columns
    if len(rows) > most:
        raise ValueError(f"{title} has more than {most} rows")
    out: Iterator[str] = (f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows)
    return "\n".join([f"## {title}", "", f"| {' | '.join(cols)} |", f"|{'---|' * len(cols)}", *out, ""])
