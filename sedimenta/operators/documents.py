"""Assembly and clean-up of generated documents: budgets, numbering, sanitising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import bound, replaced, strip
from sedimenta.operators.passages import global_numbers, running_total

#: Chunks of a document that one task joins.
PART_CHUNKS = 1000

# What replacements leave alone (a quoted line, quotations, code), and marks
# that begin a section.
KEPT = r'(?md)^[^\S\n]*> .*$|"[^"\n]*"|“[^”\n]*”|`[^`\n]*`'
SECTIONS = ["\n## ", "\n# ", "\n---", "\n### "]
#: A table: a row, a row of rules, and the rows that follow.
TABLE = r"(?md)^[^\S\n]*\|[^\n]*\n[^\S\n]*\|[ \t\r:|-]*[:|-][ \t\r]*(?:\n|\z)(?:[^\S\n]*\|[^\n]*(?:\n|\z))*+"


def within_budget(files: DataFrame, name: str, text: str, budget: int, cut_last: bool = False) -> DataFrame:
    """Files in order of name until their characters exceed a budget; the first is always
    whole. cut_last: the file that overflows is cut to what is left instead of left out. Sizes
    are summed within ranges of names; texts are joined back afterwards."""
    sizes = files.select(name, F.length(text).cast("bigint").alias("size"))
    kept = running_total(sizes, [name], "size", "upto").withColumn("before", F.col("upto") - F.col("size"))
    if cut_last:
        kept = kept.filter(F.col("before") < budget).withColumn("take", F.least("size", budget - F.col("before")))
    else:
        kept = kept.filter((F.col("upto") <= budget) | (F.col("before") == 0)).withColumn("take", F.col("size"))
    return files.join(kept.select(name, "take"), name).withColumn(text, F.left(F.col(text), F.col("take").cast("int"))).drop("take")


def prompt_header(patterns: DataFrame) -> DataFrame:
    """One row: how many patterns a prompt has, and how many of each category and severity,
    the most frequent first. patterns is a sample of some rows a category."""
    counts = patterns.groupingSets([["category"], ["severity"]], "category", "severity").agg(F.count("*").alias("n"), F.grouping("category").alias("g"))
    of = lambda g: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("g") == g, F.struct((-F.col("n")).alias("n"), F.coalesce("category", "severity").alias("label"))))), lambda x: F.concat(x["label"], F.lit(": "), (-x["n"]).cast("string"))), ", ")
    return counts.agg(F.coalesce(F.sum(F.when(F.col("g") == 0, F.col("n"))), F.lit(0)).alias("patterns"), of(0).alias("categories"), of(1).alias("severities"))


def numbered_blocks(patterns: DataFrame, category: str, order: list[str], line: Column) -> DataFrame:
    """(category, header, block): lines of each category, numbered from 1. patterns is a
    sample of some rows a category."""
    rn = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    p = patterns.withColumn("rn", rn).withColumn("txt", F.concat(F.col("rn").cast("string"), F.lit(". "), line))
    g = p.groupBy(category).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "txt"))), lambda x: x["txt"]), "\n").alias("block"))
    return g.select(category, F.concat(F.col(category), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("header"), "block")


def sanitised(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements outside quotations, code and quoted lines (`> `). What is kept
    splits the text; only the stretches in between are rewritten. Null stays null."""
    outside = F.split(c, KEPT, -1)
    kept = F.regexp_extract_all(c, F.lit(KEPT), F.lit(0))
    return F.array_join(F.zip_with(outside, kept, lambda o, k: F.concat(replaced(o, pairs), F.coalesce(k, F.lit("")))), "")


def _cells(row: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(strip(row), r"^\|+|\|+$", ""), r"\|"), strip)


def _bullets(table: Column) -> Column:
    rows = F.filter(F.split(table, "\n"), lambda r: r != "")
    named = lambda h, v: F.concat(F.lit("- **"), h, F.lit("**: "), v, F.lit("\n"))
    of = lambda head: F.transform(F.slice(rows, F.lit(3), F.size(rows)), lambda r: F.concat(F.array_join(F.array_compact(F.zip_with(head, _cells(r), named)), ""), F.lit("\n")))
    return F.array_join(bound(_cells(F.element_at(rows, 1)), of), "")


def without_tables(c: Column) -> Column:
    """Markdown tables as bullets: one `- **header**: value` a cell, a blank line a row. The
    text is split at its tables. Null stays null."""
    outside = F.split(c, TABLE, -1)
    tables = F.regexp_extract_all(c, F.lit(TABLE), F.lit(0))
    return F.array_join(F.zip_with(outside, tables, lambda o, t: F.concat(o, F.coalesce(_bullets(t), F.lit("")))), "")


def patched_tail(text: Column, patch: Column) -> Column:
    """A text that was cut off, with what another version has from its last section on. The
    sections are told by the first characters of what begins them; a version that lacks the
    section or has less of it replaces the text as a whole."""
    last = lambda mark: F.when(text.contains(mark), F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)).otherwise(0)
    at = F.greatest(*map(last, SECTIONS))
    found = F.instr(patch, strip(F.substr(text, at + 1, F.lit(10))))
    longer = F.length(patch) - found + 1 > F.length(text) - at
    both = F.when((at > 0) & (found > 0) & longer, F.concat(F.left(text, at), F.substr(patch, found))).otherwise(patch)
    return F.when(F.coalesce(patch, F.lit("")) == "", F.coalesce(text, F.lit(""))).when(F.coalesce(text, F.lit("")) == "", patch).otherwise(both)


def merged_chunks(chunks: DataFrame, doc: str, order: str, text: str, stop: str = "## Findings") -> DataFrame:
    """(doc, text): all chunks of each document in order, the first up to a heading. Chunks
    are numbered by ranges and joined in parts of PART_CHUNKS, so that a document with many
    chunks is sorted and joined by several tasks; only its finished parts meet in one row."""
    numbers = global_numbers(chunks.select(doc, order, F.col(text).alias("__t")), [doc, order], "__no")
    x = F.sort_array(F.collect_list(F.struct("__no", "__t")))
    parts = numbers.groupBy(doc, F.floor(F.col("__no") / PART_CHUNKS).alias("__at")).agg(F.transform(x, lambda c: c["__t"]).alias("__ts"))
    rest = F.filter(F.slice("__ts", 2, PART_CHUNKS), lambda t: t.isNotNull())
    joined = parts.select(doc, F.struct("__at", F.col("__ts")[0].alias("head"), F.when(F.size(rest) > 0, F.array_join(rest, "\n")).alias("rest")).alias("__p"))
    pieces = F.transform(F.sort_array(F.collect_list("__p")), lambda c, i: F.array(F.when(i == 0, F.substring_index(c["head"], stop, 1)).otherwise(c["head"]), c["rest"]))
    return joined.groupBy(doc).agg(F.array_join(F.flatten(pieces), "\n").alias("text"))


def as_prompt(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """Rows of a sample as one JSON array; more than `most` raise, none are left out."""
    import json

    rows = df.select(F.to_json(F.struct(*columns)).alias("j")).take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a prompt holds at most {most} rows; sample them first")
    return json.dumps([json.loads(r.j) for r in rows], ensure_ascii=False)
