"""Checks of artifacts: violations as rows, checksums, and the lint of generated documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import bound, word_count
from sedimenta.operators.passages import global_numbers

#: Quotations and code.
QUOTED = r'"[^"]*"|“[^”]*”|`[^`]*`'
#: Lines that quote, blanks before the mark left out.
QUOTED_LINE = r"^\s*> .*\S"


def violations(df: DataFrame, id_: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(id, code) for each rule that a row breaks; one pass, one row for each breach."""
    codes = F.array(*[F.when(broken, F.lit(code)) for code, broken in rules])
    return df.select(F.col(id_), F.explode(F.array_compact(codes)).alias("code"))


def move_rules(severities: list[str], categories: list[str]) -> list[tuple[str, Column]]:
    rules = [(f"missing_{f}", F.coalesce(F.col(f), F.lit("")) == "") for f in ("trigger", "principle", "severity", "category")]
    for f, domain in (("severity", severities), ("category", categories)):
        rules.append((f"unknown_{f}", (F.coalesce(F.col(f), F.lit("")) != "") & ~F.col(f).isin(domain)))
    return rules


def json_violations(lines: DataFrame, severities: list[str], categories: list[str], fields: tuple[str, ...] = ("category", "severity", "trigger", "principle")) -> DataFrame:
    """(line_no, code, detail) for lines (line_no, value) that should be records with moves:
    types are those of the JSON, a number doesn't pass for a string."""
    v = lines.filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    bad = F.col("v").isNull()
    record = F.array(
        F.when(bad, F.struct(F.lit("invalid_json").alias("code"), F.lit("").alias("detail"))),
        F.when(~bad & F.coalesce(~kind("$.moves").startswith("ARRAY"), F.lit(True)), F.struct(F.lit("moves_not_array").alias("code"), F.lit("").alias("detail"))),
        *[F.when(~bad & kind(f"$.{f}").isNull(), F.struct(F.lit("missing_key").alias("code"), F.lit(f).alias("detail"))) for f in ("email_message_id", "email_date")],
    )
    top = v.select("line_no", F.explode(F.array_compact(record)).alias("x")).select("line_no", "x.*")
    each = v.select("line_no", F.explode_outer(F.try_variant_get("v", "$.moves", "array<variant>")).alias("m")).filter("m is not null")
    checks = []
    for f in fields:
        k = F.schema_of_variant(F.try_variant_get("m", f"$.{f}", "variant"))
        checks += [
            F.when(k.isNull() | (k == "VOID"), F.struct(F.lit("missing_field").alias("code"), F.lit(f).alias("detail"))),
            F.when(k.isNotNull() & (k != "VOID") & (k != "STRING"), F.struct(F.lit("not_a_string").alias("code"), F.lit(f).alias("detail"))),
        ]
    for f, domain in (("severity", severities), ("category", categories)):
        value = F.try_variant_get("m", f"$.{f}", "string")
        checks.append(F.when(value.isNotNull() & ~value.isin(domain), F.struct(F.lit(f"unknown_{f}").alias("code"), value.alias("detail"))))
    moves = each.select("line_no", F.explode(F.array_compact(F.array(*checks))).alias("x")).select("line_no", "x.*")
    return top.unionByName(moves)


def _found(bad: Column, code: str, detail: Column | str = "") -> Column:
    return F.when(bad, F.struct(F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))


def pattern_violations(document: DataFrame, severities: list[str], categories: list[str], sources: tuple[str, ...] = ("email", "interview")) -> DataFrame:
    """(place, code, detail) for a document (value) that should be one JSON array of patterns;
    place counts elements from 0 and is null for the whole."""
    v = document.select(F.try_parse_json("value").alias("v"))
    kind = lambda c, path: F.schema_of_variant(F.try_variant_get(c, path, "variant"))
    whole = F.array_compact(F.array(_found(F.col("v").isNull(), "invalid_json"), _found(F.col("v").isNotNull() & ~kind("v", "$").startswith("ARRAY"), "not_an_array")))
    top = v.select(F.lit(None).cast("int").alias("place"), F.explode(whole).alias("x")).select("place", "x.*")
    each = v.filter(kind("v", "$").startswith("ARRAY")).select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("place", "m"))
    is_object = F.coalesce(kind("m", "$").startswith("OBJECT"), F.lit(False))
    checks = [_found(~is_object, "not_an_object")]
    for f in ("category", "severity", "trigger", "principle"):
        checks.append(_found(is_object & kind("m", f"$.{f}").isNull(), "missing_field", f))
    for f in ("trigger", "principle", "quote"):
        k = kind("m", f"$.{f}")
        checks.append(_found(is_object & k.isNotNull() & (k != "STRING"), "not_a_string", f))
    for f, domain in (("category", categories), ("severity", severities), ("source", list(sources))):
        value = F.try_variant_get("m", f"$.{f}", "string")
        checks.append(_found(is_object & kind("m", f"$.{f}").isNotNull() & ~F.coalesce(value.isin(domain), F.lit(False)), f"unknown_{f}", F.coalesce(value, F.lit(""))))
    return top.unionByName(each.select("place", F.explode(F.array_compact(F.array(*checks))).alias("x")).select("place", "x.*"))


def calibration_violations(document: DataFrame, sections: tuple[str, ...] = ("severity_by_category", "temporal_trends", "corpus_stats")) -> DataFrame:
    """(place, code, detail) for a document (value) that should be one JSON object with these
    sections, each an object, and a whole number of moves."""
    v = document.select(F.try_parse_json("value").alias("v"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    is_object = F.coalesce(kind("$").startswith("OBJECT"), F.lit(False))
    checks = [_found(F.col("v").isNull(), "invalid_json"), _found(F.col("v").isNotNull() & ~is_object, "not_an_object")]
    for s in sections:
        checks += [_found(is_object & kind(f"$.{s}").isNull(), "missing_section", s), _found(is_object & kind(f"$.{s}").isNotNull() & ~kind(f"$.{s}").startswith("OBJECT"), "section_not_an_object", s)]
    stats, moves = kind("$.corpus_stats"), kind("$.corpus_stats.total_moves")
    checks += [_found(stats.startswith("OBJECT") & moves.isNull(), "missing_field", "total_moves"), _found(moves.isNotNull() & (moves != "BIGINT"), "not_a_whole_number", "total_moves")]
    return v.select(F.lit(None).cast("int").alias("place"), F.explode(F.array_compact(F.array(*checks))).alias("x")).select("place", "x.*")


def folder_violations(spark: SparkSession, path: str, severities: list[str], categories: list[str]) -> DataFrame:
    """(file, place, code, detail) of moves.jsonl, patterns.json and calibration.json in a folder,
    read as text; a file that isn't there is an error too. A folder without any is sound."""
    moves = lambda d: json_violations(d, severities, categories).withColumnRenamed("line_no", "place")
    parts: dict[str, Callable[[DataFrame], DataFrame]] = {"moves.jsonl": moves, "patterns.json": lambda d: pattern_violations(d, severities, categories), "calibration.json": calibration_violations}
    out = None
    for name, check in parts.items():
        try:
            d = spark.read.text(f"{path}/{name}", wholetext=not name.endswith(".jsonl"))
            if name.endswith(".jsonl"):
                d = global_numbers(d.select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")), ["f", "i"], "line_no").select("line_no", "value")
            bad = check(d)
        except AnalysisException:
            bad = spark.createDataFrame([(None, "file_not_found", "")], "place int, code string, detail string")
        bad = bad.select(F.lit(name).alias("file"), F.col("place").cast("bigint").alias("place"), "code", "detail")
        out = bad if out is None else out.unionByName(bad)
    return out


def file_checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, sha256, size_bytes) of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def compare_checksums(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(name, status): ok, missing, mismatch or new."""
    a, b = stored.select("name", F.col("sha256").alias("was")), found.select("name", F.col("sha256").alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "mismatch").otherwise("ok")
    return a.join(b, "name", "full_outer").select("name", status.alias("status"))


def updated_checksums(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The list of checksums as the files are now: changed and new ones renewed, missing ones
    kept as they were."""
    kept = stored.join(found.select("name"), "name", "left_anti")
    return found.unionByName(kept.select(*found.columns))


def doc_lines(docs: DataFrame, id_: str, text: str) -> DataFrame:
    return docs.select(id_, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def unquoted(line: Column) -> Column:
    """A line without quotations in straight quotes, then in curly ones, then code."""
    for span in QUOTED.split("|"):
        line = F.regexp_replace(line, span, "")
    return line


def term_hits(lines: DataFrame, id_: str, terms: list[str]) -> DataFrame:
    """(id, line_no, term) of terms that a line holds outside quotations, letter case
    counting; quoted lines (`> `) are exempt. Terms are matched within the row."""
    found = lambda bare: F.array_compact(F.array(*[F.when(bare.contains(t), F.lit(t)) for t in terms]))
    return lines.filter(~F.col("line").rlike(QUOTED_LINE)).select(id_, "line_no", F.explode(bound(unquoted(F.col("line")), found)).alias("term"))


def table_lines(lines: DataFrame, id_: str) -> DataFrame:
    """(id, line_no, line, header) of Markdown tables: the separator and the line above."""
    w = Window.partitionBy(id_).orderBy("line_no")
    with_before = lines.withColumn("header", F.lag("line").over(w))
    return with_before.filter(F.col("line").rlike(r"^\s*\|.*\|---.*\|")).select(id_, "line_no", "line", "header")


def document_checks(docs: DataFrame, id_: str, text: str, sections: list[str], placeholders: list[str], least_words: int = 1500, most_words: int = 15000, quotes: int = 10) -> DataFrame:
    """(id, label, passed) for each check of each document, one pass over the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = word_count(t)
    bare = F.regexp_replace(t, QUOTED, "")
    checks = [
        ("word_count", words.between(least_words, most_words)),
        ("quotes", F.regexp_count(t, F.lit('["“][^"”]{20,}["”]')) >= quotes),
        *[(f"section_{s}", F.lower(t).contains(s.lower())) for s in sections],
        *[(f"placeholder_{i}", ~bare.rlike(p)) for i, p in enumerate(placeholders)],
    ]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), c.alias("passed")) for n, c in checks])).alias("x")
    return docs.select(id_, each).select(id_, "x.label", "x.passed")


def archive_integrity(emails: DataFrame, author: Column, instant: str = "utc_us") -> DataFrame:
    """One row of counters; the archive is sound if the first four are zero. A date that
    states no instant is missing."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return emails.agg(
        F.count_if(empty("from_email")).alias("missing_from"), F.count_if(F.col(instant).isNull()).alias("missing_date"), F.count_if(empty("message_id")).alias("missing_id"),
        F.count_if(~F.coalesce(author, F.lit(False))).alias("other_authors"), F.count("*").alias("messages"),
    )
