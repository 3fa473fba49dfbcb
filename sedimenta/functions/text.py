"""Projections of text as Column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a mail list's footer rule.
FOOTER_RULE = "_" * 47
# Typographic dashes and quotes and the ASCII they stand for.
TYPOGRAPHIC, ASCII = "‐‑‒–—‘’“”", "-----''\"\""


def strip(c: Column) -> Column:
    """c without white space, of any kind, at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def bound(c: Column, use) -> Column:  # noqa: ANN001
    """use(c) with c computed once, however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def clean_body(c: Column) -> Column:
    """A mail body up to its signature or list footer, without quoted lines, runs of blank
    lines folded into one. A signature mark before anything else is kept as text."""
    index = F.transform(lines(c), lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.startswith(x, F.lit(">")).alias("q")))

    def kept(a: Column) -> Column:
        first = F.coalesce(F.array_min(F.transform(F.filter(a, lambda r: ~r["q"]), lambda r: r["i"])), F.lit(1 << 30))

        def upto(first: Column) -> Column:
            ends = F.filter(a, lambda r: ((r["i"] > first) & (F.length(r["x"]) <= 12) & (strip(r["x"]) == "--")) | F.startswith(r["x"], F.lit(FOOTER_RULE)))
            return F.coalesce(F.array_min(F.transform(ends, lambda r: r["i"])), F.size(a))

        stop = bound(first, upto)
        return bound(stop, lambda s: F.array_join(F.transform(F.filter(a, lambda r: (r["i"] < s) & ~r["q"]), lambda r: r["x"]), "\n"))

    return strip(F.regexp_replace(bound(index, kept), "\n{3,}", "\n\n"))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def year_text(instant: Column) -> Column:
    """The year in UTC of microseconds since 1970, four digits, or unknown."""
    return F.coalesce(F.date_format(F.timestamp_micros(instant), "yyyy"), F.lit("unknown"))


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def truncated(c: Column, n: int) -> Column:
    """c cut to n characters and marked where it was longer."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def plain_punctuation(c: Column) -> Column:
    return F.translate(c, TYPOGRAPHIC, ASCII)


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other; a later one sees what earlier ones wrote."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def file_name(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Base name in lower case, by its alias where it has one."""
    base = F.substring_index(F.lower(F.trim(c)), "/", -1)
    if not aliases:
        return base
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), base), base)


def location(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """(file, line) of text such as `a/b.c:12-14` or `lines 85, 127`."""
    pattern = r"^([\w./-]+\.\w+)\s*:\s*(.+)$"
    named = c.rlike(pattern)
    file = F.when(named, file_name(F.regexp_extract(c, pattern, 1), aliases))
    line = F.when(named, first_integer(F.regexp_extract(c, pattern, 2))).otherwise(first_integer(c))
    return F.struct(file.alias("file"), line.alias("line"))


def without_fences(c: Column) -> Column:
    """What a code fence around the whole text holds; the closing fence may be missing."""
    t = strip(c)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```\s*$", "")
    return F.when(F.startswith(t, F.lit("```")), strip(inner)).otherwise(c)


def looks_truncated(c: Column, least_tokens: int = 500, hash_ends: bool = True) -> Column:
    """Whether generated text seems cut off: too short by its length over four, or without
    an end of sentence, fence or rule."""
    t = strip(c)
    closed = t.rlike(r"(?:[.!?]|```|---)$") | (t.rlike(r"#$") if hash_ends else F.lit(False)) | t.rlike(r"[.!?)\]`]$")
    return t.isNull() | (t == "") | (F.length(t) / 4 < least_tokens) | ~closed


def from_header(name: Column, address: Column) -> Column:
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", address).otherwise(F.concat(name, F.lit(" <"), address, F.lit(">")))


def header_name(h: Column) -> Column:
    return F.when(h.contains("<"), F.trim(F.regexp_replace(F.regexp_extract(h, r"^(.*)<[^<]*$", 1), '"', ""))).otherwise("")


def header_address(h: Column) -> Column:
    return F.when(h.contains("<"), F.rtrim(F.substring_index(h, "<", -1), F.lit("> "))).otherwise(F.trim(h))


def content_words(c: Column, stop_words: list[str], least: int = 3) -> Column:
    """Lower-case words of at least so many letters that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z_]+)"), F.lit(1)), lambda w: (F.length(w) >= least) & ~w.isin(stop_words))


def json_response(c: Column, schema: str) -> Column:
    """A service's answer as a struct: code fences around it are taken off, what is no JSON
    is null."""
    t = without_fences(c)
    return F.from_json(F.when(F.try_parse_json(t).isNotNull(), t), schema)


def from_rule(c: Column) -> Column:
    """Text from its first line `---` on; empty where it has none."""
    at = F.expr("0") + F.instr(F.concat(F.lit("\n"), c, F.lit("\n")), "\n---\n")
    return F.when(at > 0, F.substring(c, at, F.length(c))).otherwise("")


def citations(c: Column, patterns: list[str]) -> Column:
    """How often any of the patterns occurs, in either case."""
    return F.coalesce(F.regexp_count(c, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns))), F.lit(0))
