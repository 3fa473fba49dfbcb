"""Web pages and interview files that were fetched before; fetching itself needs a network
and is a pluggable function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements whose text isn't read, and those that begin and end a line.
HIDDEN = {"script", "style", "nav", "footer", "header", "head", "form"}
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "div", "span"}
#: A comment, a tag (closing or opening, with its name), a declaration, or text.
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?:"[^"]*"|'[^']*'|[^"'>])*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}


def visible_text(page: str | None) -> str | None:
    """Text of a page that a reader sees, line elements apart; null stays null. The page is
    read as a stream of tokens; a stack holds the hidden elements that are open."""
    if page is None:
        return None
    hidden: list[str] = []
    shown: list[str] = []
    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        name = (token["name"] or "").lower()
        if name in HIDDEN:
            if not token["end"]:
                hidden.append(name)
                if name in _RAW_END:  # markup means nothing in there
                    close = _RAW_END[name].search(page, at)
                    at = close.start() if close else len(page)
            elif hidden:
                hidden.pop()
        elif hidden:
            continue
        elif name in LINES:
            shown.append("\n")
        elif token[0][0] != "<" or token[0] == "<":
            shown.append(unescape(token[0]).strip())
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(filter(None, shown)))).strip()


def html_text(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(visible_text)

    return run(c)


def fetched(sources: DataFrame, fetch: Callable[[str], str], least_chars: int = 100) -> DataFrame:
    """(id, url, text, error): pages by a fetch function. Videos, failures and pages with too
    little text are errors of their rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, url in zip(b["id"], b["url"], strict=True):
                text, error = None, None
                if "youtube.com" in url or "youtu.be" in url:
                    error = "video"
                else:
                    try:
                        text = visible_text(fetch(url)) or ""
                        if len(text) < least_chars:
                            text, error = None, "too short"
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                rows.append((i, url, text, error))
            yield pd.DataFrame(rows, columns=["id", "url", "text", "error"])

    return sources.select("id", F.coalesce("url", F.lit("")).alias("url")).mapInPandas(run, "id string, url string, text string, error string")


def interview_file(id_: Column, title: Column, date: Column, url: Column, kind: Column, text: Column) -> Column:
    """The Markdown form of an interview: title, fields, a rule, the text."""
    field = lambda k, v: F.concat(F.lit(f"**{k}:** "), F.coalesce(v, F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(title, F.lit(""))), F.lit(""), field("Source", id_), field("Date", date), field("URL", url), field("Type", kind), F.lit(""), F.lit("---"), F.lit(""), text)


def parse_interview(content: Column) -> Column:
    """struct(title, source, date, url, kind, text) of such a file."""
    head = F.substring_index(content, "\n---\n", 1)
    get = lambda k: F.regexp_extract(head, rf"\*\*{k}:\*\* (.*)", 1)
    body = F.when(content.contains("\n---\n"), F.trim(F.regexp_replace(F.substr(content, F.length(head) + 6), r"^\n+|\n+$", ""))).otherwise(content)
    return F.struct(F.regexp_extract(head, r"^# (.*)", 1).alias("title"), get("Source").alias("source"), get("Date").alias("date"), get("URL").alias("url"), get("Type").alias("kind"), body.alias("text"))


def load_interviews(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), "value")
    return files.select("file", parse_interview(F.col("value")).alias("i")).select("file", "i.*")
