"""A news server's group as a data source. The client is a parameter: anything with
`headers(first, last)` and `article(number)`, such as NewsClient, which speaks the protocol."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Articles whose headers one request asks for.
BATCH = 50_000


class Client(Protocol):
    def headers(self, first: int, last: int) -> list[str]: ...
    def article(self, number: int) -> bytes: ...


class NewsError(OSError):
    """What the server refused."""


class NewsClient:
    """A connection to a news server; use it in a with statement. Answers of several lines end
    with a lone dot, and lines that begin with a dot got another one on their way."""

    def __init__(self, host: str, port: int = 119, timeout: float = 60.0, header: str = "From") -> None:
        self.header = header
        self.socket = socket.create_connection((host, port), timeout)
        self.lines = self.socket.makefile("rb")
        self._status()

    def __enter__(self) -> NewsClient:
        return self

    def __exit__(self, *_: object) -> None:
        try:
            self._ask("QUIT")
        except OSError:
            pass
        self.lines.close()
        self.socket.close()

    def _status(self) -> str:
        line = self.lines.readline()
        if not line.endswith(b"\n"):
            raise ConnectionError("the server closed the connection")
        status = line.decode("utf-8", "replace").strip()
        if status[:1] in ("4", "5"):
            raise NewsError(status)
        return status

    def _ask(self, command: str) -> str:
        self.socket.sendall(f"{command}\r\n".encode())
        return self._status()

    def _text(self) -> Iterator[bytes]:
        for line in self.lines:
            line = line.rstrip(b"\r\n")
            if line == b".":
                return
            yield line[1:] if line.startswith(b"..") else line
        raise ConnectionError("the server closed the connection within a text")

    def group(self, name: str) -> tuple[int, int, int]:
        """(articles, first number, last number)."""
        _, count, first, last, *_ = self._ask(f"GROUP {name}").split()
        return int(count), int(first), int(last)

    def headers(self, first: int, last: int) -> list[str]:
        self._ask(f"XHDR {self.header} {first}-{last}")
        return [x.decode("utf-8", "replace") for x in self._text()]

    def article(self, number: int) -> bytes:
        self._ask(f"ARTICLE {number}")
        return b"\n".join(self._text()) + b"\n"


def header_number(line: Column) -> Column:
    """Number of a header line `number text`; null where it is none."""
    return F.split(line, r"\s+", 2)[0].try_cast("bigint")


def header_text(line: Column) -> Column:
    return F.try_element_at(F.split(line, r"\s+", 2), F.lit(2))


def discover(spark: SparkSession, first: int, last: int, connect: Callable[[], Client], sender: str, batch: int = BATCH) -> DataFrame:
    """(number, text) of articles whose header names a sender, a range of numbers a task. A
    range that fails twice is skipped and returned with null text."""
    ranges = spark.range(first, last + 1, batch).select(F.col("id").alias("lo"), F.least(F.col("id") + batch - 1, F.lit(last)).alias("hi")).repartition(max(1, (last - first) // batch))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in zip(b["lo"], b["hi"], strict=True):
                for attempt in range(2):
                    try:
                        yield pd.DataFrame({"line": connect().headers(int(lo), int(hi))}, dtype="str")
                        break
                    except OSError:
                        if attempt:
                            yield pd.DataFrame({"line": [f"{lo}"]})

    lines = ranges.mapInPandas(scan, "line string")
    found = lines.select(header_number(F.col("line")).alias("number"), header_text(F.col("line")).alias("text"))
    return found.filter(F.col("number").isNotNull() & F.coalesce(F.lower("text").contains(sender.lower()), F.lit(True))).dropDuplicates(["number"])


def fetch(numbers: DataFrame, stored: DataFrame, connect: Callable[[], Client]) -> DataFrame:
    """(number, raw, error) of articles that aren't stored yet, by number, not by count."""
    todo = numbers.select("number").join(stored.select("number"), "number", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for b in batches:
            rows = []
            for n in b["number"]:
                raw, error = None, None
                for attempt in range(2):
                    try:
                        client = client or connect()
                        raw, error = client.article(int(n)), None
                        break
                    except OSError as e:
                        client, error = None, str(e)
                rows.append((int(n), raw, error))
            yield pd.DataFrame(rows, columns=["number", "raw", "error"])

    return todo.mapInPandas(run, "number long, raw binary, error string")


def scanned_to(spark: SparkSession, path: str, first: int) -> int:
    """The first number that no scan recorded under path has covered."""
    try:
        done = spark.read.schema("lo bigint, hi bigint").json(f"{path}/scanned").filter(F.col("hi") >= first)
        return max(first, (done.agg(F.max("hi")).first()[0] or first - 1) + 1)
    except AnalysisException:
        return first


def discover_on(spark: SparkSession, path: str, first: int, last: int, connect: Callable[[], Client], sender: str, batch: int = BATCH) -> int:
    """Go on with a scan: numbers that weren't scanned yet are, what is found is added to
    `path/found`, and how far the scan came is recorded behind that. Returns the last number."""
    at = scanned_to(spark, path, first)
    if at <= last:
        discover(spark, at, last, connect, sender, batch).write.mode("append").json(f"{path}/found")
        spark.createDataFrame([(at, last)], "lo bigint, hi bigint").write.mode("append").json(f"{path}/scanned")
    return last
