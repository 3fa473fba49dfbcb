"""External row mappers: a record goes in, an annotation comes out. A mapper is a parameter
of a plan; results are written once and everything else is derived from what was written.
Errors are values of rows, never failures of the job."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

RESULT = "key string, moves array<struct<trigger:string,principle:string,response:string,severity:string,category:string>>, error string"


class Retryable(Exception):
    """An answer worth asking again for; slow: the service asks for patience."""

    def __init__(self, why: str, slow: bool = False) -> None:
        super().__init__(why)
        self.slow = slow


@dataclass(frozen=True)
class Retry:
    """attempts, and waits that grow with each, doubled where the service asks for it."""

    attempts: int = 3
    delay: float = 1.0
    jitter: float = 0.5

    def run(self, ask: Callable[[], list[dict]], sleep: Callable[[float], None] = time.sleep) -> list[dict]:
        for i in range(self.attempts):
            try:
                return ask()
            except Retryable as e:
                if i + 1 == self.attempts:
                    raise
                sleep((2 if e.slow else 1) * self.delay * (i + 1) + random.random() * self.jitter)
        return []


class Mapper(Protocol):
    def __call__(self, key: str, text: str) -> list[dict]: ...


@dataclass(frozen=True)
class RuleMapper:
    """Moves by patterns: (pattern, category, severity). A deterministic stand-in for a
    service."""

    rules: tuple[tuple[str, str, str], ...] = field(default=())

    def __call__(self, key: str, text: str) -> list[dict]:
        import re

        out = []
        for pattern, category, severity in self.rules:
            for m in re.finditer(pattern, text):
                out.append({"trigger": m.group(0), "principle": pattern, "response": text[max(0, m.start() - 40) : m.end() + 40], "severity": severity, "category": category})
        return out


@dataclass(frozen=True)
class Fallback:
    """Mappers asked in turn until one answers without an error."""

    mappers: tuple[Mapper, ...]

    def __call__(self, key: str, text: str) -> list[dict]:
        last: Exception | None = None
        for m in self.mappers:
            try:
                return m(key, text)
            except Exception as e:  # noqa: BLE001
                last = e
        if last is not None:
            raise last
        return []


def observed(results: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """results, and counters of records, moves and errors that are known when they are
    written; no second pass."""
    o = Observation(name)
    moves = F.coalesce(F.size("moves"), F.lit(0))
    return results.observe(o, F.count(F.lit(1)).alias("records"), F.sum(F.when(moves > 0, moves).otherwise(0)).alias("moves"), F.count_if(F.col("error").isNotNull()).alias("errors")), o


def annotate(rows: DataFrame, key: str, text: str, mapper: Mapper, most_chars: int = 8000, workers: int = 4, retry: Retry = Retry(), tasks: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, moves, error) and the columns to keep, all strings. Texts are cut to what the service reads; filters belong before
    this step, as none is pushed through it. tasks bounds how many tasks call at a time."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def one(k: str, t: str) -> tuple:
            try:
                return k, retry.run(lambda: mapper(k, t)), None
            except Exception as e:  # noqa: BLE001
                return k, [], f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                out = pd.DataFrame(list(pool.map(one, b["key"], b["text"])), columns=["key", "moves", "error"])
                yield out.assign(**{c: b[c].to_numpy() for c in keep})

    r = rows.select(*keep, F.col(key).cast("string").alias("key"), F.left(F.coalesce(F.col(text), F.lit("")), F.lit(most_chars)).alias("text"))
    return (r.repartition(tasks) if tasks else r).mapInPandas(run, ", ".join([RESULT, *(f"{c} string" for c in keep)]))


def replay(rows: DataFrame, key: str, stored: DataFrame) -> DataFrame:
    """Annotations from a table of stored results; keys without one get an error."""
    return rows.select(F.col(key).cast("string").alias("key")).join(stored, "key", "left").select("key", "moves", F.when(F.col("moves").isNull(), F.coalesce("error", F.lit("no stored result"))).otherwise(F.col("error")).alias("error"))
