"""mbox archives: a batch data source, the MIME parts of messages, and the way back."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sedimenta.session import open_folder

RAW = "file string, msg_index long, raw binary"
MESSAGE = "message_id string, from_name string, from_email string, date string, subject string, in_reply_to string, body string, to_addrs string, cc_addrs string"


class _Chunk(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class MboxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.chunk = int(options.get("chunkBytes", 64 << 20))

    def partitions(self) -> list[_Chunk]:
        """Chunks of a file, of the files of a folder, or of those whose names match the last part
        of the path, in any file system that a URI names."""
        from fnmatch import fnmatchcase

        from pyarrow import fs

        files, path = open_folder(self.path)
        pattern = "*"
        if "*" in path or "?" in path:
            path, _, pattern = path.rpartition("/")
        info = files.get_file_info(path)
        found = files.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        found = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and fnmatchcase(i.base_name, pattern))
        return [_Chunk(f, at, min(at + self.chunk, size)) for f, size in found for at in range(0, max(1, size), self.chunk)]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        """Messages that begin inside the chunk; the last is read past its end. A message is
        numbered by the position of its separator line."""
        files, _ = open_folder(self.path)
        with io.BufferedReader(files.open_input_file(partition.path), 1 << 20) as f:
            f.seek(max(0, partition.start - 1))
            if partition.start:
                f.readline()  # the rest of a line that began before
            start, lines, blank = None, [], True
            while True:
                at, line = f.tell(), f.readline()
                if not line or (line.startswith(b"From ") and b"@" in line[:80] and blank):
                    if start is not None:
                        yield (partition.path, start, b"".join(lines).rstrip(b"\n") + b"\n")
                    if not line or at >= partition.end:
                        return
                    start, lines = at, []
                elif start is not None:
                    lines.append(line)
                blank = line in (b"\n", b"\r\n") or start == at


class MboxSource(DataSource):
    """spark.read.format("sedimenta_mbox").load(path): one row for each message."""

    @classmethod
    def name(cls) -> str:
        return "sedimenta_mbox"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: object) -> MboxReader:
        return MboxReader(self.options)


def read_mbox(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MboxSource)
    return spark.read.format("sedimenta_mbox").options(**options).load(path)


def count_messages(spark: SparkSession, path: str) -> int:
    """Separator lines, without parsing anything."""
    v = F.col("value")
    return spark.read.text(path).filter(F.startswith(v, F.lit("From ")) & F.substring(v, 1, 80).contains("@")).count()


def parse_message(raw: bytes | None, all_parts: bool = False) -> tuple:
    """Fields of MESSAGE. Headers are decoded (RFC 2047), dates brought to ISO 8601 or the
    empty string, identifiers trimmed; the body is the first plain part, or all joined."""
    from email import message_from_bytes, policy
    from email.header import decode_header, make_header
    from email.utils import parseaddr, parsedate_to_datetime

    if not raw:
        return ("", "", "", "", "", None, "", "", "")
    m = message_from_bytes(re.sub(rb"(?m)^>(>*From )", rb"\1", raw.replace(b"\r\n", b"\n")), policy=policy.compat32)

    def header(name: str) -> str:
        value = m.get(name)
        if value is None:
            return ""
        try:
            return str(make_header(decode_header(str(value)))).strip()
        except (LookupError, UnicodeError, ValueError):
            return str(value).strip()

    def decoded(part: object) -> str:
        data = part.get_payload(decode=True) or b""
        try:
            return data.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            return data.decode("utf-8", "replace")

    name, address = parseaddr(header("From"))
    try:
        date = parsedate_to_datetime(header("Date")).isoformat()
    except (TypeError, ValueError, IndexError):
        date = ""
    plain = [p for p in m.walk() if p.get_content_type() == "text/plain" and not p.is_multipart()]
    body = "\n".join(map(decoded, plain)) if all_parts else decoded(plain[0]) if plain else ""
    return (header("Message-ID"), name, address, date, header("Subject"), header("In-Reply-To") or None, body, header("To"), header("Cc"))


def parsed(raw: DataFrame, all_parts: bool = False) -> DataFrame:
    """Messages as columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse_message(x, all_parts) for x in b["raw"]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGE.split(", ")])

    return raw.select("raw").mapInPandas(run, MESSAGE)


def escaped_body(body: Column, strict: bool = True) -> Column:
    """A body as an mbox holds it: lines that begin with From, or such with marks, get one
    more mark. Not strict: only the first two levels, as some archives do."""
    b = F.regexp_replace(body, "\r\n", "\n")
    return F.regexp_replace(b, "(?m)^(>*From )" if strict else "(?m)^(>?From )", ">$1")


def to_mbox(emails: DataFrame) -> DataFrame:
    """(delivery_id, value): each mail as mbox text with its separator line."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("From "), F.when(c("from_email") == "", "unknown@invalid").otherwise(c("from_email")), F.lit(" "), F.date_format("received_at", "EEE MMM dd HH:mm:ss yyyy")),
        F.concat(F.lit("Message-ID: "), c("message_id")), F.concat(F.lit("From: "), c("from_name"), F.lit(" <"), c("from_email"), F.lit(">")), F.concat(F.lit("Date: "), c("date")),
        F.concat(F.lit("Subject: "), c("subject")), F.concat(F.lit("In-Reply-To: "), c("in_reply_to")), F.lit("Content-Type: text/plain; charset=utf-8"), F.lit("Content-Transfer-Encoding: 8bit"), F.lit(""), escaped_body(c("body")), F.lit(""),
    )
    return emails.select("delivery_id", lines.alias("value"))
