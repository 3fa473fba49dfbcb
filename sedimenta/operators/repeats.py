"""Keep one copy of each record that was delivered at least once.

Only identifier, delivery order and file-row position are shuffled. The smallest
(order, file, row) of an identifier is found by a partially aggregated minimum, so an
identifier that holds a third of all rows is reduced to one row per map task before the
shuffle. The winners become one vector of bits for each file, written into the shared folder;
whoever reads rows of a file opens that file's vector and deletes what has an identifier but
no bit. Wide rows pass from the scan through that filter: they are joined with nothing and
shuffled nowhere, however many files and rows there are.

Defined results: rows whose identifier is null, empty or blank repeat nothing and stay, as
do rows with any other key column null; of rows that agree in the delivery order too, the
first by file and row stays; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.session import open_folder, shared_folder

#: Rows that one stretch of a vector covers (fixed by Spark's bitmap functions), and its bytes.
BITMAP_ROWS, BITMAP_BYTES = 32768, 4096

_FILE, _ROW, _PART, _BITS = "__file", "__row", "__part", "__bits"


@dataclass(frozen=True)
class Source:
    """A Parquet table to be freed from repeats: path, the columns that identify a record
    (expressions; null in any means that the row repeats nothing) and the delivery order."""

    name: str
    path: str
    keys: tuple[Column, ...]
    order: Column


def positions(spark: SparkSession, s: Source) -> DataFrame:
    """Identifier columns k0.., order, file and row of each row; nothing else is read."""
    raw = spark.read.parquet(s.path)
    return raw.select(
        F.lit(s.name).alias("tab"),
        *[k.cast("string").alias(f"k{i}") for i, k in enumerate(s.keys)],
        s.order.cast("bigint").alias("row_id"),
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.row_index").alias(_ROW),
    )


def winner_bitmaps(narrow: DataFrame, n_keys: int) -> DataFrame:
    """(file, part, bits): a bit for each row that stays although it has an identifier. Files
    are named by the hash of their path."""
    keys = [f"k{i}" for i in range(n_keys)]
    named = narrow.dropna(subset=keys)
    won = named.groupBy("tab", *keys).agg(F.min(F.struct("row_id", _FILE, _ROW)).alias("w"))
    won = won.select(F.xxhash64(f"w.{_FILE}").alias(_FILE), F.col(f"w.{_ROW}").alias(_ROW)).withColumn(_PART, F.expr(f"bitmap_bucket_number({_ROW} + 1)"))
    return won.groupBy(_FILE, _PART).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({_ROW} + 1))").alias(_BITS))


def _put(files: FileSystem, mine: str, final: str) -> None:
    """Give a file its name; another run of the same task may have done so, with the same bits."""
    try:
        files.move(mine, final)
    except OSError:
        if files.get_file_info(final).type == FileType.NotFound:
            raise
        files.delete_file(mine)


def write_vectors(bitmaps: DataFrame) -> str:
    """Write the stretches of each file's vector one after the other into a file of the shared
    folder; returns the folder. A task that runs again writes the same."""
    folder = f"{shared_folder(bitmaps.sparkSession).rstrip('/')}/vectors-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        out, name, upto, mine = None, None, 0, f"{root}/.{uuid.uuid4().hex}"
        for batch in batches:
            for file, part, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if out is not None:
                        out.close()
                        _put(files, mine, f"{root}/{name}")
                    out, name, upto = files.open_output_stream(mine), file, 0
                part -= 1  # stretches count from 1
                for _ in range(upto, part):
                    out.write(bytes(BITMAP_BYTES))
                out.write(bits)
                upto = part + 1
        if out is not None:
            out.close()
            _put(files, mine, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name or 0], pa.int64())], ["file"])

    b = bitmaps.select(_FILE, _PART, _BITS).repartition(_FILE).sortWithinPartitions(_FILE, _PART)
    b.mapInArrow(write, "file long").write.format("noop").mode("overwrite").save()
    return folder


_opened: dict[tuple[str, int], np.ndarray] = {}


def _vector(folder: str, file: int) -> np.ndarray:
    """Bits of a file; a file without winners has none. The last one stays open."""
    if (folder, file) not in _opened:
        files, root = open_folder(folder)
        try:
            with files.open_input_stream(f"{root}/{file}") as f:
                data = np.frombuffer(f.read(), np.uint8)
        except FileNotFoundError:
            data = np.zeros(0, np.uint8)
        _opened.clear()
        _opened[folder, file] = data
    return _opened[folder, file]


def stays(folder: str) -> Column:
    """Whether the row at a position (columns file and row) has a bit. Only the position
    leaves the JVM; the other columns of a row wait there."""

    @F.pandas_udf("boolean")
    def has_bit(file: pd.Series, row: pd.Series) -> pd.Series:
        at, out = row.to_numpy(np.int64), np.zeros(len(row), bool)
        names = file.to_numpy(np.int64)
        for name in np.unique(names):
            mine = np.flatnonzero(names == name)
            bits = _vector(folder, int(name))
            inside = mine[at[mine] >> 3 < len(bits)]
            out[inside] = (bits[at[inside] >> 3] >> (at[inside] & 7)) & 1 == 1
        return pd.Series(out)

    return has_bit(F.xxhash64(_FILE), F.col(_ROW))


def find_repeats(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(tab, row_id): every row that repeats a row delivered before it."""
    most = max(len(s.keys) for s in sources)
    narrow = None
    for s in sources:
        p = positions(spark, s)
        for i in range(len(s.keys), most):
            p = p.withColumn(f"k{i}", F.lit(""))
        narrow = p if narrow is None else narrow.unionByName(p)
    folder = write_vectors(winner_bitmaps(narrow, most))
    named = narrow.dropna(subset=[f"k{i}" for i in range(most)]).select("tab", "row_id", _FILE, _ROW)
    return named.filter(~stays(folder)).select("tab", "row_id")


def drop_repeats(spark: SparkSession, s: Source) -> DataFrame:
    """The table with one copy of each record."""
    folder = write_vectors(winner_bitmaps(positions(spark, s), len(s.keys)))
    raw = spark.read.parquet(s.path)
    named = F.lit(True)
    for k in s.keys:
        named &= k.isNotNull()
    wide = raw.select("*", named.alias("__named"), F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
    return wide.withColumn("__stays", stays(folder)).filter("not __named or __stays").select(*raw.columns)
