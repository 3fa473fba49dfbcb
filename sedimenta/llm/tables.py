"""Tables of words too many for a broadcast: sorted files of hashes and flags, written once into
the shared folder and mapped into memory by the workers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from sedimenta.session import open_folder, put, shared_folder

_ROW = np.dtype([("hash", "<u8"), ("flags", "u1")])
#: Words whose flags a worker keeps.
KEPT = 500_000


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class WordTable:
    """Flags of words, 0 for words that aren't there."""

    def __init__(self, rows: np.ndarray) -> None:
        self.hashes, self.flags = rows["hash"], rows["flags"]
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, words: dict[str, int]) -> WordTable:
        return cls(np.array(sorted((word_hash(w), f) for w, f in words.items()), _ROW))

    @classmethod
    def mapped(cls, path: str) -> WordTable:
        with open(path, "rb") as f:
            empty = not f.read(1)
        return cls(np.zeros(0, _ROW) if empty else np.memmap(path, _ROW, "r"))

    def __getitem__(self, word: str) -> int:
        f = self.known.get(word)
        if f is None:
            if len(self.known) > KEPT:
                self.known.clear()
            h = np.uint64(word_hash(word))
            at = int(np.searchsorted(self.hashes, h))
            f = self.known[word] = int(self.flags[at]) if at < len(self.hashes) and self.hashes[at] == h else 0
        return f


def write_words(words: DataFrame) -> str:
    """Write (word, flags), flags of the same word joined, and give the file to all workers.
    Returns its name. One task writes it; it holds nine bytes a word."""
    spark = words.sparkSession
    name, folder = f"{uuid.uuid4().hex}.words", shared_folder(spark).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            rows = np.zeros(batch.num_rows, _ROW)
            rows["hash"] = [word_hash(w) for w in batch.column(0).to_pylist()]
            rows["flags"] = batch.column(1).to_numpy()
            parts.append(rows)
        rows = np.sort(np.concatenate(parts or [np.zeros(0, _ROW)]), order="hash")
        first = np.flatnonzero(np.concatenate(([True], rows["hash"][1:] != rows["hash"][:-1])))[: len(rows)]
        merged = rows[first]
        if len(rows):
            merged["flags"] = np.bitwise_or.reduceat(rows["flags"], first)
        files, root = open_folder(folder)
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(merged.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([len(merged)], pa.int64())], ["n"])

    put(spark, name, b"")  # what stands there if there is no word
    words.repartition(1).mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


_tables: dict[str, WordTable] = {}


def table_of(name: str) -> WordTable:
    """The table of a file that was given to the workers."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = WordTable.mapped(SparkFiles.get(name))
    return _tables[name]
