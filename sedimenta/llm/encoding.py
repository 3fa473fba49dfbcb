"""Encode a corpus with a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern. Words are counted over the corpus, and
the frequent ones are compiled with their ids into a minimal acyclic automaton in which words
share suffixes; the path of a word numbers it, and the number leads to its ids. The automaton
is an array file that workers map into memory. Words are looked up many at a time, one byte
per step; words it doesn't hold are merged exactly, by the ranks of the vocabulary, so the
result is that of the tokenizer whatever the lexicon holds.

Defined results: null and empty texts have no ids (an empty list); strings of special tokens
in a text are ordinary text; lone surrogates count as U+FFFD.
"""

from __future__ import annotations

import base64
import io
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.session import put

#: Words that the automaton holds at most, and times a word must occur. All others are merged.
LEXICON_WORDS, LEXICON_LEAST = 100_000, 2
#: Vocabulary of the tokenizer.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer cuts texts into words (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Merger:
    """Merges the bytes of a word by the ranks of a vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.kept: dict[bytes, list[int]] = {}

    def ids(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        known = self.kept.get(word)
        if known is not None:
            return known
        out = self._merged(word)
        if len(word) <= 64:
            if len(self.kept) > 300_000:
                self.kept.clear()
            self.kept[word] = out
        return out

    def _merged(self, word: bytes) -> list[int]:
        """Pairs of lowest rank first, of equal ones the leftmost, with a heap over a linked
        list: long words take n log n steps."""
        import heapq

        ranks, n = self.ranks, len(word)
        piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, piece[i], piece[i + 1]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if piece[i] is not None else n
            if j >= n or piece[i] != a or piece[j] != b:
                continue
            piece[i], piece[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                k = after[i]
                if (r := ranks.get(piece[i] + piece[k])) is not None:
                    heapq.heappush(heap, (r, i, piece[i], piece[k]))
            if before[i] >= 0:
                h = before[i]
                if (r := ranks.get(piece[h] + piece[i])) is not None:
                    heapq.heappush(heap, (r, h, piece[h], piece[i]))
        return [ranks[p] for p in piece if p is not None]


class _State:
    __slots__ = ("edges", "final", "number", "words")

    def __init__(self) -> None:
        self.edges: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = 0


def build_automaton(entries: list[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic automaton of words with their ids. Words are added in
    order; behind each, states that no later word can change are replaced by equal ones."""
    entries = sorted(entries)
    root, register = _State(), {}
    path: list[tuple[_State, int, _State]] = []
    last = b""

    def freeze(down_to: int) -> None:
        while len(path) > down_to:
            parent, label, child = path.pop()
            key = (child.final, tuple((b, id(s)) for b, s in child.edges.items()))
            same = register.get(key)
            if same is None:
                register[key] = child
            else:
                parent.edges[label] = same

    for word, _ in entries:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        freeze(shared)
        state = path[-1][2] if path else root
        for b in word[shared:]:
            new = _State()
            state.edges[b] = new
            path.append((state, b, new))
            state = new
        state.final = True
        last = word
    freeze(0)

    order: list[_State] = []
    stack: list[tuple[_State, bool]] = [(root, False)]
    while stack:  # children first
        s, done = stack.pop()
        if s.number >= 0:
            continue
        if done:
            s.number = len(order)
            s.words = s.final + sum(x.words for x in s.edges.values())
            order.append(s)
        else:
            stack.append((s, True))
            stack += [(x, False) for x in s.edges.values() if x.number < 0]
    keys, targets, skips = [], [], []
    for s in order:
        skip = int(s.final)
        for b, x in sorted(s.edges.items()):
            keys.append(s.number * 256 + b)
            targets.append(x.number)
            skips.append(skip)
            skip += x.words
    lengths = np.array([len(i) for _, i in entries], np.int64)
    return {
        "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "skips": np.array(skips, np.int32), "final": np.array([s.final for s in order], np.uint8),
        "starts": np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), "ids": np.array([i for _, x in entries for i in x], np.int32), "root": np.array([root.number], np.int64),
    }


_PARTS = ["keys", "targets", "skips", "final", "starts", "ids", "root"]


def save_automaton(arrays: dict[str, np.ndarray], f: BinaryIO) -> None:
    for name in _PARTS:
        np.save(f, arrays[name])


class Lexicon:
    """An automaton mapped into memory."""

    def __init__(self, path: str) -> None:
        self.a: dict[str, np.ndarray] = {}
        with open(path, "rb") as f:
            for name in _PARTS:
                np.lib.format.read_magic(f)
                shape, _, kind = np.lib.format.read_array_header_1_0(f)
                at, n = f.tell(), int(np.prod(shape))
                self.a[name] = np.memmap(path, kind, "r", at, shape) if n else np.zeros(shape, kind)
                f.seek(at + n * kind.itemsize)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that it doesn't hold. All words advance by
        one byte per step."""
        keys, n = self.a["keys"], len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(keys):
            return out
        lengths = np.array([len(w) for w in words])
        starts = np.concatenate(([0], np.cumsum(lengths)))
        data = np.frombuffer(b"".join(words), np.uint8)
        alive, state, number = np.flatnonzero(lengths), np.full(n, int(self.a["root"][0]), np.int64), np.zeros(n, np.int64)
        step = 0
        while len(alive):
            want = state[alive] * 256 + data[starts[alive] + step]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            ok = keys[at] == want
            alive, at = alive[ok], at[ok]
            number[alive] += self.a["skips"][at]
            state[alive] = self.a["targets"][at]
            step += 1
            ended = lengths[alive] == step
            done = alive[ended]
            out[done] = np.where(self.a["final"][state[done]] == 1, number[done], -1)
            alive = alive[~ended]
        return out


def words_of(text: str, pattern: regex.Pattern) -> list[str]:
    return pattern.findall(text)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, n = regex.compile(PATTERN), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w, k in Counter(pattern.findall(text)).items():
                    n[w.encode("utf-8", "replace")] += k
            if len(n) > 500_000:  # a memory bound for the task; sums are completed behind the shuffle
                yield out()
                n.clear()
        yield out()

    return docs.select("text").filter("text <> ''").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def given_vocabulary(spark: SparkSession, path: str) -> str:
    """Name of the vocabulary file, given to all workers through the shared folder; only the
    driver needs the path."""
    with open(path, "rb") as f:
        uri = put(spark, f"{uuid.uuid4().hex}.vocabulary", f.read())
    spark.sparkContext.addFile(uri)
    return uri.rsplit("/", 1)[-1]


def compile_lexicon(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS) -> str:
    """Name of the automaton file given to all workers."""
    spark = docs.sparkSession
    top = count_words(docs).filter(F.col("n") >= LEXICON_LEAST).orderBy(F.desc("n"), "word").limit(words)
    merger = Merger(vocabulary)
    entries = [(bytes(r["word"]), merger.ids(bytes(r["word"]))) for r in top.select("word").collect()]  # at most so many words
    held = io.BytesIO()
    save_automaton(build_automaton(entries), held)
    uri = put(spark, f"{uuid.uuid4().hex}.lexicon", held.getvalue())
    spark.sparkContext.addFile(uri)
    return uri.rsplit("/", 1)[-1]


class Encoder:
    """Ids of texts, by a lexicon where there is one."""

    def __init__(self, lexicon: str | None, vocabulary: str) -> None:
        self.lexicon, self.merger = Lexicon(lexicon) if lexicon else None, Merger(vocabulary)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def learn(self, words: set[str]) -> None:
        """Ids of words not seen before in this task."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > 1_000_000:
            self.known.clear()
            new = list(words)
        raw = [w.encode("utf-8", "replace") for w in new]
        if self.lexicon is None:
            self.known.update(zip(new, map(self.merger.ids, raw), strict=True))
            return
        numbers = self.lexicon.numbers(raw)
        starts, ids = self.lexicon.a["starts"], self.lexicon.a["ids"]
        for w, b, k in zip(new, raw, numbers.tolist(), strict=True):
            self.known[w] = ids[starts[k] : starts[k + 1]].tolist() if k >= 0 else self.merger.ids(b)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        self.learn({w for c in cut for w in c})
        known = self.known
        return [[i for w in c for i in known[w]] for c in cut]


_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, only_lengths: bool = False) -> DataFrame:
    """(doc_id, ids), or (doc_id, n_tokens), of every document. Lengths need each word once a
    task; counting the words of the corpus for a lexicon first would read it twice."""
    name = "" if only_lengths else compile_lexicon(docs, vocabulary)
    ranks = given_vocabulary(docs.sparkSession, vocabulary)
    kind = "doc_id long, n_tokens long" if only_lengths else "doc_id long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(ranks)
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[ranks] = Encoder(SparkFiles.get(name) if name else None, SparkFiles.get(ranks))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # batches of results stay small
                part = batch.slice(at, 500)
                ids = encoder.encode(part.column(1).to_pylist())
                second = pa.array([len(x) for x in ids], pa.int64()) if only_lengths else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), second], ["doc_id", "n_tokens" if only_lengths else "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, kind)
