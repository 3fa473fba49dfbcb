"""Find text that was decoded with the wrong character encoding, and restore it.

Statistics of adjacent characters are counted over the whole corpus and give each pair a
mutual information. Damaged text shows as runs of improbable pairs, which maximum-scoring
segments isolate. Only inside these runs are inverse mappings tested: encode with the codec
that was used by mistake, decode with one that may have been meant. A mapping holds if the
corpus model finds its result much likelier than what stands there; it is applied again, as
text may have been damaged twice.

The pair table has a fixed number of slots into which pairs are hashed, so what reaches the
driver and the workers is bounded whatever the corpus. All thresholds are relative
frequencies or likelihood ratios; the result doesn't depend on the size of the corpus.

Defined results: null and empty values are never damaged; a value with the replacement
character U+FFFD is damaged, and what can be restored of it is; pure ASCII is never damaged,
as all mappings keep it; rows with the same id are judged one by one.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the pair table and of the character table (powers of two).
PAIR_BITS, CHAR_BITS = 22, 17
#: Pairs are improbable below this relative frequency unless their characters explain it.
RARE = 2e-5
#: Natural logarithm of the likelihood ratio from which a mapping holds, and times so many a
#: second time.
GAIN = 3.0

#: Codecs that mail programs confuse. Fixed values.
SINGLE = ["cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "mac_roman"]
MULTI = ["utf-8", "gbk", "euc_jp", "cp932"]
WRONG = [*SINGLE, "gbk"]
#: Stands between values.
BOUND = "\x1f"
LOST = "�"


def _charmap(codec: str) -> tuple[str, dict[int, int]]:
    """Decoding table and encoding map; undefined bytes stay control characters."""
    table = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
    return table, {ord(c): b for b, c in reversed(list(enumerate(table)))}


_MAPS = {c: _charmap(c) for c in SINGLE}


#: What a byte order mark of UTF-8 looks like, read by each codec; longest first.
MARKS = sorted({"\ufeff".encode().decode("latin-1"), *(codecs.charmap_decode(b"\xef\xbb\xbf", "strict", m[0])[0] for m in _MAPS.values())}, key=len, reverse=True)


def encode(text: str, codec: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _MAPS[codec][1])[0] if codec in _MAPS else text.encode(codec)
    except (UnicodeError, LookupError):
        return None


def decode(raw: bytes, codec: str) -> str | None:
    try:
        return codecs.charmap_decode(raw, "strict", _MAPS[codec][0])[0] if codec in _MAPS else raw.decode(codec)
    except (UnicodeError, LookupError):
        return None


def decode_between(raw: bytes, codec: str, left: bool, right: bool) -> tuple[str, int, int] | None:
    """(text, bytes cut off at the start, at the end): as decode, but where a lost character
    stands beside, a sequence that it broke is cut off, the fewest bytes that are enough."""
    for n in range(7 if codec in MULTI else 1):
        for i in range(max(0, n - 3), min(n, 3) + 1):
            j = n - i
            if (i and not left) or (j and not right) or n >= len(raw):
                continue
            if (out := decode(raw[i : len(raw) - j], codec)) is not None:
                return out, i, j
    return None


def code_points(text: str) -> np.ndarray:
    """Code points, line ends as blanks: where a line was wrapped tells nothing."""
    return np.frombuffer(text.replace("\n", " ").replace("\r", " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B) + np.uint32(0xC2B2AE35))) >> np.uint32(32 - PAIR_BITS)


def char_slots(a: np.ndarray) -> np.ndarray:
    return a & np.uint32((1 << CHAR_BITS) - 1)


def count_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(slot, n): how often each pair slot and, above them, each character slot occurs in
    all values of the columns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 << PAIR_BITS) + (1 << CHAR_BITS), np.int64)
        for batch in batches:
            for column in batch.columns:
                values = [v for v in column.to_pylist() if v]
                if not values:
                    continue
                for at in range(0, len(values), 2000):
                    cp = code_points(BOUND.join(values[at : at + 2000]) + BOUND)
                    slots, k = np.unique(pair_slots(cp[:-1], cp[1:]), return_counts=True)
                    n[slots] += k
                    slots, k = np.unique(char_slots(cp), return_counts=True)
                    n[slots.astype(np.int64) + (1 << PAIR_BITS)] += k
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], ["slot", "n"])

    counted = df.select(*columns).mapInArrow(count, "slot long, n long")
    return counted.groupBy("slot").agg(F.sum("n").alias("n"))


def script(c: str) -> str:
    """Latin, Greek, Cyrillic or other for letters; nothing for other characters."""
    if not c.isalpha():
        return ""
    cp = ord(c)
    return "L" if cp < 0x250 else "G" if 0x370 <= cp < 0x400 else "C" if 0x400 <= cp < 0x530 else "o"


def fits(out: str, left: str, right: str, before: str, behind: str) -> bool:
    """Whether restored text may stand there: no word mixes alphabets, and a letter or two of
    another alphabet than Latin need one beside them, where blanks may lie between. left,
    right: the next characters; before, behind: the next that are no blanks."""
    for own, other in ((out[:1], left), (out[-1:], right)):
        a, b = script(own), script(other)
        if a != b and a in ("L", "G", "C") and b in ("L", "G", "C"):
            return False
    letters = [script(c) for c in out if c.isalpha()]
    if letters and len(letters) <= 2 and letters[0] != "L":
        return script(before) == letters[0] or script(behind) == letters[0]
    return True


class _Logs(dict):
    """Logarithms of the relative frequencies of characters, looked up once each."""

    def __init__(self, table: np.ndarray) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, c: str) -> float:
        v = self[c] = float(self.table[ord(c) & ((1 << CHAR_BITS) - 1)])
        return v


class Model:
    """Pair and character statistics of a corpus."""

    def __init__(self, slots: np.ndarray, n: np.ndarray) -> None:
        pairs = slots < (1 << PAIR_BITS)
        self.total = max(1.0, float(n[pairs].sum()))
        self.pair = np.full(1 << PAIR_BITS, math.log(0.5 / self.total), np.float32)
        self.pair[slots[pairs]] = np.log(n[pairs] / self.total)
        self.char = np.full(1 << CHAR_BITS, math.log(0.05 / self.total), np.float32)
        self.char[slots[~pairs] - (1 << PAIR_BITS)] = np.log(n[~pairs] / self.total)
        self.logs = _Logs(self.char)
        self.cost: dict[tuple[str, str], float] = {}
        self.seen: dict[tuple[str, str, str], tuple[float, str] | None] = {}

    def improbability(self, cp: np.ndarray) -> np.ndarray:
        """For each adjacent pair minus its mutual information, where a pair counts as
        expected at least RARE times; at most 0 for pairs of ASCII."""
        a, b = cp[:-1], cp[1:]
        pa_, pb = self.char[char_slots(a)], self.char[char_slots(b)]
        # pairs that share a slot are bounded by their characters
        x = np.maximum(pa_ + pb, np.float32(math.log(RARE))) - np.minimum(self.pair[pair_slots(a, b)], np.minimum(pa_, pb))
        x[(a < 128) & (b < 128)] = np.minimum(x[(a < 128) & (b < 128)], np.float32(-0.5))
        return x

    def likelihood(self, text: str) -> float:
        """Logarithm of the probability of all characters but the first, each given the one
        before it."""
        if len(text) > 200:
            return float(self._given(code_points(text)).sum())
        cost, total = self.cost, 0.0
        for pair in zip(text, text[1:], strict=False):
            c = cost.get(pair)
            if c is None:
                if len(cost) > 500_000:
                    cost.clear()
                c = cost[pair] = float(self._given(code_points(pair[0] + pair[1]))[0])
            total += c
        return total

    def _given(self, cp: np.ndarray) -> np.ndarray:
        a, b = cp[:-1], cp[1:]
        pa_, pb = self.char[char_slots(a)], self.char[char_slots(b)]
        both = np.maximum(np.exp(np.minimum(self.pair[pair_slots(a, b)], np.minimum(pa_, pb))) - 0.75 / self.total, 0)
        return np.log(0.9 * both / np.exp(pa_) + 0.1 * np.exp(pb))

    def rough(self, text: str) -> float:
        return sum(map(self.logs.__getitem__, text))

    def mappings(self, text: str, left: str, right: str = "") -> list[tuple[str, bool, tuple[str, str]]]:
        """What text may have been, by any pair of codecs, the likeliest by their characters
        first; whether it was UTF-8; and what of text stands for it, where a lost character
        beside it broke a sequence."""
        options: dict[str, tuple[float, bool, tuple[str, str]]] = {}
        for wrong in WRONG:
            raw = encode(text, wrong)
            if raw is None:
                continue
            for meant in (*MULTI, *SINGLE):
                if meant != wrong and (wrong, meant) != ("cp1252", "latin-1") and (got := decode_between(raw, meant, left == LOST, right == LOST)) is not None:
                    out = got[0].lstrip("\ufeff")
                    if out and out != text and out not in options:
                        options[out] = self.rough(out), meant == "utf-8", _without(text, wrong, got[1], got[2])
        if text.startswith(("þÿ", "ÿþ")) and left == BOUND:
            options[text[2:]] = self.rough(text[2:]), False, (text, text)
        return [(out, *options[out][1:]) for out in sorted(options, key=lambda x: options[x][0], reverse=True)]

    def beside(self, text: str, left: str, right: str) -> float:
        """Likelihood of text between its neighbours. A lost character tells nothing."""
        alone = "" if right == LOST else right
        return self.rough(text[:1]) + self.likelihood(text + alone) if left == LOST else self.likelihood(left + text + alone)

    def restored(self, text: str, left: str, right: str, before: str = "", behind: str = "") -> tuple[float, str] | None:
        """(gain, text as it was meant), or None if no mapping makes it much likelier. Only
        what was UTF-8 is mapped again: such damage grows, and no step alone may gain."""
        key = (left + right + before + behind, text, "")
        if key in self.seen:
            return self.seen[key]
        best, now = (0.0, text), [(text, (text, text))]
        was: dict[tuple[str, str], float] = {}
        tried: set[str] = set()
        while now:  # what was UTF-8 grows shorter each time
            again = []
            for one, stood in now:
                for out, utf8, kept in self.mappings(one, left, right):
                    # bytes that were cut off are no gain
                    of = stood if kept == (one, one) else kept if one == text else None
                    if of is None:
                        continue
                    if of not in was:
                        was[of] = (self.beside(of[0], left, right) + self.beside(of[1], left, right)) / 2
                    gain = self.beside(out, left, right) - was[of]
                    if gain > best[0] and fits(out, left, right, before or left, behind or right):
                        best = gain, out
                    if utf8 and len(out) < len(one) and out not in tried:
                        tried.add(out)
                        again.append((out, of))
            now = again
        if len(self.seen) > 50000:
            self.seen.clear()
        self.seen[key] = out = best if best[0] >= GAIN else None
        return out


def _without(text: str, codec: str, start: int, end: int) -> tuple[str, str]:
    """text without the characters that hold bytes cut off at its ends, and without those
    only that are cut off whole."""
    i, j, a, b = 0, len(text), 0, len(text)
    while start > 0 and i < j:
        start -= len(encode(text[i], codec) or b"?")
        i += 1
        a = i if start >= 0 else a
    while end > 0 and i < j:
        j -= 1
        end -= len(encode(text[j], codec) or b"?")
        b = j if end >= 0 else b
    return text[i:j], text[a:b]


def maximal_segments(x: list[float]) -> list[tuple[int, int]]:
    """All maximum-scoring segments [i, j) of x, in linear time: those whose sum no
    extension and no cut improves."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum with
    done: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, v in enumerate(x):
        if v <= 0:
            total += v
            continue
        new = (i, i + 1, total, total + v)
        total += v
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0:
                # no later segment reaches back behind this one
                done += found
                found = [new]
                break
            if found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(a, b) for a, b, _, _ in done + found]


def improbable_runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-scoring segments of x. Their ends are ends of stretches of equal sign, so the
    search runs over the sums of these."""
    signs = x > 0
    if not signs.any():
        return []
    starts = np.concatenate(([0], np.flatnonzero(signs[1:] != signs[:-1]) + 1))
    ends = np.append(starts[1:], len(x))
    sums = np.add.reduceat(x.astype(np.float64), starts)
    return [(int(starts[i]), int(ends[j - 1])) for i, j in maximal_segments(sums.tolist())]


def _grown(text: str, i: int, j: int) -> tuple[int, int]:
    """Characters [i, j) without ASCII at the ends, and with what is not ASCII beside."""
    while i < j and text[i] < "\x80":
        i += 1
    while j > i and text[j - 1] < "\x80":
        j -= 1
    while i and text[i - 1] >= "\x80":
        i -= 1
    while j < len(text) and text[j] >= "\x80":
        j += 1
    return i, j


def _pieces(text: str, i: int, j: int) -> list[tuple[int, int]]:
    """Stretches of text[i:j] without ASCII."""
    out, k = [], i
    while k < j:
        if text[k] < "\x80":
            k += 1
            continue
        e = k
        while e < j and text[e] >= "\x80":
            e += 1
        out.append((k, e))
        k = e
    return out


def _lines(text: str, i: int, j: int) -> list[tuple[int, int]]:
    """The lines of text[i:j], each from its first to its last character that isn't ASCII."""
    out = []
    while i < j:
        e = text.find("\n", i, j)
        e = j if e < 0 else e
        a, b = i, e
        while a < b and text[a] < "\x80":
            a += 1
        while b > a and text[b - 1] < "\x80":
            b -= 1
        if a < b:
            out.append((a, b))
        i = e + 1
    return out


def _intact(text: str, i: int, j: int) -> list[tuple[int, int]]:
    """Stretches of text[i:j] between lost characters."""
    out = []
    while i < j:
        e = text.find(LOST, i, j)
        e = j if e < 0 else e
        if i < e:
            out.append((i, e))
        i = e + 1
    return out


def repaired(model: Model, text: str, x: np.ndarray) -> tuple[str, int, bool]:
    """(restored text, runs restored, whether something is lost). x: improbability of the
    pairs of a bound, text and a bound."""
    edits: list[tuple[int, int, str]] = []
    upto = 0
    if mark := next((m for m in MARKS if text.startswith(m)), None):
        edits.append((0, len(mark), ""))
        upto = len(mark)

    def attempt(a: int, b: int) -> tuple[float, str] | None:
        if LOST in text[a:b]:
            return None
        left, right = text[a - 1] if a else BOUND, text[b] if b < len(text) else BOUND
        p, n = a - 1, b
        while p >= 0 and text[p].isspace():
            p -= 1
        while n < len(text) and text[n].isspace():
            n += 1
        before, behind = text[p] if p >= 0 else "", text[n] if n < len(text) else ""
        # what was restored just before counts as it reads now
        if edits and edits[-1][1] == p + 1 and edits[-1][2]:
            before = edits[-1][2][-1]
            left = before if p + 1 == a else left
        return model.restored(text[a:b], left, right, before, behind)

    for i, j in improbable_runs(x):
        # pair k stands before character k, so characters i-1 to j-1 take part
        i, j = _grown(text, max(0, i - 1), min(len(text), j))
        if i >= j or i < upto:
            i = max(i, upto)
            if i >= j:
                continue
        # the trail byte of a pair may be ASCII
        spans = [(i, j), (i, j + 1)] if j < len(text) and "@" <= text[j] <= "~" else [(i, j)]
        best: tuple[float, int, int, str] | None = None
        for a, b in spans:
            if (out := attempt(a, b)) and (best is None or out[0] > best[0]):
                best = out[0], a, b, out[1]
        if best:
            edits.append(best[1:])
            upto = best[2]
            continue
        # a run of several lines may be damaged in some, and a line in some of its parts
        for la, lb in [x for a, b in _intact(text, i, j) for x in _lines(text, a, b)]:
            ends = [(la, lb), (la, lb + 1)] if lb < len(text) and "@" <= text[lb] <= "~" else [(la, lb)]
            whole = [(out[0], a, b, out[1]) for a, b in ends if b - a < j - i and (out := attempt(a, b))]
            if whole:
                edits.append(max(whole)[1:])
                continue
            for a, b in _pieces(text, la, lb):
                if b - a < lb - la and (out := attempt(a, b)):
                    edits.append((a, b, out[1]))
        upto = j
    new, at = [], 0
    for a, b, out in edits:
        new += [text[at:a], out]
        at = b
    return "".join([*new, text[at:]]), len(edits), LOST in text


_models: dict[int, Model] = {}


def restore(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(row_id, field, restored, runs, lost): the damaged values of the columns, as restored
    as they can be; runs counts what was mapped back, lost tells of U+FFFD."""
    spark = df.sparkSession
    counted = count_pairs(df, columns).toPandas()  # at most as many rows as slots
    shared = spark.sparkContext.broadcast((counted["slot"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _models.get(key)
        if model is None:
            _models.clear()
            model = _models[key] = Model(*shared.value)
        for batch in batches:
            ids, out = batch.column(0), []
            for f, name in enumerate(columns):
                values = batch.column(f + 1).to_pylist()
                rows = [i for i, v in enumerate(values) if v and not v.isascii()]
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    cp = code_points(BOUND + BOUND.join(values[i] for i in part) + BOUND)
                    x = model.improbability(cp)
                    start = 0
                    for i in part:
                        end = start + len(values[i]) + 1
                        own = x[start:end]
                        start = end
                        lost = LOST in values[i]
                        if lost or (own > 0).any():
                            new, runs, lost = repaired(model, values[i], own)
                            if runs or lost:
                                out.append((ids[i].as_py(), name, new, runs, lost))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_()), strict=True)], [row_id, "field", "restored", "runs", "lost"])

    key = hash((spark.sparkContext.applicationId, id(shared), int(counted["n"].sum())))
    odd = " or ".join(rf"{c} rlike '[^\\x00-\\x7F]'" for c in columns)
    return df.filter(odd).select(F.col(row_id).cast("bigint").alias(row_id), *columns).mapInArrow(scan, f"{row_id} long, field string, restored string, runs int, lost boolean")
