"""Find personal information in free text and replace it by typed placeholders.

Labelers propose spans and vote on them: patterns of addresses, numbers and mail addresses,
a gazetteer (a table of known names and the names of senders), and what stands left and
right. Which words speak for a kind and which against it is counted over the corpus: words
beside spans on which pattern and gazetteer agree, against words beside all other spans of the
kind. Each vote is for, against or absent. Expectation maximisation over the counted vote
vectors of the whole corpus estimates how reliable each labeler is, and with that how likely
each vector marks a mention. These probabilities are the soft labels on which a logistic
regression over votes, shapes and neighbouring words is trained; it decides on every span.
Texts are read once to find mentions; spans are kept in a table in between. To replace them,
texts are read once more, by a map that proposes, votes and decides as before.

The gazetteer is a sorted file of hashes, mapped into memory by the workers. All statistics of
words have a fixed number of slots into which words are hashed, so what reaches the driver is
bounded whatever the corpus, and no word leaves it as the corpus grows.

Defined results: null, empty and blank texts hold no mention; a span lies in one mention
only, where kinds overlap addresses come before mail addresses, numbers and names; a mention
that runs over a line end, marks of quotation in between, starts where its first character
stands; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.tables import WordTable, table_of, write_words
from sedimenta.session import cut

KINDS = ["address", "email", "identity", "phone", "name"]
#: Rows of spans at most that the classifier is trained on, drawn by hash.
TRAINING_ROWS = 200_000
#: Slots of the classifier's hashed features, and of the words beside spans.
SLOTS = 1 << 14
#: Times a word must occur as a sender's name to enter the gazetteer.
NAME_LEAST = 2
#: Characters on each side by which a span is told from copies of it.
AROUND = 16
#: A word that stands beside spans so often, copies aside, speaks for them if these are at least, and against
#: if at most, so great a share of the different ones expected; of which GROUPS are told apart.
OFTEN, MANY, FEW, GROUPS = 8, 0.6, 0.3, 63
#: Gazetteer: what a word is.
GIVEN, FAMILY, LOWERED = 1, 2, 4

#: A blank or one line end, with marks of quotation.
_W = r"(?:[ \xa0]|[ \t]*\r?\n(?:[A-Z]{1,3}> ?|[>|] ?)*[ \t]*)"
_CITY = rf"(?:St\.{_W})?[^\W\d_][\w'’-]+(?:{_W}[A-Z][\w'’-]+)?"

# How postal addresses are written, from street, number, flat or box on.
_ADDRESSES = [
    rf"P\.{_W}?O\.{_W}Box{_W}\d+,{_W}{_CITY}{_W}\d{{5}}\b",
    rf"(?:Flat|Unit|Apt\.?|Suite){_W}\d+[A-Za-z]?,{_W}\d+[A-Za-z]?{_W}[\w'’.-]+(?:{_W}[\w'’.-]+)?,{_W}{_CITY}{_W}[A-Z]{{1,2}}\d[\dA-Z]?{_W}\d[A-Z]{{2}}\b",
    rf"\d+[A-Za-z]?{_W}[A-Z][\w'’.-]+(?:{_W}[A-Z][\w'’.-]+)?{_W}(?:Street|St\.|Road|Rd\.|Lane|Close|Court|Blvd|Boulevard|Avenue|Ave\.?|Drive|Way|Square|Place)(?:\b|(?<=\.))(?:,{_W}(?:Apt\.|Flat|Unit|Suite|No\.){_W}\d+[A-Za-z]?)?(?:,{_W}{_CITY}{_W}(?:\d{{5}}\b|[A-Z]{{1,2}}\d[\dA-Z]?{_W}\d[A-Z]{{2}}\b)|,{_W}[A-Z][\w-]+)?",
    rf"[A-ZÄÖÜ][\w-]*(?:stra[^\s\d,]{{1,10}}e|str\.|weg|gasse|platz|allee){_W}\d+{_W}?[a-z]?,{_W}(?:[A-Z]{{1,2}}-)?\d{{5}}{_W}{_CITY}",
    rf"\d+(?:{_W}?(?:bis|ter|[A-Za-z]))?,{_W}(?:rue|avenue|boulevard|place|chemin|quai){_W}(?:(?:du|de{_W}la|de|des){_W})?[\w'’-]+,{_W}\d{{5}}{_W}{_CITY}",
    rf"(?:Calle|Avenida|Avda\.|Plaza|Paseo|C/){_W}[\w'’-]+{_W}\d+,{_W}\d+[^\s,]{{1,6}}{_W}[A-Z]{{1,3}},{_W}\d{{5}}{_W}{_CITY}",
]
ADDRESS = re.compile("|".join(f"(?<![\\w-])(?:{a})" for a in _ADDRESSES))
#: A fixed part of each alternative: texts without any hold no address.
_ADDRESS_HINTS = (
    *("Box", "Flat", "Unit", "Apt", "Suite"),
    *("Street", "St.", "Road", "Rd.", "Lane", "Close", "Court", "Blvd", "Boulevard", "Ave", "Drive", "Way", "Square", "Place"),
    *("stra", "str.", "weg", "gasse", "platz", "allee"),
    *("rue", "avenue", "boulevard", "place", "chemin", "quai"),
    *("Calle", "Avda.", "Plaza", "Paseo", "C/"),
)

# How numbers of persons are written.
IDENTITY = re.compile(
    rf"(?<![\w+./-])(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}}{_W}\d{{2}}{_W}\d{{4}}|\d{{3}}{_W}\d{{3}}{_W}\d{{3}}{_W}\d{{3}}|\d{{6}}[-+]\d{{4}}|\d{{6}}[-+A]\d{{3}}[0-9A-Z]|\d{{8}}[A-Z]|[XYZ]\d{{7}}[A-Z]"
    rf"|[A-Z]{{2}}{_W}?\d{{2}}{_W}?\d{{2}}{_W}?\d{{2}}{_W}?[A-D]|[CFGHJKL][0-9CFGHJKLMNPRTVWXYZ]{{8}}\d)(?![\w/-]|\.\d)"
)
# How telephone numbers are written.
PHONE = re.compile(
    rf"(?<![\w+./-])(?:\+\d{{1,3}}(?:(?:{_W}|[-./]|{_W}/{_W})?\(?\d{{1,5}}\)?){{2,6}}|\(\d{{3}}\){_W}?\d{{3}}[-.{' '}]\d{{4}}|0\d{{1,4}}/\d{{6,9}}|00[1-9]\d{{0,2}}(?:[-{' '}]\d{{1,9}}){{2,5}}"
    rf"|0[1-9]\d{{1,3}}{_W}\d{{4}}{_W}\d{{4}}|0[1-9](?:\.\d\d){{4}}|0[1-9](?:{_W}\d\d){{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}})(?:{_W}ext\.{_W}?\d{{1,5}})?(?![\w/]|[-.]\d)"
)
_NUMBERISH = re.compile(r"[+(]?\d[\d() /.-]{4,}\d|[A-Z]\d[A-Z0-9]\d|\d{4}[A-Z]\b|[A-Z]{2}\s\d\d\s")
_DISGUISED = re.compile(
    rf"(?<![\w.+-])[\w.+-]+{_W}?(?:\(at\)|\[at\]|\{{at\}}|<at>|{_W}at{_W}){_W}?[\w-]+(?:(?:\.|{_W}?(?:\(dot\)|\[dot\]|{_W}dot{_W}){_W}?)[A-Za-z][\w-]*)+", re.I
)
#: What tells a disguised address from running text.
_DISGUISE = re.compile(r"[(\[{<]at[)\]}>]|\bdot\b", re.I)
_LOCAL = re.compile(r"[\w.+-]+$")
_DOMAIN = re.compile(r"(?:[\w-]+\.)+[A-Za-z][\w-]*")
_HARDBREAK = re.compile(r"[\w.+-]*-[ \t]*\r?\n(?:[A-Z]{1,3}> ?|[>|] ?)*$")
_MADE_UP = re.compile(r"\d{6}|\.\d\d\.|^[A-Z]{2}[0-9A-F]{6}|[0-9a-f]{8}|-digest$")
_PAIR = re.compile(rf"{_W}")
_COMMA = re.compile(rf",{_W}")
_INITIAL = re.compile(rf"(?<![\w.])[^\W\d_]\.{_W}?$")
_ODD_BEFORE = re.compile(rf"(?<![\w])([^\W\d_][^\s,;:()<>\"]*[^\x00-\x7f][^\s,;:()<>\"]*){_W}$")
_ODD_BEHIND = re.compile(rf"{_W}([^\W\d_][^\s,;:()<>\"]*[^\x00-\x7f][^\s,;:()<>\"]*)")
_NAMED = re.compile(rf"(?<![^\s>|*,:(])([^\W\d_][^\s<>:,]*(?:{_W}[^\W\d_][^\s<>:,]*)?){_W}<?$")
_WORD_RIGHT = re.compile(rf"(?:[ \xa0,'’]|{_W})([^\W\d_]+)")
_PARTICLE = re.compile(rf"{_W}(?:(?:[^\W\d_]\.|von{_W}der|von|van{_W}der|van{_W}de|van|de{_W}la|de|da|di|del|zu){_W})?")

N_VOTES = 4
N_FEATURES = 5
#: Slots of vote vectors, behind those of other features.
VOTE_SLOTS = 512


def _hash(*parts: object) -> int:
    h = 2166136261
    for b in "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % (SLOTS - 1) + 1


_hashed: dict[tuple, int] = {}


def slot(*parts: object) -> int:
    v = _hashed.get(parts)
    if v is None:
        if len(_hashed) > 200_000:
            _hashed.clear()
        v = _hashed[parts] = _hash(*parts)
    return v


def gazetteer_of(given: set[str], family: set[str]) -> WordTable:
    flags: dict[str, int] = {}
    for word in given | family:
        own = FAMILY if word not in given else GIVEN
        for form, f in ((word, own), (word.upper(), own), (word.lower(), LOWERED)):
            flags[form] = flags.get(form, 0) | f
    return WordTable.of(flags)


#: A word that begins with a capital, up to where letters that need no blanks begin, and its parts.
_CAPITAL = re.compile(r"(?<![^\W⺀-\U0010ffff])(?<!@)[^\W\d_a-z⺀-\U0010ffff][^\W⺀-\U0010ffff]*(?:['’-][^\W⺀-\U0010ffff]+)*")
_PART = re.compile(r"[^\W_]+")


def back(text: str, at: int, tokens: int) -> int:
    """Where the last so many tokens before a position begin."""
    for _ in range(tokens):
        while at > 0 and text[at - 1].isspace():
            at -= 1
        while at > 0 and not text[at - 1].isspace():
            at -= 1
    return at


def left_word(text: str, a: int) -> str:
    """The word before a position in lower case, unless a sentence or mark of quotation ends in
    between."""
    e = a
    while e > 0 and not text[e - 1].isalpha():
        if text[e - 1] in ".!?>|" or text[e - 1].isalnum() or text[e - 1] == "_":
            return ""
        e -= 1
    s = e
    while s > 0 and text[s - 1].isalpha():
        s -= 1
    return text[s:e].lower()


def right_word(text: str, b: int) -> str:
    m = _WORD_RIGHT.match(text, b)
    return m[1].lower() if m else ""


def word_slot(kind: int, word: str) -> int:
    return slot("w", kind, word) if word else 0


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: int
    pattern: int
    known: int
    against: int
    shape: str


class Labelers:
    """Proposes spans of a text with votes of the labelers."""

    def __init__(self, names: WordTable) -> None:
        self.names = names

    def named(self, local: str) -> bool:
        return any(len(w) > 2 and self.names[w] & LOWERED for w in re.split(r"[\W\d_]+", local.lower()))

    def spans(self, text: str) -> list[Span]:
        """Spans without overlaps, by start, with the votes of the pattern and the gazetteer
        and what in their shape speaks against."""
        out: list[Span] = []
        taken: list[tuple[int, int]] = []

        def free(a: int, b: int) -> bool:
            k = bisect_left(taken, (b, b))
            return k == 0 or taken[k - 1][1] <= a

        def add(kind: str, a: int, b: int, pattern: int, known: int, shape: str, against: int = 0) -> None:
            insort(taken, (a, b))
            out.append(Span(a, b, KINDS.index(kind), pattern, known, against, shape))

        for h in _ADDRESS_HINTS:
            if h in text:
                for m in ADDRESS.finditer(text):
                    add("address", m.start(), m.end(), 1, 0, "full" if re.search(r"\d{5}|[A-Z]\d", m[0]) else "street")
                break
        at = text.find("@")
        while at >= 0:
            d, a = _DOMAIN.match(text, at + 1), at
            while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.+-"):
                a -= 1
            if d and a < at:
                b = d.end()
                head = text[a:at].lstrip(".-+")
                a = at - len(head)
                # wrapped behind a hyphen
                if head and text[a - 1 : a] in (" ", "\n", ">", "|", "\t") and (h := _HARDBREAK.search(text, back(text, a, 3), a)) and _LOCAL.search(h[0].rstrip("-> |\t\r\n") or " "):
                    stem = re.match(r"[\w.+-]*", h[0])[0]
                    if self.names[stem.strip("-").lower()] & LOWERED:
                        a = h.start()
                if head and free(a, b):
                    made = _MADE_UP.search(head) is not None
                    known = 1 if self.named(head) else 0
                    before = text[max(0, a - 12) : a]
                    if before.endswith("message <") or (before.lower().endswith("id: <")):
                        made = True
                    add("email", a, b, 1, known, "plain", -1 if made else 0)
            at = text.find("@", at + 1)
        if _DISGUISE.search(text):
            for m in _DISGUISED.finditer(text):
                if free(m.start(), m.end()) and _DISGUISE.search(m[0]):
                    known = 1 if self.named(m[0]) else 0
                    add("email", m.start(), m.end(), 1, known, "disguised")
        if _NUMBERISH.search(text):
            for m in PHONE.finditer(text):
                n = sum(c.isdigit() for c in m[0])
                if 8 <= n <= 17 and free(m.start(), m.end()):
                    add("phone", m.start(), m.end(), 1, 1 if m[0][0] in "+(0" else 0, re.sub(r"\d+", "9", m[0])[:16])
            for m in IDENTITY.finditer(text):
                if free(m.start(), m.end()):
                    add("identity", m.start(), m.end(), 1, 1 if re.search("[A-Z]", m[0]) else 0, re.sub("[A-Z]", "A", re.sub(r"\d", "9", m[0])))
        self._names(text, free, add, out)
        out.sort(key=lambda x: x.start)
        return out

    def _names(self, text: str, free, add, out) -> None:  # noqa: ANN001
        mails = sorted((x.start, x.end) for x in out if x.kind == 1)
        hits: list[tuple[int, int, int]] = []
        for m in _CAPITAL.finditer(text):
            if f := self.names[m[0]] & (GIVEN | FAMILY):
                hits.append((m.start(), m.end(), f))
            elif not m[0].isalnum():
                for x in _PART.finditer(m[0]):
                    if f := self.names[x[0]] & (GIVEN | FAMILY):
                        hits.append((m.start() + x.start(), m.start() + x.end(), f))
        hits = [h for h in hits if free(h[0], h[1])]
        used = -1
        i = 0
        while i < len(hits):
            a, b, f = hits[i]
            i += 1
            if a < used:
                continue
            nxt = hits[i] if i < len(hits) else None
            if f & GIVEN and nxt and nxt[2] & FAMILY and _PARTICLE.fullmatch(text, b, nxt[0]):
                add("name", a, nxt[1], 1, 1, "full")
                used = nxt[1]
            elif f & FAMILY:
                if nxt and nxt[2] & GIVEN and _COMMA.fullmatch(text, b, nxt[0]) and not (i + 1 < len(hits) and hits[i + 1][2] & FAMILY and _PAIR.fullmatch(text, nxt[1], hits[i + 1][0])):
                    add("name", a, nxt[1], 1, 1, "turned")
                    used = nxt[1]
                elif m := _INITIAL.search(text, back(text, a, 3), a):
                    add("name", m.start(), b, 1, 1, "initial")
                    used = b
                elif (m := _ODD_BEFORE.search(text, back(text, a, 3), a)) and m.start(1) >= used and m[1][0].isupper() and m[1][0] < "⺀":
                    add("name", m.start(1), b, 1, 1, "odd")
                    used = b
                else:
                    add("name", a, b, 0, 1, "family")
                    used = b
            else:
                # a given name before a word that may be a damaged family name
                m = _ODD_BEHIND.match(text, b)
                if m and m[1][0].isupper() and m[1][0] < "⺀":
                    add("name", a, m.end(1), 1, 1, "odd")
                    used = m.end(1)
                    continue
                after = text[b : b + 2]
                line_start = a == 0 or text[a - 1] == "\n" or text[max(0, a - 2) : a] in ("> ", "| ")
                calls = after[:1] == "," and line_start or after in ("'s", "’s") or after[:1] == ":"
                # a small letter behind it goes on with a sentence
                goes_on = after[:1] == " " and after[1:].islower()
                add("name", a, b, 1 if calls else 0, 1, "given" if calls or not goes_on else "given?")
                used = b
        # whoever stands before a mail address
        for a, b in mails:
            m = _NAMED.search(text, back(text, a, 5), a)
            if m and text[a - 1 : a] in "< (" and text[m.end(1) : a].strip(" \r\n>|\t") in ("<", "") and text[a - 1] == "<":
                s = m.start(1)
                words = m[1].split()
                if len(words) == 2 and all(w[0].isupper() for w in words) and free(s, m.end(1)):
                    add("name", s, m.end(1), 1, 0, "before-mail")


def features(text: str, x: Span, left: str, right: str) -> list[int]:
    """Slots of shape and neighbouring words; of a word that may be an ordinary one also of the
    word itself."""
    word = text[x.start : x.end].lower() if x.shape == "given?" else ""
    return [slot(x.kind), slot(x.kind, "s", x.shape), slot(x.kind, "l", left), slot(x.kind, "r", right), slot(x.kind, "w", word, right if word else "")]


def vote_code(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def estimate(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Probability that a vote vector (kind, code) marks a mention, by expectation
    maximisation with a reliability of each labeler for either truth. Labelers are taken as
    independent given the truth; absent votes count as a third answer."""
    out: dict[tuple[int, int], float] = {}
    for kind in range(len(KINDS)):
        rows = [(code, n) for (k, code), n in counts.items() if k == kind]
        if not rows:
            continue
        votes = np.array([[c // 3 ** (N_VOTES - 1 - i) % 3 for i in range(N_VOTES)] for c, _ in rows])
        n = np.array([x for _, x in rows], float)
        p = 1 / (1 + np.exp(-(votes - 1).sum(1) * 1.5 + 0.5))
        for _ in range(rounds):
            prior = ((p * n).sum() + 1) / (n.sum() + 2)
            like = np.zeros((2, len(rows)))
            for t, w in ((1, p * n), (0, (1 - p) * n)):
                for i in range(N_VOTES):
                    # votes for are likelier of mentions, votes against of others
                    anchor = np.array([0.05, 0.35, 0.6]) if t else np.array([0.6, 0.35, 0.05])
                    k = 0.02 * n.sum() + 5
                    share = (np.array([(w * (votes[:, i] == v)).sum() for v in range(3)]) + k * anchor) / (w.sum() + k)
                    like[t] += np.log(share[votes[:, i]])
            new = 1 / (1 + np.exp(np.clip(like[0] - like[1] + np.log((1 - prior) / prior), -50, 50)))
            if np.abs(new - p).max() < 1e-6:
                p = new
                break
            p = new
        out.update({(kind, c): float(x) for (c, _), x in zip(rows, p, strict=True)})
    return out


def train(slots: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.5, ridge: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression on hashed features and soft labels (Adagrad over
    batches in the order given)."""
    w, g2 = np.zeros(SLOTS + VOTE_SLOTS), np.full(SLOTS + VOTE_SLOTS, 1e-8)
    for _ in range(epochs):
        for at in range(0, len(labels), 4096):
            s, y = slots[at : at + 4096], labels[at : at + 4096]
            p = 1 / (1 + np.exp(-np.clip(w[s].sum(1), -30, 30)))
            g = np.zeros(SLOTS + VOTE_SLOTS)
            np.add.at(g, s.ravel(), np.repeat((p - y) / len(y), s.shape[1]))
            g += ridge * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
    return w


def gazetteer(emails: DataFrame, known: DataFrame) -> str:
    """Name of the gazetteer's file, given to all workers: the known names and the words of
    senders' names that occur several times."""
    words = F.split(F.trim("from_name"), r"\s+")
    plain = r"^\p{Lu}[\p{L}'’-]+$"
    parts = emails.select(words.alias("w")).filter(F.size("w") == 2).select(F.posexplode("w").alias("p", "w")).filter(F.col("w").rlike(plain))
    senders = parts.groupBy("p", "w").agg(F.count("*").alias("n")).filter(F.col("n") >= NAME_LEAST).select("w", F.when(F.col("p") == 0, GIVEN).otherwise(FAMILY).alias("f"))
    listed = known.filter("name is not null and name_part in ('given', 'family')").select(F.col("name").alias("w"), F.when(F.col("name_part") == "given", GIVEN).otherwise(FAMILY).alias("f"))
    names = senders.unionByName(listed).groupBy("w").agg(F.when(F.bit_or("f").bitwiseAND(GIVEN) > 0, GIVEN).otherwise(FAMILY).alias("f"))
    forms = names.select(F.explode(F.array(F.struct("w", "f"), F.struct(F.upper("w").alias("w"), F.col("f")), F.struct(F.lower("w").alias("w"), F.lit(LOWERED).alias("f")))).alias("x")).select("x.*")
    return write_words(forms)


_labelers: dict[str, Labelers] = {}


def labelers_of(name: str) -> Labelers:
    if name not in _labelers:
        _labelers.clear()
        _labelers[name] = Labelers(table_of(name))
    return _labelers[name]


_SPANS = ["tab", "row_id", "kind", "start", "end", "pattern", "known", "against", "what", "around", "left", "right", *(f"f{i}" for i in range(N_FEATURES))]
_SPAN_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * (7 + N_FEATURES)]


def what(text: str, x: Span) -> int:
    """Group of what a span holds: its words, of numbers their shape; what its shape speaks
    against is one group."""
    if x.against:
        return slot("h", x.kind) % GROUPS
    held = x.shape if KINDS[x.kind] in ("phone", "identity") else " ".join(_PART.findall(text[x.start : x.end].lower()))
    return slot("h", x.kind, held) % GROUPS


def rows_of(labelers: Labelers, tab: str, row: int, text: str) -> list[tuple]:
    """Spans of a text as rows of _SPANS."""
    out = []
    for x in labelers.spans(text):
        left, right = left_word(text, x.start), right_word(text, x.end)
        # a name beside an address says whose it is, not what
        sides = [0 if labelers.names[w] & LOWERED else word_slot(x.kind, w) for w in (left, right)]
        out.append((tab, row, x.kind, x.start, x.end, x.pattern, x.known, x.against, what(text, x), zlib.crc32(text[max(0, x.start - AROUND) : x.end + AROUND].encode("utf-8", "replace")) >> 1, *sides, *features(text, x, left, right)))
    return out


def propose(texts: DataFrame, names: str) -> DataFrame:
    """Spans of texts (tab, row_id, text), without what words beside them vote."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelers = labelers_of(names)
        for batch in batches:
            rows = [r for tab, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows_of(labelers, tab, row, text)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_SPANS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SPAN_TYPES, strict=True)], _SPANS)

    kind = ", ".join(f"{c} {'string' if c == 'tab' else 'long' if c in ('row_id', 'start', 'end') else 'int'}" for c in _SPANS)
    return texts.select("tab", "row_id", "text").filter("trim(text) <> ''").mapInArrow(scan, kind)


@dataclass
class Judge:
    """What was learned: for each slot of words on either side of a span whether it speaks for
    (1) or against (-1) it, and the classifier."""

    left: np.ndarray
    right: np.ndarray
    weights: np.ndarray | None = None

    def votes(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        """Codes of the vote vectors: pattern, gazetteer, words for, and against."""
        left, right = self.left[columns["left"]], self.right[columns["right"]]
        near = ((left > 0) | (right > 0)).astype(np.int64)
        against = np.where((columns["against"] < 0) | (left < 0) | (right < 0), -1, 0)
        code = np.zeros(len(left), np.int64)
        for v in (columns["pattern"], columns["known"], near, against):
            code = code * 3 + v + 1
        return code

    def slots(self, columns: dict[str, np.ndarray], votes: np.ndarray) -> np.ndarray:
        of_votes = (columns["kind"].astype(np.int64) * 3**N_VOTES + votes) % VOTE_SLOTS + SLOTS
        return np.stack([*(columns[f"f{i}"].astype(np.int64) for i in range(N_FEATURES)), of_votes], 1)

    def mentions(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return self.weights[self.slots(columns, self.votes(columns))].sum(1) > 0


def numbers_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(i).to_numpy() for i, c in enumerate(batch.schema.names) if c != "tab"}


def beside(spans: DataFrame) -> Judge:
    """Words that speak for and against, from how many different spans they stand beside."""
    held = spans.groupBy("kind", "what").agg(F.approx_count_distinct("around", 0.02).alias("n")).toPandas()  # kinds x groups
    out = []
    for side in ("left", "right"):
        bit = F.expr("shiftleft(cast(1 as bigint), what)")
        seen = spans.filter(f"{side} > 0").groupBy("kind", side).agg(F.approx_count_distinct("around", 0.02).alias("n"), F.bit_count(F.bit_or(bit)).alias("groups")).filter(F.col("n") >= OFTEN).toPandas()  # at most kinds x slots
        table = np.zeros(SLOTS, np.int8)
        for kind, k in seen.groupby("kind"):
            share = held.loc[held["kind"] == kind, "n"].to_numpy(float)
            share /= share.sum()
            expected = (1 - (1 - share[None, :]) ** k["n"].to_numpy(float)[:, None]).sum(1)
            part = k["groups"].to_numpy(float) / expected
            table[k[side].to_numpy()] = np.where(part >= MANY, 1, np.where(part <= FEW, -1, 0))
        out.append(table)
    return Judge(*out)


def learned(spans: DataFrame) -> Judge:
    """A classifier trained on the votes of all spans."""
    spark = spans.sparkSession
    judge = beside(spans)
    shared = spark.sparkContext.broadcast(judge)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = numbers_of(batch)
            pairs, n = np.unique(np.stack([c["kind"].astype(np.int64), shared.value.votes(c)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n.astype(np.int64))], ["kind", "votes", "n"])

    counted = spans.mapInArrow(count, "kind long, votes long, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    counts = {(r["kind"], r["votes"]): r["n"] for r in counted.collect()}  # at most kinds x 3^labelers
    soft = estimate(counts)
    total = sum(counts.values())
    draw = spans if total <= TRAINING_ROWS else spans.filter(F.pmod(F.xxhash64("tab", "row_id", "start"), F.lit(1_000_000)) < int(1_000_000 * TRAINING_ROWS / total))
    used = ["kind", "pattern", "known", "against", "left", "right", *(f"f{i}" for i in range(N_FEATURES))]
    sample = draw.select(*used).toPandas()
    # the same order whatever the partitioning, then a fixed shuffle for training
    sample = sample.sort_values(used).sample(frac=1.0, random_state=42)
    columns = {c: sample[c].to_numpy() for c in used}
    votes = judge.votes(columns)
    labels = np.array([soft[k, v] for k, v in zip(columns["kind"].tolist(), votes.tolist(), strict=True)], float)
    judge.weights = train(judge.slots(columns, votes), labels)
    return judge


def decided(spans: DataFrame, judge: Judge) -> DataFrame:
    """(tab, row_id, kind, start_pos, end_pos) of the spans that are mentions."""
    shared = spans.sparkSession.sparkContext.broadcast(judge)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["tab", "row_id", "kind", "start", "end"]).filter(pa.array(shared.value.mentions(numbers_of(batch))))

    mentions = spans.mapInArrow(keep, "tab string, row_id long, kind int, start long, end long")
    return mentions.select("tab", "row_id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


def find_mentions(texts: DataFrame, emails: DataFrame, known: DataFrame) -> DataFrame:
    """(tab, row_id, kind, start_pos, end_pos) of mentions in texts (tab, row_id, text)."""
    spans = cut(propose(texts, gazetteer(emails, known)))
    return decided(spans, learned(spans))


def replaced(text: str, mentions: list[tuple[int, int, int]]) -> str:
    """text with placeholders such as [NAME]; mentions (start, end, kind) by start."""
    out, at = [], 0
    for a, b, kind in mentions:
        out += [text[at:a], "[", KINDS[kind].upper(), "]"]
        at = b
    return "".join([*out, text[at:]])


def replace(texts: DataFrame, emails: DataFrame, known: DataFrame) -> DataFrame:
    """(tab, row_id, text) with placeholders for mentions; null texts stay null. Texts pass
    through a map and are shuffled nowhere."""
    names = gazetteer(emails, known)
    shared = texts.sparkSession.sparkContext.broadcast(learned(cut(propose(texts, names))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelers = labelers_of(names)
        for batch in batches:
            tabs, ids, values = (c.to_pylist() for c in batch.columns)
            rows, of = [], []
            for i, text in enumerate(values):
                found = rows_of(labelers, "", 0, text) if text and not text.isspace() else []
                rows += found
                of += [i] * len(found)
            if rows:
                columns = {c: np.array(v) for c, v in zip(_SPANS[2:], list(zip(*rows, strict=True))[2:], strict=True)}
                mentions: dict[int, list[tuple[int, int, int]]] = {}
                for k in np.flatnonzero(shared.value.mentions(columns)).tolist():
                    mentions.setdefault(of[k], []).append((rows[k][3], rows[k][4], rows[k][2]))
                for i, m in mentions.items():
                    values[i] = replaced(values[i], m)
            yield pa.RecordBatch.from_arrays([pa.array(tabs, pa.string()), pa.array(ids, pa.int64()), pa.array(values, pa.string())], ["tab", "row_id", "text"])

    return texts.select("tab", "row_id", "text").mapInArrow(scan, "tab string, row_id long, text string")
