"""Split texts into sentences, in any language, script and layout.

What ends a sentence is learned from the corpus, unsupervised and per language: words that
stand before a period far more often than a log-likelihood ratio lets chance do
(abbreviations, with how often lower case, numbers and other words follow), words that follow
an abbreviation, an initial or a number with its period more often than chance and don't begin
sentences (collocations), and words that begin sentences more often than chance (sentence
starters, counted where beginnings are certain). Each period is then classified by these
statistics. Layout is read first: blank lines, headings, list items, lines of indented code
and speaker labels bound sentences whatever their punctuation. The language is told by script
and function words, not by a column that may be wrong.

Statistics are counts summed over the corpus, and ratios are taken where the counts are; no
word leaves them as the corpus grows. What was learned is a sorted file of hashes, mapped into
memory by the workers.

Defined results: null, empty and blank texts have no sentences; a text without any end of a
sentence is one; positions count code points of the stored text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.tables import WordTable, table_of, write_words
from sedimenta.session import cut

#: Log-likelihood ratios beyond chance: of abbreviations, of sentence starters and of collocations.
ABBREVIATION_RATIO, STARTER_RATIO, COLLOCATION_RATIO = 0.3, 7.88, 7.88
#: Times a word, or a pair, must occur to be judged.
LEAST = 2
#: What a word is: an abbreviation that doesn't end sentences, any abbreviation, a sentence starter;
#: or, of two words, a collocation.
INNER, ABBREVIATION, STARTER, COLLOCATION = 1, 2, 4, 8
#: Share of followers, none of which begins a sentence, that make an abbreviation one that
#: doesn't end sentences.
INNER_SHARE = 0.5
#: Letters of abbreviations that stand before names, such as titles.
NAMED_LENGTH = 5

# Function words that tell languages of one script apart.
FUNCTION_WORDS = {
    "en": set("the and of to is in that it for with this was not on are be".split()),
    "de": set("der die das und ist nicht ein eine mit für auf den von zu wird im".split()),
    "fr": set("le la les et est une des dans pour pas que du ce sur cette par".split()),
    "es": set("el la los y es una en que de por con para se no las del".split()),
    "it": set("il la di che e un per non con del della sono gli una più".split()),
    "pt": set("o a de que e do da em um para com não uma os no".split()),
    "nl": set("de het een en van is op dat niet te zijn met voor aan".split()),
    "sv": set("och att det som en på är av för med den till inte".split()),
    "pl": set("i w na z się nie do to jest że jak od po".split()),
}
#: Languages of each function word; a letter alone tells nothing.
_FUNCTION = {w: [k for k, words in FUNCTION_WORDS.items() if w in words] for w in set().union(*FUNCTION_WORDS.values()) if len(w) > 1}

_LINE = re.compile(r"\r\n|\r|\n|\x0b|\x0c|\x85| | ")
_BULLET = re.compile(r"[ \t]{0,3}(?:[-*•‣◦·–—+]|\(?(\d{1,3})[.)]|\(?[a-zA-Z][)])[ \t]+(?=\S)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+\S|.*\S[ \t]*$(?<=:{2}$)", re.S)
_RULE = re.compile(r"[ \t]*(?:[-=_*~#]{3,})[ \t]*$")
_CODE = re.compile(r"\t|    ")
_LABEL = re.compile(r"[ \t]{0,3}(?:[A-Z]{1,3}|[A-ZÀ-Ž][\w'’-]{1,20}(?: [A-ZÀ-Ž][\w'’-]{1,20})?)[:：][ \t]+(?=\S)")
_SHORT_LABEL = re.compile(r"[ \t]{0,3}[A-Z]{1,3}[:：][ \t]+(?=\S)")
#: Characters that end sentences; the Greek question mark looks like a semicolon.
_STOP = re.compile(r"[.!?…。！？｡।॥؟۔;;‼⁇⁈⁉]+")
_FULL = set("。！？｡।॥؟۔‼⁇⁈⁉")
_ASKING = set("!?;;")
_CLOSERS = "\"'”’»」』）)]}›〉》】〕"
_OPENERS = "\"'“„‚‘«‹「『（([{¿¡〈《【〔"
_STRIPPED = _OPENERS + _CLOSERS + ",;:—–"
_NEXT_TOKEN = re.compile(r"\s*(\S+)")
_ENDS = re.compile("[!?…]")
_IDENT = re.compile(r"[\w./-]*(?:_|\(|[a-z/]\.[A-Za-z]{1,3}\b|/)[\w./()-]*")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_THAI = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])|(?<=[฀-๿])[ \t]*\n\s*(?=[A-Za-z])")
_WORDS = re.compile(r"[^\W\d_]+")
_OTHER_SCRIPT = re.compile(r"[\u0370-\u1fff\u2e80-\uffdf\U00020000-\U0003ffff]")
_ANY_THAI = re.compile(r"[\u0e00-\u0e7f]")
_PAIRED = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", "《": "》", "(": ")", "（": "）"}
_CJK_CONTINUES = "とってはがをのにもでや，、,"

SCRIPTS = [("L", 0x41, 0x24F), ("G", 0x370, 0x3FF), ("C", 0x400, 0x52F), ("H", 0x590, 0x5FF), ("A", 0x600, 0x77F), ("D", 0x900, 0xDFF), ("T", 0xE00, 0xE7F), ("K", 0xAC00, 0xD7AF), ("J", 0x3040, 0x30FF), ("Z", 0x3400, 0x9FFF)]


_RUNS = {name: re.compile(f"[{chr(lo)}-{chr(hi)}]+") for name, lo, hi in SCRIPTS[1:]}
_ASCII_RUNS = re.compile("[A-Za-z]+")


def spoken(words: list[str], default: str) -> str:
    """The language of Latin letters by function words; a word of several languages is divided
    among them."""
    votes: dict[str, float] = {}
    for w in words:
        if w in _FUNCTION:
            of = _FUNCTION[w]
            for k in of:
                votes[k] = votes.get(k, 0.0) + 1 / len(of)
    if default in votes:
        votes[default] += 0.5  # what the rest is written in
    return "L" + (max(votes, key=votes.__getitem__) if votes else default)


def language(text: str, default: str = "en") -> str:
    """The script of most letters, with the language for Latin letters; default where no
    function word tells it."""
    if _OTHER_SCRIPT.search(text) is not None:
        n: Counter[str] = Counter()
        for c, k in Counter(text).items():
            if c.isalpha():
                cp = ord(c)
                for name, lo, hi in SCRIPTS:
                    if lo <= cp <= hi:
                        n[name] += k
                        break
        script = n.most_common(1)[0][0] if n else "L"
        if script != "L":
            return script
    return spoken(text.split(), default)


def part_language(part: str, words: list[str], whole: str) -> str:
    """The language of a part of a text in a language."""
    if whole[0] == "L":
        return spoken(words, whole[1:]) if _OTHER_SCRIPT.search(part) is None else language(part, whole[1:])
    own = sum(map(len, _RUNS[whole].findall(part)))
    return whole if own and 2 * own >= sum(map(len, _ASCII_RUNS.findall(part))) else language(part)


@dataclass
class Unit:
    """A stretch of text in which sentences are sought, or that is one."""

    start: int
    end: int
    whole: bool


def units(text: str) -> list[Unit]:
    """Layout: paragraphs without what bounds sentences by itself."""
    lines: list[tuple[int, int]] = []
    at = 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    out: list[Unit] = []
    para: int | None = None
    para_end = 0
    item: int | None = None
    item_end, number, code_before = 0, 0, False

    def flush() -> None:
        nonlocal para, item
        if para is not None:
            out.append(Unit(para, para_end, False))
        if item is not None:
            out.append(Unit(item, item_end, True))
        para = item = None

    blank_before = True
    for a, b in lines:
        line = text[a:b]
        if not line.strip():
            flush()
            blank_before, code_before = True, False
            continue
        if _CODE.match(line) and (blank_before or code_before) and item is None:
            flush()
            out.append(Unit(a, b, True))
            code_before, blank_before = True, False
            continue
        if code_before and _CODE.match(line):
            out.append(Unit(a, b, True))
            continue
        code_before = False
        m = _BULLET.match(line)
        if m:
            n = int(m[1]) if m[1] else None
            fresh = blank_before or item is not None or (para is None)
            if n is not None and item is not None and n != number + 1 and not blank_before:
                fresh = False
            if not fresh and para is not None and (n == 1 or n is None) and re.search(r"[.!?:。：]\s*$", text[para:para_end]):
                fresh = True
            if fresh:
                flush()
                item, item_end, number = a, b, n if n is not None else 0
                blank_before = False
                continue
        if re.match(r"[ \t]{0,3}#{1,6}[ \t]+\S", line):
            flush()
            out.append(Unit(a, b, True))
            blank_before = True
            continue
        if _RULE.match(line):
            flush()
            out.append(Unit(a, b, True))
            blank_before = True
            continue
        if _SHORT_LABEL.match(line):
            flush()
            para, para_end = a, b
            blank_before = False
            continue
        if item is not None:
            item_end = b
        else:
            if para is None:
                para = a
            para_end = b
        blank_before = False
    flush()
    return out


def quote_spans(s: str) -> list[tuple[int, int]]:
    """(opening, closing) of quotations and brackets that close in s."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    straight: int | None = None
    for i, c in enumerate(s):
        if c == '"':
            before = s[i - 1] if i else " "
            if straight is None:
                if before.isspace() or before in "([{“„«—–-:：" or not before.isascii():
                    straight = i
            else:
                out.append((straight, i))
                straight = None
        elif stack and c in _PAIRED[stack[-1][0]]:
            out.append((stack.pop()[1], i))
        elif c in _PAIRED:
            stack.append((c, i))
    return out


class Knowledge:
    """What was learned of one language: flags of words and of pairs."""

    def __init__(self, table: WordTable, language: str) -> None:
        self.table, self.prefix = table, language + "\x1f"
        self.known: dict[str, int] = {}

    def __getitem__(self, word: str) -> int:
        f = self.known.get(word)
        if f is None:
            if len(self.known) > 200_000:
                self.known.clear()
            f = self.known[word] = self.table[self.prefix + word]
        return f


class AllKnowledge(dict):
    def __init__(self, table: WordTable) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, language: str) -> Knowledge:
        k = self[language] = Knowledge(self.table, language)
        return k


def number_shape(token: str) -> str:
    """One sign for all short numbers, and one for the others."""
    return "0" if len(token) <= 2 else "0000"


def token_before(s: str, i: int) -> str:
    a = i
    while a > 0 and not s[a - 1].isspace():
        a -= 1
    return _ENDS.split(s[a:i])[-1].lstrip(_OPENERS + "—–-").lower()


def kind_of(token: str) -> str:
    """num, id, low, up or other, for the token after a period."""
    t = token.lstrip(_OPENERS)
    if not t:
        return "other"
    if t[0].isdigit():
        return "num"
    if _IDENT.match(t) and len(t) > 2:
        return "id"
    if t[0].islower():
        return "low"
    return "up" if t[0].isupper() else "other"


def bare(token: str) -> str:
    m = _WORDS.search(token)
    return m[0] if m else ""


def candidates(s: str) -> Iterator[tuple[int, int, str]]:
    """(start of the stop, end behind closers, stops) in a paragraph."""
    low = "„" in s
    for m in _STOP.finditer(s):
        stop = m[0]
        if stop.strip(";") == "" and not (m.start() and _GREEK.match(s[m.start() - 1])) and ";" not in stop:
            continue
        if ";" in stop and stop.strip(";"):
            stop = stop.replace(";", "")
        e = m.end()
        j = e
        while True:
            if j < len(s) and s[j] in _CLOSERS:
                # a straight quote behind blanks opens, one behind the stop closes
                j += 1
            elif j + 1 < len(s) and s[j] in "   " and s[j + 1] in "»":
                j += 2
            elif low and j < len(s) and s[j] == "“":
                j += 1
            else:
                break
        yield m.start(), j, stop


def count_evidence(docs: DataFrame) -> DataFrame:
    """(lang, what, word, n): w: words without period; p: with period; pl, pd, pu: before
    lower case, numbers, capitals; f: pairs 'word next' before capitals; b: words that begin
    units or follow other stops; t: words at all."""

    def ended(core: str) -> bool:
        return core.endswith(".") and not core.endswith("..")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[tuple[str, str, str]] = Counter()
            raw: dict[str, Counter[str]] = {}
            for text in batch.column(0).to_pylist():
                whole = language(text)
                for u in units(text):
                    if u.whole:
                        continue
                    s = text[u.start : u.end]
                    tokens = s.split()
                    if not tokens:
                        continue
                    lang = part_language(s, tokens, whole)
                    first = tokens[1] if _SHORT_LABEL.match(s) and len(tokens) > 1 else tokens[0]
                    n[lang, "b", bare(first)] += 1
                    raw.setdefault(lang, Counter()).update(tokens)
                    for k in [k for k, t in enumerate(tokens[:-1]) if "." in t or "!" in t or "?" in t]:
                        t, nxt = tokens[k], tokens[k + 1]
                        core = t.strip(_STRIPPED)
                        if ended(core):
                            x = core[:-1].lower()
                            if not x or t.endswith((",", ";", ":")):
                                continue
                            kind = kind_of(nxt)
                            n[lang, "p", x] += 1
                            if kind == "low":
                                n[lang, "pl", x] += 1
                            elif kind == "num":
                                n[lang, "pd", x] += 1
                            elif kind == "id":
                                n[lang, "pi", x] += 1
                            else:
                                n[lang, "f", f"{number_shape(x) if x.isdigit() else x} {bare(nxt)}"] += 1
                        elif core[-1:] in ("!", "?") and nxt[0] not in "«\"“" and kind_of(nxt) == "up":
                            n[lang, "b", bare(nxt)] += 1
            # what depends on a token alone is done once for each
            for lang, words in raw.items():
                for t, k in words.items():
                    core = t.strip(_STRIPPED)
                    w = bare(core)
                    if w and kind_of(core) != "id":
                        n[lang, "t", w] += k
                    if not ended(core):
                        x = core.rstrip("!?…").lower()
                        if x:
                            n[lang, "w", x] += k
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "what", "word", "n"])

    return docs.select("text").filter("trim(text) <> ''").mapInArrow(count, "lang string, what string, word string, n long").groupBy("lang", "what", "word").agg(F.sum("n").alias("n"))


def ratio(k: Column, without: Column, all_k: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio that the share of k among the occurrences of a word differs
    from that among all; 0 where it is smaller."""
    k, m, total = k.cast("double"), (k + without).cast("double"), total.cast("double")
    p, q, r = all_k / total, k / m, (all_k - k) / (total - m)

    def part(k: Column, n: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    value = 2 * (part(k, m, q) + part(all_k - k, total - m, r) - part(k, m, p) - part(all_k - k, total - m, p))
    return F.when((m > 0) & (total > m) & (q > p), value).otherwise(0.0)


def lower_limit(k: Column, n: Column) -> Column:
    """Lower end of the 95 % interval of a share k of n."""
    p, z2 = k / n, 1.96**2
    return (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)


def judged(counted: DataFrame) -> DataFrame:
    """(lang, word, flags) of words and pairs that are something."""
    totals = {(r["lang"], r["what"]): r["n"] for r in counted.groupBy("lang", "what").agg(F.sum("n").alias("n")).collect()}  # languages x counts
    langs = sorted({k for k, _ in totals})

    def total(*kinds: str) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, float(sum(totals.get((k, what), 0) for what in kinds)))]), F.col("lang")), F.lit(0.0))

    def counts(*kinds: str) -> DataFrame:
        of = counted.filter(F.col("what").isin(*kinds)).groupBy("lang", "word")
        return of.agg(*[F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])

    none = counted.select("lang", "word", F.lit(0).alias("flags")).limit(0)
    if not langs:
        return none
    begins = counts("b", "t").filter((F.col("b") >= LEAST) & (F.col("word") != ""))
    seen = F.greatest("b", "t")
    starters = begins.filter(ratio(F.col("b"), seen - F.col("b"), total("b"), F.greatest(total("t"), total("b") + 1)) > STARTER_RATIO).select("lang", "word")
    pairs = counted.filter("what = 'f'").select("lang", F.substring_index("word", " ", 1).alias("x"), F.substring_index("word", " ", -1).alias("next"), "n")
    pairs = pairs.join(starters.select("lang", F.col("word").alias("next"), F.lit(1).alias("starts")), ["lang", "next"], "left")
    follow = pairs.groupBy("lang", F.col("x").alias("word")).agg(F.sum("n").alias("caps"), F.sum(F.when(F.col("starts") == 1, F.col("n")).otherwise(0)).alias("begin"))
    words = counts("p", "pl", "pd", "pi", "w").filter(F.col("p") >= LEAST).join(follow, ["lang", "word"], "left").fillna(0, ["caps", "begin"])
    p, w = F.col("p"), F.col("w")
    bare_length = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    plain = (bare_length > 0) & F.col("word").rlike(r"(?U)\p{L}") & ~F.col("word").rlike(r"(?U)[\d_]") & ~F.col("word").contains("/")
    score = ratio(p, w, total("p"), total("p", "w")) * F.exp(-bare_length) * (F.length("word") - bare_length + 1) * F.pow(bare_length, -F.least(F.lit(20.0), 10.0 * w / F.greatest(p, F.lit(1))))
    # only short words are abbreviations of what a name follows
    named = F.when(bare_length <= NAMED_LENGTH, F.col("caps") - F.col("begin")).otherwise(0)
    # a word that mostly stands without a period is one only before numbers
    ordinary = (w > 3 * p) & (F.col("pd") < 0.5 * p)
    never = F.col("pl") + F.col("pd") + named
    inner = ~ordinary & ((lower_limit(never, p) >= INNER_SHARE) | (lower_limit(never + F.col("pi"), p) >= 0.8))
    flags = F.when(inner, INNER + ABBREVIATION).when(score > ABBREVIATION_RATIO, ABBREVIATION)
    short = words.filter(plain).select("lang", "word", flags.alias("flags")).filter("flags is not null")
    # what may stand before the period of a collocation: an abbreviation, a letter, a number
    heads = short.select("lang", F.col("word").alias("x")).unionByName(counted.filter("what = 'f'").select("lang", F.substring_index("word", " ", 1).alias("x")).filter(F.col("x").rlike(r"(?U)^(?:\p{L}|0|0000)$"))).distinct()
    beside = pairs.filter((F.col("n") >= LEAST) & F.col("starts").isNull() & (F.col("next") != "")).join(heads, ["lang", "x"], "left_semi")
    often = follow.select("lang", F.col("word").alias("x"), F.col("caps").alias("all_x"))
    seen_next = begins_all(counted).select("lang", F.col("word").alias("next"), F.col("t").alias("all_next"))
    both = beside.join(often, ["lang", "x"]).join(seen_next, ["lang", "next"])
    collocations = both.filter(ratio(F.col("n"), F.col("all_x") - F.col("n"), F.greatest("all_next", "n"), total("t")) > COLLOCATION_RATIO)
    out = short.unionByName(starters.withColumn("flags", F.lit(STARTER))).unionByName(collocations.select("lang", F.concat_ws(" ", "x", "next").alias("word"), F.lit(COLLOCATION).alias("flags")))
    return out.select("lang", "word", F.col("flags").cast("int").alias("flags"))


def begins_all(counted: DataFrame) -> DataFrame:
    return counted.filter("what = 't'").select("lang", "word", F.col("n").alias("t"))


def learn(docs: DataFrame) -> str:
    """Name of the file of what was learned, given to all workers."""
    known = judged(cut(count_evidence(docs)))
    return write_words(known.select(F.concat_ws("\x1f", "lang", "word").alias("word"), "flags"))


def ends_sentence(s: str, i: int, j: int, stop: str, k: Knowledge, quotes: list[tuple[int, int]]) -> bool:
    """Whether the stop at i, with closers up to j, ends a sentence of paragraph s. quotes:
    quotations and brackets that are open at i."""
    m = _NEXT_TOKEN.match(s, j)
    if m is None:
        return True
    nxt, gap = m[1], m.start(1) - j
    kind = kind_of(nxt)
    word = bare(nxt)
    full = not _FULL.isdisjoint(stop)
    closed = next(((a, b) for a, b in quotes if i < b < j and a < i), None)
    around = [(a, b) for a, b in quotes if a < i and b >= j]
    if any(s[a] not in "(（" for a, b in around) or (around and not full and stop != "." and kind == "low"):
        return False
    if around and all(s[a] in "(（" for a, b in around) and not (len(s[around[0][0] : around[0][1]]) > 120):
        return False
    if full or stop[0] == "…" and len(stop) > 1 and not nxt[0].isascii() or (stop in "!?" and not gap and not nxt[0].isascii()):
        if closed:
            a = closed[0]
            before = s[:a].rstrip()
            opened_fresh = not before or before[-1] in ":：" or before[-1] in _FULL or before[-1] in "…!?" or before[-1] in _CLOSERS
            if s[a] not in "(（" and not opened_fresh:
                return False
            if nxt[:1] in _CJK_CONTINUES and nxt[:2] not in ("この", "その", "これ", "もう", "では", "でも"):
                return s[a] in "(（"
        return True
    if not gap:
        # a blank is missing between sentences, or the stop is inside a token
        if stop != "." or i == 0 or j != i + 1 or not (s[i - 1].islower() and kind == "up" and len(word) > 1 and k[word] & STARTER):
            return stop in ("!", "?") and kind == "up" and k[word] & STARTER > 0
        left = token_before(s, i)
        return left.isalpha() and len(left) > 1 and not k[left] & INNER
    if stop.startswith(("..", "…")):
        return not (kind == "low" and not k[word] & STARTER)
    if any(c in "!?;;" for c in stop):
        if kind == "low":
            return k[word] & STARTER and not closed
        if closed and kind == "num":
            return True
        return True
    # a period
    left = token_before(s, i)
    if "." in left and not k[left] & INNER and k[left.rpartition(".")[2]] & INNER:
        left = left.rpartition(".")[2]
    if closed and kind == "low" and not k[word] & STARTER:
        return False
    if not left:
        return kind != "low"
    if len(left) == 1 and left.isalpha() and s[i - 1].isupper() and kind == "up" and not k[left] & STARTER:
        return False
    if kind == "up" and k[f"{number_shape(left) if left.isdigit() else left} {word}"] & COLLOCATION:
        return False
    if left.isdigit():
        if kind == "low":
            return k[word] & STARTER
        return kind in ("id", "num") or k[word] & STARTER or kind == "other" or len(left) > 2
    if k[left] & INNER:
        return kind == "up" and k[word] & STARTER and (len(left) > 1 or "." in left) and not nxt[0].isdigit()
    if k[left] & ABBREVIATION:
        if kind == "low":
            return k[word] & STARTER
        return True
    if "." in left and left.replace(".", "").isalpha() and kind == "low":
        return False
    return True


def starts(text: str, known: AllKnowledge) -> list[int]:
    """Positions of the first characters of all sentences."""
    whole = language(text)
    out: list[int] = []

    def begin(at: int, end: int) -> None:
        while at < end and (text[at].isspace() or text[at] in "﻿​"):
            at += 1
        if at < end:
            out.append(at)

    for u in units(text):
        begin(u.start, u.end)
        if u.whole:
            continue
        s = _LINE.sub(lambda m: "\n" * len(m[0]), text[u.start : u.end])
        flat = s.replace("\n", " ")
        k = known[part_language(flat, flat.split(), whole)]
        quotes = quote_spans(flat) if any(c in flat for c in "\"“„«「『‹《(（") else []
        cuts = set()
        quotes.sort()
        open_: list[tuple[int, int]] = []
        p = 0
        for i, j, stop in candidates(flat):
            while p < len(quotes) and quotes[p][0] < i:
                open_.append(quotes[p])
                p += 1
            open_ = [q for q in open_ if q[1] > i]
            if j < len(flat) and ends_sentence(flat, i, j, stop, k, open_):
                cuts.add(j)
        if _ANY_THAI.search(flat):
            cuts.update(m.start() for m in _THAI.finditer(s))
        for at in sorted(cuts):
            begin(u.start + at, u.end)
    return sorted(set(out))


_known: dict[str, AllKnowledge] = {}


def find_sentences(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, start_pos) of every sentence, with its text if asked."""
    learned = learn(docs)
    names = ["doc_id", "start_pos", *(["sentence"] if with_text else [])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known.get(learned)
        if known is None:
            _known.clear()
            known = _known[learned] = AllKnowledge(table_of(learned))
        for batch in batches:
            ids, at, said = [], [], []
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = starts(text, known)
                ids += [row] * len(s)
                at += s
                if with_text and s:
                    said += [text[a:b].strip() for a, b in zip(s, [*s[1:], len(text)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), *([pa.array(said, pa.string())] if with_text else [])], names)

    kind = "doc_id long, start_pos long" + ", sentence string" * with_text
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("trim(text) <> ''").mapInArrow(scan, kind)
