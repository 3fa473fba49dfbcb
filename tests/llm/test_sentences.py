import pytest
from pyspark.sql import functions as F

from sedimenta.llm import sentences as s
from sedimenta.llm.tables import WordTable

LEARN = [
    "We saw approx. 73 ms per call, i.e. twice the old figure. The U.S. mirror lags by 42 min. on average. See Fig. 17 and Sec. 8 for details. The review by J. R. Lee covers a file. It covers locks, caches, timers, etc. Honestly, it works. The board came from Kestrel Inc. The lock is fine.",
    "The build broke at 6 a.m. and nobody was awake. The run ended at 11 p.m. The caller is fine. Honestly, it works. Use a helper, e.g. wake_node(), instead of it. Honestly, it works. Prof. Lee and Dr. Marby measured it. This was the reply after No. 84 of the series.",
    "Der Fehlerpfad kostet ca. 12 ms pro Aufruf, d. h. viel zu viel. Das ist z. B. in der Datei falsch. Bitte Sperren, Zähler usw. Die Sperre ist gut! Die Sperre ist da! Laut Dr. Lee ist das Nr. 3 der Reihe. Am 3. März wurde die Änderung zurückgenommen. Die Prüfung ist da.",
    "Блокировки, таймеры и т. д. Цикл теряет память. Задержка выросла, т. е. почти вдвое. См. стр. 84 отчёта. Цикл работает! Цикл теряет! Проф. Lee измерил это.",
    "Honestly, it is so. The end. Honestly, so it is. This was it! The end. The lock. Die Sperre! Die Sperre! Die Prüfung. Honestly, yes. Цикл работает. Блокировки теряют.",
]
CASES = {
    "abbreviations": ("The run ended at 11 p.m. The caller takes approx. 5 ms. Prof. Marby said no.", ["The run", "The caller", "Prof. Marby"]),
    "ident": ("Use a helper, e.g. wake_node(), instead. wake_node() is fine. Done v2.1.3 now.", ["Use a", "wake_node() is", "Done"]),
    "quotes": ('He asked: "Who tested this? Where?" The end. "This is wrong," he said. The answer was "No!" and nothing else. (See the note in a/b.c.) Honestly, yes.', ["He asked", "The end", '"This', "The answer", "(See", "Honestly"]),
    "german": ("Am 3. März kam es zurück. Das ist z. B. gut, d. h. fein. Die Sperre ist da, usw. Die Prüfung auch.", ["Am 3", "Das ist", "Die Sperre", "Die Prüfung"]),
    "russian": ("См. стр. 12 отчёта. Цикл, таймеры и т. д. Цикл теряет, т. е. плохо. «Так нельзя», — ответил он.", ["См.", "Цикл,", "Цикл теряет", "«Так"]),
    "chinese": ("维护者说：“这样不行。”循环过于复杂！他问“有测试吗？”然后就没有再回复。感到困惑……请分开", ["维护者", "循环", "他问", "感到", "请分开"]),
    "japanese": ("「テストはありますか？」彼は「これは違う。」と書いて終えた。版3.4は動く！", ["「テスト", "彼は", "版"]),
    "hindi": ("यह ताला है। परीक्षण कहाँ है? डॉ", ["यह", "परीक्षण", "डॉ"]),
    "arabic": ("أين الاختبار؟ هذا القفل معقد جدا.", ["أين", "هذا"]),
    "greek": ("Πού είναι η δοκιμή; Αυτή η ουρά.", ["Πού", "Αυτή"]),
    "thai": ("คิวนี้ซับซ้อนเกินไป การล็อกนี้ล้น", ["คิวนี้", "การล็อก"]),
    "layout": ("# Head\nText goes\non. More\n\nTitle\n\n- one item. still\n- two\n1. first\n2. second\n\n    if (x > 9.1f)\n    return y;\n\nQ: Why?\nA: Because it is.\r\n\r\nlast", ["# Head", "Text", "More", "Title", "- one", "- two", "1. first", "2. second", "if (x", "return", "Q: Why", "A: Because", "last"]),
    "wrapped number": ("Das war am\n3. März so. Die Sperre", ["Das war", "Die Sperre"]),
    "missing blank": ("please split it.Honestly, maybe. a/b.Sub is a file", ["please", "Honestly", "a/b"]),
    "blank": ("  \n\t\n", []),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1000 + i, t) for i, t in enumerate(LEARN * 30)] + [(i, c[0]) for i, c in enumerate(CASES.values())] + [(900, None), (901, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'xx' as lang", "1 as n", "'w' as word").repartition(4)


def test_cases(docs):
    got = {}
    for r in s.find_sentences(docs, with_text=True).filter("doc_id < 1000").collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.sentence))
    for i, (name, (text, want)) in enumerate(CASES.items()):
        have = sorted(got.get(i, []))
        assert all(text[a:].startswith(t[:5]) for a, t in have), name
        assert [t[: len(w)] for (_, t), w in zip(have, want, strict=False)] == want and len(have) == len(want), (name, have)
    assert 900 not in got and 901 not in got


def test_empty(spark):
    assert s.find_sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ratio(spark):
    rows = [(10, 0, 50, 1000), (5, 5, 50, 1000), (0, 10, 50, 1000), (3, 3, 50, 6)]
    df = spark.createDataFrame(rows, "k long, without long, a long, n long")
    a, b, c, d = (r.v for r in df.select(s.ratio(F.col("k"), F.col("without"), F.col("a"), F.col("n")).alias("v")).collect())
    assert a > b > 0 == c == d


def test_very_long_paragraph():
    import time

    t = time.time()
    n = s.starts('He said "no" and left. ' * 40_000, s.AllKnowledge(WordTable.of({})))
    assert len(n) == 40_000 and time.time() - t < 30


def test_collocations(spark):
    rows = [("Len", "p", "0", 40), ("Len", "t", "March", 30), ("Len", "t", "Board", 500), ("Len", "t", "The", 900), ("Len", "t", "word", 20_000), ("Len", "b", "The", 600), ("Len", "b", "x", 400)]
    rows += [("Len", "f", "0 March", 25), ("Len", "f", "0 The", 12), ("Len", "f", "0 Board", 1), ("Len", "f", "end The", 500), ("Len", "f", "end March", 4)]
    got = {(r.word, r.flags) for r in s.judged(spark.createDataFrame(rows, "lang string, what string, word string, n long")).collect()}
    # a starter is no collocation, nor is what follows an ordinary word
    assert ("0 March", s.COLLOCATION) in got and ("The", s.STARTER) in got and not {w for w, _ in got} & {"0 The", "0 Board", "end March", "end The"}


def test_languages():
    assert s.language("Il lucchetto non è della coda, più di una volta") == "Lit" and s.language("De rij is niet van het slot en dat is te zien") == "Lnl"
    assert s.language("Die Sperre ist nicht für die Schlange") == "Lde" and s.language("xyzzy", "fr") == "Lfr" and s.language("") == "Len"
    assert s.part_language("ロックは動く wake_node()", [], "J") == "J" and s.part_language("The lock of the queue", "The lock of the queue".split(), "J") == "Len"


def test_tokens_and_gaps_of_any_length():
    known = s.AllKnowledge(WordTable.of({"Len\x1f" + "x" * 90: s.INNER}))
    assert s.starts("The " + "x" * 90 + ". said so." + " " * 100 + "Then it ended.", known) == [0, 204]


def test_word_tables(spark):
    from sedimenta.llm import tables

    words = spark.createDataFrame([("a", 1), ("b", 2), ("a", 4)], "word string, flags int")
    out = words.select("word").mapInPandas(lambda it, name=tables.write_words(words): (b.assign(f=[tables.table_of(name)[w] for w in b["word"]]) for b in it), "word string, f int")
    assert {(r.word, r.f) for r in out.collect()} == {("a", 5), ("b", 2)}
    assert tables.WordTable.of({})["a"] == 0
