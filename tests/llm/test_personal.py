import pytest

from sedimenta.llm import personal as p

GIVEN, FAMILY = {"Ann", "Rose", "Will", "Mark", "Zoë"}, {"Lee", "Marby", "Kessfeldt"}
CASES = [
    ("Mail ann.lee@x.example or ann-lee (at) y.example now", [("email", "ann.lee@x.example"), ("email", "ann-lee (at) y.example")]),
    ("Write to ann lee? no: ann.lee at kestrel dot example.", [("email", "ann.lee at kestrel dot example")]),
    ("In message <20080105.6f5ff339-digest@lists.example.org>, Zoë Marby wrote:", [("name", "Zoë Marby")]),
    ("Clone git@forge:tools/x; memcpy@plt; root@board144: # make", []),
    ("Call Ann at +1 (202) 555-0138 or +49 (0)30 / 23125-170, tel. 01.99.00.62.41", [("name", "Ann"), ("phone", "+1 (202) 555-0138"), ("phone", "+49 (0)30 / 23125-170"), ("phone", "01.99.00.62.41")]),
    ("Build 2014.555.0110 was good. Sizes 1024-4096-8192. Slope 5550 - 0123 per step. Version 5.5.11-rc4", []),
    ("passport 979-37-5870, id QQ 97 76 86 C, id 171313-5584 and 71137367G", [("identity", x) for x in ("979-37-5870", "QQ 97 76 86 C", "171313-5584", "71137367G")]),
    ("Send it to Flat 17, 170 Copper Close, Norhafen TN5 8XX, it is faster", [("address", "Flat 17, 170 Copper Close, Norhafen TN5 8XX")]),
    ("Millweg 188c, D-32856 Thalby and P.O. Box 401, Kesselau 42459", [("address", "Millweg 188c, D-32856 Thalby"), ("address", "P.O. Box 401, Kesselau 42459")]),
    ("> My name is Zoë\n> Marby and 112, rue du Sandpiper,\n> 25466 Pelvane.", [("name", "Zoë\n> Marby"), ("address", "112, rue du Sandpiper,\n> 25466 Pelvane")]),
    ("The Rose board. Mark the page dirty. Will it build?", []),
    ("Dear Rose,\nsays Will. Kessfeldt, Mark and A. Marby and Ann von der Lee", [("name", "Rose"), ("name", "Will"), ("name", "Kessfeldt, Mark"), ("name", "A. Marby"), ("name", "Ann von der Lee")]),
]


MORE_GIVEN = [f"{a}{b}" for a in ("Ba", "Co", "Di", "Fe", "Gu", "Hal") for b in ("rin", "mar", "lda", "wen", "tan")]
MORE_FAMILY = [f"{a}{b}" for a in ("North", "Quel", "Stur", "Tarn", "Wex") for b in ("feld", "dersen", "pitz", "vane", "holm", "gren")]


def filler():
    """Texts with many names, numbers and addresses, and with what looks like some but is always
    the same."""
    for i in range(240):
        g, f, n = MORE_GIVEN[i % 30], MORE_FAMILY[(i * 7) % 30], 100 + i
        yield [
            f"Mail {g.lower()}.{f.lower()}@x.example or {g.lower()}-{f.lower()} (at) y.example now. The note of {g} {f} is long.",
            f"Write to {g.lower()}.{f.lower()} at kestrel dot example. Dear {g},\nsays {g}. {f}, {g} and A. {f}",
            f"In message <20080105.6f5f{n:04x}-digest@lists.example.org>, {g} {f} wrote:",
            f"Call {g} at {{}} or {{}}, tel. {{}} or {{}} or {{}}".format(*(x := [f"+1 (202) 555-0{n}", f"+49 (0)30 / 23125-{n}", f"01.99.00.62.{i % 90 + 10}", f"{n}-{n}-0{n}", f"{n}.{n}.0{n}"])[i // 8 % 5 :], *x[: i // 8 % 5]),
            f"Build 2014.555.0{n} was good. Sizes 1024-4096-8{n}. The Rose board. Mark the page dirty. Will it build?",
            "passport {}, id {}, id {} and {}".format(*(x := [f"{n}-37-5{n}", f"QQ {i % 90 + 10} 76 86 C", f"171{n}-5{n}", f"71137{n}G"])[i // 8 % 4 :], *x[: i // 8 % 4]),
            f"Send it to Flat 17, {n} Copper Close, Norhafen TN5 8XX, or to P.O. Box {n}, Kesselau 42459",
            f"Millweg {n}c, D-32856 Thalby and {n}, rue du Sandpiper, 25466 Pelvane.",
        ][i % 8]


@pytest.fixture(scope="module")
def mentions(spark):
    rows = [("t", i, t) for i, (t, _) in enumerate(CASES)]
    filler_rows = [("f", 1000 + i, t) for i, t in enumerate(filler())]
    extra = [("t", 500, None), ("t", 501, ""), ("t", 502, "  ")]
    texts = spark.createDataFrame([*rows, *filler_rows, *extra], "tab string, row_id long, text string").selectExpr("*", "'x' as kind", "1 as m")
    emails = spark.createDataFrame([("Zoë Marby",), ("Ann Lee",), (None,), ("Odd",), *[(f"{g} {f}",) for g, f in zip(MORE_GIVEN, MORE_FAMILY, strict=True)]] * 3, "from_name string")
    known = spark.createDataFrame([*[(n, "given") for n in GIVEN], *[(n, "family") for n in FAMILY], (None, "given")], "name string, name_part string")
    return texts, p.find_mentions(texts.select("tab", "row_id", "text"), emails, known), p.replace(texts, emails, known)


def test_cases(mentions):
    _, found, _ = mentions
    got = {}
    for r in found.filter("tab = 't'").collect():
        got.setdefault(r.row_id, []).append((r.start_pos, r.end_pos, r.kind))
    for i, (text, want) in enumerate(CASES):
        assert [(k, text[a:b]) for a, b, k in sorted(got.get(i, []))] == want, text
    assert not {500, 501, 502} & set(got)


def test_replaced(mentions):
    texts, found, replaced = mentions
    out = {r.row_id: r.text for r in replaced.filter("tab = 't'").collect()}
    assert out[0] == "Mail [EMAIL] or [EMAIL] now" and out[3] == CASES[3][0] and out[500] is None and out[501] == "" and out[502] == "  "
    assert out[9] == "> My name is [NAME] and [ADDRESS]."
    # the text is what the mentions leave of it
    spans = {}
    for r in found.collect():
        spans.setdefault((r.tab, r.row_id), []).append((r.start_pos, r.end_pos, p.KINDS.index(r.kind)))
    new = {(r.tab, r.row_id): r.text for r in replaced.collect()}
    assert len(new) == texts.count()
    for r in texts.collect():
        assert new[r.tab, r.row_id] == (None if r.text is None else p.replaced(r.text, sorted(spans.get((r.tab, r.row_id), []))))
    plan = replaced._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_estimation_separates():
    e = p.estimate({(0, p.vote_code((1, 1, 1, 0))): 900, (0, p.vote_code((1, 0, 0, 0))): 60, (0, p.vote_code((1, 0, 0, -1))): 300})
    assert e[0, p.vote_code((1, 1, 1, 0))] > 0.9 and e[0, p.vote_code((1, 0, 0, -1))] < 0.1


def test_empty(spark):
    texts = spark.createDataFrame([], "tab string, row_id long, text string")
    assert p.find_mentions(texts, spark.createDataFrame([], "from_name string"), spark.createDataFrame([], "name string, name_part string")).count() == 0


def test_long_text_is_linear():
    import time

    lab = p.Labelers(p.gazetteer_of(GIVEN, FAMILY))
    t = time.time()
    spans = lab.spans("Ask Zoë Marby at ann.lee@x.example or +1 (202) 555-0138. " * 8000)
    assert len(spans) == 24000 and time.time() - t < 20


@pytest.mark.parametrize(
    ("text", "kind", "mention"),
    [
        ("Send it to 12, avenue Victor, 75016 Paris now", "address", "12, avenue Victor, 75016 Paris"),
        ("Send it to Paseo Mayor 12, 3º B, 28001 Madrid now", "address", "Paseo Mayor 12, 3º B, 28001 Madrid"),
        ("Send it to 12 Copper Way, Norhafen 25466 now", "address", "12 Copper Way, Norhafen 25466"),
        ("Send it to Lindenallee 7, 25466 Thalby now", "address", "Lindenallee 7, 25466 Thalby"),
        ("Mail ann.lee {at} y.example now", "email", "ann.lee {at} y.example"),
        ("Mail ann.lee (AT) y [DOT] example now", "email", "ann.lee (AT) y [DOT] example"),
        ("Mail ann.lee <at> y(dot)example now", "email", "ann.lee <at> y(dot)example"),
    ],
)
def test_no_prefilter_is_narrower_than_its_pattern(text, kind, mention):
    at = text.index(mention)
    found = p.Labelers(p.gazetteer_of(GIVEN, FAMILY)).spans(text)
    assert (at, at + len(mention), p.KINDS.index(kind)) in [(x.start, x.end, x.kind) for x in found]


def test_tokens_of_any_length():
    lab, local = p.Labelers(p.gazetteer_of(GIVEN, FAMILY)), "a" * 300
    text = f"mail {local}@x.example and {'z' * 90} Mark-up, Zoë's, ANN LEE"
    assert [(text[x.start : x.end], p.KINDS[x.kind]) for x in lab.spans(text)] == [(f"{local}@x.example", "email"), ("Mark", "name"), ("Zoë", "name"), ("ANN LEE", "name")]
    assert p.left_word("x " + "y" * 80 + " 1", 83) == "y" * 80 and p.left_word("end. A", 5) == "" and p.right_word("A " + "y" * 80, 1) == "y" * 80


def test_words_that_stand_beside_the_same_few_speak_against(spark):
    rows = [("t", i, 4, 0, 1, 0, 1, 0, i % 60, i, 5, 0) for i in range(120)] + [("t", i, 4, 0, 1, 0, 1, 0, 7, 200 + i, 6, 0) for i in range(20)] + [("t", i, 4, 0, 1, 0, 1, 0, 7, 300 + i % 3, 8, 0) for i in range(90)]
    j = p.beside(spark.createDataFrame(rows, "tab string, row_id long, kind int, start long, end long, pattern int, known int, against int, what int, around int, left int, right int"))
    assert (j.left[5], j.left[6], j.left[8]) == (1, -1, 0) and not j.right.any()
