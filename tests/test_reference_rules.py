"""Hand-derived cases of the text rules, samples, checks and matching."""

import json

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import labels, text
from sedimenta.operators import documents, findings, mappers, moves, passages, quality, sampling, stats
from sedimenta.sources import jsonl, mail, news, sinks, web
from sedimenta.streaming import streams


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("v")).first().v


@pytest.mark.parametrize(("body", "want"), [("a\n> q\nb\n--\nsig", "a\nb"), ("--\na", "--\na"), ("a\n\n\n\nb", "a\n\nb"), ("> q\n--\nx\n -- \ny", "--\nx"), ("a\n" + "_" * 50 + "\nb", "a"), ("", ""), (None, None)])
def test_clean_body(spark, body, want):
    assert one(spark, text.clean_body(F.col("b")), b=body) == want


LONG = "x" * 31 + "\n" + "y" * 80


@pytest.mark.parametrize(
    ("subject", "reply", "body", "want"),
    [("Re: [PATCH] x", None, LONG, False), ("patch idea", None, LONG, True), ("Re: x", None, "z" * 99, False), ("Re: x", None, "z" * 100, True), ("Re: x", None, "\n".join(["w" * 30] * 5), False),
     ("Re: [GIT PULL] x", "m", LONG, False), ("hello", "", LONG, False), ("hello", "m", LONG, True), ("Re: [RFC] x", "m", LONG, False), ("Linux 5.9", "m", LONG, False), ("Re: x", None, "Signed-off-by: " + "n" * 100, False), (None, None, None, False)],
)
def test_is_review(spark, subject, reply, body, want):
    assert one(spark, labels.is_review(F.col("s"), F.col("r"), F.col("b")), s=subject, r=reply, b=body) is want


def test_phase_and_urgency(spark):
    p = labels.thread_phase(F.col("s"), F.col("r"))
    assert [one(spark, p, s=s, r=r) for s, r in [("Applied, thanks", "m"), ("unapplied", "m"), ("Merged", "")]] == ["final_decision", "iteration_n", "initial_review"]
    u = labels.urgency(F.col("s"), F.col("d"))
    assert [one(spark, u, s=s, d=d) for s, d in [("Linux 5.9-rc2", None), ("merge  window", None), ("x", None)]] == ["release_blocker", "release_blocker", "routine"]


def test_small_projections(spark):
    assert one(spark, text.replaced(F.col("v"), [("noinline", "no-optimization attribute"), ("inline", "hint")]), v="noinline inline") == "no-optimization attribute hint"
    at = text.location(F.col("v"), {"server.c": "core.c"})
    assert [tuple(one(spark, at, v=v)) for v in ("a/server.c:188-189", "lines 85, 127", "none")] == [("core.c", 188), (None, 85), (None, None)]
    cut = text.looks_truncated(F.col("v"))
    assert [one(spark, cut, v=v) for v in ("x" * 1998 + ".", "x" * 1999 + ".", "x" * 2000, None)] == [True, False, True, True]
    assert one(spark, text.without_fences(F.col("v")), v="```json\n{}\n```") == "{}"
    assert one(spark, text.word_count(F.col("v")), v=" a b\n c ") == 3
    assert one(spark, text.plain_punctuation(F.col("v")), v="a–b’s “q”") == "a-b's \"q\""


def test_passages(spark):
    long, short = "p" * 31, "q" * 30
    docs = spark.createDataFrame([("f1", f"{long}\r\n\r\n{short}\n \n{long}. More."), ("f2", None), ("f3", "")], "id string, t string")
    p = passages.split_passages(docs, "id", "t")
    assert [(r.id, r.pos) for r in p.orderBy("id", "pos").collect()] == [("f1", 0), ("f1", 1)]
    ctx = {r.pos: r.context for r in passages.with_context(p, "id").collect()}
    assert ctx[0] == long and ctx[1] == f"{long} | {long}"
    assert [r.passage_id for r in passages.passage_ids(p, "id").orderBy("pos").collect()] == ["source-001", "source-002"]


def test_stats_ties_and_zeros(spark):
    m = spark.createDataFrame([(1, "style", "approve", 2008), (2, "style", "reject", 2008), (3, "testing", "reject", None)], "move_id long, category string, severity string, year int")
    s = {r.category: r for r in stats.severity_by_category(m, labels.CALIBRATED, labels.SEVERITIES).collect()}
    assert s["style"].dominant_severity == "reject" and s["style"].nitpick == 0 and set(s) == {"style", "testing"}
    assert [(r.year, r.total, r.top_category) for r in stats.yearly_trends(m).collect()] == [(2008, 2, "style")]
    assert stats.severity_by_category(m.limit(0), labels.CALIBRATED, labels.SEVERITIES).count() == 0
    assert {r.what: r.cnt for r in stats.corpus_stats(m).collect()}["total"] == 3 and stats.corpus_stats(m.limit(0)).count() == 0


def test_canonical_labels(spark):
    c = labels.canonical(F.col("v"), labels.CALIBRATED, labels.CALIBRATION_CATEGORY)
    assert [one(spark, c, v=v) for v in ("security", "banana", "style", None)] == ["correctness", None, "style", None]
    rec = spark.createDataFrame([("k", [("reliability",), ("style",)])], "email_message_id string, moves array<struct<category:string>>")
    r = moves.migrate(rec, labels.MIGRATION_CATEGORY, {("k", 1): "testing"}).first()
    assert [m.category for m in r.moves] == ["error-handling", "testing"] and r.changed == 2
    long = spark.createDataFrame([(i, "k", "style") for i in range(250)] + [(900, None, "style")], "move_id long, email_message_id string, category string")
    for c in ("trigger", "principle", "response", "severity"):
        long = long.withColumn(c, F.lit("x"))
    n = moves.nest(long)
    assert sorted(r.first for r in n.collect()) == [0, 0, 100, 200]
    assert moves.migrate(n, {}, {("k", 105): "testing"}).agg(F.sum("changed")).first()[0] == 1


def test_samples(spark):
    rows = [(i, "c", 2000 + i % 10, "s" + str(i % 2), "r" * (i + 1)) for i in range(50)] + [(99, "d", 2000, "s0", "r")]
    df = spark.createDataFrame(rows, "id long, category string, year int, severity string, response string")
    pick = lambda d, seed="42": sorted(r.id for r in sampling.stratified(d, "category", ["year", "severity"], "id", 10, seed).collect())
    a = pick(df)
    assert len(a) == 11 and a == pick(df.repartition(5)) and a != pick(df, "99")
    got = df.filter(F.col("id").isin(a)).select("year", "severity").distinct().collect()
    assert len({r.year for r in got}) > 1 and len({r.severity for r in got}) > 1
    half = sampling.substantive_half(df.filter("id < 20 or id = 99"), "category", "response", "id")
    assert sorted(r.id for r in half.collect()) == [*range(10, 20), 99]
    two = spark.createDataFrame([(i, "c", "email") for i in range(100)] + [(100 + i, "c", "interview") for i in range(100)] + [(300 + i, "d", "email") for i in range(100)] + [(500, "d", "interview"), (501, "d", "interview")], "id long, category string, source string")
    b = sampling.balanced(two, "category", "source", "interview", "id", 25).groupBy("category", "source").count().collect()
    assert {(r.category, r.source): r["count"] for r in b} == {("c", "interview"): 13, ("c", "email"): 12, ("d", "interview"): 2, ("d", "email"): 23}


def test_flatten(spark):
    rec = spark.createDataFrame([("k", [("t", "q", None)]), ("e", []), ("n", None)], "email_message_id string, moves array<struct<trigger:string,quote:string,response:string>>")
    r = moves.flatten(rec, ["email_message_id"], source="email").collect()
    assert len(r) == 1 and r[0].response == "q" and r[0].category is None and r[0].source == "email"
    with pytest.raises(Exception, match="move without"):
        moves.flatten(rec, ["email_message_id"], lenient=False).collect()
    done = spark.createDataFrame([("k", None), ("e", "boom")], "key string, error string").withColumn("moves", F.array())
    assert [r.key for r in moves.skip_keys(done, "key").collect()] == ["k"] == [r.key for r in moves.done_keys(done, "key").collect()]


def test_json_checks(spark):
    good = {"email_message_id": "m", "email_date": "2020", "moves": [{"category": "style", "severity": "reject", "trigger": "t", "principle": "p"}]}
    bad = [{**good, "moves": [{**good["moves"][0], "trigger": 1}]}, {**good, "moves": [{**good["moves"][0], "severity": "high"}]}, {**good, "moves": [{k: v for k, v in good["moves"][0].items() if k != "principle"}]}, {"email_message_id": "m", "email_date": "d", "moves": {}}]
    lines = [json.dumps(good), *map(json.dumps, bad), "{oops", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = {(r.line_no, r.code) for r in quality.json_violations(df, labels.SEVERITIES, labels.CATEGORIES).collect()}
    assert got == {(1, "not_a_string"), (2, "unknown_severity"), (3, "missing_field"), (4, "moves_not_array"), (5, "invalid_json")}


def test_lint(spark):
    doc = 'a racy "racy"\n  > racy\n| h | i |\n|---|---|\n| racy | Racy |'
    lines = quality.doc_lines(spark.createDataFrame([(1, doc), (2, None)], "id int, t string"), "id", "t")
    assert [(r.line_no, r.term) for r in quality.term_hits(lines, "id", ["racy"]).orderBy("line_no").collect()] == [(1, "racy"), (5, "racy")]
    assert [(r.line_no, r.header) for r in quality.table_lines(lines, "id").collect()] == [(4, "| h | i |")]
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "name string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "name string, sha256 string")
    assert {r.name: r.status for r in quality.compare_checksums(a, b).collect()} == {"x": "ok", "y": "mismatch", "z": "missing", "w": "new"}


def test_documents(spark):
    files = spark.createDataFrame([("a", "x" * 30), ("b", "y" * 5), ("c", "z" * 5)], "name string, t string")
    assert [r.name for r in documents.within_budget(files, "name", "t", 20).collect()] == ["a"]
    assert [(r.name, len(r.t)) for r in documents.within_budget(files, "name", "t", 32, True).orderBy("name").collect()] == [("a", 30), ("b", 2)]
    assert one(spark, documents.sanitised(F.col("v"), [("lock", "guard")]), v='lock "lock" `lock`\n> lock') == 'guard "lock" `lock`\n> lock'
    assert one(spark, documents.without_tables(F.col("v")), v="| a | b |\n|---|---|\n| 1 | 2 |\nend") == "- **a**: 1\n- **b**: 2\n\nend"
    assert one(spark, documents.sanitised(F.col("v"), [("lock", "guard")]), v="“lock\n lock” \n   > lock\n>lock") == "“guard\n guard” \n   > lock\n>guard"
    assert one(spark, documents.without_tables(F.col("v")), v="a | b\n---|---\n| h |\n| -- |\n" + "| x |\n" * 5000) == "a | b\n---|---\n" + "- **h**: x\n\n" * 5000
    assert one(spark, documents.without_tables(F.col("v")), v=None) is None and one(spark, documents.sanitised(F.col("v"), []), v="") == ""
    patch = lambda t, p: one(spark, documents.patched_tail(F.col("v"), F.lit(p)), v=t)
    assert patch("x\n## Long heading\ncut", "y\n## Long heading\nwhole text\n## More") == "x## Long heading\nwhole text\n## More"
    assert patch("x\n## Long heading\n" + "cut " * 9, "y\n## Long heading\nwhole") == "y\n## Long heading\nwhole"
    assert patch("no section", "other") == "other" and patch("x", "") == "x" and patch(None, "y") == "y" and patch("x", None) == "x"


def test_parse_reviews(spark):
    doc = "intro\n## io/a.c\n### [HIGH] Bad lock\n- **Location:** x\n- **Location:** core/B.c:12-14\n- **Trigger**: t\n#### [LOW] Nit\n- **Location:** lines 7, 9\n"
    r = findings.parse_reviews(spark.createDataFrame([(1, doc), (2, None)], "id int, d string"), "id", "d").orderBy("finding_no").collect()
    assert [(x.severity, x.title, x.file, x.line, x.trigger) for x in r] == [("HIGH", "Bad lock", "b.c", 12, "t"), ("LOW", "Nit", "io/a.c", 7, None)]


def test_matching(spark):
    rows = [(1, "g", "f", 10, "race in queue"), (2, "h", "f", 20, "other"), (3, "h", "f", 21, "x"), (4, "m", "f", 90, "queue race again"), (5, "h", "e", 5, "y"), (6, "g", "f", None, "race in queue")]
    f = spark.createDataFrame(rows, "finding_id long, model string, file string, line int, title string").withColumn("severity", F.lit("HIGH"))
    groups = lambda words: {frozenset(x.ids) for x in findings.match_groups(f, "g", words=words).groupBy("file", "group_id").agg(F.collect_set("finding_id").alias("ids")).collect()}
    assert groups(2) == {frozenset({1, 2, 4}), frozenset({3}), frozenset({5}), frozenset({6})}
    assert groups(None) == {frozenset({1, 2}), frozenset({3}), frozenset({4}), frozenset({5}), frozenset({6})}
    assert findings.match_groups(f.limit(0), "g").count() == 0


def test_matching_agrees_with_all_pairs(spark):
    import random

    rng = random.Random(7)
    words = ["race", "queue", "lock", "leak", "buffer", "the"]
    rows = [(i, rng.choice("ghm"), rng.choice("ef"), rng.choice([None, 0, *range(1, 400, 7)]), rng.choice([None, " ".join(rng.sample(words, rng.randint(0, 3)))])) for i in range(300)]
    f = spark.createDataFrame(rows, "finding_id long, model string, file string, line int, title string")
    for common in (2, None):
        used, want = set(), set()
        for a in (r for r in rows if r[1] == "g"):
            want.add((a[0], a[0]))
            for m in "hm":
                for r in rows:
                    wa, wr = (set((x[4] or "").split()) - {"the"} for x in (a, r))
                    if r[1] == m and r[2] == a[2] and a[3] and r[0] not in used and (r[3] and abs(r[3] - a[3]) <= 10 or common and len(wa & wr) >= 2):
                        used.add(r[0])
                        want.add((a[0], r[0]))
                        break
        want |= {(r[0], r[0]) for r in rows if r[1] != "g" and r[0] not in used}
        assert {(r.group_id, r.finding_id) for r in findings.match_groups(f.repartition(5), "g", words=common).collect()} == want


def test_mappers(spark):
    rows = spark.createDataFrame([("a", "leaks memory"), ("b", None), ("c", "boom")], "id string, t string")

    def mapper(key, t):
        if t == "boom":
            raise ValueError("no")
        return mappers.RuleMapper((("leaks memory", "memory-safety", "reject"),))(key, t)

    r = {x.key: x for x in mappers.annotate(rows, "id", "t", mapper).collect()}
    assert len(r["a"].moves) == 1 and r["b"].moves == [] and r["c"].error == "ValueError: no"
    tries, waits = [], []

    def ask():
        tries.append(1)
        if len(tries) < 3:
            raise mappers.Retryable("busy", slow=len(tries) == 1)
        return []

    assert mappers.Retry(3, 1.0, 0.0).run(ask, waits.append) == [] and waits == [2.0, 2.0]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "k.jsonl"
    p.write_text('"a@x"\n\n{"skipped_ids": ["b", "c"]}\n{"email_message_id": "d"}\nplain\n"a@x"\n')
    assert {r.key for r in jsonl.read_keys(spark, str(p)).collect()} == {"a@x", "b", "c", "d", "plain"}
    lines = spark.createDataFrame([(1, '"a"'), (2, ""), (3, '"b"'), (4, '"br'), (5, '"c"')], "line_no long, value string")
    assert {r.key for r in jsonl.keys_before_corrupt(lines).collect()} == {"a", "b"}
    q = tmp_path / "r.jsonl"
    q.write_text('{"a": "1", "z": 2}\n\n{oops\n')
    assert sorted((r.a, r.corrupt) for r in jsonl.read_lenient(spark, str(q), "a string").filter("a is not null").collect()) == [("1", None)]
    assert jsonl.read_lenient(spark, str(q), "a string").filter("corrupt is not null").count() == 1
    assert [r.key for r in jsonl.unknown_keys(spark, str(q), ["a"]).collect()] == ["z"]
    assert jsonl.count_lines(spark, str(q)) == 2


@pytest.mark.parametrize("chunk", ["40", "1000000"])
def test_mbox_round_trip(spark, tmp_path, chunk):
    bodies = ["hello\nFrom here on\n>From there", "zwei é", ""]
    rows = [(i, f"<m{i}@x>", "Ann Lee", "ann@x.org", "Tue, 1 Apr 2008 10:00:00 +0200", f"s{i}", None, b) for i, b in enumerate(bodies)]
    e = spark.createDataFrame(rows, "delivery_id long, message_id string, from_name string, from_email string, date string, subject string, in_reply_to string, body string").withColumn("received_at", F.timestamp_seconds(F.lit(1207000000)))
    p = tmp_path / "a.mbox"
    p.write_text("\n".join(r.value for r in mail.to_mbox(e).orderBy("delivery_id").collect()), "utf-8")
    got = mail.parsed(mail.read_mbox(spark, str(p), chunkBytes=chunk)).orderBy("message_id").collect()
    assert [(r.message_id, r.from_name, r.date, r.body.strip()) for r in got] == [(f"<m{i}@x>", "Ann Lee", "2008-04-01T10:00:00+02:00", b) for i, b in enumerate(bodies)]
    assert mail.count_messages(spark, str(p)) == 3


def test_web(spark):
    assert web.visible_text("<p>A</p><script>x</script><p>B &amp; C</p>").split() == ["A", "B", "&", "C"]
    assert web.visible_text("a<!-- <p>b --><pre>c  d</pre><span title='>'>e</span><style>p > q</style><br>1 < 2") == "a\n\nc d\n\ne\n\n1\n<\n2"
    assert web.visible_text("") == "" and web.visible_text(None) is None and web.visible_text("<script>never closed <p>x") == ""
    assert web.visible_text("<nav><nav>x</nav>y</nav></nav>z") == "z"
    src = spark.createDataFrame([("a", "http://ok"), ("b", "http://youtube.com/1"), ("c", "http://no"), ("d", None)], "id string, url string")

    def fetch(url):
        if url == "http://ok":
            return "<p>" + "t" * 120 + "</p>"
        raise OSError("down")

    r = {x.id: x for x in web.fetched(src, fetch).collect()}
    assert r["a"].error is None and r["b"].error == "video" and r["c"].error == "OSError: down"
    doc = web.interview_file(F.lit("s1"), F.lit("T"), F.lit("2020"), F.lit("u"), F.lit("talk"), F.lit("text\n\n---\nmore"))
    i = spark.range(1).select(web.parse_interview(doc).alias("i")).first().i
    assert (i.title, i.source, i.date, i.kind, i.text) == ("T", "s1", "2020", "talk", "text\n\n---\nmore")


def test_news(spark):
    class Server:
        def headers(self, lo, hi):
            if lo == 11:
                raise OSError("gone")
            return [f"{n} {'Ann' if n % 2 else 'Bob'} <x>" for n in range(lo, hi + 1)] + ["x y"]

        def article(self, n):
            return b"raw %d" % n

    found = news.discover(spark, 1, 15, Server, "ann", batch=10)
    assert sorted((r.number, r.text is None) for r in found.collect()) == [(1, False), (3, False), (5, False), (7, False), (9, False), (11, True)]
    got = news.fetch(found, spark.createDataFrame([(3,)], "number long"), Server)
    assert sorted(r.number for r in got.collect()) == [1, 5, 7, 9, 11]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert json.loads(sinks.to_document(df, "k", ["v"])) == {"a": {"v": 1}, "b": {"v": 2}}
    p = str(tmp_path / "out")
    sinks.swap_in(df, p)
    sinks.swap_in(df.limit(1), p)
    assert spark.read.json(p).count() == 1 and spark.read.json(p + ".bak").count() == 2


def test_streams(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "k string, n int"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], schema).write.json(src)
    go = lambda: streams.append_once(streams.arrivals(spark, src, schema), ["k"], F.col("k").isNotNull(), out, ck).awaitTermination()
    go()
    spark.createDataFrame([("b", 5), ("c", 1)], schema).write.mode("append").json(src)
    go()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_enrichment_and_assembly(spark, tmp_path):
    from sedimenta.operators import enrich
    from sedimenta.sources import dispatch

    e = spark.createDataFrame([("<m@x>", "Re: x", "p", "2020", "w " * 60, " A@x, ,b@y", None, 1), ("", "s", None, None, "w " * 60, "", "", 2), ("<n@x>", None, None, None, None, None, "C@z", 3)], "message_id string, subject string, in_reply_to string, date string, body string, to_addrs string, cc_addrs string, delivery_id long")
    assert {(r.delivery_id, r.role, r.recipient) for r in enrich.recipients(e).collect()} == {(1, "to", "a@x"), (1, "to", "b@y"), (3, "cc", "c@z")}

    def bad(body):
        raise ValueError

    assert [(r.email_message_id, r.thread_phase, r.stakes, r.risk) for r in enrich.variations(e, bad).collect()] == [("<m@x>", "iteration_n", "medium", "correctness")]
    chunks = spark.createDataFrame([("d", 1, "sum\n## Findings\nx"), ("d", 2, "two")], "doc string, no int, t string")
    assert documents.merged_chunks(chunks, "doc", "no", "t").first().text == "sum\n\ntwo"
    assert json.loads(documents.as_prompt(chunks.limit(1), ["no"])) == [{"no": 1}]
    assert one(spark, text.from_rule(F.col("v")), v="a\n---\nb") == "---\nb" and one(spark, text.from_rule(F.col("v")), v="a") == ""
    assert one(spark, text.json_response(F.col("v"), "a int"), v="```\n{\"a\": 1}\n```").a == 1 and one(spark, text.json_response(F.col("v"), "a int"), v="oops") is None
    p = tmp_path / "c.jsonl"
    p.write_text('{"message_id": "a", "to": "t"}\n{"message_id": "b"}\n{"message_id": ""}\nbad\n')
    keys = spark.createDataFrame([("b",)], "key string")
    assert [(r.message_id, r.to_addrs) for r in dispatch.read_emails(spark, str(p), keys).collect()] == [("a", "t")]
    dispatch.append_keys(keys, str(tmp_path / "keys"))
    assert [r.key for r in jsonl.read_keys(spark, str(tmp_path / "keys")).collect()] == ["b"]


def test_fallback_and_counters(spark):
    def down(key, t):
        raise OSError("down")

    m = mappers.Fallback((down, mappers.RuleMapper((("x", "style", "nitpick"),))))
    rows = spark.createDataFrame([("a", "x x"), ("b", "")], "id string, t string")
    r, seen = mappers.observed(mappers.annotate(rows, "id", "t", m))
    r.collect()
    assert seen.get == {"records": 2, "moves": 2, "errors": 0}
    stored = spark.createDataFrame([("a", [], None)], mappers.RESULT)
    assert {x.key: x.error for x in mappers.replay(rows, "id", stored).collect()} == {"a": None, "b": "no stored result"}


def test_windows_and_sessions(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", "a" if d % 2 else "b") for d in (1, 2) for h in (0, 1, 2)]
    df = spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streams.into_memory(streams.windowed_counts(s, "t", "k"), "w1", "complete").collect()
    assert sorted((str(r.start)[:10], r.k, r.n) for r in out) == [("2024-01-01", "a", 3), ("2024-01-02", "b", 3)]
    assert sorted((r.k, r.n) for r in streams.session_counts(df, "t", "k", "90 minutes").collect()) == [("a", 3), ("b", 3)]


def test_all_chunks_of_a_document_are_merged(spark, data, monkeypatch):
    from sedimenta.plans import reference_queries

    monkeypatch.setattr(documents, "PART_CHUNKS", 3)
    rows = [("hot", i, f"c{i}. d{i}") for i in range(1, 41)] + [("cold", 1, "only. x"), (None, 1, "a"), (None, 2, None), (None, 3, "b"), ("void", 1, None)]
    chunks = spark.createDataFrame(rows, "doc string, id int, t string").repartition(5)
    got = {r.doc: r.text for r in documents.merged_chunks(chunks, "doc", "id", "t", ". ").collect()}
    assert got == {"hot": "\n".join(["c1", *(f"c{i}. d{i}" for i in range(2, 41))]), "cold": "only", None: "a\nb", "void": ""}
    want = spark.read.parquet(f"{data}/passages.parquet").filter("text is not null")
    whole = reference_queries.registry.queries["merged_chunks"](spark, data)
    per_source = {r.source_file: r["count"] for r in want.groupBy("source_file").count().collect()}
    assert max(per_source.values()) > 5 and {r.source_file: r.text.count("\n") + 1 >= per_source[r.source_file] for r in whole.collect()} == dict.fromkeys(per_source, True)
