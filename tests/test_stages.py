"""Stages, commands, validators and the news client."""

import json
import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from sedimenta import cli, pipeline
from sedimenta.functions import labels
from sedimenta.operators import enrich, findings, joins, quality, stats
from sedimenta.sources import dispatch, jsonl, news, sinks


@pytest.fixture
def stage(spark, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    return lambda folder, *args: cli.main(["--data", str(folder), *args])


def test_commands(spark, data, tmp_path, stage):
    for name in ("emails", "documents", "interview_sources"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(400).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert stage(tmp_path, "cluster") == 1  # no moves yet
    assert stage(tmp_path, "run", "--sample", "0") == 0
    m = spark.read.parquet(str(tmp_path / "moves"))
    assert {"date", "tz_name", "subject"} <= set(m.columns)
    assert spark.read.parquet(str(tmp_path / "patterns")).filter("year is not null").count() > 0
    assert (tmp_path / "skill.md").read_text("utf-8").startswith("# skill")
    assert stage(tmp_path, "calibrate") == 0
    assert spark.read.parquet(str(tmp_path / "calibration/trends")).count() > 0
    assert stage(tmp_path, "interlocutor") == 0 and stage(tmp_path, "interlocutor", "--resume") == 0
    told = spark.read.parquet(str(tmp_path / "interlocutors"))
    assert told.count() == told.select("email_message_id", "recipients").distinct().count() or told.count() > 0
    assert stage(tmp_path, "variation") == 0 and stage(tmp_path, "soul") == 0
    assert "## Interlocutors" in (tmp_path / "soul.md").read_text("utf-8")
    assert stage(tmp_path, "interviews-pipeline") == 0
    assert spark.read.parquet(str(tmp_path / "calibration_both/sources")).count() >= 1
    assert stage(tmp_path, "migrate", "--dry-run") == 0 and not (tmp_path / "moves_migrated").exists()
    assert stage(tmp_path, "distill", "--single-call", "--out", str(tmp_path / "one.md")) == 0 and "patterns" in (tmp_path / "one.md").read_text("utf-8")


def test_checksums(spark, tmp_path, stage):
    (tmp_path / "a.parquet").write_bytes(b"1")
    assert stage(tmp_path, "checksums", "generate") == 0 == stage(tmp_path, "checksums", "verify")
    (tmp_path / "a.parquet").write_bytes(b"2")
    (tmp_path / "b.parquet").write_bytes(b"3")
    assert stage(tmp_path, "checksums", "verify") == 1
    assert stage(tmp_path, "checksums", "update") == 0 == stage(tmp_path, "checksums", "verify")
    assert spark.read.json(str(tmp_path / "checksums")).count() == 2


def test_validate(spark, tmp_path, stage):
    assert stage(tmp_path, "validate") == 1  # no files
    move = {"category": "style", "severity": "reject", "trigger": "t", "principle": "p"}
    (tmp_path / "moves.jsonl").write_text(json.dumps({"email_message_id": "m", "email_date": "d", "moves": [move]}) + "\n")
    (tmp_path / "patterns.json").write_text(json.dumps([{**move, "source": "email"}]))
    (tmp_path / "calibration.json").write_text(json.dumps({"severity_by_category": {}, "temporal_trends": {}, "corpus_stats": {"total_moves": 3}}))
    assert stage(tmp_path, "validate") == 0
    (tmp_path / "moves.jsonl").write_text("{oops\n" + json.dumps({"email_message_id": "m", "moves": [move]}) + "\n")
    (tmp_path / "patterns.json").write_text(json.dumps([1, {**move, "category": "x", "trigger": 2, "source": "web", "quote": 1}, {}]))
    (tmp_path / "calibration.json").write_text(json.dumps({"severity_by_category": [], "corpus_stats": {"total_moves": "3"}}))
    got = {(r.file, r.place, r.code, r.detail) for r in quality.folder_violations(spark, str(tmp_path), labels.SEVERITIES, labels.CATEGORIES).collect()}
    assert got == {
        ("moves.jsonl", 1, "invalid_json", ""), ("moves.jsonl", 2, "missing_key", "email_date"),
        ("patterns.json", 0, "not_an_object", ""), ("patterns.json", 1, "unknown_category", "x"), ("patterns.json", 1, "not_a_string", "trigger"), ("patterns.json", 1, "not_a_string", "quote"), ("patterns.json", 1, "unknown_source", "web"),
        *[("patterns.json", 2, "missing_field", f) for f in ("category", "severity", "trigger", "principle")],
        ("calibration.json", None, "section_not_an_object", "severity_by_category"), ("calibration.json", None, "missing_section", "temporal_trends"), ("calibration.json", None, "not_a_whole_number", "total_moves"),
    }
    for text, code in (("{", "invalid_json"), ("{}", "not_an_array")):
        (tmp_path / "patterns.json").write_text(text)
        assert code in {r.code for r in quality.folder_violations(spark, str(tmp_path), labels.SEVERITIES, labels.CATEGORIES).filter("file = 'patterns.json'").collect()}


def test_strict_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"a": "1"}\n\n{"a": "2"}\n')
    assert sorted(r.a for r in jsonl.read_strict(spark, str(p), "a string").collect()) == ["1", "2"]
    p.write_text('{"a": "1", "z": 1}\n')
    with pytest.raises(Exception, match="unknown keys: z"):
        jsonl.read_strict(spark, str(p), "a string").collect()
    p.write_text("{oops\n")
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(p), "a string").collect()
    dispatch.append_keys(spark.createDataFrame([("b",), ("a",), ("b",)], "k string").coalesce(1), str(tmp_path / "keys"))
    assert [r.value for r in spark.read.text(str(tmp_path / "keys")).collect()] == ["a", "b"]


class _Server(socketserver.StreamRequestHandler):
    def handle(self):
        self.wfile.write(b"200 ready\r\n")
        for line in self.rfile:
            word, *rest = line.decode().split()
            if word == "GROUP":
                self.wfile.write(b"211 4 1 4 g\r\n" if rest == ["g"] else b"411 no such group\r\n")
            elif word == "XHDR":
                lo, hi = map(int, rest[1].split("-"))
                self.wfile.write(b"221 follows\r\n" + b"".join(b"%d Ann <ann@x>\r\n" % n if n % 2 else b"%d Bob\r\n" % n for n in range(lo, hi + 1)) + b".\r\n")
            elif word == "ARTICLE":
                self.wfile.write(b"220 follows\r\nSubject: s\r\n\r\n..dot\r\nend\r\n.\r\n")
            elif word == "QUIT":
                self.wfile.write(b"205 bye\r\n")
                return


@pytest.fixture
def server():
    class Threads(socketserver.ThreadingTCPServer):
        allow_reuse_address = True

    with Threads(("127.0.0.1", 0), _Server) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield s.server_address[1]
        s.shutdown()


def test_news_client(spark, server, tmp_path, stage):
    with news.NewsClient("127.0.0.1", server) as c:
        assert c.group("g") == (4, 1, 4) and c.headers(1, 2) == ["1 Ann <ann@x>", "2 Bob"]
        assert c.article(1) == b"Subject: s\n\n.dot\nend\n"
        with pytest.raises(news.NewsError):
            c.group("none")
    assert stage(tmp_path, "fetch", "--host", "127.0.0.1", "--port", str(server), "--group", "g", "--sender", "ann@x", "--batch-size", "2") == 0
    assert sorted(r.number for r in spark.read.parquet(str(tmp_path / "news/articles")).collect()) == [1, 3]
    # what was scanned isn't scanned again, what was stored isn't fetched again
    assert news.scanned_to(spark, str(tmp_path / "news"), 1) == 5
    assert stage(tmp_path, "fetch", "--host", "127.0.0.1", "--port", str(server), "--group", "g", "--sender", "ann@x") == 0
    assert spark.read.parquet(str(tmp_path / "news/articles")).count() == 2


def test_review_files_of_any_layout(spark):
    docs = spark.createDataFrame([("baseline-1.md", "# io/a.c\n## [HIGH] One\n- **Location:** lines 3"), ("x.md", "## io/a.c\n### [LOW] Two\n"), ("y.md", "# io/b.c\n## [LOW] Three\n"), ("z.md", "nothing")], "name string, t string")
    got = {(r.name, r.title, r.file) for r in findings.parse_files(docs, "name", "t").collect()}
    assert got == {("baseline-1.md", "One", "io/a.c"), ("x.md", "Two", "io/a.c"), ("y.md", "Three", "io/b.c")}


def test_written_with_fallback(spark):
    p = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "name string, prompt string")

    def writer(name, prompt):
        if name == "c":
            raise ValueError("no")
        return "## Section one\nwhole text of enough words to be taken as such.\n" + ("## Section two\ncut off in" if name == "b" else "## Section two\nends here with lock.")

    def other(name, prompt):
        return "## Section zero\n## Section two\ncut off in the middle, but not here and not in the lock.\n| a | b |\n|---|---|\n| 1 | 2 |\nEnd."

    got = {r.name: r for r in pipeline.written(p, writer, other, replacements=[("lock", "guard")]).collect()}
    assert got["a"].text.endswith("ends here with guard.") and got["a"].error is None
    assert "Section one" in got["b"].text and "not in the guard." in got["b"].text and "- **a**: 1" in got["b"].text
    assert got["c"].text.startswith("## Section zero") and got["c"].error is None
    alone = {r.name: r for r in pipeline.written(p, writer).collect()}
    assert alone["c"].text is None and alone["c"].error == "ValueError: no"


def test_interlocutors_and_voice(spark):
    body = "please look " * 30
    e = spark.createDataFrame([("m1", "a@x.org", "B@x.org, c@y.org", "d+review@z.org", body), ("m2", None, None, None, body), (None, "a@x", "b@x", "", body), ("m3", "a@x", "b@x", "", "short")], "message_id string, from_email string, to_addrs string, cc_addrs string, body string")
    got = {r.email_message_id: r for r in enrich.interlocutors(e).collect()}
    assert [(r.recipient, r.relationship, r.tone) for r in got["m1"].recipients] == [("b@x.org", "peer", "formal"), ("c@y.org", "newcomer", "formal"), ("d+review@z.org", "maintainer", "formal")]
    assert got["m2"].recipients == [] and set(got) == {"m1", "m2"}

    def broken(*_):
        raise ValueError("no")

    assert {r.error for r in enrich.interlocutors(e, broken).collect()} == {"ValueError: no"}
    v = stats.voice(spark.createDataFrame([("- damn\n- this might do?",), (None,)], "r string"), "r").first()
    assert (v.swearing_pct, v.hedging_pct, v.question_pct, v.list_pct, v.list_lines_pct, v.humour_pct) == (50.0, 50.0, 50.0, 50.0, 100.0, 0.0)


def test_dealt_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    a = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(900)] + [(1000, None), (1001, "only")], "id int, k string")
    b = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), *[(f"k{i}", i) for i in range(900)]], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(tuple, a.join(b, "k", how).collect()), key=str)
        assert sorted(map(tuple, joins.dealt_join(a, b, "k", how).collect()), key=str) == want
    assert joins.dealt_join(a.limit(0), b, "k").count() == 0


def test_manifest(spark):
    e = spark.createDataFrame([(0, "a"), (86_400_000_000 * 366, "b"), (None, "a"), (None, None)], "utc_us long, from_email string")
    m = sinks.manifest(e).first()
    assert (m.messages, m.first_date, m.last_date, m.by_year, m.senders) == (4, "1970-01-01T00:00:00Z", "1971-01-02T00:00:00Z", {"1970": 1, "1971": 1, "unknown": 2}, 2)
    files = spark.createDataFrame([("x", "s", 3), ("y", "t", 4)], "name string, sha256 string, size_bytes long")
    c = sinks.with_corpus(sinks.manifest(e), files).first().corpus
    assert (c.files, c.bytes, c.parts[1].name) == (2, 7, "y")
    assert sinks.manifest(e.limit(0)).first().messages == 0
    with pytest.raises(ValueError):
        sinks.to_document(e.filter("utc_us is not null").withColumn("k", F.col("from_email")), "k", ["utc_us"], 1)


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"technical": ["spinlock"]}')
    lex = labels.Lexicon.read(spark, str(tmp_path / "l.json"))
    assert lex.technical == ["spinlock"] and lex.personal == labels.Lexicon().personal
    (tmp_path / "l.json").write_text('{"other": []}')
    with pytest.raises(ValueError, match="other"):
        labels.Lexicon.read(spark, str(tmp_path / "l.json"))
