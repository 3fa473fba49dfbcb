"""The driver's contract, the independence of the core, and the command line."""

import importlib
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark, data):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert "category" in df.columns and df.count() > 0


def test_core_does_not_need_llm():
    code = "import sys; sys.modules['sedimenta.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p7_ids' not in q; print(len(q))"
    r = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert r.returncode == 0, r.stderr
    used = [p for p in (ROOT / "sedimenta").rglob("*.py") if "llm" not in p.parts and ".llm" in p.read_text("utf-8")]
    assert used == []


@pytest.mark.parametrize("name", ["p2_found", "p4_found", "clean_body", "review_filter", "stratified_sample", "manifest_by_year", "merged_chunks", "html_visible_text", "parse_reviews", "passage_split", "verdict_score"])
def test_queries_agree_with_sql(spark, data, name):
    import duckdb

    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, data)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    key = sorted(names)
    want = sorted(tuple(text(r[names.index(k)]) for k in key) for r in cur.fetchall())
    got = sorted(tuple(text(r[k]) for k in key) for r in df.collect())
    assert got == want


def test_settings(tmp_path, monkeypatch):
    from sedimenta.config import Settings

    f = tmp_path / ".env"
    f.write_text("# c\nSEDIMENTA_SAMPLE=7\nbad\nSEDIMENTA_SEED='x'\n")
    monkeypatch.setenv("SEDIMENTA_SEED", "9")
    s = Settings.load(str(f))
    assert (s.sample, s.seed, s.workers) == (7, "9", 8)


def test_pipeline(spark, data, tmp_path):
    from sedimenta import cli, pipeline
    from sedimenta.operators import mappers

    e = spark.read.parquet(f"{data}/emails.parquet")
    reviews, out = pipeline.classify(e), str(tmp_path / "moves")
    pipeline.extract(reviews, mappers.RuleMapper(cli.RULES), out, sample=50)
    n = spark.read.parquet(out).count()
    assert n == 50
    pipeline.extract(reviews, mappers.RuleMapper(cli.RULES), out, sample=0, resume=True)
    assert spark.read.parquet(out).count() > n
    m = pipeline.flat(spark.read.parquet(out), "email")
    p = pipeline.cluster(m, 5)
    assert p.groupBy("category").count().agg({"count": "max"}).first()[0] <= 5
    assert pipeline.prompt(p).startswith(f"{p.count()} patterns\ncategories: ") and "\n## " in pipeline.prompt(p)
    assert pipeline.calibrate(m)["corpus"].count() > 1 and pipeline.calibrate(m)["trends"].count() > 0
    d = spark.read.parquet(f"{data}/documents.parquet").filter("doc_kind = 'interview'")
    assert pipeline.classify_interviews(d, "doc_id").filter("passage_id = 'source-001'").count() == 1
    assert pipeline.cluster_sources(m, m.limit(0), 5).count() > 0
    assert os.path.isdir(out)
