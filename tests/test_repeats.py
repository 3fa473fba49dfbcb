from pyspark.sql import functions as F

from sedimenta.functions.keys import label_key, message_key
from sedimenta.operators import repeats


def test_message_key(spark):
    rows = [("<a.B@X.Org>", "a.B@x.org"), (" a.B@x.ORG\t", "a.B@x.org"), ("<A.b@x.org>", "A.b@x.org"), ("", None), (" <> ", None), (None, None), ("noat", "noat"), ("a@b@C", "a@b@c")]
    got = spark.createDataFrame(rows, "v string, want string").select(message_key(F.col("v")).alias("k"), "want").collect()
    assert [r.k for r in got] == [r.want for r in got]


def test_label_key(spark):
    rows = [("Api – Stability",), ("api_stability",), (" API-STABILITY\t",), ("api‑stability",)]
    got = {r.k for r in spark.createDataFrame(rows, "v string").select(label_key(F.col("v")).alias("k")).collect()}
    assert got == {"api-stability"}


def source(path, keys=("mid",)):
    exprs = tuple(message_key(F.col(k)) if k == "mid" else F.col(k) for k in keys)
    return repeats.Source("t", path, exprs, F.col("id"))


def brute(rows, keys):
    seen, drop = set(), []
    for r in sorted(rows, key=lambda r: r["id"]):
        k = tuple(r[x] for x in keys)
        if any(x is None for x in k):
            continue
        if k in seen:
            drop.append(r["id"])
        seen.add(k)
    return sorted(drop)


def test_hot_identifier_over_many_files(spark, tmp_path):
    # one identifier holds a third of all rows, spread over all files
    rows = [{"id": i, "mid": "hot@x" if i % 3 == 0 else f"m{i % 400}@x", "n": None if i % 97 == 0 else i % 2, "payload": "p" * (i % 50), "__row": i} for i in range(3000)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id long, mid string, n int, payload string, `__row` int").drop("__row").withColumn("tab", F.lit("clash")).repartition(7).write.parquet(path)
    s = source(path, ("mid", "n"))
    want = brute(rows, ("mid", "n"))
    assert sorted(r.row_id for r in repeats.find_repeats(spark, [s]).collect()) == want
    kept = repeats.drop_repeats(spark, s)
    assert kept.columns == ["id", "mid", "n", "payload", "tab"]
    assert sorted(r.id for r in kept.collect()) == sorted({r["id"] for r in rows} - set(want))


def test_repeated_rows_and_missing_identifiers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(2, "a@x"), (1, "<a@X>"), (3, None), (4, ""), (5, None), (1, "a@x")], "id long, mid string").coalesce(1).write.parquet(path)
    got = sorted(r.row_id for r in repeats.find_repeats(spark, [source(path)]).collect())
    assert got == [1, 2]  # the row repeated as a whole stays once
    assert sorted(r.id for r in repeats.drop_repeats(spark, source(path)).collect()) == [1, 3, 4, 5]


def test_wide_rows_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).selectExpr("id", "concat(id % 150000, '@x') as mid", "'p' as payload").repartition(3).write.parquet(path)
    kept = repeats.drop_repeats(spark, source(path))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert kept.count() == 150_000 and kept.agg(F.max("id")).first()[0] == 149_999


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([], "id long, mid string").write.parquet(path)
    assert repeats.find_repeats(spark, [source(path)]).count() == 0
    assert repeats.drop_repeats(spark, source(path)).count() == 0
