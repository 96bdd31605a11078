import pytest
from pyspark.sql import functions as F

from stihora.operators import ml as M
from stihora.sources import files
from stihora.streaming import streams


def test_rejects_are_kept_with_their_reason(spark, tmp_path):
    (tmp_path / "a.csv").write_text('author,title,text\nА,Прва,"ред ""еден""\nред два"\nБ,Втора,текст,вишок\n,Трета,текст\n', encoding="utf-8")
    good, bad = files.read_csv_checked(spark, str(tmp_path / "a.csv"), ["author", "title", "text"], ["author", "text"])
    assert [r.text for r in good.collect()] == ['ред "еден"\nред два']
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "missing_field"]


def test_nested_json(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"А": {"NOUN": {"река": 2}, "VERB": {"тече": 1}}}', encoding="utf-8")
    rows = files.read_nested_json(spark, str(tmp_path / "v.json"), "int", ["author", "pos", "lemma"]).collect()
    assert sorted(map(tuple, rows)) == [("А", "NOUN", "река", 2), ("А", "VERB", "тече", 1)]


def test_no_split_lands_where_it_must_not(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val")], "k int, split string")
    files.write_by_split(df, str(tmp_path / "ok"), ("train", "val"))
    with pytest.raises(Exception, match="split not allowed here: val"):
        files.write_by_split(df, str(tmp_path / "no"), ("train",))


def test_versions_are_never_overwritten(spark, tmp_path):
    df = spark.range(3)
    path = files.write_versioned(df, str(tmp_path), "1")
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_versioned(df, str(tmp_path), "1")
    assert spark.read.parquet(path).count() == 3


def test_run_names_come_from_the_files(spark, tmp_path):
    for n in ("base_a", "tuned_b"):
        (tmp_path / f"{n}.csv").write_text("k,v\n1,x\n", encoding="utf-8")
    rows = files.read_runs(spark, f"{tmp_path}/*.csv", "k int, v string").orderBy("place", "run").collect()
    assert [(r.run, r.place) for r in rows] == [("base_a", 0), ("tuned_b", 1)]


def test_a_resumed_stream_adds_nothing_twice_and_retries_errors(spark, tmp_path):
    source, done, errors = (str(tmp_path / x) for x in ("in", "done", "errors"))
    spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int").write.parquet(source)
    for turn, bad in enumerate((3, 0)):
        s = streams.file_stream(spark, source, "k int", files=10)
        work = lambda df, bad=bad: df.withColumn("error", F.when(F.col("k") == bad, "failed"))
        streams.resumable(s, ["k"], work, done, errors, str(tmp_path / f"c{turn}")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(done).collect()) == [1, 2, 3]
    assert [r.k for r in spark.read.parquet(errors).collect()] == [3]


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, value double"
    for i, (t, v) in enumerate([("2030-01-01 10:00:00", 1.0), ("2030-01-01 12:00:00", 2.0), ("2030-01-01 10:05:00", 4.0), ("2030-01-01 15:00:00", 8.0)]):
        spark.createDataFrame([(t, v)], "t string, value double").select(F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streams.file_stream(spark, str(tmp_path / "in"), schema, files=1)
    rows = streams.run_to_end(streams.windowed(s, "ts", "1 hour", late="30 minutes"), "late_rows").collect()
    assert sum(r.total for r in rows) <= 7.0 and all(r.n >= 1 for r in rows)


def test_a_stream_of_choices_goes_to_files(spark, tmp_path):
    schema = "poem_id bigint, place int, candidates array<string>"
    spark.createDataFrame([(p, i, ["а", "б"]) for p in (1, 2) for i in range(3)], schema).write.parquet(str(tmp_path / "in"))
    s = streams.least_used_stream(streams.file_stream(spark, str(tmp_path / "in"), schema, files=10), "poem_id")
    out = streams.run_to_files(s, f"file://{tmp_path}/out")
    assert sorted(map(tuple, out.collect())) == [(p, i, x) for p in (1, 2) for i, x in enumerate("аба")]
    assert out.inputFiles() and all("/out/rows/" in f for f in out.inputFiles())


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "u int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "u int, t int, v string")
    got = sorted((r.u, r.t, r.v) for r in streams.as_of(left, right, "u", "t", "v").collect())
    assert got == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


def test_the_classifier_learns_and_leaves_empty_texts(spark):
    rows = [(f"a{i}", "А", "река тече низ поле") for i in range(6)] + [(f"b{i}", "Б", "ветер дува над гора") for i in range(6)]
    df = spark.createDataFrame(rows, "k string, author string, text string")
    model = M.author_classifier(df, iterations=5)
    new = spark.createDataFrame([("Б", "силен ветер дува"), ("А", ""), ("В", "река")], "target string, text string")
    out = {r.target: r for r in M.predict(model, new, "target").collect()}
    assert out["Б"].predicted == "Б" and out["Б"].target_probability > 0.5
    assert out["А"].predicted is None and out["А"].top_probability == 0 and out["В"].target_probability == 0
    assert M.held_out_accuracy(model, df).head().accuracy == 1.0


def test_folds_are_stratified(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "k int, l string")
    n = {(r.l, r.fold): r["count"] for r in M.folds(df, "l", "k").groupBy("l", "fold").count().collect()}
    assert set(n.values()) == {2} and len(n) == 10


def test_folds_are_scored_like_spark_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    rows = [(i, "АБВ"[i % 3], f"{('река', 'ветер', 'гора')[(i // 5) % 3]} {('тече', 'дува', 'стои')[i % 3]}") for i in range(45)]
    df = spark.createDataFrame(rows, "k long, author string, text string")
    got = {r.fold: (r.accuracy, r.f1) for r in M.cross_validated(df, "author", "k", k=2, iterations=2).collect()}
    folded = M.folds(df, "author", "k", 2).cache()
    for i in range(2):
        model = M.author_classifier(folded.filter(F.col("fold") != i), iterations=2)
        told = M.predict(model, folded.filter(F.col("fold") == i)).select(F.ascii("author").cast("double").alias("label"), F.ascii("predicted").cast("double").alias("prediction"))
        want = [MulticlassClassificationEvaluator(metricName=m).evaluate(told) for m in ("accuracy", "f1")]
        assert max(abs(a - b) for a, b in zip(got[i], want)) < 1e-9
    assert model.path and not hasattr(model, "stages")


def test_embedding_once_for_each_text(spark):
    df = spark.createDataFrame([("а",), ("а",), (None,), ("б",)], "t string")
    rows = M.embed(df, "t", lambda xs: [[float(len(x))] for x in xs]).collect()
    assert sorted((r.t, r.vector[0]) for r in rows) == [("а", 1.0), ("б", 1.0)]


def test_a_plugged_in_tagger(spark):
    df = spark.createDataFrame([(1, "река тече")], "k int, line string")
    rows = M.tag(df, "k", "line", lambda ls: [[(w, w, "X") for w in x.split()] for x in ls]).collect()
    assert [(r.tok_no, r.word) for r in rows] == [(1, "река"), (2, "тече")]
