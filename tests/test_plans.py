import random

import pytest
from pyspark.sql import functions as F

from framewise.operators import scoring
from framewise.plans import experiments, features, models
from framewise.streaming import trailing


def learnable(spark, n=400):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        label = int(rng.random() < 0.4)
        rows.append((f"v{k % 2}", k // 2, label, label * 2 + rng.gauss(0, 1), rng.gauss(0, 1) if k % 5 else None, float("nan") if label and k % 3 == 0 else 1.0))
    return spark.createDataFrame(rows, "video_id string, frame long, label int, a double, b double, c double")


@pytest.mark.parametrize("kind", ["logistic", "balanced", "boosted"])
def test_models_learn(spark, kind):
    df = learnable(spark)
    fit = {"logistic": lambda d: models.logistic(d, ["a", "b", "c"]), "balanced": lambda d: models.logistic(d, ["a", "b", "c"], balanced=True, indicators=False), "boosted": lambda d: models.boosted(d, ["a", "b", "c"], trees=10)}[kind]
    model = fit(df)
    got = scoring.ranking_metrics(models.predict(model, df), []).first()
    assert got.roc_auc > 0.88
    assert model.inputs == (["a", "b", "c"] if kind == "balanced" else ["a", "b", "c", "missing_b", "missing_c"])
    assert {n for n, _ in models.coefficients(model)} == set(model.inputs)


def test_logistic_matches_its_optimum(spark):
    """The gradient of summed loss plus half the squared weights vanishes at the fit (C = 1)."""
    import numpy as np

    df = learnable(spark).select("label", "a")
    model = models.logistic(df, ["a"])
    x = np.array([r.a for r in df.collect()])
    y = np.array([r.label for r in df.collect()])
    x = (x - x.mean()) / x.std()
    w, b = model.fitted.coefficients[0], model.fitted.intercept
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs(((p - y) * x).sum() + w) < 0.05 and abs((p - y).sum()) < 0.05


def test_blocks_and_buffers(spark):
    df = spark.range(4000).select(F.lit("v").alias("video_id"), F.col("id").alias("frame"))
    got = {(r.fold, r.role): r["count"] for r in experiments.inner_folds(df).groupBy("fold", "role").count().collect()}
    assert [got[k, "test"] for k in range(4)] == [1000] * 4
    assert [got[k, "buffer"] for k in range(4)] == [300, 600, 600, 300]
    assert sum(got.values()) == 16000


def test_fit_rule_takes_the_first_best(spark):
    rows = [(v, f, 0.9 if 100 <= f < 220 else 0.2, -0.8 if 100 <= f < 220 else 2.0) for v in ("a", "b") for f in range(400) if f % 50 or f < 100]
    train = spark.createDataFrame(rows, "video_id string, frame long, close double, turns double")
    gt = spark.createDataFrame([(v, 100, 219) for v in ("a", "b")], "video_id string, start long, end long")
    dims = spark.createDataFrame([("a", 400), ("b", 400)], "video_id string, num_frames long")
    best = experiments.fit_rule(train, gt, dims).first()
    assert (best.close_min, best.turns_min, best.min_length, best.f1_50) == (0.5, 0.25, 0, 1.0)
    folds = experiments.rule_folds(train, gt, dims).collect()
    assert sorted((r.test_video, r.close_min, r.min_length, r.f1_50, r.train_f1_50) for r in folds) == [("a", 0.5, 0, 1.0, 1.0), ("b", 0.5, 0, 1.0, 1.0)]


def test_rule_folds_match_a_loop(spark):
    import random

    rng = random.Random(8)
    rows = [(v, f, rng.random() * 0.4 + 0.5, rng.random() * 1.6) for v in ("a", "b", "c") for f in range(0, 600) if (f // 60) % 3]
    df = spark.createDataFrame(rows, "video_id string, frame long, close double, turns double").cache()
    gt = spark.createDataFrame([(v, 70 + 200 * k, 130 + 200 * k) for v in ("a", "b", "c") for k in range(3)], "video_id string, start long, end long")
    dims = spark.createDataFrame([(v, 600) for v in ("a", "b", "c")], "video_id string, num_frames long")
    grid = {"closes": (0.5, 0.6), "turns": (0.25, 0.5), "lengths": (0, 40)}
    got = {r.test_video: r for r in experiments.rule_folds(df, gt, dims, **grid).collect()}
    for test in ("b",):
        keep = lambda d, t=test: d.where(F.col("video_id") != t)
        best = experiments.fit_rule(keep(df), keep(gt), keep(dims), **grid).first()
        assert (got[test].close_min, got[test].turns_min, got[test].min_length) == (best.close_min, best.turns_min, best.min_length)
        assert got[test].train_f1_50 == best.f1_50


def test_variants_run(spark, tmp_path):
    rows = []
    for v in ("v0", "v1"):
        for f in range(1500):
            hot = any(s <= f <= s + 120 for s in range(200, 1500, 500))
            rows.append((v, f, int(hot), float(hot) + (f * 37 % 101) / 400, 0.9 if hot else 0.1, 1.0))
    df = spark.createDataFrame(rows, "video_id string, frame long, label int, a double, close double, turns double").cache()
    gt = spark.createDataFrame([(v, s, s + 120) for v in ("v0", "v1") for s in range(200, 1500, 500)], "video_id string, start long, end long")
    dims = spark.createDataFrame([("v0", 1500), ("v1", 1500)], "video_id string, num_frames long")
    for variant in (experiments.Variant("rule_shared", "rule"),):
        got = {r.video_id: r for r in experiments.run_variant(variant, df, ["a"], gt, dims, quick=True, sink=str(tmp_path / variant.name)).collect()}
        assert set(got) == {"v0", "v1", "overall"} and got["overall"].f1_50 == 1.0
        assert spark.read.option("header", True).csv(str(tmp_path / variant.name)).count() == 6
    with pytest.raises(ValueError):
        models.learner("other")


def test_run_fold_finds_the_events(spark):
    rows = []
    for v in ("v0", "v1"):
        for f in range(2400):
            hot = any(s <= f <= s + 120 for s in range(200, 2400, 500))
            rows.append((v, f, int(hot), (1.0 if hot else 0.0) + (f * 37 % 101) / 400))
    df = spark.createDataFrame(rows, "video_id string, frame long, label int, a double")
    gt = spark.createDataFrame([(v, s, s + 120) for v in ("v0", "v1") for s in range(200, 2400, 500)], "video_id string, start long, end long")
    dims = spark.createDataFrame([("v0", 2400), ("v1", 2400)], "video_id string, num_frames long")
    found = experiments.run_fold(df, ["a"], models.logistic, models.predict, "v1", gt, dims).orderBy("start").collect()
    assert [r.video_id for r in found] == ["v1"] * 5
    assert all(abs(r.start - s) <= 15 and r.span_score > 0.5 for r, s in zip(found, range(200, 2400, 500), strict=True))


def test_importance_ranks_the_signal_first(spark):
    df = learnable(spark).withColumn("key", F.monotonically_increasing_id()).cache()
    model = models.logistic(df, ["a", "b"])
    ranked = experiments.permutation_importance(lambda d: models.predict(model, d), df, ["a", "b"], "key", 1)
    assert ranked[0][0] == "a" and ranked[0][1] > 0.1


def test_evaluation_plan(spark):
    schema = "video_id string, row_id long, start long, end long, direction string, cycles double, score double"
    gt = spark.createDataFrame([("a", 0, 0, 9, "CW", 1.0, 1.0), ("b", 1, 5, 9, "CCW", 2.0, 1.0)], schema)
    found = features.evaluation(gt, gt, oracle=gt)
    assert found.per_video.count() == 2 and found.table().count() == 3
    row = found.overall.first()
    assert (row.mof, row.frame_f1, row.f1_50, row.direction_accuracy, row.cycle_mae, row.map_avg, row.map_70) == (1, 1, 1, 1, 0, 1, 1)
    assert (row.strict_attribute_pairs, row.oracle_attribute_pairs, row.oracle_direction_accuracy) == (2, 2, 1)
    assert len(found.warnings) == 3 and "tied" in found.warnings[0]


def test_labels_are_decided_over_all_predictions(spark):
    schema = "video_id string, row_id long, start long, end long, direction string, cycles double"
    gt = spark.createDataFrame([("a", 0, 0, 9, "CW", 1.0), ("b", 1, 5, 9, "CCW", 2.0)], schema)
    pred = spark.createDataFrame([("a", 0, 0, 9, "CW", 1.0), ("only predicted", 1, 0, 99, "CW", 1.0)], schema)
    found = features.evaluation(gt, pred)
    row = found.overall.first()
    assert (row.cw_tp, row.ccw_fn, row.direction_f1, row.frame_fp) == (1, 1, 0.5, 0)
    rows = {r.video_id: r for r in found.per_video.collect()}
    assert set(rows) == {"a", "b"} and (rows["b"].ccw_tp, rows["b"].ccw_fn, rows["b"].cycle_pairs, rows["b"].pred_cycles) == (0, 1, 0, 0)
    assert "map_avg" not in found.per_video.columns and any("average precision" in w for w in found.warnings)


def test_scope_and_frame_counts(spark):
    schema = "video_id string, start long, end long"
    gt = spark.createDataFrame([("a", 0, 9), ("b", 5, 9)], schema)
    sizes = spark.createDataFrame([("a", 100)], "video_id string, num_frames long")
    found = features.evaluation(gt, gt, sizes, scope=["a", "c"])
    assert [(r.video_id, r.num_frames) for r in found.per_video.collect()] == [("a", 100)]
    assert sum("c" in w.split(": ")[-1] or "b" in w.split(": ")[-1] for w in found.warnings) >= 2
    assert features.evaluation(gt, gt, known={"b": 50}).per_video.where("video_id = 'b'").first().num_frames == 50
    with pytest.raises(ValueError, match="reach"):
        features.evaluation(gt, gt, known={"a": 5})
    with pytest.raises(ValueError, match="scope"):
        features.evaluation(gt, gt, scope=["c"])
    with pytest.raises(ValueError, match="labelled"):
        features.evaluation(gt, gt, oracle=gt)


def test_streaming_sessions(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 2, 20, 21)] + [("k", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "key string, at string").select("key", F.to_timestamp("at").alias("at"), F.lit(2.0).alias("x")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key string, at timestamp, x double").parquet(str(tmp_path / "in"))
    for name, df in (("sessions", trailing.sessions(stream(), ["key"], "at", "5 seconds", "10 seconds")), ("means", trailing.trailing_means(stream(), ["key"], "at", ["x"], "4 seconds", "1 second", "10 seconds"))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(r.n_rows for r in spark.table("sessions").collect()) == [2, 3]
    assert {r.x_trailing for r in spark.table("means").collect()} == {2.0}
