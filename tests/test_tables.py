"""Composite tables, event summaries, frame masks, exporter intervals and invariants."""

import math
import random

import pytest

from framewise.functions import exprs
from framewise.operators import framefeat, pairfeat, qc, spans
from framewise.plans import models, reports, tables
from framewise.sources import intervals

SPAN = "video_id string, start long, end long"
DIMS = "video_id string, num_frames long"


def frames_in(rows, video):
    return {f for v, a, b in rows if v == video for f in range(a, b + 1)}


def test_event_summary_against_loops(spark):
    labels = [("a", 100, 199), ("a", 400, 429), ("b", 10, 19)]
    found = [("a", 150, 180), ("a", 190, 220), ("a", 700, 760)]
    reviewed = [("a", 180, 720)]
    shifts = [("a", 1000, s) for s in (0, 0, 350, 900)] + [("b", 500, 7)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = {r.video_id: r for r in spans.event_summary(make(labels, SPAN), make(found, SPAN), make(reviewed, SPAN), make(shifts, "video_id string, num_frames long, shift long"), "video_id").collect()}
    hit = lambda a, b, s, e: e >= a - 30 and s <= b + 30
    told = [[(s, e) for v, s, e in found if v == "a" and hit(a, b, s, e)] for v, a, b in labels if v == "a"]
    a, det, lab, rev = out["a"], *(frames_in(x, "a") for x in (found, labels, reviewed))
    assert (a.caught, a.events, a.episodes) == (sum(map(bool, told)), 2, 3)
    assert a.pieces == 2 and a.coverage == pytest.approx(len(det & lab) / len(lab))
    assert a.start_err == pytest.approx(50 / 30) and a.end_err == pytest.approx(21 / 30)
    assert a.false_alarm_s == pytest.approx(len(det & (rev - lab)) / 30) and a.reviewed_neg_s == pytest.approx(len(rev - lab) / 30)
    null = [sum(any(hit(x, y, (s + o) % 1000, (e + o) % 1000) for v, s, e in found if v == "a") for v, x, y in labels if v == "a") for _, _, o in shifts[:4]]
    assert a.null_hits == pytest.approx(sum(null) / 4)
    b = out["b"]
    assert (b.caught, b.events, b.episodes, b.null_hits, b.pieces, b.start_err, b.false_alarm_s) == (0, 1, 0, 0, None, None, 0)
    assert spans.hash_shifts(make([("a", 50)], DIMS), "video_id", times=40).where("shift between 0 and 49").count() == 40


def test_event_recall(spark):
    labels = spark.createDataFrame([("a", 0, 9), ("a", 20, 29), ("b", 0, 5)], SPAN)
    events = spark.createDataFrame([("a", 9, 11), ("a", 5, 6), ("b", 6, 8)], SPAN)
    counted = spans.event_recall(labels, events, "video_id")
    assert sorted((r.video_id, r.start, r.n_events) for r in counted.collect()) == [("a", 0, 2), ("a", 20, 0), ("b", 0, 0)]
    assert [(r.video_id, r.found, r.labels, r.recall) for r in spans.recall_of(counted, ["video_id"]).orderBy("video_id").collect()] == [("a", 1, 2, 0.5), ("b", 0, 1, 0.0)]


def test_masks_and_reference_status(spark):
    masks = spans.frame_masks({"x": spark.createDataFrame([("a", 0, 2), ("a", 2, 3)], SPAN), "y": spark.createDataFrame([("a", 3, 4)], SPAN)}, ["video_id"])
    assert sorted((r.frame, r.x, r.y) for r in masks.collect()) == [(0, True, False), (1, True, False), (2, True, False), (3, True, True), (4, False, True)]
    at = spark.createDataFrame([("v", f) for f in range(4)], "video_id string, frame long")
    held = spark.createDataFrame([("v", 0, 1, "circling"), ("v", 0, 3, "unknown"), ("v", 1, 2, "non-circling")], f"{SPAN}, status string")
    assert [r.status for r in spans.reference_status(at, held, ["video_id"]).orderBy("frame").collect()] == ["circling", "CONFLICT", "non-circling", "UNKNOWN"]


def test_stamps_and_bounds(spark):
    rows = spark.createDataFrame([(0,), (1,), (107_999,), (108_000,)], "f long").select(exprs.stamp(exprs.F.col("f")).alias("t")).collect()
    assert [r.t for r in rows] == ["00:00:00.000", "00:00:00.033", "00:59:59.967", "01:00:00.000"]
    one = lambda a, b, n, size: spark.createDataFrame([(a, b, n, size)], "a long, b long, n long, size long").select(exprs.buffered(*map(exprs.F.col, ("a", "b", "n", "size"))).alias("x")).first().x
    assert tuple(one(5, 8, 10, 12)) == (0, 11) and tuple(one(5, 8, 2, 12)) == (3, 10)
    for bad in ((5, 4, 1, 12), (-1, 4, 1, 12), (5, 12, 1, 12), (5, 8, -1, 12)):
        with pytest.raises(Exception, match="invalid span"):
            one(*bad)


def test_exporter_intervals(spark):
    df = spark.createDataFrame([("v", "1", "5", "yes", "1", "good", "CW"), (None, "6", "6", "no", "1", None, None), ("v", "7", "9", "1.0", "no", "x", "CCW"), ("w", "7", "9", "1", "1", "x", "CCW"), ("v", "3", None, "1", "1", "", "")], "VideoID string, `Start Frame` string, `End Frame` string, ShouldUse string, Circling string, Notes string, Direction string")
    got = intervals.exporter_intervals(df, "v", end_exclusive=False).orderBy("start").collect()
    assert [(r.start, r.end, r.status, r.direction, r.notes) for r in got] == [(1, 5, "circling", "CW", "good"), (6, 6, "unknown", "", ""), (7, 9, "non-circling", "CCW", "x")]
    assert intervals.skipped(df, "v") == 1 and {r.status for r in intervals.exporter_intervals(df, "v", prediction=True).collect()} == {"prediction"}
    plain = spark.createDataFrame([("1", "5", "true", "Circling "), ("2", "5", "", "circling"), ("3", "5", "y", "no-circling"), ("4", "5", "y", "other")], "start_frame string, end_frame string, Verified string, behavior string")
    assert [r.status for r in intervals.exporter_intervals(plain, "v").orderBy("start").collect()] == ["circling", "unknown", "non-circling", "unknown"]
    told = plain.drop("Verified")
    assert [r.status for r in intervals.exporter_intervals(told, "v", verified=True, end_exclusive=True).orderBy("start").collect()] == ["circling", "circling", "non-circling", "unknown"]
    assert {r.status for r in intervals.exporter_intervals(told, "v").collect()} == {"unknown"}
    with pytest.raises(Exception, match="precedes"):
        intervals.exporter_intervals(spark.createDataFrame([("5", "5")], "StartFrame string, EndFrame string"), "v", end_exclusive=True).collect()
    with pytest.raises(ValueError, match="end"):
        intervals.exporter_intervals(spark.createDataFrame([("5",)], "StartFrame string"), "v")


def test_clip_table(spark):
    labels = spark.createDataFrame([("a", 3, 9), ("b", 0, 29), ("c", 1, 2)], SPAN)
    videos, poses = spark.createDataFrame([("a", 99), ("b", 99)], DIMS), spark.createDataFrame([("b", 1), ("b", 2)], "video_id string, frame long")
    got = [tuple(r) for r in spans.clip_table(labels, videos, poses).orderBy("clip").collect()]
    assert got == [("a__f3-9.mp4", "a", None, None, None, None, "skipped (no parquet)"), ("b__f0-29.mp4", "b", 0, 29, 1.0, 30, "ok")]


def moving(spark, frames=240):
    """Two animals on a circle; their poses and pairs."""
    rng = random.Random(3)
    poses, pairs = [], []
    for f in range(frames):
        for t in (1, 2):
            angle = f / 15 + math.pi * t
            at = [(100 * math.cos(angle) + k * 4 + rng.random(), 100 * math.sin(angle) + k * 3 + rng.random()) for k in range(len(framefeat.KEYPOINTS))]
            if f != 50 or t == 1:
                poses.append(("a", f, t, *[x for p in at for x in p]))
        if f not in (70, 71):
            pairs.append(("a", f, 1, 2, *[float(f % 7 + k) for k in range(len(tables.PAIR_VALUES))], *[f / 9 + k for k in range(len(tables.PAIR_ANGLES))]))
    points = ", ".join(f"{k}_{x} double" for k in framefeat.KEYPOINTS for x in "xy")
    values = ", ".join(f"{c} double" for c in (*tables.PAIR_VALUES, *tables.PAIR_ANGLES))
    return spark.createDataFrame(poses, f"video_id string, frame long, track int, {points}"), spark.createDataFrame(pairs, f"video_id string, frame long, t1 int, t2 int, {values}")


def test_linear_features_and_baselines(spark):
    poses, pairs = moving(spark)
    videos = spark.createDataFrame([("a", 240)], DIMS)
    lr = tables.lr_features(poses, pairs, videos).cache()
    names = [c for c in lr.columns if c.startswith("lr_")]
    assert len(names) == 102 and names[0] == "lr_track_count" and names[50] == "lr_pair_count" and lr.count() == 240
    rows = {r.frame: r for r in lr.collect()}
    assert (rows[70].lr_pair_count, rows[70].lr_centroid_distance_px_mean, rows[50].lr_track_count) == (0, None, 1)
    assert rows[60].lr_orbital_rad_sin_mean == pytest.approx(math.sin(60 / 9)) and rows[60].lr_track_count_trailing30 == pytest.approx(59 / 30)
    series = lr.selectExpr("video_id", "frame", *[f"double(frame * {k + 1}) AS {s}" for k, s in enumerate(tables.SIGNALS)])
    windows = tables.flat_windows(series)
    assert len(windows.columns) - 2 == 155 and windows.columns[2] == "win_dist_offset_-60"
    edge = windows.where("frame = 3").first()
    assert (edge["win_dist_offset_-4"], edge["win_rate_offset_+0"], edge["win_rate_offset_+60"]) == (None, 6, 126)
    model = spark.createDataFrame([("a", 3, 1), ("a", 200, 0)], "video_id string, frame long, label int")
    base = tables.baseline_frames(model, lr, windows)
    both = tables.with_baselines(model, base)
    assert len(base.columns) == 2 + 102 + 155 and sorted((r.frame, r.label, r["win_dist_offset_+0"]) for r in both.collect()) == [(3, 1, 3), (200, 0, 200)]
    for short in (lr.where("frame <> 200"), lr.union(lr.where("frame = 3"))):
        with pytest.raises(Exception, match="not one row"):
            tables.baseline_frames(model, short, windows).collect()


def test_model_table(spark):
    pairs = spark.createDataFrame([("a", 0, 1, 2, 5.0, 1.0), ("a", 0, 1, 3, 4.0, 3.0), ("a", 0, 2, 3, 1.0, 9.0), ("b", 7, 1, 2, 2.0, 2.0)], "video_id string, frame long, t1 int, t2 int, dist double, x double")
    valid = pairs.where("x < 9").select("video_id", "frame", "t1", "t2")
    labels = spark.createDataFrame([("b", 5, 8)], SPAN)
    got = tables.model_table(pairs, valid, labels, "dist", ["x"], {"x": ["mean"]}).orderBy("video_id").collect()
    assert [(r.video_id, r.frame, r.t2, r.dist, r.n_pairs, r.all_x_mean, r.label) for r in got] == [("a", 0, 3, 4.0, 2, 2.0, 0), ("b", 7, 2, 2.0, 1, 2.0, 1)]


def test_sampled_windows_train_a_model(spark):
    positives = spark.createDataFrame([("a", s, s + 29) for s in (60, 160, 260)], SPAN)
    videos = spark.createDataFrame([("a", 360)], DIMS)
    hot = " OR ".join(f"frame BETWEEN {s} AND {s + 29}" for s in (60, 160, 260))
    series = spark.range(360).selectExpr("'a' AS video_id", "id AS frame", f"CASE WHEN {hot} THEN 1.0D ELSE 0.0D END + (id * 37 % 11) / 100.0D AS dist")
    data = tables.prepare_dataset(series, positives, videos, ("dist",), half=2).cache()
    assert data.count() == 180 and data.where("label = 1").count() == 90
    model, held = tables.train(data, lambda df, names: models.logistic(df, names, indicators=False))
    assert held.count() == 36
    assert held.where("(score >= 0.5) <> (label = 1)").count() <= 2
    scores = tables.full_scores(model, series, videos, ("dist",), half=2)
    assert scores.count() == 360 and scores.where("frame = 75").first().score > 0.5 > scores.where("frame = 10").first().score
    with pytest.raises(ValueError, match="no positive spans for b"):
        tables.prepare_dataset(series, positives, spark.createDataFrame([("a", 360), ("b", 9)], DIMS), ("dist",))


def test_invariants_see_broken_rows(spark):
    rows = [("p", "d", f, 1, 2, 1, 0, 4.0 + f, (4.0 + f) / 10, 10.0, 10.0, 0.2, True) for f in range(30)]
    names = "project_id string, day_label string, FrameNum long, TrackUID_1 int, TrackUID_2 int, pair_episode_id int, smooth_segment int, centroid_distance_px double, centroid_distance_bl double, body_length_px_1 double, body_length_px_2 double, bearing_1_rad double, facing_1 boolean"
    good = pairfeat.add_smoothed(spark.createDataFrame(rows, names), ["centroid_distance_bl"])
    assert tuple(pairfeat.violations(good).first()) == (0, 0, 0)
    told = pairfeat.median_checks(good).first()
    assert told.residual_ok and not told.near_zero_ok and told.near_zero_bl == pytest.approx(0.45)
    assert [(r.n, r.changed) for r in pairfeat.isolated_smoothing(good).collect()] == [(30, 0)]
    bad = good.selectExpr("* EXCEPT (centroid_distance_bl, facing_1, centroid_distance_bl_smooth)", "centroid_distance_bl + IF(FrameNum = 3, 1, 0) AS centroid_distance_bl", "FrameNum <> 4 AS facing_1", "centroid_distance_bl_smooth + IF(FrameNum = 20, 1, 0) AS centroid_distance_bl_smooth")
    broken = pairfeat.violations(bad).first()
    assert (broken.body_lengths, broken.bearing) == (1, 1)
    assert pairfeat.isolated_smoothing(bad).first().changed >= 1


def test_reports(spark, tmp_path):
    stats = spark.createDataFrame([("a|b", 12345, 0.25, None), ("c", 1, 0.5, 2.0)], "day string, rows long, bad_frac double, x double")
    assert qc.grid(stats) == "| day | rows | bad_frac | x |\n| --- | --- | --- | --- |\n| a\\|b | 12,345 | 25.0% |  |\n| c | 1 | 50.0% | 2 |"
    join = lambda *v: spark.createDataFrame([v], "n long, unmatched_1 long, unmatched_2 long")
    assert "All 9 pair rows" in reports.quality_report(stats, join(9, 0, 0)) and "2 the second" in reports.quality_report(stats, join(9, 0, 2), stats)
    summary = spark.createDataFrame([(f"f{k:02d}", k / 100, k % 10 != 0) for k in range(40)], "feature string, weakest_auc_gap double, same_direction boolean")
    pairs = spark.createDataFrame([("f01", "f02", 0.99), ("f03", "f04", 0.96)], "feature_a string, feature_b string, abs_corr double")
    told = reports.feature_document(spark.createDataFrame([("a", 10, 3)], "video string, rows long, positives long"), summary, pairs)
    assert "videos: 4\n\n- `f30`\n- `f20`" in told and "2 pairs" in told and sum(x[:3] == "| f" and x[3].isdigit() for x in told.splitlines()) == 25 + 2 and told.index("f39") < told.index("f38")
    rows = [(v, x, f / 10 + (x == "b") / 100, 3) for f, v in enumerate(("one", "two", "three")) for x in ("a", "b", "overall")]
    results = spark.createDataFrame(rows, "variant string, video_id string, f1_50 double, pred_segments long")
    whole = reports.experiment_document(results)
    assert "Each of a, b" in whole and whole.index("| three") < whole.index("| two") < whole.index("| one")
    text = reports.comparison_document({"rule": results.where("variant = 'one'").drop("variant")}, results)
    assert text.index("rule (a)") < text.index("rule (b)") < text.index("rule (overall)") < text.index("| three |") < text.index("three (test a)") < text.index("one (test b)")
    reports.write_text(stats, text, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report"), wholetext=True).first().value.rstrip("\n") == text.rstrip("\n")
    with pytest.raises(ValueError, match="no shipped"):
        reports.comparison_document({}, results)
