import math
import random

import pytest
from pyspark.sql import functions as F

from framewise.operators import evaluate, spans

IV = "video_id string, start long, end long"
LV = IV + ", direction string, cycles double"


def iv(spark, rows, video="a"):
    return spark.createDataFrame([(video, *r) for r in rows], IV)


def lv(spark, rows, video="a"):
    return spark.createDataFrame([(video, *r) for r in rows], LV)


def videos(spark, n, video="a"):
    return spark.createDataFrame([(video, n)], "video_id string, num_frames long")


def test_partial_prediction(spark):
    row = evaluate.video_metrics(iv(spark, [(0, 9), (20, 29)]), iv(spark, [(5, 14)]), videos(spark, 40)).first()
    assert (row.frame_tp, row.frame_fp, row.frame_fn) == (5, 5, 15)
    assert (row.mof, row.frame_precision, row.frame_recall) == (0.5, 0.5, 0.25)
    assert row.frame_f1 == pytest.approx(1 / 3) and row.frame_iou == pytest.approx(5 / 25)
    assert (row.tp_10, row.tp_25, row.tp_50) == (1, 1, 0)
    assert row.f1_25 == pytest.approx(2 / 3)


def test_no_spans_at_all(spark):
    row = evaluate.video_metrics(iv(spark, []), iv(spark, []), videos(spark, 10)).first()
    assert (row.mof, row.frame_f1, row.edit_score, row.f1_10) == (1.0, 0.0, 100.0, 0.0)
    assert row.frame_precision is None and row.frame_iou is None


def test_edit_score(spark):
    texts = evaluate.segment_text(iv(spark, [(0, 4), (6, 8), (9, 9)]), videos(spark, 12), "s").first().s
    assert texts == "10110"
    got = evaluate.edit_scores(iv(spark, [(2, 4), (8, 9)]), iv(spark, [(2, 4)]), videos(spark, 12)).first().edit_score
    assert got == pytest.approx(60)


def reference_matches(gt, pred, tau):
    claimed, out = set(), set()
    for p in pred:
        share = lambda g: max(0, min(g[1], p[1]) - max(g[0], p[0]) + 1)  # noqa: B023, E731
        ious = [share(g) / (g[1] - g[0] + p[1] - p[0] + 2 - share(g)) for g in gt]
        best = ious.index(max(ious)) if ious else None
        if best is not None and 100 * ious[best] >= tau and best not in claimed:
            claimed.add(best)
            out.add((p, gt[best]))
    return out


def spans_of(rng, n):
    out, at = [], 0
    for _ in range(n):
        at += rng.randint(1, 6)
        end = at + rng.randint(0, 8)
        out.append((at, end))
        at = end + 1
    return out


def test_matching_and_ap_against_loops(spark):
    rng = random.Random(4)
    cases = {f"v{k}": (spans_of(rng, rng.randint(0, 6)), spans_of(rng, rng.randint(0, 7))) for k in range(60)}
    scores = {v: [(a, b, rng.choice([0.1, 0.5, 0.5, 0.9])) for a, b in p] for v, (_, p) in cases.items()}
    gt = spark.createDataFrame([(v, *s) for v, (g, _) in cases.items() for s in g], IV)
    pred = spark.createDataFrame([(v, k, *s) for v, p in scores.items() for k, s in enumerate(p)], "video_id string, row_id long, start long, end long, score double")
    for tau in (10, 25, 50):
        got = {(r.video_id, (r.start, r.end), (r.b_start, r.b_end)) for r in evaluate.segment_matches(gt, pred, tau).collect()}
        assert got == {(v, p, g) for v, (gs, ps) in cases.items() for p, g in reference_matches(gs, ps, tau)}
    dims = spark.createDataFrame([(v, 200) for v in cases], "video_id string, num_frames long")
    aps = {(r.video_id, r.tau): r.ap for r in evaluate.average_precision(gt, pred, dims, (10, 50)).collect()}
    for v, (g, _) in cases.items():
        for tau in (10, 50):
            assert (aps[v, tau] is None) == (not g)
            if g:
                assert aps[v, tau] == pytest.approx(loop_ap(g, scores[v], tau))


def loop_ap(gt, pred, tau):
    free, hits = list(gt), []
    for a, b, _ in sorted(pred, key=lambda x: -x[2]):
        tiou = lambda g: max(0, min(g[1], b) - max(g[0], a) + 1) / (max(g[1], b) - min(g[0], a) + 1)  # noqa: B023, E731
        best = max(free, key=tiou, default=None)
        hit = best is not None and 100 * tiou(best) >= tau
        if hit:
            free.remove(best)
        hits.append(hit)
    precision = [sum(hits[: k + 1]) / (k + 1) for k in range(len(hits))]
    return sum(max(precision[k:]) / len(gt) for k, h in enumerate(hits) if h)


def test_average_precision_toy(spark):
    gt = iv(spark, [(0, 9), (20, 29)])
    pred = spark.createDataFrame([("a", 0, 0, 9, 0.9), ("a", 1, 40, 49, 0.8), ("a", 2, 20, 29, 0.7)], "video_id string, row_id long, start long, end long, score double")
    assert evaluate.average_precision(gt, pred, videos(spark, 60), (50,)).first().ap == pytest.approx(5 / 6)


def test_labels_by_overlap(spark):
    events = lv(spark, [(0, 9, "CW", 2.0), (5, 24, "CCW", 4.0), (30, 39, None, None)]).withColumn("row_id", F.col("start"))
    got = {(r.start, r.end): (r.direction, r.cycles) for r in spans.prorated_labels(iv(spark, [(0, 9), (0, 14), (30, 35), (50, 60)]), events, "video_id").collect()}
    assert got[0, 9] == ("CW", pytest.approx(2 + 4 * 5 / 20))
    assert got[0, 14] == ("CW", pytest.approx(2 + 4 * 10 / 20))
    assert got[30, 35] == (None, None) and got[50, 60] == (None, None)


def test_direction_counts(spark):
    gt = lv(spark, [(0, 9, "CW", 1.0), (20, 29, "CCW", 2.0), (40, 49, None, None), (60, 69, "CW", 3.0)])
    pred = lv(spark, [(0, 9, "CW", 1.5), (20, 29, "CW", 2.0), (40, 49, "CCW", 1.0), (80, 89, "CCW", None)])
    row = evaluate.label_metrics(evaluate.label_counts(gt, pred, videos(spark, 100))).first()
    assert (row.cw_tp, row.cw_fp, row.cw_fn) == (1, 1, 1)
    assert (row.ccw_tp, row.ccw_fp, row.ccw_fn) == (0, 1, 1)
    assert (row.direction_correct, row.direction_matched, row.direction_accuracy) == (1, 2, 0.5)
    assert (row.cycle_pairs, row.cycle_mae) == (2, 0.25)
    none = evaluate.label_counts(gt, lv(spark, [(0, 9, None, None)]), videos(spark, 100)).first()
    assert none.cw_tp is None and none.cycle_pairs is None


def test_strict_attributes_and_oracle(spark):
    gt = lv(spark, [(0, 9, "CW", 2.0), (20, 29, "CCW", 4.0)])
    pred = lv(spark, [(0, 9, "CW", 2.5), (21, 29, "CW", 2.0), (50, 59, "CW", 9.0)])
    row = evaluate.attribute_metrics(evaluate.attribute_counts(gt, pred, videos(spark, 100))).first()
    assert (row.attribute_pairs, row.direction_correct, row.direction_matched) == (2, 1, 2)
    assert row.cycle_mae == pytest.approx(1.25) and row.cycle_rmse == pytest.approx(math.sqrt((0.25 + 4) / 2))
    assert row.cycle_wape == pytest.approx(2.5 / 6) and row.within_0p5 == 0.5
    assert evaluate.oracle_attributes(gt, gt, videos(spark, 100)).first().attribute_pairs == 2
    with pytest.raises(ValueError):
        evaluate.oracle_attributes(gt, pred, videos(spark, 100))


def test_pooled_cycle_errors(spark):
    schema = "video_id string, start long, end long, direction string, cycles double"
    gt = spark.createDataFrame([("a", 0, 9, "CW", 1.0), ("b", 0, 9, "CW", 1.0), ("b", 20, 29, "CW", 2.0)], schema)
    pred = spark.createDataFrame([("a", 0, 9, "CW", 2.0), ("b", 0, 9, "CW", 1.0), ("b", 20, 29, "CW", 6.0)], schema)
    dims = spark.createDataFrame([("a", 30), ("b", 30)], "video_id string, num_frames long")
    row = evaluate.pooled_labels(evaluate.label_counts(gt, pred, dims)).first()
    assert row.cycle_pairs == 3 and row.cycle_rmse == pytest.approx(math.sqrt(17 / 3))


def test_scope_and_missed(spark):
    gt, pred = iv(spark, [(0, 4), (10, 12)]), iv(spark, [(3, 5)])
    assert [(r.start, r.end) for r in evaluate.missed_events(gt, pred).collect()] == [(10, 12)]
    assert evaluate.scope(gt, iv(spark, [(1, 2)], "b")).count() == 2
