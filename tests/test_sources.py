import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewise.functions import exprs as X
from framewise.operators import scoring
from framewise.sources import contracts, intervals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_interval_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('VideoID,Start Frame,End Frame,Primary label/behavior,Rotation direction,No. of turns/circles,Notes,Score\nv1,0,9, Circling ,Clockwise,2.5,"two\nlines",0.5\nv1,20,29,feeding,CW,1,,0.4\n,,,,,,,\nv1,30,30,circling,,,x,0.3\n')
    rows = intervals.read_intervals(spark, str(path), labels=True, scores=True, behavior="circling").orderBy("start").collect()
    assert [(r.video_id, r.start, r.end, r.direction, r.cycles, r.score) for r in rows] == [("v1", 0, 9, "CW", 2.5, 0.5), ("v1", 30, 30, None, None, 0.3)]


@pytest.mark.parametrize("line", ["v,5,4,CW,1,1", "v,0.5,4,CW,1,1", "v,-1,4,CW,1,1", "v,0,4,sideways,1,1", "v,0,4,CW,-1,1", "v,0,4,CW,1,nan"])
def test_broken_interval_files(spark, tmp_path, line):
    path = tmp_path / "a.csv"
    path.write_text(f"VideoID,StartFrame,EndFrame,Direction,Cycles,Score\n{line}\n")
    with pytest.raises(Exception):  # noqa: B017, PT011
        intervals.read_intervals(spark, str(path), labels=True, scores=True).collect()


def test_round_trip_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "VideoID string, StartFrame long, EndFrame long")
    intervals.write_csv(empty, str(tmp_path / "out"))
    assert intervals.read_intervals(spark, str(tmp_path / "out")).collect() == []


def test_viewer_intervals(spark):
    df = spark.createDataFrame([("v", "0:00:01", "0:00:02.5", "good", "x"), ("w", "0:00:01", "0:00:02", "", "")], "VideoID string, StartTime string, EndTime string, Notes string, Other string")
    row = intervals.viewer_intervals(df, "v", verified=True).collect()
    assert [(r.start, r.end, r.status, r.notes) for r in row] == [(30, 74, "circling", "Notes: good")]
    used = spark.createDataFrame([("v", "1", "5", "true", "1"), ("v", "6", "6", "true", "1.0"), ("v", "7", "9", "yes", "no"), ("v", "9", "9", "no", "yes")], "VideoID string, StartFrame string, EndFrame string, ShouldUse string, Circling string")
    assert [r.status for r in intervals.viewer_intervals(used, "v").orderBy("start").collect()] == ["circling", "circling", "non-circling", "unknown"]
    assert [(r.start, r.end) for r in intervals.usable_spans(used).collect()] == [(1, 5)]


def test_contract(spark, tmp_path):
    table = pa.table({"project_id": ["p"], "day_label": ["d"], "FrameNum": [1], "TrackUID": [1], "speed": [math.nan]})
    good = table.replace_schema_metadata(contracts.TRACK_METADATA)
    pq.write_table(good, tmp_path / "good.parquet")
    pq.write_table(table.replace_schema_metadata({"fps": "25"}), tmp_path / "bad.parquet")
    assert contracts.load(spark, [str(tmp_path / "good.parquet")], "tracks", ["speed"]).first().speed is None
    with pytest.raises(ValueError, match="fps.*y_axis"):
        contracts.assert_contract(spark, str(tmp_path / "bad.parquet"), "tracks")
    with pytest.raises(ValueError, match="repeated key"):
        contracts.load(spark, [str(tmp_path / "good.parquet")] * 2, "tracks", ["speed"])
    with pytest.raises(ValueError, match="lacks"):
        contracts.load(spark, [str(tmp_path / "good.parquet")], "tracks", ["nothing"])


def test_scoped_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("FrameNum"), F.lit("v").alias("day_label"), F.lit(1).alias("other")).write.parquet(str(tmp_path / "t"))
    held = contracts.scoped(spark.read.parquet(str(tmp_path / "t")), 5, 9, "v", columns=["FrameNum"])
    assert held.count() == 5
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(FrameNum,5)" in plan and "other" not in plan


def test_expressions(spark):
    pi = math.pi
    for x, want in ((pi, -pi), (-pi, -pi), (3 * pi, -pi), (0.5, 0.5), (-7.0, -7 + 2 * pi)):
        assert one(spark, X.wrap_rad(F.lit(x))) == pytest.approx(want)
    assert one(spark, X.turn(F.lit(3 * pi / 2))) == pytest.approx(-pi / 2)
    assert one(spark, X.mean_known(F.lit(None).cast("double"), F.lit(4.0))) == 4.0
    assert one(spark, X.span_iou(F.lit(0), F.lit(9), F.lit(5), F.lit(14))) == pytest.approx(5 / 15)
    assert one(spark, X.temporal_iou(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == 0
    assert one(spark, X.seconds_of(F.lit("1:02:03.5"))) == 3723.5
    assert one(spark, X.hms(F.lit(3723.9))) == "01:02:03"
    assert one(spark, X.direction(F.lit(" Counter-Clockwise"))) == "CCW"
    assert one(spark, X.leading_digits(F.lit("0028_vid"))) == "0028"
    assert one(spark, X.inside_polygon(F.lit(1.0), F.lit(1.0), [(0, 0), (2, 0), (2, 2), (0, 2)])) is True
    assert one(spark, X.inside_polygon(F.lit(3.0), F.lit(1.0), [(0, 0), (2, 0), (2, 2), (0, 2)])) is False


@pytest.mark.parametrize(
    ("points", "want"),
    [(((0, 0), (2, 2), (0, 2), (2, 0)), (1, 1)), (((0, 0), (1, 0), (0, 1), (1, 1)), None), (((0, 0), (2, 0), (1, 0), (3, 0)), None), (((0, 0), (0, 0), (1, 1), (2, 2)), None), (((0, 0), (1, 1), (1, 1), (2, 0)), (1, 1)), (((0, 0), (1, 0), (5, -1), (5, 1)), None)],
)
def test_segment_crossing(spark, points, want):
    sides = [(F.lit(float(x)), F.lit(float(y))) for x, y in points]
    for a, b, c, d in ((0, 1, 2, 3), (1, 0, 3, 2), (2, 3, 0, 1)):
        x, y = X.segment_crossing(sides[a], sides[b], sides[c], sides[d])
        row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        assert (row.x, row.y) == (want or (None, None))


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (None, 1)], "score double, label int")
    row = scoring.ranking_metrics(df, []).first()
    assert row.roc_auc == pytest.approx((2 + 1.5) / 4) and row.average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_split_shares(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    got = {(r.label, r.test): r["count"] for r in scoring.stratified_split(df, "id", "label").groupBy("label", "test").count().collect()}
    assert got == {(1, True): 50, (1, False): 200, (0, True): 150, (0, False): 600}


def test_cache_follows_its_inputs(spark, tmp_path):
    from framewise.sources import cache

    spark.range(3).write.parquet(str(tmp_path / "in"))
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(str(tmp_path / "in"))

    key = cache.signature(spark, [str(tmp_path / "in")], window=4)
    assert cache.cached(spark, str(tmp_path), key, build).count() == cache.cached(spark, str(tmp_path), key, build).count() == 3
    assert len(calls) == 1 and key != cache.signature(spark, [str(tmp_path / "in")], window=5)
    spark.range(4).write.mode("append").parquet(str(tmp_path / "in"))
    assert cache.signature(spark, [str(tmp_path / "in")], window=4) != key


def test_labelled_copy(spark, tmp_path):
    from framewise.plans import features

    (tmp_path / "a.csv").write_text("VideoID,StartFrame,EndFrame,Direction\nv,0,89,CCW\n")
    series = spark.range(200).select(F.lit("v").alias("video_id"), F.col("id").alias("frame"), F.lit(2 * math.pi).alias("rate"), F.lit(100.0).alias("dist"))
    out = features.label_file(spark, str(tmp_path / "a.csv"), str(tmp_path / "b"), series).collect()
    assert [(r.Direction, r.Cycles) for r in out] == [("CW", 3.0)]
    assert intervals.read_intervals(spark, str(tmp_path / "b"), labels=True).first().direction == "CW"
    with pytest.raises(ValueError, match="place of its own"):
        features.label_file(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.csv"), series)


def test_variants():
    from framewise.operators import pairfeat
    from framewise.plans import experiments

    found = experiments.variants(pairfeat.FEATURE_GROUPS)
    assert len(found) == len({v.name for v in found}) == 42
    every = next(v for v in found if v.name == "logreg_mine_plus_their")
    assert experiments.columns_of(every, pairfeat.FEATURE_GROUPS, ["agg_n", "lr_a", "win_b", "x"]) == [*pairfeat.MODEL_FEATURES, "agg_n", "lr_a", "win_b"]
