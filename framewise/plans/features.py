"""Whole plans: pair-motion feature table, span prediction and evaluation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions import exprs
from framewise.operators import detect, evaluate, framefeat, pairfeat, spans
from framewise.sources import contracts, intervals

POINTS = ["Nose_x", "Nose_y", "TailTip_x", "TailTip_y"]


def motion_features(pairs: DataFrame, tracks: DataFrame, seconds=pairfeat.WINDOW_SECONDS, trailing: bool = False) -> DataFrame:
    """Pairs with both tracks to the full feature table: normalised distances, orientation, approach, smoothing,
    angular features, windowed statistics and flags. The windows share the exchange by the pair keys."""
    columns = ["body_length_px", "speed_bl_s", "bend_angle_rad", *[c for c in ("is_track_start", "is_track_end", *POINTS) if c in tracks.columns]]
    out = pairfeat.join_tracks(pairs, tracks, columns)
    out = pairfeat.add_distances(pairfeat.flag_lengths(out))
    out = pairfeat.add_segments(pairfeat.add_approach(pairfeat.add_orientation(out)))
    distances = [f"{d}_bl" for d in pairfeat.DISTANCES if f"{d}_bl" in out.columns]
    out = pairfeat.add_smoothed(out, [*distances, *pairfeat.SPEEDS], pairfeat.BEARINGS)
    out = pairfeat.add_windows(pairfeat.add_angular(pairfeat.add_orbital(pairfeat.add_clean_rates(out))), seconds=seconds, trailing=trailing)
    held = [f"{c}_{k}" for k in (1, 2) for c in POINTS if f"{c}_{k}" in out.columns]
    return pairfeat.add_qc(out, held) if held else out


def build_features(spark: SparkSession, track_paths: list[str], pair_paths: list[str], out: str) -> DataFrame:
    """Load checked files, build the feature table in its declared columns and write it by video with its
    parameters."""
    tracks = contracts.load(spark, track_paths, "tracks", ["body_length_px", "speed_bl_s", "bend_angle_rad", "is_track_start", "is_track_end", *POINTS])
    own = ["day_index", "Time_s", "TrackID_1", "TrackID_2", "sex_1", "sex_2", "pair_sex", "qc_n_missing_kp_1", "qc_n_missing_kp_2", "pair_episode_id", "dt_frames", "orbital_rad", "rel_heading_rad", *pairfeat.BEARINGS, *pairfeat.RATES]
    pairs = contracts.load(spark, pair_paths, "pairs", [*[f"{d}_px" for d in pairfeat.DISTANCES], *own])
    features = contracts.require_columns(motion_features(pairs, tracks), pairfeat.OUTPUT_COLUMNS, "feature table")
    intervals.write_features(features, out, {"window_seconds": list(pairfeat.WINDOW_SECONDS), "gap_seconds": pairfeat.GAP_SECONDS, "max_rate": pairfeat.MAX_RATE}, ("day_label",))
    return spark.read.parquet(out)


def detect_spans(pairs: DataFrame, videos: DataFrame, keep: str | None = None, **parameters) -> DataFrame:
    """Closest-pair series to labelled spans of the rule detector."""
    series = framefeat.closest_series(pairs, videos, keep=keep)
    found = spans.hysteresis(detect.rule_signals(series, ["video_id"]), ["video_id"], **parameters)
    found = found.withColumn("row_id", F.xxhash64("video_id", "start"))
    return spans.rotation_labels(found, spans.rotation_steps(series, ["video_id"]), "video_id")


#: Frames of the two known videos.
VIDEO_FRAMES = {"0028_vid": 1_080_175, "0031_vid": 1_080_398}


class Evaluation(NamedTuple):
    per_video: DataFrame
    overall: DataFrame
    warnings: list[str]

    def table(self) -> DataFrame:
        """The videos' rows and the overall row, named ``overall``."""
        return self.per_video.unionByName(self.overall.withColumn("video_id", F.lit("overall")), allowMissingColumns=True)


def _events(df: DataFrame) -> DataFrame:
    """Intervals with the label columns that they may lack."""
    for name, value in (("direction", F.lit(None).cast("string")), ("cycles", F.lit(None).cast("double")), ("row_id", F.xxhash64("video_id", "start", "end"))):
        df = df if name in df.columns else df.withColumn(name, value)
    return df


def _names(df: DataFrame) -> list[str]:
    return sorted(r[0] for r in df.collect())


def _dimensions(gt: DataFrame, pred: DataFrame, num_frames: DataFrame | None, known: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """video_id, num_frames of the ground truth's videos: as given, else as known, else up to the last interval."""
    spark = gt.sparkSession
    last = gt.select("video_id", "end").union(pred.select("video_id", "end")).groupBy("video_id").agg((F.max("end") + 1).alias("_last"))
    sizes = spark.createDataFrame(list(known.items()), "video_id string, _known long")
    rows = gt.select("video_id").distinct().join(last, "video_id").join(F.broadcast(sizes), "video_id", "left")
    given = F.lit(None).cast("long")
    if num_frames is not None:
        rows = rows.join(num_frames.select("video_id", F.col("num_frames").cast("long").alias("_given")), "video_id", "left")
        given = F.when(F.col("_given") > 0, F.col("_given"))
    rows = rows.withColumn("_told", F.coalesce(given, "_known"))
    odd = rows.where(F.col("_told").isNull() | (F.col("_told") < F.col("_last"))).select("video_id", "_told", "_last").orderBy("video_id").collect()
    short = [r for r in odd if r["_told"] is not None]
    if short:
        raise ValueError("; ".join(f"{r['video_id']}: {r['_told']} frames, but intervals reach frame {r['_last'] - 1}" for r in short))
    told = [f"{r['video_id']}: frame count unknown, taken as {r['_last']} from the last interval" for r in odd]
    return rows.select("video_id", F.coalesce("_told", "_last").alias("num_frames")), told


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "video_id" else f"{prefix}{c}") for c in df.columns])


def evaluation(gt: DataFrame, pred: DataFrame, num_frames: DataFrame | None = None, scope: list[str] | None = None, oracle: DataFrame | None = None, known: dict[str, int] | None = None) -> Evaluation:
    """Per-video rows, the overall row and warnings, for the videos that have ground truth.

    ``scope`` names the videos to evaluate (by default all with ground truth). Frame counts come from ``num_frames``,
    then from ``known``, then from the last interval; intervals beyond a known count raise. Average precision is added
    if every prediction has a finite score; joint (unprefixed) and strict (``strict_``) label metrics are added if the
    ground truth has labels, and ``oracle_`` ones if labels predicted on exactly its merged spans are given too. Whether
    the model predicts a label is decided over all its predictions, whatever their video.
    """
    labels = "direction" in gt.columns or "cycles" in gt.columns
    if oracle is not None and not labels:
        raise ValueError("oracle labels need a labelled ground truth")
    gt, pred = _events(gt), _events(pred)
    flags, warnings = evaluate.label_flags(pred), []
    scored = "score" in pred.columns
    if scored:
        n, finite, distinct = pred.agg(F.count("*"), F.count(exprs.finite(F.col("score"))), F.countDistinct("score")).first()
        scored = n == finite
        if scored and distinct < n:
            warnings.append("Some scores are tied; tied predictions are taken in the order of their rows")
    if not scored:
        warnings.append("No average precision: not every prediction has a finite score")
    if scope is not None:
        extra = sorted(set(scope) - set(_names(gt.select("video_id").distinct())))
        omitted = _names(gt.select("video_id").distinct().where(~F.col("video_id").isin(scope)))
        warnings += [f"Videos without ground truth are not evaluated: {', '.join(extra)}"] * bool(extra)
        warnings += [f"Videos outside the scope are not evaluated: {', '.join(omitted)}"] * bool(omitted)
        gt = gt.where(F.col("video_id").isin(scope))
    pred = pred.join(gt.select("video_id").distinct(), "video_id", "left_semi")
    if gt.isEmpty():
        raise ValueError("no video in the scope has ground truth")
    videos, told = _dimensions(gt, pred, num_frames, VIDEO_FRAMES if known is None else known)
    warnings += told

    rows = evaluate.video_metrics(gt, pred, videos)
    per_video, overall = rows, evaluate.summary(rows)
    if scored:
        maps = evaluate.map_columns(evaluate.average_precision(spans.merge_spans(gt, ["video_id"]), pred, videos))
        per_video = per_video.join(maps, "video_id", "left")
        overall = overall.crossJoin(maps.agg(*[F.avg(c).alias(c) for c in maps.columns if c != "video_id"]))
    if labels:
        truth, found = evaluate.labelled(gt, gt), evaluate.labelled(pred, pred)
        counts = evaluate.label_counts(truth, found, videos, flags=flags)
        per_video, overall = per_video.join(evaluate.label_metrics(counts), "video_id"), overall.crossJoin(evaluate.pooled_labels(counts))
        strict = {"strict_": evaluate.attribute_counts(truth, found, videos)}
        if oracle is not None:
            own = _events(oracle).join(videos.select("video_id"), "video_id", "left_semi")
            strict["oracle_"] = evaluate.oracle_attributes(truth, own, videos)
        for prefix, of in strict.items():
            per_video = per_video.join(_prefixed(evaluate.attribute_metrics(of), prefix), "video_id")
            overall = overall.crossJoin(_prefixed(evaluate.attribute_metrics(evaluate.pooled(of)), prefix))
        merged = spans.merge_spans(gt, ["video_id"])
        for n, what in (
            (truth.where("direction is null").count(), "merged spans have no direction and are left out of label metrics"),
            (evaluate.mixed_directions(merged, gt).count(), "merged spans lie under events of both directions; the longer one counts"),
            (evaluate.missed_events(gt, merged).count(), "labelled events overlap no merged span and are not evaluated"),
        ):
            warnings += [f"{n} {what}"] * bool(n)
    return Evaluation(per_video, overall, warnings)


def chunk(tables: dict[str, DataFrame], start: int, end: int, video: str, project: str | None = None) -> dict[str, DataFrame]:
    """A viewer's query: each table's rows of a frame range of one video; poses from one frame earlier."""
    return {name: contracts.scoped(df, start - (name == "poses"), end, video, project) for name, df in tables.items()}


def _labelled_rows(rows: DataFrame, series: DataFrame, dist_max: float) -> DataFrame:
    told = spans.rotation_labels(rows, spans.rotation_steps(series, ["video_id"], dist_max), "video_id")
    # Halves round to even digits, as the labels' readers expect.
    return told.withColumns({"Direction": F.col("direction"), "Cycles": F.bround("cycles", 2)})


def label_file(spark: SparkSession, source: str, target: str, series: DataFrame, dist_max: float = 160.0) -> DataFrame:
    """A copy of an interval file with the direction and cycles of each interval; old labels are replaced, the file's
    other columns stay."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the labelled copy needs a place of its own")
    table = intervals.read_csv(spark, source).withColumn("row_id", F.monotonically_increasing_id())
    rows = intervals.intervals_of(table, source, row_id="row_id")
    told = _labelled_rows(rows, series, dist_max).select("row_id", "start", "Direction", "Cycles")
    old = [c for c in table.columns if "".join(x for x in c.lower() if "a" <= x <= "z") in ("direction", "cycles")]
    out = table.drop(*old).join(told, "row_id").orderBy("row_id")
    out = out.select(*[F.col(f"`{c}`") for c in table.columns if c not in (*old, "row_id")], "Direction", "Cycles")
    intervals.write_csv(out, target)
    return out


def label_folder(spark: SparkSession, sources: list[str], target: str, series: DataFrame, dist_max: float = 160.0) -> list[str]:
    """A labelled copy of each file below ``target``, under its own name."""
    if not sources:
        raise FileNotFoundError("no prediction files")
    out = []
    for source in sources:
        out.append(f"{target.rstrip('/')}/{intervals.video_of_name(source)}")
        label_file(spark, source, out[-1], series, dist_max)
    return out


def label_spans_of(spark: SparkSession, source: str, target: str, series: DataFrame, dist_max: float = 160.0) -> DataFrame:
    """Merged spans of a file of several videos with their labels, written by video below ``target``."""
    merged = spans.merge_spans(intervals.read_intervals(spark, source), ["video_id"]).withColumn("row_id", F.xxhash64("video_id", "start"))
    out = _labelled_rows(merged, series, dist_max).select("video_id", F.col("video_id").alias("VideoID"), F.col("start").alias("StartFrame"), F.col("end").alias("EndFrame"), "Direction", "Cycles")
    out.repartition("video_id").sortWithinPartitions("video_id", "StartFrame").write.mode("overwrite").option("header", True).partitionBy("video_id").csv(target)
    return out.drop("video_id")
