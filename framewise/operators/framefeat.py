"""Per-frame features: pose and pair aggregates with causal trailing means, the closest pair's signals, and the
model table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.exprs import finite, segment_crossing, turn
from framewise.operators.frames import closest_pair, dense, offsets, same_pair, spine, step_rate, windowed

#: Keypoints, and those of the midline in order.
KEYPOINTS = ["Nose", "LeftEye", "RightEye", "Head", "Spine1", "Spine2", "Spine3", "Spine4", "Peduncle", "TailTip"]
MIDLINE = ["Nose", "Head", "Spine1", "Spine2", "Spine3", "Spine4", "Peduncle", "TailTip"]
TRAIL = 30


def distance(a: str, b: str) -> Column:
    return F.hypot(F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y"))


def trailing_mean(frames: DataFrame, keys: list[str], columns: Sequence[str], frame: str = "frame", length: int = TRAIL) -> DataFrame:
    """<column>_trailing<length>: mean of the known values of the last ``length`` frames of a dense spine."""
    means = lambda w: {f"{c}_trailing{length}": F.avg(c).over(w.rowsBetween(1 - length, 0)) for c in columns}
    return windowed(frames, keys, frame, length - 1, 0, means)


def displacement(tracks: DataFrame, keys: list[str], points: Sequence[str], frame: str = "frame") -> DataFrame:
    """<point>_moved: distance since the frame right before; null after a gap or if a position is missing."""
    order = Window.partitionBy(*keys).orderBy(frame)
    next_ = F.col(frame) - F.lag(frame).over(order) == 1
    delta = lambda c: finite(F.col(c)) - F.lag(finite(F.col(c))).over(order)
    return tracks.withColumns({f"{p}_moved": F.when(next_, F.hypot(delta(f"{p}_x"), delta(f"{p}_y"))) for p in points})


def turned(tracks: DataFrame, keys: list[str], heading: str, frame: str = "frame") -> DataFrame:
    """turn: absolute wrapped change of heading since the frame right before."""
    order = Window.partitionBy(*keys).orderBy(frame)
    next_ = F.col(frame) - F.lag(frame).over(order) == 1
    return tracks.withColumn("turn", F.when(next_, F.abs(turn(F.col(heading) - F.lag(heading).over(order)))))


def pose_features(poses: DataFrame, videos: DataFrame, keys: list[str], track: str = "TrackID", frame: str = "FrameNum") -> DataFrame:
    """50 causal features per frame: movement of the keypoints in body lengths, bend and turn, their mean and
    maximum over tracks, the track count, and trailing means of those 25."""
    by_track = [*keys, track]
    clean = poses.select(*by_track, F.col(frame).alias("frame"), *[finite(F.col(f"{k}_{a}").cast("double")).alias(f"{k}_{a}") for k in KEYPOINTS for a in ("x", "y")])
    length = sum((distance(a, b) for a, b in zip(MIDLINE[1:-1], MIDLINE[2:], strict=True)), distance(MIDLINE[0], MIDLINE[1]))
    clean = clean.withColumns({"_length": length, "_heading": F.atan2(F.col("Nose_y") - F.col("Spine1_y"), F.col("Nose_x") - F.col("Spine1_x"))})
    long = F.when(F.col("_length") > 1, F.col("_length"))
    clean = displacement(turned(clean, by_track, "_heading"), by_track, KEYPOINTS).withColumn("bend", 1 - distance("Nose", "TailTip") / long)
    signals = {**{k: F.log1p(F.col(f"{k}_moved") / long) for k in KEYPOINTS}, "bend": F.col("bend"), "turn": F.col("turn")}
    rows = clean.select(*keys, "frame", *[c.alias(n) for n, c in signals.items()])
    stats = [F.count("*").cast("double").alias("track_count")]
    for s in signals:
        stats += [F.avg(s).alias(f"{s}_mean"), F.max(s).alias(f"{s}_max")]
    found = dense(spine(videos, keys[0]), rows.groupBy(*keys, "frame").agg(*stats), [*keys, "frame"]).fillna(0.0, ["track_count"])
    base = [c for c in found.columns if c not in (*keys, "frame")]
    return trailing_mean(found, keys, base)


def pair_features(pairs: DataFrame, keys: list[str], values: Sequence[str], angles: Sequence[str] = ()) -> DataFrame:
    """Mean, least and largest of values and of the sine and cosine of angles over the pairs of a frame."""
    clean = {v: finite(F.col(v).cast("double")) for v in values}
    for a in angles:
        clean |= {f"{a}_sin": F.sin(finite(F.col(a).cast("double"))), f"{a}_cos": F.cos(finite(F.col(a).cast("double")))}
    rows = pairs.select(*keys, *[c.alias(n) for n, c in clean.items()])
    return rows.groupBy(*keys).agg(F.count("*").alias("pair_count"), *[f(n).alias(f"{n}_{s}") for n in clean for s, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def closest_series(pairs: DataFrame, videos: DataFrame, video: str = "video_id", distance: str = "dist", rate: str = "rate", sides: tuple[str, str] = ("t1", "t2"), episode: str | None = "pair_episode_id", keep: str | None = None, poses: DataFrame | None = None, track: str = "track", max_rate: float = 15.0) -> DataFrame:
    """The closest pair's signals on the dense spine: dist, rate (0 if unknown or too fast), their step rates
    while the pair stays the same, and with poses the speed of the crossing of head and tail lines."""
    keys = [video, "frame"]
    best = closest_pair(pairs, keys, distance, sides, keep).select(*keys, *sides, *([episode] if episode else []), F.col(distance).alias("dist"), F.when(F.abs(rate) <= max_rate, F.col(rate)).alias("_rate"))
    if poses is not None:
        for k, side in enumerate(sides):
            points = [F.col(f"{p}_{a}").alias(f"_{p}_{a}{k}") for p in ("Head", "TailTip") for a in ("x", "y")]
            best = best.join(poses.select(*keys, F.col(track).alias(side), *points), [*keys, side], "left")
        point = lambda p, k: (F.col(f"_{p}_x{k}"), F.col(f"_{p}_y{k}"))
        cx, cy = segment_crossing(point("Head", 0), point("Head", 1), point("TailTip", 0), point("TailTip", 1))
        best = best.withColumns({"crossing_x": cx, "crossing_y": cy})
    rows = dense(spine(videos, video), best, keys)

    def columns(w):
        same = same_pair(*sides, episode, w)
        out = {"same_pair": same, "dist_rate": step_rate("dist", same, w), "rate_rate": step_rate("_rate", same, w)}
        if poses is not None:
            out["crossing_speed"] = F.when(same, F.hypot(F.col("crossing_x") - F.lag("crossing_x").over(w), F.col("crossing_y") - F.lag("crossing_y").over(w)) * 30.0)
        return out

    out = windowed(rows, [video], "frame", 1, 0, columns).withColumn("rate", F.coalesce("_rate", F.lit(0.0)))
    return out.drop("_rate", *[c for c in out.columns if c.startswith(("_Head", "_TailTip"))])


def signal_windows(series: DataFrame, video: str = "video_id", signals: Sequence[str] = ("dist", "rate", "dist_rate", "rate_rate"), half: int = 60, stride: int = 1) -> DataFrame:
    return offsets(series, [video], "frame", list(signals), half, stride)


def model_frames(pairs: DataFrame, keys: list[str], distance: str, closest_columns: Sequence[str], all_columns: dict[str, Sequence[str]], ties: tuple[str, str] = ("t1", "t2")) -> DataFrame:
    """The closest pair's columns beside aggregates over all pairs of the frame, from one exchange by frame."""
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(F.col(distance).asc_nulls_last(), *ties)
    stats = {f"all_{c}_{s}": getattr(F, {"mean": "avg"}.get(s, s))(c).over(whole) for c, kinds in all_columns.items() for s in kinds}
    rows = pairs.withColumns({"n_pairs": F.count("*").over(whole), **stats, "_nth": F.row_number().over(order)})
    return rows.where("_nth = 1").select(*keys, *ties, distance, *closest_columns, "n_pairs", *stats)
