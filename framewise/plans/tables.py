"""Composite tables of the experiments: the model table with labels, the two older detectors' inputs beside it, and the
sampled windows that the boosted detector learns from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.operators import framefeat, scoring, spans
from framewise.operators.frames import dense, spine
from framewise.operators.pairfeat import BEARINGS, DISTANCES, RATES
from framewise.plans import models

#: The pair columns that the linear detector aggregates, and the offsets of the boosted detector's windows.
PAIR_VALUES = [*[f"{d}_px" for d in DISTANCES], *[f"d_{x}_rad_s" for x in ("heading_1", "heading_2", "orbital")]]
PAIR_ANGLES = ["orbital_rad", "rel_heading_rad", *BEARINGS]
SIGNALS = ("dist", "rate", "dist_rate", "rate_rate", "crossing_speed")
HALF_WINDOW, STRIDE = 60, 4
KEYS = ["video_id", "frame"]

assert set(RATES) < set(PAIR_VALUES)


def lr_features(poses: DataFrame, pairs: DataFrame, videos: DataFrame, track: str = "track", frame: str = "frame") -> DataFrame:
    """The linear detector's 102 features of every frame, each with the prefix ``lr_``: 50 of the poses and 52 of all
    pairs. A frame without pairs has a count of 0 and nulls."""
    of_poses = framefeat.pose_features(poses, videos, ["video_id"], track, frame)
    rows = pairs.withColumn("frame", F.col(frame))
    of_pairs = framefeat.pair_features(rows, KEYS, PAIR_VALUES, PAIR_ANGLES).withColumn("pair_count", F.col("pair_count").cast("double"))
    out = dense(of_poses, of_pairs, KEYS).fillna(0.0, ["pair_count"])
    return out.select(*KEYS, *[F.col(c).alias(f"lr_{c}") for c in out.columns if c not in KEYS])


def win_name(signal: str, offset: int) -> str:
    return f"win_{signal}_offset_{offset:+d}"


def flat_windows(series: DataFrame, signals=SIGNALS, half: int = HALF_WINDOW, stride: int = STRIDE) -> DataFrame:
    """A column for every signal and offset, signal by signal: 155 with a stride of 4 and 605 with one of 1."""
    steps = range(-half, half + 1, stride)
    found = framefeat.signal_windows(series, signals=signals, half=half, stride=stride)
    return found.select(*KEYS, *[F.col(f"{s}_window")[k].alias(win_name(s, o)) for s in signals for k, o in enumerate(steps)])


def baseline_frames(model_frames: DataFrame, lr: DataFrame, windows: DataFrame) -> DataFrame:
    """Both older detectors' inputs on the frames of the model table. A frame that an input lacks, or has twice, raises
    where it is read."""
    one = lambda df, name: df.groupBy(*KEYS).agg(F.count("*").alias(f"_{name}"), *[F.first(c).alias(c) for c in df.columns if c not in KEYS])
    out = model_frames.select(*KEYS).join(one(lr, "lr"), KEYS, "left").join(one(windows, "win"), KEYS, "left")
    wrong = F.raise_error(F.concat(F.lit("not one row of input for frame "), F.col("frame").cast("string"), F.lit(" of "), F.col("video_id")))
    sound = (F.coalesce("_lr", F.lit(0)) == 1) & (F.coalesce("_win", F.lit(0)) == 1)
    return out.withColumn("video_id", F.when(sound, F.col("video_id")).otherwise(wrong.cast("string"))).drop("_lr", "_win")


def with_baselines(model_frames: DataFrame, baselines: DataFrame) -> DataFrame:
    """The model table with the older detectors' inputs, one to one by video and frame."""
    extra = [c for c in baselines.columns if c in KEYS or c not in model_frames.columns]
    return model_frames.join(baselines.select(*extra), KEYS, "left")


def model_table(pairs: DataFrame, valid: DataFrame, labels: DataFrame, distance: str, closest: list[str], aggregates: dict[str, list[str]], sides: tuple[str, str] = ("t1", "t2")) -> DataFrame:
    """The closest valid pair of every frame of all videos with its features, aggregates over the frame's valid pairs and
    the frame's label. ``valid`` holds the keys of the pairs to keep, each once."""
    held = pairs.join(valid.select(*KEYS, *sides), [*KEYS, *sides], "left_semi")
    found = framefeat.model_frames(held, KEYS, distance, closest, aggregates, sides)
    return spans.frame_labels(found, labels, ["video_id"])


def prepare_dataset(series: DataFrame, positives: DataFrame, videos: DataFrame, signals=SIGNALS, half: int = HALF_WINDOW, stride: int = 1) -> DataFrame:
    """The frames in and around positive spans with their windows and labels; a video without positives raises."""
    bare = [r[0] for r in videos.join(positives, "video_id", "left_anti").select("video_id").orderBy("video_id").collect()]
    if bare:
        raise ValueError(f"no positive spans for {', '.join(bare)}")
    sampled = spans.buffer_sample(positives, videos)
    return sampled.join(flat_windows(series, signals, half, stride), KEYS)


def train(dataset: DataFrame, fit=models.boosted, label: str = "label", test_share: float = 0.2, seed: int = 42) -> tuple[models.Model, DataFrame]:
    """A model of the training part of a sampled dataset and the held-out rows with their scores. Whole classes keep
    their share in both parts."""
    names = [c for c in dataset.columns if c not in (*KEYS, label)]
    keyed = dataset.withColumn("_key", F.xxhash64(*KEYS))
    parts = scoring.stratified_split(keyed, "_key", label, test_share, seed).drop("_key")
    model = fit(parts.where(~F.col("test")).drop("test"), names)
    return model, models.predict(model, parts.where("test").drop("test"))


def full_scores(model: models.Model, series: DataFrame, videos: DataFrame, signals=SIGNALS, half: int = HALF_WINDOW, stride: int = 1) -> DataFrame:
    """A score for every frame of every video."""
    scored = models.predict(model, dense(spine(videos), flat_windows(series, signals, half, stride), KEYS))
    return scored.select(*KEYS, "score")
