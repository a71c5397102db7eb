"""Frame spines, windows that hold at any video length, and the closest pair of a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a video that one window task works on, with a halo on both sides.
BLOCK = 1 << 16


def spine(videos: DataFrame, video: str = "video_id", count: str = "num_frames") -> DataFrame:
    """Every frame 0..count-1 of every video; blocks of frames are dealt out before they become rows."""
    last = F.col(count).cast("long") - 1
    blocks = videos.where(F.col(count) > 0).select(video, last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK))).alias("_block"))
    blocks = blocks.repartition(video, "_block")
    return blocks.select(video, F.explode(F.sequence(F.col("_block") * BLOCK, F.least("_last", (F.col("_block") + 1) * BLOCK - 1))).alias("frame"))


def dense(frames: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` on the spine: a frame without a row has nulls."""
    return frames.join(rows, keys, "left")


def zero_filled(frames: DataFrame, scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return dense(frames, scores.select(*keys, score), keys).withColumn(score, F.coalesce(score, F.lit(0.0)))


def windowed(df: DataFrame, keys: list[str], frame: str, before: int, after: int, columns: Callable[[Window], dict[str, Column]], block: int = BLOCK) -> DataFrame:
    """Columns over windows that reach ``before`` frames back and ``after`` ahead, ordered by ``frame``.

    A few long videos would give a few long window partitions. Videos are cut into blocks instead, each with
    copies of the rows within reach on both sides, so a partition has a bounded length whatever the video's; the
    copies are dropped afterwards.
    """
    own = F.floor(F.col(frame) / block)
    copies = F.sequence(F.floor((F.col(frame) - after) / block), F.floor((F.col(frame) + before) / block))
    spread = df.withColumn("_block", F.explode(copies))
    window = Window.partitionBy(*keys, "_block").orderBy(frame)
    return spread.withColumns(columns(window)).where(F.col("_block") == own).drop("_block")


def range_with_halo(df: DataFrame, frame: str, low: int, high: int, before: int, after: int) -> DataFrame:
    """The frames that windows over [low, high] need. Filters on the order key aren't pushed below a window by
    the optimizer, so ranges are cut first, then windowed, then trimmed to [low, high]."""
    return df.where(F.col(frame).between(low - before, high + after))


def closest_pair(pairs: DataFrame, keys: list[str], distance: str = "dist", ties: tuple[str, ...] = ("t1", "t2"), keep: str | None = None) -> DataFrame:
    """The pair with the least distance of every frame, unknown distances last; ties by ``ties``."""
    rows = pairs if keep is None else pairs.where(keep)
    order = Window.partitionBy(*keys).orderBy(F.col(distance).asc_nulls_last(), *ties)
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def self_pairs(tracks: DataFrame, keys: list[str], track: str = "track", columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """All pairs of tracks of a frame, smaller id first, with the columns of both sides as ``<c>_1``, ``<c>_2``."""
    sides = [tracks.select(*keys, F.col(track).alias(f"t{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in (1, 2)]
    return sides[0].join(sides[1], keys).where("t1 < t2")


def same_pair(a: str, b: str, episode: str | None, window: Window) -> Column:
    """Whether the pair of a spine row is that of the row before, in either order, and of the same episode."""
    low, high = F.least(a, b), F.greatest(a, b)
    told = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.lag(low).over(window) == low) & (F.lag(high).over(window) == high)
    if episode:
        told = told & (F.lag(episode).over(window) == F.col(episode))
    return F.coalesce(told, F.lit(False))


def step_rate(x: str, same: Column, window: Window, fps: float = 30.0) -> Column:
    return F.when(same, (F.col(x) - F.lag(x).over(window)) * fps)


def offsets(df: DataFrame, keys: list[str], frame: str, signals: list[str], half: int = 60, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """One array for each signal with its values at offsets -half..half by ``stride`` on a dense spine, null
    beyond the ends of the video and where the signal is null."""

    def columns(window):
        reach = F.collect_list(F.struct(F.col(frame), *signals)).over(window.rowsBetween(-half, half))
        return {"_reach": F.map_from_entries(F.transform(reach, lambda r: F.struct(r[frame], r)))}

    found = windowed(df.select(*keys, frame, *signals), keys, frame, half, half, columns, block)
    steps = F.sequence(F.lit(-half), F.lit(half), F.lit(stride))

    def window_of(signal: str) -> Column:
        return F.transform(steps, lambda o: F.try_element_at(F.col("_reach"), F.col(frame) + o)[signal]).alias(f"{signal}_window")

    return found.select(*keys, frame, *[window_of(s) for s in signals])
