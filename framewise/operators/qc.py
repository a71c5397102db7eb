"""Quality-control summaries of track and pair tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def video_stats(tracks: DataFrame, pairs: DataFrame, keys: Sequence[str], episode: Sequence[str], track: str = "track", length: str = "body", frame: str = "frame", gap: str = "dt") -> DataFrame:
    """Rows, distinct ids, medians, episode sizes, frame range and unknown shares of each video."""
    by = list(keys)
    of_tracks = tracks.groupBy(*by).agg(F.count("*").alias("track_rows"), F.countDistinct(track).alias("tracks"), F.expr(f"percentile(`{length}`, 0.5d)").alias("median_body"))
    sizes = pairs.groupBy(*by, *episode).agg(F.count("*").alias("_n"))
    of_episodes = sizes.groupBy(*by).agg(F.count("*").alias("episodes"), F.expr("percentile(_n, 0.5d)").alias("median_episode"))
    of_pairs = pairs.groupBy(*by).agg(F.count("*").alias("pair_rows"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.avg(F.col(gap).isNull().cast("double")).alias("dt_null"))
    return of_tracks.join(of_episodes, by).join(of_pairs, by)


def several_values(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Groups in which a column that should be constant has several values."""
    return rows.groupBy(*keys).agg(F.countDistinct(column).alias("values")).where("values > 1")


def null_shares(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_null") for c in columns])


def typical_episode(pairs: DataFrame, video: str, episode: Sequence[str], frame: str = "frame", rows: int = 80) -> DataFrame:
    """The first rows of each video's episode whose size is nearest to the median; ties by the episode's ids."""
    sizes = pairs.groupBy(video, *episode).agg(F.count("*").alias("_n"))
    medians = sizes.groupBy(video).agg(F.expr("percentile(_n, 0.5d)").alias("_m"))
    order = Window.partitionBy(video).orderBy(F.abs(F.col("_n") - F.col("_m")), *episode)
    chosen = sizes.join(medians, video).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(video, *episode)
    held = pairs.join(F.broadcast(chosen), [video, *episode])  # one row for each video
    return held.withColumn("_line", F.row_number().over(Window.partitionBy(video).orderBy(frame))).where(F.col("_line") <= rows).drop("_line")


def grid(rows: DataFrame) -> str:
    """A small table as Markdown; shares as percentages, nulls empty, bars escaped."""
    names = rows.columns

    def cell(name: str, value) -> str:
        if value is None:
            return ""
        if name.endswith(("_rate", "_frac", "_null")):
            return f"{100 * value:.1f}%"
        return f"{value:.4g}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value).replace("|", "\\|")

    lines = [names, ["---"] * len(names), *[[cell(c, row[c]) for c in names] for row in rows.collect()]]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def markdown(rows: DataFrame, title: str) -> str:
    return f"# {title}\n\n{grid(rows)}\n"
