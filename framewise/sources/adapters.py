"""Tracking-shaped views of the star-schema test tables, each with the same definition in SQL.

``events`` become tracks (8 ids on 30-minute frames, two videos for every 10,000 events), pairs of tracks of a frame, and
intervals: every ``error`` event is a labelled interval and every ``click`` event a predicted one on 10-minute frames of
ten videos.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.functions.exprs import wrap_rad
from framewise.operators.framefeat import KEYPOINTS
from framewise.operators.frames import self_pairs

#: 2024-01-01 in 30-minute and in 10-minute frames since the epoch.
FIRST_HALF_HOUR, FIRST_TEN_MINUTES = 946704, 2840112
FRAMES_PER_VIDEO, INTERVAL_FRAMES, INTERVAL_VIDEOS = 720, 4320, 10
#: Events of one group of tracks; the number of groups, and so of videos, grows with the table.
GROUP_EVENTS = 10_000
FLOOR = [(20.0, 100.0), (1200.0, 50.0), (1250.0, 3000.0), (600.0, 4200.0), (40.0, 2500.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def groups(spark: SparkSession, sf_dir: str) -> int:
    return max(1, table(spark, sf_dir, "events").count() // GROUP_EVENTS)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, track, x, y, body, heading, speed, bend, missing, sex: one row per track and frame, from the event
    with the largest id."""
    group = ((F.col("event_id") % groups(spark, sf_dir)) * 2).cast("long")
    slot = (F.floor(_micros() / 1_800_000_000) - FIRST_HALF_HOUR).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "props", slot.alias("slot"), group.alias("first_video"), (F.col("user_id") % 8).alias("track"))
    last = Window.partitionBy("slot", "first_video", "track").orderBy(F.desc("event_id"))
    rows = rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1")
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.select(
        F.concat(F.lit("v"), (F.col("first_video") + F.floor(F.col("slot") / FRAMES_PER_VIDEO)).cast("string")).alias("video_id"), (F.col("slot") % FRAMES_PER_VIDEO).alias("frame"), "track",
        (k * 13).cast("double").alias("x"), (F.col("value") * 10).alias("y"), (100 + F.col("user_id") % 50).cast("double").alias("body"),
        ((F.col("event_id") * 7 % 628).cast("double") / F.lit(100.0) - F.lit(3.0)).alias("heading"), ((F.col("event_id") % 17).cast("double") / F.lit(4.0)).alias("speed"), ((F.col("event_id") % 11).cast("double") / F.lit(8.0) - F.lit(0.5)).alias("bend"),
        (F.col("event_id") % 4).alias("missing"), (F.col("user_id") % 2).alias("sex"),
    )


GROUPS = f"(SELECT greatest(1, count(*) // {GROUP_EVENTS}) FROM events)"
TRACKS = f"""
tracks AS (
  SELECT 'v' || CAST(first_video + slot // {FRAMES_PER_VIDEO} AS VARCHAR) AS video_id, slot % {FRAMES_PER_VIDEO} AS frame, track, CAST(k * 13 AS DOUBLE) AS x, value * 10 AS y,
    CAST(100 + user_id % 50 AS DOUBLE) AS body, CAST(event_id * 7 % 628 AS DOUBLE) / 100.0::DOUBLE - 3.0::DOUBLE AS heading,
    CAST(event_id % 17 AS DOUBLE) / 4.0::DOUBLE AS speed, CAST(event_id % 11 AS DOUBLE) / 8.0::DOUBLE - 0.5::DOUBLE AS bend, event_id % 4 AS missing, user_id % 2 AS sex
  FROM (SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1800000000 - {FIRST_HALF_HOUR} AS slot, user_id % 8 AS track, event_id % g * 2 AS first_video,
      row_number() OVER (PARTITION BY epoch_us(ts) // 1800000000, event_id % g, user_id % 8 ORDER BY event_id DESC) AS nth FROM events, (SELECT {GROUPS} AS g)) WHERE nth = 1)"""

WRAP = "(({0}) + pi() - 2 * pi() * floor((({0}) + pi()) / (2 * pi())) - pi())"


def sql_wrap(x: str) -> str:
    return WRAP.format(x)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tracks of a frame in the columns of a pair table; episodes end after gaps of over 30 frames."""
    both = self_pairs(tracks(spark, sf_dir), ["video_id", "frame"], "track", ("x", "y", "body", "heading", "speed", "bend", "missing", "sex"))
    dx, dy = F.col("x_2") - F.col("x_1"), F.col("y_2") - F.col("y_1")
    order = Window.partitionBy("video_id", "t1", "t2").orderBy("frame")
    out = both.withColumns({"dist": F.sqrt(dx * dx + dy * dy), "orbital": F.atan2(dy, dx), "rel_heading": wrap_rad(F.col("heading_2") - F.col("heading_1")), "_gap": F.col("frame") - F.lag("frame").over(order)})
    out = out.withColumns({"bearing_1": wrap_rad(F.col("orbital") - F.col("heading_1")), "bearing_2": wrap_rad(F.col("orbital") + F.lit(math.pi) - F.col("heading_2"))})
    out = out.withColumn("pair_episode_id", F.sum(F.when(F.col("_gap") > 30, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("video_id", "t1", "t2", "pair_episode_id").orderBy("frame")
    out = out.withColumn("dt", (F.col("frame") - F.lag("frame").over(inside)).cast("double"))
    # A rate for the detectors: small multiples of an angle, some beyond the limit of 15.
    return out.withColumn("rate", (F.col("orbital") - F.lag("orbital").over(inside)) * F.lit(4.0)).drop("_gap")


PAIRS = TRACKS + f""",
pairs0 AS (
  SELECT a.video_id, a.frame, a.track AS t1, b.track AS t2, {', '.join(f'a.{c} AS {c}_1, b.{c} AS {c}_2' for c in ('x', 'y', 'body', 'heading', 'speed', 'bend', 'missing', 'sex'))},
    sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dist, atan2(b.y - a.y, b.x - a.x) AS orbital,
    a.frame - lag(a.frame) OVER (PARTITION BY a.video_id, a.track, b.track ORDER BY a.frame) AS gap
  FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track < b.track),
pairs1 AS (
  SELECT * EXCLUDE (gap), {sql_wrap('heading_2 - heading_1')} AS rel_heading, {sql_wrap('orbital - heading_1')} AS bearing_1, {sql_wrap('orbital + pi() - heading_2')} AS bearing_2,
    CAST(sum(CASE WHEN gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, t1, t2 ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pair_episode_id FROM pairs0),
pairs AS (
  SELECT *, CAST(frame - lag(frame) OVER w AS DOUBLE) AS dt, (orbital - lag(orbital) OVER w) * 4.0::DOUBLE AS rate FROM pairs1 WINDOW w AS (PARTITION BY video_id, t1, t2, pair_episode_id ORDER BY frame))"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(2 * groups(spark, sf_dir)).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("video_id"), F.lit(FRAMES_PER_VIDEO).cast("long").alias("num_frames"))


VIDEOS = f"videos AS (SELECT 'v' || CAST(i AS VARCHAR) AS video_id, {FRAMES_PER_VIDEO} AS num_frames FROM (SELECT unnest(range(0, 2 * {GROUPS})) AS i))"
SPINE = VIDEOS + ", spine AS (SELECT video_id, unnest(range(0, num_frames)) AS frame FROM videos)"


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs under the names of the pair-motion features, at one frame of 1/30 s for each row's frame."""
    p = pairs(spark, sf_dir)
    named = {"project_id": F.lit("p"), "day_label": F.col("video_id"), "FrameNum": F.col("frame"), "TrackUID_1": F.col("t1"), "TrackUID_2": F.col("t2"), "centroid_distance_px": F.col("dist"), "orbital_rad": F.col("orbital"), "rel_heading_rad": F.col("rel_heading"), "dt_frames": F.col("dt"),
             "d_orbital_rad_s": F.col("rate"), "d_heading_1_rad_s": F.col("heading_1") * 6, "d_heading_2_rad_s": F.col("heading_2") * 3}
    for k in (1, 2):
        named |= {f"body_length_px_{k}": F.col(f"body_{k}"), f"speed_bl_s_{k}": F.col(f"speed_{k}"), f"bend_angle_rad_{k}": F.col(f"bend_{k}"), f"bearing_{k}_rad": F.col(f"bearing_{k}"), f"qc_n_missing_kp_{k}": F.col(f"missing_{k}")}
    named["pair_sex"] = F.when(F.col("sex_1") != F.col("sex_2"), "FM").otherwise("MM")
    return p.select("pair_episode_id", *[c.alias(n) for n, c in named.items()])


MOTION = PAIRS + """,
motion AS (
  SELECT pair_episode_id, 'p' AS project_id, video_id AS day_label, frame AS FrameNum, t1 AS TrackUID_1, t2 AS TrackUID_2, dist AS centroid_distance_px, orbital AS orbital_rad, rel_heading AS rel_heading_rad, dt AS dt_frames,
    rate AS d_orbital_rad_s, heading_1 * 6 AS d_heading_1_rad_s, heading_2 * 3 AS d_heading_2_rad_s, body_1 AS body_length_px_1, body_2 AS body_length_px_2, speed_1 AS speed_bl_s_1, speed_2 AS speed_bl_s_2,
    bend_1 AS bend_angle_rad_1, bend_2 AS bend_angle_rad_2, bearing_1 AS bearing_1_rad, bearing_2 AS bearing_2_rad, missing_1 AS qc_n_missing_kp_1, missing_2 AS qc_n_missing_kp_2, CASE WHEN sex_1 <> sex_2 THEN 'FM' ELSE 'MM' END AS pair_sex FROM pairs)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks with a position for every keypoint: a line from the track's own position, bent by its heading."""
    points = {}
    for k, name in enumerate(KEYPOINTS):
        points |= {f"{name}_x": F.col("x") + F.lit(3.0 * k), f"{name}_y": F.col("y") + F.lit(float(k)) * F.col("heading")}
    return tracks(spark, sf_dir).select("video_id", "frame", "track", *[c.alias(n) for n, c in points.items()])


POSES = "poses AS (SELECT video_id, frame, track, " + ", ".join(f"x + {3.0 * k}::DOUBLE AS {n}_x, y + {float(k)}::DOUBLE * heading AS {n}_y" for k, n in enumerate(KEYPOINTS)) + " FROM tracks)"

#: The linear detector's pair columns from those of the pairs.
LINEAR_VALUES = {
    "centroid_distance_px": "dist", "dist_nose1_nose2_px": "dist + speed_1", "dist_nose1_tailtip2_px": "dist + speed_2", "dist_nose2_tailtip1_px": "dist * speed_1", "dist_nose1_spine4of2_px": "dist * speed_2",
    "dist_nose2_spine4of1_px": "speed_1 - speed_2", "d_heading_1_rad_s": "heading_1 * 6", "d_heading_2_rad_s": "heading_2 * 3", "d_orbital_rad_s": "rate", "orbital_rad": "orbital", "rel_heading_rad": "rel_heading", "bearing_1_rad": "bearing_1", "bearing_2_rad": "bearing_2",
}


def linear_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).selectExpr("video_id", "frame", "t1", "t2", *[f"{e} AS {n}" for n, e in LINEAR_VALUES.items()])


LINEAR = "lin AS (SELECT video_id, frame, t1, t2, " + ", ".join(f"{e} AS {n}" for n, e in LINEAR_VALUES.items()) + " FROM pairs)"


def intervals(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """video_id, row_id, start, end, direction, cycles, score of every event of a kind."""
    e = F.col("event_id")
    start = (F.floor(_micros() / 600_000_000) - FIRST_TEN_MINUTES).cast("long")
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", (F.col("user_id") % INTERVAL_VIDEOS).alias("v"), start.alias("start"))
    return rows.select(
        F.concat(F.lit("v"), F.col("v").cast("string")).alias("video_id"), e.alias("row_id"), "start", F.least(F.lit(INTERVAL_FRAMES - 1), F.col("start") + e % 7).cast("long").alias("end"),
        F.when(e % 3 == 0, "CW").when(e % 3 == 1, "CCW").alias("direction"), F.when(e % 8 < 7, (e % 8).cast("double") / F.lit(2.0)).alias("cycles"), ((e * 37 % 1000).cast("double") / F.lit(1000.0)).alias("score"),
    )


def _interval_sql(name: str, kind: str) -> str:
    return f"""{name} AS (
  SELECT 'v' || CAST(user_id % {INTERVAL_VIDEOS} AS VARCHAR) AS video_id, event_id AS row_id, s AS "start", least({INTERVAL_FRAMES - 1}, s + event_id % 7) AS "end",
    CASE WHEN event_id % 3 = 0 THEN 'CW' WHEN event_id % 3 = 1 THEN 'CCW' END AS direction, CASE WHEN event_id % 8 < 7 THEN CAST(event_id % 8 AS DOUBLE) / 2.0::DOUBLE END AS cycles, CAST(event_id * 37 % 1000 AS DOUBLE) / 1000.0::DOUBLE AS score
  FROM (SELECT *, epoch_us(ts) // 600000000 - {FIRST_TEN_MINUTES} AS s FROM events WHERE event_type = '{kind}'))"""


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir, "error")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir, "click")


def interval_videos(spark: SparkSession) -> DataFrame:
    return spark.range(INTERVAL_VIDEOS).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("video_id"), F.lit(INTERVAL_FRAMES).cast("long").alias("num_frames"))


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that somebody has looked at."""
    return intervals(spark, sf_dir, "view")


REVIEWED = _interval_sql("reviewed", "view")


def _merged_sql(source: str) -> str:
    return f"""{source}_m AS (
  SELECT video_id, min("start") AS "start", max("end") AS "end" FROM (
    SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY "start", "end", row_id ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY video_id ORDER BY "start", "end", row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM {source}))
  GROUP BY video_id, run)"""


EVENTS = f"iv AS (SELECT 'v' || CAST(i AS VARCHAR) AS video_id, {INTERVAL_FRAMES} AS num_frames FROM range({INTERVAL_VIDEOS}) t(i)), " + _interval_sql("gt", "error") + ", " + _interval_sql("pred", "click")
REVIEWED_SPANS = REVIEWED + ", " + _merged_sql("reviewed")
SPANS = EVENTS + ", " + _merged_sql("gt") + ", " + _merged_sql("pred")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels: a length-based score, some features, and label (quality)."""
    n = F.col("n_chars").cast("double")
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("video_id"), ((F.col("n_chars") % 50).cast("double") / F.lit(50.0)).alias("score"), F.col("quality").alias("label"),
        n.alias("f_len"), (n * 2 + F.col("doc_id") % 5).alias("f_len2"), (F.col("doc_id") % 97).cast("double").alias("f_id"), F.when(F.col("doc_id") % 9 != 0, (F.col("n_chars") % 31).cast("double")).alias("f_mod"),
    )


SCORED = """scored AS (
  SELECT doc_id, 'v' || CAST(doc_id % 2 AS VARCHAR) AS video_id, CAST(n_chars % 50 AS DOUBLE) / 50.0::DOUBLE AS score, quality AS label, CAST(n_chars AS DOUBLE) AS f_len, CAST(n_chars AS DOUBLE) * 2 + doc_id % 5 AS f_len2,
    CAST(doc_id % 97 AS DOUBLE) AS f_id, CASE WHEN doc_id % 9 <> 0 THEN CAST(n_chars % 31 AS DOUBLE) END AS f_mod FROM documents JOIN labels USING (doc_id))"""
