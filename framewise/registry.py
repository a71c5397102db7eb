"""Registered queries of the library's own operators and the SQL they must agree with.

Each query applies one operator to a whole view of the test tables; results are integers, texts and doubles that
are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions import exprs as X
from framewise.operators import clean, detect, evaluate, framefeat, frames, pairfeat, scoring, spans
from framewise.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def R(c, digits: int = 4, alias: str | None = None):
    """Rounded, with -0 as 0."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, digits) + F.lit(0.0)
    return out.alias(alias) if alias else out


def r(x: str, digits: int = 4) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["closest_pair"](spark, sf_dir)


KEYS = ["video_id", "frame"]

# -- frames and pairs -------------------------------------------------------------------------------------------

CLOSEST = A.PAIRS + ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY dist NULLS LAST, t1, t2) AS nth FROM pairs) WHERE nth = 1)"


@query(f"WITH {CLOSEST} SELECT video_id, frame, t1, t2, {r('dist')} AS dist FROM best")
def closest_pair(spark, sf):
    return frames.closest_pair(A.pairs(spark, sf), KEYS).select(*KEYS, "t1", "t2", R("dist", alias="dist"))


@query(f"WITH {A.TRACKS} SELECT a.video_id, a.frame, a.track AS t1, b.track AS t2, {r('b.x - a.x')} AS dx FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track < b.track")
def frame_self_pairs(spark, sf):
    return frames.self_pairs(A.tracks(spark, sf), KEYS).select(*KEYS, "t1", "t2", R(F.col("x_2") - F.col("x_1"), alias="dx"))


@query(f"WITH {CLOSEST}, {A.SPINE} SELECT s.video_id, s.frame, t1, t2, {r('dist')} AS dist FROM spine s LEFT JOIN best b ON s.video_id = b.video_id AND s.frame = b.frame")
def spine_reindex(spark, sf):
    best = frames.closest_pair(A.pairs(spark, sf), KEYS)
    return frames.dense(frames.spine(A.videos(spark, sf)), best, KEYS).select(*KEYS, "t1", "t2", R("dist", alias="dist"))


SERIES = CLOSEST + ", " + A.SPINE + """, dense AS (
  SELECT s.video_id, s.frame, t1, t2, pair_episode_id, dist, CASE WHEN abs(rate) <= 15 THEN rate END AS mrate FROM spine s LEFT JOIN best b ON s.video_id = b.video_id AND s.frame = b.frame),
same AS (SELECT *, coalesce(least(t1, t2) = lag(least(t1, t2)) OVER w AND greatest(t1, t2) = lag(greatest(t1, t2)) OVER w AND pair_episode_id = lag(pair_episode_id) OVER w, false) AS same_pair,
  lag(dist) OVER w AS pdist, lag(mrate) OVER w AS prate FROM dense WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
series AS (SELECT video_id, frame, dist, coalesce(mrate, 0) AS rate, same_pair, CASE WHEN same_pair THEN (dist - pdist) * 30 END AS dist_rate, CASE WHEN same_pair THEN (mrate - prate) * 30 END AS rate_rate FROM same)"""


def _series(spark, sf):
    return framefeat.closest_series(A.pairs(spark, sf), A.videos(spark, sf))


@query(f"WITH {SERIES} SELECT video_id, frame, {r('dist')} AS dist, {r('rate')} AS rate, same_pair, {r('dist_rate', 3)} AS dist_rate, {r('rate_rate', 3)} AS rate_rate FROM series")
def same_pair_rates(spark, sf):
    return _series(spark, sf).select(*KEYS, R("dist", alias="dist"), R("rate", alias="rate"), "same_pair", R("dist_rate", 3, "dist_rate"), R("rate_rate", 3, "rate_rate"))


@query(f"""WITH {SERIES}, o AS (SELECT video_id, frame, unnest(range(-60, 61, 4)) AS o FROM series)
SELECT o.video_id, o.frame, CAST(count(s.dist) AS BIGINT) AS known, {r('sum(s.dist)', 3)} AS total, {r("sum(s.dist * (o.o + 61))", 2)} AS weighted FROM o LEFT JOIN series s ON s.video_id = o.video_id AND s.frame = o.frame + o.o GROUP BY o.video_id, o.frame""")
def window_offsets(spark, sf):
    found = frames.offsets(_series(spark, sf), ["video_id"], "frame", ["dist"], 60, 4)
    known = F.filter("dist_window", lambda v: v.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b))
    terms = F.filter(F.transform("dist_window", lambda v, k: v * (k * 4 + 1)), lambda v: v.isNotNull())
    weighted = F.when(F.size(known) > 0, F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
    return found.select(*KEYS, F.size(known).cast("long").alias("known"), R(total, 3, "total"), R(weighted, 2, "weighted"))


@query(f"WITH {A.PAIRS} SELECT video_id, frame, t1, t2, {r('dist')} AS dist FROM pairs WHERE frame BETWEEN 100 AND 140 AND video_id = 'v0'")
def scoped_chunk(spark, sf):
    held = A.pairs(spark, sf).where("video_id = 'v0'")
    return frames.range_with_halo(held, "frame", 100, 140, 0, 0).select(*KEYS, "t1", "t2", R("dist", alias="dist"))


CROSS = """, poses AS (SELECT a.*, a.x AS hx1, a.y AS hy1 FROM tracks a),
c0 AS (SELECT *, x_2 - x_1 AS ux, y_2 - y_1 AS uy, (x_2 + 50) - (x_1 - 50) AS vx, (y_2 - 80) - (y_1 + 80) AS vy, (x_1 - 50) - x_1 AS wx, (y_1 + 80) - y_1 AS wy FROM pairs),
c1 AS (SELECT *, ux * vy - uy * vx AS area, sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy) AS scale FROM c0),
c2 AS (SELECT *, CASE WHEN scale > 0 AND abs(area) > 1e-9 * scale THEN area END AS s FROM c1),
c3 AS (SELECT *, (wx * vy - wy * vx) / s AS p, (wx * uy - wy * ux) / s AS q FROM c2),
crossing AS (SELECT video_id, frame, t1, t2, CASE WHEN p BETWEEN -1e-9 AND 1 + 1e-9 AND q BETWEEN -1e-9 AND 1 + 1e-9 THEN x_1 + least(1, greatest(0, p)) * ux END AS cx, CASE WHEN p BETWEEN -1e-9 AND 1 + 1e-9 AND q BETWEEN -1e-9 AND 1 + 1e-9 THEN y_1 + least(1, greatest(0, p)) * uy END AS cy FROM c3)"""


@query(f"WITH {A.PAIRS}{CROSS} SELECT video_id, frame, t1, t2, {r('cx', 3)} AS cx, {r('cy', 3)} AS cy FROM crossing")
def segment_intersection(spark, sf):
    c = F.col
    cx, cy = X.segment_crossing((c("x_1"), c("y_1")), (c("x_2"), c("y_2")), (c("x_1") - 50, c("y_1") + 80), (c("x_2") + 50, c("y_2") - 80))
    return A.pairs(spark, sf).select(*KEYS, "t1", "t2", R(cx, 3, "cx"), R(cy, 3, "cy"))


@query(f"""WITH {A.TRACKS}, m AS (SELECT *, frame - lag(frame) OVER w = 1 AS nxt, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d,
  heading - lag(heading) OVER w AS dh FROM tracks WINDOW w AS (PARTITION BY video_id, track ORDER BY frame))
SELECT video_id, frame, track, {r('CASE WHEN nxt THEN d END')} AS moved, {r('CASE WHEN nxt THEN abs(atan2(sin(dh), cos(dh))) END')} AS turn FROM m""")
def displacement(spark, sf):
    t = A.tracks(spark, sf).withColumnsRenamed({"x": "p_x", "y": "p_y"})
    out = framefeat.turned(framefeat.displacement(t, ["video_id", "track"], ["p"]), ["video_id", "track"], "heading")
    return out.select(*KEYS, "track", R("p_moved", alias="moved"), R("turn", alias="turn"))


AGGS = A.TRACKS + ", " + A.SPINE + ", agg AS (SELECT video_id, frame, CAST(count(*) AS DOUBLE) AS track_count, avg(speed) AS speed_mean, max(speed) AS speed_max FROM tracks GROUP BY 1, 2), d AS (SELECT s.video_id, s.frame, coalesce(track_count, 0) AS track_count, speed_mean, speed_max FROM spine s LEFT JOIN agg a ON s.video_id = a.video_id AND s.frame = a.frame)"


def _track_aggs(spark, sf):
    agg = A.tracks(spark, sf).groupBy(*KEYS).agg(F.count("*").cast("double").alias("track_count"), F.avg("speed").alias("speed_mean"), F.max("speed").alias("speed_max"))
    return frames.dense(frames.spine(A.videos(spark, sf)), agg, KEYS).fillna(0.0, ["track_count"])


@query(f"WITH {AGGS} SELECT video_id, frame, track_count, {r('speed_mean')} AS speed_mean, speed_max FROM d")
def frame_track_aggs(spark, sf):
    return _track_aggs(spark, sf).select(*KEYS, "track_count", R("speed_mean", alias="speed_mean"), "speed_max")


@query(f"WITH {AGGS} SELECT video_id, frame, {r('avg(track_count) OVER w', 7)} AS track_count_trailing30, {r('avg(speed_mean) OVER w', 7)} AS speed_mean_trailing30 FROM d WINDOW w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def trailing30_mean(spark, sf):
    out = framefeat.trailing_mean(_track_aggs(spark, sf), ["video_id"], ["track_count", "speed_mean"])
    return out.select(*KEYS, R("track_count_trailing30", 7, "track_count_trailing30"), R("speed_mean_trailing30", 7, "speed_mean_trailing30"))


@query(f"""WITH {A.PAIRS} SELECT video_id, frame, CAST(count(*) AS BIGINT) AS pair_count, {r('avg(dist)')} AS dist_mean, {r('min(dist)')} AS dist_min, {r('max(dist)')} AS dist_max, {r('avg(sin(orbital))')} AS orbital_sin_mean, {r('max(cos(orbital))')} AS orbital_cos_max FROM pairs GROUP BY 1, 2""")
def frame_pair_aggs(spark, sf):
    out = framefeat.pair_features(A.pairs(spark, sf), KEYS, ["dist"], ["orbital"])
    return out.select(*KEYS, "pair_count", *[R(c, alias=c) for c in ("dist_mean", "dist_min", "dist_max", "orbital_sin_mean", "orbital_cos_max")])


@query(f"""WITH {CLOSEST}, a AS (SELECT video_id, frame, CAST(count(*) AS BIGINT) AS n_pairs, min(dist) AS dmin, avg(rate) AS rmean FROM pairs GROUP BY 1, 2)
SELECT b.video_id, b.frame, t1, t2, n_pairs, {r('dmin')} AS all_dist_min, {r('rmean')} AS all_rate_mean, {r('bearing_1')} AS bearing_1 FROM best b JOIN a ON a.video_id = b.video_id AND a.frame = b.frame""")
def all_pair_aggs(spark, sf):
    out = framefeat.model_frames(A.pairs(spark, sf), KEYS, "dist", ["bearing_1"], {"dist": ["min"], "rate": ["mean"]})
    return out.select(*KEYS, "t1", "t2", "n_pairs", R("all_dist_min", alias="all_dist_min"), R("all_rate_mean", alias="all_rate_mean"), R("bearing_1", alias="bearing_1"))


# -- cleaning ---------------------------------------------------------------------------------------------------

_EDGES = list(zip(A.FLOOR, A.FLOOR[1:] + A.FLOOR[:1], strict=True))
_INSIDE = "(" + " + ".join(f"CASE WHEN y >= {min(a[1], b[1])} AND y < {max(a[1], b[1])} AND x < {a[0]}::DOUBLE + (y - {a[1]}::DOUBLE) * {(b[0] - a[0]) / (b[1] - a[1])!r}::DOUBLE THEN 1 ELSE 0 END" for a, b in _EDGES) + ") % 2 = 1"
FLAGS = A.PAIRS + f""", med AS (SELECT video_id, quantile_cont(body, 0.5) AS m FROM tracks GROUP BY 1),
ft AS (SELECT t.*, coalesce(NOT ({_INSIDE}), false) AS reflection, coalesce(sqrt((bend * 300) * (bend * 300)) > m, false) AS jump FROM tracks t JOIN med USING (video_id)),
fp AS (SELECT p.video_id, p.frame, p.t1, p.t2, p.dist, a.reflection OR b.reflection AS reflection, a.jump OR b.jump AS jump, coalesce(p.dist < 40, false) AS duplicate FROM pairs p
  JOIN ft a ON a.video_id = p.video_id AND a.frame = p.frame AND a.track = p.t1 JOIN ft b ON b.video_id = p.video_id AND b.frame = p.frame AND b.track = p.t2),
flagged AS (SELECT *, NOT (reflection OR jump OR duplicate) AS keep FROM fp)"""


def _flagged(spark, sf):
    t = A.tracks(spark, sf).withColumns({"mx": F.col("x") + F.col("bend") * 300, "my": F.col("y")})
    told = clean.flag_tracks(t, ["video_id"], A.FLOOR, ("x", "y"), ("mx", "my"), "body")
    return told, clean.flag_pairs(A.pairs(spark, sf), told, KEYS)


@query(f"WITH {FLAGS} SELECT video_id, frame, t1, t2, reflection, jump, duplicate, keep FROM flagged")
def artifact_flags(spark, sf):
    return _flagged(spark, sf)[1].select(*KEYS, "t1", "t2", "reflection", "jump", "duplicate", "keep")


@query(f"WITH {FLAGS} SELECT video_id, frame, track, reflection, jump FROM ft")
def polygon_flag(spark, sf):
    return _flagged(spark, sf)[0].select(*KEYS, "track", "reflection", "jump")


@query(f"WITH {FLAGS} SELECT video_id, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"{r(f'avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END)')} AS {c}_rate" for c in ("reflection", "jump", "duplicate", "keep")) + " FROM flagged GROUP BY 1")
def flag_rates(spark, sf):
    out = clean.flag_rates(_flagged(spark, sf)[1], ["video_id"])
    return out.select("video_id", "n", *[R(c, alias=c) for c in out.columns[2:]])


@query(f"WITH {FLAGS} SELECT video_id, frame, t1, t2 FROM flagged WHERE keep")
def closest_pair_keep(spark, sf):
    return clean.valid_keys(_flagged(spark, sf)[1], KEYS)


@query(f"WITH {A.TRACKS} SELECT video_id, frame, track, CAST(count(*) AS BIGINT) AS n FROM (SELECT video_id, frame // 2 AS frame, track FROM tracks) GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dup_key_check(spark, sf):
    from framewise.sources.contracts import repeated_keys

    t = A.tracks(spark, sf).withColumn("frame", F.floor(F.col("frame") / 2))
    return repeated_keys(t, ["video_id", "frame", "track"])


# -- pair motion ------------------------------------------------------------------------------------------------

GROUPS = "project_id, day_label, TrackUID_1, TrackUID_2, pair_episode_id"
PK = ["day_label", "FrameNum", "TrackUID_1", "TrackUID_2"]
pk = ", ".join(PK)
F0 = A.MOTION + f""", f0 AS (SELECT *, centroid_distance_px / ((body_length_px_1 + body_length_px_2) / 2) AS dbl, (speed_bl_s_1 + speed_bl_s_2) / 2 AS speed_mean, speed_bl_s_1 - speed_bl_s_2 AS speed_diff,
  abs({A.sql_wrap('bearing_1_rad')}) < pi() / 4 AS facing_1, abs({A.sql_wrap('bearing_2_rad')}) < pi() / 4 AS facing_2 FROM motion),
f1 AS (SELECT *, dbl <= 1.5 AS proximity, facing_1 AND facing_2 AS mutual, CASE WHEN dt_frames > 0 THEN (dbl - lag(dbl) OVER w) / (dt_frames / 30) END AS approach,
  CAST(sum(CASE WHEN dt_frames / 30 > 0.2::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY {GROUPS} ORDER BY FrameNum ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM f0 WINDOW w AS (PARTITION BY {GROUPS} ORDER BY FrameNum)),
f2 AS (SELECT *, CASE WHEN dt_frames > 0 THEN {A.sql_wrap('orbital_rad - lag(orbital_rad) OVER w')} END AS step0 FROM f1 WINDOW w AS (PARTITION BY {GROUPS}, seg ORDER BY FrameNum)),
f3 AS (SELECT *, CASE WHEN abs(step0 / (dt_frames / 30)) <= 15 THEN step0 END AS step, CASE WHEN abs(step0 / (dt_frames / 30)) <= 15 THEN step0 / (dt_frames / 30) END AS orate FROM f2),
f4a AS (SELECT *, CASE WHEN abs(d_heading_1_rad_s) <= 15 THEN d_heading_1_rad_s END AS h1, CASE WHEN abs(d_heading_2_rad_s) <= 15 THEN d_heading_2_rad_s END AS h2, CASE WHEN abs(d_orbital_rad_s) <= 15 THEN d_orbital_rad_s END AS dor,
  coalesce(abs(d_heading_1_rad_s) > 15, false) OR coalesce(abs(d_heading_2_rad_s) > 15, false) OR coalesce(abs(d_orbital_rad_s) > 15, false) AS clipped FROM f3),
f4 AS (SELECT *, CASE WHEN step0 IS NOT NULL THEN (dor - lag(dor) OVER w) / (dt_frames / 30) END AS oaccel FROM f4a WINDOW w AS (PARTITION BY {GROUPS}, seg ORDER BY FrameNum)),
f5 AS (SELECT *, list_avg(list_filter([sign(h1) * sign(dor), sign(h2) * sign(dor)], lambda v: v IS NOT NULL)) AS corot, list_avg(list_filter([abs(h1), abs(h2)], lambda v: v IS NOT NULL)) AS habs, (abs(bend_angle_rad_1) + abs(bend_angle_rad_2)) / 2 AS bend FROM f4)"""


def _features(spark, sf):
    m = pairfeat.add_distances(A.motion(spark, sf))
    m = pairfeat.add_segments(pairfeat.add_approach(pairfeat.add_orientation(m)))
    return pairfeat.add_angular(pairfeat.add_orbital(pairfeat.add_clean_rates(m)))


@query(f"WITH {F0} SELECT {pk}, {r('dbl')} AS dbl, {r('speed_mean')} AS speed_mean, {r('speed_diff')} AS speed_diff, proximity, mutual FROM f1")
def bl_distance(spark, sf):
    return _features(spark, sf).select(*PK, R("centroid_distance_bl", alias="dbl"), R("speed_mean_bl_s", alias="speed_mean"), R("speed_diff_bl_s", alias="speed_diff"), "proximity", F.col("mutual_facing").alias("mutual"))


@query(f"WITH {F0} SELECT {pk}, {r('approach', 3)} AS approach, {r('-approach', 3)} AS closing FROM f1")
def approach_rate(spark, sf):
    return _features(spark, sf).select(*PK, R("approach_rate_bl_s", 3, "approach"), R("closing_speed_bl_s", 3, "closing"))


@query(f"WITH {F0} SELECT {pk}, seg FROM f1")
def smooth_segments(spark, sf):
    return _features(spark, sf).select(*PK, F.col("smooth_segment").alias("seg"))


@query(f"WITH {F0} SELECT {pk}, {r('step', 3)} AS step, {r('orate', 3)} AS orate, {r('oaccel', 2)} AS oaccel FROM f4")
def orbital_steps(spark, sf):
    return _features(spark, sf).select(*PK, R("orbital_step_rad", 3, "step"), R("orbital_rate_derived_rad_s", 3, "orate"), R("orbital_accel_rad_s2", 2, "oaccel"))


@query(f"WITH {F0} SELECT {pk}, clipped, {r('corot')} AS corot, {r('habs')} AS habs, {r('bend')} AS bend, {r('sin(rel_heading_rad)')} AS rel_sin, {r('cos(bearing_1_rad)')} AS b1_cos FROM f5")
def corotation(spark, sf):
    return _features(spark, sf).select(*PK, F.col("qc_angular_rate_clipped").alias("clipped"), R("corotation", alias="corot"), R("heading_rate_abs_mean_rad_s", alias="habs"), R("bend_abs_mean_rad", alias="bend"), R("rel_heading_sin", alias="rel_sin"), R("bearing_1_cos", alias="b1_cos"))


def _window_sql(seconds: float, trailing: bool = False) -> str:
    before, after, span = pairfeat.window_bounds(seconds, trailing)
    near = lambda x: f"CASE WHEN proximity THEN {x} END"
    return f"""WITH {F0} SELECT {pk}, {r(f'sum(CASE WHEN proximity THEN 1 ELSE 0 END) OVER w / {span}')} AS close_frac, {r(f'sum(CASE WHEN mutual THEN 1 ELSE 0 END) OVER w / {span}')} AS mutual_facing_frac, {r(f'least(count(*) OVER w / {span}, 1)')} AS coverage,
{r('avg(dbl) OVER w')} AS distance_bl_mean, {r('avg(speed_mean) OVER w')} AS speed_mean_bl_s_mean, {r('avg(-approach) OVER w', 3)} AS closing_speed_bl_s_mean, {r('avg(bend) OVER w')} AS bend_abs_mean, {r(f"avg({near('abs(dor)')}) OVER w", 3)} AS abs_d_orbital_mean,
{r(f"avg({near('corot')}) OVER w")} AS corotation_mean, {r(f"CASE WHEN count({near('dor')}) OVER w > 1 THEN stddev_pop({near('dor')}) OVER w END", 3)} AS d_orbital_std, {r(f"sum({near('step')}) OVER w / (2 * pi())")} AS orbit_turns_net, {r(f"sum(abs({near('step')})) OVER w / (2 * pi())")} AS orbit_turns_abs
FROM f5 WINDOW w AS (PARTITION BY {GROUPS}, seg ORDER BY FrameNum RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING)"""


_DIGITS = {"closing_speed_bl_s_mean": 3, "abs_d_orbital_mean": 3, "d_orbital_std": 3}


def _windowed(seconds: float, trailing: bool = False):
    def run(spark, sf):
        out = pairfeat.add_windows(_features(spark, sf), seconds=[seconds], trailing=trailing)
        return out.select(*PK, *[R(f"{pairfeat.window_label(seconds)}_{s}", _DIGITS.get(s, 4), s) for s in pairfeat.STATS])

    run.__name__ = f"window_{'trailing' if trailing else 'stats'}_{pairfeat.window_label(seconds)[1:]}"
    return run


for _seconds, _trailing in ((0.5, False), (1.0, False), (2.0, False), (4.0, False), (4.0, True)):
    query(_window_sql(_seconds, _trailing))(_windowed(_seconds, _trailing))


@query(f"""WITH {F0}, m AS (SELECT *, quantile_cont(dbl, 0.5) OVER w AS md, quantile_cont(speed_mean, 0.5) OVER w AS ms FROM f5 WINDOW w AS (PARTITION BY {GROUPS}, seg ORDER BY FrameNum ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))
SELECT {pk}, {r('avg(md) OVER w')} AS dist_smooth, {r('avg(ms) OVER w')} AS speed_smooth FROM m WINDOW w AS (PARTITION BY {GROUPS}, seg ORDER BY FrameNum ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")
def rolling_median_mean(spark, sf):
    out = pairfeat.add_smoothed(_features(spark, sf), ["centroid_distance_bl", "speed_mean_bl_s"])
    return out.select(*PK, R("centroid_distance_bl_smooth", alias="dist_smooth"), R("speed_mean_bl_s_smooth", alias="speed_smooth"))


@query(f"""WITH {F0}, a AS (SELECT *, CASE WHEN qc_n_missing_kp_1 < 3 THEN bearing_1_rad END AS v FROM f5), b AS (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {GROUPS}, seg ORDER BY FrameNum ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, v - lag(v) OVER (PARTITION BY {GROUPS}, seg, run ORDER BY FrameNum) AS d FROM b), e AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN abs(d) >= pi() THEN (CASE WHEN {A.sql_wrap('d')} = -pi() AND d > 0 THEN pi() ELSE {A.sql_wrap('d')} END) - d ELSE 0 END AS fix FROM c)
SELECT {pk}, {r('v + sum(fix) OVER (PARTITION BY ' + GROUPS + ', seg, run ORDER BY FrameNum ROWS UNBOUNDED PRECEDING)', 3)} AS unwrapped FROM e""")
def circular_unwrap(spark, sf):
    held = _features(spark, sf).withColumn("bearing", F.when(F.col("qc_n_missing_kp_1") < 3, F.col("bearing_1_rad")))
    return pairfeat.unwrap(held, "bearing", "unwrapped").select(*PK, R("unwrapped", 3, "unwrapped"))


MED = """, ml AS (SELECT day_label, quantile_cont(l, 0.5) AS m FROM (SELECT day_label, unnest([body_length_px_1, body_length_px_2]) AS l FROM motion) WHERE l > 0 GROUP BY 1)"""


@query(f"WITH {A.MOTION}{MED} SELECT {', '.join('motion.' + c for c in PK)}, " + " OR ".join(f"(body_length_px_{k} < 0.5 * m OR body_length_px_{k} > 2 * m)" for k in (1, 2)) + " AS bad FROM motion JOIN ml USING (day_label)")
def body_length_flag(spark, sf):
    return pairfeat.flag_lengths(A.motion(spark, sf)).select(*PK, F.col("qc_bad_body_length").alias("bad"))


@query(f"""WITH {A.PAIRS}, j AS (SELECT p.video_id, (a.track IS NULL) AS u1, (b.track IS NULL) AS u2 FROM pairs p LEFT JOIN (SELECT * FROM tracks WHERE missing < 3) a ON a.video_id = p.video_id AND a.frame = p.frame AND a.track = p.t1
  LEFT JOIN (SELECT * FROM tracks WHERE missing < 3) b ON b.video_id = p.video_id AND b.frame = p.frame AND b.track = p.t2)
SELECT video_id AS day_label, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (u1) AS BIGINT) AS unmatched_1, CAST(count(*) FILTER (u2) AS BIGINT) AS unmatched_2, {r('count(*) FILTER (u1) / count(*)')} AS unmatched_1_frac FROM j GROUP BY 1""")
def unmatched_stats(spark, sf):
    t = A.tracks(spark, sf).where("missing < 3").select(F.lit("p").alias("project_id"), F.col("video_id").alias("day_label"), F.col("frame").alias("FrameNum"), F.col("track").alias("TrackUID"), "speed")
    held = A.motion(spark, sf).select("project_id", "day_label", "FrameNum", "TrackUID_1", "TrackUID_2")
    out = pairfeat.unmatched(pairfeat.join_tracks(held, t, ["speed"]), ["day_label"])
    return out.select("day_label", "n", "unmatched_1", "unmatched_2", R("unmatched_1_frac", alias="unmatched_1_frac"))


# -- rules and spans --------------------------------------------------------------------------------------------

SIGNALS = SERIES + """, st AS (SELECT *, CASE WHEN coalesce(dist < 1500, false) THEN 1.0::DOUBLE ELSE 0 END AS close, rate * CASE WHEN coalesce(dist < 1500, false) THEN 1.0::DOUBLE ELSE 0 END / 30 AS step FROM series),
sg AS (SELECT *, CASE WHEN count(*) OVER w >= 60 THEN abs(sum(step) OVER w) / (2 * pi()) END AS turns, CASE WHEN count(*) OVER w >= 60 THEN avg(close) OVER w END AS close_share, CASE WHEN count(*) OVER w >= 60 THEN sum(step) OVER w END AS local
  FROM st WINDOW w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 60 PRECEDING AND 59 FOLLOWING)),
signals AS (SELECT *, coalesce(close_share >= 0.5, false) AS mostly_close FROM sg)"""


def _signals(spark, sf):
    return detect.rule_signals(_series(spark, sf), ["video_id"], dist_max=1500.0, share=0.5)


@query(f"WITH {SIGNALS} SELECT video_id, frame, {r('turns')} AS turns, mostly_close FROM signals")
def rule_signals(spark, sf):
    return _signals(spark, sf).select(*KEYS, R("turns", alias="turns"), "mostly_close")


def _islands_sql(source: str, condition: str, gap: int, keys: str = "video_id", more: str = "") -> str:
    return f"""SELECT {keys}, min(frame) AS "start", max(frame) AS "end"{more} FROM (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY {keys} ORDER BY frame) <= {gap} THEN 0 ELSE 1 END AS new FROM {source} WHERE {condition})) GROUP BY {keys}, run"""


def _join_sql(source: str, touch: int, keys: str = "video_id", more: str = "") -> str:
    return f"""SELECT {keys}, min("start") AS "start", max("end") AS "end"{more} FROM (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY {keys} ORDER BY "start") <= {touch} THEN 0 ELSE 1 END AS new FROM {source})) GROUP BY {keys}, run"""


HYST = SIGNALS + f""", weak AS ({_islands_sql('signals', 'mostly_close AND turns >= 0.01', 1, more=', max(CASE WHEN turns >= 0.03 THEN 1 ELSE 0 END) AS strong')}),
wk AS (SELECT * FROM weak WHERE strong = 1), pieces AS ({_join_sql('wk', 30)}), kept AS (SELECT * FROM pieces WHERE "end" - "start" >= 5), found AS ({_join_sql('kept', 90)})"""


@query(f"WITH {HYST} SELECT * FROM found")
def hysteresis_spans(spark, sf):
    return spans.hysteresis(_signals(spark, sf), ["video_id"], min_turns=0.03, keep_turns=0.01, min_frames=5)


@query(f"""WITH {SIGNALS}, p AS ({_islands_sql('signals', 'mostly_close AND turns >= 0.03', 30)}) SELECT * FROM p WHERE "end" - "start" >= 5""")
def original_spans(spark, sf):
    return spans.hysteresis(_signals(spark, sf), ["video_id"], min_turns=0.03, keep_turns=None, merge_frames=0, min_frames=5)


@query(f"WITH {SERIES} {_islands_sql('series', 'dist < 2000', 1)}")
def positive_runs(spark, sf):
    return spans.positive_runs(_series(spark, sf), ["video_id"], F.col("dist") < 2000)


@query(f"""WITH {SERIES}, v AS (SELECT video_id, frame, avg(CASE WHEN dist < 2500 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS vote FROM series),
s AS ({_islands_sql('v', 'vote >= 0.5', 1)}) SELECT * FROM s WHERE "end" - "start" + 1 >= 3""")
def majority_vote_spans(spark, sf):
    scored = _series(spark, sf).withColumn("score", F.when(F.col("dist") < 2500, 1.0).otherwise(0.0))
    return spans.scores_to_spans(scored, ["video_id"], min_length=3)


SIX = A.MOTION + f""", tl AS (SELECT video_id AS day_label, track, quantile_cont(body, 0.5) AS m FROM tracks GROUP BY 1, 2),
x0 AS (SELECT motion.*, centroid_distance_px / ((a.m + b.m) / 2) AS dbl, cos(rel_heading_rad) AS crh, coalesce(sign(d_heading_1_rad_s) <> 0 AND sign(d_heading_1_rad_s) = sign(d_heading_2_rad_s) AND sign(d_heading_1_rad_s) = sign(d_orbital_rad_s), false) AS corot
  FROM motion JOIN tl a ON a.day_label = motion.day_label AND a.track = TrackUID_1 JOIN tl b ON b.day_label = motion.day_label AND b.track = TrackUID_2),
x1 AS (SELECT *, coalesce(qc_n_missing_kp_1 <= 2 AND qc_n_missing_kp_2 <= 2, false) AS c_qc, pair_sex = 'FM' AS c_fm, dbl < 20 AS c_close, crh < -0.2 AS c_anti, coalesce(abs(d_orbital_rad_s) >= 0.5, false) AS c_fast FROM x0),
six AS (SELECT *, c_qc AND c_fm AND c_close AND c_anti AND c_fast AND corot AS rule_hit, CASE WHEN c_fm AND corot AND c_qc THEN greatest(0, least(1, 1 - dbl / 20)) * greatest(0, least(1, -crh)) * greatest(0, least(1, coalesce(abs(d_orbital_rad_s) / 0.5, 0))) ELSE 0 END AS rule_score,
  CASE WHEN NOT c_qc THEN 'qc' WHEN NOT c_fm THEN 'fm' WHEN NOT c_close THEN 'close' WHEN NOT c_anti THEN 'anti' WHEN NOT c_fast THEN 'fast' WHEN NOT corot THEN 'corot' ELSE 'hit' END AS fail_reason FROM x1)"""


def _six(spark, sf):
    t = A.tracks(spark, sf).select(F.lit("p").alias("project_id"), F.col("video_id").alias("day_label"), F.col("track").alias("TrackUID"), F.col("body").alias("body_length_px"))
    return detect.six_conditions(detect.median_scale(A.motion(spark, sf), t, ["project_id", "day_label"]), d_max=20.0)


@query(f"WITH {SIX} SELECT {pk}, rule_hit, {r('rule_score')} AS rule_score, fail_reason FROM six")
def six_condition_rule(spark, sf):
    return _six(spark, sf).select(*PK, "rule_hit", R("rule_score", alias="rule_score"), "fail_reason")


@query(f"WITH {SIX} SELECT fail_reason, CAST(count(*) AS BIGINT) AS n FROM six GROUP BY 1")
def fail_reason(spark, sf):
    return scoring.value_counts(_six(spark, sf), "fail_reason")


_EK = "day_label, TrackUID_1, TrackUID_2, pair_episode_id"
_S = ', count(*) AS n, sum(rule_score) AS s, max(rule_score) AS mx'
EPISODES = SIX + f""", h AS (SELECT *, FrameNum AS frame FROM six WHERE c_close AND c_qc), runs AS ({_islands_sql('h', 'true', 30, _EK, _S)}), kp AS (SELECT * FROM runs WHERE "end" - "start" + 1 >= 60),
ev AS ({_join_sql('kp', 60, _EK, ', CAST(sum(n) AS BIGINT) AS n_hit, sum(s) AS s, max(mx) AS mx')})"""


@query(f'WITH {EPISODES} SELECT {_EK}, "start", "end", n_hit, {r("s / n_hit")} AS mean_score, {r("mx")} AS max_score FROM ev')
def episode_events(spark, sf):
    hits = _six(spark, sf).where("cond_close and cond_qc")
    out = spans.episode_events(hits, ["day_label", "TrackUID_1", "TrackUID_2", "pair_episode_id"], "FrameNum")
    return out.select("day_label", "TrackUID_1", "TrackUID_2", "pair_episode_id", "start", "end", "n_hit", R("mean_score", alias="mean_score"), R("max_score", alias="max_score"))


LABELS = SIGNALS + """, vi AS (SELECT video_id, i * 45 AS row_id, i * 45 AS "start", i * 45 + 10 + (i * 7) % 60 AS "end" FROM videos, range(0, 16) t(i)),
inn AS (SELECT vi.video_id, row_id, sg.frame, step, coalesce(local, 0) >= 0 AS cw FROM vi JOIN signals sg ON sg.video_id = vi.video_id AND sg.frame BETWEEN "start" AND "end"),
chg AS (SELECT *, CASE WHEN cw <> lag(cw) OVER (PARTITION BY video_id, row_id ORDER BY frame) THEN 1 ELSE 0 END AS c FROM inn),
rn AS (SELECT *, sum(c) OVER (PARTITION BY video_id, row_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM chg),
br AS (SELECT video_id, row_id, run, abs(sum(step)) AS t, sum(CASE WHEN cw THEN 1 ELSE 0 END) AS cws, count(*) AS n FROM rn GROUP BY 1, 2, 3),
lab AS (SELECT video_id, row_id, CASE WHEN sum(cws) * 2 >= sum(n) THEN 'CW' ELSE 'CCW' END AS direction, sum(t) / (2 * pi()) AS cycles FROM br GROUP BY 1, 2)"""


@query(f"WITH {LABELS} SELECT vi.video_id, vi.row_id, direction, {r('coalesce(cycles, 0)')} AS cycles FROM vi LEFT JOIN lab USING (video_id, row_id)")
def interval_labels(spark, sf):
    held = A.videos(spark, sf).crossJoin(spark.range(16)).select("video_id", (F.col("id") * 45).alias("row_id"), (F.col("id") * 45).alias("start"), (F.col("id") * 45 + 10 + F.col("id") * 7 % 60).alias("end"))
    steps = spans.rotation_steps(_series(spark, sf), ["video_id"], dist_max=1500.0)
    return spans.rotation_labels(held, steps, "video_id").select("video_id", "row_id", "direction", R("cycles", alias="cycles"))


@query(f"""WITH {FLAGS}, n AS (SELECT video_id, t1, t2, CAST(count(*) FILTER (nth = 1) AS BIGINT) AS closest_frames, CAST(count(*) AS BIGINT) AS frames, quantile_cont(dist, 0.5) AS md FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY dist, t1, t2) AS nth FROM pairs) GROUP BY 1, 2, 3)
SELECT video_id, t1, t2, closest_frames, frames, {r('md')} AS median_distance FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY closest_frames DESC, frames DESC, md, t1, t2) AS k FROM n) WHERE k = 1""")
def top_pair_selection(spark, sf):
    out = detect.top_pair(A.pairs(spark, sf), KEYS)
    return out.select("video_id", "t1", "t2", "closest_frames", "frames", R("median_distance", alias="median_distance"))


# -- interval algebra -------------------------------------------------------------------------------------------


@query(f'WITH {A.SPANS} SELECT video_id, "start", "end" FROM gt_m')
def span_union_merge(spark, sf):
    return spans.merge_spans(A.gt(spark, sf), ["video_id"])


def _merged(spark, sf):
    return spans.merge_spans(A.gt(spark, sf), ["video_id"]), spans.merge_spans(A.pred(spark, sf), ["video_id"])


def _b(df):
    return df.select("video_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))


_OVER = 'least(g."end", p."end") - greatest(g."start", p."start") + 1'
_ON = 'g.video_id = p.video_id AND p."start" <= g."end" AND p."end" >= g."start"'


@query(f'WITH {A.SPANS} SELECT g.video_id, g."start", g."end", p."start" AS b_start, p."end" AS b_end, {_OVER} AS shared, {r(f"({_OVER}) / (g.end - g.start + p.end - p.start + 2 - ({_OVER}))", 6)} AS iou FROM gt_m g JOIN pred_m p ON {_ON}'.replace("g.end", 'g."end"').replace("g.start", 'g."start"').replace("p.end", 'p."end"').replace("p.start", 'p."start"'))
def overlap_join(spark, sf):
    g, p = _merged(spark, sf)
    c = [F.col(x) for x in ("start", "end", "b_start", "b_end")]
    return spans.overlapping(g, _b(p), "video_id").select("video_id", "start", "end", "b_start", "b_end", X.overlap(*c).alias("shared"), R(X.span_iou(*c), 6, "iou"))


@query(f'WITH {A.SPANS} SELECT g.video_id, g."start", g."end", CAST(count(*) AS BIGINT) AS pieces FROM gt_m g JOIN pred_m p ON g.video_id = p.video_id AND p."start" <= g."end" + 30 AND p."end" >= g."start" - 30 GROUP BY 1, 2, 3')
def overlap_tolerant(spark, sf):
    g, p = _merged(spark, sf)
    return spans.overlapping(g, _b(p), "video_id", 30).groupBy("video_id", "start", "end").agg(F.count("*").alias("pieces"))


@query(f'WITH {A.SPANS} SELECT video_id, row_id FROM gt g WHERE NOT EXISTS (SELECT 1 FROM pred_m p WHERE {_ON})')
def unmatched_events_anti(spark, sf):
    return evaluate.missed_events(A.gt(spark, sf), _merged(spark, sf)[1]).select("video_id", "row_id")


_INN = 'EXISTS (SELECT 1 FROM gt_m g WHERE g.video_id = s.video_id AND s.frame BETWEEN g."start" AND g."end")'


@query(f'WITH {A.SPANS}, s AS (SELECT video_id, unnest(range(0, num_frames)) AS frame FROM iv) SELECT video_id, frame, CASE WHEN {_INN} THEN 1 ELSE 0 END AS label FROM s')
def frame_labels(spark, sf):
    return spans.frame_labels(frames.spine(A.interval_videos(spark)), A.gt(spark, sf), ["video_id"]).select(*KEYS, "label")


@query(f"""WITH {A.SPANS}, w AS (SELECT video_id, greatest(0, "start" - ("end" - "start" + 2) // 2) AS a, least({A.INTERVAL_FRAMES - 1}, "end" + ("end" - "start" + 2) // 2) AS b FROM gt_m),
s AS (SELECT DISTINCT video_id, frame FROM (SELECT video_id, unnest(range(a, b + 1)) AS frame FROM w)) SELECT video_id, frame, CASE WHEN {_INN} THEN 1 ELSE 0 END AS label FROM s""")
def buffer_sample(spark, sf):
    return spans.buffer_sample(_merged(spark, sf)[0], A.interval_videos(spark)).select(*KEYS, "label")


LSPAN = A.SPANS + ', ' + ', '.join(f"""{n}_v AS (SELECT m.video_id, m."start", m."end", e.direction, e.cycles, e.row_id, e."end" - e."start" + 1 AS len, least(m."end", e."end") - greatest(m."start", e."start") + 1 AS sh FROM {n}_m m JOIN {n} e ON e.video_id = m.video_id AND e."start" <= m."end" AND e."end" >= m."start"),
{n}_l AS (SELECT m.video_id, m."start", m."end", d.direction, c.cycles FROM {n}_m m
  LEFT JOIN (SELECT video_id, "start", "end", direction FROM (SELECT *, row_number() OVER (PARTITION BY video_id, "start", "end" ORDER BY n DESC, f) AS k FROM (SELECT video_id, "start", "end", direction, sum(sh) AS n, min(row_id) AS f FROM {n}_v WHERE direction IS NOT NULL GROUP BY 1, 2, 3, 4)) WHERE k = 1) d USING (video_id, "start", "end")
  LEFT JOIN (SELECT video_id, "start", "end", sum(cycles * sh / len) AS cycles FROM {n}_v GROUP BY 1, 2, 3) c USING (video_id, "start", "end"))""" for n in ("gt", "pred"))


@query(f'WITH {LSPAN} SELECT video_id, "start", "end", direction, {r("cycles", 6)} AS cycles FROM pred_l')
def label_spans_prorated(spark, sf):
    return evaluate.labelled(A.pred(spark, sf), A.pred(spark, sf)).select("video_id", "start", "end", "direction", R("cycles", 6, "cycles"))


@query(f'WITH {A.SPANS} SELECT g.video_id, g."start", g."end", CAST(count(DISTINCT e.direction) AS BIGINT) AS directions FROM gt_m g JOIN gt e ON e.video_id = g.video_id AND e."start" <= g."end" AND e."end" >= g."start" GROUP BY 1, 2, 3 HAVING count(DISTINCT e.direction) > 1')
def mixed_direction_spans(spark, sf):
    return evaluate.mixed_directions(_merged(spark, sf)[0], A.gt(spark, sf))


_STATUS = "CASE WHEN row_id % 3 = 0 THEN 'circling' WHEN row_id % 3 = 1 THEN 'non-circling' ELSE 'unknown' END"
STATUS = A.SPANS + f""", s AS (SELECT video_id, unnest(range(0, num_frames)) AS frame FROM iv), si AS (SELECT video_id, frame, min(st) AS a, max(st) AS b FROM (SELECT video_id, {_STATUS} AS st, unnest(range("start", "end" + 1)) AS frame FROM gt) GROUP BY 1, 2),
status AS (SELECT s.video_id, s.frame, CASE WHEN a = b AND a <> 'unknown' THEN a ELSE 'UNKNOWN' END AS status FROM s LEFT JOIN si ON si.video_id = s.video_id AND si.frame = s.frame)"""


def _status(spark, sf):
    held = A.gt(spark, sf).withColumn("status", F.expr(_STATUS))
    return spans.status_at(frames.spine(A.interval_videos(spark)), held, ["video_id"])


@query(f"WITH {STATUS} SELECT * FROM status")
def status_at_frame(spark, sf):
    return _status(spark, sf).select(*KEYS, "status")


@query(f"WITH {STATUS} {_islands_sql('status', 'true', 1, 'video_id, status')}")
def rle_status(spark, sf):
    return spans.run_lengths(_status(spark, sf), ["video_id"], "status")


# -- evaluation -------------------------------------------------------------------------------------------------

EVAL = A.SPANS + f""", c AS (SELECT iv.video_id, num_frames, CAST(coalesce((SELECT sum("end" - "start" + 1) FROM gt_m g WHERE g.video_id = iv.video_id), 0) AS BIGINT) AS g, CAST(coalesce((SELECT sum("end" - "start" + 1) FROM pred_m p WHERE p.video_id = iv.video_id), 0) AS BIGINT) AS p,
  CAST((SELECT count(*) FROM gt_m g WHERE g.video_id = iv.video_id) AS BIGINT) AS gs, CAST((SELECT count(*) FROM pred_m p WHERE p.video_id = iv.video_id) AS BIGINT) AS ps, CAST(coalesce((SELECT sum({_OVER}) FROM gt_m g JOIN pred_m p ON {_ON} WHERE g.video_id = iv.video_id), 0) AS BIGINT) AS tp FROM iv)"""


def _rows(spark, sf):
    return evaluate.video_metrics(A.gt(spark, sf), A.pred(spark, sf), A.interval_videos(spark))


@query(f"WITH {EVAL} SELECT video_id, tp AS frame_tp, p - tp AS frame_fp, g - tp AS frame_fn, {r('tp / nullif(p, 0)')} AS frame_precision, {r('tp / nullif(g, 0)')} AS frame_recall, {r('CASE WHEN tp > 0 THEN 2 * tp / (p + g) ELSE 0 END')} AS frame_f1, {r('tp / nullif(g + p - tp, 0)')} AS frame_iou, gs AS gt_segments, ps AS pred_segments FROM c")
def frame_metrics(spark, sf):
    out = evaluate.frame_counts(*_merged(spark, sf), A.interval_videos(spark))
    return out.select("video_id", "frame_tp", "frame_fp", "frame_fn", *[R(c, alias=c) for c in ("frame_precision", "frame_recall", "frame_f1", "frame_iou")], "gt_segments", "pred_segments")


@query(f"WITH {EVAL} SELECT video_id, {r('(num_frames - g - p + 2 * tp) / num_frames')} AS mof FROM c")
def mof(spark, sf):
    return evaluate.frame_counts(*_merged(spark, sf), A.interval_videos(spark)).select("video_id", R("mof", alias="mof"))


def _text_sql(n: str) -> str:
    return f"""{n}_t AS (SELECT video_id, string_agg(CASE WHEN "start" > coalesce(pe + 1, 0) THEN '01' ELSE '1' END, '' ORDER BY "start") AS t, max("end") AS l FROM (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY "start") AS pe FROM {n}_m) GROUP BY 1),
{n}_s AS (SELECT iv.video_id, coalesce(t, '') || CASE WHEN coalesce(l + 1, 0) < num_frames THEN '0' ELSE '' END AS s FROM iv LEFT JOIN {n}_t USING (video_id))"""


EDIT = A.SPANS + ", " + _text_sql("gt") + ", " + _text_sql("pred")


@query(f"WITH {EDIT} SELECT a.video_id, {r('100 * (1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s), 1))')} AS edit_score FROM gt_s a JOIN pred_s b USING (video_id)")
def edit_score(spark, sf):
    return evaluate.edit_scores(*_merged(spark, sf), A.interval_videos(spark)).select("video_id", R("edit_score", alias="edit_score"))


def _match_sql(g: str, p: str, tau: int) -> str:
    o = _OVER
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, gs, ge ORDER BY "start", "end") AS claim FROM (
  SELECT p.video_id, p."start", p."end", g."start" AS gs, g."end" AS ge, ({o}) / (g."end" - g."start" + p."end" - p."start" + 2 - ({o})) AS iou,
    row_number() OVER (PARTITION BY p.video_id, p."start", p."end" ORDER BY ({o}) / (g."end" - g."start" + p."end" - p."start" + 2 - ({o})) DESC, g."start", g."end") AS best FROM {g} g JOIN {p} p ON {_ON})
  WHERE best = 1 AND 100 * iou >= {tau}) WHERE claim = 1)"""


F1S = EVAL + ", " + ", ".join(f"m{t} AS {_match_sql('gt_m', 'pred_m', t)}" for t in evaluate.TAUS) + ", f AS (SELECT c.*, " + ", ".join(f"CAST((SELECT count(*) FROM m{t} m WHERE m.video_id = c.video_id) AS BIGINT) AS tp_{t}" for t in evaluate.TAUS) + " FROM c)"


@query(f"WITH {F1S} SELECT video_id, " + ", ".join(f"tp_{t}, {r(f'CASE WHEN tp_{t} > 0 THEN 2 * tp_{t} / (gs + ps) ELSE 0 END')} AS f1_{t}" for t in evaluate.TAUS) + " FROM f")
def segment_f1(spark, sf):
    out = evaluate.segment_f1(*_merged(spark, sf), A.interval_videos(spark))
    return out.select("video_id", *[x for t in evaluate.TAUS for x in (f"tp_{t}", R(f"f1_{t}", alias=f"f1_{t}"))])


SUMMARY = F1S + ", " + _text_sql("gt") + ", " + _text_sql("pred") + """, e AS (SELECT a.video_id, 100 * (1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s), 1)) AS edit_score FROM gt_s a JOIN pred_s b USING (video_id)),
t AS (SELECT CAST(sum(num_frames) AS BIGINT) AS num_frames, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p - tp) AS BIGINT) AS fp, CAST(sum(g - tp) AS BIGINT) AS fn, CAST(sum(gs) AS BIGINT) AS gs, CAST(sum(ps) AS BIGINT) AS ps, CAST(sum(tp_50) AS BIGINT) AS tp_50, avg(edit_score) AS edit_score, avg(tp / nullif(g + p - tp, 0)) AS frame_iou FROM f JOIN e USING (video_id))"""


@query(f"WITH {SUMMARY} SELECT num_frames, tp AS frame_tp, fp AS frame_fp, fn AS frame_fn, {r('(num_frames - fp - fn) / num_frames')} AS mof, {r('edit_score')} AS edit_score, {r('frame_iou')} AS frame_iou, {r('2 * tp / (2 * tp + fp + fn)')} AS frame_f1, tp_50, {r('2 * tp_50 / (gs + ps)')} AS f1_50 FROM t")
def summary_overall(spark, sf):
    out = evaluate.summary(_rows(spark, sf))
    return out.select("num_frames", "frame_tp", "frame_fp", "frame_fn", R("mof", alias="mof"), R("edit_score", alias="edit_score"), R("frame_iou", alias="frame_iou"), R("frame_f1", alias="frame_f1"), "tp_50", R("f1_50", alias="f1_50"))


def _attr_sql(tau: int) -> str:
    return LSPAN + f""", mt AS {_match_sql('gt_l', 'pred_l', tau)},
mm AS (SELECT p.*, m.gs, g.direction AS gd, g.cycles AS gc FROM pred_l p LEFT JOIN mt m USING (video_id, "start", "end") LEFT JOIN gt_l g ON g.video_id = m.video_id AND g."start" = m.gs AND g."end" = m.ge)"""


_N = lambda c, a: f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {a}"


def _labelled(spark, sf):
    g, p = A.gt(spark, sf), A.pred(spark, sf)
    return evaluate.labelled(g, g), evaluate.labelled(p, p), A.interval_videos(spark)


@query(f"""WITH {_attr_sql(10)}, d AS (SELECT video_id, {_N("direction = 'CW' AND gd = 'CW'", 'cw_tp')}, {_N("direction = 'CCW' AND gd = 'CCW'", 'ccw_tp')}, {_N("direction = 'CW' AND (gs IS NULL OR gd <> 'CW')", 'cw_fp')}, {_N("direction = 'CCW' AND (gs IS NULL OR gd <> 'CCW')", 'ccw_fp')}, {_N('direction = gd', 'ok')}, {_N('direction IS NOT NULL AND gd IS NOT NULL', 'n')},
  CAST(count(cycles - gc) AS BIGINT) AS cp, sum(abs(cycles - gc)) AS ae, sum(cycles) AS pc FROM mm GROUP BY 1), g AS (SELECT video_id, {_N("direction = 'CW'", 'cw')}, {_N("direction = 'CCW'", 'ccw')}, sum(cycles) AS gcy FROM gt_l GROUP BY 1)
SELECT video_id, cw_tp, cw_fp, cw - cw_tp AS cw_fn, ccw_tp, ccw_fp, ccw - ccw_tp AS ccw_fn, ok AS direction_correct, n AS direction_matched, {r('ok / nullif(n, 0)')} AS direction_accuracy, cp AS cycle_pairs, {r('ae / nullif(cp, 0)')} AS cycle_mae, {r('gcy', 3)} AS gt_cycles, {r('pc', 3)} AS pred_cycles FROM d JOIN g USING (video_id)""")
def direction_metrics(spark, sf):
    out = evaluate.label_metrics(evaluate.label_counts(*_labelled(spark, sf)))
    return out.select("video_id", "cw_tp", "cw_fp", "cw_fn", "ccw_tp", "ccw_fp", "ccw_fn", "direction_correct", "direction_matched", R("direction_accuracy", alias="direction_accuracy"), "cycle_pairs", R("cycle_mae", alias="cycle_mae"), R("gt_cycles", 3, "gt_cycles"), R("pred_cycles", 3, "pred_cycles"))


_ATTR = f"""WITH {_attr_sql(50)}, a AS (SELECT *, cycles - gc AS err FROM mm WHERE gs IS NOT NULL),
q AS (SELECT CAST(count(*) AS BIGINT) AS attribute_pairs, CAST(count(gd) AS BIGINT) AS direction_eligible, {_N('gd = direction', 'ok')}, {_N('gd IS NOT NULL AND direction IS NOT NULL', 'n')}, CAST(count(err) AS BIGINT) AS cycle_pairs, sum(abs(err)) AS ae, sum(err * err) AS se, sum(err) AS e, sum(CASE WHEN err IS NOT NULL THEN gc END) AS t, count(*) FILTER (WHERE abs(err) <= 0.5) AS h FROM a)
SELECT attribute_pairs, direction_eligible, ok AS direction_correct, n AS direction_matched, {r('ok / nullif(n, 0)')} AS direction_accuracy, cycle_pairs, {r('ae / nullif(cycle_pairs, 0)')} AS cycle_mae, {r('sqrt(se / nullif(cycle_pairs, 0))')} AS cycle_rmse, {r('e / nullif(cycle_pairs, 0)')} AS cycle_bias, {r('ae / nullif(t, 0)')} AS cycle_wape, {r('h / nullif(cycle_pairs, 0)')} AS within_0p5 FROM q"""


@query(_ATTR)
def attribute_quality(spark, sf):
    out = evaluate.attribute_metrics(evaluate.pooled(evaluate.attribute_counts(*_labelled(spark, sf))))
    return out.select("attribute_pairs", "direction_eligible", "direction_correct", "direction_matched", R("direction_accuracy", alias="direction_accuracy"), "cycle_pairs", *[R(c, alias=c) for c in ("cycle_mae", "cycle_rmse", "cycle_bias", "cycle_wape", "within_0p5")])


@query(f"""WITH {LSPAN} SELECT CAST(count(*) AS BIGINT) AS attribute_pairs, CAST(count(direction) AS BIGINT) AS direction_correct, 0.0::DOUBLE AS cycle_mae FROM gt_l""")
def oracle_check(spark, sf):
    g, _, v = _labelled(spark, sf)
    out = evaluate.attribute_metrics(evaluate.pooled(evaluate.oracle_attributes(g, g, v)))
    return out.select("attribute_pairs", "direction_correct", R("cycle_mae", alias="cycle_mae"))


@query(f"""WITH {A.SPANS}, e AS (SELECT g.video_id, g."start", g."end", CAST(count(p."start") AS BIGINT) AS pieces, sum(greatest(0, coalesce({_OVER}, 0))) / (g."end" - g."start" + 1) AS coverage, (min(p."start") - g."start") / 30 AS se, (max(p."end") - g."end") / 30 AS ee
  FROM gt_m g LEFT JOIN pred_m p ON g.video_id = p.video_id AND p."start" <= g."end" + 30 AND p."end" >= g."start" - 30 GROUP BY 1, 2, 3) SELECT video_id, "start", "end", pieces, {r('coverage')} AS coverage, {r('se')} AS start_err, {r('ee')} AS end_err FROM e""")
def event_eval(spark, sf):
    out = spans.event_evaluation(*_merged(spark, sf), "video_id")
    return out.select("video_id", "start", "end", "pieces", R("coverage", alias="coverage"), R("start_err", alias="start_err"), R("end_err", alias="end_err"))


@query(f"""WITH {A.SPANS}, sh AS (SELECT video_id, num_frames, (i * 997 + 13) % num_frames AS shift FROM iv, range(0, 300) t(i)),
mv AS (SELECT p.video_id, shift, (p."start" + shift) % num_frames AS "start", (p."end" + shift) % num_frames AS "end" FROM pred_m p JOIN sh ON sh.video_id = p.video_id),
h AS (SELECT video_id, shift, count(*) AS hits FROM (SELECT DISTINCT g.video_id, shift, g."start", g."end" FROM gt_m g JOIN mv p ON g.video_id = p.video_id AND p."start" <= g."end" + 30 AND p."end" >= g."start" - 30) GROUP BY 1, 2)
SELECT sh.video_id, sh.shift, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM sh LEFT JOIN h ON h.video_id = sh.video_id AND h.shift = sh.shift""")
def random_shift_null(spark, sf):
    shifts = A.interval_videos(spark).crossJoin(spark.range(300)).select("video_id", "num_frames", ((F.col("id") * 997 + 13) % F.col("num_frames")).alias("shift"))
    return spans.shifted_hits(*_merged(spark, sf), shifts, "video_id")


@query()
def temporal_map(spark, sf):
    aps = evaluate.average_precision(_merged(spark, sf)[0], A.pred(spark, sf), A.interval_videos(spark))
    return aps.select("video_id", "tau", R("ap", 6, "ap"))


@query()
def greedy_spans(spark, sf):
    scores = _series(spark, sf).select(*KEYS, F.when(F.col("dist") < 2500, 0.9).otherwise(0.1).alias("score"))
    out = spans.greedy_spans(scores, "video_id", seconds=0.2, fraction=0.6)
    return out.select("video_id", "span", "start", "end", "positive_frames", R("positive_fraction", alias="positive_fraction"))


@query(f"WITH {A.SPANS} SELECT video_id, 'pred' AS missing_in FROM (SELECT DISTINCT video_id FROM gt WHERE video_id NOT IN (SELECT video_id FROM pred WHERE score >= 0.995)) UNION ALL SELECT video_id, 'gt' FROM (SELECT DISTINCT video_id FROM pred WHERE score >= 0.995 AND video_id NOT IN (SELECT video_id FROM gt))")
def scope_warnings(spark, sf):
    return evaluate.scope(A.gt(spark, sf), A.pred(spark, sf).where("score >= 0.995"))


# -- scores, reports, sampling ----------------------------------------------------------------------------------

RANK = A.SCORED + """, byv AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1), cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM byv WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {RANK} SELECT CAST(sum(pos) AS BIGINT) AS positives, {r('sum(pos * tp / (tp + fp)) / sum(pos)', 6)} AS average_precision FROM cu")
def average_precision(spark, sf):
    return scoring.ranking_metrics(A.scored(spark, sf), []).select("positives", R("average_precision", 6, "average_precision"))


@query(f"WITH {RANK} SELECT CAST(sum(neg) AS BIGINT) AS negatives, {r('sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg))', 6)} AS roc_auc FROM cu")
def roc_auc(spark, sf):
    return scoring.ranking_metrics(A.scored(spark, sf), []).select("negatives", R("roc_auc", 6, "roc_auc"))


@query(f"WITH {A.SCORED}, k AS (SELECT video_id, {_N('score >= 0.5 AND label = 1', 'tp')}, {_N('score >= 0.5 AND label = 0', 'fp')}, {_N('score < 0.5 AND label = 1', 'fn')}, {_N('score < 0.5 AND label = 0', 'tn')} FROM scored GROUP BY 1) SELECT *, {r('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {r('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM k")
def confusion_counts(spark, sf):
    out = scoring.confusion(A.scored(spark, sf), ["video_id"])
    return out.select("video_id", "tp", "fp", "fn", "tn", R("accuracy", alias="accuracy"), R("f1", alias="f1"))


FEATURES = ["f_len", "f_len2", "f_id", "f_mod"]
REPORT = A.SCORED + ", l AS (SELECT video_id, label, unnest(['f_len', 'f_len2', 'f_id', 'f_mod']) AS feature, unnest([f_len, f_len2, f_id, f_mod]) AS v FROM scored)"


@query(f"""WITH {REPORT}, s AS (SELECT feature, avg(v) FILTER (WHERE label = 1) AS mp, avg(v) FILTER (WHERE label = 0) AS mn, var_samp(v) FILTER (WHERE label = 1) AS vp, var_samp(v) FILTER (WHERE label = 0) AS vn, count(v) FILTER (WHERE label = 1) AS np, count(v) FILTER (WHERE label = 0) AS nn, avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS missing FROM l GROUP BY 1)
SELECT feature, {r('mp')} AS mean_pos, {r('mn')} AS mean_neg, {r('missing')} AS missing, {r('(mp - mn) / sqrt(((np - 1) * vp + (nn - 1) * vn) / (np + nn - 2))')} AS cohens_d FROM s""")
def cohens_d(spark, sf):
    out = scoring.feature_report(A.scored(spark, sf), FEATURES)
    return out.select("feature", *[R(c, alias=c) for c in ("mean_pos", "mean_neg", "missing", "cohens_d")])


@query(f"""WITH {REPORT}, byv AS (SELECT video_id, feature, v, sum(label) AS pos, sum(1 - label) AS neg FROM l WHERE v IS NOT NULL GROUP BY 1, 2, 3), cu AS (SELECT *, sum(pos) OVER w AS tp FROM byv WINDOW w AS (PARTITION BY video_id, feature ORDER BY v DESC ROWS UNBOUNDED PRECEDING)),
au AS (SELECT video_id, feature, sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM cu GROUP BY 1, 2) SELECT feature, {r('min(abs(auc - 0.5))', 6)} AS weakest_auc_gap FROM au GROUP BY 1""")
def feature_report(spark, sf):
    out = scoring.report_summary(scoring.feature_report(A.scored(spark, sf), FEATURES, keys=("video_id",)))
    return out.select("feature", R("weakest_auc_gap", 6, "weakest_auc_gap"))


_PAIRS = [(a, b) for k, a in enumerate(FEATURES) for b in FEATURES[k + 1 :]]


@query(f"WITH {A.SCORED}, k AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS correlation FROM scored" for a, b in _PAIRS) + f") SELECT a, b, {r('correlation')} AS correlation FROM k WHERE abs(correlation) >= 0.95")
def redundant_pairs(spark, sf):
    return scoring.correlations(A.scored(spark, sf), FEATURES).select("a", "b", R("correlation", alias="correlation"))


@query(f"""WITH {A.TRACKS}, h AS (SELECT least(floor(x / (1300.0::DOUBLE / 16)), 15) AS bin_x, least(floor(y / (5000.0::DOUBLE / 12)), 11) AS bin_y FROM tracks WHERE x BETWEEN 0 AND 1300 AND y BETWEEN 0 AND 5000), g AS (SELECT a AS bin_x, b AS bin_y FROM range(16) t(a), range(12) u(b))
SELECT g.bin_x, g.bin_y, CAST(count(h.bin_x) AS BIGINT) AS n FROM g LEFT JOIN h ON h.bin_x = g.bin_x AND h.bin_y = g.bin_y GROUP BY 1, 2""")
def hist2d(spark, sf):
    return scoring.histogram2d(A.tracks(spark, sf), "x", "y", 1300.0, 5000.0, 16, 12)


@query(f"WITH {A.PAIRS}, q AS (SELECT video_id, quantile_cont(dist, [0.25, 0.5, 0.975]) AS q FROM pairs GROUP BY 1) SELECT video_id, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.975::DOUBLE]) AS q, round(unnest(q), 4) + 0.0::DOUBLE AS value FROM q")
def quantile_cut(spark, sf):
    return scoring.quantiles(A.pairs(spark, sf), ["video_id"], "dist", (0.25, 0.5, 0.975)).select("video_id", "q", R("value", alias="value"))


@query(f"WITH {A.SCORED}, n AS (SELECT label, count(*) AS a, CAST(floor(count(*) * 0.2::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS t FROM scored GROUP BY 1) SELECT * FROM (SELECT label, true AS test, t AS n FROM n UNION ALL SELECT label, false, CAST(a - t AS BIGINT) FROM n) WHERE n > 0")
def stratified_split(spark, sf):
    out = scoring.stratified_split(A.scored(spark, sf), "doc_id", "label")
    return out.groupBy("label", "test").agg(F.count("*").alias("n"))


@query(f"WITH {A.SCORED}, n AS (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, count(*) AS n FROM scored GROUP BY 1) SELECT label, CAST(CASE WHEN label = 1 THEN n ELSE least(n, coalesce((SELECT n FROM n WHERE label = 1), 0)) END AS BIGINT) AS n FROM n")
def balanced_negatives(spark, sf):
    held = A.scored(spark, sf).withColumn("label", F.when(F.col("label") == 0, 1).otherwise(0))
    return scoring.balanced_negatives(held, "doc_id", "label").groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {A.PAIRS}, e AS (SELECT video_id, t1, t2, pair_episode_id, count(*) AS n FROM pairs GROUP BY 1, 2, 3, 4), t AS (SELECT video_id, CAST(count(*) AS BIGINT) AS track_rows, CAST(count(DISTINCT track) AS BIGINT) AS tracks, median(body) AS median_body FROM tracks GROUP BY 1),
m AS (SELECT video_id, CAST(count(*) AS BIGINT) AS episodes, median(n) AS median_episode FROM e GROUP BY 1), p AS (SELECT video_id, CAST(count(*) AS BIGINT) AS pair_rows, min(frame) AS first_frame, max(frame) AS last_frame, {r('avg(CASE WHEN dt IS NULL THEN 1.0::DOUBLE ELSE 0 END)')} AS dt_null FROM pairs GROUP BY 1)
SELECT * FROM t JOIN m USING (video_id) JOIN p USING (video_id)""")
def qc_summary(spark, sf):
    from framewise.operators import qc

    return qc.video_stats(A.tracks(spark, sf), A.pairs(spark, sf), ["video_id"], ["t1", "t2", "pair_episode_id"]).withColumn("dt_null", R("dt_null"))


@query(f"""WITH {A.PAIRS}, e AS (SELECT video_id, t1, t2, pair_episode_id, count(*) AS n FROM pairs GROUP BY 1, 2, 3, 4), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY abs(n - (SELECT median(n) FROM e i WHERE i.video_id = e.video_id)), t1, t2, pair_episode_id) AS nth FROM e)
SELECT video_id, frame, t1, t2 FROM (SELECT p.*, row_number() OVER (PARTITION BY p.video_id ORDER BY frame) AS line FROM pairs p JOIN k USING (video_id, t1, t2, pair_episode_id) WHERE nth = 1) WHERE line <= 80""")
def episode_median_sample(spark, sf):
    from framewise.operators import qc

    return qc.typical_episode(A.pairs(spark, sf), "video_id", ["t1", "t2", "pair_episode_id"]).select(*KEYS, "t1", "t2")


@query("SELECT event_id, printf('%02d:%02d:%02d', event_id * 37 // 3600, event_id * 37 // 60 % 60, event_id * 37 % 60) AS hms, event_id * 37.0::DOUBLE AS seconds FROM events")
def hms_format(spark, sf):
    out = A.table(spark, sf, "events").select("event_id", X.hms(F.col("event_id") * 37).alias("hms"))
    return out.select("event_id", "hms", X.seconds_of(F.col("hms")).alias("seconds"))


@query("SELECT DISTINCT regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS header FROM part")
def normalise_headers(spark, sf):
    return A.table(spark, sf, "part").select(X.letters_only(F.col("p_type")).alias("header")).distinct()


# -- experiments ------------------------------------------------------------------------------------------------


@query(f"""WITH {A.SCORED}, e AS (SELECT video_id, quantile_cont(doc_id, 0.25) AS a, quantile_cont(doc_id, 0.5) AS b, quantile_cont(doc_id, 0.75) AS c FROM scored GROUP BY 1)
SELECT video_id, doc_id, CASE WHEN doc_id < a THEN 0 WHEN doc_id < b THEN 1 WHEN doc_id < c THEN 2 ELSE 3 END AS block FROM scored JOIN e USING (video_id)""")
def inner_blocks(spark, sf):
    from framewise.plans import experiments

    return experiments.inner_blocks(A.scored(spark, sf), "video_id", "doc_id").select("video_id", "doc_id", F.col("block").cast("int").alias("block"))


def _cells_sql(cells: str, source: str, hot: str, lengths: tuple[int, ...]) -> str:
    """Counts of every video for every cell and minimum length: vid, nth, the grid's columns and pooled counts."""
    sizes = ", ".join(f"({k}, {n})" for k, n in enumerate(lengths))
    return f"""cells AS ({cells}), vt AS (SELECT video_id, cell, frame, avg(p) OVER (PARTITION BY video_id, cell ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS vote FROM (SELECT s.*, cell, CASE WHEN {hot} THEN 1.0::DOUBLE ELSE 0 END AS p FROM {source} s, cells)),
rn AS ({_islands_sql('vt', 'vote >= 0.5', 1, 'video_id, cell')}), grid AS (SELECT *, cell * {len(lengths)} + k AS nth FROM cells, (VALUES {sizes}) l(k, min_length)),
pg AS (SELECT video_id || '#' || nth AS video_id, "start", "end" FROM rn JOIN grid USING (cell) WHERE "end" - "start" + 1 >= min_length), gg AS (SELECT video_id || '#' || nth AS video_id, "start", "end" FROM gt_m, grid),
hit AS (SELECT video_id, count(*) AS n FROM {_match_sql('gg', 'pg', 50)} GROUP BY 1), shared AS (SELECT g.video_id, sum({_OVER}) AS n FROM gg g JOIN pg p ON {_ON} GROUP BY 1),
size_p AS (SELECT video_id, sum("end" - "start" + 1) AS f, count(*) AS n FROM pg GROUP BY 1), size_g AS (SELECT video_id, sum("end" - "start" + 1) AS f, count(*) AS n FROM gg GROUP BY 1),
counts AS (SELECT v.vid, grid.*, coalesce(sh.n, 0) AS tp, coalesce(sp.f, 0) AS p, coalesce(sg.f, 0) AS g, coalesce(sp.n, 0) AS ps, coalesce(sg.n, 0) AS gs, coalesce(h.n, 0) AS tp_50
  FROM (SELECT iv.video_id AS vid, nth AS vnth, iv.video_id || '#' || nth AS video_id FROM iv, grid) v JOIN grid ON nth = vnth LEFT JOIN shared sh USING (video_id) LEFT JOIN size_p sp USING (video_id) LEFT JOIN size_g sg USING (video_id) LEFT JOIN hit h USING (video_id))"""


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("tp", "p", "g", "ps", "gs", "tp_50"))
_OBJECTIVE = "CASE WHEN tp_50 > 0 THEN 2 * tp_50 / (ps + gs) ELSE 0::DOUBLE END AS f1_50, CASE WHEN tp > 0 THEN 2 * tp / (g + p) ELSE 0::DOUBLE END AS frame_f1"
_THRESHOLD_CELLS = "SELECT i - 1 AS cell, i / 20 AS threshold FROM range(1, 20) t(i)"
_RULE_CELLS = "SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS BIGINT) AS cell, a AS close_min, b AS turns_min FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS a) x, (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.5]::DOUBLE[]) AS b) y"
_LENGTHS = (0, 90, 150, 300)
GRID = A.SPANS + f""", inside AS (SELECT video_id, unnest(range("start", "end" + 1)) AS frame FROM pred_m),
dense AS (SELECT f.video_id, f.frame, CASE WHEN i.frame IS NULL THEN 0 ELSE 0.8::DOUBLE END AS score FROM (SELECT video_id, unnest(range(0, {A.INTERVAL_FRAMES})) AS frame FROM iv) f LEFT JOIN inside i ON i.video_id = f.video_id AND i.frame = f.frame)"""
RULES = A.SPANS + f""", inside AS (SELECT video_id, frame, max(score) AS c, max(cycles) AS t FROM (SELECT *, unnest(range("start", "end" + 1)) AS frame FROM pred) GROUP BY 1, 2),
dense AS (SELECT f.video_id, f.frame, c, t FROM (SELECT video_id, unnest(range(0, {A.INTERVAL_FRAMES})) AS frame FROM iv) f LEFT JOIN inside i ON i.video_id = f.video_id AND i.frame = f.frame)"""


@query(f"""WITH {GRID}, {_cells_sql(_THRESHOLD_CELLS, 'dense', 'score >= threshold', _LENGTHS)}, pooled AS (SELECT nth, threshold, min_length, {_SUMS} FROM counts GROUP BY 1, 2, 3)
SELECT threshold, min_length, {r('f1_50')} AS f1_50, {r('frame_f1')} AS frame_f1 FROM (SELECT *, {_OBJECTIVE} FROM pooled) ORDER BY f1_50 DESC, frame_f1 DESC, nth LIMIT 1""")
def grid_search_best(spark, sf):
    from framewise.plans import experiments

    scores = frames.zero_filled(frames.spine(A.interval_videos(spark)), spans.frames_of(spans.merge_spans(A.pred(spark, sf), ["video_id"]), ["video_id"]).withColumn("score", F.lit(0.8)), KEYS)
    return experiments.choose_postprocess(scores, A.gt(spark, sf), A.interval_videos(spark)).select("threshold", "min_length", R("f1_50", alias="f1_50"), R("frame_f1", alias="frame_f1"))


@query(f"""WITH {RULES}, {_cells_sql(_RULE_CELLS, 'dense', 'coalesce(c >= close_min AND abs(t) >= turns_min, false)', _LENGTHS)}, whole AS (SELECT nth, {_SUMS} FROM counts GROUP BY 1),
rest AS (SELECT c.vid, nth, close_min, turns_min, min_length, {', '.join(f'w.{x} - c.{x} AS {x}' for x in ('tp', 'p', 'g', 'ps', 'gs', 'tp_50'))} FROM counts c JOIN whole w USING (nth)),
fitted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY f1_50 DESC, frame_f1 DESC, nth) AS place FROM (SELECT *, {_OBJECTIVE} FROM rest)) WHERE place = 1), judged AS (SELECT vid, nth, {_OBJECTIVE} FROM counts)
SELECT f.vid AS test_video, f.close_min, f.turns_min, f.min_length, {r('f.f1_50')} AS train_f1_50, {r('f.frame_f1')} AS train_frame_f1, {r('j.f1_50')} AS f1_50, {r('j.frame_f1')} AS frame_f1 FROM fitted f JOIN judged j ON j.vid = f.vid AND j.nth = f.nth""")
def lovo_rule(spark, sf):
    from framewise.plans import experiments

    told = spans.frames_of(A.pred(spark, sf), ["video_id"], ("score", "cycles"))
    held = told.groupBy("video_id", "frame").agg(F.max("score").alias("close"), F.max("cycles").alias("turns"))
    out = experiments.rule_folds(held, A.gt(spark, sf), A.interval_videos(spark))
    return out.select("test_video", "close_min", "turns_min", "min_length", *[R(c, alias=c) for c in ("train_f1_50", "train_frame_f1", "f1_50", "frame_f1")])


@query()
def logreg_fit(spark, sf):
    from framewise.plans import models

    held = scoring.stratified_split(A.scored(spark, sf), "doc_id", "label")
    model = models.logistic(held.where(~F.col("test")), FEATURES)
    scored = models.predict(model, held.where("test"))
    return scored.select("doc_id", R("score", 6, "score"), "label")


# -- composite tables and event reports -------------------------------------------------------------------------

_REV = A.SPANS + ", " + A.REVIEWED_SPANS
_FRAMES_OF = 'SELECT video_id, unnest(range("start", "end" + 1)) AS frame'
MASKS = _REV + f", masks AS (SELECT video_id, frame, bool_or(m = 'det') AS det, bool_or(m = 'lab') AS lab, bool_or(m = 'rev') AS rev FROM ({' UNION ALL '.join(f'{_FRAMES_OF}, {chr(39)}{m}{chr(39)} AS m FROM {t}_m' for m, t in (('det', 'pred'), ('lab', 'gt'), ('rev', 'reviewed')))}) GROUP BY 1, 2)"


def _masks(spark, sf):
    return spans.frame_masks({"det": A.pred(spark, sf), "lab": A.gt(spark, sf), "rev": A.reviewed(spark, sf)}, ["video_id"])


@query(f"WITH {MASKS} SELECT video_id, frame, det AND lab AS both, rev AND NOT lab AS negative, det AND rev AND NOT lab AS false_alarm FROM masks")
def frame_masks(spark, sf):
    negative = F.col("rev") & ~F.col("lab")
    return _masks(spark, sf).select(*KEYS, (F.col("det") & F.col("lab")).alias("both"), negative.alias("negative"), (F.col("det") & negative).alias("false_alarm"))


@query(f"""WITH {MASKS}, met AS (SELECT g.video_id, g."start" AS a, g."end" AS b, count(p."start") AS pieces, abs(min(p."start") - g."start") / 30 AS se, abs(max(p."end") - g."end") / 30 AS ee FROM gt_m g LEFT JOIN pred_m p ON g.video_id = p.video_id AND p."start" <= g."end" + 30 AND p."end" >= g."start" - 30 GROUP BY 1, 2, 3),
ev AS (SELECT video_id, CAST(sum(CASE WHEN pieces > 0 THEN 1 ELSE 0 END) AS BIGINT) AS caught, CAST(count(*) AS BIGINT) AS events, avg(CASE WHEN pieces > 0 THEN pieces END) AS pieces, median(se) AS start_err, median(ee) AS end_err FROM met GROUP BY 1),
sh AS (SELECT video_id, (i * 997 + 13) % num_frames AS shift, num_frames FROM iv, range(0, 300) t(i)), mv AS (SELECT p.video_id, shift, (p."start" + shift) % num_frames AS "start", (p."end" + shift) % num_frames AS "end" FROM pred_m p JOIN sh ON sh.video_id = p.video_id),
nu AS (SELECT video_id, count(*) / 300 AS null_hits FROM (SELECT DISTINCT g.video_id, shift, g."start", g."end" FROM gt_m g JOIN mv p ON g.video_id = p.video_id AND p."start" <= p."end" AND p."start" <= g."end" + 30 AND p."end" >= g."start" - 30) GROUP BY 1),
mk AS (SELECT video_id, sum(CASE WHEN det AND lab THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN lab THEN 1 ELSE 0 END), 0) AS coverage, sum(CASE WHEN det AND rev AND NOT lab THEN 1 ELSE 0 END) / 30 AS fa, sum(CASE WHEN rev AND NOT lab THEN 1 ELSE 0 END) / 30 AS neg FROM masks GROUP BY 1)
SELECT iv.video_id, coalesce(caught, 0) AS caught, coalesce(events, 0) AS events, {r('coalesce(null_hits, 0)')} AS null_hits, {r('coverage')} AS coverage, {r('pieces')} AS pieces, {r('start_err')} AS start_err, {r('end_err')} AS end_err, {r('coalesce(fa, 0)')} AS false_alarm_s, {r('coalesce(neg, 0)')} AS reviewed_neg_s,
  CAST((SELECT count(*) FROM pred_m p WHERE p.video_id = iv.video_id) AS BIGINT) AS episodes FROM iv LEFT JOIN ev ON ev.video_id = iv.video_id LEFT JOIN nu ON nu.video_id = iv.video_id LEFT JOIN mk ON mk.video_id = iv.video_id""")
def event_summary(spark, sf):
    shifts = A.interval_videos(spark).crossJoin(spark.range(300)).select("video_id", "num_frames", ((F.col("id") * 997 + 13) % F.col("num_frames")).alias("shift"))
    labels, found = _merged(spark, sf)
    out = spans.event_summary(labels, found, A.reviewed(spark, sf), shifts, "video_id")
    return out.select("video_id", "caught", "events", *[R(c, alias=c) for c in ("null_hits", "coverage", "pieces", "start_err", "end_err", "false_alarm_s", "reviewed_neg_s")], "episodes")


@query(f'WITH {A.SPANS}, c AS (SELECT g.video_id, g."start", g."end", count(p."start") AS n FROM gt_m g LEFT JOIN pred p ON {_ON} GROUP BY 1, 2, 3) SELECT video_id, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS found, CAST(count(*) AS BIGINT) AS labels, {r("sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) / count(*)")} AS recall FROM c GROUP BY 1')
def event_recall(spark, sf):
    counted = spans.event_recall(_merged(spark, sf)[0], A.pred(spark, sf), "video_id")
    return spans.recall_of(counted, ["video_id"]).withColumn("recall", R("recall"))


@query(f"""WITH {A.SPANS}, s AS (SELECT video_id, unnest(range(0, num_frames)) AS frame FROM iv), i AS (SELECT video_id, frame, min(st) AS a, max(st) AS b FROM (SELECT video_id, {_STATUS} AS st, unnest(range("start", "end" + 1)) AS frame FROM gt) WHERE st <> 'unknown' GROUP BY 1, 2)
SELECT s.video_id, s.frame, CASE WHEN a IS NULL THEN 'UNKNOWN' WHEN a <> b THEN 'CONFLICT' ELSE a END AS status FROM s LEFT JOIN i ON i.video_id = s.video_id AND i.frame = s.frame""")
def browser_status(spark, sf):
    held = A.gt(spark, sf).withColumn("status", F.expr(_STATUS))
    return spans.reference_status(frames.spine(A.interval_videos(spark)), held, ["video_id"]).select(*KEYS, "status")


@query("WITH m AS (SELECT event_id, CAST(round(event_id * 37 / 30 * 1000) AS BIGINT) AS ms FROM events) SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM m")
def frame_stamps(spark, sf):
    return A.table(spark, sf, "events").select("event_id", X.stamp(F.col("event_id") * 37).alias("stamp"))


@query(f'WITH {A.SPANS} SELECT video_id, row_id, greatest(0, "start" - 30) AS low, least({A.INTERVAL_FRAMES - 1}, "end" + 30) AS high FROM pred')
def buffered_bounds(spark, sf):
    held = A.pred(spark, sf).withColumn("_b", X.buffered(F.col("start"), F.col("end"), F.lit(30), F.lit(A.INTERVAL_FRAMES).cast("long")))
    return held.select("video_id", "row_id", F.col("_b.start").alias("low"), F.col("_b.end").alias("high"))


@query(f"""WITH {A.SPANS}, h AS (SELECT g.*, EXISTS (SELECT 1 FROM pred p WHERE p.video_id = g.video_id AND p.direction = 'CW' AND p.score > 0.9::DOUBLE) AS ok, g."end" - g."start" + 1 AS n FROM gt g)
SELECT printf('%s__f%d-%d.mp4', video_id, "start", "end") AS clip, video_id, CASE WHEN ok THEN "start" END AS start_frame, CASE WHEN ok THEN "end" END AS stop_frame, CASE WHEN ok THEN {r('n / 30', 3)} END AS duration_s, CASE WHEN ok THEN n END AS n_frames, CASE WHEN ok THEN 'ok' ELSE 'skipped (no parquet)' END AS status FROM h""")
def clip_status(spark, sf):
    present = A.pred(spark, sf).where("direction = 'CW' AND score > 0.9D")
    return spans.clip_table(A.gt(spark, sf), A.interval_videos(spark), None, present=present)


_LR_POINTS = framefeat.KEYPOINTS
_LR_SIGNALS = [*_LR_POINTS, "bend", "turn"]


def _hypot(a: str, b: str, own: str = "") -> str:
    return f"sqrt(({a}_x - {own}{b}_x) * ({a}_x - {own}{b}_x) + ({a}_y - {own}{b}_y) * ({a}_y - {own}{b}_y))"


_LR_LENGTH = " + ".join(_hypot(a, b) for a, b in zip(framefeat.MIDLINE[:-1], framefeat.MIDLINE[1:], strict=True))
_LR_MOVES = ", ".join(f"CASE WHEN len > 1 AND next_ THEN ln(1 + sqrt(({k}_x - lag({k}_x) OVER w) * ({k}_x - lag({k}_x) OVER w) + ({k}_y - lag({k}_y) OVER w) * ({k}_y - lag({k}_y) OVER w)) / len) END AS {k}" for k in _LR_POINTS)
_LR_BASE = ["track_count", *[f"{x}_{y}" for x in _LR_SIGNALS for y in ("mean", "max")]]
_LR_PAIRS = {**{c: c for c in list(A.LINEAR_VALUES)[:9]}, **{f"{c}_{f}": f"{f}({c})" for c in list(A.LINEAR_VALUES)[9:] for f in ("sin", "cos")}}
LINEAR = A.PAIRS + f", {A.POSES}, {A.LINEAR}, {A.SPINE}" + f""",
p1 AS (SELECT *, {_LR_LENGTH} AS len, atan2(Nose_y - Spine1_y, Nose_x - Spine1_x) AS hd, coalesce(frame - lag(frame) OVER (PARTITION BY video_id, track ORDER BY frame) = 1, false) AS next_ FROM poses),
p2 AS (SELECT video_id, frame, {_LR_MOVES}, CASE WHEN len > 1 THEN 1 - {_hypot('Nose', 'TailTip')} / len END AS bend, CASE WHEN next_ THEN abs(atan2(sin(hd - lag(hd) OVER w), cos(hd - lag(hd) OVER w))) END AS turn FROM p1 WINDOW w AS (PARTITION BY video_id, track ORDER BY frame)),
p3 AS (SELECT video_id, frame, CAST(count(*) AS DOUBLE) AS track_count, {', '.join(f'avg({x}) AS {x}_mean, max({x}) AS {x}_max' for x in _LR_SIGNALS)} FROM p2 GROUP BY 1, 2),
p4 AS (SELECT s.video_id, s.frame, coalesce(track_count, 0) AS track_count, {', '.join(_LR_BASE[1:])} FROM spine s LEFT JOIN p3 ON p3.video_id = s.video_id AND p3.frame = s.frame),
p5 AS (SELECT *, {', '.join(f'avg({c}) OVER w AS {c}_trailing30' for c in _LR_BASE)} FROM p4 WINDOW w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
q1 AS (SELECT video_id, frame, CAST(count(*) AS DOUBLE) AS pair_count, {', '.join(f'avg({e}) AS {n}_mean, min({e}) AS {n}_min, max({e}) AS {n}_max' for n, e in _LR_PAIRS.items())} FROM lin GROUP BY 1, 2)"""
_LR_ALL = [*_LR_BASE, *[f"{c}_trailing30" for c in _LR_BASE], *[f"{n}_{f}" for n in _LR_PAIRS for f in ("mean", "min", "max")]]


@query(f"WITH {LINEAR} SELECT p5.video_id, p5.frame, coalesce(pair_count, 0) AS lr_pair_count, {', '.join(f'{r(c, 6)} AS lr_{c}' for c in _LR_ALL)} FROM p5 LEFT JOIN q1 ON q1.video_id = p5.video_id AND q1.frame = p5.frame")
def lr_features(spark, sf):
    from framewise.plans import tables

    out = tables.lr_features(A.poses(spark, sf), A.linear_pairs(spark, sf), A.videos(spark, sf))
    return out.select(*KEYS, "lr_pair_count", *[R(c, 6, c) for c in out.columns if c not in (*KEYS, "lr_pair_count")])


_WIN = ["dist", "rate", "dist_rate", "rate_rate"]


@query(f"""WITH {SERIES}, win AS (SELECT video_id, frame, {', '.join(f"lead({s}, {o}) OVER w AS {s}{k}" if o >= 0 else f"lag({s}, {-o}) OVER w AS {s}{k}" for s in _WIN for k, o in enumerate(range(-60, 61, 4)))} FROM series WINDOW w AS (PARTITION BY video_id ORDER BY frame))
SELECT b.video_id, b.frame, {r('b.dist')} AS dist, {', '.join(f'{r(f"{s}{k}", 3)} AS "win_{s}_offset_{o:+d}"' for s in _WIN for k, o in enumerate(range(-60, 61, 4)))} FROM best b JOIN win ON win.video_id = b.video_id AND win.frame = b.frame""")
def baseline_frames(spark, sf):
    from framewise.plans import tables

    model = frames.closest_pair(A.pairs(spark, sf), KEYS).select(*KEYS, R("dist", alias="dist"))
    windows = tables.flat_windows(_series(spark, sf), _WIN)
    base = tables.baseline_frames(model, frames.spine(A.videos(spark, sf)).withColumn("lr_one", F.lit(1)), windows).drop("lr_one")
    out = tables.with_baselines(model, base)
    return out.select(*KEYS, "dist", *[R(F.col(f"`{c}`"), 3, c) for c in out.columns if c.startswith("win_")])


@query(f"""WITH {A.PAIRS}, iv AS (SELECT 1), {A._interval_sql('gt', 'error')}, ok AS (SELECT * FROM pairs WHERE missing_1 + missing_2 < 5), lf AS (SELECT DISTINCT video_id, unnest(range("start", "end" + 1)) AS frame FROM gt),
a AS (SELECT video_id, frame, CAST(count(*) AS BIGINT) AS n_pairs, avg(rate) AS rmean FROM ok GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY dist NULLS LAST, t1, t2) AS nth FROM ok) WHERE nth = 1)
SELECT b.video_id, b.frame, t1, t2, n_pairs, {r('rmean')} AS all_rate_mean, {r('bearing_1')} AS bearing_1, CASE WHEN lf.frame IS NULL THEN 0 ELSE 1 END AS label FROM b JOIN a ON a.video_id = b.video_id AND a.frame = b.frame LEFT JOIN lf ON lf.video_id = b.video_id AND lf.frame = b.frame""")
def model_table(spark, sf):
    from framewise.plans import tables

    held = A.pairs(spark, sf)
    out = tables.model_table(held, held.where("missing_1 + missing_2 < 5"), A.gt(spark, sf), "dist", ["bearing_1"], {"rate": ["mean"]})
    return out.select(*KEYS, "t1", "t2", "n_pairs", R("all_rate_mean", alias="all_rate_mean"), R("bearing_1", alias="bearing_1"), "label")


@query(f"WITH {F0}, e AS (SELECT {GROUPS}, count(*) AS n FROM f1 GROUP BY ALL) SELECT day_label, CAST(max(n) AS BIGINT) AS n, CAST(0 AS BIGINT) AS changed FROM e GROUP BY 1")
def isolated_smoothing(spark, sf):
    return pairfeat.isolated_smoothing(pairfeat.add_smoothed(_features(spark, sf), ["centroid_distance_bl"]))


@query(f"""WITH {F0} SELECT CAST(count(*) FILTER (TrackUID_1 >= TrackUID_2) AS BIGINT) AS pair_order, CAST(count(*) FILTER (abs(speed_mean * 2 - speed_bl_s_1 - speed_bl_s_2) > 1e-6) AS BIGINT) AS speed_mean, CAST(count(*) FILTER (proximity <> (dbl <= 1.5)) AS BIGINT) AS proximity,
  CAST(count(*) FILTER (abs(dbl * (body_length_px_1 + body_length_px_2) / 2 - centroid_distance_px) > 1e-5 * (1 + centroid_distance_px)) AS BIGINT) AS body_lengths, CAST(count(*) FILTER (facing_1 <> (abs(bearing_1_rad) < pi() / 4)) AS BIGINT) AS bearing FROM f1""")
def invariants(spark, sf):
    return pairfeat.violations(_features(spark, sf)).select("pair_order", "speed_mean", "proximity", "body_lengths", "bearing")
