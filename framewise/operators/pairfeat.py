"""Pair-motion features: join of both tracks, normalised distances, orientation, gap-aware rates, smoothing and
windowed statistics.

All windows are over the pair keys or a refinement of them, so one exchange by the pair keys serves every step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.exprs import TWO_PI, finite, mean_known, positive, ratio, wrap_rad

FPS = 30.0
GAP_SECONDS = 0.2
#: Limits of the features.
NEAR_BL, FACING_RAD, MAX_RATE = 1.5, math.pi / 4, 15.0
WINDOW_SECONDS = (0.5, 1.0, 2.0, 4.0)
GROUP = ["project_id", "day_label", "TrackUID_1", "TrackUID_2", "pair_episode_id"]
DISTANCES = ["centroid_distance", "dist_nose1_nose2", "dist_nose1_tailtip2", "dist_nose2_tailtip1", "dist_nose1_spine4of2", "dist_nose2_spine4of1"]
SPEEDS = ["speed_bl_s_1", "speed_bl_s_2", "speed_mean_bl_s", "speed_diff_bl_s"]
BEARINGS = ["bearing_1_rad", "bearing_2_rad"]
STATS = ["close_frac", "mutual_facing_frac", "coverage", "distance_bl_mean", "speed_mean_bl_s_mean", "closing_speed_bl_s_mean", "bend_abs_mean", "abs_d_orbital_mean", "corotation_mean", "d_orbital_std", "orbit_turns_net", "orbit_turns_abs"]


def window_label(seconds: float) -> str:
    return f"w{seconds:g}s".replace(".", "p")


def window_columns(seconds: Sequence[float] = WINDOW_SECONDS) -> list[str]:
    return [f"{window_label(x)}_{s}" for x in seconds for s in STATS]


def side(tracks: DataFrame, number: int, columns: Sequence[str]) -> DataFrame:
    """Track columns of one side of a pair."""
    keys = ["project_id", "day_label", "FrameNum"]
    return tracks.select(*keys, F.col("TrackUID").alias(f"TrackUID_{number}"), F.lit(True).alias(f"matched_{number}"), *[F.col(c).alias(f"{c}_{number}") for c in columns])


def join_tracks(pairs: DataFrame, tracks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both sides' track columns beside each pair; matched_1 and matched_2 tell whether there was a track."""
    out = pairs
    for number in (1, 2):
        out = out.join(side(tracks, number, columns), ["project_id", "day_label", "FrameNum", f"TrackUID_{number}"], "left")
    return out.withColumns({f"matched_{k}": F.coalesce(f"matched_{k}", F.lit(False)) for k in (1, 2)})


def unmatched(joined: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and shares of pairs without a track on either side."""
    out = joined.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum((~F.col(f"matched_{k}")).cast("long")).alias(f"unmatched_{k}") for k in (1, 2)])
    return out.withColumns({f"unmatched_{k}_frac": ratio(F.col(f"unmatched_{k}"), F.col("n")) for k in (1, 2)})


def add_distances(df: DataFrame, names: Sequence[str] = tuple(DISTANCES)) -> DataFrame:
    """Distances in mean positive body lengths (<name>_px to <name>_bl)."""
    scale = mean_known(positive(F.col("body_length_px_1")), positive(F.col("body_length_px_2")))
    return df.withColumns({f"{n}_bl": F.col(f"{n}_px") / scale for n in names if f"{n}_px" in df.columns})


def add_orientation(df: DataFrame) -> DataFrame:
    """Speeds, proximity and facing. Unknown inputs stay unknown; mutual facing is false as soon as one side is."""
    facing = lambda c: F.abs(wrap_rad(F.col(c))) < FACING_RAD
    out = df.withColumns({"speed_mean_bl_s": (F.col("speed_bl_s_1") + F.col("speed_bl_s_2")) / 2, "speed_diff_bl_s": F.col("speed_bl_s_1") - F.col("speed_bl_s_2"), "proximity": F.col("centroid_distance_bl") <= NEAR_BL, "facing_1": facing("bearing_1_rad"), "facing_2": facing("bearing_2_rad")})
    return out.withColumn("mutual_facing", F.col("facing_1") & F.col("facing_2"))


def _order(keys: Sequence[str], frame: str) -> Window:
    return Window.partitionBy(*keys).orderBy(frame)


def add_approach(df: DataFrame, keys: Sequence[str] = tuple(GROUP), frame: str = "FrameNum", distance: str = "centroid_distance_bl") -> DataFrame:
    """Rate of change of the distance since the pair's row before, across gaps inside an episode."""
    rate = (F.col(distance) - F.lag(distance).over(_order(keys, frame))) / (F.when(F.col("dt_frames") > 0, F.col("dt_frames")) / FPS)
    return df.withColumn("approach_rate_bl_s", rate).withColumn("closing_speed_bl_s", -F.col("approach_rate_bl_s"))


def add_segments(df: DataFrame, keys: Sequence[str] = tuple(GROUP), frame: str = "FrameNum") -> DataFrame:
    """smooth_segment: a new one after every gap of more than 0.2 s."""
    gap = F.coalesce(F.col("dt_frames") / FPS > GAP_SECONDS, F.lit(False)).cast("long")
    return df.withColumn("smooth_segment", F.sum(gap).over(_order(keys, frame).rowsBetween(Window.unboundedPreceding, 0)))


RATES = ("d_orbital_rad_s", "d_heading_1_rad_s", "d_heading_2_rad_s")


def add_clean_rates(df: DataFrame) -> DataFrame:
    """<rate>_clean without values beyond 15 rad/s, and whether any was dropped."""
    dropped = F.lit(False)
    for c in RATES:
        dropped = dropped | F.coalesce(F.abs(c) > MAX_RATE, F.lit(False))
    clean = {f"{c}_clean": F.when(F.abs(c) <= MAX_RATE, F.col(c)) for c in RATES}
    return df.withColumns({**clean, "qc_angular_rate_clipped": dropped}).withColumn("abs_d_orbital_rad_s", F.abs("d_orbital_rad_s_clean"))


def add_orbital(df: DataFrame, keys: Sequence[str] = (*GROUP, "smooth_segment"), frame: str = "FrameNum", angle: str = "orbital_rad") -> DataFrame:
    """Wrapped step and derived rate of the position angle inside a segment, both dropped beyond 15 rad/s, and the
    acceleration of the supplied clean rate where there is a step."""
    order = _order(keys, frame)
    dt = F.when(F.col("dt_frames") > 0, F.col("dt_frames")) / FPS
    step = F.when(dt.isNotNull(), wrap_rad(F.col(angle) - F.lag(angle).over(order)))
    change = F.col("d_orbital_rad_s_clean") - F.lag("d_orbital_rad_s_clean").over(order)
    out = df.withColumns({"_step": step, "_rate": step / dt, "_change": change / dt})
    sane = F.abs("_rate") <= MAX_RATE
    out = out.withColumns({"orbital_step_rad": F.when(sane, F.col("_step")), "orbital_rate_derived_rad_s": F.when(sane, F.col("_rate")), "orbital_accel_rad_s2": F.when(F.col("_step").isNotNull(), F.col("_change"))})
    return out.drop("_step", "_rate", "_change")


def add_angular(df: DataFrame) -> DataFrame:
    """Corotation (+1 where a side turns the way the pair rotates), mean sizes of turns and bends, and sine/cosine
    encodings; needs the clean rates."""
    product = lambda k: F.signum(f"d_heading_{k}_rad_s_clean") * F.signum("d_orbital_rad_s_clean")
    out = df.withColumns({
        "corotation": mean_known(product(1), product(2)),
        "heading_rate_abs_mean_rad_s": mean_known(F.abs("d_heading_1_rad_s_clean"), F.abs("d_heading_2_rad_s_clean")),
        "bend_abs_mean_rad": mean_known(F.abs("bend_angle_rad_1"), F.abs("bend_angle_rad_2")),
    })
    return out.withColumns({f"{name}_{f}": getattr(F, f)(c) for name, c in (("rel_heading", "rel_heading_rad"), ("bearing_1", "bearing_1_rad"), ("bearing_2", "bearing_2_rad")) for f in ("sin", "cos")})


def flag_lengths(df: DataFrame, keys: Sequence[str] = ("project_id", "day_label")) -> DataFrame:
    """qc_bad_body_length: a side's length is missing, not positive, or outside half to twice the video's median."""
    both = df.select(*keys, F.explode(F.array("body_length_px_1", "body_length_px_2")).alias("_l")).where("_l > 0")
    medians = both.groupBy(*keys).agg(F.expr("percentile(_l, 0.5d)").alias("_median"))
    bad = lambda c: ~F.coalesce(F.col(c) > 0, F.lit(False)) | F.coalesce((F.col(c) < 0.5 * F.col("_median")) | (F.col(c) > 2 * F.col("_median")), F.lit(False))
    return df.join(medians, list(keys), "left").withColumn("qc_bad_body_length", bad("body_length_px_1") | bad("body_length_px_2")).drop("_median")


def unwrap(df: DataFrame, column: str, out: str, keys: Sequence[str] = (*GROUP, "smooth_segment"), frame: str = "FrameNum") -> DataFrame:
    """A continuous angle: whole turns are added so that steps are at most half a turn. A missing value ends a
    run; the next known value starts afresh."""
    order = _order(keys, frame)
    known = finite(F.col(column))
    df = df.withColumn("_run", F.sum(F.when(known.isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = _order([*keys, "_run"], frame)
    step = known - F.lag(known).over(inner)
    short = wrap_rad(step)
    short = F.when((short == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(short)
    fix = F.coalesce(F.when(F.abs(step) >= math.pi, short - step), F.lit(0.0))
    df = df.withColumn("_fix", F.when(known.isNotNull(), fix))
    return df.withColumn(out, known + F.sum("_fix").over(inner.rowsBetween(Window.unboundedPreceding, 0))).drop("_run", "_fix")


def add_smoothed(df: DataFrame, columns: Sequence[str], angles: Sequence[str] = (), keys: Sequence[str] = (*GROUP, "smooth_segment"), frame: str = "FrameNum", reach: int = 7) -> DataFrame:
    """<column>_smooth: a centred rolling median, then a rolling mean, inside a segment; angles are unwrapped
    before and wrapped after."""
    sources = {c: c for c in columns}
    for a in angles:
        df = unwrap(df, a, f"_u_{a}", keys, frame)
        sources[a] = f"_u_{a}"
    near = _order(keys, frame).rowsBetween(-reach, reach)
    df = df.withColumns({f"_m_{c}": F.percentile(F.col(s), F.lit(0.5)).over(near) for c, s in sources.items()})
    smooth = {f"{c}_smooth": F.avg(f"_m_{c}").over(near) for c in sources}
    df = df.withColumns(smooth).withColumns({f"{a}_smooth": wrap_rad(F.col(f"{a}_smooth")) for a in angles})
    return df.drop(*[f"_m_{c}" for c in sources], *[f"_u_{a}" for a in angles])


def window_bounds(seconds: float, trailing: bool = False) -> tuple[int, int, int]:
    """Frames before, frames after and length of a window."""
    length = round(FPS * seconds)
    before = length if trailing else length // 2
    return before, length - before, length + 1


def window_stats(seconds: float, keys: Sequence[str], frame: str, trailing: bool = False) -> dict[str, Column]:
    """The twelve statistics of one window length."""
    before, after, span = window_bounds(seconds, trailing)
    w = _order(keys, frame).rangeBetween(-before, after)
    close = F.coalesce(F.col("proximity"), F.lit(False))
    mutual = F.coalesce(F.col("mutual_facing"), F.lit(False))
    near = lambda x: F.when(close, x)
    step = near(F.col("orbital_step_rad"))
    known = F.count(step).over(w) > 0
    stats = {
        "close_frac": F.sum(close.cast("int")).over(w) / span,
        "mutual_facing_frac": F.sum(mutual.cast("int")).over(w) / span,
        "coverage": F.least(F.count("*").over(w) / span, F.lit(1.0)),
        "distance_bl_mean": F.avg("centroid_distance_bl").over(w),
        "speed_mean_bl_s_mean": F.avg("speed_mean_bl_s").over(w),
        "closing_speed_bl_s_mean": F.avg("closing_speed_bl_s").over(w),
        "bend_abs_mean": F.avg("bend_abs_mean_rad").over(w),
        "abs_d_orbital_mean": F.avg(near(F.col("abs_d_orbital_rad_s"))).over(w),
        "corotation_mean": F.avg(near(F.col("corotation"))).over(w),
        "d_orbital_std": F.when(F.count(near(F.col("d_orbital_rad_s_clean"))).over(w) > 1, F.stddev_pop(near(F.col("d_orbital_rad_s_clean"))).over(w)),
        "orbit_turns_net": F.when(known, F.sum(step).over(w) / F.lit(TWO_PI)),
        "orbit_turns_abs": F.when(known, F.sum(F.abs(step)).over(w) / F.lit(TWO_PI)),
    }
    return {f"{window_label(seconds)}_{s}": c for s, c in stats.items()}


def add_windows(df: DataFrame, keys: Sequence[str] = (*GROUP, "smooth_segment"), frame: str = "FrameNum", seconds: Sequence[float] = WINDOW_SECONDS, trailing: bool = False) -> DataFrame:
    """All windowed statistics. They share one partitioning and order, so they need one sort."""
    columns: dict[str, Column] = {}
    for x in seconds:
        columns |= window_stats(x, keys, frame, trailing)
    return df.withColumns(columns)


def add_qc(df: DataFrame, points: Sequence[str]) -> DataFrame:
    """qc_missing_nose_or_tail: any of the coordinate columns is missing; they are dropped."""
    missing = F.lit(False)
    for p in points:
        missing = missing | finite(F.col(p)).isNull()
    return df.withColumn("qc_missing_nose_or_tail", missing).drop(*points)


def violations(features: DataFrame) -> DataFrame:
    """Counts of rows that break what must hold for every feature row."""
    near = lambda a, b: F.abs(a - b) > 1e-6 * F.greatest(F.lit(1.0), F.abs(b))
    scaled = F.col("centroid_distance_px") / mean_known(positive(F.col("body_length_px_1")), positive(F.col("body_length_px_2")))
    rules = {
        "pair_order": F.col("TrackUID_1") >= F.col("TrackUID_2"),
        "speed_mean": near(F.col("speed_mean_bl_s"), (F.col("speed_bl_s_1") + F.col("speed_bl_s_2")) / 2),
        "closing_sign": near(F.col("closing_speed_bl_s"), -F.col("approach_rate_bl_s")),
        "proximity": F.col("proximity") != (F.col("centroid_distance_bl") <= NEAR_BL),
        "facing": F.col("mutual_facing") & ~(F.col("facing_1") & F.col("facing_2")),
        "coverage": (F.col("w1s_coverage") < 0) | (F.col("w1s_coverage") > 1),
        "body_lengths": F.abs(F.col("centroid_distance_bl") - scaled) > 1e-5 * (1 + F.abs(scaled)),
        "bearing": F.col("facing_1") != (F.abs(wrap_rad(F.col("bearing_1_rad"))) < FACING_RAD),
    }
    counted = {n: r for n, r in rules.items() if all(c in features.columns for c in _columns_of(n))}
    return features.agg(*[F.sum(F.coalesce(r, F.lit(False)).cast("long")).alias(n) for n, r in counted.items()])


def _columns_of(rule: str) -> list[str]:
    return {"pair_order": ["TrackUID_1"], "speed_mean": ["speed_mean_bl_s"], "closing_sign": ["approach_rate_bl_s"], "proximity": ["proximity"], "facing": ["mutual_facing"], "coverage": ["w1s_coverage"], "body_lengths": ["centroid_distance_px", "centroid_distance_bl"], "bearing": ["bearing_1_rad", "facing_1"]}[rule]


#: What the medians of near-zero distances and of smoothing residuals may be, in body lengths.
ZERO_PX, ZERO_BL, RESIDUAL_BL = 5.0, 0.15, 0.1


def median_checks(features: DataFrame) -> DataFrame:
    """One row: the medians, in body lengths, of distances of at most 5 px and of what smoothing changes, and whether
    both are small. The median of no rows is small."""
    bl, smooth = F.col("centroid_distance_bl"), F.col("centroid_distance_bl_smooth")
    out = features.agg(F.percentile(F.when(F.col("centroid_distance_px") <= ZERO_PX, bl), F.lit(0.5)).alias("near_zero_bl"), F.percentile(F.abs(bl - smooth), F.lit(0.5)).alias("residual_bl"))
    return out.withColumns({"near_zero_ok": F.coalesce(F.col("near_zero_bl") <= ZERO_BL, F.lit(True)), "residual_ok": F.coalesce(F.col("residual_bl") <= RESIDUAL_BL, F.lit(True))})


def isolated_smoothing(features: DataFrame, frame: str = "FrameNum") -> DataFrame:
    """The number of rows of each video's longest episode (ties by its ids) and of those among them whose smoothed
    distance changes when the episode is smoothed alone."""
    ids = [k for k in GROUP if k not in ("project_id", "day_label")]
    sizes = features.groupBy(*GROUP).agg(F.count("*").alias("_n"))
    order = Window.partitionBy("day_label").orderBy(F.desc("_n"), *ids, "project_id")
    longest = sizes.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(*GROUP)
    column = "centroid_distance_bl"
    alone = features.join(longest, GROUP).withColumn("_old", F.col(f"{column}_smooth"))
    alone = add_smoothed(alone, [column], frame=frame)
    changed = ~(F.col("_old").eqNullSafe(F.col(f"{column}_smooth")) | F.coalesce(F.abs(F.col("_old") - F.col(f"{column}_smooth")) <= 1e-8 + 1e-5 * F.abs("_old"), F.lit(False)))
    return alone.groupBy("day_label").agg(F.count("*").alias("n"), F.sum(changed.cast("long")).alias("changed"))


#: The model-facing feature groups.
FEATURE_GROUPS = {
    "distance_proximity": [*[f"{d}_bl" for d in DISTANCES], "centroid_distance_bl_smooth", "proximity"],
    "orientation_facing": ["facing_1", "facing_2", "mutual_facing", *[f"{a}_{f}" for a in ("rel_heading", "bearing_1", "bearing_2") for f in ("sin", "cos")]],
    "speed_closing": [*SPEEDS, "approach_rate_bl_s", "closing_speed_bl_s", "speed_mean_bl_s_smooth"],
    "angular_movement": ["d_orbital_rad_s_clean", "abs_d_orbital_rad_s", "orbital_rate_derived_rad_s", "orbital_accel_rad_s2", "d_heading_1_rad_s_clean", "d_heading_2_rad_s_clean", "heading_rate_abs_mean_rad_s", "corotation", "bend_abs_mean_rad"],
    "temporal_consistency": window_columns(),
}
MODEL_FEATURES = [c for group in FEATURE_GROUPS.values() for c in group]

#: Columns of the feature table, in order.
OUTPUT_COLUMNS = [
    "project_id", "day_index", "day_label", "Time_s", "FrameNum", "TrackID_1", "TrackID_2", "TrackUID_1", "TrackUID_2", "pair_episode_id", "dt_frames", "smooth_segment", "sex_1", "sex_2", "pair_sex",
    *[f"{d}_px" for d in DISTANCES], "orbital_rad", "rel_heading_rad", *BEARINGS, "body_length_px_1", "body_length_px_2", "speed_bl_s_1", "speed_bl_s_2", *[f"{d}_bl" for d in DISTANCES],
    "approach_rate_bl_s", "proximity", "facing_1", "facing_2", "mutual_facing", "speed_mean_bl_s", "speed_diff_bl_s", "closing_speed_bl_s",
    *[f"{c}_smooth" for c in (*[f"{d}_bl" for d in DISTANCES], *BEARINGS, *SPEEDS)],
    "qc_n_missing_kp_1", "qc_n_missing_kp_2", "qc_missing_nose_or_tail", "is_track_start_1", "is_track_end_1", "is_track_start_2", "is_track_end_2",
    *RATES, "bend_angle_rad_1", "bend_angle_rad_2", "qc_bad_body_length", "qc_angular_rate_clipped", *[f"{r}_clean" for r in RATES], "abs_d_orbital_rad_s", "orbital_step_rad", "orbital_rate_derived_rad_s", "orbital_accel_rad_s2",
    "corotation", "heading_rate_abs_mean_rad_s", "bend_abs_mean_rad", *[f"{a}_{f}" for a in ("rel_heading", "bearing_1", "bearing_2") for f in ("sin", "cos")], *window_columns(),
]
