"""Rule-based signals and the six-condition rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.exprs import TWO_PI, clip01, same_sign
from framewise.operators.frames import windowed

#: Defaults of the six-condition rule.
D_MAX, COS_MAX, W_MIN, QC_MAX = 1.5, -0.2, 0.5, 2
CONDITIONS = ("qc", "fm", "close", "anti", "fast", "corot")


def rule_signals(series: DataFrame, keys: list[str], dist_max: float = 160.0, window: int = 120, share: float = 0.6, fps: float = 30.0) -> DataFrame:
    """turns (size of the summed rotation while close, in turns) and mostly_close over a centred window; null and
    false where less than half a window of frames lies around."""
    half = window // 2
    close = F.coalesce(F.col("dist") < dist_max, F.lit(False)).cast("double")
    rows = series.withColumns({"_close": close, "_step": F.coalesce("rate", F.lit(0.0)) * close / fps})

    def columns(w):
        near = w.rowsBetween(-half, half - 1)
        enough = F.count("*").over(near) >= half
        return {"turns": F.when(enough, F.abs(F.sum("_step").over(near)) / TWO_PI), "close_share": F.when(enough, F.avg("_close").over(near))}

    out = windowed(rows, keys, "frame", half, half - 1, columns)
    return out.withColumn("mostly_close", F.coalesce(F.col("close_share") >= share, F.lit(False))).drop("_close", "_step")


def median_scale(pairs: DataFrame, tracks: DataFrame, keys: list[str], track: str = "TrackUID", length: str = "body_length_px") -> DataFrame:
    """Distances in the mean of both tracks' median lengths, cosine of the relative heading and corotation."""
    medians = tracks.groupBy(*keys, track).agg(F.expr(f"percentile(`{length}`, 0.5d)").alias("_m"))
    out = pairs
    for k in (1, 2):
        out = out.join(medians.select(*keys, F.col(track).alias(f"{track}_{k}"), F.col("_m").alias(f"bl_{k}")), [*keys, f"{track}_{k}"], "left")
    out = out.withColumn("bl_pair", (F.col("bl_1") + F.col("bl_2")) / 2)
    return out.withColumns({"centroid_distance_bl": F.col("centroid_distance_px") / F.col("bl_pair"), "cos_rel_heading": F.cos("rel_heading_rad"), "is_corotating": same_sign(F.col("d_heading_1_rad_s"), F.col("d_heading_2_rad_s"), F.col("d_orbital_rad_s"))})


def six_conditions(df: DataFrame, d_max: float = D_MAX, cos_max: float = COS_MAX, w_min: float = W_MIN, qc_max: int = QC_MAX) -> DataFrame:
    """The six conditions (unknown is no), rule_hit, rule_score in [0, 1] and the first condition that fails."""
    known = lambda c: F.coalesce(c, F.lit(False))
    told = {
        "cond_qc": known((F.col("qc_n_missing_kp_1") <= qc_max) & (F.col("qc_n_missing_kp_2") <= qc_max)),
        "cond_fm": known(F.col("pair_sex") == "FM"),
        "cond_close": known(F.col("centroid_distance_bl") < d_max),
        "cond_anti": known(F.col("cos_rel_heading") < cos_max),
        "cond_fast": known(F.abs("d_orbital_rad_s") >= w_min),
        "cond_corot": known(F.col("is_corotating")),
    }
    hit, reason = F.lit(True), F.lit("hit")
    for c in reversed(CONDITIONS):
        hit, reason = hit & F.col(f"cond_{c}"), F.when(~F.col(f"cond_{c}"), c).otherwise(reason)
    number = lambda c: F.col(c).cast("double")
    score = number("cond_fm") * clip01(1 - F.col("centroid_distance_bl") / d_max) * clip01(-F.col("cos_rel_heading")) * clip01(F.abs("d_orbital_rad_s") / w_min) * number("cond_corot") * number("cond_qc")
    return df.withColumns(told).withColumns({"rule_hit": hit, "rule_score": score, "fail_reason": reason})


def two_thresholds(df: DataFrame, close: str, turns: str, close_min: float, turns_min: float) -> DataFrame:
    """score 1 where both signals reach their thresholds, else 0."""
    hot = (F.col(close) >= close_min) & (F.abs(turns) >= turns_min)
    return df.withColumn("score", F.coalesce(hot, F.lit(False)).cast("double"))


def top_pair(pairs: DataFrame, keys: list[str], distance: str = "dist", sides: tuple[str, str] = ("t1", "t2")) -> DataFrame:
    """The pair that is closest in most frames of a video; ties by frames seen together, median distance, ids."""
    from pyspark.sql import Window

    video, frame = keys
    order = Window.partitionBy(video, frame).orderBy(F.col(distance).asc_nulls_last(), *sides)
    ranked = pairs.withColumn("_first", (F.row_number().over(order) == 1).cast("long"))
    counted = ranked.groupBy(video, *sides).agg(F.sum("_first").alias("closest_frames"), F.count("*").alias("frames"), F.expr(f"percentile(`{distance}`, 0.5d)").alias("median_distance"))
    best = Window.partitionBy(video).orderBy(F.desc("closest_frames"), F.desc("frames"), F.col("median_distance").asc_nulls_last(), *sides)
    return counted.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")


def geometry(pairs: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Distance, angle (null if nearly on one spot) and angular velocity of pairs from their centres."""
    from pyspark.sql import Window

    from framewise.functions.exprs import turn

    dx, dy = F.col("x_2") - F.col("x_1"), F.col("y_2") - F.col("y_1")
    out = pairs.withColumn("distance", F.hypot(dx, dy)).withColumn("angle", F.when(F.col("distance") >= 1e-8, F.atan2(dy, dx)))
    order = Window.partitionBy(*keys).orderBy(frame)
    next_ = F.col(frame) - F.lag(frame).over(order) == 1
    return out.withColumn("angular_velocity", F.when(next_, turn(F.col("angle") - F.lag("angle").over(order)) * 30.0))
