"""Tracking artefacts: reflections, keypoint jumps and duplicate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.exprs import inside_polygon

DUPLICATE_PX = 40.0


def flag_tracks(tracks: DataFrame, keys: list[str], floor: list[tuple[float, float]], center: tuple[str, str] = ("X_center", "Y_center"), midline: tuple[str, str] = ("midline_centroid_x", "midline_centroid_y"), length: str = "body_length_px") -> DataFrame:
    """Adds reflection (centre outside the floor outline) and jump (centre further from the midline than the
    video's median body length); unknown positions raise neither."""
    medians = tracks.groupBy(*keys).agg(F.expr(f"percentile(`{length}`, 0.5d)").alias("_median"))
    (x, y), (mx, my) = center, midline
    far = F.hypot(F.col(x) - F.col(mx), F.col(y) - F.col(my)) > F.col("_median")
    out = tracks.join(medians, keys).withColumns({"reflection": F.coalesce(~inside_polygon(F.col(x), F.col(y), floor), F.lit(False)), "jump": F.coalesce(far, F.lit(False))})
    return out.drop("_median")


def flag_pairs(pairs: DataFrame, flagged: DataFrame, keys: list[str], track: str = "track", sides: tuple[str, str] = ("t1", "t2"), distance: str = "dist", closest: float = DUPLICATE_PX) -> DataFrame:
    """Adds reflection and jump if either side has them, duplicate for pairs nearer than ``closest`` and keep."""
    out = pairs
    for k, side in enumerate(sides):
        told = flagged.select(*keys, F.col(track).alias(side), F.col("reflection").alias(f"_r{k}"), F.col("jump").alias(f"_j{k}"))
        out = out.join(told, [*keys, side], "left")
    either = lambda c: F.coalesce(f"_{c}0", F.lit(False)) | F.coalesce(f"_{c}1", F.lit(False))
    out = out.withColumns({"reflection": either("r"), "jump": either("j"), "duplicate": F.coalesce(F.col(distance) < closest, F.lit(False))})
    return out.withColumn("keep", ~(F.col("reflection") | F.col("jump") | F.col("duplicate"))).drop("_r0", "_r1", "_j0", "_j1")


def clean_pairs(flagged: DataFrame) -> DataFrame:
    return flagged.where("keep").drop("reflection", "jump", "duplicate", "keep")


def valid_keys(flagged: DataFrame, keys: list[str], sides: tuple[str, str] = ("t1", "t2")) -> DataFrame:
    return flagged.where("keep").select(*keys, *sides)


def flag_rates(flagged: DataFrame, keys: list[str], flags: tuple[str, ...] = ("reflection", "jump", "duplicate", "keep")) -> DataFrame:
    return flagged.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in flags])
