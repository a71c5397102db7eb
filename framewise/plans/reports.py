"""Markdown reports of small results: data quality, features, held-out experiments and shipped detectors.

A report takes tables of a row for each video, variant, model or feature; their sizes don't follow the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.operators.qc import grid

#: The measures that experiment tables show, by column.
MEASURES = {"f1_10": "F1@10", "f1_25": "F1@25", "f1_50": "F1@50", "edit_score": "Edit", "frame_precision": "Frame P", "frame_recall": "Frame R", "frame_f1": "Frame F1", "pred_segments": "Segments"}
MOST_FEATURES, MOST_FLIPPED, MOST_PAIRS, MOST_VARIANTS = 25, 20, 25, 8


def _section(title: str, *parts: str) -> str:
    return "\n\n".join([f"## {title}", *parts])


def _document(title: str, *parts: str) -> str:
    return "\n\n".join([f"# {title}", *parts]) + "\n"


def _measures(rows: DataFrame, name: str, title: str) -> str:
    return grid(rows.select(F.col(name).alias(title), *[F.col(c).alias(t) for c, t in MEASURES.items() if c in rows.columns]))


def quality_report(stats: DataFrame, joined: DataFrame, medians: DataFrame | None = None) -> str:
    """Per-video statistics, how many pairs lack a track (columns n, unmatched_1, unmatched_2 of one row), and what to
    treat carefully."""
    n, a, b = joined.select("n", "unmatched_1", "unmatched_2").first()
    told = f"All {n:,} pair rows have both tracks." if not a and not b else f"Of {n:,} pair rows {a:,} lack the first track and {b:,} the second."
    parts = [grid(stats), _section("Join", told)]
    if medians is not None:
        parts.append(_section("Values to treat carefully", grid(medians)))
    return _document("Data quality", *parts)


def feature_document(prevalence: DataFrame, summary: DataFrame, redundant: DataFrame) -> str:
    """Rows and positives of each video, the strongest features of one direction, those whose direction differs
    between videos, and features that nearly repeat another.

    ``summary`` has a row for each feature (feature, weakest_auc_gap, same_direction), ``redundant`` pairs (feature_a,
    feature_b, abs_corr)."""
    by_gap = summary.orderBy(F.desc_nulls_last("weakest_auc_gap"), "feature")
    strongest = by_gap.where("same_direction").drop("same_direction").limit(MOST_FEATURES)
    flipped = summary.where("NOT same_direction")
    names = "\n".join(f"- `{r['feature']}`" for r in by_gap.where("NOT same_direction").limit(MOST_FLIPPED).collect())
    return _document(
        "Features of positive and other frames",
        "Rows are frames with a valid pair. An AUC of 0.5 carries no signal. Choose candidates here, not by a held-out video.",
        grid(prevalence),
        _section("Strongest features, one direction in all videos", grid(strongest)),
        _section(f"Features whose direction differs between videos: {flipped.count()}", *([names] if names else [])),
        _section(f"Near-duplicate features: {redundant.count()} pairs", grid(redundant.orderBy(F.desc("abs_corr"), "feature_a", "feature_b").limit(MOST_PAIRS))),
    )


def experiment_document(results: DataFrame) -> str:
    """Overall rows of all variants, best segment F1 first. ``results`` has variant, video_id (``overall`` for pooled rows)
    and the measures."""
    videos = sorted(r[0] for r in results.where("video_id <> 'overall'").select("video_id").distinct().collect())
    return _document("Leave-one-video-out results", f"Each of {', '.join(videos)} is held out once; overall rows pool the held-out videos.", _measures(_best(results), "variant", "Variant"))


def _best(results: DataFrame) -> DataFrame:
    return results.where("video_id = 'overall'").orderBy(F.desc_nulls_last("f1_50"), "variant")


def comparison_document(shipped: dict[str, DataFrame], results: DataFrame) -> str:
    """Shipped detectors, seen videos included, beside the held-out variants and the best variants' single videos.
    A detector's table has a row for each video and an overall one."""
    named = None
    for name, rows in shipped.items():
        one = rows.withColumn("_name", F.concat(F.lit(f"{name} ("), "video_id", F.lit(")"))).withColumns({"_last": F.col("video_id") == "overall", "_detector": F.lit(name)})
        named = one if named is None else named.unionByName(one, allowMissingColumns=True)
    if named is None:
        raise ValueError("no shipped detectors")
    top = _best(results).limit(MOST_VARIANTS).select("variant", F.col("f1_50").alias("_f1"))
    single = results.where("video_id <> 'overall'").join(top, "variant").withColumn("_name", F.concat("variant", F.lit(" (test "), "video_id", F.lit(")")))
    return _document(
        "Shipped detectors and shared features",
        _section("Shipped detectors, not held out", _measures(named.orderBy("_detector", "_last", "video_id"), "_name", "Detector")),
        _section("Held out, pooled", _measures(_best(results), "variant", "Variant")),
        _section("Held out, best variants by video", _measures(single.orderBy(F.desc("_f1"), "variant", "video_id"), "_name", "Variant")),
    )


def write_text(df: DataFrame, text: str, path: str) -> None:
    """A report as one text file below ``path``, on any file system that Spark writes to."""
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
