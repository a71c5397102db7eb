"""Frame, segment, ranking and attribute metrics of predicted intervals. One row per video; undefined ratios are
null. Videos come from a dimension table (video_id, num_frames), so a video without spans has a row too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.exprs import overlap, ratio, span_iou
from framewise.operators.spans import merge_spans, overlapping, prorated_labels

#: Thresholds in percent.
TAUS = (10, 25, 50)
MAP_TAUS = (10, 20, 30, 40, 50, 60, 70)
LABEL_TAU, STRICT_TAU = 10, 50
DIRECTIONS = ("CW", "CCW")
KEY = "video_id"


def _sides(gt: DataFrame, pred: DataFrame) -> DataFrame:
    told = pred.select(KEY, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return overlapping(gt.select(KEY, "start", "end"), told, KEY)


def frame_counts(gt: DataFrame, pred: DataFrame, videos: DataFrame) -> DataFrame:
    """MoF, frame counts, precision, recall, F1 and IoU of merged spans."""
    sizes = lambda df, name, n: df.groupBy(KEY).agg(F.sum(F.col("end") - F.col("start") + 1).alias(name), F.count("*").alias(n))
    shared = _sides(gt, pred).groupBy(KEY).agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))).alias("frame_tp"))
    rows = videos.select(KEY, "num_frames").join(sizes(gt, "_g", "gt_segments"), KEY, "left").join(sizes(pred, "_p", "pred_segments"), KEY, "left").join(shared, KEY, "left")
    rows = rows.fillna(0, ["_g", "_p", "frame_tp", "gt_segments", "pred_segments"])
    g, p, tp, n = (F.col(c) for c in ("_g", "_p", "frame_tp", "num_frames"))
    return rows.select(KEY, "num_frames", ratio(n - g - p + 2 * tp, n).alias("mof"), "frame_tp", (p - tp).alias("frame_fp"), (g - tp).alias("frame_fn"), *_frame_ratios(tp, p - tp, g - tp), ratio(tp, g + p - tp).alias("frame_iou"), "gt_segments", "pred_segments")


def _frame_ratios(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [precision.alias("frame_precision"), recall.alias("frame_recall"), F.when(tp > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("frame_f1")]


def segment_text(spans: DataFrame, videos: DataFrame, name: str) -> DataFrame:
    """The sequence of segment labels of each video, 1 for a span and 0 for background, as a string."""
    order = Window.partitionBy(KEY).orderBy("start")
    part = F.concat(F.when(F.col("start") > F.coalesce(F.lag("end").over(order) + 1, F.lit(0)), "0").otherwise(""), F.lit("1"))
    parts = spans.withColumn("_part", part).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("start", "_part"))).alias("_parts"), F.max("end").alias("_last"))
    rows = videos.join(parts, KEY, "left")
    tail = F.when(F.coalesce(F.col("_last") + 1, F.lit(0)) < F.col("num_frames"), "0").otherwise("")
    return rows.select(KEY, F.concat(F.coalesce(F.array_join(F.transform("_parts", lambda p: p["_part"]), ""), F.lit("")), tail).alias(name))


def edit_scores(gt: DataFrame, pred: DataFrame, videos: DataFrame) -> DataFrame:
    """100 * (1 - Levenshtein distance / longer length) of the segment sequences."""
    rows = segment_text(gt, videos, "_g").join(segment_text(pred, videos, "_p"), KEY)
    longest = F.greatest(F.length("_g"), F.length("_p"), F.lit(1))
    return rows.select(KEY, (100 * (1 - F.levenshtein("_g", "_p") / longest)).alias("edit_score"))


def segment_matches(gt: DataFrame, pred: DataFrame, tau: float) -> DataFrame:
    """Pairs of a prediction and its best ground-truth segment (b_start, b_end) with an IoU of at least
    ``tau`` percent; of several predictions with one best segment only the first counts. The best is chosen
    without regard to claims, so two rankings settle what looks like a sequential match."""
    told = gt.select(KEY, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = overlapping(pred.select(KEY, "start", "end"), told, KEY)
    met = met.withColumn("iou", span_iou(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")))
    best = Window.partitionBy(KEY, "start", "end").orderBy(F.desc("iou"), "b_start", "b_end")
    met = met.withColumn("_nth", F.row_number().over(best)).where((F.col("_nth") == 1) & (100 * F.col("iou") >= tau))
    claim = Window.partitionBy(KEY, "b_start", "b_end").orderBy("start", "end")
    return met.withColumn("_nth", F.row_number().over(claim)).where("_nth = 1").drop("_nth")


def f1(tp: Column, pred: Column, gt: Column) -> Column:
    return F.when(tp > 0, 2 * tp / (pred + gt)).otherwise(0.0)


def segment_f1(gt: DataFrame, pred: DataFrame, videos: DataFrame, taus: tuple[int, ...] = TAUS) -> DataFrame:
    """True positives and F1 at each threshold. Matching at the lowest threshold is not that of a higher one, so
    each is matched on its own."""
    counts = lambda df, n: df.groupBy(KEY).agg(F.count("*").alias(n))
    rows = videos.select(KEY).join(counts(gt, "_g"), KEY, "left").join(counts(pred, "_p"), KEY, "left")
    for tau in taus:
        rows = rows.join(counts(segment_matches(gt, pred, tau), f"tp_{tau}"), KEY, "left")
    rows = rows.fillna(0)
    return rows.select(KEY, *[f"tp_{t}" for t in taus], *[f1(F.col(f"tp_{t}"), F.col("_p"), F.col("_g")).alias(f"f1_{t}") for t in taus])


def video_metrics(gt_events: DataFrame, pred_events: DataFrame, videos: DataFrame) -> DataFrame:
    """All frame and segment metrics of each video from raw events, which are merged first."""
    gt, pred = merge_spans(gt_events, [KEY]), merge_spans(pred_events, [KEY])
    return frame_counts(gt, pred, videos).join(edit_scores(gt, pred, videos), KEY).join(segment_f1(gt, pred, videos), KEY)


def summary(rows: DataFrame, taus: tuple[int, ...] = TAUS) -> DataFrame:
    """One overall row: counts are pooled, edit score and frame IoU are means over videos."""
    pooled = ["num_frames", "frame_tp", "frame_fp", "frame_fn", "gt_segments", "pred_segments", *[f"tp_{t}" for t in taus]]
    total = rows.agg(*[F.sum(c).alias(c) for c in pooled], F.avg("edit_score").alias("edit_score"), F.avg("frame_iou").alias("frame_iou"))
    tp, fp, fn, n = (F.col(c) for c in ("frame_tp", "frame_fp", "frame_fn", "num_frames"))
    return total.select(*pooled, "edit_score", "frame_iou", ratio(n - fp - fn, n).alias("mof"), *_frame_ratios(tp, fp, fn), *[f1(F.col(f"tp_{t}"), F.col("pred_segments"), F.col("gt_segments")).alias(f"f1_{t}") for t in taus])


def average_precision(gt: DataFrame, pred: DataFrame, videos: DataFrame, taus: tuple[int, ...] = MAP_TAUS) -> DataFrame:
    """All-point interpolated AP of scored predictions at each temporal-IoU threshold (video_id, tau, ap).

    Ground truth and predictions are inclusive and compared as half-open. Predictions are taken by score, ties by
    row_id, and claim the best segment still free, so matching is one fold over the overlapping pairs of a video,
    for all thresholds; the curve above it is made of windows. Without ground truth AP is null, without predictions 0.
    """
    ranked = pred.withColumn("_rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("score"), "row_id")))
    told = gt.select(KEY, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = overlapping(ranked.select(KEY, "start", "end", "_rank"), told, KEY)
    shared = overlap(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))
    iou = shared / (F.greatest("end", "b_end") - F.least("start", "b_start") + 1)
    # Below the lowest threshold a pair can neither match nor keep another from matching.
    pairs = met.withColumn("iou", iou).where(100 * F.col("iou") >= min(taus)).select(KEY, "_rank", "b_start", "b_end", "iou")
    kind = gt.schema[KEY].dataType.simpleString()

    def claim(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["_rank", "iou", "b_start", "b_end"], ascending=[True, False, True, True])
        rank, percent = pdf["_rank"].to_numpy(), 100 * pdf["iou"].to_numpy()
        segment = pdf.groupby(["b_start", "b_end"]).ngroup().to_numpy()
        edges = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])).tolist()
        hits = []
        for tau in taus:
            taken = np.zeros(segment.max() + 1, bool)
            for a, b in zip(edges, [*edges[1:], len(rank)], strict=True):
                # The best segment that is still free decides, whether or not it reaches the threshold.
                free = np.flatnonzero(~taken[segment[a:b]])
                if len(free) and percent[a + free[0]] >= tau:
                    taken[segment[a + free[0]]] = True
                    hits.append((tau, rank[a]))
        out = pd.DataFrame(hits, columns=["tau", "_rank"], dtype="int32")
        out.insert(0, KEY, pd.Series([pdf[KEY].iloc[0]] * len(out), dtype=object))
        return out

    grid = F.explode(F.array(*[F.lit(t) for t in taus]))
    hits = pairs.groupBy(KEY).applyInPandas(claim, f"`{KEY}` {kind}, tau int, _rank int").withColumn("_hit", F.lit(1))
    sizes = gt.groupBy(KEY).agg(F.count("*").alias("_g"))
    # Only hits carry area, and the precision at a hit needs its rank and how many hits are before it.
    order = Window.partitionBy(KEY, "tau").orderBy("_rank")
    rows = hits.withColumn("_precision", F.row_number().over(order) / F.col("_rank"))
    rows = rows.withColumn("_envelope", F.max("_precision").over(order.rowsBetween(0, Window.unboundedFollowing))).join(sizes, KEY)
    areas = rows.groupBy(KEY, "tau").agg(F.sum(F.col("_envelope") / F.col("_g")).alias("ap"))
    all_ = videos.select(KEY, grid.alias("tau")).join(sizes, KEY, "left").join(areas, [KEY, "tau"], "left")
    return all_.select(KEY, "tau", F.when(F.col("_g").isNotNull(), F.coalesce("ap", F.lit(0.0))).alias("ap"))


def map_columns(aps: DataFrame, taus: tuple[int, ...] = MAP_TAUS) -> DataFrame:
    """One row per video: map_10 ... map_70 and their mean map_avg, null without ground truth."""
    wide = aps.groupBy(KEY).agg(*[F.max(F.when(F.col("tau") == t, F.col("ap"))).alias(f"map_{t}") for t in taus], F.avg("ap").alias("map_avg"))
    return wide


def mean_average_precision(aps: DataFrame) -> DataFrame:
    """map_avg per video: the mean over thresholds, null without ground truth."""
    return aps.groupBy(KEY).agg(F.avg("ap").alias("map_avg"))


def labelled(spans: DataFrame, events: DataFrame) -> DataFrame:
    return prorated_labels(merge_spans(spans, [KEY]), events, KEY)


def matched_labels(gt: DataFrame, pred: DataFrame, tau: float) -> DataFrame:
    """Every prediction with its labels and those of the segment it is matched with (null columns if none)."""
    truth = gt.select(KEY, F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("direction").alias("g_direction"), F.col("cycles").alias("g_cycles"))
    pairs = segment_matches(gt, pred, tau).select(KEY, "start", "end", "b_start", "b_end").join(truth, [KEY, "b_start", "b_end"])
    return pred.select(KEY, "start", "end", "direction", "cycles").join(pairs, [KEY, "start", "end"], "left")


def _count(condition: Column, name: str) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long")).alias(name)


def label_flags(pred: DataFrame) -> DataFrame:
    """One row: whether any prediction of any video has a direction (_d) and cycles (_c)."""
    told = lambda c: F.coalesce(F.max(F.col(c).isNotNull()), F.lit(False))
    return pred.agg(told("direction").alias("_d"), told("cycles").alias("_c"))


def label_counts(gt: DataFrame, pred: DataFrame, videos: DataFrame, tau: float = LABEL_TAU, flags: DataFrame | None = None) -> DataFrame:
    """Joint direction and cycle counts of labelled segments per video (start, end, direction, cycles).

    A predicted d is true if matched with a ground-truth d, ignored if matched with an unknown direction, else
    false. Counts of a label that no prediction of any video has (``flags``, by default of ``pred``) are null; a video
    without predictions has counts of 0 and misses all its segments.
    """
    rows = matched_labels(gt, pred, tau)
    matched, same = F.col("b_start").isNotNull(), F.col("direction") == F.col("g_direction")
    error = F.when(F.col("cycles").isNotNull(), F.col("cycles") - F.col("g_cycles"))
    told = rows.groupBy(KEY).agg(
        *[_count((F.col("direction") == d) & same, f"{d.lower()}_tp") for d in DIRECTIONS],
        *[_count((F.col("direction") == d) & (~matched | (F.col("g_direction").isNotNull() & ~same)), f"{d.lower()}_fp") for d in DIRECTIONS],
        _count(same, "direction_correct"), _count(same.isNotNull(), "direction_matched"),
        F.sum("cycles").alias("pred_cycles"), F.count(error).alias("cycle_pairs"), F.sum(F.abs(error)).alias("_abs"), F.sum(error * error).alias("_square"), F.sum(error).alias("_error"),
    )
    named = [*[f"{d.lower()}_{k}" for d in DIRECTIONS for k in ("tp", "fp")], "direction_correct", "direction_matched"]
    turns = ["pred_cycles", "cycle_pairs", "_abs", "_square", "_error"]
    truth = gt.groupBy(KEY).agg(*[_count(F.col("direction") == d, f"gt_{d.lower()}_segments") for d in DIRECTIONS], F.sum("cycles").alias("gt_cycles"))
    out = videos.select(KEY).join(truth, KEY, "left").join(told, KEY, "left").fillna(0, ["gt_cw_segments", "gt_ccw_segments", "gt_cycles", *named, *turns])
    out = out.crossJoin(F.broadcast(label_flags(pred) if flags is None else flags))
    return out.select(
        KEY, "gt_cw_segments", "gt_ccw_segments", *[F.when(F.col("_d"), F.col(c)).alias(c) for c in named], *[F.when(F.col("_d"), F.col(f"gt_{d.lower()}_segments") - F.col(f"{d.lower()}_tp")).alias(f"{d.lower()}_fn") for d in DIRECTIONS],
        "gt_cycles", *[F.when(F.col("_c"), F.col(c)).alias(c) for c in turns],
    )


def direction_ratios(prefix: str = "") -> list[Column]:
    """Precision, recall and F1 by direction, macro F1 and accuracy from counts with ``prefix``."""
    out, f1s = [], []
    for d in DIRECTIONS:
        tp, fp, fn = (F.col(f"{prefix}{d.lower()}_{k}") for k in ("tp", "fp", "fn"))
        score = ratio(2 * tp, 2 * tp + fp + fn)
        f1s.append(score)
        out += [ratio(tp, tp + fp).alias(f"{prefix}{d.lower()}_precision"), ratio(tp, tp + fn).alias(f"{prefix}{d.lower()}_recall"), score.alias(f"{prefix}{d.lower()}_f1")]
    known = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), 1).otherwise(0) for x in f1s])
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in f1s])
    return [*out, ratio(total, known).alias(f"{prefix}direction_f1"), ratio(F.col(f"{prefix}direction_correct"), F.col(f"{prefix}direction_matched")).alias(f"{prefix}direction_accuracy")]


def cycle_ratios() -> list[Column]:
    n = F.col("cycle_pairs")
    return [ratio(F.col("_abs"), n).alias("cycle_mae"), F.sqrt(ratio(F.col("_square"), n)).alias("cycle_rmse"), ratio(F.col("_error"), n).alias("cycle_bias")]


def label_metrics(counts: DataFrame) -> DataFrame:
    """Per-video ratios of ``label_counts``."""
    return counts.select(*[c for c in counts.columns if not c.startswith("_")], *direction_ratios(), *cycle_ratios())


def pooled_labels(counts: DataFrame) -> DataFrame:
    """Overall row: sums over videos, null if any video's count is null; errors are weighted by pairs. A video's
    errors without pairs weigh nothing."""
    names = [c for c in counts.columns if c != KEY]
    whole = [F.when(F.max(F.col(c).isNull().cast("int")) == 0, F.sum(c)).alias(c) if not c.startswith("_") else F.sum(c).alias(c) for c in names]
    total = counts.agg(*whole)
    return total.select(*[c for c in names if not c.startswith("_")], *direction_ratios(), *cycle_ratios())


def attribute_counts(gt: DataFrame, pred: DataFrame, videos: DataFrame, tau: float = STRICT_TAU) -> DataFrame:
    """Counts of attribute quality on segments matched at a strict threshold; missed and spurious ones don't count."""
    rows = matched_labels(gt, pred, tau).where("b_start is not null")
    g, p = F.col("g_direction"), F.col("direction")
    both = g.isNotNull() & p.isNotNull()
    error = F.col("cycles") - F.col("g_cycles")
    told = rows.groupBy(KEY).agg(
        F.count("*").alias("attribute_pairs"), F.count("g_direction").alias("direction_eligible"), _count(both, "direction_matched"), _count(both & (g == p), "direction_correct"),
        *[x for d in DIRECTIONS for x in (_count(both & (p == d) & (g == d), f"{d.lower()}_tp"), _count(both & (p == d) & (g != d), f"{d.lower()}_fp"), _count(both & (g == d) & (p != d), f"{d.lower()}_fn"))],
        F.count("g_cycles").alias("cycle_eligible"), F.count(error).alias("cycle_pairs"), F.sum(F.abs(error)).alias("_abs"), F.sum(error * error).alias("_square"), F.sum(error).alias("_error"),
        F.sum(F.when(error.isNotNull(), F.col("g_cycles"))).alias("_total"), _count(F.abs(error) <= 0.5, "_half"), _count(F.abs(error) <= 1, "_one"),
    )
    names = [c for c in told.columns if c != KEY]
    return videos.select(KEY).join(told, KEY, "left").fillna(0, names)


def attribute_metrics(counts: DataFrame) -> DataFrame:
    """Ratios of ``attribute_counts`` rows, of one video or pooled."""
    keys = [c for c in counts.columns if not c.startswith("_")]
    recalls = [ratio(F.col(f"{d.lower()}_tp"), F.col(f"{d.lower()}_tp") + F.col(f"{d.lower()}_fn")) for d in DIRECTIONS]
    known = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), 1).otherwise(0) for x in recalls])
    balanced = ratio(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in recalls]), known)
    n = F.col("cycle_pairs")
    return counts.select(
        *keys, *direction_ratios(), balanced.alias("balanced_accuracy"), ratio(F.col("direction_matched"), F.col("direction_eligible")).alias("direction_coverage"), ratio(n, F.col("cycle_eligible")).alias("cycle_coverage"), *cycle_ratios(),
        ratio(F.col("_abs"), F.col("_total")).alias("cycle_wape"), ratio(F.col("_half"), n).alias("within_0p5"), ratio(F.col("_one"), n).alias("within_1"),
    )


def pooled(counts: DataFrame) -> DataFrame:
    return counts.agg(*[F.sum(c).alias(c) for c in counts.columns if c != KEY])


def same_boundaries(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Spans that only one side has, in either direction, with multiplicity; empty if the boundaries are equal."""
    a, b = (x.select(KEY, "start", "end") for x in (gt, pred))
    return a.exceptAll(b).withColumn("side", F.lit("gt")).union(b.exceptAll(a).withColumn("side", F.lit("pred")))


def oracle_attributes(gt: DataFrame, pred: DataFrame, videos: DataFrame) -> DataFrame:
    """Attribute counts of predictions that have exactly the ground truth's boundaries; raises if they differ."""
    if same_boundaries(gt, pred).limit(1).count():
        raise ValueError("predicted spans must have the boundaries of the ground truth")
    return attribute_counts(gt, pred, videos, 100)


def missed_events(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events that overlap no span."""
    told = spans.select(F.col(KEY).alias("_key"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return events.join(told, (F.col(KEY) == F.col("_key")) & (F.col("b_start") <= F.col("end")) & (F.col("b_end") >= F.col("start")), "left_anti")


def mixed_directions(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Spans over which events of both directions lie."""
    told = events.select(KEY, F.col("start").alias("b_start"), F.col("end").alias("b_end"), "direction")
    met = overlapping(spans.select(KEY, "start", "end"), told, KEY).groupBy(KEY, "start", "end").agg(F.countDistinct("direction").alias("directions"))
    return met.where("directions > 1")


def scope(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Videos that only one side names."""
    a, b = gt.select(KEY).distinct(), pred.select(KEY).distinct()
    return a.join(b, KEY, "left_anti").withColumn("missing_in", F.lit("pred")).union(b.join(a, KEY, "left_anti").withColumn("missing_in", F.lit("gt")))
