"""Interval algebra and span detectors. Intervals are inclusive frame ranges (start, end) of a video."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.exprs import TWO_PI, finite, overlap, ratio
from framewise.operators.frames import BLOCK, windowed


def islands(rows: DataFrame, keys: list[str], frame: str = "frame", gap: int = 1, block: int = BLOCK, extra: dict[str, Column] | None = None) -> DataFrame:
    """Runs of rows whose frames are at most ``gap`` apart: start, end, n_rows and ``extra`` aggregates.

    Run starts are found in blocks of frames, so no window holds a whole video; what then runs over a video are
    only the starts.
    """
    marked = windowed(rows, keys, frame, gap, gap, lambda w: {"_first": F.coalesce(F.col(frame) - F.lag(frame).over(w) > gap, F.lit(True))}, block)
    block_of = marked.withColumn("_b", F.floor(F.col(frame) / block))
    inside = Window.partitionBy(*keys, "_b").orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    numbered = block_of.withColumn("_nth", F.sum(F.col("_first").cast("long")).over(inside))
    totals = block_of.groupBy(*keys, "_b").agg(F.sum(F.col("_first").cast("long")).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    runs = numbered.join(totals, [*keys, "_b"]).withColumn("_run", F.col("_before") + F.col("_nth"))
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return runs.groupBy(*keys, "_run").agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("n_rows"), *more).drop("_run")


def merge_spans(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end", touch: int = 1) -> DataFrame:
    """Union of intervals; those that overlap or are at most ``touch`` apart are joined."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) > reach + touch, F.lit(True)).cast("long")
    numbered = intervals.select(*keys, start, end).withColumn("_new", new)
    numbered = numbered.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def positive_runs(frames: DataFrame, keys: list[str], positive: Column, frame: str = "frame") -> DataFrame:
    """Runs of consecutive positive frames."""
    return islands(frames.where(positive).select(*keys, frame), keys, frame).drop("n_rows")


def hysteresis(signals: DataFrame, keys: list[str], turns: str = "turns", close: str = "mostly_close", frame: str = "frame", min_turns: float = 0.75, keep_turns: float | None = 0.4, merge_frames: int = 90, gap_frames: int = 30, min_frames: int = 60) -> DataFrame:
    """Spans from a two-threshold signal.

    A frame is strong with at least ``min_turns`` while mostly close. With ``keep_turns`` whole runs of weaker
    frames that hold a strong one count too. What counts is split where frames are more than ``gap_frames``
    apart, kept if it spans at least ``min_frames`` (last minus first), and joined up to ``merge_frames`` apart.
    """
    near = F.coalesce(F.col(close), F.lit(False))
    strong = F.coalesce(F.col(turns) >= min_turns, F.lit(False)) & near
    if keep_turns is None:
        flagged = signals.where(strong).select(*keys, frame)
        pieces = islands(flagged, keys, frame, gap_frames)
    else:
        weak = F.coalesce(F.col(turns) >= keep_turns, F.lit(False)) & near
        runs = islands(signals.where(weak | strong).select(*keys, frame, strong.cast("int").alias("_strong")), keys, frame, extra={"_strong": F.max("_strong")})
        pieces = merge_spans(runs.where("_strong = 1"), keys, touch=gap_frames)
    kept = pieces.where(F.col("end") - F.col("start") >= min_frames).select(*keys, "start", "end")
    return merge_spans(kept, keys, touch=merge_frames) if merge_frames else kept


def episode_events(hits: DataFrame, keys: list[str], frame: str = "frame", score: str = "rule_score", persist: int = 60, dropout: int = 30, merge: int = 60) -> DataFrame:
    """Events of each pair episode from its hit frames: split where frames are more than ``dropout`` apart, kept
    if they last ``persist`` frames, joined up to ``merge`` apart; n_hit, mean and max score of the hits kept."""
    runs = islands(hits.select(*keys, frame, score), keys, frame, dropout, extra={"_sum": F.sum(score), "max_score": F.max(score)})
    kept = runs.where(F.col("end") - F.col("start") + 1 >= persist)
    order = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce(F.col("start") - F.lag("end").over(order) > merge, F.lit(True)).cast("long")
    numbered = kept.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_rows").alias("n_hit"), F.sum("_sum").alias("_sum"), F.max("max_score").alias("max_score"))
    return joined.select(*keys, "start", "end", "n_hit", (F.col("_sum") / F.col("n_hit")).alias("mean_score"), "max_score")


def majority(frames: DataFrame, keys: list[str], positive: Column, frame: str = "frame", before: int = 15, after: int = 14) -> DataFrame:
    """Adds ``vote``, the share of positive frames around each frame, clipped at the ends of the video."""
    marked = frames.withColumn("_p", F.coalesce(positive, F.lit(False)).cast("double"))
    return windowed(marked, keys, frame, before, after, lambda w: {"vote": F.avg("_p").over(w.rowsBetween(-before, after))}).drop("_p")


def scores_to_spans(frames: DataFrame, keys: list[str], score: str = "score", threshold: float = 0.5, min_length: int = 0, vote: bool = True, frame: str = "frame") -> DataFrame:
    """Threshold, majority vote, runs and minimum length over a dense spine; a score that is not finite counts as 0."""
    hot = F.coalesce(finite(F.col(score)), F.lit(0.0)) >= threshold
    if vote:
        frames, hot = majority(frames, keys, hot, frame), F.col("vote") >= 0.5
    return positive_runs(frames, keys, hot, frame).where(F.col("end") - F.col("start") + 1 >= min_length)


def greedy_spans(frames: DataFrame, key: str, score: str = "score", frame: str = "frame", fps: float = 30.0, threshold: float = 0.5, fraction: float = 0.9, seconds: float = 5.0) -> DataFrame:
    """Windows longer than ``seconds`` with enough positive frames, grown greedily.

    Candidate windows and their counts are found by windows over blocks; only candidates go on to the fold that
    decides in order whether a candidate extends the last span, is skipped, or opens a new one. Raises when read if
    a score is not finite or a video's frames are not consecutive.
    """
    if not (math.isfinite(fps) and fps > 0 and seconds >= 0 and 0 < fraction <= 1 and 0 <= threshold <= 1):
        raise ValueError("fps, seconds, fraction or threshold is out of range")
    length = math.floor(seconds * fps) + 1
    need = math.ceil(fraction * length)
    marked = frames.select(key, frame, (finite(F.col(score)) >= threshold).cast("int").alias("_p"))
    marked = marked.withColumn("_p", F.coalesce("_p", F.raise_error(F.lit("scores must be finite")).cast("int")))
    ordered = Window.partitionBy(key, "_b").orderBy(frame)
    marked = marked.withColumn("_b", F.floor(F.col(frame) / BLOCK)).withColumn("_in", F.sum("_p").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_gap", F.coalesce(F.col(frame) - F.lag(frame).over(ordered) != 1, F.lit(False)))
    totals = marked.groupBy(key, "_b").agg(F.sum("_p").alias("_n"), F.max("_gap").alias("_gap"), F.min(frame).alias("_low"), F.max(frame).alias("_high"))
    blocks = Window.partitionBy(key).orderBy("_b")
    apart = F.col("_gap") | F.coalesce(F.col("_low") - F.lag("_high").over(blocks) != 1, F.lit(False))
    before = F.coalesce(F.sum("_n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(key, "_b", F.when(apart, F.raise_error(F.lit("frames must be consecutive")).cast("long")).otherwise(before).alias("_before"))
    summed = marked.join(totals, [key, "_b"]).select(key, frame, "_p", (F.col("_before") + F.col("_in")).alias("upto"))
    ahead = lambda w: {"_last": F.lead(frame, length - 1).over(w), "upto_end": F.lead("upto", length - 1).over(w)}
    found = windowed(summed, [key], frame, 0, length - 1, ahead)
    found = found.withColumn("before", F.col("upto") - F.col("_p")).where((F.col("upto_end") - F.col("before") >= need) & (F.col("_last") == F.col(frame) + length - 1))
    kind = frames.schema[key].dataType.simpleString()

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values(frame)
        spans: list[list[int]] = []
        for begin, before, upto in zip(pdf[frame].tolist(), pdf["before"].tolist(), pdf["upto_end"].tolist(), strict=True):
            end = begin + length - 1
            if not spans or begin > spans[-1][1] + 1:
                spans.append([begin, end, before, upto])
            elif upto - spans[-1][2] >= math.ceil(fraction * (end - spans[-1][0] + 1)):
                spans[-1][1], spans[-1][3] = end, upto
            elif begin > spans[-1][1]:
                spans.append([begin, end, before, upto])
        out = pd.DataFrame([(k, a, b, hi - lo) for k, (a, b, lo, hi) in enumerate(spans, 1)], columns=["span", "start", "end", "positive_frames"], dtype="int64")
        out.insert(0, key, pd.Series([pdf[key].iloc[0]] * len(out), dtype=object))
        return out

    out = found.select(key, frame, "before", "upto_end").groupBy(key).applyInPandas(fold, f"`{key}` {kind}, span long, start long, end long, positive_frames long")
    count = F.col("end") - F.col("start") + 1
    return out.withColumns({"frame_count": count, "duration_seconds": count / F.lit(float(fps)), "positive_fraction": F.col("positive_frames") / count})


def frames_of(intervals: DataFrame, keys: list[str], columns: tuple[str, ...] = ()) -> DataFrame:
    """A row for every frame of every interval; spans are short, so an equi-join follows instead of a range join."""
    return intervals.select(*keys, *columns, F.explode(F.sequence("start", "end")).alias("frame"))


def frame_labels(frames: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adds label 1 to frames inside any span, 0 to the others."""
    inside = frames_of(merge_spans(spans, keys), keys).withColumn("label", F.lit(1))
    return frames.join(inside, [*keys, "frame"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


#: Frames of a block within which intervals are compared.
NEAR = 1 << 12


def overlapping(a: DataFrame, b: DataFrame, key: str, tolerance: int = 0, how: str = "inner") -> DataFrame:
    """Rows of ``a`` (start, end) and ``b`` (b_start, b_end) that overlap, up to ``tolerance`` frames apart.

    Both sides are joined on the video and the blocks of frames they reach into, so intervals far apart never meet
    and one video is many keys; a pair counts in the first block that both reach. An interval that ends before it
    starts, as one shifted around a video's end, overlaps what holds both of its ends, so the block of its start finds
    it. With ``how`` "left", rows of ``a`` that meet none are kept with nulls.
    """
    block = lambda c: F.floor(c / NEAR)
    reach = lambda low, high: F.explode(F.sequence(block(low), F.greatest(block(low), block(high))))
    low, high = F.col("start") - tolerance, F.col("end") + tolerance
    left = a.withColumn("_block", reach(low, high))
    right = b.withColumnRenamed(key, "_key").withColumn("_near", reach(F.col("b_start"), F.col("b_end")))
    near = (F.col("b_start") <= high) & (F.col("b_end") >= low)
    once = F.col("_block") == F.greatest(block(low), block(F.col("b_start")))
    met = left.join(right, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_near")) & near & once).drop("_block", "_near", "_key")
    if how == "inner":
        return met
    alone = a.join(met.select(*a.columns).distinct(), a.columns, "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def rotation_steps(series: DataFrame, keys: list[str], dist_max: float = 160.0, fps: float = 30.0, window: int = 120) -> DataFrame:
    """Adds ``step``, the turn of a frame while close, and ``local``, its centred sum (null under half a window)."""
    step = F.coalesce(F.col("rate"), F.lit(0.0)) * F.coalesce(F.col("dist") < dist_max, F.lit(False)).cast("double") / fps
    half = window // 2
    near = lambda w: {"local": F.when(F.count("*").over(w.rowsBetween(-half, half - 1)) >= half, F.sum("step").over(w.rowsBetween(-half, half - 1)))}
    return windowed(series.withColumn("step", step), keys, "frame", half, half - 1, near)


def rotation_labels(intervals: DataFrame, steps: DataFrame, key: str, row_id: str = "row_id") -> DataFrame:
    """Direction and cycles of each interval: CW if the local turn is not negative in at least half its frames;
    cycles are the turns of runs of one local direction, added up without sign. An interval beyond the data has
    no direction and 0 cycles; frames beyond it are ignored."""
    inside = frames_of(intervals, [key], (row_id,)).join(steps.select(key, "frame", "step", "local"), [key, "frame"])
    inside = inside.withColumn("_cw", F.coalesce(F.col("local"), F.lit(0.0)) >= 0)
    order = Window.partitionBy(key, row_id).orderBy("frame")
    change = F.coalesce(F.col("_cw") != F.lag("_cw").over(order), F.lit(False)).cast("int")
    runs = inside.withColumn("_change", change).withColumn("_run", F.sum("_change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by_run = runs.groupBy(key, row_id, "_run").agg(F.abs(F.sum("step")).alias("_turn"), F.sum(F.col("_cw").cast("long")).alias("_cws"), F.count("*").alias("_n"))
    told = by_run.groupBy(key, row_id).agg(F.when(F.sum("_cws") * 2 >= F.sum("_n"), "CW").otherwise("CCW").alias("direction"), (F.sum("_turn") / F.lit(TWO_PI)).alias("cycles"))
    return intervals.join(told, [key, row_id], "left").withColumn("cycles", F.coalesce("cycles", F.lit(0.0)))


def prorated_labels(spans: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Direction and cycles of spans from the events that overlap them: the direction with most shared frames
    (the first event's by row_id on ties), and cycles in proportion to the share of each event."""
    told = events.select(key, F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("direction").alias("_d"), F.col("cycles").alias("_c"), "row_id")
    met = overlapping(spans.select(key, "start", "end"), told, key).withColumn("_shared", overlap(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")))
    cycles = met.groupBy(key, "start", "end").agg(F.sum(F.col("_c") * F.col("_shared") / (F.col("b_end") - F.col("b_start") + 1)).alias("cycles"))
    votes = met.where("_d is not null").groupBy(key, "start", "end", "_d").agg(F.sum("_shared").alias("_n"), F.min("row_id").alias("_first"))
    order = Window.partitionBy(key, "start", "end").orderBy(F.desc("_n"), "_first")
    winner = votes.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(key, "start", "end", F.col("_d").alias("direction"))
    on = [key, "start", "end"]
    return spans.select(*on).join(winner, on, "left").join(cycles, on, "left")


def status_at(frames: DataFrame, intervals: DataFrame, keys: list[str], unknown_blocks: bool = True) -> DataFrame:
    """Status of each frame from the statuses of the intervals over it: circling or non-circling if that is the
    only one, else UNKNOWN; with ``unknown_blocks`` an unknown interval counts, otherwise it is passed over."""
    held = intervals if unknown_blocks else intervals.where("status <> 'unknown'")
    inside = frames_of(held, keys, ("status",)).groupBy(*keys, "frame").agg(F.min("status").alias("_a"), F.max("status").alias("_b"))
    found = frames.join(inside, [*keys, "frame"], "left")
    sole = (F.col("_a") == F.col("_b")) & F.col("_a").isin("circling", "non-circling")
    return found.withColumn("status", F.when(sole, F.col("_a")).otherwise("UNKNOWN")).drop("_a", "_b")


def reference_status(frames: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each frame as the browser tells it: unknown intervals are passed over, and a frame that is circling by
    one interval and not by another is a conflict."""
    inside = frames_of(intervals.where(F.col("status").isin("circling", "non-circling")), keys, ("status",)).groupBy(*keys, "frame").agg(F.min("status").alias("_a"), F.max("status").alias("_b"))
    found = frames.join(inside, [*keys, "frame"], "left")
    told = F.when(F.col("_a").isNull(), "UNKNOWN").when(F.col("_a") != F.col("_b"), "CONFLICT").otherwise(F.col("_a"))
    return found.withColumn("status", told).drop("_a", "_b")


def frame_masks(masks: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """A row for every frame inside any of the interval tables, with a boolean for each table; AND, OR and NOT of masks
    are then expressions over one exchange by frame."""
    rows = None
    for name, held in masks.items():
        one = frames_of(merge_spans(held, keys), keys).select(*keys, "frame", *[F.lit(n == name).alias(n) for n in masks])
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*keys, "frame").agg(*[F.max(n).alias(n) for n in masks])


def run_lengths(frames: DataFrame, keys: list[str], value: str, frame: str = "frame") -> DataFrame:
    """Consecutive frames of one value as (value, start, end)."""
    return islands(frames.select(*keys, value, frame), [*keys, value], frame).drop("n_rows")


def buffer_sample(spans: DataFrame, videos: DataFrame, key: str = "video_id", count: str = "num_frames") -> DataFrame:
    """Frames of positive spans and of a buffer of half a span's length (rounded up) on each side, clipped to the
    video and taken once; label 1 inside a span."""
    half = F.floor((F.col("end") - F.col("start") + 2) / 2).cast("long")
    wide = spans.join(videos, key).select(key, F.greatest(F.lit(0), F.col("start") - half).alias("start"), F.least(F.col(count) - 1, F.col("end") + half).alias("end")).where("start <= end")
    return frame_labels(frames_of(merge_spans(wide, [key]), [key]), spans, [key])


def span_scores(spans: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score of the frames of each span."""
    inside = frames_of(spans.select(*keys, "start", "end"), keys, ("start", "end")).join(scores, [*keys, "frame"])
    return spans.join(inside.groupBy(*keys, "start", "end").agg(F.avg("score").alias("span_score")), [*keys, "start", "end"], "left")


def rotate(a: Column, by: Column, size: Column) -> Column:
    """A frame shifted around the end of a video."""
    return F.pmod(a + by, size)


def event_evaluation(labels: DataFrame, spans: DataFrame, key: str, tolerance: int = 30, fps: float = 30.0) -> DataFrame:
    """For each label: hit, pieces, coverage by spans, and signed start and end errors in seconds."""
    met = overlapping(labels.select(key, "start", "end"), spans.select(key, F.col("start").alias("b_start"), F.col("end").alias("b_end")), key, tolerance, "left")
    shared = F.sum(F.coalesce(overlap(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")), F.lit(0)))
    return met.groupBy(key, "start", "end").agg(
        F.count("b_start").alias("pieces"), ratio(shared, F.first(F.col("end") - F.col("start") + 1)).alias("coverage"), ((F.min("b_start") - F.first("start")) / fps).alias("start_err"), ((F.max("b_end") - F.first("end")) / fps).alias("end_err")
    ).withColumn("hit", F.col("pieces") > 0)


def shifted_hits(labels: DataFrame, spans: DataFrame, shifts: DataFrame, key: str, size: str = "num_frames", tolerance: int = 30, wrapped: bool = True) -> DataFrame:
    """Null model: labels hit when all spans of a video are shifted around its end by each given offset. A span whose end
    passes the video's end and whose start doesn't hits labels that hold both, as in the reference, and none if not
    ``wrapped``."""
    moved = spans.join(shifts, key).select(key, "shift", rotate(F.col("start"), F.col("shift"), F.col(size)).alias("b_start"), rotate(F.col("end"), F.col("shift"), F.col(size)).alias("b_end"))
    met = overlapping(labels.select(key, "start", "end"), moved if wrapped else moved.where("b_start <= b_end"), key, tolerance)
    hits = met.select(key, "shift", "start", "end").distinct().groupBy(key, "shift").agg(F.count("*").alias("hits"))
    return shifts.select(key, "shift").join(hits, [key, "shift"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def hash_shifts(videos: DataFrame, key: str, size: str = "num_frames", times: int = 300, seed: int = 0) -> DataFrame:
    """(video, num_frames, shift): reproducible shifts of every video; draws may repeat and then count again."""
    draws = videos.sparkSession.range(times)
    return videos.crossJoin(F.broadcast(draws)).select(key, size, F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), key, "id"), F.col(size)).alias("shift"))


def event_summary(labels: DataFrame, spans: DataFrame, reviewed: DataFrame, shifts: DataFrame, key: str, tolerance: int = 30, fps: float = 30.0) -> DataFrame:
    """One row for each video of ``shifts``: labels caught, labels, mean hits of the shifted null model (without spans
    wrapped around the end), share of label frames covered, mean pieces of the labels caught, median absolute start and
    end errors, seconds detected in reviewed frames without a label, seconds of such frames, and spans. Shares and medians
    of nothing are null."""
    events = event_evaluation(labels, spans, key, tolerance, fps).groupBy(key).agg(
        F.sum(F.col("hit").cast("long")).alias("caught"), F.count("*").alias("events"), F.avg(F.when(F.col("hit"), F.col("pieces"))).alias("pieces"),
        *[F.expr(f"percentile(abs({c}), 0.5d)").alias(c) for c in ("start_err", "end_err")],
    )
    own = shifts.groupBy(key, F.col("shift")).agg(F.count("*").alias("_times"), F.first("num_frames").alias("num_frames"))
    hits = shifted_hits(labels, spans, own.select(key, "num_frames", "shift"), key, "num_frames", tolerance, wrapped=False)
    null = own.join(hits, [key, "shift"]).groupBy(key).agg((F.sum(F.col("hits") * F.col("_times")) / F.sum("_times")).alias("null_hits"))
    of = lambda c: F.sum(c.cast("long"))
    negative = F.col("_rev") & ~F.col("_lab")
    masks = frame_masks({"_det": spans, "_lab": labels, "_rev": reviewed}, [key]).groupBy(key).agg(
        ratio(of(F.col("_det") & F.col("_lab")), of(F.col("_lab"))).alias("coverage"), (of(F.col("_det") & negative) / F.lit(fps)).alias("false_alarm_s"), (of(negative) / F.lit(fps)).alias("reviewed_neg_s")
    )
    found = spans.groupBy(key).agg(F.count("*").alias("episodes"))
    out = null.join(events, key, "left").join(masks, key, "left").join(found, key, "left")
    return out.fillna(0, ["caught", "events", "episodes"]).fillna(0.0, ["false_alarm_s", "reviewed_neg_s"])


def event_recall(labels: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Each label with the number of detected events that overlap it."""
    met = overlapping(labels.select(key, "start", "end"), events.select(key, F.col("start").alias("b_start"), F.col("end").alias("b_end")), key, 0, "left")
    return met.groupBy(key, "start", "end").agg(F.count("b_start").alias("n_events"))


def recall_of(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Labels met, labels and their ratio."""
    out = counted.groupBy(*keys).agg(F.sum((F.col("n_events") > 0).cast("long")).alias("found"), F.count("*").alias("labels"))
    return out.withColumn("recall", ratio(F.col("found"), F.col("labels")))


def clip_table(labels: DataFrame, videos: DataFrame, poses: DataFrame | None, key: str = "video_id", fps: float = 30.0, present: DataFrame | None = None) -> DataFrame:
    """The status table of clips of labelled events: name, frames, seconds, and whether the video has a pose table
    (``present``, else the videos of ``poses``); an event of an unknown video has no row."""
    held = (present if present is not None else poses).select(key).distinct().withColumn("_has", F.lit(True))
    rows = labels.join(videos.select(key).distinct(), key, "left_semi").join(held, key, "left")
    n = F.col("end") - F.col("start") + 1
    known = lambda c: F.when(F.col("_has"), c)
    return rows.select(
        F.format_string("%s__f%d-%d.mp4", key, "start", "end").alias("clip"), key, known(F.col("start")).alias("start_frame"), known(F.col("end")).alias("stop_frame"),
        known(F.round(n / F.lit(fps), 3)).alias("duration_s"), known(n).alias("n_frames"), F.when(F.col("_has"), "ok").otherwise("skipped (no parquet)").alias("status"),
    )
