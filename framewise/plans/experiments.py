"""Leave-one-video-out experiments: folds, post-processing grids, rule fits and importances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators import evaluate, scoring, spans
from framewise.operators.frames import dense, spine, zero_filled

#: The grids of post-processing and of the rule, in the order in which equals are preferred.
THRESHOLDS = tuple(round(k / 20, 2) for k in range(1, 20))
LENGTHS = (0, 90, 150, 300)
RULE_CLOSE = (0.5, 0.6, 0.7, 0.8, 0.9)
RULE_TURNS = (0.25, 0.5, 0.75, 1.0, 1.5)
LEARNERS = ("logreg", "hgb", "xgb")


@dataclass(frozen=True)
class Variant:
    name: str
    learner: str
    groups: tuple[str, ...] = ()


def variants(groups: dict[str, list[str]]) -> list[Variant]:
    """42 variants, under the names that result tables use: the rule; for every learner all groups, with aggregates, the groups without angles and windows,
    all but each group, the baselines' columns and everything; and for the linear model each group alone."""
    names = tuple(groups)
    early = ("distance_proximity", "orientation_facing", "speed_closing")
    sets = {"all": names, "all_agg": (*names, "agg"), "v1_features": early, **{f"no_{n}": tuple(x for x in names if x != n) for n in names}}
    sets |= {"their_lr102": ("lr",), "their_win155": ("win",), "their_both": ("lr", "win"), "mine_plus_their": (*names, "agg", "lr", "win")}
    out = [Variant("rule_shared", "rule"), *[Variant(f"{learner}_{k}", learner, v) for learner in LEARNERS for k, v in sets.items()]]
    return [*out, *[Variant(f"logreg_only_{n}", "logreg", (n,)) for n in names]]


def columns_of(variant: Variant, groups: dict[str, list[str]], columns: list[str]) -> list[str]:
    """Feature columns of a variant: those of its groups; agg, lr and win stand for columns with that prefix."""
    out: list[str] = []
    for g in variant.groups:
        out += groups.get(g, [c for c in columns if c.startswith(f"{g}_")])
    return out


def folds(videos: list[str]) -> list[tuple[list[str], str]]:
    return [([v for v in videos if v != test], test) for test in videos]


def inner_blocks(rows: DataFrame, video: str = "video_id", frame: str = "frame", blocks: int = 4) -> DataFrame:
    """Adds ``block``: which of ``blocks`` quantile ranges of its video's frames a row is in, the last one closed."""
    at = ", ".join(f"{k / blocks}d" for k in range(1, blocks))
    edges = rows.groupBy(video).agg(F.expr(f"percentile(`{frame}`, array({at}))").alias("_edges"))
    held = rows.join(edges, video)
    return held.withColumn("block", F.size(F.filter("_edges", lambda e: e <= F.col(frame)))).drop("_edges")


def inner_folds(rows: DataFrame, video: str = "video_id", frame: str = "frame", blocks: int = 4, buffer: int = 300) -> DataFrame:
    """A row for every (fold, row): role test inside the fold's block, buffer near it, else train."""
    held = inner_blocks(rows, video, frame, blocks)
    ranges = held.groupBy(video, F.col("block").alias("fold")).agg(F.min(frame).alias("_lo"), F.max(frame).alias("_hi"))
    met = held.join(ranges, video)
    role = F.when(F.col("block") == F.col("fold"), "test").when(F.col(frame).between(F.col("_lo") - buffer, F.col("_hi") + buffer), "buffer").otherwise("train")
    return met.withColumn("role", role).drop("_lo", "_hi")


POOLED = ("frame_tp", "frame_fp", "frame_fn", "tp_50", "pred_segments", "gt_segments")


def _grid(spark, names: list[str], values: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(k, *[float(x) for x in v]) for k, v in enumerate(values)], ", ".join(["cell int", *[f"{n} double" for n in names]]))


def cell_counts(scores: DataFrame, positive, cells: DataFrame, gt: DataFrame, videos: DataFrame, lengths=LENGTHS, vote: bool = True) -> DataFrame:
    """Counts of every video for every cell and minimum length (``nth``, in the order of the grid). All cells run as one
    plan: the cell is part of the video's key. Minimum lengths only filter the runs, so scores are spread over the
    cells alone."""
    spark = scores.sparkSession
    keys = ["video_id", "cell"]
    spread = scores.crossJoin(F.broadcast(cells))
    hot, condition = (spans.majority(spread, keys, positive), F.col("vote") >= 0.5) if vote else (spread, positive)
    runs = spans.positive_runs(hot, keys, condition)
    sizes = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "_k int, min_length int")
    grid = cells.crossJoin(sizes).withColumn("nth", F.col("cell") * len(lengths) + F.col("_k"))
    found = runs.join(F.broadcast(grid.select("cell", "nth", "min_length")), "cell").where(F.col("end") - F.col("start") + 1 >= F.col("min_length"))
    keyed = lambda df: df.withColumn("video_id", F.concat_ws("#", "video_id", "nth"))
    every = lambda df: keyed(df.crossJoin(F.broadcast(grid.select("nth"))))
    rows = evaluate.video_metrics(every(gt.select("video_id", "start", "end")), keyed(found.select("video_id", "nth", "start", "end")), every(videos))
    name = F.col("video_id")
    rows = rows.select(F.element_at(F.split(name, "#"), -1).cast("int").alias("nth"), F.regexp_replace(name, "#[0-9]+$", "").alias("video_id"), *POOLED)
    return rows.join(F.broadcast(grid.drop("_k")), "nth")


def objective(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled segment F1 at 50 and frame F1 of rows with equal keys."""
    total = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in POOLED])
    tp = F.col("frame_tp")
    frame_f1 = F.when(tp > 0, 2 * tp / (2 * tp + F.col("frame_fp") + F.col("frame_fn"))).otherwise(0.0)
    f1_50 = F.when(F.col("tp_50") > 0, 2 * F.col("tp_50") / (F.col("pred_segments") + F.col("gt_segments"))).otherwise(0.0)
    return total.select(*keys, f1_50.alias("f1_50"), frame_f1.alias("frame_f1"))


def grid_metrics(scores: DataFrame, gt: DataFrame, videos: DataFrame, thresholds=THRESHOLDS, lengths=LENGTHS, vote: bool = True) -> DataFrame:
    """Pooled metrics of every cell of a threshold x minimum-length grid."""
    cells = _grid(scores.sparkSession, ["threshold"], [(t,) for t in thresholds])
    counts = cell_counts(scores, F.col("score") >= F.col("threshold"), cells, gt, videos, lengths, vote)
    return objective(counts, ["nth", "threshold", "min_length"])


def choose_postprocess(scores: DataFrame, gt: DataFrame, videos: DataFrame, thresholds=THRESHOLDS, lengths=LENGTHS) -> DataFrame:
    """The best cell by segment F1 at 50, then frame F1, then order of the grid."""
    return grid_metrics(scores, gt, videos, thresholds, lengths).orderBy(F.desc("f1_50"), F.desc("frame_f1"), "nth").limit(1).drop("nth")


def rule_counts(rows: DataFrame, gt: DataFrame, videos: DataFrame, closes=RULE_CLOSE, turns=RULE_TURNS, lengths=LENGTHS, close: str = "close", turn: str = "turns") -> DataFrame:
    """Counts of every video for every pair of thresholds and minimum length; a frame without a row is negative."""
    cells = _grid(rows.sparkSession, ["close_min", "turns_min"], [(a, b) for a in closes for b in turns])
    full = dense(spine(videos), rows.select("video_id", "frame", F.col(close).alias("_close"), F.col(turn).alias("_turn")), ["video_id", "frame"])
    hot = F.coalesce((F.col("_close") >= F.col("close_min")) & (F.abs("_turn") >= F.col("turns_min")), F.lit(False))
    return cell_counts(full, hot, cells, gt, videos, lengths)


RULE = ["close_min", "turns_min", "min_length"]


def fit_rule(rows: DataFrame, gt: DataFrame, videos: DataFrame, closes=RULE_CLOSE, turns=RULE_TURNS, lengths=LENGTHS) -> DataFrame:
    """One row: the thresholds and minimum length with the best pooled segment F1 at 50, then frame F1, on the given
    videos; the first of equals."""
    found = objective(rule_counts(rows, gt, videos, closes, turns, lengths), ["nth", *RULE])
    return found.orderBy(F.desc("f1_50"), F.desc("frame_f1"), "nth").limit(1).drop("nth")


def rule_folds(rows: DataFrame, gt: DataFrame, videos: DataFrame, closes=RULE_CLOSE, turns=RULE_TURNS, lengths=LENGTHS) -> DataFrame:
    """For each video the rule fitted on all others, and its own metrics under it. Every video is counted once for
    every cell; a fold's training counts are the sums over all videos less its own."""
    counts = rule_counts(rows, gt, videos, closes, turns, lengths).select("video_id", "nth", *RULE, *POOLED)
    whole = counts.groupBy("nth").agg(*[F.sum(c).alias(f"_{c}") for c in POOLED])
    rest = counts.join(whole, "nth").select("video_id", "nth", *RULE, *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in POOLED])
    fitted = objective(rest, ["video_id", "nth", *RULE])
    best = Window.partitionBy("video_id").orderBy(F.desc("f1_50"), F.desc("frame_f1"), "nth")
    fitted = fitted.withColumn("_first", F.row_number().over(best)).where("_first = 1").select("video_id", "nth", *RULE, F.col("f1_50").alias("train_f1_50"), F.col("frame_f1").alias("train_frame_f1"))
    judged = objective(counts, ["video_id", "nth"])
    return fitted.join(judged, ["video_id", "nth"]).drop("nth").withColumnRenamed("video_id", "test_video")


def run_fold(rows: DataFrame, features: list[str], fit, predict, test: str, gt: DataFrame, videos: DataFrame) -> DataFrame:
    """Out-of-fold scores choose the post-processing, a fit on all training videos scores the test video:
    its spans with their mean score."""
    train = rows.where(F.col("video_id") != test)
    roles = inner_folds(train)
    parts = None
    for k in range(4):
        fold = roles.where(F.col("fold") == k)
        held = predict(fit(fold.where("role = 'train'"), features), fold.where("role = 'test'")).select("video_id", "frame", "score")
        parts = held if parts is None else parts.union(held)
    known = videos.where(F.col("video_id") != test)
    best = choose_postprocess(zero_filled(spine(known), parts, ["video_id", "frame"]), gt.where(F.col("video_id") != test), known).first()
    scored = predict(fit(train, features), rows.where(F.col("video_id") == test)).select("video_id", "frame", "score")
    full = zero_filled(spine(videos.where(F.col("video_id") == test)), scored, ["video_id", "frame"])
    found = spans.scores_to_spans(full, ["video_id"], threshold=best["threshold"], min_length=best["min_length"])
    return spans.span_scores(found, full, ["video_id"])


def run_variant(variant: Variant, rows: DataFrame, features: list[str], gt: DataFrame, videos: DataFrame, quick: bool = False, sink: str | None = None) -> DataFrame:
    """A row of metrics for each held-out video and an overall one. With ``sink`` the held-out spans are written there
    as CSV, by video. The videos are few and named by a table."""
    from framewise.plans import models
    from framewise.sources.intervals import export_scored

    if variant.learner == "rule":
        best = rule_folds(rows, gt, videos).withColumnRenamed("test_video", "video_id")
        best = rows.sparkSession.createDataFrame(best.collect(), best.schema)  # a row for each video
        hot = dense(spine(videos), rows.select("video_id", "frame", "close", "turns"), ["video_id", "frame"]).join(F.broadcast(best), "video_id")
        score = F.coalesce((F.col("close") >= F.col("close_min")) & (F.abs("turns") >= F.col("turns_min")), F.lit(False)).cast("double")
        full = hot.select("video_id", "frame", score.alias("score"))
        found = spans.scores_to_spans(full, ["video_id"]).join(F.broadcast(best.select("video_id", "min_length")), "video_id")
        found = spans.span_scores(found.where(F.col("end") - F.col("start") + 1 >= F.col("min_length")).drop("min_length"), full, ["video_id"])
    else:
        found = None
        for _, test in folds(sorted(r[0] for r in videos.select("video_id").collect())):
            one = run_fold(rows, features, models.learner(variant.learner, quick), models.predict, test, gt, videos)
            found = one if found is None else found.unionByName(one)
    found = found.cache()  # the metrics read the few spans several times
    if sink:
        out = export_scored(found)
        out.repartition("VideoID").withColumn("video_id", F.col("VideoID")).write.mode("overwrite").option("header", True).partitionBy("video_id").csv(sink)
    per_video = evaluate.video_metrics(gt.select("video_id", "start", "end"), found.select("video_id", "start", "end"), videos)
    table = per_video.unionByName(evaluate.summary(per_video).withColumn("video_id", F.lit("overall")), allowMissingColumns=True)
    return table.select(F.lit(variant.name).alias("variant"), "*")


def permutation_importance(predict, rows: DataFrame, features: list[str], key: str, repeats: int = 2) -> list[tuple[str, float]]:
    """Mean loss of average precision when a feature's values are dealt out anew by a hash of the key."""
    score = lambda df: scoring.ranking_metrics(predict(df), []).first()["average_precision"]
    whole = score(rows)
    out = []
    chunk = F.pmod(F.xxhash64(key), F.lit(256))
    for f in features:
        lost = 0.0
        for seed in range(repeats):
            # Values move within chunks of a hash, so no task sorts the whole column.
            one = rows.withColumn("_c", chunk)
            there = one.select("_c", F.row_number().over(Window.partitionBy("_c").orderBy(scoring.hash_order(key, seed))).alias("_n"), F.col(f).alias("_v"))
            here = one.withColumn("_n", F.row_number().over(Window.partitionBy("_c").orderBy(key)))
            lost += whole - score(here.join(there, ["_c", "_n"]).drop(f).withColumnRenamed("_v", f))
        out.append((f, lost / repeats))
    return sorted(out, key=lambda x: -x[1])


def compare(overall: dict[str, DataFrame]) -> DataFrame:
    """Overall rows of several models as one table, best segment F1 first."""
    out = None
    for name, row in overall.items():
        one = row.select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.orderBy(F.desc("f1_50"), "model")
