"""Score metrics, feature reports and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.exprs import ratio


def threshold_table(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label", buckets: int = 1 << 12) -> DataFrame:
    """(keys, score, pos, neg, tp, fp): rows by distinct score and how many score at least as much.

    Scores are first summed up; running totals then go over buckets of a hash-free range (ranks of quantised
    scores), so no window holds all distinct scores of a large table.
    """
    by_score = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    bounds = by_score.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    cut = F.floor((F.col("_hi") - F.col("score")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)) * buckets)
    placed = by_score.join(bounds, keys) if keys else by_score.crossJoin(F.broadcast(bounds))
    placed = placed.withColumn("_b", F.coalesce(cut, F.lit(0))).drop("_lo", "_hi")
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    totals = totals.select(*keys, "_b", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_fp"))
    out = placed.join(totals, [*keys, "_b"])
    return out.select(*keys, "score", "pos", "neg", (F.col("_tp") + F.sum("pos").over(inside)).alias("tp"), (F.col("_fp") + F.sum("neg").over(inside)).alias("fp"))


def ranking_metrics(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Average precision over distinct thresholds and ROC AUC (ties count half); null where undefined."""
    rows = threshold_table(scored, keys, score, label)
    total = rows.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))).alias("_auc")
    )
    p, n = F.col("positives"), F.col("negatives")
    return total.select(*keys, "positives", "negatives", ratio(F.col("_ap"), p).alias("average_precision"), ratio(F.col("_auc"), p * n).alias("roc_auc"))


def confusion(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and prevalence at a threshold."""
    hot, yes = F.col(score) >= threshold, F.col(label) == 1
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    rows = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys).agg(count(hot & yes, "tp"), count(hot & ~yes, "fp"), count(~hot & yes, "fn"), count(~hot & ~yes, "tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return rows.select(*keys, "tp", "fp", "fn", "tn", ratio(tp + tn, n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), ratio(tp + fn, n).alias("prevalence"))


def unpivot(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """One row per feature value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(*keys, F.explode(pairs).alias("_f")).select(*keys, "_f.feature", "_f.value")


def feature_report(rows: DataFrame, features: list[str], label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Class means, share missing, Cohen's d (pooled sample variance) and ROC AUC of every feature."""
    long = unpivot(rows, [*keys, label], features).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    by = [*keys, "feature"]
    yes = F.col(label) == 1
    side = lambda c, f: f(F.when(c, F.col("value")))
    stats = long.groupBy(*by).agg(
        side(yes, F.avg).alias("mean_pos"), side(~yes, F.avg).alias("mean_neg"), side(yes, F.var_samp).alias("_vp"), side(~yes, F.var_samp).alias("_vn"), side(yes, F.count).alias("_np"), side(~yes, F.count).alias("_nn"), F.avg(F.col("value").isNull().cast("double")).alias("missing")
    )
    spread = ((F.col("_np") - 1) * F.col("_vp") + (F.col("_nn") - 1) * F.col("_vn")) / F.when(F.col("_np") + F.col("_nn") > 2, F.col("_np") + F.col("_nn") - 2)
    stats = stats.withColumn("cohens_d", ratio(F.col("mean_pos") - F.col("mean_neg"), F.sqrt(spread)))
    auc = ranking_metrics(long, by, "value", label).select(*by, F.col("roc_auc").alias("auc"))
    return stats.join(auc, by, "left").select(*by, "mean_pos", "mean_neg", "missing", "cohens_d", "auc")


def report_summary(by_video: DataFrame, video: str = "video_id") -> DataFrame:
    """Across videos: whether all effects point the same way and the weakest distance of the AUC from one half."""
    return by_video.groupBy("feature").agg(
        (F.abs(F.sum(F.signum("cohens_d"))) == F.count("cohens_d")).alias("same_direction"), F.min(F.abs(F.col("auc") - 0.5)).alias("weakest_auc_gap"), F.avg("cohens_d").alias("mean_d"), F.max("missing").alias("worst_missing")
    )


def correlations(rows: DataFrame, features: list[str], threshold: float = 0.95) -> DataFrame:
    """Pairs of features whose correlation over rows that have both is at least ``threshold`` in size: one pass
    over the rows computes every pair."""
    pairs = [(a, b) for k, a in enumerate(features) for b in features[k + 1 :]]
    if not pairs:
        return rows.sparkSession.createDataFrame([], "a string, b string, correlation double")
    clean = rows.select(*[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features])
    told = clean.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("correlation")) for a, b in pairs]).alias("_all"))
    return told.select(F.explode("_all").alias("p")).select("p.a", "p.b", "p.correlation").where(F.abs("correlation") >= threshold)


def hash_order(column: str, seed: int = 42) -> Column:
    """A reproducible random order of rows by a key."""
    return F.xxhash64(F.lit(seed), F.col(column))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order: top-k in every task, then of the tasks."""
    return rows.orderBy(hash_order(key, seed), key).limit(n)


def stratified_split(rows: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42, chunks: int = 1 << 10) -> DataFrame:
    """Adds ``test``: within each class the share of rows first in hash order, rounded half up.

    Ranks come from counts of hash chunks, so a class is never sorted in one task."""
    h = F.pmod(hash_order(key, seed), F.lit(1 << 40))
    placed = rows.withColumn("_h", h).withColumn("_c", F.floor(F.col("_h") / ((1 << 40) / chunks)))
    sizes = placed.groupBy(label, "_c").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(label)
    before = whole.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(label, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    rank = F.row_number().over(Window.partitionBy(label, "_c").orderBy("_h", key))
    out = placed.join(sizes, [label, "_c"]).withColumn("_rank", rank + F.col("_before"))
    return out.withColumn("test", F.col("_rank") <= F.floor(F.col("_all") * test_share + 0.5)).drop("_h", "_c", "_before", "_all", "_rank")


def balanced_negatives(rows: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """All positives and as many negatives in hash order."""
    n = rows.where(F.col(label) == 1).count()
    return rows.where(F.col(label) == 1).unionByName(sample(rows.where(F.col(label) == 0), key, n, seed))


def histogram2d(rows: DataFrame, x: str, y: str, width: float, height: float, bins_x: int, bins_y: int) -> DataFrame:
    """Counts of equal bins over [0, width] x [0, height], the last ones closed; every bin has a row."""
    bin_of = lambda c, size, n: F.least(F.floor(F.col(c) / (size / n)), F.lit(n - 1))
    held = rows.where(F.col(x).between(0, width) & F.col(y).between(0, height))
    counts = held.groupBy(bin_of(x, width, bins_x).alias("bin_x"), bin_of(y, height, bins_y).alias("bin_y")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(bins_x * bins_y).select(F.floor(F.col("id") / bins_y).alias("bin_x"), (F.col("id") % bins_y).alias("bin_y"))
    return grid.join(counts, ["bin_x", "bin_y"], "left").fillna(0, ["n"])


def quantiles(rows: DataFrame, keys: list[str], column: str, at: tuple[float, ...]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row each."""
    found = rows.groupBy(*keys).agg(F.expr(f"percentile(`{column}`, array({', '.join(f'{q}d' for q in at)}))").alias("_q"))
    return found.select(*keys, F.posexplode("_q").alias("_k", "value")).select(*keys, F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("_k") + 1).alias("q"), "value")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
