"""Readers and writers of interval files. Intervals are inclusive frame ranges."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.functions.exprs import direction, hms, seconds_of, truth, whole_frame
from framewise.operators.spans import merge_spans

#: Spellings of the columns after all but letters is dropped.
NAMES = {
    "video_id": ("videoid",),
    "start": ("startframe",),
    "end": ("endframe",),
    "behavior": ("behavior", "primarylabelbehavior"),
    "direction": ("rotationdirection", "direction"),
    "cycles": ("noofturnscircles", "cycles", "turns"),
    "score": ("score",),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts; quoted fields may hold line breaks. Empty texts are null, rows of nulls go."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    blank = df.select(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")).alias(c) for c in df.columns])
    return blank.where(F.coalesce(*[F.col(f"`{c}`") for c in df.columns]).isNotNull())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path)


def column_of(df: DataFrame, kind: str) -> str | None:
    """The column that has one of the spellings of ``kind``, earlier spellings first."""
    plain = {"".join(x for x in c.lower() if "a" <= x <= "z"): c for c in reversed(df.columns)}
    return next((plain[n] for n in NAMES[kind] if n in plain), None)


def _checked(wrong: Column, message: str, value: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def read_intervals(spark: SparkSession, path: str, labels: bool = False, scores: bool = False, behavior: str | None = None) -> DataFrame:
    """video_id, row_id, start, end [, direction, cycles] [, score] of an interval file; see ``intervals_of``."""
    return intervals_of(read_csv(spark, path), path, labels, scores, behavior)


def intervals_of(df: DataFrame, path: str = "intervals", labels: bool = False, scores: bool = False, behavior: str | None = None, row_id: str | None = None) -> DataFrame:
    """video_id, row_id, start, end [, direction, cycles] [, score] of a table of texts.

    Headers match by letters only. With ``behavior`` and a column of behaviours only its rows stay, compared without
    case and outer spaces; rows that name none go. Frames must be whole and in order; a negative count of cycles, an
    unknown direction or a score that is not finite raises when the row is read. A column of labels or scores that the
    table lacks is null.
    """
    found = {k: column_of(df, k) for k in NAMES}
    missing = [k for k in ("video_id", "start", "end") if found[k] is None]
    if missing:
        raise ValueError(f"{path} has no column for {', '.join(missing)}")
    text = lambda k: F.col(f"`{found[k]}`")
    if behavior is not None and found["behavior"] is not None:
        df = df.where(F.lower(F.trim(text("behavior"))) == behavior.lower())
    df = df.withColumn("_row", F.col(row_id) if row_id else F.monotonically_increasing_id())
    start, end = whole_frame(text("start")), whole_frame(text("end"))
    broken = start.isNull() | end.isNull() | (start < 0) | (end < start)
    columns = [F.trim(text("video_id")).alias("video_id"), F.col("_row").alias("row_id"), start.alias("start"), F.when(broken, F.raise_error(F.lit(f"{path}: not an interval")).cast("long")).otherwise(end).alias("end")]
    if labels:
        told = direction(text("direction")) if found["direction"] else F.lit(None).cast("string")
        if found["direction"]:
            unknown = text("direction").isNotNull() & told.isNull()
            told = F.when(unknown, F.raise_error(F.concat(F.lit("unknown direction: "), text("direction")))).otherwise(told)
        turns = F.lit(None).cast("double")
        if found["cycles"]:
            turns = F.expr(f"try_cast(`{found['cycles']}` as double)")
            turns = _checked(turns < 0, f"{path}: negative cycles", turns)
        columns += [told.alias("direction"), turns.alias("cycles")]
    if scores:
        value = F.expr(f"try_cast(`{found['score']}` as double)") if found["score"] else F.lit(None).cast("double")
        bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        columns.append((_checked(bad, f"{path}: a score is not finite", value) if found["score"] else value).alias("score"))
    return df.select(*columns)


def interval_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Paths of a folder's files in order of their names, on any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath()) for f in found or [])


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.csv", **how) -> tuple[DataFrame, list[str]]:
    """All intervals of a folder's files, and the videos that the files' names declare, also those without rows."""
    paths = interval_files(spark, folder, pattern)
    if not paths:
        raise FileNotFoundError(f"{folder}: no interval files")
    return read_many(spark, paths, **how), [video_of_name(p) for p in paths]


def read_annotations(spark: SparkSession, folder: str, behavior: str = "circling", pattern: str = "circling_annotations_vid*.csv") -> DataFrame:
    """Labelled events of one behaviour from every annotation file of a folder."""
    return read_folder(spark, folder, pattern, labels=True, behavior=behavior)[0]


def read_many(spark: SparkSession, paths: list[str], **how) -> DataFrame:
    """Union of interval files; raises if there are none. Rows are numbered in the order of the paths, then in that of
    their file."""
    if not paths:
        raise ValueError("no interval files")
    out = None
    for k, path in enumerate(paths):
        one = read_intervals(spark, path, **how).withColumn("source", F.lit(posixpath.basename(path)))
        one = one.withColumn("row_id", F.lit(k << 44) + F.col("row_id"))
        out = one if out is None else out.unionByName(one)
    return out


def video_of_name(path: str) -> str:
    """The video id in a file name, without its extension."""
    return posixpath.basename(path).rsplit(".", 1)[0]


def usable_spans(df: DataFrame, video: str = "VideoID", start: str = "StartFrame", end: str = "EndFrame") -> DataFrame:
    """Spans of the behaviour, if the table names any, that are flagged circling and to be used, as far as it has
    these flags (true or 1); merged per video. A frame that is not whole, or an end before its start, raises."""
    plain = {"".join(c.lower().split()): c for c in reversed(df.columns)}
    column = lambda name: F.col(f"`{plain.get(name.lower(), name)}`")
    told = next((plain[n] for n in ("behavior", "primarylabel/behavior") if n in plain), None)
    if told:
        df = df.where(F.lower(F.trim(F.col(f"`{told}`").cast("string"))) == "circling")
    for flag in ("Circling", "ShouldUse"):
        if flag in df.columns:
            df = df.where(F.lower(F.col(flag).cast("string")).isin("true", "1"))
    a, b = whole_frame(column(start)), whole_frame(column(end))
    broken = a.isNull() | b.isNull() | (a < 0) | (b < a)
    rows = df.select(column(video).cast("string").alias("video_id"), a.alias("start"), F.when(broken, F.raise_error(F.lit("not an interval")).cast("long")).otherwise(b).alias("end"))
    return merge_spans(rows, ["video_id"])


def seed_spans(df: DataFrame, videos: dict[str, str], fps: float = 30.0) -> DataFrame:
    """Seed spans with their video, seconds and times of day."""
    names = F.create_map(*[F.lit(x) for pair in videos.items() for x in pair]) if videos else F.create_map()
    rows = df.select("ProjectID", F.col("StartFrame").cast("long").alias("start"), F.col("StopFrame").cast("long").alias("end"))
    rows = rows.withColumns({"video_id": names[F.col("ProjectID")], "start_s": F.col("start") / F.lit(fps), "end_s": F.col("end") / F.lit(fps)})
    return rows.withColumns({"start_hms": hms(F.col("start_s")), "end_hms": hms(F.col("end_s")), "duration_s": F.col("end_s") - F.col("start_s")})


def viewer_intervals(df: DataFrame, video: str, fps: float = 30.0, kind: str = "annotation", verified: bool = False, end_exclusive: bool = False) -> DataFrame:
    """start, end, status and notes of one video's intervals from frames or times, whichever the file has."""
    first = lambda *names: next((n for n in names if n in df.columns), None)
    start, end = first("StartFrame", "start_frame", "Start Frame", "StartTime"), first("EndFrame", "end_frame", "End Frame", "EndTime")
    name = first("VideoID", "video_id", "video")
    held = df if name is None else df.where(F.col(name).isNull() | (F.col(name).cast("string") == video))
    held = held.where(F.col(f"`{start}`").isNotNull() & F.col(f"`{end}`").isNotNull())
    if "Time" in start:
        a, b = F.round(seconds_of(F.col(start)) * fps).cast("long"), F.round(seconds_of(F.col(end)) * fps).cast("long") - 1
    else:
        a, b = whole_frame(F.col(f"`{start}`")), whole_frame(F.col(f"`{end}`")) - int(end_exclusive)
    if kind == "prediction":
        status = F.lit("prediction")
    elif "ShouldUse" in df.columns:
        circling = truth(F.col("Circling")) if "Circling" in df.columns else F.lit(False)
        status = F.when(truth(F.col("ShouldUse")), F.when(circling, "circling").otherwise("non-circling")).otherwise("unknown")
    else:
        told = first("Primary label/behavior", "Behavior", "behavior")
        word = F.lower(F.trim(F.coalesce(F.col(f"`{told}`"), F.lit("circling")))) if told else F.lit("circling")
        sure = first("verified", "Verified")
        known = F.lit(verified) if verified or not sure else truth(F.col(sure))
        status = F.when(known & word.isin("non-circling", "noncircling"), "non-circling").when(known & (word == "circling"), "circling").otherwise("unknown")
    told = [c for c in df.columns if any(x in c.lower() for x in ("note", "comment", "direction", "circle"))]
    notes = F.concat_ws(" | ", *[F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in told]) if told else F.lit("")
    wrong = F.when(b < a, F.raise_error(F.lit("end precedes start")).cast("long")).otherwise(b)
    return held.select(a.alias("start"), wrong.alias("end"), status.alias("status"), notes.alias("notes"))


#: Header names of the exporter's columns, by preference, and its words for true.
EXPORT_HEADERS = {
    "video": ("VideoID", "video_id", "video"),
    "start": ("StartFrame", "Start Frame", "start_frame"),
    "end": ("EndFrame", "End Frame", "end_frame"),
    "sure": ("Verified", "verified"),
    "label": ("Primary label/behavior", "Behavior", "behavior"),
    "direction": ("Rotation direction", "Direction"),
    "turns": ("No. of turns/circles", "Rounds"),
}


def exporter_intervals(df: DataFrame, video: str, prediction: bool = False, verified: bool = False, end_exclusive: bool = False) -> DataFrame:
    """start, end, status, direction, turns and notes of one video's intervals for the clip exporter.

    An annotation counts as circling or non-circling only if it is marked for use (its ``Circling`` flag decides) or, in
    a file without that mark, if it is verified and names one of the two; everything else is unknown. Rows without both
    frames are left out (``skipped`` counts them); texts are the file's own, empty where it has none.
    """
    role = {r: next((n for n in names if n in df.columns), None) for r, names in EXPORT_HEADERS.items()}
    missing = [r for r in ("start", "end") if role[r] is None]
    if missing:
        raise ValueError(f"no column for the interval's {' and '.join(missing)}")
    text = lambda r: F.coalesce(F.col(f"`{role[r]}`").cast("string"), F.lit("")) if role[r] else F.lit("")
    told = _of_video(df, role["video"], video).where(_framed(role["start"], role["end"]))
    a, b = whole_frame(F.col(f"`{role['start']}`")), whole_frame(F.col(f"`{role['end']}`")) - int(end_exclusive)
    word = F.lower(F.trim(text("label")))
    named = F.when(word == "circling", "circling").when(word.isin("non-circling", "no-circling"), "non-circling").otherwise("unknown")
    if prediction:
        status = F.lit("prediction")
    elif "ShouldUse" in df.columns:
        circling = truth(F.col("Circling")) if "Circling" in df.columns else F.lit(False)
        status = F.when(~truth(F.col("ShouldUse")), "unknown").when(circling, "circling").otherwise("non-circling")
    else:
        status = F.when(truth(F.col(f"`{role['sure']}`")) if role["sure"] else F.lit(verified), named).otherwise("unknown")
    remarks = [c for c in df.columns if "note" in c.lower() or "comment" in c.lower()]
    notes = F.concat_ws(" | ", *[F.col(f"`{c}`").cast("string") for c in remarks]) if remarks else F.lit("")
    end = F.when(b < a, F.raise_error(F.lit("end precedes start")).cast("long")).otherwise(b)
    return told.select(a.alias("start"), end.alias("end"), status.alias("status"), text("direction").alias("direction"), text("turns").alias("turns"), notes.alias("notes"))


def _of_video(df: DataFrame, name: str | None, video: str) -> DataFrame:
    return df if name is None else df.where(F.col(f"`{name}`").isNull() | (F.col(f"`{name}`").cast("string") == video))


def _framed(start: str, end: str):
    return F.col(f"`{start}`").isNotNull() & F.col(f"`{end}`").isNotNull()


def skipped(df: DataFrame, video: str) -> int:
    """Rows of a video that lack a frame and that the exporter leaves out."""
    start, end, name = (next((n for n in EXPORT_HEADERS[r] if n in df.columns), None) for r in ("start", "end", "video"))
    return _of_video(df, name, video).where(~_framed(start, end)).count()


def _numbered(df: DataFrame, keys: list[str], order: list[str], block: int = 1 << 16) -> DataFrame:
    """Adds ``nth``, a number from 0 in the order of frames, by counts of blocks, so that no task sorts all rows."""
    part = df.withColumn("_b", F.floor(F.col(order[0]) / block))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    sizes = part.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_b", before.alias("_before"))
    return part.withColumn("_in", F.row_number().over(inside) - 1).join(sizes, [*keys, "_b"]).withColumn("nth", F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")


def export_events(events: DataFrame, video: str | None = None, fps: float = 30.0, behavior: str = "circling", ids: tuple[str, ...] = ("t1", "t2"), confidence: str = "mean_score") -> DataFrame:
    """Events under their export names, numbered from 0 by start: VideoID, EventID, StartTime, EndTime, Behavior,
    FishIDs (ids joined by a bar) and Confidence/Notes."""
    rows = _numbered(events.withColumn("_video", F.lit(video or "")), ["_video"], ["start", "end", *ids])
    name = F.format_string(f"{video}_evt_%04d" if video else "evt_%04d", "nth")
    return rows.select(
        F.col("_video").alias("VideoID"), name.alias("EventID"), hms(F.col("start") / fps).alias("StartTime"), hms(F.col("end") / fps).alias("EndTime"), F.lit(behavior).alias("Behavior"),
        F.concat_ws("|", *[F.col(c).cast("string") for c in ids]).alias("FishIDs"), F.col(confidence).alias("Confidence/Notes"),
    )


def export_detections(found: DataFrame, labels: DataFrame, fps: float = 30.0, detector: str = "rule_v2") -> DataFrame:
    """Labelled spans of the rule detector under their export names, with seconds and whether a label overlaps."""
    told = labels.select(F.col("video_id").alias("_key"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = found.join(told, (F.col("video_id") == F.col("_key")) & (F.col("b_start") <= F.col("end")) & (F.col("b_end") >= F.col("start")), "left_semi")
    rows = _numbered(found, ["video_id"], ["start", "end"]).join(met.select("video_id", "start", "end", F.lit(True).alias("_met")).distinct(), ["video_id", "start", "end"], "left")
    seconds = lambda c: F.bround(c / F.lit(float(fps)), 2)
    return rows.select(
        F.col("video_id").alias("VideoID"), F.concat(F.regexp_replace("video_id", "_vid$", ""), F.format_string("-R%03d", F.col("nth") + 1)).alias("EventID"), F.col("start").alias("StartFrame"), F.col("end").alias("EndFrame"),
        seconds(F.col("start")).alias("start_s"), seconds(F.col("end")).alias("end_s"), seconds(F.col("end") - F.col("start") + 1).alias("duration_s"), F.col("direction").alias("Direction"), F.bround("cycles", 2).alias("Cycles"),
        F.lit(detector).alias("detector_name"), F.coalesce("_met", F.lit(False)).alias("overlaps_label"),
    )


def export_scored(found: DataFrame, score: str = "span_score") -> DataFrame:
    """Scored spans under their export names."""
    return found.select(F.col("video_id").alias("VideoID"), F.col("start").alias("StartFrame"), F.col("end").alias("EndFrame"), F.col(score).alias("Score"))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, also for an empty table. Spans of a video are few."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str, parameters: dict, partition_by: tuple[str, ...] = ()) -> None:
    """Feature table as Parquet, partitioned by video, with its parameters beside it as JSON."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    df.sparkSession.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.parameters")
