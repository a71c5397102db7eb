"""Declared schemas and metadata of track and pair tables."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.exprs import finite

#: The metadata that a table must carry.
TRACK_METADATA = {"fps": "30.0", "y_axis": "down", "coordinate_space": "raw_pixels", "units": "pixels"}
PAIR_METADATA = {**TRACK_METADATA, "pair_ordering": "TrackUID_1 < TrackUID_2", "gap_tolerance_s": "0.2", "table": "pairs"}
#: The keys of a row.
TRACK_KEYS = ["project_id", "day_label", "FrameNum", "TrackUID"]
PAIR_KEYS = ["project_id", "day_label", "FrameNum", "TrackUID_1", "TrackUID_2"]
#: Prefixes of metadata that writers add on their own.
WRITER_KEYS = ("ARROW", "pandas", "org.apache.spark")


def _first_part(spark: SparkSession, path: str) -> str:
    files = spark.read.parquet(path).select("_metadata.file_path").limit(1).collect()
    return files[0][0] if files else path


def file_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """Key/value metadata of a Parquet file's footer without what writers add. Read by the driver: one footer."""
    from pyarrow import fs, parquet

    system, name = fs.FileSystem.from_uri(_first_part(spark, path))
    found = parquet.ParquetFile(name, filesystem=system).metadata.metadata or {}
    return {k.decode(): v.decode() for k, v in found.items() if not k.decode().startswith(WRITER_KEYS)}


def mismatches(found: Mapping[str, str], wanted: Mapping[str, str]) -> list[str]:
    """All ways in which metadata differ from what is wanted; values compare as texts."""
    return [f"{k}: {found.get(k)!r} instead of {v!r}" for k, v in wanted.items() if found.get(k) != v]


def assert_contract(spark: SparkSession, path: str, kind: str) -> None:
    wrong = mismatches(file_metadata(spark, path), PAIR_METADATA if kind == "pairs" else TRACK_METADATA)
    if wrong:
        raise ValueError(f"{path} breaks the contract: {'; '.join(wrong)}")


def normalised(df: DataFrame) -> DataFrame:
    """Floating columns with NaN and infinities as null."""
    return df.select(*[finite(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields])


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    found = repeated_keys(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"{name}: repeated key {found[0].asDict()}")
    return df


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    """The columns in this order; raises if any is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*columns)


def load(spark: SparkSession, paths: Sequence[str], kind: str, columns: Sequence[str], check: bool = True) -> DataFrame:
    """Union of track or pair files: contract and uniqueness checked, only ``columns`` scanned, NaN as null."""
    keys = PAIR_KEYS if kind == "pairs" else TRACK_KEYS
    for path in paths if check else []:
        assert_contract(spark, path, kind)
    df = normalised(require_columns(spark.read.parquet(*paths), list(dict.fromkeys([*keys, *columns])), kind))
    return assert_unique(df, keys, kind) if check else df


def find_file(folders: Sequence[str], names: Sequence[str], variable: str = "") -> str:
    """The first existing of several names in several folders; a folder in an environment variable comes first."""
    searched = [*([os.environ[variable]] if variable and os.environ.get(variable) else []), *folders]
    for folder in searched:
        for name in names:
            if os.path.exists(os.path.join(folder, name)):
                return os.path.join(folder, name)
    raise FileNotFoundError(f"none of {', '.join(names)} in {', '.join(searched)}")


#: Columns that may name the video, the first that exists counts.
VIDEO_COLUMNS = ("day_label", "VideoID", "video_id", "video")


def scoped(df: DataFrame, start: int, end: int, video: str, project: str | None = None, columns: Sequence[str] | None = None, frame: str = "FrameNum") -> DataFrame:
    """Frames [start, end] of one video (and project), with the columns that exist, the video's and project's
    among them; a start below 0 is 0. The filters reach the scan."""
    held = df.where(F.col(frame).between(max(0, start), end))
    name = next((c for c in VIDEO_COLUMNS if c in df.columns), None)
    own = [c for c in (name, "project_id") if c in df.columns]
    if name:
        held = held.where(F.col(name) == video)
    if project is not None and "project_id" in df.columns:
        held = held.where(F.col("project_id") == project)
    return held if columns is None else held.select(*dict.fromkeys([*own, *[c for c in columns if c in df.columns]]))


def score_chunk(df: DataFrame, start: int, end: int, frame: str = "FrameNum", score: str = "circling_score") -> DataFrame:
    """Scores of a frame range; raises for repeated frames or scores outside [0, 1]."""
    held = df.where(F.col(frame).between(start, end)).select(frame, score)
    assert_unique(held, [frame], "scores")
    if held.where(~F.col(score).between(0, 1)).limit(1).count():
        raise ValueError("scores must be in [0, 1]")
    return held
