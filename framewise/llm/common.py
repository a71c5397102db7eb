"""Shared pieces of the training-data operators: shared storage, byte-level scanning, hashing.

Everything that must be visible to more than one machine is written below the folder that the
session names in ``spark.checkpoint.dir``; on a cluster nothing is ever written to a machine-local folder.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one vectorised step works on; bounds the memory of a Python worker.
STEP_BYTES = 2 << 20

#: Multiplicative constants of the 64-bit finaliser (public domain splitmix64).
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

#: Odd base of the polynomial byte hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where none is named, one is set: a
    temporary folder if the session runs on this machine alone, else a folder of the warehouse, which is shared too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isDefined():
            found = named.get()
        elif re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_folder(folder: str):
    """File system and path of a folder in shared storage, for tasks that read or write byte ranges."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


class Blocks:
    """Rows written once to the shared folder as numbered Parquet files, which any task can open by number.

    ``frame`` reads them with two more columns, ``file`` and ``row``: the address of a row. A later step that needs
    texts again deals out addresses only and reads the texts where they lie, so texts are never shuffled.
    """

    def __init__(self, df: DataFrame, name: str, row_group: int = 8 << 20):
        spark = df.sparkSession
        self.path = new_folder(spark, name)
        df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).option("parquet.block.size", row_group).parquet(self.path)
        stored = spark.read.schema(df.schema).parquet(self.path)
        names = stored.inputFiles()
        #: Partitions to deal files out to; a number that is given isn't coalesced by the bytes of the addresses.
        self.tasks = 2 * max(1, len(names))
        some = next(iter(names), "part-00000.parquet").rpartition("/")[2]
        self.pattern = re.sub(r"^part-\d+", "part-{:05d}", some)
        number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
        self.frame = stored.select("*", number.alias("file"), F.col("_metadata.row_index").alias("row"))

    def reader(self) -> Callable:
        """A function from a file's number to its row groups, in order, as (number of the first row, table)."""
        path, pattern = self.path, self.pattern

        def read(number: int, columns: list[str]):
            import pyarrow.parquet as pq

            system, folder = open_folder(path)
            with system.open_input_file(f"{folder}/{pattern.format(number)}") as f:
                stored, at = pq.ParquetFile(f), 0
                for k in range(stored.num_row_groups):
                    part = stored.read_row_group(k, columns=columns, use_threads=False)
                    yield at, part
                    at += part.num_rows

        return read


def crc_bucket(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; a null id is in no bucket."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept between calls."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for kind, base in (("up", BASE), ("down", BASE_INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[kind] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


class SpanHash:
    """64-bit hashes of any byte ranges of one array, two lookups each."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        up, down = powers(len(data) + 1)
        self.up = up
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.up[end]
        return mix64(raw + (end - start).astype(np.uint64) * MIX_2)


class Texts:
    """A run of rows of one Arrow column as one byte array: row i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.cast(pa.large_string()).combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        self.bounds, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        if len(column):
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            self.bounds = ends - ends[0]
            if ends[-1] > ends[0]:
                self.data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        self.rows = len(column)

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each maximal run of word bytes inside a row, and the first run of each row."""
        mask = is_word[self.data]
        if not len(mask):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.rows + 1, np.int64)
        edge = np.zeros(len(mask) + 1, bool)
        edge[self.bounds] = True
        before = np.zeros(len(mask), bool)
        before[1:] = mask[:-1]
        starts = np.flatnonzero(mask & (~before | edge[:-1]))
        after = np.zeros(len(mask), bool)
        after[:-1] = mask[1:]
        ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)


class Piece(Texts):
    """Part of some texts: its row i is the bytes from ``start[i]`` on of text ``row[i]``; ``last[i]`` tells whether
    the text ends with it."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, row: np.ndarray, start: np.ndarray, last: np.ndarray):
        self.data, self.bounds, self.row, self.start, self.last, self.rows = data, bounds, row, start, last, len(row)


def overlapping(data: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes, each but the last going on for ``overlap`` bytes into the next."""
    for start in range(0, len(data) - overlap, limit):
        yield start, min(len(data), start + limit + overlap)


def between_words(data: np.ndarray, limit: int, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end behind white space; a longer word stays whole."""
    start = 0
    while start < len(data):
        stop = min(len(data), start + limit)
        space = np.flatnonzero(~NOT_SPACE[data[start:stop]]) if stop < len(data) else []
        if len(space):
            stop = start + int(space[-1]) + 1
        while stop < len(data) and not len(space):
            space = np.flatnonzero(~NOT_SPACE[data[stop : stop + limit]])
            stop = stop + int(space[0]) + 1 if len(space) else min(len(data), stop + limit)
        yield start, stop
        start = stop


def pieces(texts: Texts, limit: int, overlap: int = 0, cut: Callable = overlapping) -> Iterator[Piece]:
    """All texts in pieces of about ``limit`` bytes. Short texts share one, a longer text is cut, so that a step's
    memory doesn't follow the length of a text."""
    sizes = np.diff(texts.bounds)
    long = sizes > limit + overlap
    group = (np.cumsum(np.where(long, 0, sizes)) - 1).clip(0) // limit
    group = group + 2 * np.cumsum(long) - long
    first = 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), texts.rows] if texts.rows else []:
        rows = np.arange(first, end)
        lo, hi = int(texts.bounds[first]), int(texts.bounds[end])
        if long[first]:
            for start, stop in cut(texts.data[lo:hi], limit, overlap):
                yield Piece(texts.data[lo + start : lo + stop], np.array([0, stop - start]), rows, np.array([start]), np.array([stop == hi - lo]))
        else:
            yield Piece(texts.data[lo:hi], texts.bounds[first : end + 1] - lo, rows, np.zeros(len(rows), np.int64), np.ones(len(rows), bool))
        first = end


def words_from(data: np.ndarray, place: np.ndarray, order: str = "<") -> np.ndarray:
    """Eight bytes from each place on as one number ("<": the first byte lowest, ">": highest). ``data`` must go on
    for eight bytes behind every place."""
    every = np.ndarray((max(len(data) - 7, 0),), f"{order}u8", np.ascontiguousarray(data), strides=(1,))
    return every[place].astype(np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort (faster for whole numbers than by hashing)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


#: Spans above this many bytes are hashed one by one.
LONG_SPAN = 1 << 12


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of byte ranges, chained over eight bytes at a time, so that no sums of powers can cancel."""
    size = end - start
    padded = np.append(data, np.zeros(8, np.uint8))
    key = mix64(size.astype(np.uint64) + MIX_2)
    active, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(active):
        word = words_from(padded, start[active] + at)
        left = (size[active] - at).clip(max=8)
        word &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64)
        key[active] = mix64(key[active] ^ word * MIX_1) + word
        at += 8
        active = active[size[active] > at]
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        key[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return key


def by_key(batches, key: str, columns: list[str]):
    """(key, columns) for each run of equal keys in a stream."""
    held: list[list[pa.Array]] = []
    now = None
    for batch in batches:
        found = batch.column(batch.schema.get_field_index(key)).to_numpy()
        values = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        edges = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(found)] if len(found) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if now is not None and found[a] != now:
                yield now, [pa.chunked_array(c) for c in zip(*held, strict=True)]
                held = []
            now = int(found[a])
            held.append([v.slice(a, b - a) for v in values])
    if now is not None:
        yield now, [pa.chunked_array(c) for c in zip(*held, strict=True)]


def table_of(kept) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(kept)] = True
    return table


#: White space that separates words, [\x20\x09-\x0D].
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_SPACE = table_of(set(range(256)) - set(SPACES))

#: Byte to byte: A-Z to a-z, the rest as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes each; a longer text is alone."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - 1).clip(0) // limit
    group = np.maximum.accumulate(group)
    cuts = np.flatnonzero(np.diff(group)) + 1
    start = 0
    for end in [*cuts.tolist(), len(texts)]:
        yield batch.slice(start, end - start)
        start = end


def by_row(weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``weights`` between consecutive entries of ``first``."""
    sums = np.zeros(len(weights) + 1, weights.dtype)
    np.cumsum(weights, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def add_columns(df: DataFrame, text: str, keep: list[str], own: T.StructType, make: Callable) -> DataFrame:
    """``keep`` columns of ``df`` and ``own`` ones computed from ``text`` slice by slice in Arrow, without a shuffle.

    ``make()`` runs once in each task and returns a function from a slice of the input to ``own`` arrays.
    Own names win: an input column of the same name is not carried.
    """
    names = [c for c in keep if c not in own.fieldNames()]
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_scanned"))
    schema = T.StructType([*source.select(*[f"`{c}`" for c in names]).schema.fields, *own.fields])
    labels = schema.fieldNames()

    def run(batches):
        work = None
        for batch in batches:
            for part in steps(batch, "_scanned"):
                work = work or make()
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *work(part.column(len(names)))], names=labels)

    return source.mapInArrow(run, schema)
