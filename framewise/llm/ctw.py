"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; for each decision a tree of contexts (the bytes before) mixes the
Krichevsky-Trofimov estimates of all depths with equal prior weight at every split. Every context of up to ``depth``
bytes that occurs in the corpus is a node, so the tree grows with the corpus. With the counts frozen, the mixture for
a context and byte is one number.

No machine holds the tree. A gram is a context of ``depth`` bytes and the byte after it, written with the latest byte
of the context first, so that a subtree is a range of grams. Subtrees below contexts of ``UNIT`` bytes are dealt out
over shards; only the sums of shorter contexts' decisions meet on the driver, of which there are at most
256^(UNIT - 1) * 255. Texts stay where they are: the distinct grams of a stretch of texts are sent to the shards,
which send back a number for each.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import FOLD, NOT_SPACE, Blocks, Piece, Texts, between_words, by_key, crc_bucket, distinct, materialise, pieces, span_keys
from framewise.llm.components import groups

DEPTH, UNIT = 5, 2
#: Training words whose counts are broadcast: the most frequent, at most this many.
FREQUENT = 1 << 20
#: Text bytes that a step works on, keys that a task holds before it passes them on, and grams worked out together.
STEP, HELD, CHUNK = 1 << 20, 1 << 20, 1 << 17
#: Files whose grams one task answers for a shard.
FILES = 256
#: The key of the end of a text among the words.
END = 0
WORD, GRAM = 0, 1
LN2 = math.log(2)


def word_keys(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit key of every word of A-Z folded text."""
    start, end, first = texts.words(NOT_SPACE)
    return np.repeat(np.arange(texts.rows), np.diff(first)), span_keys(FOLD[texts.data], start, end).view(np.int64)


def gram_keys(piece: Piece, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and gram of every byte and end: depth bytes of context, the latest highest, and the byte itself lowest.

    A text begins after ``depth`` zero bytes and ends with one. A piece that isn't a text's first begins with
    ``depth`` bytes that are only context.
    """
    size = np.diff(piece.bounds)
    lead = np.where(piece.start == 0, depth, 0)
    begins = np.zeros(piece.rows + 1, np.int64)
    np.cumsum(size + lead + piece.last, out=begins[1:])
    data = np.zeros(begins[-1], np.int64)
    data[np.arange(len(piece.data)) + np.repeat(begins[:-1] + lead - piece.bounds[:-1], size)] = piece.data
    n = max(len(data) - depth, 0)
    key = np.zeros(n, np.int64)
    for j in [*range(depth - 1, -1, -1), depth]:
        key <<= 8
        key |= data[j : j + n]
    inside = np.ones(n, bool)
    for j in range(1, depth + 1):
        inside[begins[1:-1] - j] = False
    return np.repeat(np.arange(piece.rows), np.diff(begins) - depth), key[inside]


def shard_of(unit, shards: int):
    """The shard of a context of UNIT bytes; the same for numbers in an array."""
    return ((unit * 2654435761) >> 16) % shards


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[start], np.add.reduceat(n, start) if len(start) else n


def corpus_counts(docs: DataFrame, text: str, depth: int, unit: int = UNIT, shards: int = 1, step: int = STEP) -> DataFrame:
    """(kind, shard, key, n) over all rows: words and ends, and grams. Tasks sum up what they scan before the shuffle."""
    shift = 8 * (depth + 1 - min(unit, depth))

    def run(batches):
        held, loose = {WORD: [], GRAM: []}, {WORD: 0, GRAM: 0}

        def told(kind, keys, counts):
            for a in range(0, len(keys), 1 << 17):
                key = keys[a : a + (1 << 17)]
                shard = shard_of(key >> shift, shards) if kind == GRAM else np.zeros(len(key))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(shard.astype(np.int32)), pa.array(key), pa.array(counts[a : a + (1 << 17)])], names=["kind", "shard", "key", "n"])

        def add(kind, keys):
            held[kind].append(np.unique(keys, return_counts=True))
            loose[kind] += len(held[kind][-1][0])
            if loose[kind] > HELD:
                keys, counts = _summed(*zip(*held[kind], strict=True))
                if len(keys) > HELD // 2:
                    held[kind], loose[kind] = [], 0
                    yield from told(kind, keys, counts)
                else:
                    held[kind], loose[kind] = [(keys, counts)], len(keys)

        ends = 0
        for batch in batches:
            texts = Texts(batch.column(0))
            ends += texts.rows
            for piece in pieces(texts, step, cut=between_words):
                yield from add(WORD, word_keys(piece)[1])
            for piece in pieces(texts, step, depth):
                yield from add(GRAM, gram_keys(piece, depth)[1])
        for kind in held:
            if held[kind]:
                yield from told(kind, *_summed(*zip(*held[kind], strict=True)))
        if ends:
            yield from told(WORD, np.array([END], np.int64), np.array([ends], np.int64))

    parts = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text")).mapInArrow(run, "kind int, shard int, key long, n long")
    return parts.groupBy("kind", "shard", "key").agg(F.sum("n").alias("n"))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument by eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


class Level(NamedTuple):
    """Decisions of contexts of one length, sorted by ``key`` (the context, then the node of the byte's binary tree):
    the own estimate of a one and its weight against what is below."""

    key: np.ndarray
    own: np.ndarray
    inside: np.ndarray


class Sums(NamedTuple):
    """Decisions of one level with their counts and the logarithm of the mixed probability."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    mixed: np.ndarray


def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the eight decisions of each gram, and their outcomes."""
    byte, context = grams & 255, grams >> 8 << 8
    nodes = np.stack([(256 | byte) >> (8 - j) for j in range(8)], 1)
    return context[:, None] | nodes, np.stack([byte >> (7 - j) & 1 for j in range(8)], 1)


def above(key: np.ndarray) -> np.ndarray:
    """The decision of the context without its earliest byte."""
    return key >> 16 << 8 | key & 255


def lowest(grams: np.ndarray, n: np.ndarray) -> tuple[Level, Sums]:
    """Decisions of the longest contexts, from counted grams."""
    key, bit = decisions(grams)
    key, bit, n = key.ravel(), bit.ravel(), np.repeat(n.astype(np.float64), 8)
    order = np.argsort(key)
    key, bit, n = key[order], bit[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ones, both = np.add.reduceat(n * bit, start), np.add.reduceat(n, start)
    sums = Sums(key[start], both - ones, ones, log_kt(both - ones, ones))
    return Level(sums.key, (ones + 0.5) / (both + 1), np.ones(len(start))), sums


def mixed_with(zeros: np.ndarray, ones: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the mixture of own estimate and children, and the own estimate's weight in it."""
    own = log_kt(zeros, ones)
    mixed = np.logaddexp(own, under) - LN2
    return mixed, np.exp(own - LN2 - mixed)


def raised(sums: Sums) -> tuple[Level, Sums]:
    """The level above."""
    key = above(sums.key)
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    zeros, ones, under = (np.add.reduceat(x[order], start) for x in sums[1:])
    mixed, inside = mixed_with(zeros, ones, under)
    return Level(key[start], (ones + 0.5) / (zeros + ones + 1), inside), Sums(key[start], zeros, ones, mixed)


def levels_of(grams: np.ndarray, n: np.ndarray, depth: int, unit: int) -> tuple[list[Level], Sums]:
    """Levels ``unit`` to ``depth`` of some whole subtrees, shortest contexts first, and the sums of level ``unit``."""
    level, sums = lowest(grams, n)
    out = [level]
    for _ in range(depth - unit):
        level, sums = raised(sums)
        out.append(level)
    return out[::-1], sums


def gram_logs(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of the byte of each gram after its context.

    From the root down: the chance of a one below a node is a mixture of its own estimate and what is below, so each
    node's own estimate carries the weight that the nodes above leave over. Below the last node that occurs, all is even.
    """
    key, bit = decisions(grams)
    asked, place = np.unique(key, return_inverse=True)
    chain, up = [asked], []
    for _ in range(len(levels) - 1):
        wanted, parent = np.unique(above(chain[-1]), return_inverse=True)
        chain.append(wanted)
        up.append(parent.ravel())
    chance, left = np.zeros(len(chain[-1])), np.ones(len(chain[-1]))
    for k, level in enumerate(levels):
        wanted = chain[len(levels) - 1 - k]
        if k:
            parent = up[len(levels) - 1 - k]
            chance, left = chance[parent], left[parent]
        at = np.searchsorted(level.key, wanted).clip(max=max(len(level.key) - 1, 0))
        found = level.key[at] == wanted if len(level.key) else np.zeros(len(wanted), bool)
        own = np.where(found, level.own[at] if len(level.key) else 0.5, 0.5)
        inside = np.where(found, level.inside[at] if len(level.key) else 1.0, 1.0)
        chance = chance + left * inside * own
        left = left * (1 - inside)
    one = np.clip(chance, 1e-12, 1 - 1e-12)[place.reshape(key.shape)]
    return np.log10(np.where(bit == 1, one, 1 - one)).sum(axis=1)


def _cuts(units: np.ndarray, most: int) -> list[int]:
    """Places that cut sorted units into parts of about ``most``, none of them inside a unit."""
    edges = np.flatnonzero(np.diff(units)) + 1
    if not len(edges):
        return [0, len(units)]
    part = edges // most
    return [0, *edges[np.flatnonzero(np.diff(part)) + 1].tolist(), len(units)]


def _shard(read, file: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams and counts of one shard."""
    held = [part.filter(pa.compute.equal(part.column("shard"), shard)) for _, part in read(file, ["shard", "key", "n"])]
    table = pa.concat_tables(held)
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _tops(read, depth: int, unit: int):
    """Sums of the decisions of contexts of ``unit`` bytes, by the decision of the context one shorter."""

    def run(batches):
        for batch in batches:
            for shard, file in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                grams, n = _shard(read, file, shard)
                edges = _cuts(grams >> 8 * (depth + 1 - unit), CHUNK)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    _, sums = levels_of(grams[a:b], n[a:b], depth, unit)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (above(sums.key), sums.zeros, sums.ones, sums.mixed)], names=["key", "zeros", "ones", "under"])

    return run


def top_levels(parts: DataFrame, unit: int) -> list[Level]:
    """Levels 0 to ``unit`` - 1, worked out on the driver from their last one's sums."""
    if not unit:
        return []
    table = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "under")]).orderBy("key").toArrow()
    key, zeros, ones, under = (table.column(c).to_numpy() for c in ("key", "zeros", "ones", "under"))
    if not len(key):
        return [Level(key, zeros, ones)] * unit
    mixed, inside = mixed_with(zeros, ones, under)
    out, sums = [Level(key, (ones + 0.5) / (zeros + ones + 1), inside)], Sums(key, zeros, ones, mixed)
    for _ in range(unit - 1):
        level, sums = raised(sums)
        out.append(level)
    return out[::-1]


def _packed(grams: np.ndarray, depth: int) -> bytes:
    """Grams by planes of equal bytes, which compress well as they are sorted."""
    return np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, : depth + 1].T).tobytes()


def _unpacked(data: bytes, depth: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(depth + 1, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : depth + 1] = planes.T
    return out.view(np.int64).ravel()


def _walk(read, file: int, depth: int, step: int, columns: list[str]):
    """Pieces of a file's texts, in the same order each time: (row group's table and texts, piece)."""
    for _, part in read(file, columns):
        texts = Texts(part.column("text"))
        for piece in pieces(texts, step, depth):
            yield part, texts, piece


def _asked(read, depth: int, unit: int, shards: int, step: int):
    """The distinct grams of each stretch of pieces, by shard; ``upto`` is the number of the file's pieces so far."""
    shift = 8 * (depth + 1 - unit)

    def flush(file, upto, grams):
        shard = shard_of(grams >> shift, shards)
        order = np.argsort(shard, kind="stable")
        found, start = np.unique(shard[order], return_index=True)
        blobs = [_packed(grams[part], depth) for part in np.split(order, start[1:])]
        same = np.ones(len(found), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(same * file), pa.array(same * upto), pa.array(blobs, pa.binary())], names=["shard", "file", "upto", "grams"])

    def run(batches):
        for file, _ in by_key(batches, "file", []):
            held, loose, upto, grams = [], 0, 0, np.zeros(0, np.int64)
            for _, _, piece in _walk(read, file, depth, step, ["text"]):
                held.append(distinct(gram_keys(piece, depth)[1]))
                loose, upto = loose + len(held[-1]), upto + 1
                if loose > 2 * HELD:
                    grams = distinct(np.concatenate([grams, *held]))
                    held, loose = [], 0
                    if len(grams) > HELD:
                        yield flush(file, upto, grams)
                        grams = np.zeros(0, np.int64)
            if held or len(grams):
                yield flush(file, upto, distinct(np.concatenate([grams, *held])))

    return run


def _answered(read, where: dict[int, int], tops, depth: int, unit: int):
    """log10 probabilities of the grams asked of one shard; a shard's tree is read once for many files."""
    shift = 8 * (depth + 1 - unit)

    def run(batches):
        for table in groups(batches, ["shard", "salt"]):
            shard = table.column("shard")[0].as_py()
            blobs = [_unpacked(x, depth) for x in table.column("grams").to_pylist()]
            wanted, place = np.unique(np.concatenate(blobs), return_inverse=True)
            grams, n = _shard(read, where[shard], shard) if shard in where else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            logs = np.empty(len(wanted), np.float32)
            units = wanted >> shift
            edges = _cuts(units, CHUNK)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                lo, hi = np.searchsorted(grams >> shift, [units[a], units[b - 1] + 1])
                own = levels_of(grams[lo:hi], n[lo:hi], depth, unit)[0] if hi > lo else [Level(*[np.zeros(0)] * 3)] * (depth + 1 - unit)
                for c in range(a, b, CHUNK):
                    logs[c : min(b, c + CHUNK)] = gram_logs(wanted[c : min(b, c + CHUNK)], [*tops.value, *own])
            sizes = [len(x) for x in blobs]
            parts = [x.tobytes() for x in np.split(logs[place.ravel()], np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in ("file", "upto", "grams")], pa.array(parts, pa.binary())], names=["file", "upto", "grams", "logs"])

    return run


SCORED = T.StructType(
    [
        T.StructField("_size", T.LongType()),
        T.StructField("_n_tokens", T.LongType()),
        T.StructField("_known", T.LongType()),
        T.StructField("_base", T.DoubleType()),
        T.StructField("_score", T.DoubleType()),
        T.StructField("_rare", T.ArrayType(T.LongType())),
        T.StructField("_times", T.ArrayType(T.IntegerType())),
    ]
)


class Words:
    """Counts of frequent words; ``whole`` tells that there are no others."""

    def __init__(self, known: np.ndarray, times: np.ndarray, below: float, whole: bool):
        order = np.argsort(known)
        self.keys, self.logs, self.below, self.whole = known[order], np.log10(times[order] + 0.5), below, whole

    def add(self, row: np.ndarray, word: np.ndarray, n_tokens: np.ndarray, known: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add tokens to their rows' sums; returns row and word of those that the join must settle."""
        at = np.searchsorted(self.keys, word).clip(max=max(len(self.keys) - 1, 0))
        found = self.keys[at] == word if len(self.keys) else np.zeros(len(word), bool)
        rows = len(n_tokens)
        n_tokens += np.bincount(row, minlength=rows)
        known += np.bincount(row[found], minlength=rows)
        if self.whole:
            base += np.bincount(row, np.where(found, self.logs[at] if len(self.keys) else 0.0, math.log10(0.5)) - self.below, rows)
            return row[:0], word[:0]
        if found.any():
            base += np.bincount(row[found], self.logs[at[found]] - self.below, rows)
        return row[~found], word[~found]


def _scored(read, words, depth: int, step: int, n_kept: int):
    """Scores of the rows of each file, from the answers for its stretches."""
    kept = [f"k{i}" for i in range(n_kept)]

    def finished(part, texts, score):
        rows = texts.rows
        n_tokens, known, base = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
        open_rows, open_words = [], []
        for piece in pieces(texts, step, cut=between_words):
            row, word = word_keys(piece)
            for held, x in zip((open_rows, open_words), words.value.add(piece.row[row], word, n_tokens, known, base), strict=True):
                held.append(x)
        for held, x in zip((open_rows, open_words), words.value.add(np.arange(rows), np.full(rows, END, np.int64), n_tokens, known, base), strict=True):
            held.append(x)
        r, w = np.concatenate(open_rows), np.concatenate(open_words)
        order = np.lexsort((w, r))
        r, w = r[order], w[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
        places = np.flatnonzero(new)
        ends = pa.array(np.searchsorted(r[places], np.arange(rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (w[places], np.diff(np.append(places, len(r))).astype(np.int32))]
        numbers = [pa.array(x) for x in (np.diff(texts.bounds) + 1, n_tokens, known, base, score)]
        return pa.RecordBatch.from_arrays([*[part.column(c).combine_chunks() for c in kept], *numbers, *lists], names=[*kept, *SCORED.fieldNames()])

    def run(batches):
        file, walk, now, score, done = None, iter(()), None, None, 0
        for table in groups(batches, ["file", "upto"]):
            if table.column("file")[0].as_py() != file:
                if now is not None:
                    yield finished(*now, score)
                file, now, done = table.column("file")[0].as_py(), None, 0
                walk = _walk(read, file, depth, step, [*kept, "text"])
            grams = np.concatenate([_unpacked(x, depth) for x in table.column("grams").to_pylist()])
            logs = np.concatenate([np.frombuffer(x, np.float32) for x in table.column("logs").to_pylist()])
            order = np.argsort(grams)
            grams, logs = grams[order], logs[order].astype(np.float64)
            while done < table.column("upto")[0].as_py():
                part, texts, piece = next(walk)
                if now is None or part is not now[0]:
                    if now is not None:
                        yield finished(*now, score)
                    now, score = (part, texts), np.zeros(texts.rows)
                row, key = gram_keys(piece, depth)
                order = np.argsort(key)
                key = key[order]
                new = np.concatenate([[True], key[1:] != key[:-1]])
                value = logs[np.searchsorted(grams, key[new])][np.cumsum(new) - 1]
                score += np.bincount(piece.row[row[order]], value, texts.rows)
                done += 1
        if now is not None:
            yield finished(*now, score)

    return run


def score(spark: SparkSession, docs: DataFrame, train: DataFrame, keep: list[str], text: str = "text", depth: int = DEPTH, frequent: int = FREQUENT, unit: int = UNIT, step: int = STEP) -> DataFrame:
    """``keep`` columns of ``docs`` with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``train`` is learned from as a whole; a null text is an empty one, which has only an end. A very long text is worked
    on in pieces of ``step`` bytes that see the bytes before them, so its score is that of the whole. The end of a text
    and what is before its beginning are NUL bytes, and a NUL in a text is the same symbol. Counts of the most frequent
    words are broadcast (at most ``frequent`` of them, those from some count on); other words of a text meet their
    counts in a join. With nothing to learn from, every token's base is log10(1) and every bit is even. Rows are
    independent: repeated rows score alike, null keys are kept, and an empty table gives an empty one. A column of
    ``keep`` with the name of a result isn't carried; other names, dots included, are free.
    """
    unit = min(unit, depth)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = materialise(corpus_counts(train, text, depth, unit, shards, step), "counts")
    grams = Blocks(counts.where(F.col("kind") == GRAM).select("shard", "key", "n").repartition(shards, "shard"), "tree")
    places = grams.frame.select("shard", "file").distinct().toArrow()
    where = dict(zip(places.column("shard").to_pylist(), places.column("file").to_pylist(), strict=True))
    of_shards = spark.createDataFrame(sorted(where.items()), "shard int, file int").repartition(shards, "shard")
    tops = spark.sparkContext.broadcast(top_levels(of_shards.mapInArrow(_tops(grams.reader(), depth, unit), "key long, zeros double, ones double, under double"), unit))

    words = counts.where(F.col("kind") == WORD)
    of_count = sorted(((r["n"], r["count"]) for r in words.groupBy("n").count().collect()), reverse=True)
    tokens, kinds = sum(n * c for n, c in of_count), sum(c for _, c in of_count)
    least, held = None, 0
    for n, c in of_count:
        if held + c > frequent:
            break
        least, held = n, held + c
    top = words.where(F.col("n") >= least).select("key", "n").toArrow() if least else pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    below, whole = math.log10(tokens + 0.5 * (kinds + 1)), held == kinds
    known = spark.sparkContext.broadcast(Words(top.column("key").to_numpy(), top.column("n").to_numpy(), below, whole))

    names = [c for c in keep if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")]
    texts = Blocks(docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")), "texts")
    read = texts.reader()
    files = texts.frame.select("file").distinct().repartition(texts.tasks, "file").sortWithinPartitions("file")
    asked = files.mapInArrow(_asked(read, depth, unit, shards, step), "shard int, file int, upto int, grams binary").withColumn("salt", F.floor(F.col("file") / FILES).cast("int"))
    asked = asked.repartition(shards, "shard", "salt").sortWithinPartitions("shard", "salt")
    answered = asked.mapInArrow(_answered(grams.reader(), where, tops, depth, unit), "file int, upto int, grams binary, logs binary")
    schema = T.StructType([*texts.frame.select(*[f"k{i}" for i in range(len(names))]).schema.fields, *SCORED.fields])
    scored = answered.repartition(texts.tasks, "file").sortWithinPartitions("file", "upto").mapInArrow(_scored(read, known, depth, step, len(names)), schema)

    base, n_known = F.col("_base"), F.col("_known")
    if not whole:
        scored = materialise(scored.withColumn("_uid", F.monotonically_increasing_id()), "scored")
        rare = scored.select("_uid", F.explode(F.arrays_zip("_rare", "_times")).alias("x")).select("_uid", F.col("x._rare").alias("key"), F.col("x._times").alias("times"))
        met = rare.join(words.select("key", "n"), "key", "left")
        seen = F.coalesce(F.col("n"), F.lit(0))
        sums = met.groupBy("_uid").agg(F.sum(F.col("times") * (F.log10(seen + F.lit(0.5)) - F.lit(below))).alias("_more"), F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("_also"))
        scored = scored.drop("_rare", "_times").join(sums, "_uid", "left")
        base, n_known = base + F.coalesce("_more", F.lit(0.0)), n_known + F.coalesce("_also", F.lit(0))
    bits = -F.col("_score") / math.log10(2) / F.col("_size")
    return scored.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)],
        F.col("_n_tokens").alias("n_tokens"),
        n_known.cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        F.col("_score").alias("score"),
        bits.alias("bits_per_byte"),
    )


def held_out(column: str = "doc_id"):
    """Rows that the query keeps from learning: crc32 of the id as text modulo 5 is 1."""
    return F.coalesce(crc_bucket(column, 5) == 1, F.lit(False))
