"""Embedding near-duplicates with randomised-rotation binary codes.

A vector is turned by a random rotation once; the signs of the turned vector are its binary code, and the inner product
of the vector with its own code is stored as a correction factor, beside a coarse copy of the turned vector in a few
planes of bits. Signs under further rotations put vectors into buckets. Inside a bucket the planes of one vector and the
code of the other give, by counting bits, an unbiased estimate of their inner product and a confidence bound. Only
vectors with a pair whose upper bound reaches the threshold are fetched in full, and only such pairs are computed
exactly, in double precision.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import materialise
from framewise.llm.components import Sets, block_pairs, components, groups

COSINE, RECALL = 0.98, 0.9995
#: Rows that a bucket is meant to hold, and rows above which it is cut into blocks.
BUCKET, BLOCK = 64, 2048
#: Width of the confidence bound, in standard deviations of the estimate, and bits of a turned vector's parts.
EPSILON, PLANES = 5.0, 6


@functools.cache
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.RandomState(1000 + seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(largest: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a bucket's code and number of tables: a pair at the threshold meets with probability ``recall``."""
    same = 1 - math.acos(cosine) / math.pi
    bits = max(2, math.ceil(math.log2(max(1, largest) / BUCKET)))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares stay within a double's range
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def bucket_codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A code of ``bits`` signs for each of ``tables`` tables; every rotation serves as many bits as it has rows."""
    dim = vectors.shape[1]
    turned = np.concatenate([vectors @ rotation(dim, s).T for s in range(-(-bits * tables // dim))], axis=1)
    signs = (turned[:, : bits * tables] >= 0).reshape(len(vectors), tables, bits).astype(np.int64)
    return (signs << np.arange(bits)).sum(axis=2)


def encode(x: np.ndarray) -> np.ndarray:
    """Codes of unit vectors as rows of 64-bit words: factor, least part, step, sum of the parts' levels and number of
    ones (each a double), the code's bits, and the planes of the turned vector's levels, highest last."""
    dim = x.shape[1]
    turned = x @ rotation(dim, 0).T
    ones = turned >= 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    head = np.stack([factor, low, step, level.sum(axis=1), ones.sum(axis=1)], 1).astype(np.float64).view(np.uint64)
    words = -(-dim // 64)

    def packed(bits):
        wide = np.zeros((len(bits), words * 64), np.uint8)
        wide[:, :dim] = bits
        return np.packbits(wide, axis=1).view(np.uint64)

    return np.concatenate([head, packed(ones), *[packed(level >> p & 1) for p in range(PLANES)]], axis=1)


def doubtful(x: np.ndarray, y: np.ndarray, dim: int, cosine: float):
    """(i, j), a few rows of ``x`` at a time, of the pairs of codes whose inner product may reach ``cosine``."""
    words = -(-dim // 64)
    factor, _, _, _, ones = np.ascontiguousarray(y[:, :5]).view(np.float64).T
    bits = y[:, 5 : 5 + words]
    _, low, step, levels, _ = np.ascontiguousarray(x[:, :5]).view(np.float64).T
    planes = x[:, 5 + words :].reshape(len(x), PLANES, words)
    deviation = np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    for at in range(0, len(x), 256):
        part = slice(at, at + 256)
        shared = np.zeros((len(planes[part]), len(y)), np.int64)
        for p in range(PLANES):
            for w in range(words):
                shared += np.bitwise_count(planes[part, p, w][:, None] & bits[None, :, w]).astype(np.int64) << p
        signed = 2 * (low[part, None] * ones + step[part, None] * shared) - (dim * low[part] + step[part] * levels[part])[:, None]
        estimate = signed / (math.sqrt(dim) * factor)
        rounding = math.sqrt(dim) * step[part, None] / 2 / factor
        i, j = np.nonzero(estimate + EPSILON * deviation + rounding >= cosine - 1e-9)
        yield i + at, j


def linked_pairs(codes_x: np.ndarray, codes_y: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i, j) of unit vectors with a cosine of at least ``cosine``, and how many were computed exactly."""
    none = np.zeros(0, np.int64)
    found_i, found_j, exact = [none], [none], 0
    for i, j in doubtful(codes_x, codes_y, x.shape[1], cosine):
        exact += len(i)
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
            found_i.append(a[near])
            found_j.append(b[near])
    return np.concatenate(found_i), np.concatenate(found_j), exact


def _fit(column: str):
    """Whether a vector can be compared: not null, with no null or non-finite part and not all zero."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce((F.size(column) > 0) & ~bad & F.exists(column, lambda v: v != 0), F.lit(False))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per vector: ``key``, n_links, component_id and kept.

    Vectors with equal non-null labels (and lengths) are linked if their cosine, in double precision, is at least
    ``cosine``; pairs at the threshold are met with probability ``recall``, closer ones more surely. Vectors that
    can't be compared, and null labels, link with nothing. Equal vectors are one class, whose members are counted
    and not paired; a row with a null key takes part, with kept false. Repeated rows count as rows of their own.
    The component of a row is the smallest key reachable. Keys are 64-bit integers; other columns are not looked at. An
    empty table gives an empty result.

    Linked pairs never leave the task that finds them: it passes on, for each vector, the number of links first
    seen in its bucket, and one edge to the least vector it is connected with there.
    """
    spark = rows.sparkSession
    # Parts travel as they are stored: 4 bytes each if they are floats, which doubles hold exactly.
    single = rows.schema[vector].dataType.simpleString() == "array<float>"
    source = rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"))
    usable = _fit("vector") & F.col("label").isNotNull()
    source = source.withColumn("node", F.when(usable, F.xxhash64("label", "vector")))
    nodes = source.where("node is not null").groupBy("node", "label", "vector").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    nodes = materialise(nodes, "vectors")
    largest = nodes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, cosine, recall)

    def deal(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists = table.column("vector").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for dim in np.unique(sizes):
                pick = np.flatnonzero(sizes == dim)
                x = flat[(ends[pick][:, None] + np.arange(dim)).ravel()].reshape(len(pick), dim)
                x = unit(x)
                codes = bucket_codes(x, bits, tables)
                yield pa.RecordBatch.from_arrays(
                    [table.column("node").combine_chunks().take(pa.array(pick)), table.column("label").combine_chunks().take(pa.array(pick)), pa.array(np.full(len(pick), dim, np.int64)), table.column("n").combine_chunks().take(pa.array(pick)),
                     pa.array([v.tobytes() for v in encode(x)], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                    names=["node", "label", "dim", "n", "code", "codes"],
                )

    coded = nodes.mapInArrow(deal, "node long, label string, dim long, n long, code binary, codes array<long>")
    dealt = coded.select("*", F.posexplode("codes").alias("nth", "_place")).withColumn("bucket", F.xxhash64("label", "dim", "nth", "_place"))
    dealt = block_pairs(dealt.drop("label", "_place"), "bucket", "node", BLOCK)
    order = ["bucket", "block_a", "block_b", "own"]

    def sides(table):
        """Codes of a bucket's rows and the rows on either side of its pairs."""
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(table.num_rows, -1)
        first, second = table.column("block_a")[0].as_py(), table.column("block_b")[0].as_py()
        if first == second:
            every = np.arange(table.num_rows)
            return codes, every, every, True
        own = table.column("own").to_numpy()
        return codes, np.flatnonzero(own == first), np.flatnonzero(own != first), False

    def doubt(batches):
        for table in groups(batches, order[:3]):
            codes, left, right, same = sides(table)
            if not len(left) or not len(right):
                continue
            marked = np.zeros(len(codes), bool)
            for i, j in doubtful(codes[left], codes[right], int(table.column("dim")[0].as_py()), cosine):
                pick = i != j if same else slice(None)
                marked[left[i[pick]]] = marked[right[j[pick]]] = True
            if marked.any():
                yield from table.filter(pa.array(marked)).to_batches()

    def compare(batches):
        for table in groups(batches, order[:3]):
            codes, left, right, same = sides(table)
            if not len(left) or not len(right):
                continue
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
            nth = int(table.column("nth")[0].as_py())
            places = np.array(table.column("codes").to_pylist())[:, :nth]
            x = unit(table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1))
            i, j, _ = linked_pairs(codes[left], codes[right], x[left], x[right], cosine)
            i, j = left[i], right[j]
            if same:
                # The estimate isn't symmetric: a pair is in doubt if it is from either side.
                low, high = np.minimum(i, j), np.maximum(i, j)
                both = np.unique((low * len(node) + high)[low != high])
                i, j = both // len(node), both % len(node)
            links, sets = np.zeros(len(node), np.int64), Sets(len(node))
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                first = ~(places[a] == places[b]).any(axis=1) if nth else np.ones(len(a), bool)
                a, b = a[first], b[first]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    if sets.count == 1:
                        break
                    sets.join(p, q)
            touched = np.flatnonzero(links)
            if len(touched):
                yield pa.RecordBatch.from_arrays([pa.array(node[touched]), pa.array(links[touched]), pa.array(node[sets.roots()[touched]])], names=["node", "links", "root"])

    columns = ["bucket", "block_a", "block_b", "own", "nth", "node", "dim", "n", "codes", "code"]
    kinds = "bucket long, block_a int, block_b int, own int, nth int, node long, dim long, n long, codes array<long>, code binary"
    open_ = dealt.select(*columns).repartition(*order[:3]).sortWithinPartitions(*order).mapInArrow(doubt, kinds)
    # Full vectors travel only to the buckets where they are in doubt.
    open_ = open_.join(nodes.select("node", "vector"), "node")
    found = open_.repartition(*order[:3]).sortWithinPartitions(*order).mapInArrow(compare, "node long, links long, root long")
    found = materialise(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("node <> root"), "node", "root")
    # The least keys are written before a component's members, maybe a third of all classes, meet them.
    linked = materialise(nodes.select("node", "least").join(parts, "node"), "linked")
    of_root = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id")), "of-root")
    linked = linked.join(of_root, "root").select("node", "component_id")
    placed = nodes.select("node", "n", "least").join(links, "node", "left").join(linked, "node", "left")
    placed = placed.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    placed = materialise(placed, "placed")
    out = source.select("key", "node").join(placed, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
