"""Connected components of an edge list that never leaves the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import materialise

MOST_ROUNDS = 60


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Least neighbour of each ``u`` among itself and its neighbours; summed up before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` (64-bit ids): root is the smallest node it is connected with.

    Large-star and small-star rounds (each hangs the larger neighbours of a node, then the smaller ones, below
    the least of them) until the edges are stars; the number of rounds grows with the logarithm of the size.
    Every round is written to the shared folder, and so are the least neighbours before the edges meet them: a
    join of two plain shuffles (or a broadcast, if the written table is small) can split the edges of a hub,
    which a join that shares the shuffle of a sum can't. Self-loops and nulls are dropped; no edges give no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = materialise(now, "edges")
    told = None
    for _ in range(MOST_ROUNDS):
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen[0] == 0 or seen == told:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        told = seen
        both = now.union(now.select("v", "u"))
        least = materialise(_least_neighbour(both), "least")
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = materialise(small, "edges")
    raise RuntimeError("the components did not settle")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys of a sorted stream, as one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        start = 0
        for cut in np.flatnonzero(new).tolist():
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


class Sets:
    """Disjoint sets of 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.count = n

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.parent[y] = x
        self.count -= 1
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(k) for k in range(len(self.parent))], np.int64)


def block_pairs(rows: DataFrame, key: str, node: str, most: int, star: bool = False) -> DataFrame:
    """``rows`` with block_a and block_b so that any two rows of a key meet in exactly one (key, block_a, block_b)
    where they are in different blocks or, for one block, in (b, b); keys of up to ``most`` rows stay whole.

    A larger key is cut into blocks by a hash of the node, each row goes to the pairs of its own block with every
    block. The column ``own`` names the row's block. The large keys are written first, so that their join needs
    no shuffle by the key while they are few, and one that can be split when they aren't. With ``star`` a block meets
    the first one only: in a group whose members are mostly alike that finds one component without a quadratic step.
    """
    sizes = rows.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("_blocks"))
    sizes = materialise(sizes, "sizes")
    cut = rows.join(sizes, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    if star:
        others = F.when(F.col("own") > 0, F.array(F.lit(0))).when(F.col("_blocks") > 1, F.sequence(F.lit(1), F.col("_blocks") - 1)).otherwise(others)
    cut = cut.withColumn("_other", F.explode(others))
    return cut.withColumns({"block_a": F.least("own", "_other"), "block_b": F.greatest("own", "_other")}).drop("_blocks", "_other")


def unsettled_pairs(rows: DataFrame, key: str, node: str, part: str, most: int) -> DataFrame:
    """``rows`` with block_a and block_b so that any two rows of a key with different ``part`` meet in exactly one (key,
    block_a, block_b). Rows of a large key's largest part, which are settled among themselves, meet only the others, so
    the work on a group that is mostly one component follows its size times the rest, not its square."""
    counts = rows.groupBy(key, part).count()
    sizes = counts.groupBy(key).agg(F.sum("count").alias("_all"), F.max(F.struct("count", part)).alias("_m")).where(F.col("_all") > most)
    rest, whole = F.greatest(F.lit(1), F.ceil((F.col("_all") - F.col("_m")["count"]) / most)), F.ceil(F.col("_m")["count"] / most)
    sizes = materialise(sizes.select(key, F.col("_m")[part].alias("_large"), rest.cast("int").alias("_rest"), whole.cast("int").alias("_whole")), "sizes")
    cut = rows.join(sizes, key, "left")
    one, large, hashed = F.col("_rest").isNull(), F.col(part) == F.col("_large"), F.xxhash64(node)
    own = F.when(one, 0).when(large, F.col("_rest") + F.pmod(hashed, F.col("_whole"))).otherwise(F.pmod(hashed, F.col("_rest"))).cast("int")
    last = F.when(one, 0).when(large, F.col("_rest") - 1).otherwise(F.col("_rest") + F.col("_whole") - 1)
    cut = cut.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return cut.withColumns({"block_a": F.least("own", "_other"), "block_b": F.greatest("own", "_other")}).drop("_large", "_rest", "_whole", "_other")
