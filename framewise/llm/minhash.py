"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gets a signature of b-bit minima. Signatures are cut into chunks; by the
pigeonhole principle two signatures that differ in at most ``distance`` symbols agree in some chunk up to
``distance // chunks`` errors, so each chunk is entered once for every way to leave out that many symbols, and
such pairs are guaranteed to meet. What meets is compared on full shingle sets.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import FOLD, MIX_1, MIX_2, NOT_SPACE, Blocks, Texts, add_columns, materialise, mix64, span_keys
from framewise.llm.components import Sets, block_pairs, components, groups, unsettled_pairs

SHINGLE = 5
#: Symbols of a signature, bits of a symbol, chunks, and errors allowed inside a chunk. All pairs of signatures
#: with at most CHUNKS * (ERRORS + 1) - 1 = 15 differing symbols meet; a pair with a similarity of 0.85 differs
#: in 7.2 symbols on average and fails to meet with a probability of 6e-6.
SYMBOLS, SYMBOL_BITS, CHUNKS, ERRORS = 48, 16, 8, 1
#: Members of a bucket above which it is cut into blocks: in the first round and in the second.
STAR, BLOCK = 512, 1024
_STEP = np.cumprod(np.full(16, MIX_1 | np.uint64(1), np.uint64), dtype=np.uint64)
_TURN = mix64(np.arange(1, 4096, dtype=np.uint64) * MIX_2) | np.uint64(1)

NAME = ["name_a", "name_b"]
FEATURES = T.StructType([T.StructField("n_shingles", T.LongType()), *[T.StructField(c, T.LongType()) for c in NAME], T.StructField("signature", T.BinaryType())])


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit shingles of each row: words [^\\x20\\x09-\\x0D]+ with A-Z folded, ``size`` words to a shingle;
    a row of fewer words has its whole sequence as one, a row without words none."""
    texts = Texts(column)
    start, end, first = texts.words(NOT_SPACE)
    word = span_keys(FOLD[texts.data], start, end)
    n = len(word)
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size if len(whole) else 0):
        whole += word[j : j + len(whole)] * _STEP[j]
    whole = mix64(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(mix64((word[a:b] * _STEP[: b - a]).sum(keepdims=True) + _STEP[b - a + size : b - a + size + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def names(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits that name each set: equal sets, and no others, have equal names; null for an empty set."""
    out = []
    for seed in (MIX_1, MIX_2):
        found = [int(mix64(mix64((s ^ seed) * seed).sum(keepdims=True) + seed).view(np.int64)[0]) if len(s) else None for s in sets]
        out.append(pa.array(found, pa.int64()))
    return out


def signatures(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    """A row of 16-bit minima for each non-empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, symbols), np.uint16)
    joined = np.concatenate(full)
    starts = np.cumsum([0, *[len(s) for s in full[:-1]]])
    out = np.empty((len(full), symbols), np.uint16)
    for k in range(symbols):
        least = np.minimum.reduceat((joined ^ _TURN[k + 2000]) * _TURN[k], starts)
        out[:, k] = (mix64(least) >> np.uint64(64 - SYMBOL_BITS)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray, chunks: int = CHUNKS, errors: int = ERRORS) -> np.ndarray:
    """Keys of each signature: for each chunk, one for every choice of ``errors`` symbols that are left out."""
    edges = np.linspace(0, signature.shape[1], chunks + 1).astype(int)
    wide = signature.astype(np.uint64)
    columns = []
    for c in range(chunks):
        places = range(edges[c], edges[c + 1])
        for out in itertools.combinations(places, min(errors, len(places) - 1)):
            key = np.full(len(wide), len(columns) + 1, np.uint64) * MIX_2
            for p in places:
                if p not in out:
                    key = mix64(key ^ (wide[:, p] + MIX_1))
            columns.append(key)
    return np.stack(columns, axis=1).view(np.int64)


def similar(shared: np.ndarray, a, b, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def link(sets: list[np.ndarray], linked: Sets, percent: int) -> None:
    """Join all sets that are connected by similar pairs, given those already joined.

    A set is compared with all others at once through an index of shingles. Pairs inside one component need no
    look, so sets are taken only while some unseen one lies outside the largest component: of every pair in
    different components one has been compared with everything.
    """
    if linked.count == 1:
        return
    sizes = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(at, kind="stable")
    posting = owner[order]
    begin = np.searchsorted(at[order], np.arange(len(values) + 1))
    first = np.cumsum(sizes) - sizes
    seen = np.zeros(len(sets), bool)
    while True:
        roots = linked.roots()
        largest = np.bincount(roots).argmax()
        left = np.flatnonzero(~seen & (roots != largest)) if seen.any() else np.array([largest])
        if not len(left):
            return
        for i in left.tolist():
            if seen[i] or (len(left) > 1 and linked.root(i) == linked.root(int(largest))):
                continue
            seen[i] = True
            ids = at[first[i] : first[i] + sizes[i]]
            lengths = begin[ids + 1] - begin[ids]
            skip = np.repeat(begin[ids] - (np.cumsum(lengths) - lengths), lengths)
            shared = np.bincount(posting[skip + np.arange(len(skip))], minlength=len(sets))
            for j in np.flatnonzero(similar(shared, sizes[i], sizes, percent) & (shared > 0)).tolist():
                linked.join(i, j)
            if linked.count == 1:
                return


def _verified(members: DataFrame, sets: DataFrame, percent: int, block: int, star: bool = False) -> DataFrame:
    """Edges (node, root) among ``members`` (bucket, node, part): sets of one bucket meet in one task, and each
    set that is connected with another there gets one edge."""
    dealt = block_pairs(members, "bucket", "node", block, True) if star else unsettled_pairs(members, "bucket", "node", "part", block)
    dealt = dealt.join(sets, "node")
    order = ["bucket", "block_a", "block_b"]

    def run(batches):
        for table in groups(batches, order):
            if table.num_rows < 2:
                continue
            node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
            linked = Sets(len(node))
            _, same = np.unique(part, return_inverse=True)
            firsts: dict[int, int] = {}
            for k, p in enumerate(same.tolist()):
                linked.join(firsts.setdefault(p, k), k)
            link([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()], linked, percent)
            roots = linked.roots()
            moved = np.flatnonzero(roots != np.arange(len(roots)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[roots[moved]])], names=["a", "b"])

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, block: int = BLOCK, star: int = STAR) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id and kept.

    Rows are linked if 100 * shared >= ``percent`` * union of their full shingle sets; component_id is the
    smallest key reachable, kept whether it is the row's own. Null, empty and wordless texts have no shingles,
    link with nothing and are their own component; equal sets (by 128 bits over all shingles) are one class, whatever
    their number, and are compared once. Keys are 64-bit integers; a row with a null key takes part with kept false;
    rows that repeat a key are rows of their own. A very long text is one row with one large set. Other columns are not
    looked at. An empty table gives an empty result.

    Two rounds of full comparison: in the first each set goes to its largest bucket only, where blocks meet the first
    one, which settles most groups; in the second all buckets that still hold several components, of which a large
    bucket's largest meets only the rest. No pairs are ever listed.
    """

    def make():
        def work(column):
            sets = shingle_sets(column)
            rows = iter(signatures(sets))
            return [pa.array([len(s) for s in sets], pa.int64()), *names(sets), pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())]

        return work

    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("_text"))
    # A class goes by the least address of its rows, which no other class has.
    rows = Blocks(add_columns(source, "_text", ["key"], FEATURES, make), "signatures").frame
    uid = F.shiftleft(F.col("file").cast("long"), 40) + F.col("row")
    nodes = rows.where("name_a is not null").groupBy(*NAME).agg(F.min("key").alias("least"), F.min(uid).alias("node"), F.first("signature").alias("signature"))
    nodes = materialise(nodes, "nodes")

    def spread(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            keys = chunk_keys(np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1)) if raw else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], names=["node", "bucket"])

    entries = nodes.select("node", "signature").mapInArrow(spread, "node long, bucket long")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")).where("size > 1")
    # Buckets with the same members are one.
    buckets = materialise(sizes.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "buckets")
    members = materialise(entries.join(buckets, "bucket").select("bucket", "node", "size"), "members")

    wanted = nodes.select("node", "least", *NAME).join(members.select("node").distinct(), "node", "left_semi")
    texts = wanted.select("least").distinct()
    held = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("_text"))
    held = held.join(texts, F.col("key").eqNullSafe(F.col("least")), "left_semi")

    def full(column):
        sets = shingle_sets(column)
        return [*names(sets), pa.array([s.tobytes() for s in sets], pa.binary())]

    kind = T.StructType([*[T.StructField(c, T.LongType()) for c in NAME], T.StructField("shingles", T.BinaryType())])
    found = add_columns(held, "_text", [], kind, lambda: full).where("name_a is not null")
    sets = materialise(found.join(wanted.select("node", *NAME), NAME).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    largest = members.groupBy("node").agg(F.max(F.struct("size", "bucket")).alias("m")).select("node", F.col("m.bucket").alias("bucket"))
    first = materialise(_verified(largest.withColumn("part", F.col("node")), sets, percent, star, True), "links")
    parts = materialise(components(first), "parts")
    open_ = members.join(parts, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("part"))
    unsettled = open_.groupBy("bucket").agg(F.min("part").alias("l"), F.max("part").alias("h")).where("l <> h").select("bucket")
    second = _verified(open_.join(unsettled, "bucket", "left_semi"), sets, percent, block)
    roots = components(first.union(second))

    # A class without links is its own component; a component's least key is written before its members, who may
    # be a third of all classes, meet it, so that this join can be split.
    linked = materialise(nodes.select("node", "least").join(roots, "node"), "linked")
    of_root = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id")), "of-root")
    linked = linked.join(of_root, "root").select("node", "component_id")
    placed = nodes.select("node", "least", *NAME).join(linked, "node", "left")
    placed = materialise(placed.select(*NAME, F.coalesce("component_id", "least").alias("component_id")), "placed")
    out = rows.select("key", "n_shingles", *NAME).join(placed, NAME, "left")
    component = F.when(F.col("name_a").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one for each component of near-duplicates: that with the smallest key, a null key last,
    the first of several such rows. Rows without words are all kept. Decisions are about rows, so repeated keys and
    null keys are no exception; all columns stay, whatever their names."""
    blocks = Blocks(docs.select(F.struct("*").alias("_doc")), "rows").frame
    blocks = blocks.select("_doc", (F.shiftleft(F.col("file").cast("long"), 40) + F.col("row")).alias("_uid"))
    classes = near_duplicates(blocks.select("_uid", F.col("_doc").getField(text).alias("_text")), "_uid", "_text", percent)
    keys = blocks.select("_uid", F.col("_doc").getField(key).alias("_key")).join(classes.select("_uid", "component_id"), "_uid")
    first = keys.groupBy("component_id").agg(F.min(F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_uid").alias("u"))).alias("m"))
    gone = keys.join(materialise(first.select(F.col("component_id"), F.col("m.u").alias("_kept")), "kept"), "component_id").where("_uid <> _kept").select("_uid")
    left = blocks.join(materialise(gone, "gone"), "_uid", "left_anti")
    return left.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
