"""Packing with optimal length buckets.

A global histogram of lengths feeds a dynamic program that picks the bucket boundaries with the least padding;
batches of at most ``budget`` padded tokens are then formed inside each bucket. Ranks inside a bucket come from
counts of many small chunks, so no bucket is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import materialise


def text_length(column: str):
    """Tokens of a text: its words, [^\\x20\\x09-\\x0D]+, and one end; a null text is only an end."""
    return (F.coalesce(F.regexp_count(F.col(f"`{column}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def best_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding over the histogram.

    ``histogram`` holds (length, rows). Among equal costs the one with fewer buckets wins. The cost of one
    bucket up to length x is x * rows - tokens, so each layer of the program asks for the lowest of a set of
    lines whose slopes fall, which a hull answers in linear time.
    """
    histogram = sorted((int(a), int(n)) for a, n in histogram if n)
    if not histogram:
        return []
    lengths, rows, tokens = [0], [0], [0]
    for length, n in histogram:
        lengths.append(length)
        rows.append(rows[-1] + n)
        tokens.append(tokens[-1] + n * length)
    size = len(histogram)
    best = [0] + [None] * size
    layers: list[list[int]] = []
    least, used = None, 0
    for layer in range(min(buckets, size)):
        now: list[int | None] = [None] * (size + 1)
        came = [0] * (size + 1)
        hull: list[tuple[int, int, int]] = []
        at = 0
        for j in range(layer, size + 1):
            x = lengths[j]
            if j > layer and hull:
                at = min(at, len(hull) - 1)
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                    at += 1
                slope, start, i = hull[at]
                now[j] = x * rows[j] - tokens[j] + slope * x + start
                came[j] = i
            if best[j] is not None:
                line = (-rows[j], best[j] + tokens[j], j)
                while len(hull) >= 2:
                    (a1, b1, _), (a2, b2, _) = hull[-2], hull[-1]
                    if (line[1] - b1) * (a1 - a2) <= (b2 - b1) * (a1 - line[0]):
                        hull.pop()
                    else:
                        break
                hull.append(line)
        layers.append(came)
        best = now
        if now[size] is not None and (least is None or now[size] < least):
            least, used = now[size], layer + 1
    out, j = [], size
    for layer in range(used - 1, -1, -1):
        out.append(lengths[j])
        j = layers[layer][j]
    return sorted(out)


def length_histogram(docs: DataFrame, length: str, budget: int) -> list[tuple[int, int]]:
    """Rows by length up to ``budget``: at most ``budget`` entries, whatever the size of the corpus."""
    return [(r[0], r[1]) for r in docs.where(F.col(length) <= budget).groupBy(length).count().collect()]


def pack(docs: DataFrame, keep: list[str], order: str = "doc_id", text: str = "text", budget: int = 65536, buckets: int = 16, chunk_rows: int = 20000) -> DataFrame:
    """``keep`` columns of ``docs`` with n_tokens, bucket, boundary, batch_id, slot and padding.

    A batch holds floor(budget / boundary) rows of one bucket, so its padded size stays within ``budget``; a row
    longer than ``budget`` has its own bucket (the last) and a batch to itself without padding. Every row is
    placed, ties and repeated rows too: rows of a bucket are ranked by a hash of (order, text). Null and empty
    texts have one token. An empty table gives an empty result.
    """
    own = ["n_tokens", "bucket", "boundary", "batch_id", "slot", "padding"]
    names = [c for c in keep if c not in own]
    measured = [text_length(text).alias("n_tokens"), F.xxhash64(F.col(f"`{order}`"), F.col(f"`{text}`")).alias("_h")]
    placed = docs.select(*[f"`{c}`" for c in names], *measured)
    # Counts need two numbers of a row, which are written so that the texts aren't read for each of them.
    counted = materialise(docs.select(*measured), "lengths")
    histogram = length_histogram(counted, "n_tokens", budget)
    bounds = best_boundaries(histogram, buckets)
    chunks = max(1, -(-sum(n for _, n in histogram) // chunk_rows))
    bucket, boundary = F.lit(len(bounds)), F.col("n_tokens")
    for k, bound in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(k)).otherwise(bucket)
        boundary = F.when(F.col("n_tokens") <= bound, F.lit(bound).cast("long")).otherwise(boundary)
    placed = placed.withColumns({"bucket": bucket, "boundary": boundary, "_chunk": F.pmod(F.col("_h"), F.lit(chunks)).cast("int")})
    inside = Window.partitionBy("bucket", "_chunk").orderBy("_h", *names)
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1)
    sizes = counted.select(bucket.alias("bucket"), F.pmod(F.col("_h"), F.lit(chunks)).cast("int").alias("_chunk")).groupBy("bucket", "_chunk").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = ranked.join(sizes, ["bucket", "_chunk"])
    place = F.col("_before") + F.col("_rank")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("boundary"))).cast("long")
    batch = F.floor(place / room).cast("long")
    return out.select(*names, "n_tokens", "bucket", "boundary", F.concat_ws("-", "bucket", batch).alias("batch_id"), F.pmod(place, room).alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"))
