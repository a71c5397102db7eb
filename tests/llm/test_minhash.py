import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framewise.llm import minhash
from framewise.llm.components import Sets, components, unsettled_pairs


def brute_sets(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows, percent=85):
    sets = [brute_sets(t) for _, t in rows]
    joined = Sets(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                joined.join(a, b)
    roots = joined.roots()
    least = {}
    for k, r in enumerate(roots.tolist()):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], len(sets[k]), least.get(r)) for k, r in enumerate(roots.tolist())), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(3000)]
    rows = []
    for family in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 200, 400]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) * 31 % 1013, " ".join(words)))
    return rows + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "only three words"), (5004, "ONLY three  words"), (5005, "a"), (5006, "Ä b c d e f"), (5007, "ä b c d e f")]


def test_matches_brute_force(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("node", F.lit(0)).withColumn("size", F.lit("x"))
    got = minhash.near_duplicates(docs, block=16, star=6).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (9, "a b c d e f g"), (9, "other words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 3, 7, True), (7, 3, 7, True), (None, 3, 7, False), (9, 3, 7, False), (9, 1, 9, True), (None, 0, None, False)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_rows_of_different_parts_meet_once(spark):
    rng = random.Random(6)
    rows = [(key, n, rng.choice([1, 1, 1, 1, 2, 3])) for key, size in ((1, 90), (2, 5), (3, 40)) for n in range(size)]
    cut = unsettled_pairs(spark.createDataFrame(rows, "bucket long, node long, part long"), "bucket", "node", "part", 16)
    tasks = {}
    for r in cut.collect():
        tasks.setdefault((r.bucket, r.block_a, r.block_b), []).append((r.node, r.part))
    assert max(map(len, tasks.values())) < 60
    for key in (1, 2, 3):
        own = [(n, p) for k, n, p in rows if k == key]
        for a in own:
            for b in own:
                if a[0] < b[0] and a[1] != b[1]:
                    assert any(a in t and b in t for (k, _, _), t in tasks.items() if k == key)


def test_one_row_of_each_stays(spark):
    text, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"x{k}" for k in range(60))
    rows = [(5, text), (3, text + " more"), (3, text + " more"), (None, text), (None, other), (None, other), (3, "quite another text"), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("file", F.lit("f")).withColumn("a.b", F.lit(1)).withColumn("component_id", F.lit(2))
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, text + " more"), (None, other), (3, "quite another text"), (8, None), (8, None), (9, "")], key=str)
    assert minhash.one_of_each(docs.limit(0)).collect() == []


def test_long_words_that_fool_sums_of_powers_differ():
    bits = "0"
    while len(bits) < 2048:
        bits += "".join("1" if b == "0" else "0" for b in bits)
    a, b = bits, "".join("1" if x == "0" else "0" for x in bits)
    words = lambda x: x.replace("0", "p").replace("1", "q")
    one, two = minhash.shingle_sets(pa.array([words(a), words(b)]))
    assert one[0] != two[0]


def test_signatures_within_the_distance_always_meet():
    rng = np.random.RandomState(5)
    distance = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    a = rng.randint(0, 1 << 16, (300, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.SYMBOLS, distance, replace=False)
        row[at] ^= 1
    x, y = minhash.chunk_keys(a), minhash.chunk_keys(b)
    assert (x == y).any(axis=1).all()
    assert not (x == np.roll(y, 1, axis=0)).any()


def test_minima_estimate_similarity():
    rng = np.random.RandomState(1)
    base = rng.randint(0, 1 << 62, 2000).astype(np.uint64)
    other = np.unique(np.concatenate([base[200:], rng.randint(0, 1 << 62, 200).astype(np.uint64)]))
    same = (minhash.signatures([np.unique(base)], 400) == minhash.signatures([other], 400)).mean()
    assert abs(same - 1800 / 2200) < 0.07


def test_shingle_sets_count(spark):
    texts = ["a b c d e f", "A b c d e f", "a b", None, "", "a\x85b c"]
    assert [len(s) for s in minhash.shingle_sets(pa.array(texts))] == [2, 2, 1, 0, 0, 1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(60)] + [(-5, 3), (8, 8)]
    joined = Sets(2000)
    for a, b in edges:
        joined.join(a % 2000, b % 2000)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    for a, b in edges:
        if a != b:
            assert got[a] == got[b]
    by_root = {}
    for n, r in got.items():
        by_root.setdefault(r, set()).add(n)
    assert all(r == min(m) for r, m in by_root.items())
    assert len(by_root) == len({joined.root(n % 2000) for n in nodes})
