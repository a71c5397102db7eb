"""The registered operator queries: first columns, one row per row of the table, and held-out rows; toxicity and packing
against brute force."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from framewise.llm import oracles, packing, queries, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
    "op2_toxicity": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op3_decontamination": ("documents", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]),
    "op4_pii": ("documents", ["doc_id", "text"]),
    "op5_repeated_passages": ("documents", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    "op6_minhash": ("documents", ["doc_id", "n_shingles", "component_id", "kept"]),
    "op7_warc": ("pages", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]),
    "op8_embeddings": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op9_context_tree": ("documents", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
    "op10_packing": ("documents", ["doc_id"]),
}
HELD_OUT = {"op1_language_id": (5, 0), "op2_toxicity": (3, 1), "op9_context_tree": (5, 1)}


def test_every_query_is_named():
    assert list(queries.QUERIES) == list(COLUMNS) and set(oracles.SQL) <= set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    table, columns = COLUMNS[name]
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(columns)] == columns
    rows = df.collect()
    keys = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(columns[0]).collect()]
    assert sorted(r[0] for r in rows) == sorted(keys)
    if name in HELD_OUT:
        modulus, rest = HELD_OUT[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    if name in ("op1_language_id", "op2_toxicity"):
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op2_toxicity":
        assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    if name == "op1_language_id":
        known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").collect()}
        held = [r for r in rows if r.held_out and r.doc_id in known and r.lang_pred != "und"]
        assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)


def grams(text):
    """Words, pairs of neighbours and pairs around one word, as texts."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return {(0, w) for w in words} | {(d, a, b) for d in (1, 2) for a, b in zip(words, words[d:], strict=False)}


def test_toxicity_query_against_a_loop(spark):
    """The whole query in plain Python: per-coordinate FTRL over the feature numbers of single texts, which are as many as
    the text's different grams but for hash collisions."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = defaultdict(float)
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.doc_id is not None and r.toxic is not None:
            marks[r.doc_id] = max(marks[r.doc_id], float(r.toxic))
    found = {d: sorted(set(toxicity.features(pa.array([t], pa.string()))[1].tolist())) for d, t in texts.items()}
    for d, t in texts.items():
        n_grams = len(grams(t))
        assert n_grams - 4 - n_grams**2 / (1 << toxicity.BITS) <= len(found[d]) <= n_grams  # twice the collisions to expect, and 4

    order = spark.createDataFrame([(d,) for d in texts], "d long").selectExpr("d", "xxhash64(d) AS h").collect()
    bias = -1
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        shrunk = max(0.0, abs(z[i]) - toxicity.L1)
        return -math.copysign(shrunk, z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    held_out = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    learned = [r.d for r in sorted(order, key=lambda r: r.h) if texts[r.d] is not None and r.d in marks and not held_out(r.d)]
    for _, d in itertools.product(range(toxicity.EPOCHS), learned):
        now = {i: weight(i) for i in (*found[d], bias)}
        g = 1 / (1 + math.exp(-max(-35, min(35, sum(now.values()))))) - marks[d]
        for i, w in now.items():
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w
            n[i] += g * g
    got = {r.doc_id: r for r in queries.QUERIES["op2_toxicity"](spark, SF).collect()}
    assert len(learned) > 50 and set(got) == set(texts)
    for d in texts:
        want = 1 / (1 + math.exp(-sum(weight(i) for i in (*found[d], bias))))
        assert got[d].score == pytest.approx(want, abs=1e-5) and got[d].predicted == int(got[d].score >= 0.7)


def test_packing_query_against_brute_force(spark):
    """Lengths by another split, the least padding by a plain program over all boundaries, batches by their contents."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lengths = {d: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) + 1 for d, t in texts.items()}
    got = queries.QUERIES["op10_packing"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == lengths and all(r.padding == r.boundary - r.n_tokens >= 0 for r in got)
    budget, buckets = 65536, 16
    short = Counter(x for x in lengths.values() if x <= budget)
    sizes = sorted(short)
    costs = [0] + [math.inf] * len(sizes)
    for _ in range(buckets):
        nxt = costs[:]
        for j in range(1, len(sizes) + 1):
            cost = 0
            for i in range(j - 1, -1, -1):
                cost += (sizes[j - 1] - sizes[i]) * short[sizes[i]]
                nxt[j] = min(nxt[j], costs[i] + cost)
        costs = nxt
    assert sum(r.padding for r in got if r.n_tokens <= budget) == costs[-1]
    assert len({r.boundary for r in got if r.n_tokens <= budget}) <= buckets
    batches = defaultdict(list)
    for r in got:
        batches[r.batch_id].append(r)
    in_bucket = Counter(r.bucket for r in got)
    for rows in batches.values():
        assert len({(r.bucket, r.boundary) for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or sum(r.boundary for r in rows) <= budget
    for bucket, count in in_bucket.items():
        own = [rows for rows in batches.values() if rows[0].bucket == bucket]
        assert len(own) == math.ceil(count / max(1, budget // own[0][0].boundary))
    assert packing.best_boundaries(list(short.items()), buckets) == sorted({r.boundary for r in got if r.n_tokens <= budget})
