import hashlib
import random

import pytest
from pyspark.sql import functions as F

from framewise.llm import repeats


def brute(rows, depth):
    """rows: (id, text); ids are distinct."""
    first = {}
    out = {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - depth + 1):
            if first.setdefault(data[p : p + depth], (doc, p)) != (doc, p):
                gone[p : p + depth] = b"\1" * depth
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["ab", "the", "é", "qu", "zzz", "x1", "of", "ü", "longer", "tion"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 90))) for _ in range(6)]
    rows = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.1 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.2 and rows:
            text = list(rng.choice(rows)[1] or "x")
            for _ in range(2):
                text[rng.randrange(len(text))] = "#"
            text = "".join(text)
        elif kind < 0.3:
            text = rng.choice(["a", "ab", "abc"]) * rng.randint(0, 300)
        else:
            text = " ".join([" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(passages), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))])
        rows.append((k * 7 % 1009, text))
    return rows + [(2000, None), (2001, ""), (2002, "é" * 400), (2003, "é" * 400)]


@pytest.mark.parametrize(("seed", "often", "sizes"), [(1, 32, {}), (2, 2, {"step": 700}), (3, 32, {"group": 8}), (4, 4, {"group": 40, "step": 5000})])
def test_matches_brute_force(spark, monkeypatch, seed, often, sizes):
    monkeypatch.setattr(repeats, "LEAST", often)
    monkeypatch.setattr(repeats, "SAMPLE", 32 if often > 2 else 2)
    rows = corpus(seed, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("runs", F.lit(1)).withColumn("gram", F.lit("x"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated_passages(docs, **sizes).collect()}
    assert got == brute(rows, repeats.DEPTH)


def test_repeated_rows_null_keys_and_empty_table(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (5, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in repeats.repeated_passages(docs).collect()), key=str)
    own = brute([(0, text)], 100)[0][1]
    assert got == sorted([(1, 300), (1, 300), (5, 300), (None, own)], key=str)
    assert repeats.repeated_passages(docs.limit(0)).collect() == []


def test_very_long_text_and_texts_under_one_key(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    long += long[1000:3000] + "é" * 500
    texts = ["x" + long[5000:5400], "y" + long[5000:5400], "", None]
    docs = spark.createDataFrame([(1, long), *[(7, t) for t in texts]], "doc_id long, text string").withColumn("file", F.lit(3)).withColumn("a.b", F.lit(1))
    got = repeats.repeated_passages(docs, step=20_000).collect()
    first = brute([(1, long)], 100)[1]
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] == 1] == [first]
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got if r["doc_id"] == 7) == [(0, 0), (0, 0), (401, 400), (401, 400)]


def test_refine_finds_the_equal_members():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (500, 9)).astype(np.uint64)
    group = rng.integers(0, 3, 500)
    member, found = repeats.refine(group, [lambda m, k=k: rows[m, k] for k in range(9)])
    wanted = {}
    for k in range(500):
        wanted.setdefault((group[k], *rows[k].tolist()), set()).add(k)
    got = {}
    for k, g in zip(member.tolist(), found.tolist(), strict=True):
        got.setdefault(g, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in wanted.values() if len(x) > 1)
