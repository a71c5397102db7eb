"""WARC archives, embeddings, packing and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import packing, vectors, warc
from framewise.llm.components import Sets

# -- WARC -------------------------------------------------------------------------------------------------------


def pages(spark):
    rows = [(1, "http://www.B.example:80/x?y#z", "<p>é</p>"), (2, "https://b.example/x?y", "<p>é</p>"), (3, None, None), (4, "not a url", ""), (5, "http://[broken", "a\r\n\r\nb\r\n\r\n"), (6, "http://c.example", "x" * 300000), (7, "http://c.example/\r\nEvil: 1", "WARC/1.1\r\n\r\n"), (None, "http://c.example/n", "<p>é</p>"), (2, "https://b.example/again", "<p>é</p>")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))


@pytest.mark.parametrize("block_lines", [2, 3000])
def test_archives_round_trip(spark, block_lines):
    rows, df = pages(spark)
    directory, archives, index = warc.archive(spark, df, block_lines=block_lines)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(directory, archives, index).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = max(p for p, _, h in rows if p is not None and (h or "") == (html or ""))
        revisit = page is not None and page < last
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=str)
    asked = df.union(df)
    for most in (1 << 20, 0):
        found = warc.find(directory, archives, index, asked, most=most)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()), key=str) == got
    some = warc.find(directory, archives, index, df.where("page_id = 7 or page_id is null"))
    assert sorted((r.page_id for r in some.collect()), key=str) == [7, None]
    held = [r for r in warc.read_archives(directory, archives, index).collect() if r.record_type == "response" and r.page_id is not None]
    assert all(bytes(r.payload).decode() == next(h or "" for p, _, h in rows if p == r.page_id) for r in held)


def test_small_payloads_are_never_revisits(spark):
    _, df = pages(spark)
    directory, archives, index = warc.archive(spark, df, least=100)
    assert {r.record_type for r in warc.read_archives(directory, archives, index).collect()} == {"response"}


def test_lookup_by_url(spark):
    _, df = pages(spark)
    directory, archives, index = warc.archive(spark, df, block_lines=2)
    held = warc.Directory(directory)
    assert [x[0] for x in warc.lookup(held, archives, index, ["http://b.example/x?y"])] == [1, 2]
    assert warc.lookup(held, archives, index, ["http://nowhere.example/"]) == []
    assert held.first == sorted(held.first) and held.last == sorted(held.last)


def test_a_key_with_many_captures_lies_in_many_blocks(spark):
    rows = [(k, "http://hot.example/" if k % 3 else f"http://c{k}.example/é", "x" * k) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    directory, archives, index = warc.archive(spark, df, block_lines=5)
    held = warc.Directory(directory)
    assert len(held.blocks(warc.url_key("http://hot.example/"))) >= 133 // 5
    assert sorted(r.page_id for r in warc.find(directory, archives, index, df).collect()) == list(range(200))
    assert sorted(x[0] for x in warc.lookup(held, archives, index, ["http://hot.example/"])) == [k for k in range(200) if k % 3]
    assert [x[0] for x in warc.lookup(held, archives, index, ["http://c9.example/é"])] == [9]
    keys = [r.first_key for r in directory.orderBy("first_key").collect()]
    assert keys == sorted(keys)


def test_empty_archive(spark):
    _, df = pages(spark)
    directory, archives, index = warc.archive(spark, df.limit(0))
    assert warc.read_archives(directory, archives, index).collect() == []
    assert warc.find(directory, archives, index, df).collect() == []


def test_url_keys_and_broken_records():
    assert warc.url_key("HTTP://User@www2.Sub.Example.com:8080/A?b=c#d") == "com,example,sub,)/A?b=c"
    assert warc.url_key(None) == ""
    data = warc.record(1, "u", b"payload", warc.digest32(b"payload"), None, "2024-01-01T00:00:00Z")
    assert warc.parse(gzip.decompress(gzip.compress(data)))[1] == b"payload"
    with pytest.raises(ValueError, match="truncated"):
        warc.parse(data[:-3])


# -- embeddings -------------------------------------------------------------------------------------------------


def brute_links(rows, cosine):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links, sets = [0] * len(rows), Sets(len(rows))
    for a, b in itertools.combinations(unit, 2):
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
            links[a] += 1
            links[b] += 1
            sets.join(a, b)
    least = {}
    for k, r in enumerate(sets.roots().tolist()):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], links[k], least.get(r)) for k, r in enumerate(sets.roots().tolist())), key=str)


def vector_rows(seed):
    rng = np.random.RandomState(seed)
    rows = []
    for family in range(30):
        centre = rng.standard_normal(32)
        for _ in range(rng.choice([1, 2, 6, 40])):
            v = centre + rng.standard_normal(32) * rng.choice([0.0, 0.05, 0.15])
            rows.append((len(rows) * 17 % 4001, [float(np.float32(x)) for x in v], int(family % 3)))
    nan, inf = float("nan"), float("inf")
    return rows + [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, [nan] * 32, 1), (9003, [1.0, None] * 16, 1), (9004, rows[0][1], None), (9005, [inf] * 32, 1), (9006, rows[0][1][:5], 0), (9007, [2 * x for x in rows[0][1][:5]], 0), (9008, [], 0), (None, rows[3][1], rows[3][2]), (rows[5][0], rows[5][1], rows[5][2])]


@pytest.mark.parametrize("block", [2048, 16])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = vector_rows(4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).repartition(5)
    got = vectors.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(rows, vectors.COSINE)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.RandomState(1)
    x = vectors.unit(rng.standard_normal((300, 64)))
    y = vectors.unit(x + 0.1 * rng.standard_normal((300, 64)))
    q = vectors.rotation(64, 0)
    assert np.allclose(q @ q.T, np.eye(64))
    code = y @ q.T
    signs = np.where(code >= 0, 1, -1) / 8
    factor = (code * signs).sum(axis=1)
    error = ((x @ q.T) * signs).sum(axis=1) / factor - (x * y).sum(axis=1)
    bound = vectors.EPSILON * np.sqrt(1 - factor**2) / factor / np.sqrt(63)
    assert abs(error.mean()) < 0.02 and (np.abs(error) <= bound).all()
    codes = vectors.encode(x)
    i, j, exact = vectors.linked_pairs(codes, codes, x, x, 0.98)
    assert (i == j).all() and len(i) == 300 and exact < 300 * 30


@pytest.mark.parametrize("dim", [1, 3, 64, 70, 200])
def test_stored_codes_estimate_inner_products(dim):
    rng = np.random.RandomState(dim)
    x = vectors.unit(rng.standard_normal((200, dim)))
    y = vectors.unit(x + rng.choice([0.02, 0.2, 1.0], (200, 1)) * rng.standard_normal((200, dim)))
    wanted = x @ y.T
    for cosine in (0.5, 0.9, 0.98):
        found = {p for i, j in vectors.doubtful(vectors.encode(x), vectors.encode(y), dim, cosine) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert found >= set(zip(*[a.tolist() for a in np.nonzero(wanted >= cosine)], strict=True))
    if dim >= 64:
        assert len(found) < 200 * 60


def test_extreme_norms_link(spark):
    base = [1.0, 2.0, -3.0, 0.5]
    rows = [(k, [x * scale for x in base], 1) for k, scale in enumerate((1e200, 1e-200, 1.0, 1e-300, 1e307))]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [(r.n_links, r.component_id) for r in got] == [(4, 0)] * 5


# -- packing ----------------------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(150):
        histogram = list({rng.randint(1, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}.items())
        most = rng.randint(1, 5)
        lengths = sorted(a for a, _ in histogram)
        cost = lambda bounds: sum((min(b for b in bounds if b >= a) - a) * n for a, n in histogram)  # noqa: B023, E731
        best = min(cost((*c, lengths[-1])) for r in range(min(most, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        got = packing.best_boundaries(histogram, most)
        assert len(got) <= most and cost(got) == best
    assert packing.best_boundaries([], 3) == []


def test_batches_hold_the_budget(spark):
    rng = random.Random(6)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 90)))) for k in range(700)] + [(900, None), (901, ""), (902, "a " * 5000), (903, "b " * 4000), (5, rng.choice("xy")), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("x")).repartition(6)
    got = packing.pack(docs, ["doc_id", "slot"], budget=512, buckets=5, chunk_rows=50).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(k), len((t or "").split()) + 1) for k, t in rows)
    batches = {}
    for r in got:
        batches.setdefault(r.batch_id, []).append(r)
    for members in batches.values():
        assert len({(r.bucket, r.boundary) for r in members}) == 1
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) * members[0].boundary <= 512 or len(members) == 1
        assert all(r.padding == r.boundary - r.n_tokens >= 0 for r in members)
    by_bucket = {}
    for name, members in batches.items():
        by_bucket.setdefault(members[0].bucket, []).append((int(name.split("-")[1]), len(members), members[0].boundary))
    for found in by_bucket.values():
        found.sort()
        assert [b for b, _, _ in found] == list(range(len(found)))
        assert all(n == max(1, 512 // bound) for _, n, bound in found[:-1] if bound <= 512)
    assert packing.pack(docs.limit(0), ["doc_id"]).collect() == []
    histogram = packing.length_histogram(docs.select(packing.text_length("text").alias("n")), "n", 512)
    bounds = sorted({r.boundary for r in got if r.boundary <= 512})
    assert bounds == packing.best_boundaries(histogram, 5)


# -- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_matches_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from framewise.llm import pii, toxicity
    from framewise.llm.queries import PII_KEY

    from .test_minhash import brute
    from .test_texts import brute_hits

    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
        if k % 10 == 1:
            words = rows[-1][1].split()[:-1] + ["changed"]
        if k % 10 == 4:
            words[5:5] = ["vilest", "slur"] * 2
        if k % 10 == 7:
            words.append("mail a.b1@c.example.com")
        rows.append((k, " ".join(words), "en", "s", 0))
    item = rows[2][1].split()[3:15]
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 10 == 4), 0) for k in range(0, 300)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(spark, docs, model, ["doc_id"]).where("score >= 0.7").collect()}
    assert bad == {k for k in range(300) if k % 10 == 4}
    left = [(r[0], r[1]) for r in rows if r[0] not in bad]
    kept = {k for k, _, c in brute(left) if k == c}
    left = [(k, t) for k, t in left if k in kept and not brute_hits(t, [(1, " ".join(item))])[4]]
    assert set(got) == {k for k, _ in left} and 2 not in got
    for k, text in left:
        assert got[k].text == (None if text is None else pii.replace(PII_KEY, text, lambda kind, v: pii.pseudonym(PII_KEY, kind, v))[0])
    assert {r.bucket for r in got.values()} and all(r.n_tokens <= r.boundary for r in got.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "decontamination", "pii", "packing"]


def test_pipeline_links_from_a_similarity_of_four_fifths(spark):
    import corpus_pipeline

    def changed(words, at):
        return [*words[:at], "other", *words[at + 1 :]]

    rows = []
    for k, n in enumerate((49, 50, 55)):  # one changed word inside: (n - 9) / (n + 1) = 0.80, 0.804, 0.821
        words = [f"w{k}x{j}" for j in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed(words, 20)))]
    words = [f"z{j}" for j in range(48)]  # 39 / 49 = 0.796
    rows += [(10, " ".join(words)), (11, " ".join(changed(words, 20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {0, 2, 4, 10, 11}
