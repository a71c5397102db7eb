import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from framewise.llm import ctw
from framewise.llm.common import Texts, between_words, pieces


def log_add(a, b):
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Brute:
    """A context tree of dictionaries, mixed by recursion."""

    def __init__(self, texts, depth, share):
        self.depth = depth
        self.counts = [Counter() for _ in range(depth + 1)]
        for text in texts:
            data = bytes(depth) + text + b"\0"
            for i in range(depth, len(data)):
                for k in range(depth + 1):
                    self.counts[k][data[i - k : i], data[i]] += 1
        total = sum(self.counts[0].values())
        sizes = [Counter() for _ in range(depth + 1)]
        for k in range(depth + 1):
            for (context, _), n in self.counts[k].items():
                sizes[k][context] += n
        self.nodes = {c for k in range(depth + 1) for c, n in sizes[k].items() if n >= share * total}

    def pair(self, context, prefix, bits):
        """Zeros and ones after a context and the first ``bits`` bits of a byte."""
        out = [0, 0]
        for byte in range(256):
            if byte >> (8 - bits) == prefix:
                out[byte >> (7 - bits) & 1] += self.counts[len(context)][context, byte]
        return out

    def kt(self, a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def children(self, context):
        return [c for c in self.nodes if len(c) == len(context) + 1 and c[1:] == context]

    def weighted(self, context, prefix, bits):
        own = self.kt(*self.pair(context, prefix, bits))
        below = self.children(context)
        if not below:
            return own, own, 0.0
        rest = np.array(self.pair(context, prefix, bits)) - sum(np.array(self.pair(c, prefix, bits)) for c in below)
        under = sum(self.weighted(c, prefix, bits)[0] for c in below) + self.kt(*rest)
        return log_add(own, under) - math.log(2), own, under

    def chance(self, history, prefix, bits, k=0):
        context = history[len(history) - k :]
        a, b = self.pair(context, prefix, bits)
        below = self.children(context)
        if not below:
            return (b + 0.5) / (a + b + 1)
        whole, own, _ = self.weighted(context, prefix, bits)
        share = math.exp(own - math.log(2) - whole)
        deeper = history[len(history) - k - 1 :] if k < self.depth else None
        if deeper in self.nodes:
            rest = self.chance(history, prefix, bits, k + 1)
        else:
            c, d = np.array([a, b]) - sum(np.array(self.pair(x, prefix, bits)) for x in below)
            rest = (d + 0.5) / (c + d + 1)
        return share * (b + 0.5) / (a + b + 1) + (1 - share) * rest

    def score(self, text):
        data, total = bytes(self.depth) + text + b"\0", 0.0
        for i in range(self.depth, len(data)):
            for bits in range(8):
                one = self.chance(data[i - self.depth : i], data[i] >> (8 - bits), bits)
                total += math.log10(one if data[i] >> (7 - bits) & 1 else 1 - one)
        return total


def corpus(seed=1, n=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(["ab", "ba", "é", " ", "abc"]) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["x" * 300, "", None]


@pytest.mark.parametrize(("unit", "step"), [(2, 1 << 20), (1, 40), (0, 100)])
def test_scores_match_a_recursive_tree(spark, unit, step):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ctw.score(spark, docs, docs.where("doc_id % 2 = 0"), ["doc_id"], depth=2, unit=unit, step=step).collect()}
    brute = Brute([(t or "").encode() for k, t in enumerate(texts) if k % 2 == 0], 2, 0)
    for k in (0, 1, 5, 8, 13, 25, 26, 27):
        assert got[k].score == pytest.approx(brute.score((texts[k] or "").encode()), rel=1e-4)


def grams_of(texts, depth):
    found = Texts(pa.array(texts))
    return np.concatenate([ctw.gram_keys(piece, depth)[1] for piece in pieces(found, 1 << 20, depth)])


def test_every_context_gives_a_distribution():
    grams, n = np.unique(grams_of([t or "" for t in corpus()], 3), return_counts=True)
    levels, _ = ctw.levels_of(grams, n, 3, 0)
    for context in [*np.unique(grams >> 8)[::7].tolist(), 0x010203]:
        assert (10 ** ctw.gram_logs(context << 8 | np.arange(256), levels)).sum() == pytest.approx(1, abs=1e-6)


def test_large_counts_stay_exact():
    """Counts far above a float's 24 bits: every decision's chance stays a chance."""
    grams = np.array([c << 8 | b for c in range(28, 128) for b in (105, 111)])
    levels, sums = ctw.levels_of(grams, (1 << 40) + np.arange(200), 1, 0)
    logs = ctw.gram_logs(grams, levels)
    assert np.isfinite(logs).all() and (10**logs).reshape(-1, 2).sum(axis=1) == pytest.approx(1, abs=1e-6)
    assert sums.zeros[0] + sums.ones[0] == sum(range((1 << 40), (1 << 40) + 200))


def test_pieces_see_the_bytes_before_them():
    text = "".join(t or "" for t in corpus(4, 120))
    for depth in (0, 1, 4):
        whole = grams_of([text, "", "ab"], depth)
        for step in (7, 64, len(text.encode()) - 1):
            cut = np.concatenate([ctw.gram_keys(piece, depth)[1] for piece in pieces(Texts(pa.array([text, "", "ab"])), step, depth)])
            assert cut.tolist() == whole.tolist()
        assert len(whole) == len(text.encode()) + 1 + 1 + 3


def test_words_are_never_cut():
    text = "aa bb\tcccccccccccccc  d " + "e" * 50 + "\nf"
    for step in (1, 2, 5, 11, 100):
        found = [p.data.tobytes() for p in pieces(Texts(pa.array([text])), step, cut=between_words)]
        assert b"".join(found).decode() == text and [w for p in found for w in p.decode().split()] == text.split()


def test_very_long_text_and_clashing_names(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gam", "x" * 9]) for _ in range(300_000))
    rows = [(1, long, 7, "s", 2.0), (2, long[:50_000], 8, "t", 3.0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rare int, `a.b` string, score double")
    got = {r.doc_id: r for r in ctw.score(spark, docs, docs, ["doc_id", "rare", "a.b", "score"], frequent=2).collect()}
    again = {r.doc_id: r for r in ctw.score(spark, docs, docs, ["doc_id"], step=100_000).collect()}
    assert got[1].n_tokens == 300_001 and got[1].n_known == 300_001 and (got[1].rare, got[1]["a.b"], got[None].rare) == (7, "s", None)
    assert got[1].score == pytest.approx(again[1].score, rel=1e-6) and got[1].bits_per_byte < 1


@pytest.mark.parametrize("frequent", [1 << 20, 3, 0])
def test_base_scores_match_brute_force(spark, frequent):
    rows = [(0, "The cat the"), (1, "dog\tThe\ncat É é"), (2, None), (3, ""), (4, "É unseen"), (5, "the the zebra zebra"), (None, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [r for r in rows if r[0] in (0, 1, 2)]
    words = lambda t: [*"".join(c.lower() if c.isascii() else c for c in t or "").split(), None]
    counts = Counter(w for _, t in train for w in words(t))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in ctw.score(spark, docs, docs.where("doc_id < 3"), ["doc_id"], depth=1, frequent=frequent).collect()}
    for doc, text in rows:
        r = got[doc]
        assert r.n_tokens == len(words(text)) and r.train_tokens == n
        assert r.n_known == sum(counts[w] > 0 for w in words(text))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(text)))


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score(spark, docs, docs.limit(0), ["doc_id"]).collect()}
    assert got[1].base_score == 0 and got[1].score == pytest.approx(-3 * 8 * math.log10(2)) and got[2].n_tokens == 1
    assert ctw.score(spark, docs.limit(0), docs, ["doc_id"]).collect() == []
