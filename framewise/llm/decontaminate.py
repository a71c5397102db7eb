"""Benchmark decontamination with one Aho-Corasick automaton over word ids.

The vocabulary of the benchmark maps words to small integers; the automaton's keys are the windows of every
item as integer sequences, so a document is scanned once, word by word, whatever the number of items. Hits are
mapped back to character offsets of the original text.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framewise.llm.common import add_columns, materialise

#: Words are runs of these bytes once A-Z is folded: digits, a-z and every byte of a non-ASCII character.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """All runs of ``window`` words; a shorter item is one window, one without words has none."""
    if not words:
        return []
    if len(words) < window:
        return [tuple(words)]
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class Automaton:
    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        import ahocorasick

        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for words in windows_of(words_of((text or "").encode()), window):
                key = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words)
                owners.setdefault(key, set()).update([] if item is None else [item])
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in owners.items():
            self.found.add_word(key, (len(key), sorted(names)))
        if owners:
            self.found.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged runs [first, last] of hit words, and the items whose windows occur."""
        runs: list[list[int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return runs, items
        ids = tuple(map(self.ids.get, words, itertools.repeat(0)))
        for last, (length, names) in self.found.iter(ids):
            items.update(names)
            first = last - length + 1
            while runs and runs[-1][1] >= first - 1:
                first = min(first, runs.pop()[0])
            runs.append([first, last])
        return runs, items


def merge(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and out[-1][1] >= first - 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def char_spans(text: bytes, runs: list[list[int]]) -> list[list[int]]:
    """Character offsets [start, end) of runs of words in the original text."""
    places = [m.span() for m in WORD.finditer(text)]
    return [[len(text[: places[a][0]].decode()), len(text[: places[b][1]].decode())] for a, b in runs]


def _row(raw: bytes, words: int, runs: list[list[int]], items: set[str]) -> tuple:
    names = sorted(items, key=lambda x: x.encode())
    hit = sum(b - a + 1 for a, b in runs)
    return words, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, names, char_spans(raw, runs) if runs else [], runs


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(HITS.fields)]


def _pass(df: DataFrame, text: str, keep: list[str], items: list, window: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)

    def make():
        automaton = Automaton(shared.value, window)

        def work(column):
            rows = []
            for raw in column.cast(pa.large_binary()).to_pylist():
                words = words_of(raw or b"")
                rows.append(_row(raw or b"", len(words), *automaton.scan(words)))
            return _arrays(rows)

        return work

    return add_columns(df, text, keep, HITS, make)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, bound_bytes: int = 8 << 20) -> DataFrame:
    """``keep`` columns of ``docs`` with what each whole text shares with the benchmark.

    Own columns: n_words, n_hit, n_items, items_sha256, contaminated, items (ids as sorted strings), spans
    (character offsets [start, end) of hit runs) and runs (word indexes). A null or empty text has no words and
    no hits; an empty benchmark hits nothing; repeated items count once by id; an item without id still marks
    words but is not named. Documents are scanned where they lie: there is no shuffle.

    The automaton is broadcast, so the benchmark's size is checked first: beyond ``bound_bytes`` of item text
    it is cut into parts by a hash of the id, and the documents are scanned once for each part.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // bound_bytes))
    if parts == 1:
        return _pass(docs, text, keep, [(r["i"], r["t"]) for r in items.collect()], window)
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    names = [c for c in dict.fromkeys([*keep, text]) if c == text or c not in HITS.fieldNames()]
    out, before = docs.select(*names), []
    for k in range(parts):
        held = [(r["i"], r["t"]) for r in items.where(part == k).collect()]
        hits = _pass(out, text, [*names, *before], held, window)
        runs, found = (F.concat("_runs", "runs"), F.array_union("_items", "items")) if k else (F.col("runs"), F.col("items"))
        out, before = materialise(hits.select(*names, runs.alias("_runs"), found.alias("_items")), "hits"), ["_runs", "_items"]
    return _joined(out, text, keep)


def _joined(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Totals of several passes: runs of all parts merged, spans computed on the original text."""
    names = [c for c in keep if c not in HITS.fieldNames()]
    schema = T.StructType([*df.select(*names).schema.fields, *HITS.fields])

    def run(batches):
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = [x or b"" for x in cols[text].cast(pa.large_binary()).to_pylist()]
            rows = [_row(raw, len(words_of(raw)), merge(runs), set(found)) for raw, runs, found in zip(texts, cols["_runs"].to_pylist(), cols["_items"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[cols[n] for n in names], *_arrays(rows)], names=schema.fieldNames())

    return df.mapInArrow(run, schema)
