"""Language identification by cross-parsing entropy.

A suffix automaton of a sample of labelled text is built for each language. A text is cut, from left to right,
into the longest phrases that occur in the sample; the language whose phrases code the text in the fewest bits
for each character wins. Texts are small letters with one gap for every run of other characters, as UTF-8 bytes, so
a letter of any script is covered. Automata are dense transition tables, and blocks of many texts are walked in step;
a block whose parse didn't begin in the state in which the block before it ended is walked again from that state, so
phrases are those of the whole text.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import add_columns

#: Symbols: a byte that no sample has and so matches nothing, the end of a sample text, and the first byte.
STRANGE, BETWEEN, FIRST_BYTE = 0, 1, 2
GAP = 0x20
#: Symbols of a text that are parsed in step with other blocks, and symbols before them from which a parse begins.
BLOCK, LEAD = 256, 48
#: Characters of a text that are parsed together; a longer text is parsed piece by piece.
PIECE = 1 << 20
ROWS_PER_LANGUAGE, SAMPLE_CHARS, PASSAGE_CHARS = 256, 24_000, 8_000
#: Cells of all transition tables together; with many languages each has a smaller sample.
MOST_CELLS = 1 << 26
UNDETERMINED = "und"

GUESS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_char", T.DoubleType())])


@dataclass
class Parser:
    languages: list[str]
    symbols: np.ndarray
    width: int
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


_letters: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For every code point, whether it is part of a word; kept between calls."""
    if not _letters:
        _letters["all"] = np.array([is_letter(chr(c)) for c in range(0x110000)])
    return _letters["all"]


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all normalised texts, where each begins and ends, and its number of characters."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    word = letters()[codes]
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = word[bounds[:-1][np.diff(bounds) > 0]]
    kept = np.where(word, codes, GAP)[keep].astype(np.uint32)
    sums = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    bounds = sums[bounds]
    sizes = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(1 + (kept >= 0x80) + (kept >= 0x800) + (kept >= 0x10000), out=sizes[1:])
    data = np.frombuffer(kept.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    return data, sizes[bounds], np.diff(bounds)


def is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


def suffix_automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links of the smallest automaton of all substrings."""
    moves: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for s in symbols:
        now = len(moves)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = now
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if longest[q] == longest[p] + 1:
                link[now] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return moves, link


def build(samples: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS, most_cells: int = MOST_CELLS) -> Parser:
    """One automaton for each language from its texts in their order, up to about ``sample_chars`` characters (at
    least one text's beginning). The tables have at most about ``most_cells`` cells together."""
    chosen: dict[str, list[str]] = {}
    for lang in sorted(samples):
        chosen[lang], size = [], 0
        for text in samples[lang]:
            if size >= sample_chars:
                break
            chosen[lang].append(text.lower()[: sample_chars - size])
            size += len(chosen[lang][-1])
    normal = {lang: normalised(texts) for lang, texts in chosen.items()}
    seen = np.unique(np.concatenate([np.array([GAP], np.uint8), *[data for data, _, _ in normal.values()]]))
    symbols = np.zeros(256, np.int32)
    symbols[seen] = np.arange(len(seen)) + FIRST_BYTE
    width = 1 << (len(seen) + FIRST_BYTE - 1).bit_length()
    most_bytes = max(64, most_cells // (2 * width * max(1, len(chosen))))  # an automaton has up to two states a byte
    tables, roots, bits, offset = [], [], [], 0
    for lang, (data, bounds, _) in normal.items():
        sample: list[int] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            sample += [*symbols[data[a : min(b, a + most_bytes - len(sample))]].tolist(), BETWEEN]
            if len(sample) >= most_bytes:
                break
        moves, _ = suffix_automaton(sample)
        # Where a phrase can't go on, a new one begins, which the lowest bit tells. The last row is the state
        # between phrases: at the start, and after a symbol that the sample lacks and that is a phrase alone.
        apart = offset + len(moves) * width
        fresh = np.full(width, apart * 2 + 1, np.int64)
        for s, to in moves[0].items():
            fresh[s] = (offset + to * width) * 2 + 1
        table = np.tile(fresh, (len(moves) + 1, 1))
        for state, out in enumerate(moves):
            for s, to in out.items():
                table[state, s] = (offset + to * width) * 2
        tables.append(table.ravel().astype(np.int32))
        roots.append(apart)
        bits.append(np.log2(max(2, len(sample))))
        offset += table.size
    if offset * 2 >= 1 << 31:
        raise ValueError("the automata are too large: allow fewer cells")
    return Parser(list(chosen), symbols, width, np.concatenate(tables) if tables else np.zeros(0, np.int32), np.array(roots, np.int32), np.array(bits))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", rows: int = ROWS_PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS, passage: int = PASSAGE_CHARS) -> Parser:
    """Learn from a bounded sample: for each language about ``rows`` texts, chosen by a hash of ``order`` and the text,
    of which the first up to ``sample_chars`` characters are used. Of a text longer than ``passage`` characters a
    passage of that many is taken, at a place given by the hash; so a language with only long texts is learned too.

    A first pass counts rows by language from narrow columns; the second keeps a share of each language, so at
    most about 3 * ``rows`` passages for each language reach the driver, whatever the size or skew of the corpus.
    Rows without a text, a language or a letter teach nothing; with no others, every text is undetermined.
    """
    told = F.col(f"`{text}`").cast("string")
    rows_of = docs.where(F.col(f"`{lang}`").isNotNull() & told.isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), told.alias("text"), F.pmod(F.xxhash64(F.col(f"`{order}`"), told), F.lit(1 << 30)).alias("h"))
    rows_of = rows_of.where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows_of.groupBy("lang").count().collect()}
    if not counts:
        return build({})
    share = F.lit(0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1 << 30, int((1 << 30) * 2 * rows / n) + 1))).otherwise(share)
    size = F.char_length("text")
    place = F.when(size > passage, F.pmod(F.col("h"), size - passage)).otherwise(0)
    sample = rows_of.where(F.col("h") < share).select("lang", "h", F.substring(F.col("text"), (place + 1).cast("int"), F.lit(passage)).alias("text"))
    found: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        if len(found.setdefault(r["lang"], [])) < rows:
            found[r["lang"]].append(r["text"])
    return build(found, sample_chars)


def walk(parser: Parser, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in each stretch of symbols, parsed from ``state`` on, and the state at its end."""
    order = np.argsort(-size, kind="stable")
    start, size, now = start[order], size[order], state[order]
    begun = np.zeros(len(now), np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))  # stretches longer than t
        moved = parser.table[now[:n] + symbols[start[:n] + t]]
        begun[:n] += moved & 1
        now[:n] = moved >> 1
    phrases, end = np.empty_like(begun), np.empty_like(now)
    phrases[order], end[order] = begun, now
    return phrases, end


def parse(parser: Parser, symbols: np.ndarray, bounds: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text (columns) in each language (rows), and the states at the texts' ends. ``state`` holds
    the states in which the texts are entered, if they go on from something."""
    lengths = np.diff(bounds)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    n, langs = len(owner), len(parser.roots)
    if state is None:
        state = np.repeat(parser.roots[:, None], len(lengths), axis=1)
    if not n:
        return np.zeros((langs, len(lengths))), state
    start = bounds[owner] + nth * BLOCK
    size = np.minimum(BLOCK, bounds[owner + 1] - start)
    every = lambda x: np.tile(x, langs)
    # A block's state is guessed by a parse from some symbols before it; the first block's is known.
    lead = np.where(nth > 0, LEAD, 0)
    known = np.where(every(nth) == 0, state[:, owner].ravel(), np.repeat(parser.roots, n))
    _, entered = walk(parser, symbols, every(start - lead), every(lead), known.astype(np.int32))
    begun, left = walk(parser, symbols, every(start), every(size), entered)
    after = np.flatnonzero(every(nth) > 0)
    while len(wrong := after[entered[after] != left[after - 1]]):
        entered[wrong] = left[wrong - 1]
        begun[wrong], left[wrong] = walk(parser, symbols, every(start)[wrong], every(size)[wrong], entered[wrong])
    counts = np.stack([np.bincount(owner, begun[k * n : (k + 1) * n], len(lengths)) for k in range(langs)]) if langs else np.zeros((0, len(lengths)))
    end = state.copy()
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    end[:, owner[last]] = left.reshape(langs, n)[:, last]
    return counts, end


def costs(parser: Parser, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text (columns) in each language (rows), and the texts' characters."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        # A long text goes on in the state in which its last piece was left. The character before a piece is looked at
        # with it, as it tells whether the piece begins with a gap.
        text, total, chars, state = texts[0], np.zeros((len(parser.roots), 1)), np.zeros(1, np.int64), None
        for at in range(0, len(text), PIECE):
            data, bounds, n = normalised([text[max(0, at - 1) : at + PIECE]])
            if at and is_letter(text[at - 1]):
                lead = len(text[at - 1].encode("utf-8", "surrogatepass"))
                data, bounds, n = data[lead:], bounds - [0, lead], n - 1
            counts, state = parse(parser, parser.symbols[data], bounds, state)
            total, chars = total + counts, chars + n
        return total * parser.bits[:, None], chars
    data, bounds, chars = normalised(texts)
    return parse(parser, parser.symbols[data], bounds)[0] * parser.bits[:, None], chars


def judge(parser: Parser, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    low = [(t or "").lower() for t in texts]
    worded = np.array([any(c.isalpha() for c in t) for t in low], bool)
    if not len(parser.roots):
        return [UNDETERMINED] * len(low), np.zeros(len(low)), np.zeros(len(low))
    bits, chars = costs(parser, low)
    cost = bits / np.maximum(1, chars)
    best = np.argmin(cost, axis=0)
    least = cost[best, np.arange(len(low))]
    rest = cost.copy()
    rest[best, np.arange(len(low))] = np.inf
    second = rest.min(axis=0)
    score = np.where(np.isinf(second), 1.0, 1.0 / (1.0 + least / np.maximum(second, 1e-300)))
    return [parser.languages[k] if ok else UNDETERMINED for k, ok in zip(best, worded, strict=True)], np.where(worded, score, 0.0), np.where(worded, least, 0.0)


def identify(spark: SparkSession, docs: DataFrame, parser: Parser, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score (0 to 1) and bits_per_char, from the whole text.

    A null text, an empty one and one without a letter are ``und`` with a score of 0; so is every text if nothing
    could be learned. Equal costs go to the first language by name. Very long texts are parsed piece by piece, each
    going on where the last one ended. Rows are independent: repeated rows and null keys are kept, and an empty table
    gives an empty one. No shuffle; the broadcast automata are bounded by ``MOST_CELLS``.
    """
    shared = spark.sparkContext.broadcast(parser)

    def make():
        def work(column):
            langs, score, bits = judge(shared.value, column.to_pylist())
            return [pa.array(langs, pa.string()), pa.array(score), pa.array(bits)]

        return work

    return add_columns(docs, text, keep, GUESS, make)
