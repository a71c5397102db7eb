"""Exact repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``depth`` bytes, most significant digit first; a group that has shrunk
to one member is dropped after each digit, and what is left in equal groups are exactly the repeated windows. All
digits are bytes of the texts.

A row for each of the corpus's suffixes would be many times the input, so the suffixes that are sorted are those at
synchronising positions: a window's anchor is the place in it of the ``GRAM`` bytes with the least hash (the leftmost
of equals), which depends on the window's bytes alone. Equal windows have equal bytes from their anchors on and before
them, at equal distances, so consecutive windows with one anchor travel as one run, and a window is the suffix at its
anchor with its first bytes put last.

1. Which anchors can matter: an anchor whose gram occurs once in the corpus starts no repeat. Hashes of grams and the
   numbers of the files that hold them are counted; equal hashes only let a run pass, they decide nothing.
2. First digit: the ``GRAM`` bytes at the anchor, dealt out over the cluster. Groups of one are dropped, equal runs
   (all bytes) are settled at once, and of the others the windows are sorted by eight further bytes at a time.
3. Runs of a gram that is very frequent, by a sample or by its own group's size, go on as single windows; their next
   digit is all bytes, which deals them out again.

Texts are written once as blocks and never shuffled: what travels are hashes, addresses, and bytes of runs that share
a gram with another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import MIX_1, MIX_2, Blocks, Piece, SpanHash, Texts, by_key, byte_values, materialise, mix64, pieces, words_from

DEPTH, GRAM = 100, 32
#: Text bytes that are scanned in one step, and the low bits of a hash that give way to a place in such a step.
STEP, PLACE_BITS = 1 << 20, 22
#: One document in SAMPLE is searched for frequent grams: those with at least LEAST of its anchors and a share of
#: at least SHARE, so at most 1 / SHARE of them.
SAMPLE, LEAST, SHARE = 64, 32, 1e-4
#: Runs of one gram that a task sorts together; a larger group goes on as single windows.
GROUP = 1 << 14
VALUES = byte_values(5)

#: A row of the sort. ``key`` is the digit it is dealt by, ``rest`` the run's other bytes, ``low`` its first window,
#: ``ahead`` the bytes before the anchor, ``windows`` how many. A row that says [low, low + windows) is repeated has
#: ``ahead`` TOLD and a key that only spreads such rows.
ROW = "key binary, rest binary, doc long, said long, low long, ahead int, windows int"
NAMES = [x.split()[0] for x in ROW.split(", ")]
TOLD = -1


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Anchors:
    """Runs of windows of some texts by their anchor: doc, at (the anchor), low and high (first and last window)."""

    def __init__(self, texts: Texts, depth: int = DEPTH, gram: int = GRAM):
        data, bounds = texts.data, texts.bounds
        none = np.zeros(0, np.int64)
        self.doc = self.at = self.low = self.high = self.gram = none
        if len(data) < depth:
            return
        if len(data) >= 1 << PLACE_BITS:
            raise ValueError("too many bytes for one step")
        places = np.arange(len(data) - gram + 1)
        value = SpanHash(data, VALUES).of(places, places + gram)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        least = sliding_least((value & ~mask) | places.astype(np.uint64), depth - gram + 1)
        inside = np.zeros(len(data) + 1, np.int64)
        long = np.diff(bounds) >= depth
        np.add.at(inside, bounds[:-1][long], 1)
        np.add.at(inside, bounds[1:][long] - depth + 1, -1)
        window = np.flatnonzero(np.cumsum(inside)[: len(least)])
        if not len(window):
            return
        anchor = (least[window] & mask).astype(np.int64)
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(window)) - 1
        self.at, self.low, self.high = anchor[starts], window[starts], window[ends]
        self.doc = np.searchsorted(bounds, self.low, side="right") - 1
        self.gram = mix64(value[self.at] ^ MIX_1).view(np.int64)


def word_at(data: np.ndarray, place: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Eight bytes from each place on, so that numbers are ordered as the bytes are; with ``size``, bytes from the
    size-th on count as zero. ``data`` must go on for eight bytes behind every place."""
    out = words_from(data, place, ">")
    if size is not None:
        out &= ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (size.clip(0, 7) * 8).astype(np.uint64)) | np.where(size >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return out


def refine(group: np.ndarray, digits) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: members of ``group`` (numbers) are parted by one digit after the other, and
    groups of one are dropped after each. ``digits`` are functions from members to the digit's values. Returns the
    members that are left, group by group, and their group numbers."""
    member = np.arange(len(group))
    for digit in [None, *digits]:
        if digit is None:
            order = np.argsort(group, kind="stable")
            new = group[order][1:] != group[order][:-1]
        else:
            value = digit(member)
            order = np.lexsort((value, group))
            value = value[order]
            new = (group[order][1:] != group[order][:-1]) | (value[1:] != value[:-1])
        edge = np.concatenate([[True], new, [True]]) if len(order) else np.zeros(1, bool)
        several = ~(edge[:-1] & edge[1:])
        member, group = member[order][several], np.cumsum(edge[:-1])[several]
        if not len(member):
            break
    return member, group


def ranks(doc: np.ndarray, said: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Numbers in the order of occurrences; rows of one document and place have one number."""
    order = np.lexsort((low, said, doc))
    new = np.zeros(len(order), bool)
    new[1:] = (np.diff(doc[order]) != 0) | (np.diff(said[order]) != 0) | (np.diff(low[order]) != 0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def merged(doc: np.ndarray, said: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Unions of byte ranges [start, end) of each (doc, said)."""
    order = np.lexsort((start, said, doc))
    doc, said, start, end = doc[order], said[order], start[order], end[order]
    if not len(doc):
        return doc, said, start, end
    change = np.ones(len(doc), bool)
    change[1:] = (doc[1:] != doc[:-1]) | (said[1:] != said[:-1])
    group = np.cumsum(change)
    reach = np.maximum.accumulate(end + group * (1 << 34)) - group * (1 << 34)
    new = change.copy()
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], said[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each stretch, one stretch after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _batch(key: pa.Array, rest: pa.Array, doc, said, low, ahead, windows) -> pa.RecordBatch:
    numbers = [pa.array(np.asarray(x).astype(t)) for x, t in ((doc, np.int64), (said, np.int64), (low, np.int64), (ahead, np.int32), (windows, np.int32))]
    return pa.RecordBatch.from_arrays([key, rest, *numbers], names=NAMES)


def _told(doc, said, start, end) -> pa.RecordBatch:
    doc, said, start, end = merged(doc, said, start, end)
    spread = mix64(doc.astype(np.uint64) * MIX_1 + start.astype(np.uint64) + MIX_2)
    nothing = np.zeros(len(doc), np.int64)
    return _batch(_binary(spread.view(np.uint8), nothing + 8), _binary(np.zeros(0, np.uint8), nothing), doc, said, start, nothing + TOLD, end - start)


def _as_windows(data: np.ndarray, place: np.ndarray, doc, said, low, depth: int) -> pa.RecordBatch:
    """Single windows: all bytes are the digit they are dealt by."""
    whole = data[_stretches(place, np.full(len(place), depth))] if len(place) else np.zeros(0, np.uint8)
    nothing = np.zeros(len(place), np.int64)
    return _batch(_binary(whole, nothing + depth), _binary(np.zeros(0, np.uint8), nothing), doc, said, low, nothing, nothing + 1)


def _later(member: np.ndarray, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of members of equal groups: those that are another occurrence than their group's first, and those that stand
    for theirs (the first, once). Rows of the first's own document and place are neither."""
    order = np.lexsort((rank[member], group))
    member, group = member[order], group[order]
    new = np.ones(len(member), bool)
    new[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(member)), 0))
    return member[rank[member] != rank[member[first]]], member[new]


def _grams(frequent, depth: int, step: int):
    """Hash of each gram, the file it is in, and whether a step holds it more than once."""

    def run(batches):
        often = np.sort(frequent.value)
        for batch in batches:
            file = batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)] if len(file) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for piece in pieces(Texts(batch.column(0).slice(a, b - a)), step, depth - 1):
                    gram, times = np.unique(Anchors(piece, depth).gram, return_counts=True)
                    rare = ~np.isin(gram, often)
                    gram, times = gram[rare], times[rare]
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(len(gram), file[a], np.int32)), pa.array(times > 1)], names=["gram", "file", "many"])

    return run


def _shared(batches):
    """Of rows sorted by gram: the grams that occur more than once, for each file that holds them."""
    last = None
    for batch in batches:
        gram, file, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "file", "many"))
        if not len(gram):
            continue
        # The row before this batch is held back until its successor is known.
        if last is not None:
            gram, file, many = np.append(last[0], gram), np.append(last[1], file).astype(np.int32), np.append(last[2], many)
        same = np.zeros(len(gram) + 1, bool)
        same[1:-1] = gram[1:] == gram[:-1]
        passes = many | same[:-1] | same[1:]
        # A row that equals its predecessor passes anyway, whatever comes next.
        yield pa.RecordBatch.from_arrays([pa.array(file[:-1][passes[:-1]]), pa.array(gram[:-1][passes[:-1]])], names=["file", "gram"])
        last = (gram[-1], file[-1], bool(passes[-1]))
    if last is not None and last[2]:
        yield pa.RecordBatch.from_arrays([pa.array([last[1]], pa.int32()), pa.array([last[0]], pa.int64())], names=["file", "gram"])


def _open(read, frequent, depth: int, step: int):
    """Runs whose gram is shared, with their bytes; those of a frequent gram as single windows."""

    def run(batches):
        often = np.sort(frequent.value)
        for file, (grams,) in by_key(batches, "file", ["gram"]):
            wanted = np.unique(grams.drop_null().to_numpy())
            for _, part in read(file, ["doc", "said", "text"]):
                ids, says = part.column("doc").to_numpy(), part.column("said").to_numpy()
                for piece in pieces(Texts(part.column("text")), step, depth - 1):
                    yield from _opened(piece, ids[piece.row], says[piece.row], wanted, often, depth)

    return run


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.searchsorted(table, values).clip(max=len(table) - 1)] == values


def _opened(piece: Piece, ids, says, wanted, often, depth: int):
    found = Anchors(piece, depth)
    hot = _among(found.gram, often)
    pick = hot | _among(found.gram, wanted)
    if not pick.any():
        return
    data = np.append(piece.data, np.zeros(8, np.uint8))
    doc, at, low, high, gram, hot = (x[pick] for x in (found.doc, found.at, found.low, found.high, found.gram, hot))
    size = high - low + depth
    row, said, start = ids[doc], says[doc], low - piece.bounds[doc] + piece.start[doc]
    # Runs that equal an earlier one of this step are settled here, before anything is sent.
    words = [lambda m, k=k: word_at(data, np.minimum(low[m] + 8 * k, len(data) - 8), size[m] - 8 * k) for k in range((2 * depth - GRAM + 7) // 8)]
    member, group = refine(gram, [lambda m: (at - low)[m] << 16 | size[m], *words])
    again, _ = _later(member, group, ranks(row, said, start))
    if len(again):
        yield _told(row[again], said[again], start[again], start[again] + size[again])
    sent = np.ones(len(row), bool)
    sent[again] = False
    one = sent & ~hot
    if one.any():
        a, lo, n, hi = at[one], low[one], size[one], (low + size)[one]
        key = data[_stretches(a, np.full(len(a), GRAM))]
        places = _stretches(np.stack([lo, a + GRAM], 1).ravel(), np.stack([a - lo, hi - a - GRAM], 1).ravel())
        yield _batch(_binary(key, np.full(len(a), GRAM)), _binary(data[places], n - GRAM), row[one], said[one], start[one], a - lo, n - depth + 1)
    many = sent & hot
    if many.any():
        count = (high - low + 1)[many]
        owner = np.repeat(np.flatnonzero(many), count)
        place = _stretches(low[many], count)
        yield from _single(data, place, row[owner], said[owner], start[owner] + place - low[owner], depth)


def _single(data: np.ndarray, place, doc, said, low, depth: int):
    """Windows as rows, but for those that equal an earlier one among them, which are settled."""
    words = [lambda m, k=k: word_at(data, place[m] + k) for k in [*range(0, depth - 7, 8), depth - 8]]
    member, group = refine(np.zeros(len(place), np.int64), words)
    again, _ = _later(member, group, ranks(doc, said, low))
    if len(again):
        yield _told(doc[again], said[again], low[again], low[again] + depth)
    sent = np.ones(len(place), bool)
    sent[again] = False
    for a in range(0, len(place), GROUP):
        part = np.flatnonzero(sent[a : a + GROUP]) + a
        if len(part):
            yield _as_windows(data, place[part], doc[part], said[part], low[part], depth)


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Values of ``width`` bytes each as rows of bytes."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, width)


def _groups(batches, most: int):
    """Rows of a stream sorted by key: (table, whether its last group is cut short and goes on)."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= 2 * most:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key")
            last = rows - 1
            while last and key[last - 1].equals(key[rows - 1]):
                last -= 1 if rows - last < most else last
            if rows - last < most:
                yield table.slice(0, last), False
                rest = table.slice(last).combine_chunks()
            else:
                yield table, True
                rest = table.slice(0, 0)
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), False


def _settle(depth: int, most: int):
    """Rows sorted by their first digit: repeats, and windows of groups that are too large for one task."""

    def run(batches):
        large = None  # the key of a group of runs that goes on as single windows
        best = None  # the first occurrence of the window whose group may go on
        for table, cut in _groups(batches, most):
            key = table.column("key").combine_chunks()
            size = np.diff(np.frombuffer(key.buffers()[1], np.int32)[key.offset : key.offset + len(key) + 1])
            told = table.column("ahead").to_numpy() == TOLD
            if told.any():
                part = table.filter(pa.array(told))
                start = part.column("low").to_numpy()
                yield _told(part.column("doc").to_numpy(), part.column("said").to_numpy(), start, start + part.column("windows").to_numpy())
            runs, single = table.filter(pa.array(~told & (size == GRAM))), table.filter(pa.array(~told & (size == depth)))
            if runs.num_rows:
                large = yield from _runs(runs, large, cut, depth, most)
            if single.num_rows:
                best = yield from _windows(single, best, depth)

    return run


def _runs(table: pa.Table, large: bytes | None, cut: bool, depth: int, most: int):
    table = table.combine_chunks()
    keys = _fixed(table.column("key").combine_chunks(), GRAM)
    doc, said, low, ahead, count = (table.column(c).to_numpy().astype(np.int64) for c in NAMES[2:])
    rest = table.column("rest").combine_chunks()
    ends = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(rest.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.zeros(8, np.uint8)])
    begin, size = ends[:-1] - ends[0], np.diff(ends)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    group = np.cumsum(new)
    # Equal runs: the windows of all but the first are repeats.
    words = [lambda m, k=k: word_at(data, np.minimum(begin[m] + 8 * k, len(data) - 8), size[m] - 8 * k) for k in range((int(size.max()) + 7) // 8)]
    member, equal = refine(group, [lambda m: ahead[m] << 16 | count[m], *words])
    again, _ = _later(member, equal, ranks(doc, said, low))
    again_at = [doc[again], said[again], low[again], low[again] + count[again] + depth - 1]
    alive = np.ones(len(keys), bool)
    alive[again] = False
    # Groups with another run left: their windows, by what is not in the key, which has the same place in all.
    left = np.bincount(group[alive], minlength=group[-1] + 1)
    opened = np.zeros(len(keys), bool)
    if large is not None and keys[0].tobytes() == large:
        opened |= group == group[0]
    if cut:
        opened |= group == group[-1]
    opened |= left[group] > most
    run = np.flatnonzero(alive & ~opened & (left[group] > 1))
    for part in _parts(run, count, group):
        owner = np.repeat(part, count[part])
        nth = _stretches(np.zeros(len(part), np.int64), count[part])
        place, wide = begin[owner] + nth, depth - GRAM
        words = [lambda m, k=k: word_at(data, place[m] + k) for k in [*range(0, wide - 7, 8), wide - 8]]
        member, equal = refine(group[owner], [lambda m: ahead[owner[m]] - nth[m], *words])
        later, _ = _later(member, equal, ranks(doc[owner], said[owner], low[owner] + nth))
        again_at = [np.append(a, b) for a, b in zip(again_at, (doc[owner[later]], said[owner[later]], (low[owner] + nth)[later], (low[owner] + nth)[later] + depth), strict=True)]
    if len(again_at[0]):
        yield _told(*again_at)
    for part in _parts(np.flatnonzero(alive & opened), count, None):
        owner = np.repeat(part, count[part])
        nth = _stretches(np.zeros(len(part), np.int64), count[part])
        # The window's bytes with the key put back in its place.
        cells = np.empty((len(owner), depth), np.uint8)
        before = ahead[owner] - nth
        for o in np.unique(before):
            of = np.flatnonzero(before == o)
            flat = data[(begin[owner[of]] + nth[of])[:, None] + np.arange(depth - GRAM)]
            cells[of[:, None], np.arange(o)] = flat[:, :o]
            cells[of[:, None], np.arange(o, o + GRAM)] = keys[owner[of]]
            cells[of[:, None], np.arange(o + GRAM, depth)] = flat[:, o:]
        whole = np.append(cells.ravel(), np.zeros(8, np.uint8))
        yield from _single(whole, np.arange(len(owner)) * depth, doc[owner], said[owner], low[owner] + nth, depth)
    return keys[-1].tobytes() if opened[-1] else None


def _parts(run: np.ndarray, count: np.ndarray, group: np.ndarray | None, most: int = 1 << 19):
    """Runs in pieces of about ``most`` windows; with ``group`` no group is parted."""
    if not len(run):
        return
    piece = np.cumsum(count[run]) // most
    if group is not None:
        new = np.ones(len(run), bool)
        new[1:] = group[run][1:] != group[run][:-1]
        piece = piece[np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))]
    yield from np.split(run, np.flatnonzero(np.diff(piece)) + 1)


def _windows(table: pa.Table, best: tuple | None, depth: int):
    """Of equal windows all but the first are repeats; the first of the last group is kept for what may follow."""
    table = table.combine_chunks()
    keys = _fixed(table.column("key").combine_chunks(), depth)
    doc, said, low = (table.column(c).to_numpy() for c in ("doc", "said", "low"))
    if best is not None:
        keys = np.concatenate([np.frombuffer(best[0], np.uint8)[None], keys])
        doc, said, low = (np.append(np.int64(b), x) for b, x in zip(best[1:], (doc, said, low), strict=True))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    group = np.cumsum(new)
    again, first = _later(np.arange(len(keys)), group, ranks(doc, said, low))
    if len(again):
        yield _told(doc[again], said[again], low[again], low[again] + depth)
    at = first[-1]
    return (keys[at].tobytes(), doc[at], said[at], low[at])


def _strip(read, names: list[str]):
    """Removed ranges merged, and what is left of each text."""

    def run(batches):
        for file, (row, start, end) in by_key(batches, "file", ["row", "start", "end"]):
            row = row.filter(start.is_valid()).to_numpy()
            start, end = start.drop_null().to_numpy(), end.drop_null().to_numpy()
            nothing = np.zeros(len(row), np.int64)
            row, _, start, end = merged(row, nothing, start, end)
            for first, part in read(file, ["key", "text"]):
                texts = Texts(part.column("text"))
                edge = np.searchsorted(row, np.arange(first, first + texts.rows + 1))
                out = [[], [], [], [], []]
                data, bounds = memoryview(texts.data), texts.bounds.tolist()
                for k in range(texts.rows):
                    text, told, at, removed = data[bounds[k] : bounds[k + 1]], hashlib.sha256(), 0, []
                    for a, b in zip(start[edge[k] : edge[k + 1]].tolist(), end[edge[k] : edge[k + 1]].tolist(), strict=True):
                        told.update(text[at:a])
                        removed.append([a, b])
                        at = b
                    told.update(text[at:])
                    for column, value in zip(out, (len(text), sum(b - a for a, b in removed), len(removed), told.hexdigest(), removed), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks(), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=names)

    return run


def _frequent(docs: DataFrame, depth: int) -> np.ndarray:
    """Grams that a sample shows to be frequent. They are only dealt out in another way; results don't depend on it."""

    def sampled(batches):
        for batch in batches:
            for piece in pieces(Texts(batch.column(0)), STEP, depth - 1):
                yield pa.RecordBatch.from_arrays([pa.array(Anchors(piece, depth).gram)], names=["gram"])

    sample = docs.where(F.pmod(F.xxhash64("doc", "said"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(sampled, "gram long").groupBy("gram").count()
    sample = materialise(sample.where(F.col("count") > 1), "sampled")
    least = max(LEAST, SHARE * (sample.agg(F.sum("count")).first()[0] or 0))
    return np.array([r[0] for r in sample.where(F.col("count") >= least).select("gram").collect()], np.int64)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, group: int = GROUP, step: int = STEP) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte ranges
    [start, end)): every byte is removed that a string of ``depth`` bytes covers which also starts earlier, in a
    document with a smaller key or earlier in the same one. Overlaps count; matches never cross documents.

    Keys are 64-bit integers. A null text is empty; texts shorter than ``depth`` bytes keep everything. Very long
    texts are scanned in overlapping pieces of ``step`` bytes, and more than ``group`` runs of one gram are dealt out
    again as windows; neither changes a result. Rows without a key count as earlier than all others, in an order given by
    a 64-bit hash of the text. Rows that repeat key and text are one document and give equal results; different texts
    under one key are ordered by that hash. An empty table gives an empty result; other columns are not looked at.
    """
    if not GRAM + 8 <= depth <= 1 << 12:
        raise ValueError(f"depth must be in {GRAM + 8}..{1 << 12}")
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    hashed = F.xxhash64(said)
    source = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), hashed.bitwiseOR(F.lit(-(1 << 63)))).alias("doc"), hashed.alias("said"), said.alias("text"), F.col(f"`{key}`").alias("key"))
    blocks = Blocks(source, "texts")
    spark, read = docs.sparkSession, blocks.reader()
    frequent = spark.sparkContext.broadcast(_frequent(blocks.frame, depth))

    rows = blocks.frame.select("doc", "said", "file", "row")
    grams = blocks.frame.select("text", "file").mapInArrow(_grams(frequent, depth, step), "gram long, file int, many boolean")
    shared = grams.repartition("gram").sortWithinPartitions("gram").mapInArrow(_shared, "file int, gram long")
    # Every file is opened, as it may hold a frequent gram.
    shared = shared.union(rows.select("file", F.lit(None).cast("long").alias("gram")).distinct())
    runs = shared.repartition(blocks.tasks, "file").sortWithinPartitions("file").mapInArrow(_open(read, frequent, depth, step), ROW)
    settled = materialise(runs.repartition("key").sortWithinPartitions("key").mapInArrow(_settle(depth, group), ROW), "ranges")
    is_told, span = F.col("ahead") == TOLD, [F.col("doc"), F.col("said"), F.col("low").alias("start"), (F.col("low") + F.col("windows")).alias("end")]
    told = settled.where(is_told).select(*span)
    if not settled.where(~is_told).isEmpty():
        more = settled.where(~is_told).repartition("key").sortWithinPartitions("key").mapInArrow(_settle(depth, group), ROW)
        told = told.union(more.select(*span))

    placed = rows.join(told, ["doc", "said"], "left").select("file", "row", "start", "end").repartition(blocks.tasks, "file").sortWithinPartitions("file")
    kind = docs.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    return placed.mapInArrow(_strip(read, names), f"`{key}` {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<bigint>>")
