import math
import random

import pytest

from framewise.operators import detect, frames, spans


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_merge_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(f"v{v}", a := rng.randint(0, 60), a + rng.randint(0, 6)) for v in range(50) for _ in range(rng.randint(0, 12))]
    got = sorted((r.video_id, r.start, r.end) for r in spans.merge_spans(table(spark, rows, "video_id string, start long, end long"), ["video_id"]).collect())
    want = []
    for v, a, b in sorted(rows):
        if want and want[-1][0] == v and a <= want[-1][2] + 1:
            want[-1][2] = max(want[-1][2], b)
        else:
            want.append([v, a, b])
    assert got == sorted(map(tuple, want))


@pytest.mark.parametrize("block", [7, 1 << 16])
@pytest.mark.parametrize("gap", [1, 5])
def test_islands_hold_across_blocks(spark, block, gap):
    rng = random.Random(block + gap)
    hot = sorted(rng.sample(range(200), 90))
    got = [(r.start, r.end, r.n_rows) for r in spans.islands(table(spark, [("v", f) for f in hot], "video_id string, frame long"), ["video_id"], gap=gap, block=block).orderBy("start").collect()]
    want = []
    for f in hot:
        if want and f - want[-1][1] <= gap:
            want[-1][1:] = [f, want[-1][2] + 1]
        else:
            want.append([f, f, 1])
    assert got == [tuple(w) for w in want]


def loop_hysteresis(turns, close, lo, hi, merge, gap, least):
    flagged, k = [], 0
    while k < len(turns):
        end = k
        while end < len(turns) and close[end] and turns[end] >= lo:
            end += 1
        if end > k and any(turns[j] >= hi for j in range(k, end)):
            flagged += range(k, end)
        k = max(end, k + 1)
    pieces = []
    for f in flagged:
        if pieces and f - pieces[-1][1] <= gap:
            pieces[-1][1] = f
        else:
            pieces.append([f, f])
    out = []
    for a, b in (p for p in pieces if p[1] - p[0] >= least):
        if out and a - out[-1][1] <= merge:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(p) for p in out]


def test_hysteresis_against_a_loop(spark):
    rng = random.Random(9)
    for _ in range(3):
        n = 300
        turns, close, now = [], [], 0.0
        for _ in range(n):
            now = min(1.0, max(0.0, now + rng.uniform(-0.2, 0.2)))
            turns.append(now)
            close.append(rng.random() > 0.05)
        df = table(spark, [("v", k, t, c) for k, (t, c) in enumerate(zip(turns, close, strict=True))], "video_id string, frame long, turns double, mostly_close boolean")
        got = spans.hysteresis(df, ["video_id"], min_turns=0.75, keep_turns=0.4, merge_frames=12, gap_frames=4, min_frames=5).orderBy("start").collect()
        assert [(r.start, r.end) for r in got] == loop_hysteresis(turns, close, 0.4, 0.75, 12, 4, 5)


def ones(spark, hot, n):
    return frames.zero_filled(frames.spine(table(spark, [("v", n)], "video_id string, num_frames long")), table(spark, [("v", f, 1.0) for f in hot], "video_id string, frame long, score double"), ["video_id", "frame"])


@pytest.mark.parametrize(("gap", "count"), [(15, 1), (16, 2), (30, 2)])
def test_majority_vote_spans(spark, gap, count):
    df = ones(spark, [*range(60, 120), *range(120 + gap, 180 + gap)], 300)
    assert spans.scores_to_spans(df, ["video_id"]).count() == count


@pytest.mark.parametrize(("hot", "n", "count"), [(range(300), 300, 0), (range(301), 301, 1), (range(301), 400, 1), (range(270), 600, 0), ([*range(271), *range(271 + 30, 301 + 30)], 400, 1)])
def test_greedy_window_is_strictly_longer(spark, hot, n, count):
    assert spans.greedy_spans(ones(spark, hot, n), "video_id", seconds=10.0).count() == count


def test_greedy_growth_against_a_loop(spark, monkeypatch):
    """Every window is looked at in turn, with its positive frames counted anew."""
    import random

    monkeypatch.setattr(spans, "BLOCK", 64)
    rng = random.Random(11)
    hot = {}
    for k in range(12):
        hot[f"v{k}"] = []
        while len(hot[f"v{k}"]) < 400:
            hot[f"v{k}"] += [int(rng.random() < rng.choice([0.2, 0.75, 0.95]))] * 1 + [int(rng.random() < 0.8) for _ in range(rng.randint(0, 30))] + [0] * rng.choice([0, 0, 1, 15])
    size, share = 11, 0.7
    want = set()
    for video, frames in hot.items():
        found: list[list[int]] = []
        for a in range(len(frames) - size + 1):
            b = a + size - 1
            if sum(frames[a : b + 1]) < share * size:
                continue
            near = bool(found) and a <= found[-1][1] + 1
            if near and sum(frames[found[-1][0] : b + 1]) >= share * (b - found[-1][0] + 1):
                found[-1][1] = b
            elif not near or a > found[-1][1]:
                found.append([a, b])
        want |= {(video, k, a, b, sum(frames[a : b + 1])) for k, (a, b) in enumerate(found, 1)}
    rows = table(spark, [(v, f, 0.9 * x) for v, frames in hot.items() for f, x in enumerate(frames)], "video_id string, frame long, score double")
    got = spans.greedy_spans(rows, "video_id", fraction=share, seconds=10 / 30).collect()
    assert len(want) > 40 and {(r.video_id, r.span, r.start, r.end, r.positive_frames) for r in got} == want


@pytest.mark.parametrize("bad", [float("inf"), float("-inf"), float("nan"), None])
def test_scores_that_are_not_finite(spark, bad):
    df = table(spark, [("v", f, bad) for f in range(200)], "video_id string, frame long, score double")
    assert spans.scores_to_spans(df, ["video_id"], vote=False).count() == 0
    with pytest.raises(Exception, match="finite"):
        spans.greedy_spans(df, "video_id").collect()


def test_greedy_wants_consecutive_frames(spark, monkeypatch):
    rows = lambda frames: table(spark, [("v", f, 1.0) for f in frames], "video_id string, frame long, score double")
    for block in (spans.BLOCK, 100):
        monkeypatch.setattr(spans, "BLOCK", block)
        assert spans.greedy_spans(rows(range(50, 350)), "video_id").count() == 1
        for frames_ in ([*range(100), *range(101, 300)], [*range(99), *range(100, 300)], [*range(200), 10]):
            with pytest.raises(Exception, match="consecutive"):
                spans.greedy_spans(rows(frames_), "video_id").collect()
    with pytest.raises(ValueError):
        spans.greedy_spans(rows(range(9)), "video_id", fraction=0.0)


@pytest.mark.parametrize("near", [1 << 12, 7, 1])
@pytest.mark.parametrize("tolerance", [0, 5])
def test_overlaps_match_brute_force(spark, monkeypatch, near, tolerance):
    import random

    monkeypatch.setattr(spans, "NEAR", near)
    rng = random.Random(near)
    side = lambda: [(rng.choice("vw"), s, s + rng.randint(0, 25)) for s in rng.sample(range(120), 25)]
    a, b = side(), side()
    left, right = table(spark, a, "video_id string, start long, end long"), table(spark, b, "video_id string, b_start long, b_end long")
    met = sorted((*x, *y[1:]) for x in a for y in b if x[0] == y[0] and y[1] <= x[2] + tolerance and y[2] >= x[1] - tolerance)
    assert sorted(tuple(r) for r in spans.overlapping(left, right, "video_id", tolerance).select("video_id", "start", "end", "b_start", "b_end").collect()) == met
    alone = [(*x, None, None) for x in a if not any(m[:3] == x for m in met)]
    got = [tuple(r) for r in spans.overlapping(left, right, "video_id", tolerance, "left").select("video_id", "start", "end", "b_start", "b_end").collect()]
    assert sorted(got, key=str) == sorted(met + alone, key=str)


def test_greedy_extends_one_span(spark):
    row = spans.greedy_spans(ones(spark, range(100, 1000), 1200), "video_id", fraction=1.0, seconds=10.0).collect()
    assert [(r.start, r.end, r.positive_frames) for r in row] == [(100, 999, 900)]


def test_rotation_labels(spark):
    rate = [2 * math.pi] * 90 + [-2 * math.pi] * 60 + [0.0] * 30
    series = table(spark, [("v", k, r, 100.0) for k, r in enumerate(rate)], "video_id string, frame long, rate double, dist double")
    asked = table(spark, [("v", 1, 0, 89), ("v", 2, 90, 149), ("v", 3, 500, 600)], "video_id string, row_id long, start long, end long")
    got = {r.row_id: (r.direction, r.cycles) for r in spans.rotation_labels(asked, spans.rotation_steps(series, ["video_id"], window=2), "video_id").collect()}
    assert got[1][0] == "CW" and got[1][1] == pytest.approx(3, abs=0.1)
    assert got[2][0] == "CCW" and got[2][1] == pytest.approx(2, abs=0.1)
    assert got[3] == (None, 0.0)


def test_closest_pair_series(spark):
    from framewise.operators import framefeat

    pairs = table(spark, [("v", 0, 1, 2, 7, 80.0, 2.0), ("v", 0, 1, 3, 7, 90.0, 1.0), ("v", 2, 2, 1, 7, 90.0, 20.0), ("v", 3, 1, 2, 7, 95.0, -15.0)], "video_id string, frame long, t1 long, t2 long, pair_episode_id long, dist double, rate double")
    rows = framefeat.closest_series(pairs, table(spark, [("v", 5)], "video_id string, num_frames long")).orderBy("frame").collect()
    assert [r.dist for r in rows] == [80.0, None, 90.0, 95.0, None]
    assert [r.rate for r in rows] == [2.0, 0.0, 0.0, -15.0, 0.0]
    assert [r.dist_rate for r in rows] == [None, None, None, 150.0, None]
    assert [r.rate_rate for r in rows] == [None] * 5


def test_status_policies(spark):
    at = table(spark, [("v", f) for f in range(4)], "video_id string, frame long")
    held = table(spark, [("v", 0, 1, "circling"), ("v", 1, 2, "unknown"), ("v", 2, 2, "non-circling"), ("v", 0, 0, "circling")], "video_id string, start long, end long, status string")
    told = lambda **k: [r.status for r in spans.status_at(at, held, ["video_id"], **k).orderBy("frame").collect()]
    assert told() == ["circling", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert told(unknown_blocks=False) == ["circling", "circling", "non-circling", "UNKNOWN"]


def test_six_conditions(spark):
    base = {"qc_n_missing_kp_1": 0, "qc_n_missing_kp_2": 2, "pair_sex": "FM", "centroid_distance_bl": 0.75, "cos_rel_heading": -0.5, "d_orbital_rad_s": 0.25, "is_corotating": True}
    rows = [base, base | {"d_orbital_rad_s": -2.0}, base | {"qc_n_missing_kp_1": 3}, base | {"centroid_distance_bl": None, "d_orbital_rad_s": 1.0}]
    df = table(spark, [tuple(r.values()) for r in rows], "qc_n_missing_kp_1 int, qc_n_missing_kp_2 int, pair_sex string, centroid_distance_bl double, cos_rel_heading double, d_orbital_rad_s double, is_corotating boolean")
    got = detect.six_conditions(df).collect()
    assert [r.fail_reason for r in got] == ["fast", "hit", "qc", "close"]
    assert got[1].rule_score == pytest.approx(0.5 * 0.5) and got[3].rule_score == 0


def test_shifted_hits(spark):
    labels, found = (table(spark, [("v", a, b)], "video_id string, start long, end long") for a, b in ((500, 520), (0, 10)))
    shifts = table(spark, [("v", 1000, 0), ("v", 1000, 505)], "video_id string, num_frames long, shift long")
    assert {r["shift"]: r.hits for r in spans.shifted_hits(labels, found, shifts, "video_id").collect()} == {0: 0, 505: 1}


@pytest.mark.parametrize(("near", "wrapped"), [(1 << 12, True), (7, True), (7, False)])
def test_shifted_hits_of_spans_around_the_end(spark, monkeypatch, near, wrapped):
    """Labels and spans over much of a video: a span shifted around its end starts after it ends."""
    monkeypatch.setattr(spans, "NEAR", near)
    labels, found = [("v", 0, 99), ("v", 12, 70), ("w", 35, 60)], [("v", 0, 97), ("v", 40, 65), ("w", 2, 96)]
    shifts = [(v, 100, s) for v in "vw" for s in range(100)]
    hit = lambda x, a, b: a <= x[2] + 30 and b >= x[1] - 30 and (wrapped or a <= b)
    want = {(v, s): sum(any(v == x[0] == y[0] and hit(x, (y[1] + s) % n, (y[2] + s) % n) for y in found) for x in labels) for v, n, s in shifts}
    make = lambda rows, names: table(spark, rows, "video_id string, " + names)
    got = spans.shifted_hits(*(make(x, "start long, end long") for x in (labels, found)), make(shifts, "num_frames long, shift long"), "video_id", **{} if wrapped else {"wrapped": False}).collect()
    assert len(got) == len(shifts) and {(r.video_id, r["shift"]): r.hits for r in got} == want


@pytest.mark.parametrize("near", [1 << 12, 7, 1])
def test_overlaps_of_reversed_intervals(spark, monkeypatch, near):
    monkeypatch.setattr(spans, "NEAR", near)
    a, b = ([("v", s, e) for s in range(0, 25, step) for e in range(0, 25, step)] for step in (6, 4))
    left, right = table(spark, a, "video_id string, start long, end long"), table(spark, b, "video_id string, b_start long, b_end long")
    met = sorted((*x, *y[1:]) for x in a for y in b if y[1] <= x[2] + 2 and y[2] >= x[1] - 2)
    assert any(x[3] > x[4] for x in met) and any(x[1] > x[2] for x in met)
    assert sorted(tuple(r) for r in spans.overlapping(left, right, "video_id", 2).select("video_id", "start", "end", "b_start", "b_end").collect()) == met


def test_buffer_sample(spark):
    got = spans.buffer_sample(table(spark, [("v", 2, 5)], "video_id string, start long, end long"), table(spark, [("v", 8)], "video_id string, num_frames long"))
    assert sorted((r.frame, r.label) for r in got.collect()) == [(f, int(2 <= f <= 5)) for f in range(8)]
