"""Plans of the given conversations against literal searches in Python, one conversation at a time."""

from collections import defaultdict

import pytest

from parlance.plans import registry
from parlance.settings import CLOCK, DEFAULT
from parlance.sources import driver_tables as D

SF = "/root/testdata/sf0.001"


def _union(spans):
    out = []
    for a, b in sorted(x for x in spans if x[1] > x[0]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _length(spans):
    return sum(b - a for a, b in _union(spans))


def _cut(spans, lo, hi):
    return [(max(a, lo), min(b, hi)) for a, b in spans if a < hi and lo < b]


def _by_source(df, *cols):
    out = defaultdict(list)
    for r in df.collect():
        out[r.source_id].append(tuple(r[c] for c in cols))
    return out


@pytest.fixture(scope="module")
def talks(spark):
    ends = ("start_sample", "end_sample")
    acts = _by_source(D.activities(spark, SF), "speaker", *ends, "turn")
    exc, words = _by_source(D.exclusions(spark, SF), *ends), _by_source(D.turn_words(spark, SF), *ends)
    cand = _by_source(registry.QUERIES["G5_boundary_candidates"](spark, SF), "pos", "quality")  # has SQL of its own
    bounds = {r.source_id: (r.lo, r.hi) for r in registry.QUERIES["G2_conversation_bounds"](spark, SF).collect()}
    return {r.source_id: (acts[r.source_id], exc[r.source_id], words[r.source_id], cand[r.source_id], bounds[r.source_id], r.duration) for r in D.durations(spark, SF).collect()}


def _of(acts, speaker):
    return [(a, b) for p, a, b, _ in acts if p == speaker]


def _overlaps(acts):
    a, b = _union(_of(acts, "A")), _union(_of(acts, "B"))
    return [(max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]


def _clip_reasons(acts, lo, hi):
    own = [_length(_cut(_of(acts, p), lo, hi)) for p in "AB"]
    speech = _length(_cut([(a, b) for _, a, b, _ in acts], lo, hi))
    order = [p for _, _, p in sorted((max(a, lo), min(b, hi), p) for p, a, b, _ in acts if a < hi and lo < b)]
    rules = [
        ("clip_above_100_seconds", hi - lo > DEFAULT.plan_max), ("clip_below_20_seconds", hi - lo < DEFAULT.plan_min), ("excessive_silence", max(0.0, 1 - speech / (hi - lo)) > DEFAULT.max_silence),
        ("insufficient_speaker_A", own[0] < CLOCK), ("insufficient_speaker_B", own[1] < CLOCK), ("insufficient_speaker_share", sum(own) > 0 and min(own) / max(1, sum(own)) < DEFAULT.min_speaker_share),
        ("missing_speaker_exchange", sum(x != y for x, y in zip(order, order[1:])) < 1),
    ]
    return sorted(n for n, bad in rules if bad)


def _edges(talk):
    acts, _, _, cand, (lo, hi), _ = talk
    quality = {p: q for p, q in [*cand, (lo, 0), (hi, 0)]} | {lo: 0, hi: 0}
    points = sorted(quality)
    return {a: [(b, quality[b]) for b in points if DEFAULT.plan_min <= b - a <= DEFAULT.plan_max and not _clip_reasons(acts, a, b)] for a in points}


def _counts(talk, edges):
    lo, hi = talk[4]
    state, found = {lo}, set()
    for k in range(1, (hi - lo) // DEFAULT.plan_min + 1):
        state = {b for a in state for b, _ in edges.get(a, [])}
        if hi in state:
            found.add(k)
    return found


def test_feasible_counts(spark, talks):
    got = defaultdict(set)
    for r in registry.QUERIES["G8_feasible_counts"](spark, SF).collect():
        got[r.source_id].add(r.k)
    want = {s: _counts(t, _edges(t)) for s, t in talks.items()}
    assert dict(got) == {s: k for s, k in want.items() if k} and any(want.values())


def _cheapest(talk, edges, k):
    """(cost, cuts) of the plan that the search finds first among the cheapest."""
    lo, hi = talk[4]
    state = {lo: ((0, 0), [lo])}
    for layer in range(1, k + 1):
        ideal, nxt = lo + round((hi - lo) * layer / k), {}
        for a, ((q, d), way) in state.items():
            for b, bq in edges.get(a, []):
                if (b == hi) == (layer == k):
                    cost = (q + (0 if b == hi else bq), d + abs(b - ideal))
                    if b not in nxt or cost < nxt[b][0]:
                        nxt[b] = cost, [*way, b]
        state = nxt
    return state[hi]


def _count_plan(talk, edges, asked):
    """(k, message, cuts) for a number of clips."""
    lo, hi = talk[4]
    counts = _counts(talk, edges)
    cover = asked * DEFAULT.plan_min <= hi - lo <= asked * DEFAULT.plan_max
    if not counts:
        nearest = max(1, round((hi - lo) / (60 * CLOCK)))
        said = "The exact clip count has no safe pause combination that gives every clip both speakers and a completed exchange."
        return None, said if cover else f"{asked} clips cannot cover this conversation within 20–100 seconds; try approximately {nearest} clips.", [lo, hi]
    k = min(counts, key=lambda c: (abs(c - asked), abs((hi - lo) / c - 60 * CLOCK), c))
    said = f"{asked} clips are not feasible under the 20–100 second conversation constraints. Proposed the closest valid {k}-clip plan."
    return k, "" if k == asked else said, _cheapest(talk, edges, k)[1]


def test_count_plans(spark, talks):
    got = {r.source_id: (r.k, r.message, r.cuts) for r in registry.QUERIES["G8_count_plans"](spark, SF).collect()}
    want = {}
    for s, talk in talks.items():
        k, message, cuts = _count_plan(talk, _edges(talk), s % 6 + 1)
        want[s] = k, message, ",".join(map(str, cuts))
    assert got == want and len({bool(w[1]) for w in want.values()}) == 2


def test_plan_search_on_random_edges(spark):
    import random

    from parlance.operators import planning as G

    rng, edges, bounds, asks = random.Random(2), [], [], []
    for s in range(40):
        points = sorted(rng.sample(range(1, 60), rng.randint(0, 14)))
        lo, hi = 0, 60 * CLOCK * 2
        points = [lo, *(p * CLOCK * 2 for p in points), hi]
        edges += [(s, a, b, 0 if b == hi else rng.randint(0, 2)) for a in points for b in points if DEFAULT.plan_min <= b - a <= DEFAULT.plan_max and rng.random() < 0.8]
        bounds.append((s, lo, hi))
        asks += [(s, 0, "count", rng.randint(1, 9)), (s, 1, "target", rng.choice([1, 20, 35, 10**4]) * CLOCK), (s, 2, "count", None)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = G.plan_search(frame(edges, "source_id long, a long, b long, q int"), frame(bounds, "source_id long, lo long, hi long"), frame(asks, "source_id long, request int, mode string, asked long")).collect()
    assert len(out) == 80
    for r in out:
        talk = (None, None, None, None, (0, 60 * CLOCK * 2), None)
        mine = {}
        for s, a, b, q in sorted(edges):
            if s == r.source_id:
                mine.setdefault(a, []).append((b, q))
        counts = _counts(talk, mine)
        assert set(r.counts) == counts and r.feasible == bool(counts)
        if r.mode == "count":
            assert (r.k, r.message, r.cuts) == _count_plan(talk, mine, r.asked)
        elif counts:
            aim = min(DEFAULT.plan_max, max(DEFAULT.plan_min, next(x[3] for x in asks if x[0] == r.source_id and x[2] == "target")))
            k = min(counts, key=lambda c: (abs(60 * CLOCK * 2 / c - aim), c))
            assert (r.k, r.cuts) == (k, _cheapest(talk, mine, k)[1])
    assert {r.feasible for r in out} == {True, False}


def test_plan_verdicts(spark, talks):
    got = {r.source_id: r for r in registry.QUERIES["G10_plan_verdicts"](spark, SF).collect()}
    seen = set()
    for s, talk in talks.items():
        acts, exc, words, _, (lo, hi), duration = talk
        if s % 3 == 2:
            cuts = sorted({b for _, _, b, turn in acts if turn % 2 == 0})
            if not cuts:
                assert s not in got
                continue
            fine = len(cuts) > 1 and cuts[0] >= 0 and cuts[-1] <= duration
            message = "" if fine else "Manual mode requires at least two distinct boundaries." if len(cuts) < 2 else "Manual boundaries must stay within the source."
        elif s % 3 == 0:
            k, message, cuts = _count_plan(talk, _edges(talk), s % 4 + 1)
            fine = k is not None
        else:
            edges = _edges(talk)
            counts = _counts(talk, edges)
            fine = bool(counts)
            cuts = _cheapest(talk, edges, min(counts, key=lambda c: (abs((hi - lo) / c - 40 * CLOCK), c)))[1] if counts else [lo, hi]
            message = "" if fine else "No safe pause combination can satisfy the target duration while keeping both speakers and a completed exchange in every clip."
        guarded = [(a - DEFAULT.word_guard, b + DEFAULT.word_guard) for a, b in _union(_cut(words, 0, duration))] or [(a, b) for _, a, b, _ in acts]
        unsafe = [*exc, *_overlaps(acts), *guarded]
        bad = any(_clip_reasons(acts, a, b) for a, b in zip(cuts, cuts[1:])) or len(cuts) > 1 and any(a < p < b for p in cuts for a, b in unsafe)
        message = message or ("One or more proposed clips violate export constraints." if bad else "")
        assert (got[s].feasible, got[s].message, got[s].cuts) == (fine and not bad, message, ",".join(map(str, cuts)))
        seen.add((s % 3, fine and not bad))
    assert len(seen) > 2


def test_target_plans_are_the_cheapest(spark, talks):
    clips = defaultdict(list)
    for r in registry.QUERIES["G9_target_plan"](spark, SF).collect():
        clips[r.source_id].append((r.clip_no, r.start_sample, r.end_sample, r.status, r.reasons))
    planned = 0
    for s, talk in talks.items():
        edges, (lo, hi) = _edges(talk), talk[4]
        counts = _counts(talk, edges)
        if not counts:
            assert s not in clips
            continue
        k = min(counts, key=lambda c: (abs((hi - lo) / c - 60 * CLOCK), c))
        rows = sorted(clips[s])
        assert len(rows) == k and all(not x or x.endswith("_boundary_cuts_active_audio") for r in rows for x in r[4].split(","))  # the bounds may cut
        cuts = [rows[0][1], *(r[2] for r in rows)]
        assert cuts[0] == lo and cuts[-1] == hi and [r[1] for r in rows] == cuts[:-1]
        quality = {a: dict(b) for a, b in edges.items()}
        cost = (sum(quality[a][b] for a, b in zip(cuts, cuts[1:-1])), sum(abs(b - (lo + round((hi - lo) * i / k))) for i, b in enumerate(cuts[1:], 1)))
        assert (cost, cuts) == _cheapest(talk, edges, k)
        planned += 1
    assert planned


def test_manual_plans(spark, talks):
    got = sorted((r.source_id, r.clip_no, r.start_sample, r.end_sample, r.status, r.reasons) for r in registry.QUERIES["G11_manual_plan"](spark, SF).collect())
    want = []
    for s, (acts, exc, words, _, _, duration) in talks.items():
        cuts = sorted({b for _, _, b, turn in acts if turn % 3 == 0})
        if len(cuts) < 2 or cuts[0] < 0 or cuts[-1] > duration:
            continue
        guarded = [(a - DEFAULT.word_guard, b + DEFAULT.word_guard) for a, b in _union(_cut(words, 0, duration))] or [(a, b) for _, a, b, _ in acts]
        unsafe = [*exc, *_overlaps(acts), *guarded]
        inside = lambda p, unsafe=unsafe: any(a < p < b for a, b in unsafe)
        for no, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
            reasons = {*_clip_reasons(acts, a, b), *(["start_boundary_cuts_active_audio"] if inside(a) else []), *(["end_boundary_cuts_active_audio"] if inside(b) else [])}
            want.append((s, no, a, b, "invalid" if reasons else "valid", ",".join(sorted(reasons))))
    assert got == sorted(want) and want


def _window(acts, lo, hi):
    s, sec = DEFAULT, (hi - lo) / CLOCK
    inside = [(p, max(a, lo), min(b, hi)) for p, a, b, _ in acts if a < hi and lo < b]
    mine, other = ([(a, b) for p, a, b in inside if (p == "A") == who] for who in (True, False))
    a, u = _length(mine) / CLOCK, _length(other) / CLOCK
    small = min(a, u) / (a + u) if a + u > 0 else 0.0
    quiet, over = max(0.0, 1 - _length([x[1:] for x in inside]) / CLOCK / sec), _length(_cut(_overlaps(acts), lo, hi)) / CLOCK / sec
    names = {p for p, _, _ in inside}
    rules = [
        ("clip_below_min_duration", sec < s.min_clip_s), ("clip_above_max_duration", sec > s.max_clip_s + 1e-6), ("more_than_two_active_speakers", len(names) > 2), ("clip_missing_required_speaker", "A" not in names or len(names) < 2),
        ("insufficient_assistant_speech", a < s.min_speaker_s), ("insufficient_user_speech", u < s.min_speaker_s), ("insufficient_speaker_share", small < s.min_speaker_share), ("excessive_silence", quiet > s.max_silence), ("excessive_overlap", over > s.max_overlap),
    ]
    bad = [n for n, x in rules if x]
    warn = s.warn_overlap < over <= s.max_overlap
    return ("REJECT" if bad else "REVIEW" if warn else "PASS"), bad + ["overlap_requires_review"] * warn, over, small


def test_greedy_segments(spark, talks):
    got = sorted((r.source_id, r.clip_no, r.start_sample, r.end_sample, r.status, r.reasons) for r in registry.QUERIES["G6_greedy_segments"](spark, SF).collect())
    lo, mid, hi = (int(x * CLOCK) for x in (DEFAULT.min_clip_s, DEFAULT.target_clip_s, DEFAULT.max_clip_s))
    context, want = int(DEFAULT.context_s * CLOCK), []
    for s, (acts, _, _, _, _, duration) in talks.items():
        if not acts:
            continue
        at = first = max(0, min(a for _, a, _, _ in acts) - context)
        last = min(duration, max(b for _, _, b, _ in acts) + context)
        cuts = {max(first, min(duration, b + context)) for _, _, b, _ in acts}
        no = 0
        while at < last:
            def score(b, at=at, acts=acts):
                status, _, over, small = _window(acts, at, b)
                return ("PASS", "REVIEW", "REJECT").index(status), over, abs(b - at - mid), -small, b

            fits = [b for b in cuts if lo <= b - at <= hi]
            end = min(fits, key=score) if fits else min(last, at + hi)
            if last - end < lo and last - at <= hi:
                end = last
            no += 1
            status, reasons, _, _ = _window(acts, at, end)
            want.append((s, no, at, end, status, ",".join(reasons)))
            at = end
    assert got == sorted(want) and want


def test_edges_of_files(spark):
    import hashlib

    from parlance.operators.audio import file_digests

    contents = {"a": b"", "b": bytes(range(100)), "c": bytes(range(200)) * 3, "d": None}
    rows = file_digests(spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in contents.items()], "path string, content binary"), edge=100).collect()
    for r in rows:
        c = contents[r.path]
        if c is None:
            assert r.size is None and r.sha256 is None and r.edges is None
        else:
            e = c[:100] + c[-100:] if len(c) > 100 else c
            assert (r.size, r.sha256, r.edges) == (len(c), hashlib.sha256(c).hexdigest(), hashlib.sha256(e).hexdigest())


def test_stems_replace_samples_across_blocks_of_other_sizes(spark):
    import numpy as np

    from parlance.operators.audio import substitute_stems

    n = 100
    x, y = np.arange(n, dtype=np.float32), -np.arange(n, dtype=np.float32)
    cut = lambda size, l, r: [("c", k, k * size, l[k * size : (k + 1) * size].tolist(), r[k * size : (k + 1) * size].tolist()) for k in range(-(-n // size))]  # noqa: E731, E741
    schema = "clip_id string, block_no int, start_sample long, left array<float>, right array<float>"
    pcm, stems = spark.createDataFrame(cut(30, x, y), schema), spark.createDataFrame(cut(7, x + 500, y - 500), schema).drop("block_no")
    regions = spark.createDataFrame([("c", 20, 45), ("c", 40, 65), ("c", 99, 120), ("d", 0, 9), ("c", None, 3)], "clip_id string, start_sample long, end_sample long")
    got = substitute_stems(pcm, stems, regions).orderBy("start_sample").collect()
    hit = np.zeros(n, bool)
    hit[20:65] = hit[99:] = True
    assert np.concatenate([r.left for r in got]).tolist() == np.where(hit, x + 500, x).tolist()
    assert np.concatenate([r.right for r in got]).tolist() == np.where(hit, y - 500, y).tolist()


def test_split_counts_null_and_single_projects(spark):
    import hashlib

    from parlance.operators.export import split_sources

    rows = [("p" if k < 300 else None, f"s{k}") for k in range(340)] + [("q", "only")]
    got = {r.source_id: r.split for r in split_sources(spark.createDataFrame(rows, "project_id string, source_id string")).collect()}
    assert len(got) == len(rows) and got["only"] == "train"
    for project, count in (("p", 30), (None, 4)):
        ids = sorted((s for p, s in rows if p == project), key=lambda s: hashlib.sha256(s.encode()).hexdigest())
        assert [got[s] for s in ids] == ["eval"] * count + ["train"] * (len(ids) - count)


def test_clips_by_differences_are_those_that_the_rules_leave(spark):
    """Random talk with a third and a null speaker, touching, repeated and empty turns: the edges are what ``evaluate_clips`` has no reason against."""
    import random

    from pyspark.sql import functions as F

    from parlance.operators import planning as G

    rng, acts, points, bounds = random.Random(6), [], [], []
    for source in range(12):
        at, end = 0, rng.choice([90, 240, 400]) * CLOCK
        while at < end:
            long = int(rng.choice([0, 0.2, 0.7, 2, 6, 30]) * CLOCK)
            speaker = rng.choice("AB" if source % 3 == 0 else ["A", "B", "C", None] if source % 3 == 1 else ["A", None, None, "B", None])
            acts.append((source, speaker, at, at + long))
            at += long + rng.choice([0, 0, 300, CLOCK * 3, CLOCK * 40 if source % 4 == 0 else 0, -long // 2])
            at = max(at, acts[-1][2] + 1)
        points += [(source, p, rng.randint(0, 2)) for p in sorted({*rng.sample(range(0, end, 1000), 60), 0})]
        bounds.append((source, 0, end))
    acts += acts[:5] + [(3, "A", None, 9), (12, "A", 0, CLOCK)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = frame(acts, "source_id long, speaker string, start_sample long, end_sample long")
    c, b, none = frame(points, "source_id long, pos long, quality int"), frame(bounds, "source_id long, lo long, hi long"), frame([], "source_id long, start_sample long, end_sample long")
    ends = {(s, p): q for s, p, q in points} | {(s, p): 0 for s, *x in bounds for p in x}
    pairs = [(s, p, r) for s, p in ends for z, r in ends if z == s and DEFAULT.plan_min <= r - p <= DEFAULT.plan_max]
    rated = G.evaluate_clips(frame(pairs, "source_id long, start_sample long, end_sample long"), t, none).where(F.size("reasons") == 0).collect()
    want = sorted((r.source_id, r.start_sample, r.end_sample, ends[r.source_id, r.end_sample]) for r in rated)
    got = sorted(tuple(r) for r in G.clip_edges(c, b, t, none).collect())
    assert got == want and 100 < len(want) < len(pairs) and len({w[0] % 3 for w in want}) > 1
    asks = frame([(s, 0, "count", 3) for s in range(12)], "source_id long, request int, mode string, asked long")
    rows = lambda df: sorted((r.source_id, r.k, r.cuts, r.counts, r.message) for r in df.collect())
    assert rows(G.plan_candidates(c, b, t, asks)) == rows(G.plan_search(G.clip_edges(c, b, t, none), b, asks))


@pytest.mark.parametrize("name", ["G9_target_plan", "G8_feasible_counts", "G8_count_plans", "G10_plan_verdicts"])
def test_plans_write_no_pairs_of_candidates(spark, monkeypatch, name):
    from parlance.plans import interval_queries

    seen, make = [], interval_queries.keeper
    monkeypatch.setattr(interval_queries, "keeper", lambda s: lambda df, keep=make(s): seen.append(set(df.columns)) or keep(df))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen and not [x for x in seen if {"a", "b"} <= x]
