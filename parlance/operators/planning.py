"""Clip planning: safe boundaries, clip rules, exact-count, target and manual plans, greedy plans."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..settings import CLOCK, DEFAULT, Settings
from ..shipping import ship
from ..writing import keeper
from .audio import places
from .intervals import E, S, clip_to_windows, exchange_counts, merge_intervals, proper, range_join, silences, speaker_overlaps, union_length

def conversation_bounds(activities: DataFrame, durations: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(source_id, lo, hi, duration): first and last activity with context, cut to the source; the whole source without activities."""
    ends = activities.groupBy("source_id").agg(F.min(S).alias("a0"), F.max(E).alias("a1"))
    out = durations.join(ends, "source_id", "left")
    lo, hi = F.greatest(F.lit(0), F.col("a0") - s.plan_context), F.least(F.col("duration"), F.col("a1") + s.plan_context)
    return out.select("source_id", F.coalesce(lo, F.lit(0)).cast("long").alias("lo"), F.coalesce(hi, F.col("duration")).cast("long").alias("hi"), "duration")


def word_intervals(words: DataFrame, durations: DataFrame) -> DataFrame:
    """Words cut to the source and merged; bad times are left out."""
    cut = words.join(durations, "source_id").select("source_id", F.greatest(F.lit(0), S).alias(S), F.least(F.col("duration"), F.col(E)).alias(E))
    return merge_intervals(cut, ["source_id"])


def unsafe_intervals(activities: DataFrame, excluded: DataFrame, words: DataFrame, durations: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Exclusions, overlaps, and words with a guard, or the activities of sources without words."""
    aligned = word_intervals(words, durations)
    guarded = aligned.select("source_id", (F.col(S) - s.word_guard).alias(S), (F.col(E) + s.word_guard).alias(E))
    wordless = activities.join(aligned.select("source_id").distinct(), "source_id", "left_anti").select("source_id", S, E)
    parts = excluded.select("source_id", S, E).unionByName(speaker_overlaps(activities)).unionByName(guarded).unionByName(wordless)
    return merge_touching_apart(parts)


def merge_touching_apart(parts: DataFrame) -> DataFrame:
    """Unions of intervals that overlap; those that only touch stay apart, as a cut between them is safe."""
    return merge_intervals(parts, ["source_id"], gap=-1)


def is_unsafe(points: DataFrame, unsafe: DataFrame) -> DataFrame:
    """(source_id, pos): points strictly inside an unsafe interval."""
    spans = points.select("source_id", "pos", F.col("pos").alias(S), (F.col("pos") + 1).alias(E))
    met = range_join(spans, unsafe, ["source_id"])
    return met.where((F.col("r_start") < F.col("pos")) & (F.col("pos") < F.col("r_end"))).select("source_id", "pos").distinct()


def boundary_candidates(activities: DataFrame, excluded: DataFrame, words: DataFrame, utterances: DataFrame, durations: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(source_id, pos, quality): 0 bounds and midpoints of long silences, 1 word pauses and utterance ends, 2 turn ends; the best quality of a position, if it is safe."""
    bounds = conversation_bounds(activities, durations, s)
    point = lambda df, pos, q: df.select("source_id", F.expr(pos).cast("long").alias("pos"), F.lit(q).alias("quality"))
    quiet = silences(activities, durations).where(F.col(E) - F.col(S) >= s.safe_pause)
    w = Window.partitionBy("source_id").orderBy(S)
    pauses = word_intervals(words, durations).withColumn("next", F.lead(S).over(w)).where(F.col("next") - F.col(E) >= s.safe_pause)
    ends = point(activities, E, 2)
    loud = is_unsafe(ends.select("source_id", "pos"), speaker_overlaps(activities))
    ends = ends.join(loud, ["source_id", "pos"], "left_anti")
    all_ = point(bounds, "lo", 0).unionAll(point(bounds, "hi", 0)).unionAll(point(quiet, f"({S} + {E}) div 2", 0))
    all_ = all_.unionAll(point(pauses, f"({E} + next) div 2", 1)).unionAll(point(utterances, E, 1)).unionAll(ends)
    best = all_.groupBy("source_id", "pos").agg(F.min("quality").alias("quality")).join(bounds, "source_id").where("pos >= lo and pos <= hi")
    bad = is_unsafe(best.select("source_id", "pos"), unsafe_intervals(activities, excluded, words, durations, s))
    marked = best.join(bad.withColumn("bad", F.lit(True)), ["source_id", "pos"], "left")
    keep = F.col("bad").isNull() | (F.col("pos") == F.col("lo")) | (F.col("pos") == F.col("hi")) | (F.col("pos") <= 0) | (F.col("pos") >= F.col("duration"))
    return marked.where(keep).select("source_id", "pos", "quality")


def evaluate_clips(clips: DataFrame, activities: DataFrame, excluded: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Clips (source_id, start_sample, end_sample) with reasons (sorted) and figures."""
    windows = clips.select("source_id", S, E).distinct().withColumn("window", F.struct(F.col(S).alias("w0"), F.col(E).alias("w1")))
    keys = ["source_id", "window"]
    cut = clip_to_windows(activities.select("source_id", "speaker", S, E), windows, ["source_id"])
    own = union_length(cut, [*keys, "speaker"]).groupBy(*keys).pivot("speaker", ["A", "B"]).agg(F.sum("length"))
    speech = union_length(cut, keys).withColumnRenamed("length", "speech")
    turns = exchange_counts(cut, keys)
    overlap = union_length(clip_to_windows(speaker_overlaps(activities), windows, ["source_id"]), keys).withColumnRenamed("length", "overlap")
    out_of = union_length(clip_to_windows(excluded.select("source_id", S, E), windows, ["source_id"]), keys).withColumnRenamed("length", "excluded")
    wide = windows
    for part in (own, speech, turns, overlap, out_of):
        wide = wide.join(part, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    a, b, length = zero(F.col("A")), zero(F.col("B")), F.col(E) - F.col(S)
    quiet = F.when(length == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - zero(F.col("speech")) / length))
    rules = [
        ("clip_above_100_seconds", length > s.plan_max),
        ("clip_below_20_seconds", length < s.plan_min),
        ("excessive_silence", quiet > s.max_silence),
        ("insufficient_speaker_A", a < CLOCK * s.min_speaker_s),
        ("insufficient_speaker_B", b < CLOCK * s.min_speaker_s),
        ("insufficient_speaker_share", (a + b > 0) & (F.least(a, b) / F.greatest(F.lit(1), a + b) < s.min_speaker_share)),
        ("missing_speaker_exchange", zero(F.col("exchanges")) < 1),
    ]
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules])))
    share = lambda c: F.when(length == 0, F.lit(0.0)).otherwise(zero(F.col(c)) / length)
    return wide.select(
        "source_id", S, E, reasons.alias("reasons"), a.alias("a_samples"), b.alias("b_samples"), quiet.alias("silence_ratio"),
        share("overlap").alias("overlap_ratio"), share("excluded").alias("exclusion_ratio"), zero(F.col("exchanges")).alias("exchanges"),
    )


PAIRS = 1 << 20  # pairs of candidates that are rated together


class _Measure:
    """How much of a union of intervals lies before given places."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        order = np.argsort(a, kind="stable")
        a, reach = a[order], np.maximum.accumulate(b[order])
        new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]])) if len(a) else np.zeros(0, np.int64)
        self.a = a[new]
        self.size = (reach[np.append(new[1:], len(a)) - 1] if len(a) else a) - self.a
        self.before = np.concatenate([[0], np.cumsum(self.size)])

    def until(self, places: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.a, places, "right") - 1
        if not len(self.a):
            return np.zeros(len(places), np.int64)
        return np.where(k < 0, 0, self.before[k] + np.minimum(places - self.a[k], self.size[k]))


def _exchanges(a: np.ndarray, b: np.ndarray, who: list, lo: int, hi: int) -> bool:
    """Whether the speaker changes in a window, in the order of (start, end, speaker); a null speaker comes first and ends no turn."""
    inside = [(max(int(a[k]), lo), min(int(b[k]), hi), who[k] is not None, who[k] or "") for k in np.flatnonzero((a < hi) & (b > lo))]
    inside.sort()
    return any(x[2] and y[2] and x[3] != y[3] for x, y in zip(inside, inside[1:]))


def _valid_clips(pos: np.ndarray, quality: np.ndarray, spoken: pa.Table, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, q) of the clips between sorted candidates of one source that ``evaluate_clips`` has nothing against.

    Speech until each candidate is measured once, so a pair costs a few differences; the pairs are rated ``PAIRS`` at a time.
    """
    a, b, who = spoken["a"].to_numpy(), spoken["b"].to_numpy(), spoken["speaker"].to_pylist()
    name = np.array([x or "" for x in who], object)
    null = np.array([x is None for x in who], bool)
    until = {x: _Measure(a[m], b[m]).until(pos) for x in {"A", "B", *name[~null].tolist()} for m in [(name == x) & ~null]}
    speech, unknown = _Measure(a, b).until(pos), _Measure(a[null], b[null]).until(pos)
    first, last = np.searchsorted(pos, pos + s.plan_min, "left"), np.searchsorted(pos, pos + s.plan_max, "right")
    count = last - first
    filled, begin, found = np.cumsum(count), 0, [(np.zeros(0, np.int64),) * 2]
    while begin < len(pos):
        end = max(begin + 1, int(np.searchsorted(filled, (filled[begin - 1] if begin else 0) + PAIRS, "right")))
        n = count[begin:end]
        x = np.repeat(np.arange(begin, end), n)
        y = places(first[begin:end], n)
        length, size = pos[y] - pos[x], lambda m: m[y] - m[x]  # noqa: B023
        va, vb = size(until["A"]), size(until["B"])
        fits = (1.0 - size(speech) / length <= s.max_silence) & (va >= CLOCK * s.min_speaker_s) & (vb >= CLOCK * s.min_speaker_s)
        fits &= ~((va + vb > 0) & (np.minimum(va, vb) / np.maximum(1, va + vb) < s.min_speaker_share))
        fits &= sum((size(m) > 0).astype(np.int64) for m in until.values()) > 1
        for k in np.flatnonzero(fits & (size(unknown) > 0)):  # a null speaker between two others hides their exchange
            fits[k] = _exchanges(a, b, who, int(pos[x[k]]), int(pos[y[k]]))
        found.append((x[fits], y[fits]))
        begin = end
    x, y = (np.concatenate(c) for c in zip(*found))
    return pos[x], pos[y], quality[y]


def _source_rows(candidates: DataFrame, bounds: DataFrame, activities: DataFrame) -> DataFrame:
    """(source_id, a, b, q, speaker): candidates with the bounds (q is their best quality), and activities (q is null)."""
    ends = candidates.select("source_id", "pos", "quality").unionByName(bounds.select("source_id", F.explode(F.array("lo", "hi")).alias("pos"), F.lit(0).alias("quality")))
    ends = ends.where("pos IS NOT NULL").groupBy("source_id", "pos").agg(F.min("quality").cast("int").alias("q"))
    ends = ends.select("source_id", F.col("pos").cast("long").alias("a"), F.col("pos").cast("long").alias("b"), "q", F.lit(None).cast("string").alias("speaker"))
    spoken = proper(activities).select("source_id", F.col(S).cast("long").alias("a"), F.col(E).cast("long").alias("b"), F.lit(None).cast("int").alias("q"), F.col("speaker").cast("string").alias("speaker"))
    return ends.unionByName(spoken)


def _clips_of(rows: pa.Table, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_valid_clips`` of one source's ``_source_rows``."""
    is_end = rows["q"].is_valid()
    ends = rows.filter(is_end).sort_by("a")
    return _valid_clips(ends["a"].to_numpy(), ends["q"].to_numpy().astype(np.int64), rows.filter(pc.invert(is_end)), s)


def clip_edges(candidates: DataFrame, bounds: DataFrame, activities: DataFrame, excluded: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(source_id, a, b, q): valid clips between candidates; q is the quality of b.  A task holds one source's candidates, activities and edges.

    No rule that makes a clip invalid asks for the exclusions; they only count in a clip's figures.
    """
    ship(candidates.sparkSession)
    field = _source_field(bounds)

    def run(rows: pa.Table) -> pa.Table:
        a, b, q = _clips_of(rows, s)
        source = pa.repeat(rows["source_id"][0], len(a)).cast(field.type)
        return pa.Table.from_arrays([source, pa.array(a), pa.array(b), pa.array(q.astype(np.int32))], names=["source_id", "a", "b", "q"])

    return _source_rows(candidates, bounds, activities).groupBy("source_id").applyInArrow(run, f"source_id {bounds.schema['source_id'].dataType.simpleString()}, a long, b long, q int")


# fixed values: what a plan without a way says
SAYS = {
    "cover": "{count} clips cannot cover this conversation within 20–100 seconds; try approximately {nearest} clips.",
    "count": "The exact clip count has no safe pause combination that gives every clip both speakers and a completed exchange.",
    "other": "{count} clips are not feasible under the 20–100 second conversation constraints. Proposed the closest valid {k}-clip plan.",
    "target": "No safe pause combination can satisfy the target duration while keeping both speakers and a completed exchange in every clip.",
    "few": "Manual mode requires at least two distinct boundaries.",
    "outside": "Manual boundaries must stay within the source.",
    "clips": "One or more proposed clips violate export constraints.",
}


class _Edges:
    """The valid clips of one source as rows of sorted starts."""

    def __init__(self, a: np.ndarray, b: np.ndarray, q: np.ndarray, lo: int, hi: int):
        order = np.lexsort((b, a))
        self.a, self.b, self.q, self.lo, self.hi = a[order], b[order], q[order], lo, hi

    @cached_property
    def _counts(self) -> list[int]:
        """Numbers of clips that lead from one end to the other: bit k of a place says that k clips reach it."""
        bits = {self.lo: 1}
        for a, b in zip(self.a.tolist(), self.b.tolist()):  # starts ascend, so a place is complete before it is used
            have = bits.get(a)
            if have is not None:
                bits[b] = bits.get(b, 0) | have << 1
        last = bits.get(self.hi, 0)
        return [k for k in range(1, last.bit_length()) if last >> k & 1]

    def counts(self) -> list[int]:
        return self._counts

    def cheapest(self, count: int) -> list[int]:
        """The cuts of the best plan of a feasible count by (sum of qualities, sum of distances from even cuts).

        Of equal ways to a place the one whose predecessor was found first stays, then the one found first.
        """
        places, q, d = np.array([self.lo]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        back = []
        for layer in range(1, count + 1):
            first, last = np.searchsorted(self.a, places, "left"), np.searchsorted(self.a, places, "right")
            state = np.repeat(np.arange(len(places)), last - first)
            ends = np.cumsum(last - first)
            edge = np.arange(len(state)) - np.repeat(ends - (last - first), last - first) + np.repeat(first, last - first)
            b = self.b[edge]
            fits = (b == self.hi) if layer == count else (b < self.hi)
            state, edge, b = state[fits], edge[fits], b[fits]
            ideal = self.lo + int(np.rint((self.hi - self.lo) * layer / count))
            cost_q, cost_d = q[state] + np.where(b == self.hi, 0, self.q[edge]), d[state] + np.abs(b - ideal)
            order = np.lexsort((np.arange(len(b)), cost_d, cost_q, b))
            best = order[np.concatenate([[True], b[order][1:] != b[order][:-1]])] if len(b) else order
            found = np.unique(b, return_index=True)[1]  # by place, like ``best``
            best = best[np.argsort(found)]
            back.append((b[best], state[best]))
            places, q, d = b[best], cost_q[best], cost_d[best]
        cuts, at = [], 0
        for ends, before in reversed(back):
            cuts.append(int(ends[at]))
            at = int(before[at])
        return [self.lo, *reversed(cuts)]

    def plan(self, mode: str, asked: int, s: Settings) -> tuple[int | None, str, list[int], int]:
        """(clips, message, cuts, nearest) for ``asked`` clips or, with the mode target, clips of ``asked`` samples; no clips without a way."""
        total, counts = self.hi - self.lo, self.counts()
        nearest = max(1, round(total / (60 * CLOCK)))
        if mode == "count":
            order = lambda k: (abs(k - asked), abs(total / k - 60 * CLOCK), k)
            cover = asked * s.plan_min <= total <= asked * s.plan_max
            none = SAYS["count"] if cover else SAYS["cover"].format(count=asked, nearest=nearest)
        else:
            asked = min(s.plan_max, max(s.plan_min, asked))
            order = lambda k: (abs(total / k - asked), k)
            none = SAYS["target"]
        if not counts:
            return None, none, [self.lo, self.hi], nearest
        k = min(counts, key=order)
        return k, SAYS["other"].format(count=asked, k=k) if mode == "count" and k != asked else "", self.cheapest(k), nearest


def plan_search(edges: DataFrame, bounds: DataFrame, requests: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(source_id, request, mode, asked, k, feasible, nearest, message, cuts, counts) of requests (source_id, request, mode, asked).

    The mode is ``count`` (asked clips, else the nearest feasible number) or ``target`` (clips of about
    asked samples).  One pass over the sources: a task holds a source's edges (24 bytes each, a start has at most
    as many as candidates lie in 80 s) and a state for each candidate and clip (24 bytes; 10 hours are
    at most 1800 clips).  ``counts`` are all feasible numbers.  A source without edges has no way; requests for unknown sources and with a null are left out.
    """
    return _search(edges.select("source_id", "a", "b", "q"), lambda rows: tuple(rows[c].to_numpy().astype(np.int64) for c in ("a", "b", "q")), bounds, requests, s)


def plan_candidates(candidates: DataFrame, bounds: DataFrame, activities: DataFrame, requests: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """What ``plan_search`` returns for the edges of ``clip_edges``, which are made where they are used: neither written nor shuffled.

    A start has up to 100 s of candidates before it, so edges are some hundred times the candidates.
    """
    return _search(_source_rows(candidates, bounds, activities), lambda rows: _clips_of(rows, s), bounds, requests, s)


def _search(rows: DataFrame, edges: Callable[[pa.Table], tuple[np.ndarray, ...]], bounds: DataFrame, requests: DataFrame, s: Settings) -> DataFrame:
    """The plans of each source; ``edges`` makes (a, b, q) of its rows."""
    ship(rows.sparkSession)
    asked = requests.join(bounds.select("source_id", "lo", "hi"), "source_id").where("asked IS NOT NULL AND mode IS NOT NULL")
    asked = asked.select("source_id", F.col("request").cast("long").alias("request"), "mode", F.col("asked").cast("long").alias("asked"), "lo", "hi")
    kind = bounds.schema["source_id"].dataType.simpleString()

    def run(key: tuple, found: pa.Table, wanted: pa.Table) -> pa.Table:
        rows, ways = [], {}
        if wanted.num_rows:
            a, b, q = edges(found)
        for r in wanted.to_pylist():
            at = r["lo"], r["hi"]
            way = ways[at] = ways.get(at) or _Edges(a, b, q, *at)
            k, message, cuts, nearest = way.plan(r["mode"], r["asked"], s)
            rows.append({"source_id": r["source_id"], "request": r["request"], "mode": r["mode"], "asked": r["asked"], "k": k, "feasible": k is not None, "nearest": nearest, "message": message, "cuts": cuts, "counts": way.counts()})
        return pa.Table.from_pylist(rows, schema)

    schema = pa.schema([_source_field(bounds), ("request", pa.int64()), ("mode", pa.string()), ("asked", pa.int64()), ("k", pa.int64()), ("feasible", pa.bool_()), ("nearest", pa.int64()), ("message", pa.string()), ("cuts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
    out = f"source_id {kind}, request long, mode string, asked long, k long, feasible boolean, nearest long, message string, cuts array<long>, counts array<long>"
    rows = rows.select(F.col("source_id").alias("source_id"), *rows.columns[1:])
    return rows.groupBy("source_id").cogroup(asked.groupBy("source_id")).applyInArrow(run, out)


def _source_field(bounds: DataFrame) -> pa.Field:
    return pa.field("source_id", to_arrow_type(bounds.schema["source_id"].dataType))


def plan_verdicts(plans: DataFrame, clips: DataFrame, keys: list[str]) -> DataFrame:
    """Plans (keys, feasible, message) with what their clips (keys, status) say: an invalid clip makes a plan infeasible, its own message stays first."""
    bad = clips.where("status = 'invalid'").select(*keys, F.lit(True).alias("bad")).distinct()
    df = plans.join(bad, keys, "left")
    message = F.when(F.col("bad") & (F.coalesce("message", F.lit("")) == ""), SAYS["clips"]).otherwise(F.coalesce("message", F.lit("")))
    return df.withColumns({"feasible": F.col("feasible") & F.col("bad").isNull(), "message": message}).drop("bad")


def plan_clips(plan: DataFrame, activities: DataFrame, excluded: DataFrame, unsafe: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Clips of plans (source_id, cuts): number, id, bounds, status and reasons; cuts in speech are reasons."""
    parts = plan.select("source_id", F.posexplode(F.arrays_zip(F.slice("cuts", 1, F.size("cuts") - 1).alias("s"), F.slice("cuts", 2, F.size("cuts") - 1).alias("e"))).alias("no", "c"))
    parts = parts.select("source_id", (F.col("no") + 1).alias("clip_no"), F.col("c.s").alias(S), F.col("c.e").alias(E))
    rated = parts.join(evaluate_clips(parts, activities, excluded, s), ["source_id", S, E])
    bad = is_unsafe(parts.select("source_id", F.explode(F.array(S, E)).alias("pos")), unsafe)
    rated = rated.join(bad.select("source_id", F.col("pos").alias(S), F.lit("start_boundary_cuts_active_audio").alias("r0")), ["source_id", S], "left")
    rated = rated.join(bad.select("source_id", F.col("pos").alias(E), F.lit("end_boundary_cuts_active_audio").alias("r1")), ["source_id", E], "left")
    reasons = F.array_sort(F.array_distinct(F.concat("reasons", F.array_compact(F.array("r0", "r1")))))
    name = F.substring(F.sha2(F.concat_ws(":", "source_id", S, E), 256), 1, 12)
    return rated.select(
        "source_id", F.format_string("clip_%03d_%s", F.col("clip_no"), name).alias("clip_id"), "clip_no", S, E,
        F.when(F.size(reasons) == 0, "valid").otherwise("invalid").alias("status"), reasons.alias("reasons"), "silence_ratio", "overlap_ratio", "exchanges",
    )


def manual_cuts(requests: DataFrame, durations: DataFrame) -> DataFrame:
    """(source_id, cuts, problem, message) of requests (source_id, boundaries): distinct, sorted, at least two, inside the source."""
    df = requests.join(durations, "source_id").withColumn("cuts", F.array_sort(F.array_distinct("boundaries")))
    problem = F.when(F.size("cuts") < 2, "too_few_boundaries").when((F.array_min("cuts") < 0) | (F.array_max("cuts") > F.col("duration")), "boundary_outside_source")
    message = F.when(problem == "too_few_boundaries", SAYS["few"]).when(problem.isNotNull(), SAYS["outside"]).otherwise("")
    return df.select("source_id", "cuts", problem.alias("problem"), message.alias("message"))


def window_verdicts(windows: DataFrame, segments: DataFrame, assistant: str, s: Settings = DEFAULT) -> DataFrame:
    """Windows (source_id, start_sample, end_sample) in seconds' rules: status, reasons in rule order, figures."""
    w = windows.select("source_id", S, E).withColumn("window", F.struct(F.col(S).alias("w0"), F.col(E).alias("w1")))
    keys = ["source_id", "window"]
    cut = clip_to_windows(segments.select("source_id", "speaker", S, E), w, ["source_id"])
    role = cut.withColumn("role", F.when(F.col("speaker") == assistant, "assistant").otherwise("user"))
    lengths = union_length(role, [*keys, "role"]).groupBy(*keys).pivot("role", ["assistant", "user"]).agg(F.sum("length"))
    speech = union_length(cut, keys).withColumnRenamed("length", "speech")
    names = cut.groupBy(*keys).agg(F.collect_set("speaker").alias("names"))
    from .intervals import crowded_regions

    crowd = union_length(clip_to_windows(crowded_regions(segments.select("source_id", "speaker", S, E), ["source_id"]), w, ["source_id"]), keys).withColumnRenamed("length", "overlap")
    wide = w
    for part in (lengths, speech, names, crowd):
        wide = wide.join(part, keys, "left")
    sec = lambda c: F.coalesce(F.col(c), F.lit(0)) / float(CLOCK)
    length, a, u = (F.col(E) - F.col(S)) / float(CLOCK), sec("assistant"), sec("user")
    both = a + u
    small = F.when(both > 0, F.least(a, u) / both).otherwise(0.0)
    quiet = F.when(length > 0, F.greatest(F.lit(0.0), 1.0 - sec("speech") / length)).otherwise(1.0)
    over = F.when(length > 0, sec("overlap") / length).otherwise(1.0)
    count = F.coalesce(F.size("names"), F.lit(0))
    rules: list[tuple[str, Column]] = [
        ("clip_below_min_duration", length < s.min_clip_s),
        ("clip_above_max_duration", length > s.max_clip_s + 1e-6),
        ("more_than_two_active_speakers", count > 2),
        ("clip_missing_required_speaker", ~F.coalesce(F.array_contains("names", assistant), F.lit(False)) | (count < 2)),
        ("insufficient_assistant_speech", a < s.min_speaker_s),
        ("insufficient_user_speech", u < s.min_speaker_s),
        ("insufficient_speaker_share", small < s.min_speaker_share),
        ("excessive_silence", quiet > s.max_silence),
        ("excessive_overlap", over > s.max_overlap),
    ]
    reject = F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules]))
    warn = (over <= s.max_overlap) & (over > s.warn_overlap)
    reasons = F.when(warn, F.array_append(reject, "overlap_requires_review")).otherwise(reject)
    status = F.when(F.size(reject) > 0, "REJECT").when(warn, "REVIEW").otherwise("PASS")
    return wide.select("source_id", S, E, status.alias("status"), reasons.alias("reasons"), a.alias("assistant_s"), u.alias("user_s"), count.cast("long").alias("speaker_count"), quiet.alias("silence_ratio"), over.alias("overlap_ratio"), small.alias("min_share"))


def _next_cuts(cursors: DataFrame, cuts: DataFrame, lo: int, hi: int) -> DataFrame:
    """(source_id, c, b): the boundaries at lo to hi from each cursor; both meet through bins of hi samples."""
    bins = F.sequence(F.floor((F.col("c") + lo) / hi), F.floor((F.col("c") + hi) / hi))
    left = cursors.select("source_id", "c", F.explode(bins).alias("bin"))
    right = cuts.select("source_id", "b", F.floor(F.col("b") / hi).alias("bin"))
    return left.join(right, ["source_id", "bin"]).where((F.col("b") - F.col("c")).between(lo, hi)).select("source_id", "c", "b")


def follow(steps: DataFrame, starts: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(source_id, c, place): what is reached from each source's start (source_id, c) by steps (source_id, c, e), and after how many.

    The steps are composed with themselves, so n steps take log2(n) rounds.  Steps must lead upwards.  ``keep`` writes a
    round's tables down, else each would be planned from the first again; without one they go to the shared folder.
    """
    keep = keep or keeper(steps.sparkSession)
    reached, jump, length = keep(starts.select("source_id", "c", F.lit(0).cast("long").alias("place"))), steps.select("source_id", "c", "e"), 1
    while True:
        new = keep(reached.join(jump, ["source_id", "c"]).select("source_id", F.col("e").alias("c"), (F.col("place") + length).alias("place")))
        if new.isEmpty():
            return reached
        reached = keep(reached.unionByName(new))
        on = jump.select("source_id", F.col("c").alias("e"), F.col("e").alias("far"))
        jump, length = keep(jump.join(on, ["source_id", "e"]).select("source_id", "c", F.col("far").alias("e"))), 2 * length


def greedy_segments(segments: DataFrame, durations: DataFrame, assistant: str, s: Settings = DEFAULT, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(source_id, clip_no, start_sample, end_sample, status, reasons): clips one after the other, from before the first speech to after the last.

    A boundary is a turn's end with context; of those at a fitting length the best is (status, overlap
    ratio, distance from the target, minus the smaller share, position); without one the clip has the
    greatest length.  A rest that is too short joins the last clip if that stays within bounds.

    The best next cut of every place is found at once, then the way from the start is followed by
    doubling.  Places are the boundaries and what lies clips of the greatest length after one that has
    none within reach; these are found in a round for every stretch without a boundary that such clips
    jump over and then miss the next boundary, for all sources together, mostly one or two.
    """
    keep = keep or keeper(segments.sparkSession)
    lo, mid, hi = (int(x * CLOCK) for x in (s.min_clip_s, s.target_clip_s, s.max_clip_s))
    context = int(s.context_s * CLOCK)
    ends = segments.groupBy("source_id").agg(F.min(S).alias("s0"), F.max(E).alias("e1")).join(durations, "source_id")
    frame = keep(ends.select("source_id", F.greatest(F.lit(0), F.col("s0") - context).cast("long").alias("first"), F.least("duration", F.col("e1") + context).cast("long").alias("last"), "duration"))
    cuts = segments.join(frame, "source_id").select("source_id", F.least("duration", F.greatest("first", F.col(E) + context)).cast("long").alias("b"))
    cuts = keep(cuts.distinct())
    limits = frame.select("source_id", "last")
    new = keep(frame.select("source_id", F.col("first").alias("c")).unionByName(cuts.select("source_id", F.col("b").alias("c"))).distinct().join(limits, "source_id").where("c < last"))
    places = new
    while True:
        stuck = new.join(_next_cuts(new, cuts, lo, hi).select("source_id", "c").distinct(), ["source_id", "c"], "left_anti")
        # up to the next boundary clips of the greatest length follow each other, so all of their starts are places
        marks = stuck.select("source_id", (F.col("c") + hi).alias("pos"), "c", "last", F.lit(None).cast("long").alias("b")).unionByName(cuts.select("source_id", F.col("b").alias("pos"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("last"), "b"))
        ahead = F.first("b", ignorenulls=True).over(Window.partitionBy("source_id").orderBy("pos", F.col("b").isNotNull()).rowsBetween(1, Window.unboundedFollowing))
        jumps = F.greatest(F.lit(1), F.floor((F.least("last", F.coalesce("next", "last")) - F.col("c")) / hi))
        new = marks.withColumn("next", ahead).where("c IS NOT NULL").select("source_id", "c", "last", F.explode(F.sequence(F.lit(1).cast("long"), jumps)).alias("j"))
        new = new.select("source_id", (F.col("c") + F.col("j") * hi).alias("c"), "last").where("c < last").distinct()
        new = keep(new.join(places.select("source_id", "c"), ["source_id", "c"], "left_anti"))
        if new.isEmpty():
            break
        places = keep(places.unionByName(new))
    spans = _next_cuts(places, cuts, lo, hi)
    rated = window_verdicts(spans.select("source_id", F.col("c").alias(S), F.col("b").alias(E)), segments, assistant, s)
    rank = F.when(F.col("status") == "PASS", 0).when(F.col("status") == "REVIEW", 1).otherwise(2)
    score = F.struct(rank.alias("x"), "overlap_ratio", F.abs(F.col(E) - F.col(S) - mid).alias("y"), (-F.col("min_share")).alias("z"), F.col(E).alias("b"))
    best = rated.groupBy("source_id", F.col(S).alias("c")).agg(F.min(score).alias("m")).select("source_id", "c", F.col("m.b").alias("best"))
    step = places.join(best, ["source_id", "c"], "left")
    end = F.coalesce("best", F.least("last", F.col("c") + hi))
    end = F.when((F.col("last") - end < lo) & (F.col("last") - F.col("c") <= hi), F.col("last")).otherwise(end)
    step = keep(step.select("source_id", "c", end.alias("e")).where("e > c"))
    way = follow(step, frame.where("first < last").select("source_id", F.col("first").alias("c")), keep)
    clips = way.join(step, ["source_id", "c"]).select("source_id", (F.col("place") + 1).cast("int").alias("clip_no"), F.col("c").alias(S), F.col("e").alias(E))
    clips = keep(clips)
    return clips.join(window_verdicts(clips, segments, assistant, s), ["source_id", S, E]).select("source_id", "clip_no", S, E, "status", "reasons")
