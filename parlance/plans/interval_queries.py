"""Queries of interval algebra, assignment and planning over the derived conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assign as A
from ..operators import intervals as I
from ..operators import planning as G
from ..settings import CLOCK
from ..sources import driver_tables as D
from ..writing import keeper

E, S = I.E, I.S


def w1_merged(spark: SparkSession, sf: str) -> DataFrame:
    return I.merge_intervals(D.activities(spark, sf), ["source_id", "speaker"])


def w1_merged_events(spark, sf):
    return I.merge_intervals(D.event_spans(spark, sf), ["source_id"])


def a1_union_length(spark, sf):
    return I.union_length(D.activities(spark, sf), ["source_id"])


def w2_crowded(spark, sf):
    return I.crowded_regions(D.event_spans(spark, sf), ["source_id"])


def w3_silences(spark, sf):
    return I.silences(D.activities(spark, sf), D.durations(spark, sf))


def w4_exchanges(spark, sf):
    return I.exchange_counts(D.activities(spark, sf), ["source_id"])


def w7_adjacent(spark, sf):
    return I.merge_adjacent(D.activities(spark, sf), ["source_id"], "speaker", 24_000)


def w13_speech_without_exclusions(spark, sf):
    whole = D.durations(spark, sf).select("source_id", F.lit(0).cast("long").alias(S), F.col("duration").alias(E))
    return I.complement(D.exclusions(spark, sf).select("source_id", S, E), whole, ["source_id"])


def j9_overlaps(spark, sf):
    return I.speaker_overlaps(D.activities(spark, sf))


def j9_event_pairs(spark, sf):
    spans = D.event_spans(spark, sf)
    a = spans.where("speaker = 'A'").select("source_id", F.col("event_id").alias("a_id"), S, E)
    b = spans.where("speaker = 'B'").select("source_id", F.col("event_id").alias("b_id"), S, E)
    met = I.range_join(a, b, ["source_id"], width=3_600_000)
    return met.select("source_id", "a_id", "b_id", (F.least(E, "r_end") - F.greatest(S, "r_start")).alias("shared"))


def j10_clipped(spark, sf):
    acts = D.activities(spark, sf).select("source_id", "speaker", S, E)
    windows = D.durations(spark, sf).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(duration - 1) div 1440000"))).alias("window"))
    windows = windows.select("source_id", "window", (F.col("window") * 1_440_000).alias(S), ((F.col("window") + 1) * 1_440_000).alias(E))
    return I.clip_to_windows(acts, windows, ["source_id"])


def u1_boundaries(spark, sf):
    return I.boundary_points([D.activities(spark, sf), D.exclusions(spark, sf)], ["source_id"])


def conversation_summary(spark, sf):
    """A and B seconds, overlap, silence and exchanges of each conversation."""
    t = keeper(spark)(D.turns(spark, sf))
    acts = D.activities(spark, sf, t)
    own = I.union_length(acts, ["source_id", "speaker"]).groupBy("source_id").pivot("speaker", ["A", "B"]).agg(F.sum("length"))
    over = I.union_length(I.speaker_overlaps(acts), ["source_id"]).withColumnRenamed("length", "overlap")
    quiet = I.union_length(I.silences(acts, D.durations(spark, sf, t)), ["source_id"]).withColumnRenamed("length", "silence")
    out = D.durations(spark, sf, t).join(own, "source_id", "left").join(over, "source_id", "left").join(quiet, "source_id", "left").join(I.exchange_counts(acts, ["source_id"]), "source_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("source_id", "duration", (zero("A") / 24000).alias("a_s"), (zero("B") / 24000).alias("b_s"), zero("overlap").alias("overlap"), zero("silence").alias("silence"), zero("exchanges").alias("exchanges"))


def j1_word_speakers(spark, sf):
    t = keeper(spark)(D.turns(spark, sf))
    words = D.turn_words(spark, sf, t).withColumn("speaker", F.lit(None).cast("string"))
    out = A.assign_speakers(words, D.activities(spark, sf, t), ["source_id"], ["turn", "i"])
    return out.select("source_id", "turn", "i", "speaker", "assignment_confidence", "uncertain")


def j2_turn_speakers(spark, sf):
    t = D.turns(spark, sf).select("source_id", "turn", S, E)
    return A.best_overlap(t, D.activities(spark, sf), ["source_id"], ["turn"])


def j3_speaker_at(spark, sf):
    t = keeper(spark)(D.turns(spark, sf))
    points = D.turn_words(spark, sf, t).select("source_id", "turn", "i", F.expr(f"({S} + {E}) div 2").alias("at"))
    return A.speaker_at(points, D.activities(spark, sf, t), ["source_id"], ["turn", "i"], "turn")


def j4_overrides(spark, sf):
    acts = D.activities(spark, sf).select("source_id", F.col("turn").alias("seg_no"), "speaker", S, E)
    over = D.exclusions(spark, sf).select("source_id", F.col("turn").alias("override_no"), F.lit("B").alias("speaker"), S, E)
    return A.apply_overrides(acts, over, ["source_id"])


def j5_overlap_flags(spark, sf):
    u = D.activities(spark, sf).select("source_id", "turn", S, E).withColumn("quality_flags", F.array(F.lit("repeated_ngram"), F.lit("overlapping_speech")))
    return A.flag_overlapping(u, I.speaker_overlaps(D.activities(spark, sf)), ["source_id"], ["turn"]).select("source_id", "turn", F.array_join("quality_flags", ",").alias("flags"))


def j6_alignment(spark, sf):
    u = D.turns(spark, sf).select("source_id", "turn", S, E).withColumn("quality_flags", F.array().cast("array<string>"))
    return A.alignment_status(u, D.turn_words(spark, sf), ["source_id"], ["turn"]).select("source_id", "turn", "alignment_status", F.array_join("quality_flags", ",").alias("flags"))


def j7_closed_gaps(spark, sf):
    """Gaps of up to twenty seconds, where every fifth turn is missing from the activities."""
    acts = D.activities(spark, sf).where("turn % 5 <> 2")
    words = D.turn_words(spark, sf).join(acts.select("source_id", "turn", "speaker"), ["source_id", "turn"])
    return A.close_gaps(acts, words.select("source_id", "speaker", (F.col(S) - 12000).alias(S), (F.col(E) + 12000).alias(E)), D.exclusions(spark, sf), 480_000)[1]


def j8_clean_turns(spark, sf):
    return A.clean_turns(D.activities(spark, sf))


def w6_smoothed(spark, sf):
    spans = D.event_spans(spark, sf).select("source_id", "speaker", S, E)
    return A.smooth_turns(spans, 30_000, ["source_id"])


def g2_bounds(spark, sf):
    return G.conversation_bounds(D.activities(spark, sf), D.durations(spark, sf))


def _candidates(spark, sf):
    t = keeper(spark)(D.turns(spark, sf))
    acts, exc, words, dur = D.activities(spark, sf, t), D.exclusions(spark, sf, t), D.turn_words(spark, sf, t), D.durations(spark, sf, t)
    return G.boundary_candidates(acts, exc, words, acts, dur), acts, exc, words, dur


def g5_candidates(spark, sf):
    return _candidates(spark, sf)[0]


def a3_clip_figures(spark, sf):
    t = keeper(spark)(D.turns(spark, sf))
    acts, exc = D.activities(spark, sf, t), D.exclusions(spark, sf, t)
    clips = D.durations(spark, sf, t).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(duration - 1) div 960000"))).alias("k"))
    clips = clips.select("source_id", (F.col("k") * 960_000).alias(S), ((F.col("k") + 1) * 960_000).alias(E))
    return G.evaluate_clips(clips, acts, exc).withColumn("reasons", F.array_join("reasons", ","))


def a2_window_verdicts(spark, sf):
    t = keeper(spark)(D.turns(spark, sf))
    clips = D.durations(spark, sf, t).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(duration - 1) div 960000"))).alias("k"))
    clips = clips.select("source_id", (F.col("k") * 960_000).alias(S), ((F.col("k") + 1) * 960_000).alias(E))
    return G.window_verdicts(clips, D.activities(spark, sf, t), "A").withColumn("reasons", F.array_join("reasons", ","))


def _plan_inputs(spark, sf):
    """(candidates, bounds, activities, exclusions, words, durations), written where they are used again."""
    keep = keeper(spark)
    t = keep(D.turns(spark, sf))
    acts, exc, words, dur = D.activities(spark, sf, t), D.exclusions(spark, sf, t), D.turn_words(spark, sf, t), keep(D.durations(spark, sf, t))
    bounds = keep(G.conversation_bounds(acts, dur))
    return keep(G.boundary_candidates(acts, exc, words, acts, dur)), bounds, acts, exc, words, dur


def g8_feasible_counts(spark, sf):
    """Every number of clips that each conversation can be cut into."""
    cand, bounds, acts, *_ = _plan_inputs(spark, sf)
    asked = bounds.select("source_id", F.lit(0).alias("request"), F.lit("count").alias("mode"), F.lit(1).alias("asked"))
    return G.plan_candidates(cand, bounds, acts, asked).select("source_id", F.explode("counts").alias("k"))


def g8_count_plans(spark, sf):
    """One to six clips asked for, by conversation; the nearest number that has a plan, or why there is none."""
    cand, bounds, acts, *_ = _plan_inputs(spark, sf)
    asked = bounds.select("source_id", F.lit(0).alias("request"), F.lit("count").alias("mode"), (F.col("source_id") % 6 + 1).alias("asked"))
    return G.plan_candidates(cand, bounds, acts, asked).select("source_id", "asked", "k", "feasible", "nearest", "message", F.array_join("cuts", ",").alias("cuts"))


def g9_target_plan(spark, sf):
    """Clips of each conversation near a minute long, from the exact-count planner."""
    keep = keeper(spark)
    cand, bounds, acts, exc, words, dur = _plan_inputs(spark, sf)
    asked = bounds.select("source_id", F.lit(0).alias("request"), F.lit("target").alias("mode"), F.lit(60 * CLOCK).alias("asked"))
    plan = keep(G.plan_candidates(cand, bounds, acts, asked).where("feasible").select("source_id", "cuts"))
    return G.plan_clips(plan, acts, exc, G.unsafe_intervals(acts, exc, words, dur)).withColumn("reasons", F.array_join("reasons", ","))


def g10_plan_verdicts(spark, sf):
    """Whether each conversation's plan can be used, and what to say: by count, by target or by hand, in turn."""
    keep = keeper(spark)
    cand, bounds, acts, exc, words, dur = _plan_inputs(spark, sf)
    turn = F.col("source_id") % 3
    asked = bounds.where(turn < 2).select("source_id", F.lit(0).alias("request"), F.when(turn == 0, "count").otherwise("target").alias("mode"), F.when(turn == 0, F.col("source_id") % 4 + 1).otherwise(40 * CLOCK).alias("asked"))
    found = G.plan_candidates(cand, bounds, acts, asked).select("source_id", "mode", "feasible", "message", "cuts")
    hand = acts.where("source_id % 3 = 2 AND turn % 2 = 0").groupBy("source_id").agg(F.collect_list(E).alias("boundaries"))
    hand = G.manual_cuts(hand, dur).select("source_id", F.lit("manual").alias("mode"), F.col("problem").isNull().alias("feasible"), "message", "cuts")
    plans = keep(found.unionByName(hand))
    clips = G.plan_clips(plans.where("size(cuts) > 1").select("source_id", "cuts"), acts, exc, G.unsafe_intervals(acts, exc, words, dur))
    return G.plan_verdicts(plans, clips, ["source_id"]).select("source_id", "mode", "feasible", "message", F.array_join("cuts", ",").alias("cuts"))


def g11_manual_plan(spark, sf):
    """Clips between every third turn's end: manual boundaries, with what is wrong with them."""
    t = keeper(spark)(D.turns(spark, sf))
    acts, exc, words, dur = D.activities(spark, sf, t), D.exclusions(spark, sf, t), D.turn_words(spark, sf, t), D.durations(spark, sf, t)
    asked = acts.where("turn % 3 = 0").groupBy("source_id").agg(F.collect_list(E).alias("boundaries"))
    cuts = G.manual_cuts(asked, dur).where("problem is null")
    return G.plan_clips(cuts, acts, exc, G.unsafe_intervals(acts, exc, words, dur)).withColumn("reasons", F.array_join("reasons", ","))


def g6_greedy(spark, sf):
    keep = keeper(spark)
    t = keep(D.turns(spark, sf))
    return G.greedy_segments(keep(D.activities(spark, sf, t)), keep(D.durations(spark, sf, t)), "A", keep=keep).withColumn("reasons", F.array_join("reasons", ","))


_MERGE = """{n}0 AS (SELECT {k}, start_sample, end_sample, max(end_sample) OVER (PARTITION BY {k} ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM {src} WHERE end_sample > start_sample),
{n}1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_sample > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY start_sample, end_sample ROWS UNBOUNDED PRECEDING) AS isl FROM {n}0),
{n} AS (SELECT {k}, min(start_sample) AS start_sample, max(end_sample) AS end_sample FROM {n}1 GROUP BY {k}, isl)"""


def merged(n: str, src: str, k: str) -> str:
    return _MERGE.format(n=n, src=src, k=k)


BASE = "WITH " + D.SQL
_OVER = ",\n".join([
    merged("ms", "act", "source_id, speaker"),
    """pair AS (SELECT a.source_id, greatest(a.start_sample, b.start_sample) AS start_sample, least(a.end_sample, b.end_sample) AS end_sample
  FROM ms a JOIN ms b ON a.source_id = b.source_id AND a.speaker = 'A' AND b.speaker = 'B' AND a.start_sample < b.end_sample AND b.start_sample < a.end_sample)""",
    merged("ov", "pair", "source_id"),
])
_QUIET = ",\n".join([
    "cutact AS (SELECT a.source_id, greatest(start_sample, 0) AS start_sample, least(end_sample, duration) AS end_sample FROM act a JOIN dur USING (source_id))",
    merged("sq", "cutact", "source_id"),
    """marks AS (SELECT * FROM sq UNION ALL SELECT source_id, 0, 0 FROM dur UNION ALL SELECT source_id, duration, duration FROM dur),
holes AS (SELECT source_id, end_sample AS start_sample, lead(start_sample) OVER (PARTITION BY source_id ORDER BY start_sample, end_sample) AS end_sample FROM marks),
quiet AS (SELECT * FROM holes WHERE end_sample > start_sample)""",
])
_CLIPS = """clips AS (SELECT source_id, k * 960000 AS start_sample, (k + 1) * 960000 AS end_sample FROM (SELECT source_id, unnest(range(0, (duration - 1) // 960000 + 1)) AS k FROM dur)),
cut AS (SELECT c.source_id, c.start_sample AS w0, c.end_sample AS w1, a.speaker, greatest(a.start_sample, c.start_sample) AS start_sample, least(a.end_sample, c.end_sample) AS end_sample
  FROM clips c JOIN act a ON a.source_id = c.source_id AND a.start_sample < c.end_sample AND c.start_sample < a.end_sample)"""
_CLIP_FIGURES = ",\n".join([
    _OVER, _CLIPS, merged("cs", "cut", "source_id, w0, w1, speaker"), merged("cu", "cut", "source_id, w0, w1"),
    """own AS (SELECT source_id, w0, sum(CASE WHEN speaker = 'A' THEN end_sample - start_sample ELSE 0 END) AS a, sum(CASE WHEN speaker = 'B' THEN end_sample - start_sample ELSE 0 END) AS b, count(DISTINCT speaker) AS sc FROM cs GROUP BY 1, 2),
spk AS (SELECT source_id, w0, sum(end_sample - start_sample) AS speech FROM cu GROUP BY 1, 2),
exo AS (SELECT source_id, w0, sum(CASE WHEN prev <> speaker THEN 1 ELSE 0 END) AS ex FROM (SELECT *, lag(speaker) OVER (PARTITION BY source_id, w0 ORDER BY start_sample, end_sample, speaker) AS prev FROM cut) GROUP BY 1, 2),
ovl AS (SELECT c.source_id, c.start_sample AS w0, sum(least(o.end_sample, c.end_sample) - greatest(o.start_sample, c.start_sample)) AS ov FROM clips c JOIN ov o ON o.source_id = c.source_id AND o.start_sample < c.end_sample AND c.start_sample < o.end_sample GROUP BY 1, 2),
ecut AS (SELECT c.source_id, c.start_sample AS w0, greatest(x.start_sample, c.start_sample) AS start_sample, least(x.end_sample, c.end_sample) AS end_sample FROM clips c JOIN exc x ON x.source_id = c.source_id AND x.start_sample < c.end_sample AND c.start_sample < x.end_sample)""",
    merged("em", "ecut", "source_id, w0"),
    """exl AS (SELECT source_id, w0, sum(end_sample - start_sample) AS xl FROM em GROUP BY 1, 2),
fig AS (SELECT c.source_id, c.start_sample, c.end_sample, CAST(coalesce(a, 0) AS BIGINT) AS a, CAST(coalesce(b, 0) AS BIGINT) AS b, coalesce(sc, 0) AS sc, coalesce(speech, 0) AS speech, CAST(coalesce(ex, 0) AS BIGINT) AS ex,
  coalesce(ov, 0) / 960000.0::DOUBLE AS orat, coalesce(xl, 0) / 960000.0::DOUBLE AS xrat, greatest(0.0::DOUBLE, 1.0::DOUBLE - coalesce(speech, 0) / 960000::DOUBLE) AS quiet
  FROM clips c LEFT JOIN own o ON o.source_id = c.source_id AND o.w0 = c.start_sample LEFT JOIN spk s ON s.source_id = c.source_id AND s.w0 = c.start_sample
  LEFT JOIN exo e ON e.source_id = c.source_id AND e.w0 = c.start_sample LEFT JOIN ovl v ON v.source_id = c.source_id AND v.w0 = c.start_sample LEFT JOIN exl x ON x.source_id = c.source_id AND x.w0 = c.start_sample)""",
])

QUERIES = {
    "conversation_summary": conversation_summary, "W1_merge_intervals": w1_merged, "W1_merge_event_spans": w1_merged_events, "A1_union_length": a1_union_length,
    "W2_crowded_regions": w2_crowded, "W3_silences": w3_silences, "W4_exchanges": w4_exchanges, "W7_merge_adjacent": w7_adjacent, "W13_subtract": w13_speech_without_exclusions,
    "J9_speaker_overlaps": j9_overlaps, "J9_event_pairs": j9_event_pairs, "J10_clip_to_windows": j10_clipped, "U1_boundaries": u1_boundaries, "J1_word_speakers": j1_word_speakers,
    "J2_majority_speaker": j2_turn_speakers, "J3_speaker_at": j3_speaker_at, "J4_overrides": j4_overrides, "J5_overlap_flags": j5_overlap_flags, "J6_alignment_status": j6_alignment,
    "J7_close_gaps": j7_closed_gaps, "J8_clean_turns": j8_clean_turns, "W6_smooth_turns": w6_smoothed, "G2_conversation_bounds": g2_bounds, "G5_boundary_candidates": g5_candidates,
    "A3_evaluate_clips": a3_clip_figures, "A2_window_verdicts": a2_window_verdicts, "G8_feasible_counts": g8_feasible_counts, "G8_count_plans": g8_count_plans, "G10_plan_verdicts": g10_plan_verdicts, "G9_target_plan": g9_target_plan,
    "G11_manual_plan": g11_manual_plan, "G6_greedy_segments": g6_greedy,
}

ORACLES = {
    "W6_smooth_turns": f"""WITH RECURSIVE {D.SQL},
o AS (SELECT *, row_number() OVER w AS no, lag(speaker) OVER w AS before, lead(speaker) OVER w AS after FROM sp0 WINDOW w AS (PARTITION BY source_id ORDER BY start_sample, end_sample, speaker)),
r(source_id, no, start_sample, end_sample, speaker, ambiguous) AS (SELECT source_id, no, start_sample, end_sample, speaker, false FROM o WHERE no = 1
  UNION ALL SELECT o.source_id, o.no, o.start_sample, o.end_sample, CASE WHEN o.after IS NOT NULL AND o.end_sample - o.start_sample < 30000 AND r.speaker = o.after THEN o.after ELSE o.speaker END,
    o.after IS NOT NULL AND o.end_sample - o.start_sample < 30000 AND NOT (r.speaker = o.after AND r.speaker <> o.speaker) FROM r JOIN o ON o.source_id = r.source_id AND o.no = r.no + 1)
SELECT source_id, start_sample, end_sample, speaker, ambiguous FROM r""",
    "J4_overrides": f"""{BASE},
p AS (SELECT source_id, unnest([start_sample, end_sample]) AS p FROM act UNION SELECT source_id, unnest([start_sample, end_sample]) FROM exc),
q AS (SELECT source_id, p AS p0, lead(p) OVER (PARTITION BY source_id ORDER BY p) AS p1 FROM p),
n AS (SELECT *, coalesce(CASE WHEN EXISTS (SELECT 1 FROM exc x WHERE x.source_id = q.source_id AND x.start_sample <= (p0 + p1) // 2 AND (p0 + p1) // 2 < x.end_sample) THEN 'B' END,
  (SELECT arg_min(a.speaker, a.turn) FROM act a WHERE a.source_id = q.source_id AND a.start_sample <= (p0 + p1) // 2 AND (p0 + p1) // 2 < a.end_sample)) AS speaker FROM q WHERE p1 IS NOT NULL),
x AS (SELECT *, lag(speaker) OVER (PARTITION BY source_id ORDER BY p0) AS ps, lag(p1) OVER (PARTITION BY source_id ORDER BY p0) AS pe FROM n WHERE speaker IS NOT NULL),
y AS (SELECT *, sum(CASE WHEN ps = speaker AND p0 <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY p0) AS isl FROM x)
SELECT source_id, speaker, min(p0) AS start_sample, max(p1) AS end_sample FROM y GROUP BY source_id, speaker, isl""",
    "W1_merge_intervals": f"{BASE},\n{merged('m', 'act', 'source_id, speaker')}\nSELECT * FROM m",
    "W1_merge_event_spans": f"{BASE},\n{merged('m', 'sp0', 'source_id')}\nSELECT * FROM m",
    "A1_union_length": f"{BASE},\n{merged('m', 'act', 'source_id')}\nSELECT source_id, CAST(sum(end_sample - start_sample) AS BIGINT) AS length FROM m GROUP BY 1",
    "W2_crowded_regions": f"""{BASE},\n{merged('m', 'sp0', 'source_id, speaker')},
pr AS (SELECT a.source_id, greatest(a.start_sample, b.start_sample) AS start_sample, least(a.end_sample, b.end_sample) AS end_sample FROM m a JOIN m b
  ON a.source_id = b.source_id AND a.speaker < b.speaker AND a.start_sample < b.end_sample AND b.start_sample < a.end_sample),
{merged('r', 'pr', 'source_id')}
SELECT * FROM r""",
    "W3_silences": f"{BASE},\n{_QUIET}\nSELECT * FROM quiet",
    "W4_exchanges": f"""{BASE} SELECT source_id, CAST(sum(CASE WHEN p <> speaker THEN 1 ELSE 0 END) AS BIGINT) AS exchanges
FROM (SELECT *, lag(speaker) OVER (PARTITION BY source_id ORDER BY start_sample, end_sample, speaker) AS p FROM act) GROUP BY 1""",
    "W7_merge_adjacent": f"""{BASE},
x AS (SELECT *, lag(speaker) OVER w AS p, max(end_sample) OVER (PARTITION BY source_id ORDER BY start_sample, end_sample, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM act WINDOW w AS (PARTITION BY source_id ORDER BY start_sample, end_sample, speaker)),
y AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> speaker OR start_sample > reach + 24000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_sample, end_sample, speaker ROWS UNBOUNDED PRECEDING) AS isl FROM x)
SELECT source_id, speaker, min(start_sample) AS start_sample, max(end_sample) AS end_sample FROM y GROUP BY source_id, speaker, isl""",
    "W13_subtract": f"""{BASE},\n{merged('x', 'exc', 'source_id')},
mk AS (SELECT source_id, greatest(start_sample, 0) AS start_sample, least(end_sample, duration) AS end_sample FROM x JOIN dur USING (source_id)
  UNION ALL SELECT source_id, 0, 0 FROM dur UNION ALL SELECT source_id, duration, duration FROM dur),
h AS (SELECT source_id, end_sample AS start_sample, lead(start_sample) OVER (PARTITION BY source_id ORDER BY start_sample, end_sample) AS end_sample FROM mk)
SELECT * FROM h WHERE end_sample > start_sample""",
    "J9_speaker_overlaps": f"{BASE},\n{_OVER}\nSELECT * FROM ov",
    "J9_event_pairs": f"""{BASE} SELECT a.source_id, a.event_id AS a_id, b.event_id AS b_id, least(a.end_sample, b.end_sample) - greatest(a.start_sample, b.start_sample) AS shared
FROM sp0 a JOIN sp0 b ON a.source_id = b.source_id AND a.speaker = 'A' AND b.speaker = 'B' AND a.start_sample < b.end_sample AND b.start_sample < a.end_sample""",
    "J10_clip_to_windows": f"""{BASE},
w AS (SELECT source_id, "window", "window" * 1440000 AS w0, ("window" + 1) * 1440000 AS w1 FROM (SELECT source_id, unnest(range(0, (duration - 1) // 1440000 + 1)) AS "window" FROM dur))
SELECT w.source_id, w."window", a.speaker, greatest(w0, start_sample) AS start_sample, least(w1, end_sample) AS end_sample FROM w JOIN act a ON a.source_id = w.source_id AND start_sample < w1 AND w0 < end_sample""",
    "U1_boundaries": f"""{BASE} SELECT source_id, start_sample AS point FROM act UNION SELECT source_id, end_sample FROM act UNION SELECT source_id, start_sample FROM exc UNION SELECT source_id, end_sample FROM exc""",
    "conversation_summary": f"""{BASE},\n{_OVER},\n{_QUIET},
o AS (SELECT source_id, sum(CASE WHEN speaker = 'A' THEN end_sample - start_sample ELSE 0 END) AS a, sum(CASE WHEN speaker = 'B' THEN end_sample - start_sample ELSE 0 END) AS b FROM ms GROUP BY 1),
v AS (SELECT source_id, sum(end_sample - start_sample) AS ov FROM ov GROUP BY 1), q AS (SELECT source_id, sum(end_sample - start_sample) AS q FROM quiet GROUP BY 1),
e AS (SELECT source_id, sum(CASE WHEN p <> speaker THEN 1 ELSE 0 END) AS e FROM (SELECT *, lag(speaker) OVER (PARTITION BY source_id ORDER BY start_sample, end_sample, speaker) AS p FROM act) GROUP BY 1)
SELECT source_id, duration, coalesce(a, 0) / 24000::DOUBLE AS a_s, coalesce(b, 0) / 24000::DOUBLE AS b_s, CAST(coalesce(ov, 0) AS BIGINT) AS overlap, CAST(coalesce(q, 0) AS BIGINT) AS silence, CAST(coalesce(e, 0) AS BIGINT) AS exchanges
FROM dur LEFT JOIN o USING (source_id) LEFT JOIN v USING (source_id) LEFT JOIN q USING (source_id) LEFT JOIN e USING (source_id)""",
    "J1_word_speakers": f"""{BASE},
s AS (SELECT w.source_id, w.turn, w.i, a.speaker, sum(least(w.end_sample, a.end_sample) - greatest(w.start_sample, a.start_sample)) AS ov FROM words w JOIN act a
  ON a.source_id = w.source_id AND w.start_sample < a.end_sample AND a.start_sample < w.end_sample GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY source_id, turn, i ORDER BY ov DESC, speaker DESC) AS r FROM s)
SELECT w.source_id, w.turn, w.i, CASE WHEN ov / (end_sample - start_sample)::DOUBLE >= 0.5 THEN b.speaker END AS speaker, ov / (end_sample - start_sample)::DOUBLE AS assignment_confidence,
  NOT coalesce(ov / (end_sample - start_sample)::DOUBLE >= 0.5, false) AS uncertain FROM words w LEFT JOIN b ON b.source_id = w.source_id AND b.turn = w.turn AND b.i = w.i AND r = 1""",
    "J2_majority_speaker": f"""{BASE},
s AS (SELECT t.source_id, t.turn, a.speaker, sum(least(t.end_sample, a.end_sample) - greatest(t.start_sample, a.start_sample)) AS ov FROM turns t JOIN act a
  ON a.source_id = t.source_id AND t.start_sample < a.end_sample AND a.start_sample < t.end_sample GROUP BY ALL)
SELECT source_id, turn, speaker AS best_speaker, CAST(ov AS BIGINT) AS best_overlap FROM s QUALIFY row_number() OVER (PARTITION BY source_id, turn ORDER BY ov DESC, speaker DESC) = 1""",
    "J3_speaker_at": f"""{BASE}, p AS (SELECT source_id, turn, i, (start_sample + end_sample) // 2 AS "at" FROM words)
SELECT p.source_id, p.turn, p.i, p."at", arg_min(a.speaker, a.turn) AS speaker_at FROM p LEFT JOIN act a ON a.source_id = p.source_id AND a.start_sample <= p."at" AND p."at" < a.end_sample GROUP BY ALL""",
    "J5_overlap_flags": f"""{BASE},\n{_OVER}
SELECT a.source_id, a.turn, CASE WHEN sum(CASE WHEN o.start_sample IS NULL THEN 0 ELSE least(a.end_sample, o.end_sample) - greatest(a.start_sample, o.start_sample) END) >= greatest(6000, round_even((a.end_sample - a.start_sample) * 0.05, 0)) THEN 'overlapping_speech,repeated_ngram' ELSE 'repeated_ngram' END AS flags
FROM act a LEFT JOIN ov o ON o.source_id = a.source_id AND o.start_sample < a.end_sample AND a.start_sample < o.end_sample GROUP BY a.source_id, a.turn, a.start_sample, a.end_sample""",
    "J6_alignment_status": f"""{BASE},
m AS (SELECT t.source_id, t.turn, bool_or(w.score < 0.4) AS low FROM turns t JOIN words w ON w.source_id = t.source_id AND w.start_sample < t.end_sample AND t.start_sample < w.end_sample GROUP BY 1, 2)
SELECT source_id, turn, CASE WHEN low IS NULL THEN 'unaligned' WHEN low THEN 'low_confidence' ELSE 'aligned' END AS alignment_status,
  CASE WHEN low IS NULL THEN 'unaligned_words' WHEN low THEN 'low_confidence_alignment' ELSE '' END AS flags FROM turns LEFT JOIN m USING (source_id, turn)""",
    "J7_close_gaps": f"""{BASE},\nac5 AS (SELECT * FROM act WHERE turn % 5 <> 2),\n{merged('m', 'ac5', 'source_id, speaker')},
h AS (SELECT source_id, speaker, lag(end_sample) OVER (PARTITION BY source_id, speaker ORDER BY start_sample) AS g0, start_sample AS g1 FROM m)
SELECT source_id, speaker, g0 AS start_sample, g1 AS end_sample FROM h WHERE g0 IS NOT NULL AND g1 - g0 <= 480000
  AND EXISTS (SELECT 1 FROM words w JOIN ac5 a ON a.source_id = w.source_id AND a.turn = w.turn WHERE w.source_id = h.source_id AND a.speaker = h.speaker AND w.start_sample - 12000 < g1 AND g0 < w.end_sample + 12000)
  AND NOT EXISTS (SELECT 1 FROM ac5 a WHERE a.source_id = h.source_id AND a.speaker <> h.speaker AND a.start_sample < g1 AND g0 < a.end_sample)
  AND NOT EXISTS (SELECT 1 FROM exc x WHERE x.source_id = h.source_id AND x.start_sample < g1 AND g0 < x.end_sample)""",
    "J8_clean_turns": f"""{BASE}
SELECT source_id, speaker, start_sample, end_sample, CAST(row_number() OVER (PARTITION BY source_id, speaker ORDER BY end_sample - start_sample DESC, start_sample) AS INTEGER) AS rank FROM act a
WHERE end_sample - start_sample >= 36000 AND NOT EXISTS (SELECT 1 FROM act b WHERE b.source_id = a.source_id AND b.speaker <> a.speaker AND b.start_sample < a.end_sample AND a.start_sample < b.end_sample) QUALIFY rank <= 25""",
    "G2_conversation_bounds": f"""{BASE}
SELECT source_id, CAST(coalesce(greatest(0, min(start_sample) - 6000), 0) AS BIGINT) AS lo, CAST(coalesce(least(duration, max(end_sample) + 6000), duration) AS BIGINT) AS hi, duration FROM dur LEFT JOIN act USING (source_id) GROUP BY source_id, duration""",
    "G5_boundary_candidates": f"""{BASE},\n{_OVER},\n{_QUIET},
wc AS (SELECT source_id, greatest(0, start_sample) AS start_sample, least(duration, end_sample) AS end_sample FROM words JOIN dur USING (source_id)),
{merged('wm', 'wc', 'source_id')},
un AS (SELECT source_id, start_sample, end_sample FROM exc UNION ALL SELECT * FROM ov UNION ALL SELECT source_id, start_sample - 960, end_sample + 960 FROM wm
  UNION ALL SELECT source_id, start_sample, end_sample FROM act WHERE source_id NOT IN (SELECT source_id FROM wm)),
bd AS (SELECT source_id, coalesce(greatest(0, min(start_sample) - 6000), 0) AS lo, coalesce(least(duration, max(end_sample) + 6000), duration) AS hi, duration FROM dur LEFT JOIN act USING (source_id) GROUP BY source_id, duration),
c AS (SELECT source_id, lo AS pos, 0 AS q FROM bd UNION ALL SELECT source_id, hi, 0 FROM bd
  UNION ALL SELECT source_id, (start_sample + end_sample) // 2, 0 FROM quiet WHERE end_sample - start_sample >= 6000
  UNION ALL SELECT source_id, (end_sample + nx) // 2, 1 FROM (SELECT *, lead(start_sample) OVER (PARTITION BY source_id ORDER BY start_sample) AS nx FROM wm) WHERE nx - end_sample >= 6000
  UNION ALL SELECT source_id, end_sample, 1 FROM act),
d AS (SELECT source_id, pos, min(q) AS quality, any_value(lo) AS lo, any_value(hi) AS hi, any_value(duration) AS duration FROM c JOIN bd USING (source_id) WHERE pos BETWEEN lo AND hi GROUP BY 1, 2)
SELECT source_id, CAST(pos AS BIGINT) AS pos, CAST(quality AS INTEGER) AS quality FROM d WHERE pos = lo OR pos = hi OR pos <= 0 OR pos >= duration
  OR NOT EXISTS (SELECT 1 FROM un WHERE un.source_id = d.source_id AND un.start_sample < d.pos AND d.pos < un.end_sample)""",
    "A3_evaluate_clips": f"""{BASE},\n{_CLIP_FIGURES}
SELECT source_id, start_sample, end_sample, array_to_string(list_filter([CASE WHEN quiet > 0.8 THEN 'excessive_silence' END, CASE WHEN a < 24000 THEN 'insufficient_speaker_A' END, CASE WHEN b < 24000 THEN 'insufficient_speaker_B' END,
  CASE WHEN a + b > 0 AND least(a, b) / (a + b)::DOUBLE < 0.02 THEN 'insufficient_speaker_share' END, CASE WHEN ex < 1 THEN 'missing_speaker_exchange' END], lambda x: x IS NOT NULL), ',') AS reasons,
  a AS a_samples, b AS b_samples, quiet AS silence_ratio, orat AS overlap_ratio, xrat AS exclusion_ratio, ex AS exchanges FROM fig""",
    "A2_window_verdicts": f"""{BASE},\n{_CLIP_FIGURES},
g AS (SELECT *, a / 24000::DOUBLE AS asec, b / 24000::DOUBLE AS usec, CASE WHEN a / 24000::DOUBLE + b / 24000::DOUBLE > 0 THEN least(a / 24000::DOUBLE, b / 24000::DOUBLE) / (a / 24000::DOUBLE + b / 24000::DOUBLE) ELSE 0::DOUBLE END AS sh,
  greatest(0::DOUBLE, 1.0::DOUBLE - speech / 24000::DOUBLE / 40::DOUBLE) AS qt, orat * 960000 / 24000::DOUBLE / 40::DOUBLE AS ovr FROM fig),
r AS (SELECT *, list_filter([CASE WHEN a = 0 OR sc < 2 THEN 'clip_missing_required_speaker' END, CASE WHEN asec < 1 THEN 'insufficient_assistant_speech' END, CASE WHEN usec < 1 THEN 'insufficient_user_speech' END,
  CASE WHEN sh < 0.02 THEN 'insufficient_speaker_share' END, CASE WHEN qt > 0.8 THEN 'excessive_silence' END, CASE WHEN ovr > 0.2 THEN 'excessive_overlap' END], lambda x: x IS NOT NULL) AS rj, ovr <= 0.2 AND ovr > 0.05 AS warn FROM g)
SELECT source_id, start_sample, end_sample, CASE WHEN len(rj) > 0 THEN 'REJECT' WHEN warn THEN 'REVIEW' ELSE 'PASS' END AS status,
  array_to_string(CASE WHEN warn THEN list_append(rj, 'overlap_requires_review') ELSE rj END, ',') AS reasons, asec AS assistant_s, usec AS user_s, sc AS speaker_count, qt AS silence_ratio, ovr AS overlap_ratio, sh AS min_share FROM r""",
}
