"""Interval operators against sample-by-sample counting, and literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import assign as A
from parlance.operators import export as X
from parlance.operators import identity as ID
from parlance.operators import intervals as I
from parlance.operators import planning as G
from parlance.operators import qc as C
from parlance.operators import state as M
from parlance.writing import keeper
from parlance.sources import driver_tables as D

K = 24_000


def _runs(flags):
    out, start = [], None
    for k, f in enumerate([*flags, False]):
        if f and start is None:
            start = k
        if not f and start is not None:
            out.append((start, k))
            start = None
    return out


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_random_intervals(spark):
    rng = random.Random(4)
    kept = []
    for src in range(30):
        for _ in range(rng.randrange(0, 9)):
            a = rng.randrange(0, 48)
            kept.append((src, rng.choice("ABC"), a, a + rng.randrange(0, 12)))
    df = spark.createDataFrame(kept, "source_id long, speaker string, start_sample long, end_sample long")
    dur = spark.createDataFrame([(s, 50) for s in range(30)], "source_id long, duration long")
    want = {"crowd": [], "quiet": [], "both": []}
    for src in range(30):
        t = {p: [any(s == src and q == p and a <= k < b for s, q, a, b in kept) for k in range(60)] for p in "ABC"}
        n = [sum(t[p][k] for p in "ABC") for k in range(60)]
        want["crowd"] += [(src, *x) for x in _runs([c >= 2 for c in n])]
        want["quiet"] += [(src, *x) for x in _runs([c == 0 for c in n[:50]])]
        want["both"] += [(src, *x) for x in _runs([t["A"][k] and t["B"][k] for k in range(60)])]
    cols = ("source_id", "start_sample", "end_sample")
    assert _rows(I.crowded_regions(df, ["source_id"]), *cols) == sorted(want["crowd"])
    assert _rows(I.silences(df, dur), *cols) == sorted(want["quiet"])
    assert _rows(I.speaker_overlaps(df), *cols) == sorted(want["both"])
    pairs = I.range_join(df.where("speaker = 'A'").withColumnRenamed("speaker", "p"), df.where("speaker = 'B'").withColumnRenamed("speaker", "q"), ["source_id"], width=7)
    truth = [(a[0], a[2], a[3], b[2], b[3]) for a in kept for b in kept if a[0] == b[0] and a[1] == "A" and b[1] == "B" and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]]
    assert _rows(pairs, "source_id", "start_sample", "end_sample", "r_start", "r_end") == sorted(truth)


def _acts(spark, rows):
    return spark.createDataFrame([(1, p, int(a * K), int(b * K)) for p, a, b in rows], "source_id long, speaker string, start_sample long, end_sample long")


def test_overlap_and_silence_case(spark):
    acts = _acts(spark, [("A", 0, 25), ("B", 20, 50), ("A", 50, 80), ("B", 80, 120)])
    dur = spark.createDataFrame([(1, 125 * K)], "source_id long, duration long")
    assert _rows(I.speaker_overlaps(acts), "start_sample", "end_sample") == [(20 * K, 25 * K)]
    assert _rows(I.silences(acts, dur), "start_sample", "end_sample") == [(120 * K, 125 * K)]


def test_gap_closing(spark):
    acts = _acts(spark, [("A", 0, 1), ("A", 1.3, 2)])
    words = _acts(spark, [("A", 0.8, 1.5)])
    none = acts.where("false")
    regions, repairs = A.close_gaps(acts, words, none)
    assert _rows(regions, "start_sample", "end_sample") == [(0, 2 * K)]
    assert _rows(repairs, "start_sample", "end_sample") == [(K, int(1.3 * K))]
    rival = acts.unionByName(_acts(spark, [("B", 1.1, 1.2)]))
    assert A.close_gaps(rival, words, none)[1].count() == 0
    assert A.close_gaps(acts, words, _acts(spark, [("A", 1.1, 1.2)]))[1].count() == 0
    assert A.close_gaps(acts, none, none)[1].count() == 0


def test_smoothing(spark):
    one = A.smooth_turns(_acts(spark, [("A", 0, 2), ("B", 2, 2.2), ("A", 2.2, 4)]), 0.35 * K, ["source_id"])
    assert _rows(one, "start_sample", "speaker", "ambiguous") == [(0, "A", False), (2 * K, "A", False), (int(2.2 * K), "A", False)]
    two = A.smooth_turns(_acts(spark, [("A", 0, 2), ("B", 2, 2.2), ("B", 2.2, 4)]), 0.35 * K, ["source_id"])
    assert [r for r in _rows(two, "start_sample", "speaker", "ambiguous") if r[2]] == [(2 * K, "B", True)]


def test_overrides(spark):
    seg = _acts(spark, [("A", 0, 2), ("B", 2, 4)]).withColumn("seg_no", F.when(F.col("speaker") == "A", 0).otherwise(1))
    over = _acts(spark, [("B", 0, 1.5)]).withColumn("override_no", F.lit(0))
    assert _rows(A.apply_overrides(seg, over, ["source_id"]), "start_sample", "end_sample", "speaker") == [(0, 36000, "B"), (36000, 48000, "A"), (48000, 96000, "B")]


def test_greedy_segments(spark):
    from parlance.settings import Settings

    s = Settings(min_clip_s=4, target_clip_s=6, max_clip_s=8, min_speaker_s=0.5)
    acts = _acts(spark, [("A", .5, 2), ("B", 2.5, 4), ("A", 4.5, 6), ("B", 6.5, 8), ("A", 8.5, 10), ("B", 10.5, 12)])
    dur = spark.createDataFrame([(1, int(12.5 * K))], "source_id long, duration long")
    got = G.greedy_segments(acts, dur, "A", s, keep=keeper(spark))
    assert [r[0] for r in _rows(got, "status")] == ["PASS", "PASS"]
    bounds = _rows(got, "start_sample", "end_sample")
    assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))


def test_greedy_segments_end_after_the_last_speech(spark):
    acts = _acts(spark, [("A", 1, 2), ("B", 2.5, 4), ("A", 4.5, 6)])
    dur = spark.createDataFrame([(1, 60 * K)], "source_id long, duration long")
    assert _rows(G.greedy_segments(acts, dur, "A"), "clip_no", "start_sample", "end_sample") == [(1, int(.75 * K), int(6.25 * K))]


def test_turns_of_any_length(spark, tmp_path):
    rows = [(1, 0, "user", "word " * 900), (1, 1, "assistant", "a b"), (1, 2, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.n, r.last) for r in D.turn_words(spark, str(tmp_path)).groupBy("turn").agg(F.count("*").alias("n"), F.max("i").alias("last")).collect()}
    assert got == {0: (900, 899), 1: (2, 1)}
    spans = {r.turn: r.end_sample - r.start_sample for r in D.turns(spark, str(tmp_path)).collect()}
    assert spans == {0: 900 * 9600, 1: 2 * 9600, 2: 400 * 9600}  # a turn without text counts as 400 tokens, as in the SQL


def test_excessive_overlap(spark):
    from parlance.settings import Settings

    s = Settings(min_clip_s=1, target_clip_s=5, max_clip_s=20, max_overlap=.05)
    acts = _acts(spark, [("A", 0, 10), ("B", 1, 9)])
    win = spark.createDataFrame([(1, 0, 10 * K)], "source_id long, start_sample long, end_sample long")
    row = G.window_verdicts(win, acts, "A", s).first()
    assert row.status == "REJECT" and "excessive_overlap" in row.reasons


def test_exact_count_plan(spark):
    acts = _acts(spark, [("A", 0, 25), ("B", 20, 50), ("A", 50, 80), ("B", 80, 120)])
    dur = spark.createDataFrame([(1, 125 * K)], "source_id long, duration long")
    exc, words = _acts(spark, [("A", 60, 61)]).drop("speaker"), acts.where("false")
    keep = keeper(spark)
    cand = keep(G.boundary_candidates(acts, exc, words, acts.where("false"), dur))
    bounds = keep(G.conversation_bounds(acts, dur))
    edges = keep(G.clip_edges(cand, bounds, acts, exc))
    asked = spark.createDataFrame([(1, 0, "count", 2)], "source_id long, request int, mode string, asked int")
    found = keep(G.plan_search(edges, bounds, asked))
    assert 2 in found.first().counts and found.first().k == 2
    plan = found.select("source_id", "cuts")
    clips = G.plan_clips(plan, acts, exc, G.unsafe_intervals(acts, exc, words, dur)).collect()
    assert len(clips) == 2 and all(20 * K <= c.end_sample - c.start_sample <= 100 * K and c.exchanges >= 1 and c.status == "valid" for c in clips)
    manual = G.plan_clips(spark.createDataFrame([(1, [0, 25 * K, 90 * K])], "source_id long, cuts array<long>"), _acts(spark, [("A", 0, 30), ("B", 30, 60), ("A", 60, 90)]), exc, _acts(spark, [("A", 0, 30)]).drop("speaker"))
    assert "end_boundary_cuts_active_audio" in manual.where("clip_no = 1").first().reasons


def test_text_cases(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.character_error_rate(F.lit("word"), F.lit("ward"))) == 0.25
    assert one(T.character_error_rate(F.lit("word"), F.lit(" WORD "))) == 0.0
    assert one(T.disagreement(F.lit("same text"), F.lit("same text"))) == 0.0
    assert one(T.disagreement(F.lit("abc def"), F.lit("xyz uvw"))) > 0.5
    assert one(T.token_distance(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("c")))) == 1
    assert one(T.normalize_word(F.lit("أهلاً"))) == "اهلا"
    seg = spark.createDataFrame([(1, 0.0, 20.0, "go on " * 11, None), (2, 0.0, 5.0, " ".join(["aa", "ab", "ac"] * 5), -1.14)], "id int, start_s double, end_s double, text string, avg_logprob double")
    flags = {r.id: r.quality_flags for r in T.segment_flags(seg).collect()}
    assert "repeated_ngram" in flags[1]
    assert {"suspicious_character_sequence", "low_average_log_probability"} <= set(flags[2])
    p = spark.createDataFrame([(0.0, 1.0, -1.0), (1.0, 4.0, -0.2)], "start_s double, end_s double, avg_logprob double").withColumn("k", F.lit(1))
    assert abs(T.weighted_logprob(p, ["k"]).first().avg_logprob + 0.4) < 1e-12


def test_identity_cases(spark):
    def case(*v):
        df = spark.createDataFrame([(0, d, r, x) for (d, r), x in zip([("00", "A"), ("00", "B"), ("01", "A"), ("01", "B")], v)], "source_id int, detected string, reference string, similarity double")
        return ID.choose_mapping(df, ["source_id"]).first()

    assert (case(.82, .31, .29, .86).first_to, case(.25, .88, .84, .30).first_to) == ("A", "B")
    assert case(.70, .66, .67, .71).status == "low_margin"


def test_split_and_state(spark):
    src = spark.createDataFrame([(0, f"s{k}") for k in range(12)], "project_id int, source_id string")
    got = X.split_sources(src).collect()
    assert sum(r.split == "eval" for r in got) == 1 and len(got) == 12
    rev = spark.createDataFrame([(1, 1)], "source_id int, version int")
    ask = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 1), (2, 3, 0)], "source_id int, change_no int, expected_version int")
    ok, no = M.append_revisions(rev, ask)
    assert _rows(ok, "source_id", "change_no", "version") == [(1, 1, 2), (2, 3, 1)] and _rows(no, "change_no") == [(0,), (2,)]


def test_sidecar_and_verdicts(spark):
    al = spark.createDataFrame([("a", 0, "x", 1.0, 1.0, "SPEAKER_MAIN"), ("b", 0, "x", 0.1, 0.5, "SPEAKER_MAIN"), ("c", 0, "", 0.1, 0.5, "SPEAKER_MAIN")], "clip_id string, pos int, word string, start_s double, end_s double, speaker string")
    dur = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "clip_id string, duration double")
    got = {r.clip_id: r.reasons for r in C.sidecar_problems(al, dur).collect()}
    assert got == {"a": ["alignment_timestamp_out_of_bounds"], "b": [], "c": ["invalid_alignment_schema"], "d": ["invalid_alignment_schema"]}
