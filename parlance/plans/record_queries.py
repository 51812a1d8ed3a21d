"""Queries of rows in and out, quality control, state and exports, over columns that follow from the given tables.

The input columns (``CLIP`` and the like) are plain expressions that Spark and DuckDB read alike; what the operators do with
them is written anew in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assign as A
from ..operators import export as X
from ..operators import intervals as I
from ..operators import qc as C
from ..operators import quality as Q
from ..operators import records as R
from ..operators import state as M
from ..sources import driver_tables as D
from ..writing import keeper
from .table_queries import _UTT, _spoken, _utterances

E, S = I.E, I.S

# ---------------------------------------------------------------- input columns
_K = "o_orderkey"
CLIP = [
    f"CAST({_K} AS BIGINT) AS clip_id", "CAST(o_custkey AS BIGINT) AS source_id", f"CASE WHEN {_K} % 41 = 0 THEN 1 ELSE 2 END AS channels", f"CASE WHEN {_K} % 43 = 0 THEN 16000 ELSE 24000 END AS sample_rate",
    f"CAST({_K} % 97 AS DOUBLE) / 2 AS duration", f"CAST({_K} % 97 AS DOUBLE) / 2 + CASE WHEN {_K} % 11 = 0 THEN CAST(1 AS DOUBLE) / 4 ELSE CAST(0 AS DOUBLE) END AS expected_duration",
    f"CAST({_K} % 37 AS DOUBLE) / 64 AS left_rms", f"CAST({_K} % 53 AS DOUBLE) / 64 AS right_rms", f"CAST({_K} % 1000 AS DOUBLE) / 1000 AS left_silence", f"CAST({_K} % 777 AS DOUBLE) / 1000 AS right_silence",
    f"CAST({_K} % 23 AS DOUBLE) / 2048 AS left_clipping", f"CAST({_K} % 3 AS DOUBLE) / 4096 AS right_clipping", f"CAST({_K} % 7 AS DOUBLE) / 16 AS right_leakage", f"CAST({_K} % 9 AS DOUBLE) / 32 AS left_leakage",
    f"{_K} % 61 = 0 AS swapped", f"CASE WHEN {_K} % 67 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS left_energy", "CAST(1 AS DOUBLE) AS right_energy",
    f"CAST({_K} % 31 AS DOUBLE) / 64 AS overlap_ratio", f"CASE WHEN {_K} % 5 = 0 THEN CAST({_K} % 129 AS DOUBLE) / 128 ELSE CAST(0 AS DOUBLE) END AS separation_coverage", f"{_K} % 15 = 0 AS separation_used",
    f"{_K} % 4 AS unaligned_words", f"{_K} % 40 AS low_confidence_words", f"{_K} % 25 AS uncertain_words", f"{_K} % 120 AS total_words", f"CASE WHEN {_K} % 13 = 0 THEN 2 ELSE 0 END AS suspect_segments",
    f"CASE WHEN {_K} % 29 = 0 THEN 1 ELSE 0 END AS unresolved", f"CASE WHEN {_K} % 83 = 0 THEN 'wav_missing' WHEN {_K} % 89 = 0 THEN 'json_missing' WHEN {_K} % 101 = 0 THEN 'wav_unreadable' END AS problem",
]
_L = "l_orderkey + l_linenumber"
SIDECAR = [
    "CAST(l_orderkey AS BIGINT) AS clip_id", "l_linenumber AS pos", f"CASE WHEN ({_L}) % 97 = 0 THEN '' ELSE l_returnflag END AS word", f"CAST(l_linenumber * 3 + ({_L}) % 5 AS DOUBLE) / 4 - CASE WHEN l_orderkey % 211 = 0 THEN 9 ELSE 0 END AS start_s",
    f"CAST(l_linenumber * 3 + ({_L}) % 5 AS DOUBLE) / 4 + CASE WHEN ({_L}) % 37 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / 2 END AS end_s", "CASE WHEN l_orderkey % 301 = 0 THEN 'OTHER' ELSE 'SPEAKER_MAIN' END AS speaker",
]
SIDE_LEN = f"CAST(2 + {_K} % 7 AS DOUBLE) AS duration"
STATUS = f"CASE WHEN {_K} % 3 = 0 THEN 'PASS' WHEN {_K} % 3 = 1 THEN 'REVIEW' ELSE 'REJECT' END"
REPORT = [f"CAST(o_custkey % 200 AS BIGINT) AS source", f"CAST({_K} AS BIGINT) AS pos", f"CAST({_K} % 977 AS BIGINT) AS clip_no", f"{STATUS} AS status", "o_custkey % 17 = 0 AS unreadable"]
WAV = ["CAST(p_partkey AS BIGINT) AS clip_no", "CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 2 END AS channels", "CASE WHEN p_partkey % 23 = 0 THEN 16000 ELSE 24000 END AS sample_rate", "CAST(p_partkey % 100 * 12000 AS BIGINT) AS samples", "p_partkey % 7 <> 0 AS valid", "p_partkey % 2 = 0 AS approved"]


def _clips(spark, sf):
    return D.table(spark, sf, "orders").selectExpr(*CLIP)


def _words(reasons):
    return F.array_join(reasons, ",")


# ---------------------------------------------------------------- verdicts and gates
def q1_sidecars(spark, sf):
    out = C.sidecar_problems(D.table(spark, sf, "lineitem").selectExpr(*SIDECAR), D.table(spark, sf, "orders").selectExpr("CAST(o_orderkey AS BIGINT) AS clip_id", SIDE_LEN))
    return out.select("clip_id", _words("reasons").alias("reasons"))


def _verdicts(spark, sf):
    clips = _clips(spark, sf).withColumn("sidecar_reasons", F.when(F.col("clip_id") % 71 == 0, F.array(F.lit("json_unreadable"))).when(F.col("clip_id") % 73 == 0, F.array(F.lit("unexpected_alignment_speaker"))))
    return C.clip_verdicts(clips)


def q2_verdicts(spark, sf):
    return _verdicts(spark, sf).select("clip_id", "status", _words("reasons").alias("reasons"))


def q4_merged(spark, sf):
    """Verdicts and figures of clips with those of their plans; of some clips one side has no figures, of some others the clip's figure is null."""
    planned = D.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS BIGINT) AS clip_id", f"{STATUS} AS status", f"CASE WHEN {_K} % 3 = 0 THEN array() WHEN {_K} % 3 = 1 THEN array('overlap_separation_required') ELSE array('excessive_silence', 'unaligned_words_present') END AS reasons",
        f"CASE WHEN {_K} % 5 <> 0 THEN map('overlap_ratio', CAST({_K} % 8 AS DOUBLE) / 8, 'silence_ratio', CAST({_K} % 4 AS DOUBLE) / 4) END AS metrics",
    )
    clips = _verdicts(spark, sf).withColumn("metrics", F.expr("CASE WHEN clip_id % 7 <> 0 THEN map('overlap_ratio', CASE WHEN clip_id % 11 <> 0 THEN overlap_ratio END, 'duration', duration) END"))
    out = C.merge_verdicts(planned, clips)
    said = F.array_join(F.array_sort(F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.format_string("%.6f", e["value"]), F.lit("null"))))), ",")
    return out.select("clip_id", "status", _words("reasons").alias("reasons"), said.alias("metrics"))


def q5_empty(spark, sf):
    clips = _verdicts(spark, sf).withColumn("n_alignments", F.col("total_words"))
    return C.reject_empty(clips).select("clip_id", "status", _words("reasons").alias("reasons"))


def q3_report_problems(spark, sf):
    rows = D.table(spark, sf, "orders").selectExpr(f"CASE WHEN {_K} % 50 <> 0 THEN CAST({_K} AS BIGINT) END AS clip_id", f"CASE WHEN {_K} % 51 = 0 THEN 'DONE' WHEN {_K} % 53 <> 0 THEN {STATUS} END AS status", f"CASE WHEN {_K} % 59 <> 0 THEN array('x') END AS reasons")
    return R.qc_report_problems(rows).groupBy("problem").agg(F.count("*").alias("n"))


def q7_blockers(spark, sf):
    u = _utterances(spark, sf).withColumn("quality_flags", F.when(F.col("id") % 11 == 0, F.array(F.lit("repeated_ngram"))).otherwise(F.array().cast("array<string>"))).withColumn("alignment_status", F.when(F.col("id") % 31 == 0, "unaligned").otherwise("aligned"))
    clips = u.where("decision = 'approve'").select("source_id", S, E)
    who = u.select("source_id").distinct().withColumn("assistant", F.when(F.col("source_id") != "src2", "A"))
    return C.transcript_blockers(u.drop("assistant"), clips, who)


def q9_approvals(spark, sf):
    statuses, asked = _index(spark, sf), D.table(spark, sf, "part").selectExpr("concat('data_stereo/', p_partkey, '.wav') AS path", "p_partkey % 3 AS r")
    ok, refused = R.approvals(statuses, asked.where("r = 1").select("path"), asked.where("r = 0").select("path"))
    return ok.select("path", F.lit("approved").alias("result")).unionByName(refused.select("path", F.lit("refused").alias("result")))


def q10_summary(spark, sf):
    """Customers as sources of nations; orders are clips; finished ones of some customers are golden."""
    src = X.split_sources(D.table(spark, sf, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("source_id")))
    clips = src.join(D.table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), "o_orderstatus"), "source_id")
    golden = clips.where("o_orderstatus = 'F' and source_id % 19 = 0").select("project_id")
    out = R.export_summary(clips.withColumn("source_id", F.format_string("c%06d", "source_id")), golden)
    return out.withColumn("train_sources", F.sha2("train_sources", 256))


def g12_preconditions(spark, sf):
    rows = D.table(spark, sf, "customer").selectExpr("c_custkey AS source_id", "CASE WHEN c_custkey % 10 <> 0 THEN 'A' END AS assistant", "c_custkey % 9 <> 0 AS finalized", "c_custkey % 4 AS version", "CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 5 END AS plan_version", "c_custkey % 6 <> 0 AS feasible", "c_custkey % 7 AS n_words")
    return R.preconditions(rows)


# ---------------------------------------------------------------- scans and sinks
def _reports(spark, sf):
    """Reports as files of clips; the clips of some files are unreadable."""
    rows = D.table(spark, sf, "orders").selectExpr(*REPORT)
    clip = F.struct(F.concat(F.lit("data_stereo\\"), F.col("clip_no"), F.lit(".wav")).alias("path"), "status", "pos")
    files = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", clip.alias("c")))).alias("cs"), F.bool_and("unreadable").alias("lost"))
    return files.select(F.format_string("src%04d_qc.json", "source").alias("file"), F.when(~F.col("lost"), F.transform("cs", lambda x: x["c"])).alias("clips"))


def _index(spark, sf):
    return X.qc_index(_reports(spark, sf))


def s2_clip_sources(spark, sf):
    rows = D.table(spark, sf, "orders").selectExpr(*REPORT).select("clip_no", "source", "pos", F.regexp_replace(F.format_string("src%04d_qc", "source"), "_qc$", "").alias("key"))
    return R.last_of(rows.withColumn("clip_no", F.col("clip_no").cast("string")), "clip_no", ["source", "pos"]).select("clip_no", "key")


def _manifest(spark, sf):
    wavs = D.table(spark, sf, "part").selectExpr(*WAV).withColumn("path", F.concat(F.lit("data_stereo/"), F.col("clip_no"), F.lit(".wav")))
    return X.manifest_rows(wavs.select("path", "channels", "sample_rate", "samples"), _index(spark, sf), wavs.select("path", "valid"), wavs.where("approved").select("path"))


def s11_manifest(spark, sf):
    return X.jsonl(_manifest(spark, sf), ["path"])


def s12_rejected(spark, sf):
    rows = D.table(spark, sf, "orders").selectExpr(*REPORT).where("status = 'REJECT'")
    return X.jsonl(rows.select("source", F.col("pos").alias("clip_id"), "status"), ["source", "clip_id"])


def s13_sidecars(spark, sf):
    rows = D.table(spark, sf, "lineitem").selectExpr(*SIDECAR).withColumn("reason", F.when(F.col("word") == "", "empty_after_normalization"))
    return X.sidecar_json(rows)


def s15_golden(spark, sf):
    rows = _spoken(spark, sf).where("human_verified").where(F.trim("text") != "")
    rows = rows.select("source_id", (F.col("turn") * 1000).alias("start_sample"), "conv_id", F.sha2("text", 256).alias("text"), "speaker", "alignment_status")
    return X.jsonl(rows, ["source_id", "start_sample", "conv_id"])


def s4_result_words(spark, sf):
    """Words of nested results: a result a customer, a segment an order, a word a line."""
    lines = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("no"), F.concat(F.lit("  "), "l_returnflag", F.lit(" ")).alias("word"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("string")).alias("start"), (F.col("l_linenumber") + 1).cast("string").alias("end"), F.lit("A").alias("speaker"), F.lit(None).cast("string").alias("score")))).alias("words"))
    orders = D.table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    results = orders.groupBy(F.col("o_custkey").alias("source_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "words"))).alias("segments"))
    return R.result_words(results).groupBy("source_id").agg(F.count("*").alias("n"), F.count("start_s").alias("timed"), F.sum("start_s").alias("start_sum"), F.count_if(F.col("word") == "A").alias("air"))


# ---------------------------------------------------------------- projections
def p1_clamped(spark, sf):
    return R.clamp_bounds(D.event_spans(spark, sf), _cut(spark, sf)).select("source_id", "event_id", S, E)


def _cut(spark, sf):
    """A duration for most users, before their last events."""
    ends = D.event_spans(spark, sf).groupBy("source_id").agg(((F.min(S) + F.max(E)) / 2).cast("long").alias("duration"))
    return ends.withColumn("duration", F.when(F.col("source_id") % 5 == 0, 0).otherwise(F.col("duration")))


def p1_words(spark, sf):
    """Words with odd times, cut to conversations."""
    w = D.turn_words(spark, sf).withColumn("start_s", F.when(F.col("i") % 17 == 3, "nan").when(F.col("i") % 17 == 5, "soon").otherwise(F.expr("cast(start_sample / 24000.0D - 3 as string)")))
    w = w.withColumn("end_s", F.when(F.col("i") % 17 == 7, "Infinity").otherwise(F.expr("cast(end_sample / 24000.0D + 1 as string)")))
    out = R.clamp_words(w, D.durations(spark, sf))
    return out.groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.sum("start_s"), 6).alias("starts"), F.round(F.sum("end_s"), 6).alias("ends"))


def p2_clock(spark, sf):
    x = D.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "(CAST(l_orderkey % 100003 AS DOUBLE) - 5) / 48000 AS s")
    return x.select("l_orderkey", "l_linenumber", T.samples(F.col("s")).alias("samples"), T.seconds(T.samples(F.col("s"))).alias("seconds"))


def p4_labels(spark, sf):
    raw = D.event_spans(spark, sf).withColumn("speaker", F.when(F.col("source_id") % 9 == 0, F.lit("S2")).when(F.col("speaker") == "A", F.lit("SPEAKER_07")).otherwise(F.lit("SPEAKER_03")))
    return A.map_labels(raw).select("source_id", "event_id", "detected", "speaker")


def p5_utterances(spark, sf):
    t = D.turns(spark, sf).select("source_id", "turn", (F.col(S) / 24000).alias("start_s"), (F.when(F.col("turn") % 8 == 0, F.col(S)).otherwise(F.col(E)) / 24000).alias("end_s"), F.col("role").alias("text"), F.when(F.col("turn") % 3 == 0, F.lit("user")).when(F.col("turn") % 3 == 1, F.lit("  ")).alias("retry_text"))
    return R.raw_utterances(t, D.activities(spark, sf), ["source_id"], ["turn"])


def p6_corrected(spark, sf):
    rows = D.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 13 = 0 THEN 'later' ELSE CAST(l_linenumber - 2 AS STRING) END AS start", "CAST(l_linenumber % 5 AS STRING) AS end", "CASE WHEN l_orderkey % 7 = 0 THEN '  ' ELSE l_returnflag END AS text")
    clean, bad = R.corrected_segments(rows)
    return clean.select("l_orderkey", "l_linenumber", F.lit("clean").alias("result")).unionByName(bad.select("l_orderkey", "l_linenumber", F.col("problem").alias("result")))


def p9_words(spark, sf):
    """Words of Latin script with a low or no score, and words without times, by conversation."""
    w = D.turn_words(spark, sf).withColumn("score", F.when(F.col("i") % 9 != 0, F.col("score"))).withColumn(S, F.when(F.col("i") % 10 != 4, F.col(S)))
    return w.groupBy("source_id").agg(F.count_if(T.latin(F.col("word")) & (F.col("score").isNull() | (F.col("score") < 0.4))).alias("low_latin"), F.count_if(F.col(S).isNull() | F.col(E).isNull()).alias("unaligned"))


def p13_keys(spark, sf):
    url = F.col("url")
    return D.table(spark, sf, "pages").select("page_id", T.media_key(url).alias("media_key"), T.safe_filename(url).alias("file_name"), T.slug(url).alias("slug"))


def p15_short_turns(spark, sf):
    return D.event_spans(spark, sf).where(F.col(E) - F.col(S) < 8400).select("source_id", "event_id", S, E)


def p16_assistants(spark, sf):
    labels = D.event_spans(spark, sf).select("source_id", "speaker").distinct()
    users = labels.select("source_id").distinct()
    explicit = users.where("source_id % 3 = 0").select("source_id", F.when(F.col("source_id") % 2 == 0, "A").otherwise("C").alias("speaker"))
    return A.choose_assistant(labels, explicit, users.where("source_id % 4 <> 1").withColumn("speaker", F.lit("B")))


def p17_relabelled(spark, sf):
    """Plans for separation; rendered are those that are not rejected."""
    plans = D.table(spark, sf, "orders").selectExpr("o_orderkey", f"{STATUS} AS status", f"CASE WHEN {_K} % 3 <> 2 THEN array() WHEN {_K} % 2 = 0 THEN array('excessive_overlap') ELSE array('excessive_overlap', 'excessive_silence') END AS reasons")
    return R.relabel_plans(plans).where("status <> 'REJECT'").select("o_orderkey", "status", _words("reasons").alias("reasons"))


def p18_provenance(spark, sf):
    src = X.split_sources(D.durations(spark, sf).select("source_id", F.expr("source_id div 25").alias("project_id")))
    return R.provenance(src.select("source_id", "split"), D.activities(spark, sf).where("turn < 2"))


def p19_manifest_problems(spark, sf):
    rows = D.table(spark, sf, "part").selectExpr(r"CASE WHEN p_partkey % 5 = 0 THEN concat('a', char(92), p_partkey, '.wav') WHEN p_partkey % 7 = 0 THEN concat(p_partkey, '.mp3') ELSE concat(p_partkey, '.wav') END AS path", "CAST(p_partkey % 11 AS DOUBLE) AS duration")
    return R.manifest_problems(rows)


def p20_signatures(spark, sf):
    u = D.turns(spark, sf).select("source_id", F.col("turn").alias("id"), "speaker", S, E, F.col("role").alias("text"))
    return R.signature(u)


# ---------------------------------------------------------------- joins
def _lines(spark, sf):
    """Order lines by number; of lines of one number the smallest flag."""
    return D.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))


def _minutes(spark, sf):
    clips = D.durations(spark, sf).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(duration - 1) div 1440000"))).alias("clip_id"))
    return clips.select("source_id", "clip_id", (F.col("clip_id") * 1_440_000).alias(S), ((F.col("clip_id") + 1) * 1_440_000).alias(E))


def j12_suspicious(spark, sf):
    flags = F.array_compact(F.array(F.when(F.col("turn") % 3 == 0, F.lit("repeated_ngram")), F.when(F.col("turn") % 4 == 0, F.lit("low_average_log_probability"))))
    return R.suspicious_touching(_minutes(spark, sf), D.turns(spark, sf).select("source_id", S, E, flags.alias("quality_flags")))


def _recoveries(spark, sf):
    o = I.speaker_overlaps(D.activities(spark, sf))
    n = F.expr(f"{S} div 300")
    return o.select("source_id", S, E, (n % 2 + 1).alias("version"), F.when(n % 5 == 0, "failed").otherwise("recovered").alias("status"), F.when(n % 3 == 0, "reject").otherwise("approve").alias("decision"), (n % 7 != 0).alias("auditioned"))


def _versions(spark, sf):
    return D.durations(spark, sf).select("source_id", (F.col("source_id") % 2 + 1).alias("version"))


def j13_recoveries(spark, sf):
    return R.approved_recoveries(_minutes(spark, sf), _recoveries(spark, sf), _versions(spark, sf))


def j14_reset(spark, sf):
    new = _spoken(spark, sf).select("source_id", F.concat_ws("_", "conv_id", "turn").alias("id"), "speaker", (F.col("turn") * 10).alias(S), (F.col("turn") * 10 + 9).alias(E), "text", "human_verified", "turn", "conv_id")
    old = new.where("turn % 5 <> 4").withColumn("text", F.when(F.col("turn") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("speaker", F.when(F.col("conv_id") % 6 == 0, F.lit("B")).otherwise(F.col("speaker")))
    return A.reset_verified(old, new).select("source_id", "id", "human_verified")


def j15_corrections(spark, sf):
    seg = _lines(spark, sf).selectExpr("l_orderkey AS source_id", "l_linenumber", "CAST(l_linenumber % 4 AS DOUBLE) / 3 AS start", "CAST(l_linenumber AS DOUBLE) AS end", "l_returnflag AS text")
    old = seg.where("source_id % 2 = 0").select("source_id", (F.col("start") + 0.0001).alias("start"), "end", F.col("l_linenumber").alias("no"), F.concat(F.lit("old "), "text").alias("text"))
    new = seg.where("l_linenumber % 2 = 0").select("source_id", "start", "end", F.col("l_linenumber").alias("no"), F.concat(F.lit(" new "), "text").alias("text"))
    return R.overlay_corrections(seg, old, new).select("source_id", F.round("start", 3).alias("start"), "end", "text")


def j20_permutations(spark, sf):
    """Words whose detected labels follow from their places, one, two or three labels a conversation, against the turns at the words' middles."""
    w = D.turn_words(spark, sf)
    n = (F.col("i") + F.col("source_id")) % 3
    label = F.when(F.col("source_id") % 5 == 1, "A").when(F.col("source_id") % 5 == 2, F.concat(F.lit("S"), n)).when(n == 0, "SPEAKER_00").otherwise("SPEAKER_01")
    w = w.select("source_id", "turn", "i", S, F.when(F.col("i") % 6 != 5, F.col(E)).alias(E), F.when(F.col("i") % 7 != 6, label).alias("detected"))
    gold = D.activities(spark, sf).where("turn % 4 <> 3 OR source_id % 2 = 0")
    return R.best_permutation(R.gold_labels(w, gold, ["source_id"], ["turn", "i"], "turn"), gold, ["source_id"])


# ---------------------------------------------------------------- aggregates
def a7_run_totals(spark, sf):
    rows = D.table(spark, sf, "orders").selectExpr("CAST(o_custkey % 10 AS BIGINT) AS batch", "o_custkey AS file", f"CASE WHEN o_custkey % 12 <> 0 THEN {STATUS} END AS status")
    return R.run_totals(rows, ["batch"])


def a15_diarization(spark, sf):
    spans = D.event_spans(spark, sf)
    return R.diarization_report(spans, I.crowded_regions(spans, ["source_id"]))


def a16_acceptance(spark, sf):
    files = D.table(spark, sf, "customer").selectExpr("c_custkey AS file", "CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS unresolved", "CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 0 END AS speaker_errors", "c_custkey % 5 * 10 AS words", "CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 13 AS DOUBLE) / 4 END AS realtime", "CAST(c_custkey % 8 AS BIGINT) * 1000000000 AS gpu_bytes")
    clips = D.table(spark, sf, "orders").selectExpr("o_custkey AS file", f"{STATUS} AS status", f"CAST({_K} % 16 AS DOUBLE) / 16 AS a_share", f"CAST({_K} % 5 AS DOUBLE) / 5 AS b_share")
    return R.acceptance(files, clips)


def a17_profiles(spark, sf):
    runs = D.table(spark, sf, "customer").selectExpr("c_custkey AS media", "explode(array(struct('int8' AS profile, CAST(c_custkey % 16 AS DOUBLE) / 64 AS cer, CAST(1 AS DOUBLE) AS realtime, CAST(3 AS DOUBLE) AS gpu_gib), struct('float16' AS profile, CAST(c_custkey % 11 AS DOUBLE) / 64 AS cer, CAST(c_custkey % 5 AS DOUBLE) / 2 AS realtime, CAST(c_custkey % 7 AS DOUBLE) AS gpu_gib))) AS r").select("media", "r.*")
    return Q.profile_comparison(runs)


def a19_problems(spark, sf):
    act = D.activities(spark, sf).withColumn("id", F.format_string("a%d", F.when(F.col("turn") % 6 == 4, F.col("turn") - 1).otherwise(F.col("turn"))))
    ref = D.activities(spark, sf).where("turn % 4 = 1").withColumn("id", F.format_string("r%d", "turn"))
    exc = D.exclusions(spark, sf).withColumn("id", F.format_string("a%d", "turn"))
    utt = D.turns(spark, sf).withColumn("id", F.format_string("u%d", "turn"))
    cut = D.durations(spark, sf).withColumn("duration", F.expr("duration - 48000"))
    return C.annotation_problems(act, ref, exc, utt, cut)


def a22_coverage(spark, sf):
    """Recovered against expected overlap of each conversation, and how many regions there were and are recovered."""
    r = _recoveries(spark, sf)
    got = F.sum(F.when(F.col("status") == "recovered", F.col(E) - F.col(S)))
    per = r.groupBy("source_id").agg(F.count("*").alias("regions"), F.count_if(F.col("status") == "recovered").alias("recovered"), F.sum(F.col(E) - F.col(S)).alias("n"), F.coalesce(got, F.lit(0)).alias("g"))
    out = D.durations(spark, sf).select("source_id").join(per, "source_id", "left").na.fill(0)
    return out.select("source_id", "regions", "recovered", R.coverage(F.col("n"), F.col("g")).alias("coverage"))


def a25_candidates(spark, sf):
    seg = _lines(spark, sf).selectExpr("l_orderkey", "l_linenumber", "CAST(l_linenumber AS DOUBLE) AS start_s", "CAST(l_linenumber + l_linenumber % 3 AS DOUBLE) AS end_s", "CASE WHEN l_linenumber % 4 = 0 THEN ' ' ELSE concat(' ', l_returnflag) END AS text", "-CAST(l_linenumber AS DOUBLE) / 8 AS avg_logprob", "array_compact(array(CASE WHEN l_linenumber % 2 = 0 THEN 'repeated_ngram' END, CASE WHEN l_orderkey % 3 = 0 THEN 'decode_disagreement' END)) AS quality_flags")
    out = Q.candidate(seg, ["l_orderkey"], "l_linenumber")
    return out.select("l_orderkey", "text", _words("quality_flags").alias("flags"), F.round("avg_logprob", 9).alias("avg_logprob"))


def a26_runs(spark, sf):
    stages = D.table(spark, sf, "lineitem").selectExpr("l_orderkey AS file", "l_linenumber AS stage", "CAST(l_linenumber * (l_orderkey % 9) AS DOUBLE) / 8 AS elapsed", "(l_orderkey + l_linenumber) % 4 = 0 AS cache_hit")
    return R.stage_report(stages, D.table(spark, sf, "orders").selectExpr("o_orderkey AS file", "CAST(o_orderkey % 64 AS DOUBLE) AS media_s"))


# ---------------------------------------------------------------- windows, sets, state
def t5_ranges(spark, sf):
    return R.sample_ranges(D.event_spans(spark, sf))


def t8_words(spark, sf):
    """The place of each word in its conversation by (start, end), words without times last."""
    from pyspark.sql import Window

    w = D.turn_words(spark, sf).withColumn(S, F.when(F.col("i") % 10 != 4, F.col(S)))
    order = Window.partitionBy("source_id").orderBy(F.asc_nulls_last(S), F.asc_nulls_last(E), "turn", "i")
    return w.select("source_id", "turn", "i", F.row_number().over(order).alias("place"))


def w11_clip_ids(spark, sf):
    o = D.table(spark, sf, "orders")
    plans = o.groupBy(F.col("o_custkey").alias("source_id")).agg(F.count("*").alias("n")).select("source_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("clip_no"))
    before = plans.where("source_id % 3 = 0 and clip_no <= 4").withColumn("clip_id", F.format_string("conversation_%03d", F.col("source_id") * 5 + F.col("clip_no")))
    return R.legacy_clip_ids(plans, before, keeper(spark))


def w12_windows(spark, sf):
    spans = D.event_spans(spark, sf).select("source_id", S, E)
    clips = spans.groupBy("source_id").agg(F.min(S).alias(S), F.max(E).alias(E))
    return I.split_windows(spans, clips, ["source_id"], 3_600_000, 60_000, 12_000)


def u6_pairs(spark, sf):
    """Sources whose labels are exactly A and B."""
    per = D.activities(spark, sf).groupBy("source_id").agg(F.array_sort(F.collect_set("speaker")).alias("s"))
    return per.select("source_id", (F.col("s") == F.array(F.lit("A"), F.lit("B"))).alias("both"))


def f15_ids(spark, sf):
    o = I.speaker_overlaps(D.activities(spark, sf))
    return o.select("source_id", S, T.stable_id([F.col("source_id"), F.lit(1), F.col(S), F.col(E)], 16).alias("overlap_id"), T.stable_id([F.col("source_id"), F.col(S), F.col(E)], 12).alias("clip_hash"))


def f20_gap_cuts(spark, sf):
    return R.longest_gap_cut(D.activities(spark, sf).select("source_id", F.col(E).alias("pos")).distinct())


def r7_omitted(spark, sf):
    good = _recoveries(spark, sf).where("status = 'recovered'")
    return R.remaining_overlap(I.speaker_overlaps(D.activities(spark, sf)), good, _minutes(spark, sf))


def m2_cascade(spark, sf):
    """Orders of customers with a new revision lose their lines; a stale mark is set on the customers."""
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), "o_orderkey")
    return M.cascade({"decisions": o}, o.where("o_orderkey % 50 = 0").select("source_id"))["decisions"]


def m4_replace(spark, sf):
    o = D.table(spark, sf, "orders").selectExpr("o_custkey AS source_id", "CAST(o_orderkey AS BIGINT) AS child", "o_orderstatus AS status")
    new = o.where("source_id % 6 = 0 and status = 'F'").withColumn("status", F.lit("new"))
    return M.replace_children(o, new)


def m5_clamped(spark, sf):
    from pyspark.sql import Window

    rev = D.event_spans(spark, sf).withColumn("version", F.row_number().over(Window.partitionBy("source_id").orderBy("event_id")))
    return M.clamp_revisions(rev.select("source_id", "event_id", "version", S, E), _cut(spark, sf).where("duration > 0")).select("source_id", "event_id", "version", S, E)


QUERIES = {
    "Q1_sidecar_problems": q1_sidecars, "Q2_clip_verdicts": q2_verdicts, "Q3_report_problems": q3_report_problems, "Q4_merged_verdicts": q4_merged, "Q5_empty_alignment": q5_empty, "Q7_transcript_gate": q7_blockers,
    "Q9_approvals": q9_approvals, "Q10_export_summary": q10_summary, "G12_preconditions": g12_preconditions, "S1_qc_index": _index, "S2_clip_sources": s2_clip_sources, "S4_result_words": s4_result_words,
    "S11_manifest_jsonl": s11_manifest, "S12_rejected_jsonl": s12_rejected, "S13_sidecar_json": s13_sidecars, "S15_golden_jsonl": s15_golden, "J17_manifest_rows": _manifest, "P1_clamped_regions": p1_clamped,
    "P1_clamped_words": p1_words, "P2_sample_clock": p2_clock, "P4_mapped_labels": p4_labels, "P5_raw_utterances": p5_utterances, "P6_corrected_segments": p6_corrected, "P9_low_latin_words": p9_words,
    "P13_path_keys": p13_keys, "P15_short_turns": p15_short_turns, "P16_assistant_choice": p16_assistants, "P17_relabelled_plans": p17_relabelled, "P18_provenance": p18_provenance, "P19_manifest_problems": p19_manifest_problems,
    "P20_signatures": p20_signatures, "J12_suspicious_segments": j12_suspicious, "J13_approved_recoveries": j13_recoveries, "J14_reset_verified": j14_reset, "J15_overlaid_corrections": j15_corrections, "J20_label_permutation": j20_permutations,
    "A7_run_totals": a7_run_totals, "A15_diarization_report": a15_diarization, "A16_acceptance": a16_acceptance, "A17_profile_comparison": a17_profiles, "A19_annotation_problems": a19_problems, "A22_overlap_coverage": a22_coverage,
    "A25_candidates": a25_candidates, "A26_run_report": a26_runs, "T5_sample_ranges": t5_ranges, "T8_word_order": t8_words, "W11_clip_ids": w11_clip_ids, "W12_split_windows": w12_windows, "U6_label_guard": u6_pairs,
    "F15_stable_ids": f15_ids, "F20_longest_gap": f20_gap_cuts, "R7_omitted_overlap": r7_omitted, "M2_cascade": m2_cascade, "M4_replace_children": m4_replace, "M5_clamped_revisions": m5_clamped,
}

# ---------------------------------------------------------------- the same in SQL
_B = f"WITH {D.SQL}"
_CL = f"""c AS (SELECT {', '.join(CLIP)} FROM orders),
c2 AS (SELECT *, CASE WHEN clip_id % 71 = 0 THEN ['json_unreadable'] WHEN clip_id % 73 = 0 THEN ['unexpected_alignment_speaker'] ELSE [] END AS side,
  CASE WHEN total_words > 0 THEN low_confidence_words / total_words ELSE 0 END AS low, CASE WHEN total_words > 0 THEN uncertain_words / total_words ELSE 0 END AS unsure, greatest(left_clipping, right_clipping) AS clip,
  overlap_ratio * greatest(0, 1 - separation_coverage) AS rest, overlap_ratio > 0.20::DOUBLE AND separation_coverage < 0.95::DOUBLE AS inc, channels = 2 AS st FROM c),
c3 AS (SELECT *, list_filter([CASE WHEN NOT st THEN 'wav_not_stereo' END, CASE WHEN NOT st THEN 'channel_count_mismatch' END, CASE WHEN sample_rate <> 24000 THEN 'wrong_sample_rate' END, CASE WHEN duration <= 0 THEN 'invalid_duration' END,
  CASE WHEN st AND left_rms = 0 THEN 'left_channel_silent' END, CASE WHEN st AND right_rms = 0 THEN 'right_channel_silent' END, CASE WHEN st AND greatest(left_silence, right_silence) > 0.995::DOUBLE THEN 'channel_silence_ratio_above_reject_threshold' END,
  CASE WHEN st AND clip > 0.01::DOUBLE THEN 'clipping_ratio_above_reject_threshold' END, CASE WHEN inc THEN 'overlap_separation_incomplete' END, CASE WHEN NOT inc AND rest > 0.20::DOUBLE THEN 'overlap_ratio_above_reject_threshold' END,
  CASE WHEN low > 0.35::DOUBLE THEN 'low_confidence_ratio_above_reject_threshold' END, CASE WHEN unsure > 0.15::DOUBLE THEN 'uncertain_assignment_ratio_above_reject_threshold' END, CASE WHEN unresolved > 0 THEN 'unresolved_transcript_hallucination' END,
  CASE WHEN len(side) > 0 AND side[1] = 'json_unreadable' THEN side[1] END], lambda x: x IS NOT NULL) AS bad,
  list_filter([CASE WHEN st AND clip <= 0.01::DOUBLE AND clip > 0.001::DOUBLE THEN 'clipping_ratio_above_warning_threshold' END, CASE WHEN st AND right_leakage > 0.25::DOUBLE THEN 'possible_right_channel_leakage' END, CASE WHEN st AND left_leakage > 0.25::DOUBLE THEN 'possible_left_channel_leakage' END,
  CASE WHEN st AND swapped THEN 'possible_swapped_channels' END, CASE WHEN st AND left_energy < right_energy * 0.0001::DOUBLE THEN 'possible_swapped_or_missing_left_channel' END, CASE WHEN separation_used THEN 'separated_overlap_requires_review' END,
  CASE WHEN NOT inc AND rest <= 0.20::DOUBLE AND rest > 0.05::DOUBLE THEN 'overlap_ratio_above_warning_threshold' END, CASE WHEN unaligned_words > 0 THEN 'unaligned_words_present' END, CASE WHEN low <= 0.35::DOUBLE AND low > 0.10::DOUBLE THEN 'low_confidence_words_present' END,
  CASE WHEN unsure <= 0.15::DOUBLE AND unsure > 0.05::DOUBLE THEN 'uncertain_word_assignments_present' END, CASE WHEN suspect_segments > 0 THEN 'suspect_transcript_segments_present' END,
  CASE WHEN abs(duration - expected_duration) > 1 / 24000 + 1e-9 THEN 'transcript_to_audio_duration_inconsistency' END], lambda x: x IS NOT NULL) AS warn FROM c2),
vd AS (SELECT clip_id, total_words, CASE WHEN problem IS NOT NULL OR len(bad) > 0 THEN 'REJECT' WHEN len(warn) + len(side) > 0 THEN 'REVIEW' ELSE 'PASS' END AS status,
  CASE WHEN problem IS NOT NULL THEN [problem] ELSE list_sort(list_distinct(list_concat(list_concat(bad, side), warn))) END AS reasons FROM c3)"""
_REP = f"""rp AS (SELECT {', '.join(REPORT)} FROM orders), files AS (SELECT source, bool_and(unreadable) AS lost FROM rp GROUP BY 1),
ix AS (SELECT 'data_stereo/' || clip_no || '.wav' AS path, status FROM rp JOIN files USING (source) WHERE NOT lost QUALIFY row_number() OVER (PARTITION BY clip_no ORDER BY source DESC, pos DESC) = 1)"""
_MAN = f"""{_REP}, wv AS (SELECT {', '.join(WAV)}, 'data_stereo/' || p_partkey || '.wav' AS path FROM part),
mf AS (SELECT path, samples / sample_rate AS duration FROM wv JOIN ix USING (path) WHERE channels = 2 AND sample_rate = 24000 AND valid AND (status = 'PASS' OR status = 'REVIEW' AND approved))"""
_OVL = """mr0 AS (SELECT source_id, speaker, start_sample, end_sample, max(end_sample) OVER (PARTITION BY source_id, speaker ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM act WHERE end_sample > start_sample),
mr1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_sample > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, speaker ORDER BY start_sample, end_sample ROWS UNBOUNDED PRECEDING) AS isl FROM mr0),
mr AS (SELECT source_id, speaker, min(start_sample) AS s, max(end_sample) AS e FROM mr1 GROUP BY source_id, speaker, isl),
pq AS (SELECT a.source_id, greatest(a.s, b.s) AS start_sample, least(a.e, b.e) AS end_sample FROM mr a JOIN mr b ON a.source_id = b.source_id AND a.speaker = 'A' AND b.speaker = 'B' AND a.s < b.e AND b.s < a.e),
pq0 AS (SELECT *, max(end_sample) OVER (PARTITION BY source_id ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pq),
pq1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_sample > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_sample, end_sample ROWS UNBOUNDED PRECEDING) AS isl FROM pq0),
olp AS (SELECT source_id, min(start_sample) AS start_sample, max(end_sample) AS end_sample FROM pq1 GROUP BY source_id, isl)"""
_RCV = f"""{_OVL}, rc AS (SELECT *, start_sample // 300 % 2 + 1 AS version, CASE WHEN start_sample // 300 % 5 = 0 THEN 'failed' ELSE 'recovered' END AS status, CASE WHEN start_sample // 300 % 3 = 0 THEN 'reject' ELSE 'approve' END AS decision, start_sample // 300 % 7 <> 0 AS auditioned FROM olp)"""
_MIN = "mins AS (SELECT source_id, k AS clip_id, k * 1440000 AS c0, (k + 1) * 1440000 AS c1 FROM (SELECT source_id, unnest(range(0, (duration - 1) // 1440000 + 1)) AS k FROM dur))"
_CUTD = "ct AS (SELECT source_id, CASE WHEN source_id % 5 = 0 THEN 0 ELSE CAST(floor((min(start_sample) + max(end_sample)) / 2) AS BIGINT) END AS duration FROM sp0 GROUP BY 1)"
_SAFE = "coalesce(nullif(substring(trim(regexp_replace(trim({0}), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), 1, {1}), ''), '{2}')"
_SPK = """us AS (SELECT conv_id % 20 AS source_id, conv_id, turn, CASE role WHEN 'assistant' THEN 'A' WHEN 'user' THEN 'B' END AS speaker, text, (conv_id + turn) % 2 = 0 AS hv, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'unaligned' ELSE 'aligned' END AS st FROM conversations)"""
_LINES = "(SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)"
_JOINED = "array_to_string({0}, ',')"

ORACLES = {
    "Q1_sidecar_problems": f"""WITH s AS (SELECT {', '.join(SIDECAR)} FROM lineitem), o AS (SELECT CAST(o_orderkey AS BIGINT) AS clip_id, {SIDE_LEN} FROM orders),
j AS (SELECT o.clip_id, o.duration, pos, word, start_s, end_s, speaker, lag(start_s) OVER (PARTITION BY o.clip_id ORDER BY pos) AS before FROM o LEFT JOIN s USING (clip_id)),
g AS (SELECT clip_id, bool_or(word IS NULL OR word = '' OR start_s < 0 OR end_s <= 0 OR speaker <> 'SPEAKER_MAIN') AS b, bool_or(end_s > duration + 1e-6 OR start_s >= end_s) AS x, bool_or(start_s < before) AS u FROM j GROUP BY 1)
SELECT clip_id, CASE WHEN b THEN 'invalid_alignment_schema' ELSE array_to_string(list_filter([CASE WHEN x THEN 'alignment_timestamp_out_of_bounds' END, CASE WHEN u THEN 'alignment_timestamps_not_ordered' END], lambda v: v IS NOT NULL), ',') END AS reasons FROM g""",
    "Q2_clip_verdicts": f"WITH {_CL} SELECT clip_id, status, {_JOINED.format('reasons')} AS reasons FROM vd",
    "Q3_report_problems": f"""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN {_K} % 50 = 0 THEN 'no_clip_id' WHEN {_K} % 51 = 0 OR {_K} % 53 = 0 THEN 'bad_status' WHEN {_K} % 59 = 0 THEN 'no_reasons' END AS problem FROM orders) WHERE problem IS NOT NULL GROUP BY 1""",
    "Q4_merged_verdicts": f"""WITH {_CL}, pl AS (SELECT CAST({_K} AS BIGINT) AS clip_id, {STATUS} AS ps, CASE WHEN {_K} % 3 < 2 THEN [] ELSE ['excessive_silence', 'unaligned_words_present'] END AS pr FROM orders),
m AS (SELECT *, clip_id % 5 <> 0 AS p, clip_id % 7 <> 0 AS q FROM vd JOIN pl USING (clip_id) JOIN (SELECT clip_id, duration, overlap_ratio FROM c) USING (clip_id))
SELECT clip_id, CASE WHEN 'REJECT' IN (ps, status) THEN 'REJECT' WHEN 'REVIEW' IN (ps, status) THEN 'REVIEW' ELSE 'PASS' END AS status, {_JOINED.format('list_sort(list_distinct(list_concat(pr, reasons)))')} AS reasons,
  array_to_string(list_filter([CASE WHEN q THEN printf('duration=%.6f', duration) END, CASE WHEN q THEN CASE WHEN clip_id % 11 = 0 THEN 'overlap_ratio=null' ELSE printf('overlap_ratio=%.6f', overlap_ratio) END WHEN p THEN printf('overlap_ratio=%.6f', (clip_id % 8)::DOUBLE / 8) END,
    CASE WHEN p THEN printf('silence_ratio=%.6f', (clip_id % 4)::DOUBLE / 4) END], lambda v: v IS NOT NULL), ',') AS metrics FROM m""",
    "Q5_empty_alignment": f"""WITH {_CL} SELECT clip_id, CASE WHEN total_words = 0 THEN 'REJECT' ELSE status END AS status, {_JOINED.format("CASE WHEN total_words = 0 THEN list_sort(list_append(reasons, 'missing_assistant_alignment')) ELSE reasons END")} AS reasons FROM vd""",
    "Q7_transcript_gate": f"""WITH {_UTT}, me AS (SELECT *, id % 11 = 0 AND NOT hv AS risky, trim(text) = '' OR id % 31 = 0 AS weak FROM u WHERE speaker = 'A' AND source_id <> 'src2'),
ok AS (SELECT me.* FROM me WHERE EXISTS (SELECT 1 FROM u c WHERE c.source_id = me.source_id AND c.decision = 'approve' AND c.start_sample < me.start_sample + 900 AND me.start_sample < c.start_sample + 900)),
n AS (SELECT source_id, count(*) AS n, sum(weak::INT)::BIGINT AS weak, sum(risky::INT)::BIGINT AS risky FROM ok GROUP BY 1)
SELECT source_id, CASE WHEN source_id = 'src2' THEN 'assistant_not_chosen' WHEN coalesce(n, 0) = 0 THEN 'no_assistant_utterance' WHEN weak > 0 THEN 'unaligned_or_blank:' || weak WHEN risky > 0 THEN 'unverified_high_risk:' || risky END AS blocker
FROM (SELECT DISTINCT source_id FROM u) LEFT JOIN n USING (source_id)""",
    "Q9_approvals": f"""WITH {_REP} SELECT 'data_stereo/' || p_partkey || '.wav' AS path, CASE WHEN p_partkey % 3 = 1 OR status = 'REVIEW' THEN 'approved' ELSE 'refused' END AS result FROM part LEFT JOIN ix ON path = 'data_stereo/' || p_partkey || '.wav' WHERE p_partkey % 3 < 2""",
    "Q10_export_summary": """WITH x AS (SELECT c_nationkey AS project_id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(c_custkey::VARCHAR)) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
y AS (SELECT project_id, c_custkey, printf('c%06d', c_custkey) AS s, n >= 2 AND r <= greatest(1, least(n - 1, round_even(n * 0.10, 0))) AS ev, o_orderstatus FROM x JOIN orders ON o_custkey = c_custkey)
SELECT project_id, sha256(coalesce(string_agg(DISTINCT s, ',' ORDER BY s) FILTER (NOT ev), '')) AS train_sources, coalesce(string_agg(DISTINCT s, ',' ORDER BY s) FILTER (ev), '') AS eval_sources, count(*) FILTER (NOT ev) AS train_clips, count(*) FILTER (ev) AS eval_clips,
  count(*) FILTER (o_orderstatus = 'F' AND c_custkey % 19 = 0) AS golden, array_to_string(list_filter([CASE WHEN count(DISTINCT s) < 2 THEN 'single_source_split' END, CASE WHEN count(*) FILTER (o_orderstatus = 'F' AND c_custkey % 19 = 0) < 20 THEN 'small_golden_set' END], lambda v: v IS NOT NULL), ',') AS warnings FROM y GROUP BY 1""",
    "G12_preconditions": """SELECT c_custkey AS source_id, CASE WHEN c_custkey % 10 = 0 THEN 'no_assistant' WHEN c_custkey % 9 = 0 THEN 'activities_not_final' WHEN c_custkey % 8 = 0 OR c_custkey % 5 <> c_custkey % 4 THEN 'no_current_plan'
WHEN c_custkey % 6 = 0 THEN 'plan_infeasible' WHEN c_custkey % 7 = 0 THEN 'no_words' END AS problem FROM customer""",
    "S1_qc_index": f"WITH {_REP} SELECT path, status FROM ix",
    "S2_clip_sources": f"WITH {_REP} SELECT clip_no::VARCHAR AS clip_no, printf('src%04d', source) AS key FROM rp QUALIFY row_number() OVER (PARTITION BY clip_no ORDER BY source DESC, pos DESC) = 1",
    "S4_result_words": """SELECT o_custkey AS source_id, count(*) AS n, count(*) FILTER (l_linenumber % 3 <> 0) AS timed, sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber::DOUBLE END) AS start_sum, count(*) FILTER (trim(l_returnflag) = 'A') AS air
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "S11_manifest_jsonl": f"""WITH {_MAN} SELECT '{{"path":"' || path || '","duration":' || duration || '}}' AS value FROM mf""",
    "S12_rejected_jsonl": f"""WITH {_REP} SELECT '{{"source":' || source || ',"clip_id":' || pos || ',"status":"REJECT"}}' AS value FROM rp WHERE status = 'REJECT'""",
    "S13_sidecar_json": f"""WITH s AS (SELECT {', '.join(SIDECAR)} FROM lineitem) SELECT clip_id, '{{"alignments":[' || string_agg('["' || word || '",[' || start_s || ',' || end_s || '],"SPEAKER_MAIN"]', ',' ORDER BY start_s, end_s, word) || ']}}' AS value FROM s WHERE word <> '' GROUP BY 1""",
    "S15_golden_jsonl": f"""WITH {_SPK} SELECT '{{"source_id":' || source_id || ',"start_sample":' || turn * 1000 || ',"conv_id":' || conv_id || ',"text":"' || sha256(text) || CASE WHEN speaker IS NULL THEN '"' ELSE '","speaker":"' || speaker || '"' END || ',"alignment_status":"' || st || '"}}' AS value FROM us WHERE hv AND trim(text) <> ''""",
    "J17_manifest_rows": f"WITH {_MAN} SELECT path, duration FROM mf",
    "P1_clamped_regions": f"""{_B}, {_CUTD}, q AS (SELECT s.source_id, event_id, CASE WHEN duration > 0 THEN greatest(0, least(duration, start_sample)) ELSE start_sample END AS start_sample, CASE WHEN duration > 0 THEN greatest(0, least(duration, end_sample)) ELSE end_sample END AS end_sample, duration
FROM sp0 s JOIN ct USING (source_id)) SELECT source_id, event_id, start_sample, end_sample FROM q WHERE duration <= 0 OR end_sample > start_sample""",
    "P1_clamped_words": f"""{_B}, q AS (SELECT w.source_id, greatest(0, least(duration / 24000, start_sample / 24000 - 3)) AS s, greatest(0, least(duration / 24000, end_sample / 24000 + 1)) AS e FROM words w JOIN dur USING (source_id) WHERE i % 17 NOT IN (3, 5, 7))
SELECT source_id, count(*) AS n, round(sum(s), 6) AS starts, round(sum(e), 6) AS ends FROM q WHERE e > s GROUP BY 1""",
    "P2_sample_clock": """SELECT l_orderkey, l_linenumber, n AS samples, n / 24000 AS seconds FROM (SELECT l_orderkey, l_linenumber, CAST(greatest(0, round_even((CAST(l_orderkey % 100003 AS DOUBLE) - 5) / 48000 * 24000, 0)) AS BIGINT) AS n FROM lineitem)""",
    "P4_mapped_labels": f"""{_B}, r AS (SELECT source_id, event_id, CASE WHEN source_id % 9 = 0 THEN 'S2' WHEN speaker = 'A' THEN 'SPEAKER_07' ELSE 'SPEAKER_03' END AS detected FROM sp0), n AS (SELECT source_id, count(DISTINCT detected) AS n, min(detected) AS lo FROM r GROUP BY 1)
SELECT source_id, event_id, detected, CASE WHEN n = 2 THEN CASE WHEN detected = lo THEN 'A' ELSE 'B' END END AS speaker FROM r JOIN n USING (source_id)""",
    "P5_raw_utterances": f"""{_B}, t AS (SELECT source_id, turn, role, start_sample, end_sample FROM turns WHERE turn % 8 <> 0 AND end_sample > start_sample),
s AS (SELECT t.source_id, t.turn, a.speaker, sum(least(t.end_sample, a.end_sample) - greatest(t.start_sample, a.start_sample)) AS ov FROM t JOIN act a ON a.source_id = t.source_id AND t.start_sample < a.end_sample AND a.start_sample < t.end_sample GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source_id, turn ORDER BY ov DESC, speaker DESC) = 1)
SELECT t.source_id, t.turn, b.speaker, start_sample, end_sample, role AS text, role AS model_text, 'aligned' AS alignment_status, CASE WHEN t.turn % 3 = 0 AND role <> 'user' THEN 'user' END AS candidate FROM t LEFT JOIN b ON b.source_id = t.source_id AND b.turn = t.turn""",
    "P6_corrected_segments": """SELECT * FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 13 = 0 THEN 'needs_start_end_text' WHEN l_linenumber < 2 OR l_linenumber % 5 <= l_linenumber - 2 THEN 'invalid_timestamps' WHEN l_orderkey % 7 <> 0 THEN 'clean' END AS result FROM lineitem) WHERE result IS NOT NULL""",
    "P9_low_latin_words": f"""{_B} SELECT source_id, count(*) FILTER (regexp_matches(word, '[A-Za-z]') AND (i % 9 = 0 OR score < 0.4)) AS low_latin, count(*) FILTER (i % 10 = 4) AS unaligned FROM words GROUP BY 1""",
    "P13_path_keys": f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '([^/]*)/*$', 1) AS name FROM pages)
SELECT page_id, coalesce(nullif(trim(regexp_replace(CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_replace(name, '\\.[^.]+$', '') ELSE name END, '[^A-Za-z0-9_.\\-\\x{{0600}}-\\x{{06ff}}]+', '_', 'g'), '._'), ''), substring(sha256(url), 1, 12)) AS media_key,
{_SAFE.format('name', 180, 'media.bin')} AS file_name, {_SAFE.format('url', 80, 'dataset')} AS slug FROM p""",
    "P15_short_turns": f"{_B} SELECT source_id, event_id, start_sample, end_sample FROM sp0 WHERE end_sample - start_sample < 0.35 * 24000",
    "P16_assistant_choice": f"""{_B}, l AS (SELECT source_id, list(DISTINCT speaker) AS ls, CASE WHEN source_id % 6 = 0 THEN 'A' WHEN source_id % 3 = 0 THEN 'C' WHEN source_id % 4 <> 1 THEN 'B' END AS ch FROM sp0 GROUP BY 1)
SELECT source_id, CASE WHEN list_contains(ls, ch) THEN ch END AS assistant, CASE WHEN ch IS NULL THEN 'no_choice' WHEN NOT list_contains(ls, ch) THEN 'unknown_speaker' END AS problem FROM l""",
    "P17_relabelled_plans": f"""SELECT o_orderkey, CASE WHEN {_K} % 3 = 0 THEN 'PASS' ELSE 'REVIEW' END AS status, CASE WHEN {_K} % 3 = 2 THEN 'overlap_separation_required' ELSE '' END AS reasons FROM orders WHERE {_K} % 3 < 2 OR {_K} % 2 = 0""",
    "P18_provenance": f"""{_B}, x AS (SELECT source_id, row_number() OVER (PARTITION BY source_id // 25 ORDER BY sha256(source_id::VARCHAR)) AS r, count(*) OVER (PARTITION BY source_id // 25) AS n FROM dur),
f AS (SELECT source_id, string_agg(speaker || ':' || start_sample || ':' || end_sample, ',' ORDER BY start_sample, end_sample, speaker) AS refs FROM act WHERE turn < 2 GROUP BY 1)
SELECT source_id, CASE WHEN n >= 2 AND r <= greatest(1, least(n - 1, round_even(n * 0.10, 0))) THEN 'eval' ELSE 'train' END AS split, coalesce(refs, '') AS speaker_references FROM x LEFT JOIN f USING (source_id)""",
    "P19_manifest_problems": r"""SELECT CASE WHEN p_partkey % 5 = 0 THEN 'a' || chr(92) || p_partkey || '.wav' WHEN p_partkey % 7 = 0 THEN p_partkey || '.mp3' ELSE p_partkey || '.wav' END AS path, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'bad_path' ELSE 'bad_duration' END AS problem
FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0""",
    "P20_signatures": f"""{_B}, j AS (SELECT source_id, turn, sha256('{{"id":' || turn || ',"speaker":' || coalesce('"' || speaker || '"', 'null') || ',"start_sample":' || start_sample || ',"end_sample":' || end_sample || ',"text":"' || role || '"}}') AS d FROM turns)
SELECT source_id, sha256(string_agg(d, '' ORDER BY turn)) AS signature FROM j GROUP BY 1""",
    "J12_suspicious_segments": f"""{_B}, {_MIN} SELECT m.source_id, m.clip_id, count(*) FILTER (turn % 3 = 0 OR turn % 4 = 0) AS suspicious, count(*) FILTER (turn % 3 = 0) AS unresolved
FROM mins m LEFT JOIN turns t ON t.source_id = m.source_id AND start_sample < c1 AND c0 < end_sample GROUP BY 1, 2""",
    "J13_approved_recoveries": f"""{_B}, {_RCV}, {_MIN} SELECT m.source_id, m.clip_id, greatest(c0, start_sample) AS start_sample, least(c1, end_sample) AS end_sample FROM rc JOIN mins m ON m.source_id = rc.source_id AND start_sample < c1 AND c0 < end_sample
WHERE status = 'recovered' AND decision = 'approve' AND auditioned AND version = rc.source_id % 2 + 1""",
    "J14_reset_verified": f"""WITH {_SPK} SELECT source_id, conv_id || '_' || turn AS id, hv AND turn % 5 NOT IN (1, 4) AND NOT (conv_id % 6 = 0 AND speaker IS DISTINCT FROM 'B') AS human_verified FROM us""",
    "J15_overlaid_corrections": f"""WITH s AS (SELECT l_orderkey AS source_id, l_linenumber AS n, round(CAST(l_linenumber % 4 AS DOUBLE) / 3, 3) AS b, CAST(l_linenumber AS DOUBLE) AS e, l_returnflag AS t FROM {_LINES})
SELECT source_id, b AS start, e AS "end", CASE WHEN n % 2 = 0 THEN 'new ' || t WHEN source_id % 2 = 0 THEN 'old ' || t ELSE t END AS text FROM s""",
    "J20_label_permutation": f"""{_B}, gd AS (SELECT * FROM act WHERE turn % 4 <> 3 OR source_id % 2 = 0), gl AS (SELECT source_id, list_sort(list(DISTINCT speaker)) AS g FROM gd GROUP BY 1),
w AS (SELECT source_id, turn, i, CASE WHEN i % 7 = 6 THEN NULL WHEN source_id % 5 = 1 THEN 'A' WHEN source_id % 5 = 2 THEN 'S' || ((i + source_id) % 3) WHEN (i + source_id) % 3 = 0 THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS d,
  CASE WHEN i % 6 <> 5 THEN (start_sample + end_sample) // 2 END AS m FROM words),
dl AS (SELECT source_id, list_sort(list(DISTINCT d)) AS d FROM w WHERE d IS NOT NULL GROUP BY 1),
e AS (SELECT w.source_id, w.d, arg_min(gd.speaker, gd.turn) AS gold FROM w JOIN gd ON gd.source_id = w.source_id AND gd.start_sample <= m AND m < gd.end_sample WHERE w.d IS NOT NULL GROUP BY w.source_id, w.turn, w.i, w.d),
c AS (SELECT e.*, dl.d AS ds, g, len(dl.d) = 2 AND coalesce(len(g), 0) = 2 AS two FROM e JOIN dl USING (source_id) LEFT JOIN gl USING (source_id)),
x AS (SELECT source_id, bool_or(two) AS two, count(*) FILTER ((CASE WHEN NOT two THEN d WHEN d = ds[1] THEN g[1] ELSE g[2] END) <> gold) AS x, count(*) FILTER ((CASE WHEN d = ds[1] THEN g[2] ELSE g[1] END) <> gold) AS y, count(*) AS evaluated FROM c GROUP BY 1)
SELECT source_id, CASE WHEN NOT two THEN 'identity' WHEN x <= y THEN 'straight' ELSE 'crossed' END AS mapping, CASE WHEN two THEN least(x, y) ELSE x END AS errors, evaluated FROM x""",
    "A7_run_totals": f"""SELECT CAST(o_custkey % 10 AS BIGINT) AS batch, count(DISTINCT o_custkey) FILTER (o_custkey % 12 <> 0) AS processed, count(*) FILTER (o_custkey % 12 <> 0 AND {_K} % 3 = 0) AS accepted, count(*) FILTER (o_custkey % 12 <> 0 AND {_K} % 3 = 1) AS review,
count(*) FILTER (o_custkey % 12 <> 0 AND {_K} % 3 = 2) AS rejected, count(DISTINCT o_custkey) FILTER (o_custkey % 12 = 0) AS failed FROM orders GROUP BY 1""",
    "A15_diarization_report": f"""{_B}, m0 AS (SELECT *, max(end_sample) OVER (PARTITION BY source_id, speaker ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp0 WHERE end_sample > start_sample),
m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_sample > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, speaker ORDER BY start_sample, end_sample ROWS UNBOUNDED PRECEDING) AS isl FROM m0),
m AS (SELECT source_id, speaker, min(start_sample) AS s, max(end_sample) AS e FROM m1 GROUP BY source_id, speaker, isl),
q AS (SELECT a.source_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM m a JOIN m b ON a.source_id = b.source_id AND a.speaker < b.speaker AND a.s < b.e AND b.s < a.e),
q0 AS (SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q), q1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM q0),
q2 AS (SELECT source_id, min(s) AS s, max(e) AS e FROM q1 GROUP BY source_id, isl), o AS (SELECT source_id, count(*) AS r, CAST(sum(e - s) AS BIGINT) AS n FROM q2 GROUP BY 1)
SELECT p.source_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers, CAST(count(DISTINCT speaker) AS INTEGER) AS speaker_count, count(DISTINCT speaker) > 2 AS more_than_two, count(*) FILTER (end_sample - start_sample < 8400) AS short_turns,
coalesce(any_value(r), 0) AS overlap_regions, coalesce(any_value(n), 0) AS overlap_samples FROM sp0 p LEFT JOIN o ON o.source_id = p.source_id GROUP BY 1""",
    "A16_acceptance": f"""WITH k AS (SELECT o_custkey, count(*) FILTER ({_K} % 3 = 0) AS a, count(*) FILTER ({_K} % 3 = 0 AND least(({_K} % 16) / 16, ({_K} % 5) / 5) < 0.12) AS u FROM orders GROUP BY 1),
f AS (SELECT c_custkey AS file, c_custkey % 5 * 10 AS words, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 0 END AS se, coalesce(a, 0) AS accepted, coalesce(u, 0) AS unbalanced FROM customer LEFT JOIN k ON o_custkey = c_custkey)
SELECT file, accepted, unbalanced, CASE WHEN words > 0 THEN se / words END AS speaker_error_rate, file % 9 <> 0 AS no_hallucination, words = 0 OR se = 0 AS no_swaps, unbalanced = 0 AS balanced, file % 7 <> 0 AND (file % 13) / 4 <= 2 AS fast, (file % 8) * 1000000000::BIGINT <= 5905580032 AS small FROM f""",
    "A17_profile_comparison": """WITH r AS (SELECT c_custkey AS media, (c_custkey % 16) / 64 AS a, (c_custkey % 11) / 64 AS b FROM customer), g AS (SELECT media, CASE WHEN a = 0 THEN 0::DOUBLE ELSE (a - b) / a END AS cer_gain FROM r)
SELECT media, cer_gain, cer_gain >= 0.05 AND (media % 5) / 2 <= 2 AND media % 7 <= 5.5 AS eligible FROM g""",
    "A19_annotation_problems": f"""{_B}, a AS (SELECT source_id, 'a' || CASE WHEN turn % 6 = 4 THEN turn - 1 ELSE turn END AS id, speaker, start_sample AS s, end_sample AS e FROM act), r AS (SELECT source_id, 'r' || turn AS id, speaker, start_sample AS s, end_sample AS e FROM act WHERE turn % 4 = 1),
al AS (SELECT source_id, id, s, e, 'activity' AS kind, 0 AS k FROM a UNION ALL SELECT source_id, id, s, e, 'speaker_reference', 1 FROM r UNION ALL SELECT source_id, 'a' || turn, start_sample, end_sample, 'exclusion', 2 FROM exc UNION ALL SELECT source_id, 'u' || turn, start_sample, end_sample, 'utterance', 3 FROM turns),
m AS (SELECT source_id, speaker, sum(e - s) AS total FROM a GROUP BY 1, 2)
SELECT source_id, 'duplicate_' || kind || '_id:' || id AS problem FROM (SELECT *, row_number() OVER (PARTITION BY source_id, id ORDER BY k, s, e) AS n FROM al) WHERE n > 1
UNION ALL SELECT source_id, kind || '_outside_source:' || id FROM al JOIN dur USING (source_id) WHERE e > duration - 48000
UNION ALL SELECT source_id, 'same_speaker_regions_overlap:' || speaker FROM (SELECT DISTINCT x.source_id, x.speaker FROM (SELECT *, row_number() OVER () AS n FROM a) x JOIN (SELECT *, row_number() OVER () AS n FROM a) y ON x.source_id = y.source_id AND x.speaker = y.speaker AND x.n <> y.n AND x.s < y.e AND y.s < x.e)
UNION ALL SELECT source_id, 'multiple_speaker_references:' || speaker FROM r GROUP BY source_id, speaker HAVING count(*) > 1
UNION ALL SELECT source_id, CASE WHEN e - s < 36000 THEN 'speaker_reference_too_short:' ELSE 'speaker_reference_too_long:' END || id FROM r WHERE e - s < 36000 OR e - s > 360000""",
    "A22_overlap_coverage": f"""{_B}, {_RCV} SELECT d.source_id, count(rc.source_id) AS regions, count(*) FILTER (status = 'recovered') AS recovered,
CASE WHEN count(rc.source_id) = 0 THEN 0::DOUBLE ELSE least(1, coalesce(sum(end_sample - start_sample) FILTER (status = 'recovered'), 0) / sum(end_sample - start_sample)) END AS coverage FROM dur d LEFT JOIN rc ON rc.source_id = d.source_id GROUP BY 1""",
    "A25_candidates": f"""SELECT l_orderkey, coalesce(string_agg(l_returnflag, ' ' ORDER BY l_linenumber) FILTER (l_linenumber % 4 <> 0), '') AS text, array_to_string(list_filter([CASE WHEN l_orderkey % 3 = 0 THEN 'decode_disagreement' END, CASE WHEN bool_or(l_linenumber % 2 = 0) THEN 'repeated_ngram' END], lambda x: x IS NOT NULL), ',') AS flags,
round(sum(-l_linenumber / 8 * greatest(0.001::DOUBLE, (l_linenumber % 3)::DOUBLE)) / sum(greatest(0.001::DOUBLE, (l_linenumber % 3)::DOUBLE)), 9) AS avg_logprob FROM {_LINES} GROUP BY 1""",
    "A26_run_report": """WITH s AS (SELECT l_orderkey AS file, round(sum(CAST(l_linenumber * (l_orderkey % 9) AS DOUBLE) / 8), 3) AS total_s, count(*) FILTER ((l_orderkey + l_linenumber) % 4 = 0) AS cached FROM lineitem GROUP BY 1)
SELECT file, total_s, CASE WHEN o_orderkey % 64 > 0 THEN total_s / (o_orderkey % 64) END AS realtime_factor, cached FROM s JOIN orders ON o_orderkey = file""",
    "T5_sample_ranges": f"{_B} SELECT source_id, speaker, start_sample, end_sample, CAST(row_number() OVER (PARTITION BY source_id, speaker ORDER BY start_sample, end_sample) AS INTEGER) AS rank FROM sp0 QUALIFY rank <= 5",
    "T8_word_order": f"{_B} SELECT source_id, turn, CAST(i AS INTEGER) AS i, CAST(row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN i % 10 <> 4 THEN start_sample END NULLS LAST, end_sample, turn, i) AS INTEGER) AS place FROM words",
    "W11_clip_ids": """WITH p AS (SELECT o_custkey AS source_id, unnest(range(1, count(*) + 1)) AS clip_no FROM orders GROUP BY 1), b AS (SELECT source_id, clip_no, source_id * 5 + clip_no AS num FROM p WHERE source_id % 3 = 0 AND clip_no <= 4),
n AS (SELECT source_id, clip_no, (SELECT max(num) FROM b) + row_number() OVER (ORDER BY source_id, clip_no) AS num FROM p WHERE NOT (source_id % 3 = 0 AND clip_no <= 4))
SELECT source_id, CAST(clip_no AS INTEGER) AS clip_no, 'conversation_' || CASE WHEN num < 1000 THEN lpad(num::VARCHAR, 3, '0') ELSE num::VARCHAR END AS clip_id FROM (SELECT * FROM b UNION ALL SELECT * FROM n)""",
    "W12_split_windows": f"""{_B}, c AS (SELECT source_id, min(start_sample) AS c0, max(end_sample) AS c1 FROM sp0 GROUP BY 1), m0 AS (SELECT *, max(end_sample) OVER (PARTITION BY source_id ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp0 WHERE end_sample > start_sample),
m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_sample > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_sample, end_sample ROWS UNBOUNDED PRECEDING) AS isl FROM m0), m AS (SELECT source_id, min(start_sample) AS s, max(end_sample) AS e FROM m1 GROUP BY source_id, isl),
k AS (SELECT source_id, e, s + 3480000 * unnest(range(0, CAST(ceil((e - s) / 3480000) AS BIGINT))) AS a FROM m)
SELECT source_id, a AS core_start, least(e, a + 3480000) AS core_end, greatest(c0, a - 60000) AS window_start, least(c1, least(e, a + 3480000) + 60000) AS window_end FROM k JOIN c USING (source_id)""",
    "U6_label_guard": f"{_B} SELECT source_id, count(DISTINCT speaker) = 2 AS both FROM act GROUP BY 1",
    "F15_stable_ids": f"{_B}, {_OVL} SELECT source_id, start_sample, substring(sha256(source_id || ':1:' || start_sample || ':' || end_sample), 1, 16) AS overlap_id, substring(sha256(source_id || ':' || start_sample || ':' || end_sample), 1, 12) AS clip_hash FROM olp",
    "F20_longest_gap": f"""{_B}, p AS (SELECT DISTINCT source_id, end_sample AS pos FROM act), g AS (SELECT source_id, pos, lead(pos) OVER (PARTITION BY source_id ORDER BY pos) AS nx FROM p)
SELECT source_id, pos + (nx - pos) // 2 AS middle FROM g WHERE nx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY nx - pos DESC, pos) = 1""",
    "R7_omitted_overlap": f"""{_B}, {_RCV}, {_MIN} SELECT m.source_id, m.clip_id, CAST(coalesce(sum(least(c1, end_sample) - greatest(c0, start_sample)) FILTER (status = 'failed'), 0) AS BIGINT) AS omitted
FROM mins m LEFT JOIN rc ON rc.source_id = m.source_id AND start_sample < c1 AND c0 < end_sample GROUP BY 1, 2""",
    "M2_cascade": "SELECT o_custkey AS source_id, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)",
    "M4_replace_children": """WITH n AS (SELECT o_custkey AS source_id, CAST(o_orderkey AS BIGINT) AS child, 'new' AS status FROM orders WHERE o_custkey % 6 = 0 AND o_orderstatus = 'F')
SELECT o_custkey AS source_id, CAST(o_orderkey AS BIGINT) AS child, o_orderstatus AS status FROM orders WHERE o_custkey NOT IN (SELECT source_id FROM n) UNION ALL SELECT * FROM n""",
    "M5_clamped_revisions": f"""{_B}, {_CUTD}, l AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS version FROM sp0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY event_id DESC) = 1)
SELECT source_id, event_id, CAST(version + 1 AS INTEGER) AS version, greatest(0, least(duration, start_sample)) AS start_sample, greatest(0, least(duration, end_sample)) AS end_sample FROM l JOIN ct USING (source_id) WHERE duration > 0 AND (start_sample > duration OR end_sample > duration OR start_sample < 0 OR end_sample < 0)""",
}
