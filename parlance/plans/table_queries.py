"""Queries of text quality, identity, state, gates, exports and sample blocks over the given tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audio as AU
from ..operators import export as X
from ..operators import identity as ID
from ..operators import qc as C
from ..operators import quality as Q
from ..operators import state as M
from ..shipping import BATCH_ROWS, map_arrow
from ..sources import driver_tables as D
from ..writing import keeper


def _segments(spark, sf):
    """Documents as transcript segments: the length in seconds and the log probability follow from the id."""
    d = D.table(spark, sf, "documents")
    return d.select(
        "doc_id", F.lit(0.0).alias("start_s"), (F.col("n_chars") / (1 + F.col("doc_id") % 60)).cast("double").alias("end_s"), "text",
        (-((F.col("doc_id") % 20) / 20.0)).alias("avg_logprob"), F.col("source"),
    )


def f3_tokens(spark, sf):
    toks = T.normalized_tokens(F.col("text"))
    return D.table(spark, sf, "documents").select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_distinct"))


def a18_max_ngrams(spark, sf):
    df = D.table(spark, sf, "documents").select("doc_id", T.normalized_tokens(F.col("text")).alias("t"))
    return df.select("doc_id", T.max_ngrams(F.col("t")).cast("long").alias("max_ngrams"))


def f5_segment_flags(spark, sf):
    return T.segment_flags(_segments(spark, sf)).select("doc_id", F.array_join("quality_flags", ",").alias("flags"))


def a4_quality_summary(spark, sf):
    return Q.quality_summary(T.segment_flags(_segments(spark, sf)), ["source"])


def a10_weighted_logprob(spark, sf):
    return T.weighted_logprob(_segments(spark, sf), ["source"]).withColumn("avg_logprob", F.round("avg_logprob", 9))


def t7_quality_rank(spark, sf):
    df = T.segment_flags(_segments(spark, sf)).withColumn("r", T.quality_rank(F.col("quality_flags"), F.col("avg_logprob")))
    return df.select("doc_id", F.col("r.weight").cast("long").alias("weight"), F.col("r.flags").cast("long").alias("n_flags"), F.col("r.penalty").alias("penalty"))


def t7_select_decode(spark, sf):
    """Each turn against the next turn's text as its second decode."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = D.table(spark, sf, "conversations").withColumn("retry_text", F.lead("text").over(w)).where("retry_text is not null")
    none = F.array().cast("array<string>")
    df = df.select("conv_id", "turn", "text", "retry_text", none.alias("flags"), none.alias("retry_flags"), F.lit(-0.6).alias("logprob"), (-(F.col("turn") % 10) / 10.0).alias("retry_logprob"))
    return Q.select_decode(df).select("conv_id", "turn", "selected", "disagreement", F.array_join("selected_flags", ",").alias("flags"))


def f1_normalized(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text"), drop_punctuation=True), 256).alias("digest"))


def f8_character_error_rate(spark, sf):
    """Every benchmark item against the item after it."""
    b = D.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("t"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("o"))
    return b.join(other, "item_id").select("item_id", T.character_error_rate(F.col("t"), F.col("o")).alias("cer"))


def a11_error_rates(spark, sf):
    b = D.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("t"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("o"))
    wer, cer = T.error_rates(F.col("o"), F.col("t"))
    return b.join(other, "item_id").select("item_id", wer.alias("wer"), cer.alias("cer"))


def _utterances(spark, sf):
    lab = D.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = D.table(spark, sf, "documents").join(lab, "doc_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("decode_disagreement")), F.when(F.col("doc_id") % 7 == 0, F.lit("repeated_ngram"))))
    return d.select(
        F.col("source").alias("source_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("doc_id") % 3 == 1, "B").alias("speaker"), F.lit("A").alias("assistant"),
        F.when(F.col("doc_id") % 5 < 3, "A").otherwise("B").alias("model_speaker"), "text", flags.alias("quality_flags"),
        F.when(F.col("doc_id") % 4 == 0, "unaligned").otherwise("aligned").alias("alignment_status"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("human_verified"),
        (F.col("doc_id") * 1000).alias("start_sample"), (F.col("doc_id") * 1000 + 900).alias("end_sample"), F.when(F.col("quality") == 1, "approve").when(F.col("quality") == 0, "reject").alias("decision"),
    )


def _spoken(spark, sf):
    """Turns of conversations as utterances of twenty sources; the model's text has lost some letters."""
    n = F.col("conv_id") + F.col("turn")
    flags = F.array_compact(F.array(F.when(n % 6 == 0, F.lit("decode_disagreement")), F.when(F.col("turn") % 7 == 0, F.lit("repeated_ngram"))))
    return D.table(spark, sf, "conversations").select(
        (F.col("conv_id") % 20).alias("source_id"), "conv_id", "turn", F.when(F.col("role") == "assistant", "A").when(F.col("role") == "user", "B").alias("speaker"), F.lit("A").alias("assistant"),
        F.when(F.col("turn") % 5 < 3, "A").otherwise("B").alias("model_speaker"), "text", F.regexp_replace("text", "(?i)th", "t").alias("model_text"), flags.alias("quality_flags"),
        F.when(n % 4 == 0, "unaligned").otherwise("aligned").alias("alignment_status"), (n % 2 == 0).alias("human_verified"),
    )


def a5_dashboard(spark, sf):
    recoveries = D.table(spark, sf, "conversations").selectExpr(
        "conv_id % 20 AS source_id", "CASE WHEN turn % 3 = 0 AND conv_id % 20 <> 7 THEN 'recovered' ELSE 'failed' END AS status",
        "CASE WHEN conv_id % 3 = 0 THEN 'approve' WHEN conv_id % 3 = 1 THEN 'reject' END AS decision", "CASE WHEN turn % 5 <> 0 THEN turn % 2 = 0 END AS auditioned",
    )
    return Q.dashboard(_spoken(spark, sf), ["source_id"], recoveries).withColumn("model_cer", F.round("model_cer", 9))


def t1_review_queue(spark, sf):
    return Q.review_queue(_utterances(spark, sf)).select("source_id", "id", "priority", "start_sample")


def q6_export_gate(spark, sf):
    """Sources of the documents as export candidates, through the whole ladder."""
    u = _utterances(spark, sf)
    per = u.groupBy("source_id").agg(
        F.count("*").alias("n_clips"), F.sum(F.when((F.col("id") % 500 == 3) & F.col("decision").isNull(), 1).otherwise(0)).alias("n_undecided"),
        F.count_if((F.col("id") % 911 == 5)).alias("n_pending_overlaps"), F.count_if(F.col("decision") == "approve").alias("n_approved"),
        F.count_if((F.col("decision") == "approve") & (F.col("id") % 997 == 1)).alias("n_approved_rejected"), F.count_if((F.col("id") % 300 == 7) & ~F.col("human_verified")).alias("risky"),
    )
    per = per.withColumn("stale", F.col("source_id") == "src3").withColumn("transcript_blocker", F.when(F.col("risky") > 0, F.format_string("unverified_high_risk:%d", F.col("risky")))).withColumn("rights_ok", F.col("source_id") != "src5")
    return C.export_gate(per).select("source_id", "n_clips", "n_undecided", "n_approved", "gate", "gate_reason")


def a20_readiness(spark, sf):
    g = q6_export_gate(spark, sf).withColumn("project_id", F.substring("source_id", 1, 4))
    return C.readiness(g)


def a20_messages(spark, sf):
    """Blockers and warnings of the gated sources; a project is the last two letters of a source's name, so that some have nothing that is ready."""
    g = q6_export_gate(spark, sf).withColumn("project_id", F.right("source_id", F.lit(2)))
    return C.gate_messages(g)


def q8_decisions(spark, sf):
    u = _utterances(spark, sf)
    clips = u.where("id % 10 <> 9").select(F.col("id").alias("clip_id"), F.when(F.col("id") % 6 == 0, "REJECT").otherwise("PASS").alias("status"))
    asked = u.where("decision is not null").select(F.col("id").alias("clip_id"), "decision", (F.col("id") % 2 == 0).alias("auditioned"))
    return C.decision_requests(asked, clips).select("clip_id", "decision", "refused")


def j16_undecided(spark, sf):
    return _utterances(spark, sf).where("decision is null").select("source_id", F.col("id").alias("clip_id"))


def j21_identity(spark, sf):
    """Two labels are the two voices of a source; vectors with an odd hash are references, the others detections."""
    v = D.table(spark, sf, "embeddings").where("embedding is not null").withColumn("source_id", F.expr("label div 2")).withColumn("odd", F.expr("(vec_id div 3) % 2"))
    keys = ["source_id", "label"]
    refs = ID.prototypes(v.where("odd = 1"), keys).select("source_id", F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("reference"), F.col("centroid").alias("r_vec"))
    det = ID.prototypes(v.where("odd = 0"), keys).select("source_id", F.format_string("SPEAKER_%02d", F.col("label") % 2).alias("detected"), F.col("centroid").alias("d_vec"))
    out = ID.choose_mapping(ID.similarities(det, refs, ["source_id"]), ["source_id"])
    return out.select("source_id", "first_to", "second_to", "status", F.round("similarity", 9).alias("similarity"), F.round("margin", 9).alias("margin"))


def f12_cosine(spark, sf):
    v = D.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("o")), 9).alias("cosine"))


def w10_enrolment(spark, sf):
    return ID.enrolment(D.activities(spark, sf), ["source_id", "speaker"], 720_000, 36_000).select("source_id", "speaker", "turn", "start_sample", "end_sample")


def _revisions(spark, sf):
    w = Window.partitionBy("source_id").orderBy("event_id")
    return D.event_spans(spark, sf).withColumn("version", F.row_number().over(w))


def w8_latest(spark, sf):
    return M.latest(_revisions(spark, sf)).select("source_id", "event_id", "version")


def m1_append(spark, sf):
    """Every tenth event asks to append a revision to the log; many expect what an earlier one of the batch makes current."""
    keep = keeper(spark)
    rev = keep(_revisions(spark, sf))
    top = rev.where("event_id % 10 <> 0").groupBy("source_id").agg(F.max("version").alias("top"))
    w = Window.partitionBy("source_id").orderBy("event_id")
    ask = rev.where("event_id % 10 = 0").withColumn("n", F.row_number().over(w) - 1).join(top, "source_id")
    ask = ask.select("source_id", F.col("event_id").alias("change_no"), (F.col("top") + F.col("n") - F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).cast("long").alias("expected_version"))
    kept, refused = M.append_revisions(rev.where("event_id % 10 <> 0"), ask, keep)
    return kept.select("source_id", "change_no", "version", F.lit("accepted").alias("result")).unionByName(refused.select("source_id", "change_no", F.col("current").alias("version"), F.lit("conflict").alias("result")))


def m3_upsert(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("decision"), F.col("o_totalprice").cast("double").alias("updated_at"))
    changes = o.where("id % 3 = 0").select("id", F.lit("X").alias("decision"), (F.col("updated_at") + F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)).alias("updated_at"))
    return M.upsert(o, changes, ["id"])


def m6_delete(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("child"), F.col("o_orderstatus").alias("status"))
    doomed = o.where("source_id % 5 = 0").select("source_id").distinct()
    return M.delete_sources({"orders": o}, doomed, o.where("status = 'O' and child % 2 = 0"))[0]["orders"]


def m8_patch(spark, sf):
    c = D.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    ch = c.where("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 8 == 0, F.concat("c_name", F.lit("-new"))).alias("c_name"), F.lit(None).cast(dict(c.dtypes)["c_nationkey"]).alias("c_nationkey"))
    return M.patch(c, ch, "c_custkey", ["c_name", "c_nationkey"])


def m8_headers(spark, sf):
    """Customers as headers: inserts (some of keys that exist, some without a name), updates (some of no key, some of fields that are not allowed), nulls that stay or not."""
    now = D.table(spark, sf, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS id", "c_name AS name", "'uploaded' AS status", "CAST(c_nationkey AS BIGINT) AS size", "c_mktsegment AS path")
    k = "CAST(o_orderkey AS BIGINT)"
    changes = D.table(spark, sf, "orders").selectExpr(
        f"{k} AS change_no", f"CASE WHEN {k} % 3 = 0 THEN 'insert' ELSE 'update' END AS op", f"CASE WHEN {k} % 3 = 0 THEN 1000000 + {k} % 500 WHEN {k} % 4 = 0 THEN 1000000 + {k} % 600 ELSE CAST(o_custkey AS BIGINT) END AS id",
        f"CASE WHEN {k} % 3 = 0 THEN map('name', CASE WHEN {k} % 11 = 0 THEN '  ' ELSE concat(' new ', {k}) END, 'size', CAST({k} AS STRING)) WHEN {k} % 7 = 0 THEN map('status', 'ready', 'owner', 'x') "
        f"ELSE map('status', CASE WHEN {k} % 5 <> 0 THEN o_orderstatus END, 'path', CASE WHEN {k} % 2 = 0 THEN concat('p', {k}) END) END AS values",
    )
    rows, said = M.merge_headers(now, changes, "id", ["name", "status", "size", "path"], {"status": "uploaded"}, named="name", sticky=("path",))
    left = rows.select(F.lit("row").alias("kind"), "id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("name", "status", "size", "path")]).alias("what"))
    return left.unionByName(said.where("refused IS NOT NULL").select(F.lit("refused").alias("kind"), F.col("change_no").alias("id"), F.col("refused").alias("what")))


def a8_projects(spark, sf):
    """Nations as projects, customers as sources: how many, and how many have a finished order."""
    n, c, o = (D.table(spark, sf, t) for t in ("nation", "customer", "orders"))
    done = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("ready", F.lit(1))
    src = c.select("c_custkey", "c_nationkey").join(done, "c_custkey", "left")
    return n.join(src, n.n_nationkey == src.c_nationkey, "left").groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("sources"), F.sum(F.coalesce("ready", F.lit(0))).alias("ready"))


def a9_next_version(spark, sf):
    return M.next_export_version(D.table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.expr("cast(o_orderkey % 17 as int)").alias("version")))


def a6_status_counts(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "P", "REVIEW").otherwise("REJECT")
    return X.status_counts(D.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("bucket"), status.alias("status")), ["bucket"])


def w9_split(spark, sf):
    c = D.table(spark, sf, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("source_id"))
    return X.split_sources(c)


def j11_sidecar_words(spark, sf):
    """Assistant words of minute-long clips: where they stand in the clip, or why they are left out."""
    t = keeper(spark)(D.turns(spark, sf))
    words = D.turn_words(spark, sf, t).join(D.activities(spark, sf, t).where("speaker = 'A'").select("source_id", "turn"), ["source_id", "turn"], "left_semi")
    clips = D.durations(spark, sf, t).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(duration - 1) div 1440000"))).alias("k"))
    clips = clips.select("source_id", F.format_string("%d_%d", "source_id", "k").alias("clip_id"), (F.col("k") * 1_440_000).alias("start_sample"), ((F.col("k") + 1) * 1_440_000).alias("end_sample"))
    rows = X.sidecar_rows(words.select("source_id", "word", "start_sample", "end_sample"), clips, normalized=False)
    return rows.groupBy("source_id", "clip_id", F.coalesce("reason", F.lit("kept")).alias("result")).agg(F.count("*").alias("n"), F.round(F.sum("start_s"), 3).alias("start_sum"))


def s14_train_manifest(spark, sf):
    """Manifest texts of the spoken turns as clips, split by source."""
    t = D.activities(spark, sf).select("source_id", F.format_string("clips/%d_%d.wav", "source_id", "turn").alias("path"), ((F.col("end_sample") - F.col("start_sample")) / 24000).alias("duration"))
    src = X.split_sources(t.select("source_id").distinct().withColumn("project_id", F.expr("source_id div 25")))
    return t.join(src.select("source_id", "split"), "source_id").select("split", "path", "duration")


def _values(spark, sf):
    """(clip_id, block_no, start_sample, v, event_id, event_type): the events of each user in order, one a block."""
    ev = D.table(spark, sf, "events").select(F.col("user_id").alias("clip_id"), "event_id", "event_type", (F.col("value") / 200).alias("v"))
    w = Window.partitionBy("clip_id").orderBy("event_id")
    ev = ev.withColumn("block_no", (F.row_number().over(w) - 1).cast("int"))
    return ev.select("clip_id", "block_no", (F.col("block_no") * 240).cast("long").alias("start_sample"), "v", "event_id", "event_type")


def _tones(values):
    """Blocks of 240 samples, left and right, of rows (clip_id, block_no, start_sample, v)."""
    steps = [((np.arange(240) * k) % 21 - 10) for k in (7, 5)]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                v = batch.column(3).to_numpy(zero_copy_only=False)[:, None]
                edges = pa.array(np.arange(0, 240 * batch.num_rows + 1, 240, dtype=np.int32))
                tones = [pa.ListArray.from_arrays(edges, pa.array(np.clip(v * step / 10, -1, 1).astype(np.float32).ravel())) for step in steps]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *tones], names=["clip_id", "block_no", "start_sample", "left", "right"])

    return map_arrow(values.select("clip_id", "block_no", "start_sample", "v"), run, f"clip_id {values.schema['clip_id'].dataType.simpleString()}, block_no int, start_sample long, left array<float>, right array<float>")


def _pcm(spark, sf):
    """Blocks of samples made of the event values of each user: 240 samples an event, left and right."""
    return _tones(_values(spark, sf))


def a12_channel_figures(spark, sf):
    df = AU.channel_figures(_pcm(spark, sf))
    return df.select("clip_id", *[F.round(c, 6).alias(c) for c in df.columns[1:] if "dbfs" not in c])


def a13_leakage(spark, sf):
    pcm = _pcm(spark, sf)
    mask = pcm.groupBy("clip_id").agg(F.max("start_sample").alias("m"))
    half = mask.select("clip_id", F.explode(F.array(F.struct(F.lit("assistant").alias("role"), F.lit(0).cast("long").alias("s"), F.expr("m div 2").alias("e")), F.struct(F.lit("user").alias("role"), F.expr("m div 2").alias("s"), F.col("m").alias("e")))).alias("x"))
    masks = half.select("clip_id", "x.role", F.col("x.s").alias("start_sample"), F.col("x.e").alias("end_sample")).where("end_sample > start_sample")
    out = AU.leakage(AU.masked_energy(pcm, masks))
    return out.select("clip_id", F.round("right_leakage", 6).alias("right_leakage"), F.round("left_leakage", 6).alias("left_leakage"), "swapped")


def a14_peaks(spark, sf):
    return AU.peaks(_pcm(spark, sf), points=50)


def a24_stereo_probe(spark, sf):
    return AU.stereo_probe(_pcm(spark, sf))


def r2_stereo_routing(spark, sf):
    """Mono blocks routed by turns that follow from the clip, with one muted stretch; sums of what is heard."""
    mono = _pcm(spark, sf).select("clip_id", "block_no", "start_sample", F.col("left").alias("samples"))
    end = mono.groupBy("clip_id").agg((F.max("start_sample") + 240).alias("n"))
    spans = end.select("clip_id", F.explode(F.array(F.struct(F.lit("A").alias("p"), F.lit(0).cast("long").alias("s"), F.expr("n * 6 div 10").alias("e")), F.struct(F.lit("B").alias("p"), F.expr("n * 5 div 10").alias("s"), F.col("n").alias("e")))).alias("x"))
    turns = spans.select("clip_id", F.col("x.p").alias("speaker"), F.col("x.s").alias("start_sample"), F.col("x.e").alias("end_sample"))
    both = end.select("clip_id", F.expr("n * 5 div 10").alias("start_sample"), F.expr("n * 6 div 10").alias("end_sample"))
    out = AU.route_stereo(mono, turns, both, fade=24)
    total = lambda c: F.sum(F.aggregate(F.transform(c, lambda v: F.abs(v).cast("double")), F.lit(0.0), lambda a, v: a + v))
    return out.groupBy("clip_id").agg(F.count("*").alias("blocks"), F.round(total("left"), 3).alias("left_sum"), F.round(total("right"), 3).alias("right_sum"))


QUERIES = {
    "F3_tokens": f3_tokens, "A18_max_ngrams": a18_max_ngrams, "F5_segment_flags": f5_segment_flags, "A4_quality_summary": a4_quality_summary, "A10_weighted_logprob": a10_weighted_logprob,
    "F6_quality_rank": t7_quality_rank, "T7_select_decode": t7_select_decode, "F1_normalize_text": f1_normalized, "F8_character_error_rate": f8_character_error_rate, "A11_error_rates": a11_error_rates,
    "A5_dashboard": a5_dashboard, "T1_review_queue": t1_review_queue, "Q6_export_gate": q6_export_gate, "A20_readiness": a20_readiness, "A20_messages": a20_messages, "Q8_decisions": q8_decisions, "J16_undecided": j16_undecided,
    "J21_identity": j21_identity, "F12_cosine": f12_cosine, "W10_enrolment": w10_enrolment, "W8_latest": w8_latest, "M1_append_revisions": m1_append, "M3_upsert": m3_upsert, "M6_delete_sources": m6_delete,
    "M8_patch": m8_patch, "M8_headers": m8_headers, "A8_projects": a8_projects, "A9_next_version": a9_next_version, "A6_status_counts": a6_status_counts, "W9_split": w9_split, "J11_sidecar_words": j11_sidecar_words,
    "S14_train_manifest": s14_train_manifest, "A12_channel_figures": a12_channel_figures, "A13_leakage": a13_leakage, "A14_peaks": a14_peaks, "A24_stereo_probe": a24_stereo_probe, "R2_stereo_routing": r2_stereo_routing,
}

_TOK = r"regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[\p{L}\p{N}_]+')"
_GRAMS = f"""g0 AS (SELECT doc_id, {_TOK} AS t FROM documents),
g1 AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || chr(1) || t[i + 1] || chr(1) || t[i + 2])) AS g FROM g0),
g2 AS (SELECT doc_id, max(c) AS m FROM (SELECT doc_id, g, count(*) AS c FROM g1 GROUP BY 1, 2) GROUP BY 1),
g3 AS (SELECT doc_id, len(t) AS n, coalesce(m, 0) AS m, len(list_filter(range(1, len(t) - 6), lambda i: len(list_filter(t[i:i+7], lambda x: len(x) <= 3 AND x[1] = t[i][1])) = 8)) > 0 AS odd FROM g0 LEFT JOIN g2 USING (doc_id))"""
_FLAGS = f"""{_GRAMS},
s AS (SELECT doc_id, source, n_chars / (1 + doc_id % 60)::DOUBLE AS e, -((doc_id % 20) / 20.0::DOUBLE) AS p, text FROM documents),
fl AS (SELECT doc_id, source, e, p, list_filter([CASE WHEN m > 3 THEN 'repeated_ngram' END, CASE WHEN odd OR regexp_matches(text, '\\p{{Cf}}') THEN 'suspicious_character_sequence' END, CASE WHEN p < -0.5 THEN 'low_average_log_probability' END,
  CASE WHEN n > 0 AND e > 0 AND n / e < 0.35 THEN 'abnormally_low_word_rate' END, CASE WHEN e = 0 OR n / e > 6.0 THEN 'abnormally_high_word_rate' END], lambda x: x IS NOT NULL) AS f FROM s JOIN g3 USING (doc_id))"""
_UTT = """l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
u AS (SELECT source AS source_id, d.doc_id AS id, CASE d.doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS speaker, CASE WHEN d.doc_id % 5 < 3 THEN 'A' ELSE 'B' END AS model_speaker,
  text,
  coalesce(toxic = 1, false) AS dd, d.doc_id % 7 = 0 AS rn, CASE WHEN d.doc_id % 4 = 0 THEN 'unaligned' ELSE 'aligned' END AS st, coalesce(quality = 1, false) AS hv, d.doc_id * 1000 AS start_sample,
  CASE quality WHEN 1 THEN 'approve' WHEN 0 THEN 'reject' END AS decision FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id)"""
# DuckDB's edit distance counts bytes, so the letters that the given texts have beyond ASCII become one byte each
_NORM = "trim(regexp_replace(translate(replace(lower({0}), 'ß', 'ss'), 'äçèéêíñóöü', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(14) || chr(15)), '\\s+', ' ', 'g'))"
_GATE = f"""{_UTT},
p AS (SELECT source_id, count(*) AS n_clips, sum(CASE WHEN id % 500 = 3 AND decision IS NULL THEN 1 ELSE 0 END) AS und, sum(CASE WHEN id % 911 = 5 THEN 1 ELSE 0 END) AS pend, sum(CASE WHEN decision = 'approve' THEN 1 ELSE 0 END) AS app,
  sum(CASE WHEN decision = 'approve' AND id % 997 = 1 THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN id % 300 = 7 AND NOT hv THEN 1 ELSE 0 END) AS risky FROM u GROUP BY 1),
gt AS (SELECT *, CASE WHEN source_id = 'src3' THEN 'no_current_clips' WHEN und > 0 THEN 'undecided_clips' WHEN pend > 0 THEN 'pending_overlaps' WHEN bad > 0 THEN 'rejected_clip_approved' WHEN app = 0 THEN 'no_approved_clips'
  WHEN risky > 0 THEN 'transcript' WHEN source_id = 'src5' THEN 'rights' END AS why FROM p),
gg AS (SELECT source_id, n_clips, CAST(und AS BIGINT) AS n_undecided, CAST(app AS BIGINT) AS n_approved, CASE WHEN why IS NULL THEN 'ready' WHEN why IN ('no_current_clips', 'no_approved_clips') THEN 'skipped' ELSE 'blocked' END AS gate, why AS gate_reason FROM gt)"""
_REV = f"WITH {D.SQL}, rev AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS version FROM sp0)"
_PCM = """WITH ev AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS b, value / 200 AS v FROM events),
pcm AS (SELECT clip_id, b * 240 + i AS pos, greatest(-1.0, least(1.0, v * (((i * 7) % 21) - 10) / 10))::FLOAT AS l, greatest(-1.0, least(1.0, v * (((i * 5) % 21) - 10) / 10))::FLOAT AS r FROM ev, range(0, 240) t(i))"""

_ID_SQL = """v AS (SELECT label // 2 AS source_id, label % 2 AS side, (vec_id // 3) % 2 AS odd, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL),
m AS (SELECT source_id, side, odd, i, avg(x::DOUBLE) AS m FROM v GROUP BY ALL),
s AS (SELECT d.source_id, d.side AS d, r.side AS r, sum(d.m * r.m) / (sqrt(sum(d.m * d.m)) * sqrt(sum(r.m * r.m))) AS c FROM m d JOIN m r ON d.source_id = r.source_id AND d.i = r.i AND d.odd = 0 AND r.odd = 1 GROUP BY 1, 2, 3),
w AS (SELECT source_id, max(c) FILTER (d = 0 AND r = 0) AS a, max(c) FILTER (d = 0 AND r = 1) AS b, max(c) FILTER (d = 1 AND r = 0) AS e, max(c) FILTER (d = 1 AND r = 1) AS f FROM s GROUP BY 1),
z AS (SELECT source_id, a + f >= b + e AS straight, least(CASE WHEN a + f >= b + e THEN a ELSE b END, CASE WHEN a + f >= b + e THEN f ELSE e END) AS low, CASE WHEN a + f >= b + e THEN least(a - b, f - e) ELSE least(b - a, e - f) END AS gap FROM w)"""

ORACLES = {
    "J21_identity": f"""WITH {_ID_SQL} SELECT source_id, CASE WHEN straight THEN 'A' ELSE 'B' END AS first_to, CASE WHEN straight THEN 'B' ELSE 'A' END AS second_to,
CASE WHEN low < 0.65 THEN 'low_similarity' WHEN gap < 0.10 THEN 'low_margin' ELSE 'matched' END AS status, round(low, 9) AS similarity, round(gap, 9) AS margin FROM z""",
    "F1_normalize_text": """WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS t, unnest(range(len(string_split_regex(text, '\\s+')))) AS i FROM documents),
n AS (SELECT doc_id, i, regexp_replace(translate(regexp_replace(nfkc_text, '[\\x{0610}-\\x{061a}\\x{064b}-\\x{065f}\\x{0670}\\x{06d6}-\\x{06dc}\\x{06df}-\\x{06e8}\\x{06ea}-\\x{06ed}]', '', 'g'), 'أإآٱ', 'اااا'), '[\\p{P}\\p{S}]', '', 'g') AS t FROM (SELECT doc_id, i, t AS nfkc_text FROM w))
SELECT d.doc_id, sha256(coalesce(string_agg(t, ' ' ORDER BY i) FILTER (t <> ''), '')) AS digest FROM documents d LEFT JOIN n USING (doc_id) WHERE text IS NOT NULL GROUP BY 1""",
    "A13_leakage": f"""{_PCM}, m AS (SELECT clip_id, max(pos) - 239 AS m FROM pcm GROUP BY 1),
g AS (SELECT clip_id, m, avg(l::DOUBLE * l) FILTER (pos < m // 2) AS al, avg(r::DOUBLE * r) FILTER (pos < m // 2) AS ar, avg(l::DOUBLE * l) FILTER (pos >= m // 2 AND pos < m) AS ul, avg(r::DOUBLE * r) FILTER (pos >= m // 2 AND pos < m) AS ur FROM pcm JOIN m USING (clip_id) GROUP BY 1, 2)
SELECT clip_id, round(coalesce(ar, 0) / (coalesce(al, 0) + 1e-12), 6) AS right_leakage, round(coalesce(ul, 0) / (coalesce(ur, 0) + 1e-12), 6) AS left_leakage,
  coalesce(ar, 0) > coalesce(al, 0) + 1e-12 AND coalesce(ul, 0) > coalesce(ur, 0) + 1e-12 AS swapped FROM g WHERE m > 0""",
    "A24_stereo_probe": f"""{_PCM}, g AS (SELECT clip_id, count(*) AS n, sum((l::DOUBLE - r) * (l::DOUBLE - r)) AS d, sum((l::DOUBLE + r) / 2 * ((l::DOUBLE + r) / 2)) AS p, max(greatest(abs(l), abs(r))) AS peak FROM pcm GROUP BY 1)
SELECT clip_id, d = 0 OR (p > 0 AND 20 * log10(sqrt(d / n)) - 20 * log10(sqrt(p / n)) <= -30) AS dual_mono, peak > 0 AND 20 * log10(CASE WHEN peak > 0 THEN peak::DOUBLE ELSE 1 END) >= -0.01 AS clipping FROM g""",
    "F3_tokens": f"WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM t",
    "A18_max_ngrams": f"WITH {_GRAMS} SELECT doc_id, m AS max_ngrams FROM g3",
    "F5_segment_flags": f"WITH {_FLAGS} SELECT doc_id, array_to_string(f, ',') AS flags FROM fl",
    "A4_quality_summary": f"""WITH {_FLAGS} SELECT source, count(*) AS n_segments, CAST(sum(CASE WHEN len(f) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_suspicious,
CAST(sum(CASE WHEN list_has_any(f, ['repeated_ngram', 'suspicious_character_sequence']) THEN 1 ELSE 0 END) AS BIGINT) AS n_unresolved FROM fl GROUP BY 1""",
    "A10_weighted_logprob": """WITH s AS (SELECT source, greatest(0.001::DOUBLE, n_chars / (1 + doc_id % 60)::DOUBLE) AS w, -((doc_id % 20) / 20.0::DOUBLE) AS p FROM documents)
SELECT source, round(sum(p * w) / sum(w), 9) AS avg_logprob FROM s GROUP BY 1""",
    "F6_quality_rank": f"""WITH {_FLAGS} SELECT doc_id, CAST(coalesce(list_sum(list_transform(f, lambda x: CASE x WHEN 'repeated_ngram' THEN 6 WHEN 'suspicious_character_sequence' THEN 6 WHEN 'abnormally_high_word_rate' THEN 4
WHEN 'abnormally_low_word_rate' THEN 3 WHEN 'low_average_log_probability' THEN 2 ELSE 1 END)), 0) AS BIGINT) AS weight, len(f) AS n_flags, -p AS penalty FROM fl""",
    "F8_character_error_rate": f"""WITH b AS (SELECT item_id, {_NORM.format("text")} AS t FROM benchmark)
SELECT a.item_id, CASE WHEN length(a.t) = 0 THEN CASE WHEN length(o.t) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(a.t, o.t) / length(a.t)::DOUBLE END AS cer FROM b a JOIN b o ON o.item_id = a.item_id + 1""",
    "A5_dashboard": f"""WITH u AS (SELECT conv_id % 20 AS source_id, CASE role WHEN 'assistant' THEN 'A' WHEN 'user' THEN 'B' END AS speaker, CASE WHEN turn % 5 < 3 THEN 'A' ELSE 'B' END AS model_speaker,
text, regexp_replace(text, 'th', 't', 'gi') AS model_text, (conv_id + turn) % 6 = 0 AS dd, turn % 7 = 0 AS rn, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'unaligned' ELSE 'aligned' END AS st, (conv_id + turn) % 2 = 0 AS hv,
CASE WHEN turn % 3 = 0 AND conv_id % 20 <> 7 THEN (conv_id % 3 = 0 AND turn % 5 <> 0 AND turn % 2 = 0)::INT END AS ok FROM conversations)
SELECT source_id, count(*) AS utterances, CAST(sum((dd OR rn)::INT) AS BIGINT) AS flagged, CAST(sum(((dd OR rn) AND NOT hv)::INT) AS BIGINT) AS unresolved,
CAST(sum(((dd OR rn) AND NOT hv AND speaker IS NOT DISTINCT FROM 'A')::INT) AS BIGINT) AS assistant_unresolved, CAST(sum((hv AND trim(text) <> '')::INT) AS BIGINT) AS golden,
round(avg(CASE WHEN hv AND trim(text) <> '' AND trim(model_text) <> '' THEN levenshtein({_NORM.format('text')}, {_NORM.format('model_text')}) / length({_NORM.format('text')})::DOUBLE END), 9) AS model_cer,
avg(CASE WHEN hv AND trim(text) <> '' AND speaker IS NOT NULL THEN (model_speaker <> speaker)::INT END) AS speaker_correction_rate,
CASE WHEN sum((speaker IS NOT DISTINCT FROM 'A' AND trim(text) <> '')::INT) > 0 THEN sum((speaker IS NOT DISTINCT FROM 'A' AND trim(text) <> '' AND st = 'aligned')::INT) / sum((speaker IS NOT DISTINCT FROM 'A' AND trim(text) <> '')::INT)::DOUBLE ELSE 0.0 END AS assistant_alignment_coverage,
avg(ok) AS recovery_approval_rate
FROM u GROUP BY 1""",
    "T1_review_queue": f"""WITH {_UTT}, q AS (SELECT source_id, id, start_sample, dd::INT * 55 + rn::INT * 90 + CASE WHEN speaker = 'A' THEN 20 ELSE 0 END + CASE WHEN st <> 'aligned' THEN 30 ELSE 0 END - hv::INT * 1000 AS priority FROM u)
SELECT source_id, id, priority, start_sample FROM q WHERE priority > 0""",
    "Q6_export_gate": f"WITH {_GATE} SELECT * FROM gg",
    "A20_messages": f"""WITH {_GATE}, prj AS (SELECT *, right(source_id, 2) AS project_id FROM gg)
SELECT project_id, CASE gate WHEN 'blocked' THEN 'blocker' ELSE 'warning' END AS kind, source_id AS label, source_id || ': ' || CASE gate_reason WHEN 'no_current_clips' THEN 'no current generated clips; source will be skipped'
  WHEN 'undecided_clips' THEN 'every generated clip needs a review decision' WHEN 'pending_overlaps' THEN 'every successfully recovered overlap needs an auditioned approve/reject decision'
  WHEN 'rejected_clip_approved' THEN 'rejected-QC clips cannot be approved' WHEN 'no_approved_clips' THEN 'no clips were approved; source will be skipped' WHEN 'rights' THEN 'source rights declaration is incomplete' ELSE 'transcript' END AS message
FROM prj WHERE gate <> 'ready'
UNION ALL SELECT project_id, 'blocker', NULL, 'No fully reviewed and approved clips are ready for export' FROM prj GROUP BY 1 HAVING count(*) FILTER (gate = 'ready') = 0""",
    "A20_readiness": f"""WITH {_GATE} SELECT substring(source_id, 1, 4) AS project_id, CAST(sum((gate = 'ready')::INT) AS BIGINT) AS ready_sources, CAST(sum((gate = 'blocked')::INT) AS BIGINT) AS blocked_sources,
CAST(coalesce(sum(CASE WHEN gate = 'ready' THEN n_approved END), 0) AS BIGINT) AS approved_clips, sum((gate = 'blocked')::INT) = 0 AND sum((gate = 'ready')::INT) > 0 AS valid FROM gg GROUP BY 1""",
    "Q8_decisions": f"""WITH {_UTT} SELECT id AS clip_id, decision, CASE WHEN id % 10 = 9 THEN 'unknown_clip' WHEN decision = 'approve' AND id % 2 <> 0 THEN 'not_auditioned' WHEN decision = 'approve' AND id % 6 = 0 THEN 'rejected_by_qc' END AS refused
FROM u WHERE decision IS NOT NULL""",
    "J16_undecided": f"WITH {_UTT} SELECT source_id, id AS clip_id FROM u WHERE decision IS NULL",
    "F12_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "W10_enrolment": f"""WITH {D.SQL}, p AS (SELECT *, coalesce(sum(end_sample - start_sample) OVER (PARTITION BY source_id, speaker ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
FROM act WHERE end_sample - start_sample >= 36000)
SELECT source_id, speaker, turn, start_sample, CAST(start_sample + least(end_sample - start_sample, 720000 - prior) AS BIGINT) AS end_sample FROM p WHERE prior < 720000""",
    "W8_latest": f"{_REV} SELECT source_id, event_id, CAST(version AS INTEGER) AS version FROM rev QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY version DESC) = 1",
    "M1_append_revisions": f"""{_REV.replace("WITH ", "WITH RECURSIVE ", 1)}, cur AS (SELECT source_id, CAST(max(version) AS BIGINT) AS top FROM rev WHERE event_id % 10 <> 0 GROUP BY 1),
a AS (SELECT source_id, event_id AS change_no, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS no, top, top + row_number() OVER (PARTITION BY source_id ORDER BY event_id) - 1 - CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS ev FROM rev JOIN cur USING (source_id) WHERE event_id % 10 = 0),
r(source_id, no, change_no, now, good) AS (SELECT source_id, no, change_no, top, ev = top FROM a WHERE no = 1
  UNION ALL SELECT a.source_id, a.no, a.change_no, r.now + CAST(r.good AS BIGINT), a.ev = r.now + CAST(r.good AS BIGINT) FROM r JOIN a ON a.source_id = r.source_id AND a.no = r.no + 1)
SELECT source_id, change_no, now + CAST(good AS BIGINT) AS version, CASE WHEN good THEN 'accepted' ELSE 'conflict' END AS result FROM r""",
    "M3_upsert": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS decision, o_totalprice::DOUBLE + CASE WHEN o_orderkey % 6 = 0 THEN 1.0 ELSE 0.0 END AS updated_at FROM orders""",
    "M6_delete_sources": """SELECT o_custkey AS source_id, o_orderkey AS child, o_orderstatus AS status FROM orders
WHERE o_custkey % 5 <> 0 OR o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0)""",
    "M8_headers": """WITH ch AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS ins, CASE WHEN o_orderkey % 3 = 0 THEN 1000000 + o_orderkey % 500 WHEN o_orderkey % 4 = 0 THEN 1000000 + o_orderkey % 600 ELSE o_custkey END AS id, o_orderstatus AS st FROM orders),
j AS (SELECT ch.*, c.c_custkey IS NOT NULL AS known, CASE WHEN ins AND k % 11 = 0 THEN 'blank_name' WHEN NOT ins AND k % 7 = 0 THEN 'unknown_fields:owner' END AS wrong FROM ch LEFT JOIN customer c ON c.c_custkey = ch.id),
b AS (SELECT *, min(CASE WHEN wrong IS NULL AND ins AND NOT known THEN k END) OVER (PARTITION BY id) AS born FROM j),
v AS (SELECT *, coalesce(wrong, CASE WHEN ins AND (known OR coalesce(born < k, false)) THEN 'exists' WHEN NOT ins AND NOT (known OR coalesce(born < k, false)) THEN 'unknown_key' END) AS refused FROM b),
ok AS (SELECT * FROM v WHERE refused IS NULL),
ups AS (SELECT id, count(*) AS n, arg_max(CASE WHEN k % 5 <> 0 THEN st ELSE '-' END, k) AS st FROM ok WHERE NOT ins GROUP BY 1),
pth AS (SELECT id, arg_max('p' || k, k) AS p FROM ok WHERE NOT ins AND k % 2 = 0 GROUP BY 1),
base AS (SELECT c_custkey AS id, c_name AS name, 'uploaded' AS status, c_nationkey AS size, c_mktsegment AS path FROM customer UNION ALL SELECT id, 'new ' || k, 'uploaded', k, NULL FROM ok WHERE ins)
SELECT 'row' AS kind, base.id, name || '|' || coalesce(ups.st, status) || '|' || size || '|' || coalesce(pth.p, path, '-') AS what FROM base LEFT JOIN ups USING (id) LEFT JOIN pth USING (id)
UNION ALL SELECT 'refused', k, refused FROM v WHERE refused IS NOT NULL""",
    "M8_patch": "SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN c_name || '-new' ELSE c_name END AS c_name, c_nationkey FROM customer",
    "A8_projects": """SELECT n_nationkey, n_name, count(c_custkey) AS sources, CAST(coalesce(sum(CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 1 ELSE 0 END), 0) AS BIGINT) AS ready
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "A9_next_version": "SELECT o_custkey AS project_id, CAST(coalesce(max(o_orderkey % 17), 0) + 1 AS INTEGER) AS next_version FROM orders GROUP BY 1",
    "A6_status_counts": """SELECT o_custkey % 50 AS bucket, count(*) FILTER (o_orderstatus = 'F') AS "PASS", count(*) FILTER (o_orderstatus = 'P') AS "REVIEW", count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS "REJECT" FROM orders GROUP BY 1""",
    "W9_split": """WITH x AS (SELECT c_nationkey AS project_id, c_custkey AS source_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(c_custkey::VARCHAR)) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT project_id, source_id, CASE WHEN n >= 2 AND r <= greatest(1, least(n - 1, round_even(n * 0.10, 0))) THEN 'eval' ELSE 'train' END AS split FROM x""",
    "J11_sidecar_words": f"""WITH {D.SQL}, w AS (SELECT w.* FROM words w JOIN act a ON a.source_id = w.source_id AND a.turn = w.turn WHERE a.speaker = 'A'),
c AS (SELECT source_id, k, k * 1440000 AS c0, (k + 1) * 1440000 AS c1 FROM (SELECT source_id, unnest(range(0, (duration - 1) // 1440000 + 1)) AS k FROM dur))
SELECT c.source_id, c.source_id || '_' || k AS clip_id, CASE WHEN start_sample < c0 OR end_sample > c1 THEN 'crosses_clip_boundary' ELSE 'kept' END AS result, count(*) AS n, round(sum((start_sample - c0) / 24000::DOUBLE), 3) AS start_sum
FROM c JOIN w ON w.source_id = c.source_id AND start_sample < c1 AND c0 < end_sample GROUP BY 1, 2, 3""",
    "S14_train_manifest": f"""WITH {D.SQL}, s AS (SELECT DISTINCT source_id FROM act), x AS (SELECT source_id, row_number() OVER (PARTITION BY source_id // 25 ORDER BY sha256(source_id::VARCHAR)) AS r, count(*) OVER (PARTITION BY source_id // 25) AS n FROM s)
SELECT CASE WHEN n >= 2 AND r <= greatest(1, least(n - 1, round_even(n * 0.10, 0))) THEN 'eval' ELSE 'train' END AS split, 'clips/' || source_id || '_' || turn || '.wav' AS path, (end_sample - start_sample) / 24000::DOUBLE AS duration FROM act JOIN x USING (source_id)""",
    "A12_channel_figures": f"""{_PCM} SELECT clip_id, round(sqrt(sum(l::DOUBLE * l) / count(*)), 6) AS left_rms, round(max(abs(l))::DOUBLE, 6) AS left_peak, round(sum((abs(l) >= 32767 / 32768.0::DOUBLE)::INT) / count(*)::DOUBLE, 6) AS left_clipping,
round(sum((abs(l) <= pow(10, -2.5))::INT) / count(*)::DOUBLE, 6) AS left_silence, round(sqrt(sum(r::DOUBLE * r) / count(*)), 6) AS right_rms, round(max(abs(r))::DOUBLE, 6) AS right_peak,
round(sum((abs(r) >= 32767 / 32768.0::DOUBLE)::INT) / count(*)::DOUBLE, 6) AS right_clipping, round(sum((abs(r) <= pow(10, -2.5))::INT) / count(*)::DOUBLE, 6) AS right_silence FROM pcm GROUP BY 1""",
    "A14_peaks": f"""{_PCM}, w AS (SELECT clip_id, greatest(1, ceil(count(*) / 50.0)) AS w FROM pcm GROUP BY 1)
SELECT clip_id, CAST(floor(pos / w) AS BIGINT) AS block, round(min(l)::DOUBLE, 6) AS low, round(max(l)::DOUBLE, 6) AS high FROM pcm JOIN w USING (clip_id) GROUP BY 1, 2""",
}
