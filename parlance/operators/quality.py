"""Transcript quality: summaries, dashboards, review queues, retry selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULT, Settings


def quality_summary(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_segments, n_suspicious, n_unresolved): flagged segments, and those with one of the two flags of invented text."""
    severe = F.arrays_overlap("quality_flags", F.array(F.lit("repeated_ngram"), F.lit("suspicious_character_sequence")))
    return segments.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.count_if(F.size("quality_flags") > 0).alias("n_suspicious"), F.count_if(severe).alias("n_unresolved"))


def recovery_approval(recoveries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, recovery_approval_rate) of recoveries (status, decision, auditioned): the share of recovered overlaps that were approved after they were heard; null without any."""
    back = F.col("status") == "recovered"
    good = (F.col("decision") == "approve") & F.coalesce("auditioned", F.lit(False))
    return recoveries.groupBy(*keys).agg(F.avg(F.when(back, F.coalesce(good, F.lit(False)).cast("double"))).alias("recovery_approval_rate"))


def dashboard(utterances: DataFrame, keys: list[str], recoveries: DataFrame | None = None) -> DataFrame:
    """Figures of each source from utterances (speaker, assistant, model_speaker, text, model_text, quality_flags, alignment_status, human_verified) and its recoveries."""
    high = F.arrays_overlap("quality_flags", F.array(*[F.lit(x) for x in T.HIGH_RISK]))
    mine = F.col("speaker").eqNullSafe(F.col("assistant"))
    worded = F.trim("text") != ""
    golden = F.col("human_verified") & worded
    both = golden & F.col("model_speaker").isNotNull() & F.col("speaker").isNotNull()
    rate = F.when(golden & (F.trim("model_text") != ""), T.character_error_rate(F.col("text"), F.col("model_text")))
    df = utterances.groupBy(*keys).agg(
        F.count("*").alias("utterances"), F.count_if(high).alias("flagged"), F.count_if(high & ~F.col("human_verified")).alias("unresolved"),
        F.count_if(high & ~F.col("human_verified") & mine).alias("assistant_unresolved"),
        F.count_if(mine & worded & (F.col("alignment_status") == "aligned")).alias("__al"), F.count_if(mine & worded).alias("__as"),
        F.count_if(golden).alias("golden"), F.avg(rate).alias("model_cer"),
        F.avg(F.when(both, (F.col("model_speaker") != F.col("speaker")).cast("double"))).alias("speaker_correction_rate"),
    )
    df = df.withColumn("assistant_alignment_coverage", F.when(F.col("__as") > 0, F.col("__al") / F.col("__as")).otherwise(0.0)).drop("__al", "__as")
    return df if recoveries is None else df.join(recovery_approval(recoveries, keys), keys, "left")


def review_queue(utterances: DataFrame) -> DataFrame:
    """Utterances with a positive priority, most urgent first, then by start."""
    p = T.review_priority(F.col("quality_flags"), F.col("speaker"), F.col("assistant"), F.col("alignment_status"), F.col("human_verified"))
    return utterances.withColumn("priority", p).where("priority > 0").orderBy(F.desc("priority"), "start_sample")


def select_decode(pairs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Rows (text, flags, logprob, retry_text, retry_flags, retry_logprob): the better decode, and a flag where the two disagree."""
    retry = T.quality_rank(F.col("retry_flags"), F.col("retry_logprob")) < T.quality_rank(F.col("flags"), F.col("logprob"))
    pick = lambda a, b: F.when(retry, F.col(b)).otherwise(F.col(a))
    df = pairs.withColumn("disagreement", T.disagreement(F.col("text"), F.col("retry_text")))
    flags = pick("flags", "retry_flags")
    out = F.when(F.col("disagreement") > s.max_disagreement, F.array_union(flags, F.array(F.lit("decode_disagreement")))).otherwise(flags)
    return df.withColumn("selected", F.when(retry, "retry").otherwise("initial")).withColumn("selected_text", pick("text", "retry_text")).withColumn("selected_flags", out)


def candidate(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One candidate of each key: texts in order, mean log probability, sorted union of flags."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim("text").alias("t"))))
    text = F.array_join(F.filter(F.transform(rows, lambda r: r["t"]), lambda t: t != ""), " ")
    body = segments.groupBy(*keys).agg(text.alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("quality_flags")))).alias("quality_flags"))
    return body.join(T.weighted_logprob(segments, keys), keys, "left")


def profile_comparison(runs: DataFrame) -> DataFrame:
    """(media, cer_gain, eligible) of runs (media, profile, cer, realtime, gpu_gib): gain at least 5 %, realtime up to 2, memory up to 5.5 GiB."""
    value = lambda p, c: F.max(F.when(F.col("profile") == p, F.col(c)))
    df = runs.groupBy("media").agg(value("int8", "cer").alias("base"), value("float16", "cer").alias("cer"), value("float16", "realtime").alias("rt"), value("float16", "gpu_gib").alias("gib"))
    gain = F.when(F.col("base") == 0, 0.0).otherwise((F.col("base") - F.col("cer")) / F.col("base"))
    return df.select("media", gain.alias("cer_gain"), ((gain >= 0.05) & (F.col("rt") <= 2.0) & (F.col("gib") <= 5.5)).alias("eligible"))
