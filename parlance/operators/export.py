"""Manifests, sidecars, splits and versioned exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..settings import CLOCK
from .intervals import E, S, range_join
from .qc import SPEAKER


def split_sources(sources: DataFrame, project: str = "project_id", share: float = 0.10) -> DataFrame:
    """``split`` train or eval: sources in the order of sha256(id), the first max(1, min(n - 1, round(share n))) evaluate; a single source trains.

    Ranks are counted by the first three digits of the digest, so a large project is 4096 keys; only the
    counts of these meet by project.
    """
    df = sources.withColumn("__h", F.sha2(F.col("source_id").cast("string"), 256)).withColumn("__k", F.substring("__h", 1, 3))
    w = Window.partitionBy("__p")
    sizes = df.groupBy(F.col(project).alias("__p"), F.col("__k").alias("__q")).agg(F.count("*").alias("__c"))
    sizes = sizes.withColumn("__n", F.sum("__c").over(w)).withColumn("__before", F.sum("__c").over(w.orderBy("__q")) - F.col("__c"))
    df = df.join(sizes, F.col(project).eqNullSafe(F.col("__p")) & F.col("__k").eqNullSafe(F.col("__q")))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy(project, "__k").orderBy("__h"))
    count = F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.rint(F.col("__n") * share)))
    df = df.withColumn("__r", rank)
    return df.withColumn("split", F.when((F.col("__n") >= 2) & (F.col("__r") <= count), "eval").otherwise("train")).drop("__h", "__k", "__p", "__q", "__c", "__n", "__before", "__r")


def sidecar_rows(words: DataFrame, clips: DataFrame, normalized: bool = True) -> DataFrame:
    """(source_id, clip_id, word, start_s, end_s, reason): clip-relative words, or why a word is left out.

    Words without times are reported for every clip of their source.
    """
    timed = words.where(F.col(S).isNotNull() & F.col(E).isNotNull())
    met = range_join(clips.select("source_id", "clip_id", S, E), timed.select("source_id", "word", S, E), ["source_id"])
    crosses = (F.col("r_start") < F.col(S)) | (F.col("r_end") > F.col(E))
    rows = met.select("source_id", "clip_id", F.col("word").alias("raw"), ((F.col("r_start") - F.col(S)) / CLOCK).alias("start_s"), ((F.col("r_end") - F.col(S)) / CLOCK).alias("end_s"), crosses.alias("x"))
    loose = words.where(F.col(S).isNull() | F.col(E).isNull()).select("source_id", F.col("word").alias("raw"))
    loose = clips.select("source_id", "clip_id").join(loose, "source_id").select("source_id", "clip_id", "raw", F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), F.lit(False).alias("x"))
    both = rows.unionByName(loose)
    both = both.withColumn("word", normalize_text(F.col("raw")) if normalized else F.col("raw"))
    reason = F.when(F.col("start_s").isNull(), "unaligned").when(F.col("x"), "crosses_clip_boundary").when(F.col("word") == "", "empty_after_normalization").when(F.col("end_s") <= F.col("start_s"), "invalid_timestamp")
    return both.select("source_id", "clip_id", "word", "start_s", "end_s", reason.alias("reason"))


def sidecar_json(rows: DataFrame) -> DataFrame:
    """(clip_id, value): the sidecar text, words by (start, end)."""
    quoted = F.regexp_replace(F.to_json(F.array("word")), r"^\[|\]$", "")
    item = F.concat(F.lit("["), quoted, F.lit(",["), F.col("start_s").cast("string"), F.lit(","), F.col("end_s").cast("string"), F.lit(f'],"{SPEAKER}"]'))
    kept = rows.where("reason is null").groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "end_s", item.alias("j")))), lambda r: r["j"]).alias("items"))
    return kept.select("clip_id", F.concat(F.lit('{"alignments":['), F.array_join("items", ","), F.lit("]}")).alias("value"))


def qc_index(reports: DataFrame) -> DataFrame:
    """(path, status): of reports (file, clips array<struct<path, status>>) the last file and place win; unreadable files have null clips."""
    rows = reports.where("clips is not null").select("file", F.posexplode("clips").alias("pos", "c"))
    return rows.groupBy(F.replace(F.col("c.path"), F.lit("\\"), F.lit("/")).alias("path")).agg(F.max_by(F.col("c.status"), F.struct("file", "pos")).alias("status"))


def manifest_rows(wavs: DataFrame, statuses: DataFrame, sidecars: DataFrame, approvals: DataFrame, include_approved: bool = True) -> DataFrame:
    """(path, duration) of stereo 24 kHz clips with a valid sidecar that pass, or that are approved reviews."""
    df = wavs.where((F.col("channels") == 2) & (F.col("sample_rate") == CLOCK)).join(statuses, "path")
    df = df.join(sidecars.where("valid").select("path"), "path", "left_semi").join(approvals.select("path", F.lit(True).alias("approved")).distinct(), "path", "left")
    ok = (F.col("status") == "PASS") | ((F.col("status") == "REVIEW") & F.coalesce("approved", F.lit(False)) & F.lit(include_approved))
    return df.where(ok).select("path", (F.col("samples") / F.col("sample_rate")).alias("duration"))


def jsonl(df: DataFrame, order: list[str]) -> DataFrame:
    """One JSON text a row, in a global order by ranges, so that no single task holds all rows."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_export(tables: dict[str, DataFrame], folder: str, slug: str, version: int) -> str:
    """Writes each table as JSON lines under ``<slug>_v<version>``; an existing version is an error."""
    root = f"{folder}/{slug}_v{version:03d}"
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{root}/{name}")
    return root


def status_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Clips by status, zero where there is none."""
    return df.groupBy(*keys).pivot("status", ["PASS", "REVIEW", "REJECT"]).count().na.fill(0)
