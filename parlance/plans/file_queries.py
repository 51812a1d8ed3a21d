"""Queries that write files, scan them and read them back."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import functions as F

from ..operators import export as X
from ..operators import files as W
from ..settings import DEFAULT
from ..sources import driver_tables as D
from .record_queries import _MAN, _REP, REPORT, WAV
from ..writing import shared_folder

_TORN = 7  # every seventh source's file is cut off, every seventh other one says nothing of use


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _clips(spark, sf):
    """Orders as clips of 200 report files, written and scanned."""
    rows = D.table(spark, sf, "orders").selectExpr(*REPORT)
    clip = F.struct(F.concat(F.lit("data_stereo\\"), F.col("clip_no"), F.lit(".wav")).alias("path"), F.col("clip_no").cast("string").alias("clip_id"), "status")
    texts = rows.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", clip.alias("c")))), lambda x: x["c"]).alias("clips"))
    text = F.to_json(F.struct(F.format_string("src%04d", "source").alias("source"), "clips"))
    torn = F.when(F.col("source") % _TORN == 3, F.expr("left(t, length(t) div 2)")).when(F.col("source") % _TORN == 5, F.lit('{"clips": null}')).otherwise(F.col("t"))
    texts = texts.withColumn("t", text).select(F.format_string("src%04d_qc.json", "source").alias("file"), torn.alias("value"))
    folder = _folder(spark, "reports")
    W.write_reports(texts, folder)
    return W.scan_reports(spark, folder)


def s1_scanned_index(spark, sf):
    return W.status_index(_clips(spark, sf))


def s2_scanned_sources(spark, sf):
    return W.source_index(_clips(spark, sf))


def s12_rejected_file(spark, sf):
    """The rejected clips of the scanned reports, published and read again."""
    folder = _folder(spark, "rejected")
    W.publish({"rejected_clips.jsonl": W.rejected(_clips(spark, sf))}, folder, "reports", 1)
    return W.read_export(spark, folder, "reports", 1, "rejected_clips.jsonl")


def _manifest(spark, sf):
    wavs = D.table(spark, sf, "part").selectExpr(*WAV).withColumn("path", F.concat(F.lit("data_stereo/"), F.col("clip_no"), F.lit(".wav")))
    return X.manifest_rows(wavs.select("path", "channels", "sample_rate", "samples"), s1_scanned_index(spark, sf), wavs.select("path", "valid"), wavs.where("approved").select("path"))


def s11_manifest_file(spark, sf):
    """The train manifest of the scanned reports, published and read again."""
    folder = _folder(spark, "manifest")
    W.publish({"train.jsonl": X.jsonl(_manifest(spark, sf), ["path"])}, folder, "dataset", 1)
    return W.read_export(spark, folder, "dataset", 1, "train.jsonl")


def _export_tables(spark, sf):
    """Spoken turns as approved clips of conversations as sources: manifests by split, golden utterances, reports, provenance, settings."""
    spoken = D.turns(spark, sf).where("speaker is not null").select("source_id", "turn", "speaker", "start_sample", "end_sample")
    sources = X.split_sources(spoken.select("source_id").distinct().withColumn("project_id", F.lit(1))).select("source_id", "split")
    clips = spoken.join(sources, "source_id").withColumn("clip_id", F.format_string("%d_clip_%03d", "source_id", "turn"))
    record = clips.select("split", F.concat(F.lit("data_stereo/"), "clip_id", F.lit(".wav")).alias("path"), ((F.col("end_sample") - F.col("start_sample")) / 24000).alias("duration"))
    split = lambda name: X.jsonl(record.where(F.col("split") == name).drop("split"), ["path"])
    golden = spoken.where("speaker = 'A' and turn % 4 = 1").select("source_id", "start_sample", F.col("turn").alias("utterance_id"))
    checked = clips.select("source_id", "clip_id", F.col("split").alias("assignment"), F.when(F.col("turn") % 5 == 4, "REVIEW").otherwise("PASS").alias("status"))
    origin = sources.select("source_id", F.concat(F.lit("conversation "), "source_id").alias("original_name"), F.col("split").alias("assignment"))
    config = spark.range(1).select(F.to_json(F.create_map(*[F.lit(str(x)) for pair in sorted(asdict(DEFAULT).items()) for x in pair])).alias("value"))
    return {
        "train.jsonl": split("train"), "eval.jsonl": split("eval"), "golden_regression.jsonl": X.jsonl(golden, ["source_id", "start_sample", "utterance_id"]),
        "qc_summary": X.jsonl(checked, ["source_id", "clip_id"]), "provenance": X.jsonl(origin, ["source_id"]), "config.snapshot": config,
    }


def s14_export(spark, sf):
    """One version written and published, checked against its marker, and a second attempt at the same version."""
    folder, tables = _folder(spark, "exports"), _export_tables(spark, sf)
    W.publish(tables, folder, "set", 1)
    found = W.verify_export(spark, folder, "set", 1).select("file", "rows", "digest", F.when(F.col("intact"), "published").otherwise("damaged").alias("result"))
    try:
        W.publish(tables, folder, "set", 1)
        again = "overwritten"
    except W.VersionExists:
        again = "refused"
    return found.where("file <> 'config.snapshot'").unionByName(spark.createDataFrame([("(second attempt)", 0, "0", again)], found.schema))


QUERIES = {"S1_scanned_index": s1_scanned_index, "S2_scanned_sources": s2_scanned_sources, "S11_manifest_file": s11_manifest_file, "S12_rejected_file": s12_rejected_file, "S14_export": s14_export}

_SCAN = _REP.replace("NOT lost", f"source % {_TORN} NOT IN (3, 5)")
_EXPORT = f"""WITH {D.SQL},
spoken AS (SELECT source_id, turn, speaker, start_sample, end_sample FROM turns WHERE speaker IS NOT NULL),
hashed AS (SELECT source_id, row_number() OVER (ORDER BY sha256(source_id::VARCHAR)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source_id FROM spoken)),
src AS (SELECT source_id, CASE WHEN n >= 2 AND r <= greatest(1, least(n - 1, round_even(n * 0.1, 0))) THEN 'eval' ELSE 'train' END AS split FROM hashed),
clip AS (SELECT *, printf('%d_clip_%03d', source_id, turn) AS clip_id FROM spoken JOIN src USING (source_id)),
line AS (
  SELECT split || '.jsonl' AS file, '{{"path":"data_stereo/' || clip_id || '.wav","duration":' || ((end_sample - start_sample) / 24000)::VARCHAR || '}}' AS value FROM clip
  UNION ALL SELECT 'golden_regression.jsonl', '{{"source_id":' || source_id || ',"start_sample":' || start_sample || ',"utterance_id":' || turn || '}}' FROM spoken WHERE speaker = 'A' AND turn % 4 = 1
  UNION ALL SELECT 'qc_summary', '{{"source_id":' || source_id || ',"clip_id":"' || clip_id || '","assignment":"' || split || '","status":"' || CASE WHEN turn % 5 = 4 THEN 'REVIEW' ELSE 'PASS' END || '"}}' FROM clip
  UNION ALL SELECT 'provenance', '{{"source_id":' || source_id || ',"original_name":"conversation ' || source_id || '","assignment":"' || split || '"}}' FROM src)
SELECT file, count(*) AS rows, sum(CAST('0x' || substr(sha256(value), 1, 15) AS BIGINT)::HUGEINT)::VARCHAR AS digest, 'published' AS result FROM line GROUP BY file
UNION ALL SELECT '(second attempt)', 0, '0', 'refused'"""

ORACLES = {
    "S1_scanned_index": f"WITH {_SCAN} SELECT path, status FROM ix",
    "S2_scanned_sources": f"WITH {_SCAN} SELECT clip_no::VARCHAR AS clip_id, printf('src%04d', source) AS key FROM rp WHERE source % {_TORN} NOT IN (3, 5) QUALIFY row_number() OVER (PARTITION BY clip_no ORDER BY source DESC, pos DESC) = 1",
    "S11_manifest_file": f"""WITH {_MAN.replace(_REP, _SCAN)} SELECT '{{"path":"' || path || '","duration":' || duration || '}}' AS value FROM mf""",
    "S12_rejected_file": f"""WITH {_SCAN} SELECT printf('{{"source":"src%04d","path":"data_stereo\\\\%d.wav","clip_id":"%d","status":"REJECT"}}', source, clip_no, clip_no) AS value FROM rp WHERE status = 'REJECT' AND source % {_TORN} NOT IN (3, 5)""",
    "S14_export": _EXPORT,
}
