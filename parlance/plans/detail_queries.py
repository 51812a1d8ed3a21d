"""Queries of nested reports, sample intervals, stems and files; the SQL writes each anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio as AU
from ..operators import export as X
from ..operators import intervals as I
from ..operators import records as R
from ..sources import driver_tables as D
from .interval_queries import _QUIET
from .record_queries import _B, _CL, _MIN, _OVL, _RCV, _REP, _index, _minutes, _recoveries, _verdicts
from .table_queries import _PCM, _pcm, _tones, _values
from ..writing import keeper

E, S = I.E, I.S
CLIP_BLOCKS = 10_000  # blocks of 240 samples in a clip of 100 s


def u4_discarded(spark, sf):
    """Approved paths of Q9 without those that are discarded again."""
    part = D.table(spark, sf, "part").selectExpr("concat('data_stereo/', p_partkey, '.wav') AS path", "p_partkey % 6 AS r")
    ok, _ = R.approvals(_index(spark, sf), part.where("r % 3 = 1").select("path"), part.where("r % 3 = 0").select("path"))
    return R.discard_approvals(ok, part.where("r in (0, 1)"))


def a23_recoveries(spark, sf):
    return R.recovery_totals(_recoveries(spark, sf), ["source_id", "version"])


def m7_detail(spark, sf):
    act, dur = D.activities(spark, sf), D.durations(spark, sf)
    return R.source_detail(dur, act, I.speaker_overlaps(act), I.silences(act, dur), _recoveries(spark, sf), _minutes(spark, sf))


def j19_items(spark, sf):
    segments = D.turns(spark, sf).select("source_id", S, E, F.col("role").alias("text"))
    act = D.activities(spark, sf)
    return R.review_items(_minutes(spark, sf), segments, act, I.speaker_overlaps(act))


def s19_report(spark, sf):
    w = D.turn_words(spark, sf).withColumn(S, F.when(F.col("i") % 10 != 4, F.col(S)))
    return R.transcript_report(w)


def a21_report(spark, sf):
    """The verdict of each clip and the clips of each source, under the sides of the split."""
    src = X.split_sources(D.table(spark, sf, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("source_id")))
    clips = src.join(_verdicts(spark, sf), "source_id")
    quality = clips.groupBy("project_id", "split", "source_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PASS").alias("good"))
    return R.sections({
        "clip": (clips, F.concat_ws(":", "clip_id", "status", F.array_join("reasons", "+"))), "source": (quality, F.concat_ws(":", "source_id", "n", "good")),
    }, ["project_id", "split"])


def s8_reads(spark, sf):
    """Two intervals a user: one that crosses blocks, and one that ends after the last sample; none where a user has one event only."""
    pcm = _pcm(spark, sf)
    ends = pcm.groupBy("clip_id").agg(F.max(S).alias("m"))
    asked = ends.select("clip_id", F.explode(F.array(F.struct(F.lit(0).alias("interval_id"), F.expr("m div 3").alias(S), F.col("m").alias(E)), F.struct(F.lit(1).alias("interval_id"), (F.col("m") + 100).alias(S), (F.col("m") + 300).alias(E)))).alias("q"))
    out = AU.interval_reads(pcm, asked.select("clip_id", "q.*"))
    return out.select("clip_id", "interval_id", "decoded", F.round("left_sum", 6).alias("left_sum"), F.round("right_sum", 6).alias("right_sum"), "problem")


def r3_stems(spark, sf):
    """Stems with the channels exchanged, between the quarter and the half of each user's samples."""
    values = keeper(spark)(_values(spark, sf))
    pcm = _tones(values)
    stems = pcm.select("clip_id", S, F.col("right").alias("left"), F.col("left").alias("right"))
    regions = values.groupBy("clip_id").agg(F.max(S).alias("m")).select("clip_id", F.expr("m div 4").alias(S), F.expr("m div 2").alias(E))
    sums = AU.block_sums(AU.substitute_stems(pcm, stems, regions), ["clip_id"], ["n", "ls", "rs"], lambda x, y: [len(x), x.sum(), y.sum()])
    return sums.groupBy("clip_id").agg(F.sum("n").cast("long").alias("samples"), F.round(F.sum("ls"), 6).alias("left_sum"), F.round(F.sum("rs"), 6).alias("right_sum"))


def s10_headers(spark, sf):
    """Clips of 100 s at most are written as WAV and read again."""
    cut = F.expr(f"block_no div {CLIP_BLOCKS}")
    pcm = _pcm(spark, sf).select(F.concat_ws("_", "clip_id", cut).alias("clip_id"), F.expr(f"block_no % {CLIP_BLOCKS}").alias("block_no"), S, "left", "right")
    blocks = AU.read_wav(AU.wav_bytes(pcm).select(F.col("clip_id").alias("path"), F.col("wav").alias("content")))
    return AU.read_sums(blocks)


def s7_digests(spark, sf):
    return AU.file_digests(D.table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.col("html").cast("binary").alias("content"))).drop("edges")


def s6_edges(spark, sf):
    """Edges of 256 bytes of contents that are shorter or longer than that."""
    content = F.expr("repeat(concat(page_id, url), cast(page_id % 30 as int))").cast("binary")
    return AU.file_digests(D.table(spark, sf, "pages").select(F.col("page_id").alias("path"), content.alias("content")), edge=256).drop("sha256")


QUERIES = {
    "U4_discarded_approvals": u4_discarded, "A23_recovery_totals": a23_recoveries, "M7_source_detail": m7_detail, "J19_review_items": j19_items, "S19_transcript_report": s19_report, "A21_export_report": a21_report,
    "S8_interval_reads": s8_reads, "R3_recovered_stems": r3_stems, "S10_wav_headers": s10_headers, "S7_file_digests": s7_digests, "S6_edge_digests": s6_edges,
}

ORACLES = {
    "U4_discarded_approvals": f"WITH {_REP} SELECT 'data_stereo/' || p_partkey || '.wav' AS path FROM part LEFT JOIN ix ON path = 'data_stereo/' || p_partkey || '.wav' WHERE (p_partkey % 3 = 1 OR p_partkey % 3 = 0 AND status = 'REVIEW') AND p_partkey % 6 NOT IN (0, 1)",
    "A23_recovery_totals": f"{_B}, {_RCV} SELECT source_id, version, count(*) AS regions, count(*) FILTER (status = 'recovered') AS recovered FROM rc GROUP BY 1, 2",
    "M7_source_detail": f"""{_B}, {_RCV}, {_MIN}, {_QUIET} SELECT source_id, 'source' AS section, 0::BIGINT AS start_sample, duration::BIGINT AS end_sample, NULL::VARCHAR AS detail FROM dur UNION ALL SELECT source_id, 'activity', start_sample, end_sample, speaker FROM act
UNION ALL SELECT source_id, 'overlap', start_sample, end_sample, NULL FROM olp UNION ALL SELECT source_id, 'silence', start_sample, end_sample, NULL FROM quiet UNION ALL SELECT source_id, 'recovery', start_sample, end_sample, version || ':' || status || ':' || decision FROM rc
UNION ALL SELECT source_id, 'clip', c0, c1, clip_id::VARCHAR FROM mins""",
    "J19_review_items": f"""{_B}, {_OVL}, {_MIN}, x AS (SELECT source_id, 'segment' AS section, start_sample, end_sample, role AS detail FROM turns UNION ALL SELECT source_id, 'timeline', start_sample, end_sample, speaker FROM act UNION ALL SELECT source_id, 'overlap', start_sample, end_sample, NULL FROM olp)
SELECT x.source_id, clip_id, section, start_sample, end_sample, detail FROM x JOIN mins m ON m.source_id = x.source_id AND start_sample < c1 AND c0 < end_sample WHERE start_sample < end_sample""",
    "S19_transcript_report": f"""{_B}, w AS (SELECT source_id, score, regexp_matches(word, '[A-Za-z]') AS latin, i % 10 = 4 AS lost, '","word":"' || word || '"' || CASE WHEN i % 10 <> 4 THEN ',"start_sample":' || start_sample ELSE '' END || ',"end_sample":' || end_sample || '}}' AS rest FROM words)
SELECT source_id, '{{"list":"unaligned_words' || rest AS value FROM w WHERE lost UNION ALL SELECT source_id, '{{"list":"low_confidence_latin_words' || rest FROM w WHERE latin AND score < 0.4""",
    "A21_export_report": f"""WITH {_CL}, x AS (SELECT c_nationkey AS project_id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(c_custkey::VARCHAR)) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
y AS (SELECT project_id, c_custkey, CASE WHEN n >= 2 AND r <= greatest(1, least(n - 1, round_even(n * 0.10, 0))) THEN 'eval' ELSE 'train' END AS split, clip_id, status, reasons FROM x JOIN orders ON o_custkey = c_custkey JOIN vd ON clip_id = o_orderkey)
SELECT project_id, split, 'clip' AS section, NULL::BIGINT AS start_sample, NULL::BIGINT AS end_sample, clip_id || ':' || status || ':' || coalesce(array_to_string(reasons, '+'), '') AS detail FROM y
UNION ALL SELECT project_id, split, 'source', NULL, NULL, c_custkey || ':' || count(*) || ':' || count(*) FILTER (status = 'PASS') FROM y GROUP BY project_id, split, c_custkey""",
    "S8_interval_reads": f"""{_PCM}, m AS (SELECT clip_id, max(pos) - 239 AS m FROM pcm GROUP BY 1), q AS (SELECT clip_id, 0 AS interval_id, m // 3 AS s, m AS e FROM m UNION ALL SELECT clip_id, 1, m + 100, m + 300 FROM m)
SELECT q.clip_id, interval_id, count(pos) AS decoded, round(coalesce(sum(l::DOUBLE), 0), 6) AS left_sum, round(coalesce(sum(r::DOUBLE), 0), 6) AS right_sum, CASE WHEN e <= s THEN 'invalid_interval' WHEN count(pos) < e - s THEN 'short_read' END AS problem
FROM q LEFT JOIN pcm p ON p.clip_id = q.clip_id AND pos >= s AND pos < e GROUP BY q.clip_id, interval_id, s, e""",
    "R3_recovered_stems": f"""{_PCM}, m AS (SELECT clip_id, max(pos) - 239 AS m FROM pcm GROUP BY 1), x AS (SELECT clip_id, pos >= m // 4 AND pos < m // 2 AS hit, l::DOUBLE AS l, r::DOUBLE AS r FROM pcm JOIN m USING (clip_id))
SELECT clip_id, count(*) AS samples, round(sum(CASE WHEN hit THEN r ELSE l END), 6) AS left_sum, round(sum(CASE WHEN hit THEN l ELSE r END), 6) AS right_sum FROM x GROUP BY 1""",
    "S10_wav_headers": f"""{_PCM}, x AS (SELECT clip_id || '_' || pos // {CLIP_BLOCKS * 240} AS path, round_even(greatest(-32768, least(32767, l::DOUBLE * 32768)), 0) AS l, round_even(greatest(-32768, least(32767, r::DOUBLE * 32768)), 0) AS r FROM pcm)
SELECT path, 24000 AS sample_rate, 2 AS channels, count(*) AS samples, count(*) / 24000 AS duration, count(*) AS decoded, CAST(sum(l) AS BIGINT) AS left_sum, CAST(sum(r) AS BIGINT) AS right_sum FROM x GROUP BY 1""",
    "S7_file_digests": "SELECT page_id AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS sha256 FROM pages",
    "S6_edge_digests": """SELECT page_id AS path, CAST(octet_length(encode(c)) AS BIGINT) AS size, sha256(CASE WHEN length(c) > 256 THEN left(c, 256) || right(c, 256) ELSE c END) AS edges FROM (SELECT page_id, repeat(page_id || url, page_id % 30) AS c FROM pages)""",
}
