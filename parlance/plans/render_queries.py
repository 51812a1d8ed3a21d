"""Queries that render clips: every user's events as a source, 240 samples an event, ten events a clip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rendering as R
from ..sources import driver_tables as D
from .table_queries import _tones, _values
from ..writing import keeper

FADE, CHUNK = 24, 960  # short, as the clips are short


def _inputs(spark, sf):
    """Speech that runs into the next event, exclusions, recovered stems and words, all from the event's number and type."""
    keep = keeper(spark)
    # the values are written down, not the samples, which are two thousand bytes an event
    values = keep(_values(spark, sf))
    ev = values.select(F.col("clip_id").alias("source_id"), "event_id", "event_type", F.col("start_sample").alias("at"))
    pcm = lambda rows: _tones(rows).withColumnRenamed("clip_id", "source_id")
    span = lambda df, a, b, *more: df.select("source_id", *more, F.expr(a).cast("long").alias("start_sample"), F.expr(b).cast("long").alias("end_sample"))
    speaker = F.when(F.col("event_type").isin("click", "view"), "A").otherwise("B").alias("speaker")
    activities = span(ev, "greatest(0, at - 60 * (at div 240 % 3))", "at + 240 + 100 * (event_id % 2)", speaker)
    exclusions = span(ev.where("event_id % 13 = 0"), "at + 30", "at + 90")
    took = pcm(values.where("event_id % 11 = 0"))
    half = F.transform(F.slice("left", 1, 120), lambda x: (x * 0.5).cast("float"))
    stems = took.select("source_id", "start_sample", half.alias("left"), F.slice("right", 1, 120).alias("right"))
    ends = ev.groupBy("source_id").agg((F.max("at") + 240).alias("n"))
    clips = ends.select("source_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 2400"))).alias("j"))
    clips = clips.select("source_id", F.format_string("%d_%d", "source_id", "j").alias("clip_id"), F.expr("j * 2400").alias("start_sample"), F.expr("least(n, (j + 1) * 2400)").alias("end_sample"), ((F.col("j") % 4) / 40).alias("overlap_ratio"))
    assistants = ends.select("source_id", F.when(F.col("source_id") % 2 == 0, "A").otherwise("B").alias("assistant"))
    words = span(ev.withColumn("speaker", speaker).join(assistants, "source_id").where("speaker = assistant"), "at + 10", "at + 200", F.concat(F.lit("w"), "event_id").alias("word"))
    return pcm(values).select("source_id", "start_sample", F.col("left").alias("samples")), clips, activities, assistants, stems, exclusions, words


def _rendered(spark, sf):
    mono, clips, activities, assistants, stems, exclusions, words = _inputs(spark, sf)
    keep = keeper(spark)
    recovered = stems.select("source_id", "start_sample", (F.col("start_sample") + F.size("left")).alias("end_sample"))
    runs, left_out = R.channel_runs(clips, activities, assistants, recovered)
    left_out = keep(left_out)
    chunks = R.rendered_chunks(mono, clips, runs, stems, exclusions, FADE, CHUNK)
    return keep(R.clip_totals(chunks, left_out)), clips, words, stems, left_out


def r6_rendered_clips(spark, sf):
    """What each clip's file holds."""
    return _rendered(spark, sf)[0].select("source_id", "clip_id", "samples", "digest", "omitted", "left_sum", "right_sum", "assistant_samples", "user_samples", F.round("left_rms", 9).alias("left_rms"), F.round("right_leakage", 6).alias("right_leakage"))


def r6_clip_artifacts(spark, sf):
    """Sidecars, verdicts and manifest rows of the same clips."""
    totals, clips, words, stems, left_out = _rendered(spark, sf)
    out = R.clip_artifacts(totals, clips, words, stems, left_out)
    return out.select("source_id", "clip_id", "sidecar", "total_words", "status", F.array_join("reasons", ",").alias("reasons"), "path", F.round("duration", 9).alias("duration"))


QUERIES = {"R6_rendered_clips": r6_rendered_clips, "R6_clip_artifacts": r6_clip_artifacts}

# sample by sample: masks are sets of samples, runs are islands of them
_SAMPLES = f"""ev AS (SELECT user_id AS u, event_id, event_type, value / 200 AS v, 240 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS pos FROM events),
n AS (SELECT u, max(pos) + 240 AS n FROM ev GROUP BY 1),
x AS (SELECT u, pos + i AS i, event_id, i AS k, CAST(greatest(-1, least(1, v * ((i * 7) % 21 - 10) / 10)) AS REAL) AS l, CAST(greatest(-1, least(1, v * ((i * 5) % 21 - 10) / 10)) AS REAL) AS r FROM ev, range(240) t(i)),
spk AS (SELECT DISTINCT u, i, s FROM (SELECT u, CASE WHEN event_type IN ('click', 'view') THEN 'A' ELSE 'B' END AS s, unnest(range(greatest(0, pos - 60 * (pos // 240 % 3)), pos + 240 + 100 * (event_id % 2))) AS i FROM ev) JOIN n USING (u) WHERE i < n),
solo AS (SELECT u, i, min(s) AS s, count(*) AS c FROM spk GROUP BY 1, 2),
st AS (SELECT u, i, CAST(l * 0.5 AS REAL) AS l, r FROM x WHERE event_id % 11 = 0 AND k < 120),
ex AS (SELECT DISTINCT u, pos + 30 + i AS i FROM ev, range(60) t(i) WHERE event_id % 13 = 0),
heard AS (
  SELECT u, i, CASE WHEN (s = 'A') = (u % 2 = 0) THEN 'assistant' ELSE 'user' END AS role FROM solo WHERE c = 1
  UNION SELECT u, i, unnest(['assistant', 'user']) FROM st),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY u, i // 2400, role ORDER BY i) AS g FROM heard),
run AS (SELECT u, i, role, min(i) OVER w AS a, max(i) OVER w + 1 AS b FROM isl WINDOW w AS (PARTITION BY u, i // 2400, role, g)),
gain AS (SELECT u, i, role, b - a AS len, i - a AS up, least({FADE}, (b - a) // 2) AS w FROM run),
gained AS (SELECT u, i, role, CASE WHEN w = 0 THEN 1.0 WHEN up >= len - w THEN 1 - (up - (len - w)) / greatest(1, w - 1)::DOUBLE WHEN up < w THEN up / greatest(1, w - 1)::DOUBLE ELSE 1.0 END AS g FROM gain),
side AS (SELECT x.u, x.i, gained.role, ex.i IS NOT NULL AS mute,
  CASE WHEN ex.i IS NOT NULL OR gained.g IS NULL THEN CAST(0 AS REAL) ELSE CAST(CAST(CASE WHEN st.i IS NULL THEN x.l WHEN gained.role = 'assistant' THEN st.l ELSE st.r END AS DOUBLE) * gained.g AS REAL) END AS y
  FROM x LEFT JOIN gained ON gained.u = x.u AND gained.i = x.i LEFT JOIN st ON st.u = x.u AND st.i = x.i LEFT JOIN ex ON ex.u = x.u AND ex.i = x.i),
pcm AS (SELECT u, i, CAST(round_even(coalesce(max(greatest(-1, least(32767 / 32768.0::DOUBLE, y)) * 32768) FILTER (role = 'assistant'), 0), 0) AS BIGINT) AS l,
  CAST(round_even(coalesce(max(greatest(-1, least(32767 / 32768.0::DOUBLE, y)) * 32768) FILTER (role = 'user'), 0), 0) AS BIGINT) AS r,
  bool_or(role = 'assistant' AND NOT mute) IS TRUE AS al, bool_or(role = 'user' AND NOT mute) IS TRUE AS us FROM side GROUP BY 1, 2),
hex AS (SELECT *, i // 2400 AS j, i % 2400 // {CHUNK} AS k, printf('%02x%02x%02x%02x', l & 255, (l >> 8) & 255, r & 255, (r >> 8) & 255) AS h FROM pcm),
chunk AS (SELECT u, j, k, sha256(unhex(string_agg(h, '' ORDER BY i))) AS d FROM hex GROUP BY 1, 2, 3),
whole AS (SELECT u, j, sha256(string_agg(d, '' ORDER BY k)) AS digest FROM chunk GROUP BY 1, 2),
miss AS (SELECT solo.u, solo.i // 2400 AS j, count(*) AS c FROM solo LEFT JOIN st ON st.u = solo.u AND st.i = solo.i WHERE solo.c = 2 AND st.i IS NULL GROUP BY 1, 2),
sums AS (SELECT u, j, count(*) AS samples, sum(abs(l)) AS left_sum, sum(abs(r)) AS right_sum, count(*) FILTER (al) AS assistant_samples, count(*) FILTER (us) AS user_samples, sqrt(avg((l / 32768.0::DOUBLE) ** 2)) AS left_rms,
  coalesce(avg((r / 32768.0::DOUBLE) ** 2) FILTER (al), 0) / (coalesce(avg((l / 32768.0::DOUBLE) ** 2) FILTER (al), 0) + 1e-12) AS leak FROM hex GROUP BY 1, 2)"""

ORACLES = {
    "R6_rendered_clips": f"""WITH {_SAMPLES}
SELECT u AS source_id, u || '_' || j AS clip_id, samples, digest, coalesce(c, 0) AS omitted, CAST(left_sum AS BIGINT) AS left_sum, CAST(right_sum AS BIGINT) AS right_sum, assistant_samples, user_samples,
  round(left_rms, 9) AS left_rms, round(leak, 6) AS right_leakage FROM sums JOIN whole USING (u, j) LEFT JOIN miss USING (u, j)""",
}
