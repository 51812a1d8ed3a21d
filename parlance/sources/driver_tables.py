"""Timed conversation tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, turn, speaker, role, toks, start_sample, end_sample): one row a turn, 0.4 s a token."""
    base = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("toks"))
    base = base.withColumn("dur", F.greatest(F.lit(1), F.when(F.col("toks").isNull(), 400).otherwise(F.size("toks"))) * 9600)
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("base", 24000 + F.coalesce(F.sum("dur").over(before), F.lit(0)))
    shift = F.when(F.col("turn") % 3 == 0, 12000).when(F.col("turn") % 3 == 1, -6000).otherwise(0)
    return base.select(
        F.col("conv_id").alias("source_id"), "turn",
        F.when(F.col("role") == "assistant", "A").when(F.col("role") == "user", "B").alias("speaker"), "role", "toks",
        (F.col("base") + shift).cast("long").alias("start_sample"), (F.col("base") + shift + F.col("dur")).cast("long").alias("end_sample"),
    )


def _turns(spark: SparkSession, sf_dir: str, of: DataFrame | None) -> DataFrame:
    """Turns that a query has written down already (``of``), or the plan that makes them."""
    return turns(spark, sf_dir) if of is None else of


def activities(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return _turns(spark, sf_dir, of).where("speaker is not null").select("source_id", "turn", "speaker", "start_sample", "end_sample")


def exclusions(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return _turns(spark, sf_dir, of).where("speaker is null").select("source_id", "turn", "start_sample", "end_sample")


def durations(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(source_id, duration): the end of the last turn and one second."""
    return _turns(spark, sf_dir, of).groupBy("source_id").agg((F.max("end_sample") + 24000).alias("duration"))


def turn_words(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(source_id, turn, i, word, start_sample, end_sample, score): the tokens of each spoken turn."""
    words = _turns(spark, sf_dir, of).where("speaker is not null").select("source_id", "turn", "start_sample", F.posexplode("toks").alias("i", "word"))
    start = F.col("start_sample") + F.col("i") * 9600
    return words.select(
        "source_id", "turn", "i", "word", (start + 960).alias("start_sample"), (start + F.when(F.col("i") % 8 == 7, 3360).otherwise(8640)).alias("end_sample"),
        (((F.col("i") * 37 + F.col("turn") * 11) % 100) / 100.0).alias("score"),
    )


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, event_id, speaker, start_sample, end_sample) of the events, in milliseconds."""
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), "event_id", F.when(F.col("event_type").isin("click", "view"), "A").otherwise("B").alias("speaker"),
        start.alias("start_sample"), (start + F.floor(F.col("value") * 600).cast("long") * 1000 + 1000).alias("end_sample"),
    )


#: The same tables for DuckDB, to be followed by more common table expressions.
SQL = r"""t0 AS (SELECT conv_id, turn, role, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS toks FROM conversations),
t1 AS (SELECT *, greatest(1, coalesce(len(toks), 400)) * 9600 AS dur FROM t0),
t2 AS (SELECT *, 24000 + coalesce(sum(dur) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + CASE turn % 3 WHEN 0 THEN 12000 WHEN 1 THEN -6000 ELSE 0 END AS s FROM t1),
turns AS (SELECT conv_id AS source_id, turn, role, CASE role WHEN 'assistant' THEN 'A' WHEN 'user' THEN 'B' END AS speaker, toks,
  CAST(s AS BIGINT) AS start_sample, CAST(s + dur AS BIGINT) AS end_sample FROM t2),
act AS (SELECT source_id, turn, speaker, start_sample, end_sample FROM turns WHERE speaker IS NOT NULL),
exc AS (SELECT source_id, turn, start_sample, end_sample FROM turns WHERE speaker IS NULL),
dur AS (SELECT source_id, max(end_sample) + 24000 AS duration FROM turns GROUP BY 1),
words AS (SELECT source_id, turn, i, toks[i + 1] AS word, start_sample + i * 9600 + 960 AS start_sample,
  start_sample + i * 9600 + CASE WHEN i % 8 = 7 THEN 3360 ELSE 8640 END AS end_sample, ((i * 37 + turn * 11) % 100) / 100.0 AS score
  FROM (SELECT *, unnest(range(0, len(toks))) AS i FROM turns WHERE speaker IS NOT NULL)),
sp0 AS (SELECT user_id AS source_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'A' ELSE 'B' END AS speaker, epoch_us(ts) // 1000 AS start_sample,
  epoch_us(ts) // 1000 + CAST(floor(value * 600) AS BIGINT) * 1000 + 1000 AS end_sample FROM events)"""
