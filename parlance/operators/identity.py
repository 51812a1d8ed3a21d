"""Speaker identity: prototypes, similarities, the mapping of two detected voices to two references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..settings import DEFAULT, Settings


def prototypes(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centroid): the mean vector by key; components meet in one aggregate with partial sums."""
    parts = vectors.where("embedding is not null").select(*keys, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"])
    return means.groupBy(*keys).agg(ordered.alias("centroid"))


def similarities(detected: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, detected, reference, similarity) of the voices of each source."""
    return detected.join(references, keys).select(*keys, "detected", "reference", cosine(F.col("d_vec"), F.col("r_vec")).alias("similarity"))


def choose_mapping(similarity: DataFrame, keys: list[str], s: Settings = DEFAULT) -> DataFrame:
    """(keys, first_to, second_to, status): straight or crossed by the larger sum, straight on a tie; refused if a similarity or the margin is too small."""
    w = Window.partitionBy(*keys).orderBy("detected")
    r = Window.partitionBy(*keys).orderBy("reference")
    df = similarity.withColumn("d", F.dense_rank().over(w)).withColumn("r", F.dense_rank().over(r))
    cell = lambda d, k: F.max(F.when((F.col("d") == d) & (F.col("r") == k), F.col("similarity")))
    wide = df.groupBy(*keys).agg(cell(1, 1).alias("s11"), cell(1, 2).alias("s12"), cell(2, 1).alias("s21"), cell(2, 2).alias("s22"), F.min("reference").alias("r1"), F.max("reference").alias("r2"), F.max("d").alias("nd"), F.max("r").alias("nr"))
    straight = F.col("s11") + F.col("s22") >= F.col("s12") + F.col("s21")
    pick = lambda a, b: F.when(straight, F.col(a)).otherwise(F.col(b))
    least = F.least(pick("s11", "s12"), pick("s22", "s21"))
    margin = F.least(pick("s11", "s12") - pick("s12", "s11"), pick("s22", "s21") - pick("s21", "s22"))
    status = F.when((F.col("nd") != 2) | (F.col("nr") != 2), "wrong_count").when(least < s.identity_similarity, "low_similarity").when(margin < s.identity_margin, "low_margin").otherwise("matched")
    return wide.select(*keys, pick("r1", "r2").alias("first_to"), pick("r2", "r1").alias("second_to"), status.alias("status"), least.alias("similarity"), margin.alias("margin"))


def enrolment(turns: DataFrame, keys: list[str], budget: int, shortest: int) -> DataFrame:
    """Turns of each key taken in order until the budget of samples is used; the last one is cut."""
    w = Window.partitionBy(*keys).orderBy("start_sample", "end_sample").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end_sample") - F.col("start_sample")
    df = turns.where(length >= shortest).withColumn("prior", F.coalesce(F.sum(length).over(w), F.lit(0)))
    take = F.least(length, F.lit(budget) - F.col("prior"))
    return df.withColumn("take", take).where("take > 0").withColumn("end_sample", F.col("start_sample") + F.col("take")).drop("prior", "take")
