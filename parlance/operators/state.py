"""Versioned state as table transformations: current table and changes in, new tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..writing import keeper
from .planning import follow


def latest(revisions: DataFrame, key: str = "source_id", version: str = "version") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return revisions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def append_revisions(revisions: DataFrame, changes: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with their new version, conflicts with the version that was current then), as if the changes of a source came one by one by change_no.

    A change is accepted if it expects the version that is current at its turn; so each accepted one is
    followed by the next change that expects one version more.  The way over these successors is followed by
    doubling (``keep`` writes its tables down).  Change numbers of a source differ; one without an expected version conflicts.
    """
    keep = keep or keeper(revisions.sparkSession)
    now = revisions.groupBy("source_id").agg(F.max("version").alias("current"))
    df = keep(changes.join(now, "source_id", "left").withColumn("current", F.coalesce("current", F.lit(0)).cast("long")))
    asks = df.select("source_id", F.col("change_no").cast("long").alias("no"), F.col("expected_version").cast("long").alias("v"))
    both = asks.select("source_id", "v", "no", F.lit(True).alias("asks")).unionByName(asks.select("source_id", (F.col("v") + 1).alias("v"), "no", F.lit(False).alias("asks")))
    later = Window.partitionBy("source_id", "v").orderBy("no", "asks").rowsBetween(1, Window.unboundedFollowing)
    nxt = both.withColumn("e", F.first(F.when(F.col("asks"), F.col("no")), ignorenulls=True).over(later)).where("NOT asks AND e IS NOT NULL")
    first = df.where("expected_version = current").groupBy("source_id").agg(F.min("change_no").cast("long").alias("c"))
    way = follow(keep(nxt.select("source_id", F.col("no").alias("c"), "e")), first, keep).select("source_id", F.col("c").alias("change_no"), F.lit(1).alias("__good"))
    df = df.join(way, ["source_id", "change_no"], "left")
    before = Window.partitionBy("source_id").orderBy("change_no").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("current", F.col("current") + F.coalesce(F.sum("__good").over(before), F.lit(0)))
    accepted = df.where("__good IS NOT NULL").withColumn("version", F.col("current") + 1).drop("current", "__good", "expected_version")
    return accepted, df.where("__good IS NULL").drop("__good")


def cascade(children: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
    """Child tables without the rows of changed sources."""
    gone = changed.select("source_id").distinct()
    return {name: df.join(gone, "source_id", "left_anti") for name, df in children.items()}


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """One row a key, the newest; on a tie the change."""
    both = current.withColumn("__src", F.lit(0)).unionByName(changes.withColumn("__src", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__src"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__src")


def replace_children(current: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the sources in ``new`` are replaced."""
    return current.join(new.select("source_id").distinct(), "source_id", "left_anti").unionByName(new)


def patch(current: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Field by field, a change that is not null replaces the old value; only allowed fields change."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in allowed])
    out = current.join(new, key, "left")
    for c in allowed:
        out = out.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out


def merge_headers(current: DataFrame, changes: DataFrame, key: str, allowed: list[str], defaults: dict[str, str], named: str | None = None, sticky: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(header rows after the changes, (change_no, key, op, refused) of all changes), as if these came one by one by change_no.

    A change (change_no, op insert or update, key, values map<string,string>) is refused with a reason: a
    field outside ``allowed``, a blank ``named`` field (which is trimmed; an insert needs it), an insert of
    a key that exists, an update of one that does not.  An insert has the ``defaults`` for fields that it leaves out.  An
    update sets all its fields, also to null, but for the ``sticky`` ones, where null keeps what was there.
    """
    values = F.coalesce(F.col("values"), F.create_map().cast("map<string,string>"))
    if named:
        values = F.transform_values(values, lambda k, v: F.when(k == named, F.trim(v)).otherwise(v))
    df = changes.select("change_no", "op", key, values.alias("values"))
    odd = F.array_sort(F.array_except(F.map_keys("values"), F.array(*map(F.lit, allowed))))
    blank = F.lit(False)
    if named:
        given = F.map_contains_key("values", F.lit(named))
        blank = (given | (F.col("op") == "insert")) & (F.coalesce(F.col("values")[named], F.lit("")) == "")
    wrong = F.when(~F.col("op").isin("insert", "update") | F.col("op").isNull(), "unknown_operation").when(F.size(odd) > 0, F.concat(F.lit("unknown_fields:"), F.array_join(odd, ","))).when(blank, f"blank_{named}")
    df = df.join(current.select(key, F.lit(True).alias("known")), key, "left").withColumn("wrong", wrong)
    # the first sound insert of a new key makes it; what comes before it by number finds no row
    born = F.min(F.when(F.col("wrong").isNull() & (F.col("op") == "insert") & F.col("known").isNull(), F.col("change_no"))).over(Window.partitionBy(key))
    df = df.withColumn("born", born)
    there = F.coalesce(F.col("known") | (F.col("born") < F.col("change_no")), F.lit(False))
    refused = F.coalesce("wrong", F.when((F.col("op") == "insert") & there, "exists").when((F.col("op") == "update") & ~there, "unknown_key"))
    df = df.withColumn("refused", refused)
    sound = df.where("refused IS NULL")
    last = []
    for c in allowed:
        sets = F.map_contains_key("values", F.lit(c)) & (F.col("values")[c].isNotNull() if c in sticky else F.lit(True))
        default = F.struct(F.lit(defaults.get(c)).cast("string").alias("v"))
        said = F.when(sets, F.struct(F.col("values")[c].alias("v"))).when(F.col("op") == "insert", default)
        last.append(F.max_by(said, F.when(said.isNotNull(), F.col("change_no"))).alias(f"__{c}"))
    new = sound.groupBy(key).agg(*last)
    kinds = {c: current.schema[c].dataType for c in allowed}
    rows = current.join(new, key, "full")
    for c in allowed:
        rows = rows.withColumn(c, F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}")["v"].cast(kinds[c])).otherwise(F.col(c)))
    return rows.select(current.columns), df.select("change_no", key, "op", "refused")


def delete_sources(tables: dict[str, DataFrame], doomed: DataFrame, running: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the doomed sources, refused): sources with an active run stay."""
    refused = doomed.join(running.select("source_id").distinct(), "source_id", "left_semi")
    return cascade(tables, doomed.join(refused, "source_id", "left_anti")), refused


def clamp_revisions(revisions: DataFrame, durations: DataFrame) -> DataFrame:
    """Latest revisions whose bounds leave the source, cut to it, as new versions."""
    df = latest(revisions).join(durations, "source_id")
    s, e = F.least("duration", F.greatest(F.lit(0), "start_sample")), F.least("duration", F.greatest(F.lit(0), "end_sample"))
    changed = ~(F.struct("start_sample", "end_sample").eqNullSafe(F.struct(s.alias("start_sample"), e.alias("end_sample"))))
    return df.where(changed).withColumn("start_sample", s).withColumn("end_sample", e).withColumn("version", F.col("version") + 1).drop("duration")


def next_export_version(exports: DataFrame, project: str = "project_id") -> DataFrame:
    return exports.groupBy(project).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))
