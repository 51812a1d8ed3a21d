"""Report files scanned from disk, and exports that are written once, published by a marker and read back.

Report texts are one JSON object a file; names end in ``_qc.json``.  A scan may meet plain files or
Spark's own layout (a folder ``file=<name>`` a report, as ``write_reports`` makes it).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .export import jsonl

CLIP = "path string, clip_id string, status string, reasons array<string>"
MARKER = "PUBLISHED.json"  # no underscore before it: Spark does not read such files


def write_reports(reports: DataFrame, folder: str) -> None:
    """Writes texts (file, value), each to a file in a folder of its name; Spark's committer keeps failed attempts out."""
    reports.repartition("file").select("file", "value").write.partitionBy("file").text(folder)


def scan_reports(spark: SparkSession, path: str, clip: str = CLIP, suffix: str = "_qc.json") -> DataFrame:
    """(file, source, pos, clip) of all clips in the report files at ``path``, by name and place.

    A file that is no JSON object of this shape is skipped, like an empty one; a report without
    clips has no rows.  ``source`` is what the report says, null if it says nothing.
    """
    shape = f"source string, clips array<struct<{clip}>>, _broken string"
    read = spark.read.schema(shape).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", pathGlobFilter="*", recursiveFileLookup=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"(?:^|[/=])([^/=]*{suffix.replace('.', chr(92) + '.')})(?:/[^/]*)?$", 1)
    rows = read.json(path).select(name.alias("file"), "source", "clips", "_broken")
    # the broken texts are read as columns, too, as Spark refuses to scan for them alone
    good = rows.where("_broken IS NULL AND file <> ''").select("file", "source", F.posexplode("clips").alias("pos", "clip"))
    return good.where("clip IS NOT NULL")


def _last(rows: DataFrame, key: Column, value: Column, name: str, out: str) -> DataFrame:
    kept = rows.select(key.alias(name), value.alias(out), "file", "pos").where(f"{name} IS NOT NULL AND {name} <> ''")
    return kept.groupBy(name).agg(F.max_by(out, F.struct("file", "pos")).alias(out))


def status_index(clips: DataFrame) -> DataFrame:
    """(path, status) of scanned clips with both; backslashes count as slashes, the last file and place win."""
    stated = clips.where("clip.status IS NOT NULL AND clip.status <> ''")
    return _last(stated, F.replace(F.col("clip.path"), F.lit("\\"), F.lit("/")), F.col("clip.status"), "path", "status")


def source_index(clips: DataFrame, suffix: str = "_qc.json") -> DataFrame:
    """(clip_id, key): the file, without its ending, that names a clip last."""
    return _last(clips, F.col("clip.clip_id"), F.expr(f"left(file, length(file) - {len(suffix)})"), "clip_id", "key")


def rejected(clips: DataFrame) -> DataFrame:
    """The rejected clips of scanned reports with their source, one JSON text a row, by (source, clip_id)."""
    return jsonl(clips.where("clip.status = 'REJECT'").select("source", "clip.*"), ["source", "clip_id"])


# ---------------------------------------------------------------- versioned exports


class VersionExists(ValueError):
    """The version is published already; a published version never changes."""


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version_root(folder: str, slug: str, version: int) -> str:
    return f"{folder}/{slug}_v{version:03d}"


def published(spark: SparkSession, folder: str, slug: str, version: int) -> dict | None:
    """What the marker says ({"attempt": ..., "tables": {name: [rows, digest]}}), None while there is none or it is not whole."""
    path, files = _path(spark, f"{version_root(folder, slug, version)}/{MARKER}")
    if not files.exists(path):
        return None
    lines = spark.read.text(path.toString()).collect()  # one small line
    try:
        return json.loads("".join(r.value for r in lines))
    except ValueError:
        return None


def text_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(file, rows, digest) of tables of texts (value): the digest adds up 60 bits of each text's SHA-256, so no order is needed."""
    number = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("file"), "rows", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def publish(tables: dict[str, DataFrame], folder: str, slug: str, version: int) -> DataFrame:
    """Writes tables of texts (value) as one version, reads them back and publishes them; (file, rows, digest) as read.

    Every attempt writes to a folder of its own below the version's; what has been read back goes into one
    small marker, which is created only if there is none.  Readers follow the marker, so an attempt
    that fails leaves nothing that they see.  A published version raises ``VersionExists`` before anything is written,
    and so does the loser of two attempts at once.
    """
    if not tables:
        raise ValueError("an export needs a table")
    spark = next(iter(tables.values())).sparkSession
    if published(spark, folder, slug, version) is not None:
        raise VersionExists(f"{slug}_v{version:03d}")
    root, attempt = version_root(folder, slug, version), f"attempt-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.select("value").write.mode("errorifexists").text(f"{root}/{attempt}/{name}")
    found = text_digests({name: spark.read.text(f"{root}/{attempt}/{name}") for name in tables}).collect()  # a row a table
    text = json.dumps({"attempt": attempt, "tables": {r.file: [r.rows, r.digest] for r in found}}, sort_keys=True)
    path, files = _path(spark, f"{root}/{MARKER}")
    try:
        out = files.create(path, False)
    except Exception as e:
        if files.exists(path):
            raise VersionExists(f"{slug}_v{version:03d}") from e
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return spark.createDataFrame(found, "file string, rows long, digest string")


def read_export(spark: SparkSession, folder: str, slug: str, version: int, name: str) -> DataFrame:
    """The texts (value) of a table of a published version; a version without a marker is an error."""
    said = published(spark, folder, slug, version)
    if said is None:
        raise FileNotFoundError(f"{slug}_v{version:03d} is not published")
    if name not in said["tables"]:
        raise KeyError(name)
    return spark.read.text(f"{version_root(folder, slug, version)}/{said['attempt']}/{name}")


def verify_export(spark: SparkSession, folder: str, slug: str, version: int) -> DataFrame:
    """(file, rows, digest, intact) of a published version: what its tables hold now against what the marker says."""
    said = published(spark, folder, slug, version)
    if said is None:
        raise FileNotFoundError(f"{slug}_v{version:03d} is not published")
    now = text_digests({name: read_export(spark, folder, slug, version, name) for name in said["tables"]})
    then = spark.createDataFrame([(n, r, d) for n, (r, d) in said["tables"].items()], "file string, said_rows long, said_digest string")
    return now.join(then, "file").select("file", "rows", "digest", ((F.col("rows") == F.col("said_rows")) & (F.col("digest") == F.col("said_digest"))).alias("intact"))
