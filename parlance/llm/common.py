"""Helpers shared by the corpus operators: checkpoints, hashing of words, components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels handle at once; a longer text is one piece.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); where it is unset, a temporary one, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    sc = spark.sparkContext
    where = sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="parlance-ckpt-"))
        where = sc.getCheckpointDir()
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written as a table in the shared folder and read again.

    A written table also gives the planner true sizes; the estimates of ``DataFrame.checkpoint``
    are carried over from the plan before and multiply from join to join in a loop.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlance-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of an id written as decimal text, modulo a small number: the fixed folds."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted`` with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def one_text(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows, others) of documents (doc_id, text): of an id with several texts only rows of that with the smallest hash stay.

    ``others`` are the rows left out, None if there are none; a null id stays.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h")).where("doc_id is not null")
    twice = hashed.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select(F.col("doc_id").alias("twice"), "low")
    twice = checkpoint(twice)
    if twice.isEmpty():
        return docs, None
    other = (F.col("doc_id") == F.col("twice")) & (F.xxhash64("text") != F.col("low"))
    return docs.join(twice, other, "left_anti"), docs.join(twice, other, "left_semi")


HOT_SHARE = 10_000  # a key is hot with more than this part of the rows, so there are fewer hot keys than this


def join_hot(rows: DataFrame, sizes: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with one row a key (key, n, ...): hot keys are broadcast, as they are fewer than HOT_SHARE; others shuffle."""
    hot = sizes.where(F.col("n") * HOT_SHARE > total)
    cold = sizes.where(F.col("n") * HOT_SHARE <= total).drop("n")
    near = rows.join(F.broadcast(hot.drop("n")), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


# ---------------------------------------------------------------- hashing of words and spans

_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~0x7 | 0x5)  # odd and 5 modulo 8: powers differ in few low bits only
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n + 1:
        size = max(n + 1, PIECE_BYTES + 4096)
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
            _INVERSES = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _INVERSE, np.uint64))])
    return _POWERS, _INVERSES


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for many spans, from one pass of prefix sums."""
    powers, inverses = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * powers[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * inverses[starts]
        return mix(value + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes; the whole sequence as one if it is shorter; none without words."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k])
    return out if n > 1 else mix(out)


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.zeros(0, np.uint8)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, A-Z lower-cased."""
    data = _LOWER[text_bytes(text)]
    starts, ends = word_bounds(data)
    return np.unique(ngram_hashes(span_hashes(data, starts, ends), n))


def arrow_strings(column) -> list:
    """The values of an Arrow string column, one at a time, so that no list of all is held."""
    return (x.as_py() for x in column)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected link table: rows (id, component_id), smallest id each.

    Links are contracted round by round: each vertex points to the smallest neighbour (itself
    included), pointers are followed twice, links are renamed to the pointed-to vertices and
    deduplicated.  Odd rounds order vertices by a hash instead of the id, so that long ordered
    chains shrink by a constant factor in expectation.  Every step is a join or a partial
    aggregate; nothing but the count of the remaining links reaches the driver.  Null ends and
    self links are ignored; an empty link table gives an empty result.
    """
    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    links = checkpoint(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    owner = None
    turn = 0
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        salt = F.lit(turn)
        by = (lambda c, salt=salt: F.xxhash64(c, salt)) if turn % 2 else (lambda c: F.lit(0).cast("long"))
        rank = lambda name, by=by: F.struct(by(F.col(name)).alias("h"), F.col(name).alias("x"))
        near = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        point = near.select(F.col("u").alias("id"), F.when(F.col("m") < rank("u"), F.col("m.x")).otherwise(F.col("u")).alias("to"))
        hop = point.alias("p").join(point.alias("q"), F.col("p.to") == F.col("q.id")).select(F.col("p.id").alias("id"), F.col("q.to").alias("to"))
        point = checkpoint(hop)
        if owner is None:
            owner = point
        else:
            owner = owner.alias("o").join(point.alias("p"), F.col("o.to") == F.col("p.id"), "left").select(F.col("o.id").alias("id"), F.coalesce("p.to", "o.to").alias("to"))
            owner = checkpoint(owner)
        links = (
            links.join(point.select(F.col("id").alias("u"), F.col("to").alias("u2")), "u")
            .join(point.select(F.col("id").alias("v"), F.col("to").alias("v2")), "v")
            .where("u2 <> v2")
            .select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
            .distinct()
        )
        links = checkpoint(links)
        turn += 1
    if owner is None:
        return edges.sparkSession.createDataFrame([], "id long, component_id long")
    least = owner.groupBy("to").agg(F.min("id").alias("component_id"))
    return owner.join(least, "to").select("id", "component_id")


def batched_rows(batches, names: list[str]):
    """Rows of Arrow batches as tuples of Python values, one row at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def emit(rows: list[tuple], schema):
    """An Arrow batch of rows."""
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def cpu_threads_one() -> None:
    """Numeric libraries keep to one thread in a task; Spark runs the tasks side by side."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
