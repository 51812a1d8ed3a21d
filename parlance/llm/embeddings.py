"""Near-duplicate embeddings: rotated binary codes with correction factors.

A unit vector is embedded in twice its dimensions by a random rotation and kept in 4 bits a
component.  The first bit of each is its sign, the binary code; stored with it are the correction
factor, the inner product of the normalised code and the rotated vector, and the step of
the 4 bits.  For two vectors, <code of a, b> divided by a's factor is an unbiased estimate of their
cosine with a known spread, so ``ERRORS`` times the spread above the estimate bounds the cosine.
Only vectors with a partner whose bound reaches the threshold have their cosines computed
again, in double precision from the vectors themselves.

Which pairs get an estimate: those that lie on the same side of every random hyperplane of one
of a number of draws.  The draw's length grows with the logarithm of the number of vectors, so that a
bucket holds about ``BUCKET`` unrelated vectors at any size, and the number of draws follows from ``MISS``,
the chance that a pair at the threshold agrees in none; each draw has hyperplanes of its own.
Sides are computed in whole numbers from the 4 bits, so every task finds the same ones, and
a pair counts in the first draw in which it agrees only.  What goes through the network for each draw
is a row of about 100 bytes at 64 dimensions; the vectors themselves follow only for those that have
a partner to be computed again.  Tasks return counts of links and a spanning forest of them, never the links.
Equal vectors are one class, whatever their number.  A large bucket is cut into chunks, and pairs of
chunks are groups of their own.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are kept; vectors of different lengths never link; a null id links with nothing,
has a null component and is kept; n_links counts ids, so repeated rows of one id and vector are one vector; of several
vectors of one id that with the smallest bytes counts, and each row is returned.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import checkpoint, components, mix, table

THRESHOLD, ERRORS, MISS, SEED = 0.9, 4.0, 1e-4, 29
BUCKET, CHUNK, SLAB = 1024, 4096, 512
ROUGH = 0.05  # what 4 bits may add to an estimate
BENT = 0.015  # by which 4 bits may lower a cosine at the threshold


def rotation(dims: int) -> np.ndarray:
    """2 * dims rows, orthonormal columns; an even number of rows."""
    size = max(16, 2 * dims)
    return np.linalg.qr(np.random.default_rng(SEED + dims).normal(size=(size, size)))[0][:, :dims]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(odd whole numbers from -15 to 15 for each rotated component, correction factors, steps) of unit rows."""
    y = unit @ rotation(unit.shape[1]).T
    step = np.abs(y).max(axis=1) / 15.99
    level = 2 * np.floor(y / (2 * step[:, None])).clip(-8, 7).astype(np.int8) + 1
    sign = np.where(level > 0, 1.0, -1.0)
    return level, (sign * y).sum(axis=1) / math.sqrt(y.shape[1]), step


def pack(level: np.ndarray) -> np.ndarray:
    """Two components a byte."""
    half = ((level + 15) >> 1).astype(np.uint8)
    return half[:, 0::2] << 4 | half[:, 1::2]


def unpack(packed: np.ndarray) -> np.ndarray:
    out = np.empty((packed.shape[0], 2 * packed.shape[1]), np.int8)
    out[:, 0::2], out[:, 1::2] = packed >> 4, packed & 15
    return 2 * out - 15


_planes: dict[tuple[int, int], np.ndarray] = {}


def draws(level: np.ndarray, bits: int, count: int) -> np.ndarray:
    """(rows, count) 64-bit keys: the sides of each draw's hyperplanes, which have whole coefficients; other dimensions have other keys."""
    size = level.shape[1]
    if (size, bits * count) not in _planes:
        _planes[size, bits * count] = np.rint(np.random.default_rng([SEED, size]).normal(size=(bits * count, size)) * 1000).T.copy()
    sides = level.astype(np.float64) @ _planes[size, bits * count] > 0  # exact: whole numbers far under 2^53
    powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    with np.errstate(over="ignore"):
        keys = np.stack([(sides[:, k * bits : (k + 1) * bits] * powers).sum(axis=1) for k in range(count)], axis=1)
        return mix(mix(keys + np.uint64(size << 32)) + np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a draw, number of draws) for n vectors."""
    bits = max(3, round(math.log2(max(n, 2) / BUCKET)))
    agree = 1 - math.acos(threshold - BENT) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


class Group:
    """The rows of one bucket, or of two chunks of it, in a task: ``own`` marks those of the first chunk."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.draw = int(columns["draw"][0])
        self.own = columns["chunk"] == columns["pa"]
        self.same = columns["pa"][0] == columns["pb"][0]
        self.left = np.flatnonzero(self.own)
        self.right = self.left if self.same else np.flatnonzero(~self.own)
        self.columns = columns

    def bytes_of(self, name: str, kind=np.uint8) -> np.ndarray:
        return np.frombuffer(b"".join(self.columns[name]), kind).reshape(len(self.own), -1)

    def slabs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, mask of the other rows' order): a bounded number of left rows with all right rows, each pair once."""
        for k in range(0, len(self.left), SLAB):
            rows = self.left[k : k + SLAB]
            later = self.right[None, :] > rows[:, None] if self.same else np.ones((len(rows), len(self.right)), bool)
            yield rows, later


def partners(group: Group, threshold: float) -> np.ndarray:
    """The rows that have a partner whose bound reaches the threshold."""
    level = unpack(group.bytes_of("q"))
    factor, step = (group.columns[n].astype(np.float32) for n in ("factor", "step"))
    size = level.shape[1]
    rotated = level * step[:, None]
    codes = np.where(level > 0, np.float32(1 / math.sqrt(size)), np.float32(-1 / math.sqrt(size)))
    spread = (ERRORS * np.sqrt((1 - factor**2).clip(0) / factor**2 / (size - 1)) + ROUGH).astype(np.float32)
    # the bound reaches the threshold where the raw product reaches this
    least = (threshold - spread) * factor
    marked = np.zeros(len(level), bool)
    others = rotated[group.right].T
    for rows, later in group.slabs():
        i, j = np.nonzero((codes[rows] @ others >= least[rows, None]) & later)
        i, j = rows[i], group.right[j]
        back = np.einsum("ij,ij->i", codes[j], rotated[i]) >= least[j]  # the bound from the other side
        marked[i[back]] = marked[j[back]] = True
    return np.flatnonzero(marked)


def links(group: Group, threshold: float, bits: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(linked ids that count in this group, by row; root row of each row in the group's forest)."""
    x = group.bytes_of("key", np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    square = np.einsum("ij,ij->i", x, x)
    keys = draws(unpack(group.bytes_of("q")), bits, count)[:, : group.draw]
    copies = group.columns["copies"]
    total, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for rows, later in group.slabs():
        product = x[rows] @ x[group.right].T
        linked = (product >= threshold * np.sqrt(square[rows, None] * square[None, group.right])) & later
        for d in range(group.draw):  # pairs of an earlier draw are not counted again
            if not linked.any():
                break
            linked &= keys[rows, d][:, None] != keys[group.right, d][None, :]
        total[rows] += linked @ copies[group.right]
        total[group.right] += linked.T @ copies[rows]
        i, j = np.nonzero(linked & (root[rows, None] != root[None, group.right]))
        while len(i):  # hooks of roots, then jumps
            a, b = root[rows[i]], root[group.right[j]]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
            still = root[rows[i]] != root[group.right[j]]
            i, j = i[still], j[still]
    return total, root


def _in_groups(names: list[str], plain: int, work: Callable[[Group], pa.RecordBatch | None]) -> Callable:
    """A task's function over sorted rows: ``work`` is called once for each (bucket, pa, pb); the first ``plain`` columns are numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(t: pa.Table, last: bool) -> Iterator[Group]:
            nonlocal rest
            b, x, y = (t[n].to_numpy() for n in names[:3])
            edges = np.concatenate([[0], np.flatnonzero((b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(b)]])
            rest = None if last else t.slice(edges[-2])
            numbers = {n: t[n].to_numpy() for n in names[:plain]}
            for p, q in zip(edges[:-1], edges[1:] if last else edges[1:-1]):
                if q - p > 1:
                    yield Group({n: v[p:q] for n, v in numbers.items()} | {n: t[n].slice(p, q - p).to_pylist() for n in names[plain:]})

        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                for group in groups(t if rest is None else pa.concat_tables([rest, t]), False):
                    yield from work(group)
        if rest is not None and rest.num_rows:
            for group in groups(rest, True):
                yield from work(group)

    return run


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding)."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0)
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(sound)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(np.array(v.as_py()) + 0.0).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["vec_id", "key"])

    one = map_arrow(usable, raw, "vec_id long, key binary").groupBy("vec_id").agg(F.min("key").alias("key"))
    keyed = checkpoint(one.withColumn("class", F.sha2("key", 256)))
    classes = keyed.groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = checkpoint(classes.join(keyed.select(F.col("vec_id").alias("id"), "key"), "id"))
    bits, count = plan(classes.count(), threshold)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for at, key in enumerate(keys):
                by_size.setdefault(len(key), []).append(at)
            for rows in by_size.values():
                for k in range(0, len(rows), 2048):
                    part = rows[k : k + 2048]
                    x = np.frombuffer(b"".join(keys[r] for r in part), np.float64).reshape(len(part), -1)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    level, factor, step = encode(x / np.linalg.norm(x, axis=1, keepdims=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[r] for r in part], pa.int64()), pa.array([c.tobytes() for c in pack(level)], pa.binary()), pa.array(factor, pa.float32()),
                            pa.array(step, pa.float32()), pa.array(list(draws(level, bits, count).view(np.int64)), pa.list_(pa.int64())),
                        ],
                        names=["id", "q", "factor", "step", "keys"],
                    )

    coded = checkpoint(map_arrow(classes.select("key", "id"), code, "id long, q binary, factor float, step float, keys array<long>"))
    sizes = coded.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("size"))
    large = checkpoint(sizes.where(F.col("size") > CHUNK))  # few: each holds over CHUNK vectors
    rows = coded.select("id", "q", "factor", "step", F.posexplode("keys").alias("draw", "bucket")).join(large, "bucket", "left")
    chunks = F.coalesce(F.ceil(F.col("size") / CHUNK).cast("int"), F.lit(1))
    rows = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    place = ["bucket", "pa", "pb", "chunk", "draw"]
    rows = rows.withColumn("pa", F.least("chunk", "other")).withColumn("pb", F.greatest("chunk", "other"))
    rows = rows.select(*place, "id", "factor", "step", "q").repartition("bucket", "pa", "pb").sortWithinPartitions("bucket", "pa", "pb")

    def screen(group: Group) -> Iterator[pa.RecordBatch]:
        if len(group.left) and len(group.right):
            at = partners(group, threshold)
            if len(at):
                columns = [pa.array(group.columns[n][at]) for n in [*place, "id"]] + [pa.array([group.columns["q"][k] for k in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*place, "id", "q"])

    found = map_arrow(rows, _in_groups([*place, "id", "factor", "step", "q"], 8, screen), "bucket long, pa int, pb int, chunk int, draw int, id long, q binary")
    again = checkpoint(found).join(classes.select("id", "copies", "key"), "id")
    again = again.select(*place, "id", "copies", "q", "key").repartition("bucket", "pa", "pb").sortWithinPartitions("bucket", "pa", "pb")

    def count_links(group: Group) -> Iterator[pa.RecordBatch]:
        if len(group.left) and len(group.right):
            total, root = links(group, threshold, bits, count)
            at = np.flatnonzero(total)
            ids = group.columns["id"]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(total[at])], names=["id", "root", "n"])

    counted = checkpoint(map_arrow(again, _in_groups([*place, "id", "copies", "q", "key"], 7, count_links), "id long, root long, n long"))
    others = counted.groupBy("id").agg(F.sum("n").alias("others"))
    whole = classes.select("class", "id", "copies").join(others, "id", "left").join(components(counted, "id", "root"), "id", "left")
    whole = whole.select("class", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    known = keyed.select("vec_id", "class").join(whole, "class").select("vec_id", "n_links", "component_id")
    out = vectors.select("vec_id").join(known, "vec_id", "left")
    least = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), least.alias("component_id"), F.coalesce(least == F.col("vec_id"), F.lit(True)).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS comp FROM r GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(comp, vec_id) AS component_id, coalesce(comp, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

QUERIES = {"op1_embeddings": op1_embeddings}
ORACLES = {"op1_embeddings": SQL}
