"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

Two permutations make all coordinates: the first scatters the shingles over a circle of
``CIRCLE`` places, the second, shifted by k places, gives the k-th coordinate
``min over shingles of second[(first(shingle) + k) mod CIRCLE]``.  Documents with equal
shingle sets become one class before any pairing.  Classes that share a band are compared
with pivots of the band only: classes that already lie in the pivot's component need no
comparison, pivots that are done leave the band, and their number grows fourfold each round, so a
group of near copies costs about one comparison a member and no link between components
is lost.  A pair is compared only if a sketch allows the link: every shingle flips one of
``SKETCH`` bits, so two sets differ in at least as many shingles as their sketches in bits,
and a pair that differs in too many has no link.  Each comparison counts the whole sets.

Defined results: null or empty texts and texts of white space have no shingles, link with
nothing and are kept; a null id links with nothing, has a null component and is kept;
repeated rows of one id are one document and each row is returned; of several texts of one id that with
the smallest hash is the document, and the id's other rows are returned with its result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow, small_batches
from .common import checkpoint, components, mix, one_text, shingle_set, table

CIRCLE = 1 << 20
BANDS, ROWS = 25, 4  # a pair of similarity 0.8 is missed with probability (1 - 0.8 ** 4) ** 25 = 2e-6
SKETCH = 512  # bits
GROWTH = 4  # of the number of pivots of a band, from round to round
SALT = 1024  # classes of a band that meet its pivots in one task

_second: np.ndarray | None = None


def _second_permutation(width: int) -> np.ndarray:
    """All windows of the second permutation of the circle; made once in each worker."""
    global _second
    if _second is None or _second.shape[1] != width:
        order = np.random.default_rng(71).permutation(CIRCLE).astype(np.uint32)
        _second = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: width - 1]]), width)
    return _second


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` coordinates of a non-empty shingle set."""
    places = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    windows, out = _second_permutation(width), np.full(width, CIRCLE, np.uint32)
    for k in range(0, len(places), 4096):  # bounded memory for very long texts
        np.minimum(out, windows[places[k : k + 4096]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the number of the band is part of the key."""
    parts = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key.view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles that fall on each of ``SKETCH`` places, as 64-bit words."""
    places = (mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.int64) % SKETCH
    return np.packbits((np.bincount(places, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch) of each document; set_key is a 128-bit digest of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, keys, lists, sketches = [], [], [], []
            for value in batch.column(1):
                shingles = shingle_set(value.as_py(), n)
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                lists.append(band_keys(signature(shingles, bands * rows), bands, rows) if len(shingles) else None)
                sketches.append(sketch(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (lists, sketches))],
                names=["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return map_arrow(docs, run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, set) with the sorted distinct shingle hashes of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingle_set(v.as_py(), n).view(np.int64) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return map_arrow(docs, run, "id long, set array<long>")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for documents (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their n-word
    shingle sets; component_id is the smallest id that links reach.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, others = one_text(docs)
    signed = checkpoint(signatures(docs, n, bands, rows))
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = checkpoint(
        named.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    in_bands = classes.select("id", "n", F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    open_ = in_bands.join(shared, "band").select("band", "id", "n")
    open_ = checkpoint(open_.join(classes.select("id", "sketch"), "id"))
    wanted = open_.select("id").distinct()
    texts = docs.where("doc_id is not null").join(wanted, docs.doc_id == wanted.id, "left_semi").dropDuplicates(["doc_id"])
    sets = checkpoint(shingle_sets(texts, n))
    owner = _linked(open_, sets, percent)
    least = classes.join(owner, "id", "left").select("set_key", F.coalesce("component_id", "id").alias("component_id"))
    out = signed.join(least, "set_key", "left")
    whole = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(whole == F.col("doc_id"), F.lit(True)).alias("kept"))
    return out if others is None else out.unionByName(others.select("doc_id").join(out.dropDuplicates(["doc_id"]), "doc_id"))


def _linked(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component_id) of all classes that have a link.

    ``c`` is a vertex that the found links reach, and only saves comparisons: links lower it by
    one hook and one jump a round, and components are computed once, from all links, at the end.
    """
    links, pivots = None, 1
    live = open_.withColumn("c", F.col("id"))
    while True:
        state = live.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size"), F.min("id").alias("first"))
        live = live.join(state.where("c0 <> c1").select("band", "size", "first"), "band")
        share = F.greatest(F.lit(1), F.floor(F.col("size") / pivots))
        chosen = (F.col("id") == F.col("first")) | F.lit(pivots > 1) & (F.pmod(F.xxhash64("band", "id", F.lit(pivots)), share) == 0)
        salts = F.ceil(F.col("size") / SALT).cast("int")  # a large band is spread, its few pivots are repeated
        live = checkpoint(live.select("band", "id", "n", "sketch", "c", chosen.alias("pivot"), salts.alias("salts"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt")))
        if live.isEmpty():
            break
        hub = live.where("pivot").select("band", F.col("id").alias("pid"), F.col("n").alias("pn"), F.col("sketch").alias("ps"), F.col("c").alias("pc"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        near = (F.col("c") != F.col("pc")) & (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent)
        differ = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("ps")[k])) for k in range(SKETCH // 64)), F.lit(0))
        near = near & (differ * (100 + percent) <= (F.col("n") + F.col("pn")) * (100 - percent))
        swap = F.col("pid") < F.col("id")
        first, second = F.struct(F.col("pid").alias("a"), F.col("pc").alias("ca")), F.struct(F.col("id").alias("a"), F.col("c").alias("ca"))
        ends = live.join(hub, ["band", "salt"]).where(near).select(F.when(swap, first).otherwise(second).alias("x"), F.when(swap, second).otherwise(first).alias("y"))
        pairs = ends.selectExpr("x.a AS a", "y.a AS b", "x.ca AS ca", "y.ca AS cb").distinct()
        found = checkpoint(_verified(pairs, sets, percent))
        live = live.where(~F.col("pivot")).select("band", "id", "n", "sketch", "c")
        if not found.isEmpty():
            links = found.select("a", "b") if links is None else links.unionAll(found.select("a", "b"))
            hooks = found.select(F.greatest("ca", "cb").alias("c"), F.least("ca", "cb").alias("to")).groupBy("c").agg(F.min("to").alias("to"))
            jump = hooks.select(F.col("c").alias("to"), F.col("to").alias("next"))
            lower = hooks.join(jump, "to", "left").select("c", F.coalesce("next", "to").alias("low"))
            # written at once, as both the bands' state and the next round read it
            live = checkpoint(live.join(lower, "c", "left").select("band", "id", "n", "sketch", F.coalesce("low", "c").alias("c")))
        pivots *= GROWTH
    return components(links) if links is not None else open_.sparkSession.createDataFrame([], "id long, component_id long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent).select("a", "b", "ca", "cb")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of near copies (five-word shingles).

    Null and empty texts and rows with a null id stay; repeated rows of a kept id all stay, and of an id with
    several texts all rows stay or go by the text with the smallest hash; extra columns pass through, whatever their names.
    """
    small_batches(spark)
    gone = near_duplicates(docs, n=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs.doc_id.cast("long") == gone.gone, "left_anti")


#: DuckDB: all pairs of 2-word shingle sets by an inverted list, then reachability.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
cls AS (SELECT list_sort(sh) AS k, min(doc_id) AS id, any_value(len(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 1),
e AS (SELECT id, n, unnest(k) AS g FROM cls),
p AS (SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r(x, y) AS (SELECT id, id FROM cls UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS id, min(y) AS comp FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.comp, s.doc_id) AS component_id, coalesce(c.comp, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN cls ON cls.k = list_sort(s.sh) AND len(s.sh) > 0 LEFT JOIN c ON c.id = cls.id
"""

QUERIES = {"op6_minhash": op6_minhash}
ORACLES = {"op6_minhash": SQL}
