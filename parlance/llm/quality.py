"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text gives ``len(NAMES)`` statistics.  Standardised statistics go through ``WIDTH``
random Fourier features, which approximate a Gaussian kernel.  Each partition sums its part
of the normal equations, the sums meet by cell in one aggregate of a fixed number of cells,
and the driver solves them.  Raw scores of other labelled rows are summed into ``BINS`` bins
and pool-adjacent-violators makes them calibrated probabilities, joined by straight lines.

Rows whose fold (crc32 of the id, modulo 3) is 0 fit the ridge, fold 2 the calibration, fold 1
is held out.  All labelled rows of these folds are used.

Defined results: null and empty texts have the statistics of an empty text and get a score;
null labels are ignored, repeated labels of one document count once (the largest), as do repeated rows of one id and text; without
usable labels every score is 0.5, with labels of one class only it is that class's calibrated
rate; a null doc_id is scored and is not held out.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow, small_batches
from .common import _LOWER, checkpoint, crc_mod, ngram_hashes, span_hashes, table, text_bytes, word_bounds

NAMES = (
    "log_bytes log_words word_length word_length_spread upper digits marks stops commas bangs pipes symbols wide lines line_words "
    "distinct_words top_word repeats distinct_pairs distinct_lines capital_words word_end_marks upper_words short_words"
).split()
WIDTH, RIDGE, BINS, SEED = 192, 1.0, 400, 11
BANDWIDTH = 1.2  # in units of the square root of the number of statistics


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_UPPER, _DIGIT, _STOP, _COMMA, _BANG, _PIPE = _mask(bytes(range(65, 91))), _mask(b"0123456789"), _mask(b".?"), _mask(b",;:"), _mask(b"!"), _mask(b"|")
_SYMBOL, _WIDE = _mask(b"#$%&*+/<=>@[\\]^_`{}~"), _mask(bytes(range(128, 256)))
_MARK = np.clip(_STOP + _COMMA + _BANG + _PIPE + _SYMBOL, 0, 1)
_IS_UPPER, _IS_MARK = _UPPER > 0, _MARK > 0


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, in the order of NAMES."""
    data = text_bytes(text)
    starts, ends = word_bounds(data)
    size, count = max(1, len(data)), max(1, len(starts))
    tally = np.bincount(data, minlength=256)
    lengths = (ends - starts) if len(starts) else np.zeros(1)
    low = _LOWER[data]
    words = span_hashes(low, starts, ends)
    _, times = np.unique(words, return_counts=True)
    pairs = np.unique(ngram_hashes(words, 2))
    breaks = np.concatenate([[-1], np.flatnonzero(data == 10), [len(data)]])
    rows = np.unique(span_hashes(low, breaks[:-1] + 1, breaks[1:]))
    heads = _IS_UPPER[data[starts]] if len(starts) else np.zeros(1)
    tails = _IS_MARK[data[ends - 1]] if len(starts) else np.zeros(1)
    second = _IS_UPPER[data[np.minimum(starts + 1, ends - 1)]] if len(starts) else np.zeros(1)
    return np.array(
        [
            np.log1p(len(data)),
            np.log1p(len(starts)),
            lengths.mean(),
            lengths.std(),
            tally @ _UPPER / size,
            tally @ _DIGIT / size,
            tally @ _MARK / size,
            tally @ _STOP / count,
            tally @ _COMMA / count,
            tally @ _BANG / count,
            tally @ _PIPE / count,
            tally @ _SYMBOL / count,
            tally @ _WIDE / size,
            np.log1p(len(breaks) - 1),
            np.log1p(count / (len(breaks) - 1)),
            len(times) / count,
            (times.max() if len(times) else 0) / count,
            (words[1:] == words[:-1]).sum() / count,
            len(pairs) / count,
            len(rows) / (len(breaks) - 1),
            heads.mean(),
            tails.mean(),
            second.mean(),
            (lengths <= 2).mean(),
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, t, stats array<double>) of documents (doc_id, text); t is a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "t", "stats"])

    return map_arrow(docs, run, "doc_id long, t long, stats array<double>")


class Model:
    """Means, scales, random directions, ridge weights and the calibration curve: a few hundred kB."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, 1 / (BANDWIDTH * np.sqrt(len(NAMES))), (len(NAMES), WIDTH))
        self.phases = rng.uniform(0, 2 * np.pi, WIDTH)
        self.weights = np.zeros(WIDTH + 1)
        self.curve = (np.array([0.5]), np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Fourier features of rows of statistics, and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.hstack([np.sqrt(2 / WIDTH) * np.cos(z), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.curve)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten() if pa.types.is_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks of the best non-decreasing fit (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    table_ = np.array(blocks)
    return table_[:, 0] / table_[:, 2], table_[:, 1] / table_[:, 2]


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from (doc_id, stats) and labels (doc_id, quality); only bounded sums reach the driver."""
    truth = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    fold = crc_mod("doc_id", 3)
    rows = checkpoint(stats.dropDuplicates(["doc_id", "t"]).join(truth, "doc_id").withColumn("fold", fold).where("fold <> 1"))
    width = len(NAMES)
    one = rows.where("fold = 0").agg(*[g(F.col("stats")[i]).alias(f"{k}{i}") for i in range(width) for k, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    value = lambda k: np.array([one[f"{k}{i}"] or 0.0 for i in range(width)])
    model = Model(value("m"), np.maximum(value("s"), 1e-6))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z, y = model.features(_matrix(batch, "stats")), _matrix(batch, "y")
            part = np.hstack([z, y]).T @ z
            total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "value"])

    cells = map_arrow(rows.where("fold = 0").select("stats", "y"), sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    got = cells.toPandas()  # (WIDTH + 2) * (WIDTH + 1) cells at most
    if len(got):
        flat = np.zeros((WIDTH + 2) * (WIDTH + 1))
        flat[got["cell"]] = got["value"]
        grid = flat.reshape(WIDTH + 2, WIDTH + 1)
        penalty = RIDGE * np.eye(WIDTH + 1)
        penalty[-1, -1] = 1e-6
        model.weights = np.linalg.solve(grid[:-1] + penalty, grid[-1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch, "stats"))), batch.column(1)], names=["r", "y"])

    binned = map_arrow(rows.where("fold = 2").select("stats", "y"), raw, "r double, y double")
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("r") + 0.5) * (BINS / 2))))
    bins = binned.groupBy(at.alias("bin")).agg(F.avg("r").alias("r"), F.avg("y").alias("y"), F.count("*").alias("n")).toPandas().sort_values("bin")
    if len(bins):
        model.curve = isotonic(bins["r"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(float))
    return model


def scores(docs: DataFrame, labels: DataFrame, hashed: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from labels of the folds 0 and 2; with ``hashed`` also t, a hash of the text."""
    stats = checkpoint(with_statistics(docs))
    model = fit(stats.where("doc_id is not null"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.clip(model.score(_matrix(batch, "stats")), 0.0, 1.0) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], names=["doc_id", "t", "score"])

    out = map_arrow(stats, run, "doc_id long, t long, score double")
    return out.select("doc_id", *["t"][: int(hashed)], F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the classifier rejects (score under 0.5).

    Null and empty texts are scored like others; a row with a null id stays; repeated rows of one text stay or go
    together, rows of one id and different texts each by their own score; extra columns pass through, whatever their names.
    """
    small_batches(spark)
    rejected = scores(docs, table(spark, sf_dir, "labels"), hashed=True).where("predicted = 0").select(F.col("doc_id").alias("gone"), "t").distinct()
    return docs.join(rejected, (docs.doc_id.cast("long") == rejected.gone) & (F.xxhash64(docs.text.cast("string")) == rejected.t), "left_anti")


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
