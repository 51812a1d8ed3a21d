"""Language identification: a byte convolutional network, trained in numpy.

Filters of ``WIDTHS`` bytes slide over windows of ``WINDOW`` bytes; the largest answer of each
filter goes through a rectifier to a softmax layer.  A filter of w bytes is w tables of 256
rows, one for each byte of its span, so a window's answers are sums of looked-up rows; for
prediction the tables of two neighbouring bytes are added beforehand.  The whole text is cut
into windows that overlap by the widest filter less one byte; a text's probabilities are
its windows' mean, weighted by their bytes.

Training takes at most ``SAMPLE`` labelled documents, spread evenly over the languages, chosen
by a hash of the id, and ``CUTS`` windows of each.  Documents of fold 0 (crc32 of the id modulo 5) are held out.

Defined results: null texts and texts without a letter are ``und`` with score 0; null
languages and null ids teach nothing; without labelled rows everything is ``und``; a null id
is not held out; repeated rows are predicted each.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import crc_mod, mix, table, text_bytes

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
SAMPLE, CUTS, EPOCHS, BATCH, RATE = 3000, 4, 4, 128, 0.01
STEP = WINDOW - max(WIDTHS) + 1
PAD = 0  # the byte that fills short windows


class Net:
    """Tables of the filters (8 kB each byte of a width), and the softmax layer."""

    def __init__(self, classes: list[str]):
        rng = np.random.default_rng(3)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.shift = np.zeros(len(classes), np.float32)
        self.joined: list | None = None

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.bias, self.out, self.shift]

    def answers(self, x: np.ndarray, k: int) -> np.ndarray:
        """(windows, places, filters) of the k-th width, by the byte tables."""
        w = WIDTHS[k]
        last = x.shape[1] - w + 1
        total = self.tables[k][0][x[:, :last]]
        for j in range(1, w):
            total += self.tables[k][j][x[:, j : j + last]]
        return total

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest answers of all filters, for prediction: pairs of bytes are looked up at once."""
        if self.joined is None:
            self.joined = [[(t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in self.tables]
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        found = []
        for k, w in enumerate(WIDTHS):
            last = x.shape[1] - w + 1
            total = np.take(self.joined[k][0], pair[:, :last], axis=0)
            if w == 3:
                total += np.take(self.joined[k][1], x[:, 2 : 2 + last], axis=0)
            elif w == 4:
                total += np.take(self.joined[k][1], pair[:, 2 : 2 + last], axis=0)
            found.append(total.max(axis=1) + self.bias[k])
        return np.maximum(np.hstack(found), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(5)
        means = [np.zeros_like(p) for p in self.parameters()]
        squares = [np.zeros_like(p) for p in self.parameters()]
        turn = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                grads = self._gradients(x[rows], y[rows])
                turn += 1
                for p, g, m, s in zip(self.parameters(), grads, means, squares):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)
        self.joined = None

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, lanes = len(x), np.arange(len(x))[:, None]
        places, tops = [], []
        for k in range(len(WIDTHS)):
            a = self.answers(x, k)
            best = a.argmax(axis=1)
            places.append(best)
            tops.append(np.take_along_axis(a, best[:, None], 1)[:, 0] + self.bias[k])
        h = np.maximum(np.hstack(tops), 0)
        z = h @ self.out + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), y] -= 1
        z /= n
        back = (z @ self.out.T) * (h > 0)
        tables, biases = [], []
        for k, w in enumerate(WIDTHS):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            g = np.zeros_like(self.tables[k])
            for j in range(w):
                np.add.at(g[j], (x[lanes, places[k] + j], np.arange(FILTERS)[None]), part)
            tables.append(g)
            biases.append(part.sum(axis=0))
        return [*tables, *biases, h.T @ z, z.sum(axis=0)]


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text's bytes, the last one filled up, and the bytes of each."""
    count = max(1, -(-(len(data) - WINDOW + STEP) // STEP)) if len(data) > WINDOW else 1
    size = STEP * (count - 1) + WINDOW
    whole = np.full(size, PAD, np.uint8)
    whole[: len(data)] = data
    weight = np.full(count, WINDOW, float)
    weight[-1] = max(1, len(data) - STEP * (count - 1))
    return np.lib.stride_tricks.sliding_window_view(whole, WINDOW)[::STEP], weight


def train(docs: DataFrame) -> Net | None:
    """A network from the labelled documents outside fold 0."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    classes = sorted(counts)
    each = SAMPLE / len(classes)
    share = F.create_map(*[F.lit(v) for c in classes for v in (c, min(1.0, each / counts[c]))])
    draw = (F.xxhash64("doc_id", F.lit("sample")) / F.lit(2.0**64)) + 0.5
    chosen = usable.where(F.col("text").rlike(r"\p{L}")).where(draw < share[F.col("lang")]).select("doc_id", "text", "lang")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, langs = [], []
            for doc, text, lang in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text_bytes(text.as_py())
                luck = mix(np.arange(2 * CUTS, dtype=np.uint64) + np.uint64(doc & 0x7FFFFFFFFFFF))
                for k in range(CUTS):
                    at = int(luck[2 * k] % np.uint64(max(1, len(data) - WINDOW + 1)))
                    size = WINDOW if k else 24 + int(luck[2 * k + 1] % np.uint64(WINDOW - 24))  # short ones too
                    windows.append(data[at : at + size].tobytes().ljust(WINDOW, b"\0"))
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(langs, pa.string())], names=["w", "lang"])

    got = map_arrow(chosen, pick, "w binary, lang string").limit(4 * SAMPLE * CUTS).toPandas().sort_values(["lang", "w"])
    if not len(got):
        return None
    net = Net(classes)
    x = np.frombuffer(b"".join(got["w"]), np.uint8).reshape(-1, WINDOW)
    net.train(x, np.array([classes.index(v) for v in got["lang"]]))
    return net


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for k in range(0, batch.num_rows, 64):
                texts = [v.as_py() for v in batch.column(1).slice(k, 64)]
                for text in texts:
                    if net is None or not text or not any(map(str.isalpha, text)):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    x, weight = cut(text_bytes(text))
                    total = np.zeros(len(net.classes))
                    for a in range(0, len(x), 64):  # bounded memory for very long texts
                        total += weight[a : a + 64] @ net.probabilities(x[a : a + 64])
                    total /= weight.sum()
                    langs.append(net.classes[int(total.argmax())])
                    scores.append(float(min(1.0, total.max())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op3_langid": op3_langid}
ORACLES: dict[str, str] = {}
