"""Sample blocks in bounded batches."""

import io
import wave

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import audio as AU
from parlance.shipping import BATCH_BYTES

SCHEMA = "clip_id string, block_no int, start_sample long, left array<float>, right array<float>"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_wide_blocks_come_in_small_batches(spark):
    """400 blocks of a second are 77 MB; a worker never holds more than a batch of ``BATCH_BYTES`` and its last row, here as doubles."""
    spark.conf.unset(BYTES)
    second = F.array_repeat(F.lit(0.5).cast("float"), 24_000)
    pcm = spark.range(0, 400, 1, 1).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("block_no"), (F.col("id") * 24_000).alias("start_sample"), second.alias("left"), second.alias("right"))
    most, n = AU.block_sums(pcm, ["clip_id"], ["held", "n"], lambda x, y: [x.base.nbytes, len(y)]).agg(F.max("held"), F.sum("n")).first()
    assert n == 400 * 24_000 and most <= 2 * BATCH_BYTES


def test_a_wav_of_blocks_in_any_order(spark):
    spark.conf.unset(BYTES)
    rng = np.random.default_rng(5)
    x = rng.uniform(-1.3, 1.3, (2, 50)).astype(np.float32)
    rows = [("a", k, k * 10, *(side[k * 10 : k * 10 + 10].tolist() for side in x)) for k in (3, 0, 4, 1, 2)] + [("b", 0, 0, [], []), ("b", 1, 0, [0.25], [-1.0])]
    files = {r.clip_id: bytes(r.wav) for r in AU.wav_bytes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert int(spark.conf.get(BYTES).removesuffix("b")) <= BATCH_BYTES
    with wave.open(io.BytesIO(files["a"])) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (2, 2, 24_000, 50)
        got = np.frombuffer(w.readframes(50), "<i2").reshape(-1, 2)
    assert got.T.tolist() == (np.clip(x, -1, AU.FULL) * 32768).round().astype(int).tolist()
    table = spark.createDataFrame(list(files.items()), "path string, content binary")
    sums = {r.path: r for r in AU.read_sums(AU.read_wav(table)).collect()}
    assert [sums["a"].decoded, sums["a"].left_sum, sums["a"].right_sum] == [50, *got.sum(0, dtype=int).tolist()]
    assert (sums["b"].samples, sums["b"].left_sum, sums["b"].right_sum) == (1, 8192, -32768)


def test_overlapping_stems_the_last_by_position_wins(spark):
    spark.conf.unset(BYTES)
    pcm = spark.createDataFrame([("c", 0, 0, [0.0] * 8, [0.0] * 8), ("c", 1, 8, [0.0] * 8, None), ("d", 0, 0, None, None)], SCHEMA)
    stems = [("c", 6, [3.0] * 3, [4.0] * 3), ("c", 4, [1.0] * 4, [2.0] * 4), ("c", 2, [5.0] * 3, [6.0] * 3)]
    stems = spark.createDataFrame(stems, "clip_id string, start_sample long, left array<float>, right array<float>").coalesce(1)
    regions = spark.createDataFrame([("c", 0, 8), ("d", 0, 8)], "clip_id string, start_sample long, end_sample long")
    got = {(r.clip_id, r.block_no): (r.left, r.right) for r in AU.substitute_stems(pcm, stems, regions).collect()}
    assert got == {("c", 0): ([0, 0, 5, 5, 1, 1, 3, 3], [0, 0, 6, 6, 2, 2, 4, 4]), ("c", 1): ([0] * 8, []), ("d", 0): ([], [])}
    assert int(spark.conf.get(BYTES).removesuffix("b")) <= BATCH_BYTES
