"""Sample blocks: level figures, leakage, peaks, stereo routing, fades; WAV files in and out.

PCM is a table (clip_id, block_no, start_sample, left ARRAY<FLOAT>, right ARRAY<FLOAT>) of blocks of
bounded size; figures are partial sums by block that meet by clip.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship, small_batches
from .intervals import E, S, range_join

BLOCK = 24_000
FULL = 32767 / 32768


def places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ranges of so many numbers from each first one, in a row."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of lists; a null list is empty."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])


def block_sums(blocks: DataFrame, keys: list[str], names: list[str], figures: Callable[[np.ndarray, np.ndarray], list[float]]) -> DataFrame:
    """(keys, names): figures of the left and right samples of each block; numpy over Arrow's own buffers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in batch.columns[-2:]:
                flat, edges = _flat(column)
                sides.append((flat.astype(np.float64), edges))
            (left, at), (right, to) = sides
            rows = [figures(left[at[k] : at[k + 1]], right[to[k] : to[k + 1]]) for k in range(batch.num_rows)]
            columns = np.array(rows, np.float64).reshape(batch.num_rows, len(names)).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(c) for c in columns)], names=[*keys, *names])

    small_batches(blocks.sparkSession)
    kinds = [f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} double" for n in names]
    return map_arrow(blocks.select(*keys, "left", "right"), run, ", ".join(kinds))


def _top(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if len(x) else 0.0


def _db(level: Column) -> Column:
    return F.when(level > 0, 20 * F.log10(level)).otherwise(F.lit(float("-inf")))


def channel_figures(pcm: DataFrame, key: str = "clip_id", silence_db: float = -50.0) -> DataFrame:
    """RMS, dBFS, peak, clipping and silence ratio of both channels of each clip."""
    floor = 10 ** (silence_db / 20)
    each = ("n", "q", "peak", "c", "s")

    def figures(left: np.ndarray, right: np.ndarray) -> list[float]:
        return [v for x in (left, right) for v in (len(x), x @ x, _top(x), (np.abs(x) >= FULL).sum(), (np.abs(x) <= floor).sum())]

    sums = block_sums(pcm, [key], [f"{side}_{e}" for side in ("left", "right") for e in each], figures)
    total = sums.groupBy(key).agg(*[(F.max if e == "peak" else F.sum)(f"{side}_{e}").alias(f"{side}_{e}") for side in ("left", "right") for e in each])
    final = []
    for side in ("left", "right"):
        n, c = F.col(f"{side}_n"), lambda e, side=side: F.col(f"{side}_{e}")
        rms = F.when(n > 0, F.sqrt(c("q") / n)).otherwise(0.0)
        final += [rms.alias(f"{side}_rms"), _db(rms).alias(f"{side}_dbfs"), c("peak").alias(f"{side}_peak")]
        final += [F.when(n > 0, c("c") / n).otherwise(0.0).alias(f"{side}_clipping"), F.when(n > 0, c("s") / n).otherwise(1.0).alias(f"{side}_silence")]
    return total.select(key, *final)


def read_intervals(pcm: DataFrame, asked: DataFrame, key: str = "clip_id") -> DataFrame:
    """Pieces (key, asked's other columns, start_sample, left, right) of the blocks inside asked intervals (key, ..., start_sample, end_sample)."""
    other = [c for c in asked.columns if c not in (key, S, E)]
    blocks = pcm.select(key, F.col(S).alias("b0"), S, (F.col(S) + F.size("left")).alias(E), "left", "right")
    met = range_join(blocks, asked, [key], width=BLOCK)
    at, count = (F.greatest(F.lit(0), F.col("r_start") - F.col("b0")) + 1).cast("int"), F.greatest(F.lit(0), F.least(E, "r_end") - F.greatest("b0", "r_start")).cast("int")
    return met.select(key, *other, F.greatest("b0", "r_start").alias(S), F.slice("left", at, count).alias("left"), F.slice("right", at, count).alias("right"))


def interval_reads(pcm: DataFrame, asked: DataFrame, key: str = "clip_id") -> DataFrame:
    """(asked's columns, decoded, left_sum, right_sum, problem): what was read of each interval; an impossible or short one has a problem.

    Intervals (key, interval_id, start_sample, end_sample) are told apart by key and interval_id.
    """
    ids = [key, "interval_id"]
    sums = block_sums(read_intervals(pcm, asked, key), ids, ["n", "ls", "rs"], lambda x, y: [len(x), x.sum(), y.sum()])
    total = sums.groupBy(*ids).agg(F.sum("n").cast("long").alias("decoded"), F.sum("ls").alias("left_sum"), F.sum("rs").alias("right_sum"))
    df = asked.join(total, ids, "left").na.fill(0, ["decoded", "left_sum", "right_sum"])
    possible = F.coalesce((F.col(S) >= 0) & (F.col(E) > F.col(S)), F.lit(False))
    return df.withColumn("problem", F.when(~possible, "invalid_interval").when(F.col("decoded") < F.col(E) - F.col(S), "short_read"))


def substitute_stems(pcm: DataFrame, stems: DataFrame, regions: DataFrame, key: str = "clip_id") -> DataFrame:
    """Blocks with the samples of recovered stems (key, start_sample, left, right) inside the regions (key, start_sample, end_sample, merged).

    A block meets only the pieces that lie in it, so a row holds at most a block and its pieces.
    """
    from .intervals import merge_intervals

    pieces = read_intervals(stems, merge_intervals(regions, [key]), key)
    pieces = pieces.select(key, S, (F.col(S) + F.size("left")).alias(E), F.struct(F.col(S).alias("at"), "left", "right").alias("piece"))
    met = range_join(pcm.select(key, "block_no", S, (F.col(S) + F.size("left")).alias(E)), pieces, [key], width=BLOCK)
    joined = pcm.select(key, "block_no", S, "left", "right").join(met.groupBy(key, "block_no").agg(F.collect_list("piece").alias("pieces")), [key, "block_no"], "left")

    small_batches(pcm.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, found = batch.column(2).to_numpy(zero_copy_only=False), batch.column(5)
            block = np.repeat(np.arange(batch.num_rows), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at, *news = found.flatten().flatten()  # of structs: a column for each field
            at, new_edges = at.to_numpy(zero_copy_only=False), _flat(news[0])[1]
            length = np.diff(_flat(batch.column(3))[1])
            lo = np.maximum(start[block], at)
            count = np.maximum(0, np.minimum(start[block] + length[block], at + np.diff(new_edges)) - lo)
            order = np.lexsort((at, block))  # of pieces that overlap the last by position wins
            sides = []
            for column, new in zip((3, 4), news):
                values, edges = _flat(batch.column(column))
                values, pieces = values.astype(np.float32), _flat(new)
                values[places((edges[block] + lo - start[block])[order], count[order])] = pieces[0][places((pieces[1][:-1] + lo - at)[order], count[order])]
                sides.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *sides], names=[key, "block_no", S, "left", "right"])

    kind = lambda c: pcm.schema[c].dataType.simpleString()
    return map_arrow(joined, run, f"`{key}` {kind(key)}, block_no {kind('block_no')}, {S} {kind(S)}, left array<float>, right array<float>")


def masked_energy(pcm: DataFrame, masks: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, role, left_energy, right_energy, n): mean squares inside the role's intervals (key, role, start_sample, end_sample, merged).

    Blocks meet the intervals through time bins, so a long clip with many intervals is many keys.
    """
    cut = read_intervals(pcm, masks.select(key, "role", S, E), key)
    sums = block_sums(cut, [key, "role"], ["n", "lq", "rq"], lambda x, y: [len(x), x @ x, y @ y])
    total = sums.groupBy(key, "role").agg(*[F.sum(c).alias(c) for c in ("n", "lq", "rq")])
    return total.select(key, "role", (F.col("lq") / F.col("n")).alias("left_energy"), (F.col("rq") / F.col("n")).alias("right_energy"), F.col("n").cast("long").alias("n"))


def leakage(energies: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, right_leakage, left_leakage, swapped): energy of the wrong channel against the right one, by role."""
    value = lambda role, side: F.coalesce(F.max(F.when(F.col("role") == role, F.col(f"{side}_energy"))), F.lit(0.0))
    df = energies.groupBy(key).agg(value("assistant", "left").alias("al"), value("assistant", "right").alias("ar"), value("user", "left").alias("ul"), value("user", "right").alias("ur"))
    eps = 1e-12
    return df.select(
        key, (F.col("ar") / (F.col("al") + eps)).alias("right_leakage"), (F.col("ul") / (F.col("ur") + eps)).alias("left_leakage"),
        ((F.col("ar") > F.col("al") + eps) & (F.col("ul") > F.col("ur") + eps)).alias("swapped"),
    )


def peaks(pcm: DataFrame, points: int = 4000, key: str = "clip_id") -> DataFrame:
    """(key, block, low, high): smallest and largest left sample of each of at most ``points`` stretches, to six places."""
    total = pcm.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("left")) / points)).alias("width"))
    # a block is cut at the stretches' bounds, and only the cuts' extremes go on
    cut = pcm.join(total, key).where(F.size("left") > 0).select(key, "width", "start_sample", "left", F.explode(F.sequence(F.floor(F.col("start_sample") / F.col("width")), F.floor((F.col("start_sample") + F.size("left") - 1) / F.col("width")))).alias("block"))
    lo = F.greatest(F.lit(0), F.col("block") * F.col("width") - F.col("start_sample"))
    hi = F.least(F.size("left"), (F.col("block") + 1) * F.col("width") - F.col("start_sample"))
    part = F.slice("left", (lo + 1).cast("int"), (hi - lo).cast("int"))
    grouped = cut.select(key, "block", F.array_min(part).alias("a"), F.array_max(part).alias("b")).groupBy(key, "block")
    return grouped.agg(F.round(F.min("a").cast("double"), 6).alias("low"), F.round(F.max("b").cast("double"), 6).alias("high"))


def stereo_probe(pcm: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, dual_mono, clipping): the difference at least 30 dB under the programme or silent; a peak of -0.01 dB or more."""

    def figures(left: np.ndarray, right: np.ndarray) -> list[float]:
        return [len(left), ((left - right) ** 2).sum(), (((left + right) / 2) ** 2).sum(), max(_top(left), _top(right))]

    sums = block_sums(pcm, [key], ["n", "d", "p", "peak"], figures)
    df = sums.groupBy(key).agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("p").alias("p"), F.max("peak").alias("peak"))
    level = lambda c: F.sqrt(F.col(c) / F.col("n"))
    mono = (F.col("d") == 0) | (_db(level("d")) - _db(level("p")) <= -30)
    return df.select(key, mono.alias("dual_mono"), (F.coalesce(_db(F.col("peak")), F.lit(float("-inf"))) >= -0.01).alias("clipping"))


def route_stereo(mono: DataFrame, turns: DataFrame, muted: DataFrame, fade: int = 240, key: str = "clip_id") -> DataFrame:
    """Blocks (key, block_no, start_sample, left, right) from mono blocks (samples): A to the left, B to the right.

    Turns (key, speaker, start_sample, end_sample) are merged runs without overlap and without the
    muted intervals; each run fades in and out linearly over min(fade, half its length) samples.
    """
    from .intervals import complement, merge_intervals

    runs = merge_intervals(turns, [key, "speaker"])
    frame = runs.groupBy(key, "speaker").agg(F.min(S).alias(S), F.max(E).alias(E))
    cut = muted.select(key, S, E).join(frame.select(key, "speaker"), key)
    holes = complement(runs.unionByName(cut.select(key, "speaker", S, E)), frame, [key, "speaker"])
    solid = complement(holes.unionByName(cut.select(key, "speaker", S, E)), frame, [key, "speaker"])
    # a block meets the runs that touch it only
    extents = mono.select(key, "block_no", S, (F.col(S) + F.size("samples")).alias(E))
    met = range_join(extents, solid, [key]).select(key, "block_no", F.struct("speaker", F.col("r_start").alias(S), F.col("r_end").alias(E)).alias("run"))
    table = met.groupBy(key, "block_no").agg(F.collect_list("run").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for start, samples, spans in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                x = np.asarray(samples, np.float32)
                gains = {"A": np.zeros(len(x), np.float32), "B": np.zeros(len(x), np.float32)}
                for span in spans or []:
                    a, b = span[S], span[E]
                    lo, hi = max(a, start), min(b, start + len(x))
                    if lo < hi:
                        width, place = min(fade, (b - a) // 2), np.arange(lo - a, hi - a)
                        ramp = np.minimum(place, b - a - 1 - place) / max(1, width - 1) if width > 0 else np.ones(hi - lo)
                        gains[span["speaker"]][lo - start : hi - start] = np.clip(ramp, 0, 1)
                left.append(x * gains["A"])
                right.append(x * gains["B"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(left, pa.list_(pa.float32())), pa.array(right, pa.list_(pa.float32()))], names=[key, "block_no", "start_sample", "left", "right"])

    joined = mono.join(table, [key, "block_no"], "left").select(F.col(key).cast("string").alias(key), F.col("block_no").cast("int").alias("block_no"), F.col("start_sample").cast("long").alias("start_sample"), "samples", "runs")
    return map_arrow(joined, run, f"{key} string, block_no int, start_sample long, left array<float>, right array<float>")


def read_wav(files: DataFrame) -> DataFrame:
    """(path, sample_rate, channels, samples, block_no, start_sample, left, right) of binary files (path, content), PCM of 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sample_rate", "channels", "samples", "block_no", "start_sample", "left", "right"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float32())]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with wave.open(io.BytesIO(content.as_py())) as w:
                    rate, channels, total = w.getframerate(), w.getnchannels(), w.getnframes()
                    for no, start in enumerate(range(0, max(1, total), BLOCK)):
                        x = np.frombuffer(w.readframes(BLOCK), "<i2").reshape(-1, channels).astype(np.float32) / 32768
                        row = [path, rate, channels, total, no, start, x[:, 0], x[:, -1]]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    small_batches(files.sparkSession)
    return map_arrow(files.select("path", "content"), run, "path string, sample_rate int, channels int, samples long, block_no int, start_sample long, left array<float>, right array<float>")


def wav_bytes(pcm: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, wav): a stereo PCM-16 file of each clip's blocks; a clip is bounded by its length, 100 s."""

    ship(pcm.sparkSession)
    small_batches(pcm.sparkSession)

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block_no")
        left, right = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("left", "right"))
        x = np.empty((len(left), 2), "<i2")
        for column, side in enumerate((left, right)):
            x[:, column] = (np.clip(side, -1, FULL) * 32768).round()
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(24_000)
            w.writeframes(x.tobytes())
        return pa.table({key: rows[key].slice(0, 1).cast(pa.string()), "wav": pa.array([out.getvalue()], pa.binary())})

    return pcm.select(key, "block_no", "left", "right").groupBy(key).applyInArrow(build, f"{key} string, wav binary")


def read_sums(blocks: DataFrame) -> DataFrame:
    """(path, sample_rate, channels, samples, duration, decoded, left_sum, right_sum) of what ``read_wav`` returns, in one pass; sums in steps of 16 bits."""
    of = ["path", "sample_rate", "channels", "samples"]
    sums = block_sums(blocks, of, ["n", "ls", "rs"], lambda x, y: [len(x), x.sum() * 32768, y.sum() * 32768])
    total = sums.groupBy(*of).agg(*[F.sum(c).cast("long").alias(name) for c, name in (("n", "decoded"), ("ls", "left_sum"), ("rs", "right_sum"))])
    return total.select(*of, (F.col("samples") / F.col("sample_rate")).alias("duration"), "decoded", "left_sum", "right_sum")


def headers(blocks: DataFrame) -> DataFrame:
    """(path, sample_rate, channels, samples, duration, decoded) of what ``read_wav`` returns."""
    per = blocks.groupBy("path", "sample_rate", "channels", "samples").agg(F.sum(F.size("left")).alias("decoded"))
    return per.select("path", "sample_rate", "channels", "samples", (F.col("samples") / F.col("sample_rate")).alias("duration"), "decoded")


def file_digests(files: DataFrame, edge: int = 1 << 20) -> DataFrame:
    """(path, size, sha256, edges): digests of whole contents and of their first and last MiB (``edge`` bytes); contents of one MiB at most are their own edges."""
    edge = F.when(F.length("content") > edge, F.concat(F.substring("content", 1, edge), F.expr(f"substring(content, length(content) - {edge} + 1, {edge})"))).otherwise(F.col("content"))
    return files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.sha2(edge, 256).alias("edges"))
