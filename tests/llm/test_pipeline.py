"""The pipeline on the smallest tables: its rows against what its stages must have removed."""

import corpus_pipeline
from parlance.llm import decontam, minhash, quality
from parlance.llm.common import table

SF = "/root/testdata/sf0.001"


def test_pipeline_rows(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in rows}
    assert len(kept) == len(rows) and all(len(r.ids) == r.n_tokens for r in rows)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good = {r.doc_id for r in quality.scores(docs, labels).collect() if r.predicted == 1}
    assert kept <= good
    left = docs.where(docs.doc_id.isin(sorted(good)))
    single = {r.doc_id for r in minhash.near_duplicates(left).collect() if r.kept}
    leaks = {r.doc_id for r in decontam.decontaminate(left, table(spark, SF, "benchmark")).collect() if r.contaminated}
    assert kept <= single and single - leaks <= kept


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, gone long, t long, h string"


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9, 8, "x") for i, t in rows], SCHEMA)


def test_minhash_stage_with_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    near = text.replace("w39", "other")
    rows = [(1, text), (2, text), (3, near), (4, None), (5, ""), (None, text), (6, "alone here"), (6, "alone here"), (7, text), (7, " ".join(f"v{k}" for k in range(40)))]
    df = _rows(spark, rows)
    out = minhash.stage(spark, df, SF)
    assert out.columns == df.columns
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    few = {r.doc_id: r.low for r in df.where("doc_id = 7").selectExpr("doc_id", "xxhash64(text) AS low").groupBy("doc_id").agg({"low": "min"}).withColumnRenamed("min(low)", "low").collect()}
    copy_counts = few[7] == df.where("doc_id = 1").selectExpr("xxhash64(text) AS h").first().h
    assert kept == sorted([-1, 1, 4, 5, 6, 6, *([] if copy_counts else [7, 7])])
    assert minhash.stage(spark, df.limit(0), SF).count() == 0


def test_quality_stage_with_odd_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = _rows(spark, [(10**9, None), (10**9 + 1, ""), (None, "!!! $$$ ###"), (10**9 + 2, "long " * 30_000)])
    both = docs.unionByName(odd, allowMissingColumns=True)
    both = both.unionByName(both.limit(3))
    out = quality.stage(spark, both, SF)
    assert out.columns == both.columns
    left = {r.doc_id for r in out.select("doc_id").collect()}
    bad = {r.doc_id for r in quality.scores(both, labels).collect() if r.predicted == 0 and r.doc_id is not None}
    assert None in left and left == {r.doc_id for r in both.select("doc_id").collect()} - bad
    assert quality.stage(spark, both.limit(0), SF).count() == 0


def test_stages_ask_for_small_batches(spark):
    """Whole texts reach the workers 1000 rows at a time, so that neither side holds tens of MB of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        if stage is decontam.stage:  # no Python
            continue
        spark.conf.set(name, "10000")
        assert stage(spark, docs, SF).columns and 0 < int(spark.conf.get(name)) <= 1000
    spark.conf.set(name, "64")
    corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert spark.conf.get(name) == "64"
