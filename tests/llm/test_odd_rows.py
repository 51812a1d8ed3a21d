"""Odd rows, empty tables and clashing names of the corpus operators; models against independent forms."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from parlance.llm import bpe, langid, quality, warc

SCHEMA = "doc_id long, text string, lang string, score double, t long, held_out boolean, stats int, digest string"


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, lang, 9.0, 1, None, 2, "d") for i, t, lang in rows], SCHEMA)


def _text(rng, letters, n=40):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def test_langid_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, _text(rng, "abcd" if k % 2 else "wxyz"), "en" if k % 2 else "fr") for k in range(60)]
    rows += [(1, rows[1][1], "en"), (1, rows[1][1], "en"), (None, "abcd abcd abdc", "en"), (901, None, "fr"), (902, "12 .. !", None), (903, "", ""), (904, "abcd " * 30_000, None)]
    got = langid.identify(_rows(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in got}
    assert [of[k][0] for k in (901, 902, 903)] == ["und"] * 3 and [of[k][1] for k in (901, 902, 903)] == [0.0] * 3
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1 and of[None][2] is False
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(of[k][0] == ("en" if k % 2 else "fr") for k in range(60)) > 55 and of[904][0] == "en"
    assert langid.identify(_rows(spark, [])).count() == 0
    unlabelled = langid.identify(_rows(spark, [(1, "abc", None)])).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)


def test_langid_network_by_loops():
    """Filters slid over one-hot bytes, largest answers, softmax; windows weighted by their bytes."""
    net, rng = langid.Net(["a", "b", "c"]), np.random.default_rng(0)
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    want = []
    for row in x:
        hot = np.eye(256)[row]
        pooled = []
        for table, bias in zip(net.tables, net.bias):
            w = len(table)
            answers = np.array([sum(hot[p + j] @ table[j].astype(float) for j in range(w)) for p in range(len(row) - w + 1)])
            pooled.append(np.maximum(answers.max(axis=0) + bias, 0))
        z = np.concatenate(pooled) @ net.out + net.shift
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert net.probabilities(x) == pytest.approx(np.array(want), abs=1e-5)


def test_quality_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, _text(rng, "abcdefgh", 60) + "." if k % 2 else "$$$ " * 20 + _text(rng, "ab", 3), "en") for k in range(90)]
    rows += [(1, rows[1][1], "en"), (None, rows[1][1], "en"), (800, None, None), (801, "", None)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(90)] + [(3, 0, 0), (None, 1, 0), (5000, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scores(_rows(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    held = [r for r in got if r.held_out and r.doc_id < 90]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held) and sum(r.predicted == r.doc_id % 2 for r in held) > 0.9 * len(held)
    assert quality.scores(_rows(spark, []), labels).count() == 0
    assert {r.predicted for r in quality.scores(_rows(spark, rows[:4]), labels.limit(0)).collect()} <= {0, 1}


def test_quality_model_by_its_formulas():
    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(size=len(quality.NAMES)), rng.uniform(1, 2, len(quality.NAMES)))
    model.weights = rng.normal(size=quality.WIDTH + 1)
    stats = rng.normal(size=(7, len(quality.NAMES)))
    for row, value in zip(stats, model.raw(stats)):
        z = [max(-6.0, min(6.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale)]
        want = model.weights[-1] + sum(w * np.sqrt(2 / quality.WIDTH) * np.cos(sum(a * b for a, b in zip(z, model.directions[:, k])) + model.phases[k]) for k, w in enumerate(model.weights[:-1]))
        assert value == pytest.approx(want)


def test_isotonic_fit_is_the_best():
    """Min-max formula of isotonic regression at each point, ties and weights included."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 12))
        x, y, w = np.arange(n, dtype=float), rng.integers(0, 4, n).astype(float), rng.integers(1, 4, n).astype(float)
        mean = lambda a, b, y=y, w=w: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        centres, values = quality.isotonic(x, y, w)
        assert sorted(set(np.round(want, 9))) == sorted(set(np.round(values, 9))) and (np.diff(values) > 0).all() and (np.diff(centres) > 0).all()


def test_bpe_odd_rows(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "foo bar", "x"), (1, "foo bar", "x"), (None, "é", "x"), (2, None, "x"), (3, "", "x")]
    got = bpe.encode_and_decode(_rows(spark, rows), path, public_tokenizers.PATTERN, with_ids=True).collect()
    want = [(i, library.encode_ordinary(t or "")) for i, t, _ in rows]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), ids) for i, ids in want)
    assert {r.decoded_sha256 for r in got if r.doc_id in (2, 3)} == {hashlib.sha256(b"").hexdigest()} and all(r.n_tokens == len(r.ids) for r in got)
    staged = bpe.stage(spark, _rows(spark, rows), "")
    assert sorted(staged.columns) == ["decoded_sha256", "doc_id", "ids", "ids_sha256", "n_tokens"] and staged.count() == len(rows)
    assert bpe.stage(spark, _rows(spark, []), "").count() == 0


def test_warc_odd_rows(spark, tmp_path):
    schema = "page_id long, url string, html string, digest string, record_type string, payload string"
    long = "<p>" + "x" * 2000
    rows = [(1, "u", long), (2, "u", long), (2, "u", long), (3, None, None), (4, "u", "short"), (5, "u", "short"), (6, "u", "é" * 500)]
    for k, some in enumerate((rows, [])):
        pages = spark.createDataFrame([(*r, "d", "r", "p") for r in some], schema)
        folder = str(tmp_path / str(k))
        out = warc.read_archives(warc.write_archives(warc.with_types(pages), folder, warc.train_dictionary(pages)), folder).collect()
        got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
        assert len(got) == len(some)
        for page, size, digest, kind, refers in got:
            html = next(h or "" for p, _, h in some if p == page).encode()
            assert (size, digest) == (len(html), hashlib.sha1(html).hexdigest())
            assert (kind, refers) == (("revisit", 2) if page == 1 else ("response", None))


def test_bpe_trees_and_forgetting(monkeypatch):
    """Matches of every length up to the long ones, of random bytes too, against the library; a worker that forgets after each batch."""
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        lines = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.Encoder(lines, public_tokenizers.PATTERN), np.random.default_rng(8)
    letters = list("aeinorst" * 3 + "zéñß日本語ж")
    words = ["".join(rng.choice(letters, n)) for n in [*range(1, 70), *rng.integers(2, 20, 9000)]]
    pairs = rng.permutation(len(coder.ranks.keys))[:2000]
    a, b = coder.ranks.keys[pairs] >> 20, coder.ranks.keys[pairs] & (1 << 20) - 1
    assert (coder.ranks.of_pairs(a, b)[a >= 0] == coder.ranks.ranks[pairs][a >= 0]).all() and (coder.ranks.of_pairs(np.full(5, -1), np.arange(5)) == bpe.NONE).all()
    monkeypatch.setattr(bpe, "CACHE", 100)
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)] + ["", "a"]
    for k in range(0, len(texts), 40):
        ids = coder.encode(texts[k : k + 40])
        assert ids.to_pylist() == [library.encode_ordinary(t) for t in texts[k : k + 40]]
        assert list(coder.joined(ids, coder.bytes, b"")) == [hashlib.sha256(t.encode()).hexdigest() for t in texts[k : k + 40]]
        assert len(coder.place) == len(coder.sizes)


def test_bpe_worker_keeps_numbers_not_lists():
    """What a worker remembers of a match is one number: 100,000 matches stay under 40 MB."""
    import tracemalloc

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        coder = bpe.Encoder(f.read(), public_tokenizers.PATTERN)
    texts = [" ".join(f"w{k}x{i}" for i in range(500)) for k in range(100)]
    tracemalloc.start()
    coder.encode(texts)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 40e6 and isinstance(next(iter(coder.place.values())), int)
