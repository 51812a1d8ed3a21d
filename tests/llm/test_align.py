"""Alignment of two vocabularies against the definition, token by token."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parlance.llm import align

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, pairs string, n long"


def _definition(texts):
    """The contract's figures from whole texts, with plain loops."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    rows, count = [], Counter()
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in ids_b]
        if t and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a = {sum(map(len, bytes_a[: k + 1])): k for k in range(len(ids_a))}
        ends_b = {sum(map(len, bytes_b[: k + 1])): k for k in range(len(ids_b))}
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            x, y = ends_a[end], ends_b[end]
            groups.append(",".join(map(str, ids_a[i : x + 1])) + "|" + ",".join(map(str, ids_b[j : y + 1])))
            links.append((ids_a[x], ids_b[y]))
            i, j = x + 1, y + 1
        count.update(links)
        rows.append((len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(x, y, len(ls), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), d) for x, y, ls, d in rows]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    parts = ["foo", "Bar", "é", "12", "'s", ".", " ", "\n", "  ", "\t", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "▁", "日本", "\r\n", "🙂", "́", "ﬁ", "\x00", "the", " of", "x" * 90]
    odd = [None, "", " ", "\n", "a", " a", "a ", "a  b", "the of the of", "the of the of", "long words " * 3000]
    return odd + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(400)]


def test_against_the_definition(spark, texts):
    rows = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align.alignment(rows, *PATHS).collect()}
    want = _definition(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[0] == 0 for w in want) > 3 and sum(w[4] < w[3] for w in want) > 3


def test_repeats_null_ids_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(align, "CACHE", 1)
    rows = spark.createDataFrame([(1, "to be", "x", 1), (1, "to be", "x", 1), (None, "to be", "x", 1), (2, None, "x", 1)], SCHEMA)
    got = align.alignment(rows, *PATHS).collect()
    assert sorted((str(r.doc_id), r.n_links, r.n_best, r.count_sum) for r in got) == [("1", 2, 2, 6), ("1", 2, 2, 6), ("2", 0, 0, 0), ("None", 2, 2, 6)]
    assert align.alignment(rows.limit(0), *PATHS).count() == 0


def test_pairs_are_bounded_by_the_vocabularies():
    with open(PATHS[0], encoding="utf-8") as f, open(PATHS[1], "rb") as g:
        aligner = align.Aligner(f.read(), g.read(), PATHS[2])
    a, b = (x.to_pylist() for x in aligner.bytes)
    ends = set(b)
    pairs = sum(x[k:] in ends for x in a for k in range(len(x))) + sum(len(x) for x in b)
    assert pairs <= aligner.pair_bound() < 1 << 20 and aligner.b.alone


def test_batches_are_small_and_many_links_meet_the_counts_in_parts(spark):
    """One partition with more links than ``PART``: Spark hands over 1000 rows at most, and the sums are those of the definition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    some = ["the of the " * 240, "foo bar " * 180 + "end", "to be"]
    rows = spark.createDataFrame([(k, some[k % 3], "x", 1) for k in range(2400)], SCHEMA).coalesce(1)
    got = align.alignment(rows, *PATHS).collect()
    assert int(spark.conf.get(name)) <= 1000
    want = _definition(some)
    assert sum(r.n_links for r in got) > 2 * align.PART and len(got) == 2400
    for r in got:
        *same, total, digest = want[r.doc_id % 3]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*same[:4], digest) and r.count_sum == 800 * total
