"""Words of the token files against whole texts through the library; the coder's round trip at its edges."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parlance.llm import tokenbin

PARTS = ["foo", "Bar", "é", "12", "'s", ".", " ", "\n", "  ", "\n\n", "\t", " ", "\x1c", "　", "<|endoftext|>", "<|", "日本", "\r\n", "!?", "_", "́", "x" * 80]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_give_the_ids_of_whole_texts(library, monkeypatch):
    monkeypatch.setattr(tokenbin, "CACHE", 40)  # forgets often
    words, rng = tokenbin.Words(library, public_tokenizers.PATTERN), random.Random(3)
    texts = ["", " ", "\n", "a", "a\n\nb", "a \nb", "a\n b", "a\n \nb", "a ", "a\n"] + ["".join(rng.choices(PARTS, k=rng.randint(1, 12))) for _ in range(3000)]
    for text, ids in zip(texts, words.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("count", [1, 2, 63, 64, 65, 129, 4097, 200_000])
@pytest.mark.parametrize("kind", ["one id", "two ids", "all ids", "text"])
def test_blocks_round_trip(count, kind):
    rng = np.random.default_rng(count)
    top = {"one id": 1, "two ids": 2, "all ids": tokenbin.IDS, "text": 500}[kind]
    ids = (rng.integers(0, top, count) if kind != "text" else np.minimum(rng.zipf(1.3, count), tokenbin.IDS - 1)).astype(np.uint32)
    ids[-1] = tokenbin.IDS - 1
    assert (tokenbin.decode_block(tokenbin.encode_block(ids), count) == ids).all()


def test_contexts_earn_their_place(library):
    """Half a bit an id less than the entropy of the ids' own frequencies, which no order-0 coder with a fixed table goes below."""
    import duckdb

    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    ids = np.concatenate([np.array([*e.ids, 0], np.uint32) for e in library.encode_batch(texts, add_special_tokens=False)])
    share = np.bincount(ids)
    share = share[share > 0] / len(ids)
    coded = sum(len(tokenbin.encode_block(ids[k : k + tokenbin.BLOCK])) for k in range(0, len(ids), tokenbin.BLOCK))
    assert 8 * coded / len(ids) < -(share * np.log2(share)).sum() - 0.5


def test_odd_rows(spark, tmp_path):
    """Null ids come first, repeated rows stay, null and empty texts have the end id only; columns of clashing names are ignored."""
    schema = "doc_id long, text string, start long, n_tokens long, part int"
    rows = [(3, "foo bar", 1, 1, 1), (None, "x", 1, 1, 1), (3, "foo bar", 1, 1, 1), (1, None, 1, 1, 1), (2, "", 1, 1, 1)]
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    folder = str(tmp_path / "ids")
    got = sorted(tokenbin.read_ids(tokenbin.write_ids(spark.createDataFrame(rows, schema), folder, *paths), folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (2, 3, 1), (3, 4, 3), (3, 7, 3)]
    folder = str(tmp_path / "none")
    assert tokenbin.read_ids(tokenbin.write_ids(spark.createDataFrame([], schema), folder, *paths), folder).count() == 0


def test_new_words_go_to_the_library_in_rows(library):
    """Few and long rows instead of one call a word, and words that the rows cannot tell apart still get the library's ids."""

    class Counting:
        def __init__(self):
            self.texts = 0

        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return library.encode_batch_fast(texts, **how)

    coder = Counting()
    words = tokenbin.Words(coder, public_tokenizers.PATTERN)
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdeéñ日'1.,\n", k=rng.randint(1, 12))).strip("\n").replace("\n\n", "\n") or "x" for _ in range(4000))
    text = "\n".join(line.strip() for line in text.split("\n") if line.strip())
    assert words.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.texts < 200
    words.widths = words.widths + 1  # a vocabulary whose ids do not tell their bytes
    words.clear()
    assert words.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids and coder.texts > 3000
    with pytest.raises(ValueError):
        tokenbin.Words(library, r"\S+|\s+")


def test_words_are_known_without_the_signs_after_them(library):
    """A word meets the library once, whatever signs come after it, and the ids stay those of whole texts."""
    words = tokenbin.Words(library, public_tokenizers.PATTERN)
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdeghimnorstué", k=9)) for _ in range(500)]
    texts = [" ".join(w + sign for w in rng.sample(stems, 500)) for sign in ("", ".", ",", ";", ":", "!", "?", "...", "?!", ".x", "'s.", "×,")]
    for text, ids in zip(texts, words.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]
    plain = tokenbin.Words(library, public_tokenizers.PATTERN)
    plain.encode([x for x in texts[:8]])
    assert plain.count < 1800  # of 4000; about a third of the words end in é, after which words are not cut


@pytest.mark.parametrize("count", [130, 70_000])
def test_blocks_side_by_side_are_as_alone(count):
    rng = np.random.default_rng(4)
    blocks = [np.minimum(rng.zipf(1.2 + k / 10, count), tokenbin.IDS - 1).astype(np.uint32) for k in range(tokenbin.SIDE)]
    coded = tokenbin.encode_blocks(blocks)
    assert coded == [tokenbin.encode_block(x) for x in blocks]
    assert all((a == b).all() for a, b in zip(tokenbin.decode_blocks(coded, [count] * len(coded)), blocks))


def test_files_of_many_blocks(monkeypatch):
    """Groups of blocks and the rest are read back, document by document, and a changed byte is seen."""
    import io
    import zlib

    monkeypatch.setattr(tokenbin, "BLOCK", 3000)
    rng = np.random.default_rng(8)

    class Kept(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    for total in (1, 2999, 3000, 3001, 12_000, 12_001, 26_999, 40_000):
        ids = np.minimum(rng.zipf(1.3, total), tokenbin.IDS - 1).astype(np.uint32)
        cuts = np.unique(np.append(rng.integers(0, total, 7), [0, total]))
        writer = tokenbin.Writer(Kept())
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            writer.add(k, ids[a:b])
        writer.close()
        want = [(k, int(a), int(b - a), zlib.crc32(ids[a:b].astype("<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert list(tokenbin.read_file(Source(writer.stream.kept))) == want
    broken = bytearray(writer.stream.kept)
    broken[len(broken) // 3] ^= 1
    with pytest.raises(ValueError):
        list(tokenbin.read_file(Source(bytes(broken))))
