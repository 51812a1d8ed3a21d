"""The corpus operators on small tables with nulls, empty and long texts, repeats and clashing columns, against brute force."""

import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from parlance.llm import bpe, decontam, embeddings, langid, licenses, minhash, quality, substring, tokenbin, warc

DOCS = "doc_id long, text string, id string, n long, band long, size long, lang string, quality int"


def _docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "en", 1) for i, t in zip(ids, texts)], DOCS)


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


ODD = [None, "", "   \n ", "word", "Word", "é ü ß 語 🙂", "a\tb\x0bc", "x" * 3000, "la " * 4000]


def test_minhash_against_all_pairs(spark):
    rng = random.Random(1)
    base = [_words(rng, 60) for _ in range(4)]
    texts = list(ODD)
    for b in base:
        for _ in range(5):
            w = b.split()
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = "zzz"
            texts.append(" ".join(w))
    texts += [base[0].upper(), base[0]]
    got = {r.doc_id: r for r in minhash.near_duplicates(_docs(spark, texts), n=2).collect()}

    def shingles(t):
        w = bytes((t or ""), "utf8").lower().split()
        return {tuple(w)} if len(w) == 1 else {tuple(w[k : k + 2]) for k in range(len(w) - 1)}

    sets = [shingles(t) for t in texts]
    owner = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    owner[a] = owner[b] = min(owner[a], owner[b])
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert [got[k].component_id for k in range(len(texts))] == owner
    assert minhash.near_duplicates(_docs(spark, []).limit(0)).count() == 0


def test_substring_against_brute_force(spark):
    rng = random.Random(2)
    sentence = lambda: _words(rng, rng.randrange(6, 14)) + ". "
    shared = "".join(sentence() for _ in range(6))
    texts = [*ODD, *("".join(sentence() for _ in range(4)) + (shared if k % 2 else "") + "".join(sentence() for _ in range(3)) for k in range(6))]
    out = {r.doc_id: r for r in substring.dedup_spans(_docs(spark, texts)).collect()}
    kept = _repeated_sentences([t or "" for t in texts])
    assert [(out[k].text or "", out[k].n_removed) for k in range(len(texts))] == kept
    hit = [k for k in out if k >= len(ODD) and out[k].n_removed]
    assert len(hit) == 2 and all(shared[-200:] not in out[k].text for k in hit)
    assert out[0].text is None and out[0].id == "x"


def _repeated_sentences(texts, least_sentences=2, least_words=16):
    """Texts without the sentences in any run that meets both minima and occurs earlier, from the definition."""
    first, cut = {}, []
    for k, t in enumerate(texts):
        parts = []
        for p in re.split(r"(?<=\n)|(?<=[.!?][ \t\x0b\x0c\r])", t):
            if parts and (not p.strip() or not parts[-1].strip()):
                parts[-1] += p  # pieces without words join the one before, leading ones the first sentence
            else:
                parts.append(p)
        words = [tuple(p.lower().split()) for p in parts]
        cut.append((parts, words))
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                first.setdefault(tuple(words[i:j]), (k, i))
    kept = []
    for k, (parts, words) in enumerate(cut):
        gone = set()
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                n = sum(map(len, words[i:j]))
                if j - i >= least_sentences and n >= least_words and first[tuple(words[i:j])] < (k, i):
                    gone |= set(range(i, j))
        kept.append(("".join(p for i, p in enumerate(parts) if i not in gone), len(gone)))
    return kept


def test_substring_removes_all_of_a_repeated_run(spark):
    rng = random.Random(12)
    sentence = lambda n: _words(rng, n) + ". "
    long_first = sentence(30) + sentence(20)  # a lone run, then a sentence whose own run reaches into other text
    short_last = sentence(12) + sentence(12) + sentence(3) + sentence(2)  # the end has too few words for a run of its own
    texts = [sentence(9) + shared + sentence(25) + sentence(10) for shared in (long_first, short_last) for _ in range(3)]
    pool = [sentence(rng.choice([1, 2, 3, 5, 8, 15, 16, 23, 24, 30])) for _ in range(12)]
    for _ in range(40):
        at = rng.randrange(9)
        texts.append("".join([sentence(5), *pool[at : at + rng.randrange(1, 5)], sentence(rng.choice([2, 26])), *rng.choices(pool, k=3)]))
    out = {r.doc_id: r for r in substring.dedup_spans(_docs(spark, texts)).collect()}
    want = _repeated_sentences(texts)
    assert want[1][1] == want[2][1] == 2 and want[4][1] == want[5][1] == 4
    assert [(out[k].text, out[k].n_removed) for k in range(len(texts))] == want


def test_bpe_as_tiktoken(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [*ODD, "abcdefgh" * 40, "12345 it's we'll  \n\n x", "".join(rng.choice("ab é語") for _ in range(2000)), "\x1c\x85  a"]
    got = {r.doc_id: r for r in bpe.encode_and_decode(_docs(spark, texts), path, public_tokenizers.PATTERN, with_ids=True).collect()}
    for k, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        assert got[k].ids == want and got[k].n_tokens == len(want)
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_decontamination(spark):
    item = "A train leaves the northern town with 120 boxes of 15 kg each and meets old Peter after 3 hours near the wide river bank"
    changed = item.replace("120", "77").replace("15 kg", "9 kg").replace("Peter", "Marta").replace("after 3", "after 8")
    rng = random.Random(5)
    clean = [_words(rng, 80) for _ in range(3)]
    texts = [*ODD, *clean, clean[0] + ". " + item + ". " + clean[1], "Intro words here: " + changed + ". tail words", item]
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x"), (3, "tiny item text"), (1, item)], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.decontaminate(_docs(spark, texts), bench).collect()}
    n = len(texts)
    assert {k for k, v in got.items() if v} == {n - 3, n - 2, n - 1} and got[n - 2] == [1]
    assert not any(r.contaminated for r in decontam.decontaminate(_docs(spark, texts), bench.limit(0)).collect())


def test_decontamination_of_short_strided_and_renamed_items(spark):
    rng = random.Random(15)
    short, eleven = "why do tall gates open inwards", "grey wolves near the frozen lake often sleep under fallen trunks"
    names = "Alice has 12 apples. Alice gives 3 to Bob. How many apples does Alice have?"
    start = "Fresh bread from the old mill costs little"
    bench = spark.createDataFrame([(1, short), (2, eleven), (3, names), (4, start), (5, "12"), (6, "Paul 7")], "item_id long, text string")
    texts, want = [], []
    for k in range(8):  # every offset of the leak in the document
        before, after = _words(rng, 30 + k), _words(rng, 40)
        half = " ".join(eleven.split()[:9])  # 2 of its 4 windows
        renamed = names.replace("Alice", "Carol").replace("12", "40").replace("Bob", "Dora")
        for leak, item in ((short, 1), (half, 2), (renamed, 3), ("eggs. " + start.lower(), 4), ("sum 12 of", 5)):
            texts.append(f"{before} {leak} {after}")
            want.append([item])
        # an earlier place with the same template window and other names must not hide the leak
        texts.append(f"{before}. Frank gives 8 to Gerd. How many apples does Hugo {after}. {renamed} {after}")
        want.append([3])
        texts.append(f"{before}. Mary counts 9 {after}")
        want.append([])
    texts.append("Anna 9")
    want.append([6])
    got = {r.doc_id: r.item_ids for r in decontam.decontaminate(_docs(spark, texts), bench).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_quality(spark):
    rng = random.Random(6)
    texts = [_words(rng, 60).capitalize() + "." if k % 2 else "buy " * 50 + "!!! $$$" for k in range(160)] + ODD
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)] + [(3, None), (5, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    held = [k for k in range(160) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(rows[k].held_out for k in held) and np.mean([rows[k].predicted == k % 2 for k in held]) > 0.95
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows.values())
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}


def test_langid(spark):
    rng = random.Random(7)
    kinds = {"aa": "abcde", "bb": "uvwxy"}
    rows = [(k, " ".join("".join(rng.choice(kinds[v]) for _ in range(5)) for _ in range(80)), v) for k, v in enumerate(rng.choices(["aa", "bb"], k=120))]
    rows += [(200 + k, t, None) for k, t in enumerate([None, "", "123 !", "abcde " * 500])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [r for r in rows[:120] if got[r[0]].held_out]
    assert held and np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert [got[200 + k].lang_pred for k in range(4)] == ["und", "und", "und", "aa"]


def _pairs_at_threshold(rng, n, dims):
    a, r = rng.normal(size=(2, n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    return a, embeddings.THRESHOLD * a + np.sqrt(1 - embeddings.THRESHOLD**2) * r


def test_embeddings_missed_pairs_at_any_size():
    rng = np.random.default_rng(18)
    for dims in (16, 64):
        a, b = _pairs_at_threshold(rng, 5000, dims)
        for n in (2000, 1_000_000):
            bits, count = embeddings.plan(n, embeddings.THRESHOLD)
            keys = [embeddings.draws(embeddings.encode(x)[0], bits, count) for x in (a, b)]
            assert (~(keys[0] == keys[1]).any(axis=1)).sum() <= 4  # 0.5 expected


def test_embeddings_links_of_few_dimensions(spark):
    a, b = _pairs_at_threshold(np.random.default_rng(19), 1000, 16)
    b = b + 0.01 * a
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    x = np.concatenate([a, b])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= embeddings.THRESHOLD).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.similar_vectors(df).collect()}
    assert [got[k] for k in range(len(x))] == near.tolist()


@pytest.mark.parametrize("chunk", [4096, 16])
def test_embeddings_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)  # small: large buckets meet chunk by chunk
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 16))
    vectors = [(base[k % 20] + rng.normal(size=16) * 0.08 * (k % 4)).tolist() for k in range(200)]
    vectors += [vectors[0], None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows = [(k, v, 0, "c") for k, v in enumerate(vectors)] + [(5, vectors[5], 1, "again"), (None, vectors[0], 1, "no id")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, copies long, key string")
    out = embeddings.similar_vectors(df).collect()
    assert len(out) == len(rows) and [tuple(r) for r in out if r.vec_id is None] == [(None, 0, None, True)]
    got = {r.vec_id: r for r in out}
    u = np.array(vectors[:201])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    links, all_ = sum(got[k].n_links for k in range(201)), int(near.sum() - 201)
    print(f"recall of links: {links / all_:.4f} of {all_}")
    assert [got[k].n_links for k in range(201)] == (near.sum(axis=1) - 1).tolist()
    owner = np.arange(201)
    for _ in range(201):
        owner = np.where(near, owner[None], 1000).min(axis=1)
    assert [got[k].component_id for k in range(201)] == owner.tolist()
    assert all(got[k].n_links == 0 and got[k].kept for k in range(201, 207))
    assert embeddings.similar_vectors(df.limit(0)).count() == 0


def test_embeddings_bounds_hold():
    """Of pairs at the threshold, hardly any has a bound under it; of unrelated pairs, few reach it."""
    rng = np.random.default_rng(23)
    a, b = _pairs_at_threshold(rng, 2000, 64)
    x = np.concatenate([a, b])
    level, factor, step = embeddings.encode(x)
    packed = embeddings.pack(level)
    assert (embeddings.unpack(packed) == level).all()
    marked = []
    for rows in ([k, k + 2000] for k in range(2000)):
        columns = {"draw": np.zeros(2, int), "chunk": np.zeros(2, int), "pa": np.zeros(2, int), "pb": np.zeros(2, int), "factor": factor[rows], "step": step[rows], "q": [packed[r].tobytes() for r in rows]}
        marked.append(len(embeddings.partners(embeddings.Group(columns), embeddings.THRESHOLD)) == 2)
    assert np.mean(marked) >= 0.999
    columns = {"draw": np.zeros(2000, int), "chunk": np.zeros(2000, int), "pa": np.zeros(2000, int), "pb": np.zeros(2000, int), "factor": factor[:2000], "step": step[:2000], "q": [c.tobytes() for c in packed[:2000]]}
    assert len(embeddings.partners(embeddings.Group(columns), embeddings.THRESHOLD)) <= 200  # of 2 million pairs


def test_whole_licenses_with_and_without_their_titles(spark):
    texts = []
    for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense"):
        text = licenses.KNOWN[name]
        untitled = text.split("\n", 1)[1]
        rewrapped = "\n * ".join(text.replace("<year>", "2019").replace(". ", ".\n").split("\n"))
        texts += [(name, text), (name, untitled), (name, rewrapped.lower()), (None, text + " and more words")]
    got = {r.doc_id: r.whole_license for r in licenses.scan(_docs(spark, [t for _, t in texts])).collect()}
    assert [got[k] for k in range(len(texts))] == [n for n, _ in texts]


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"].upper().replace("SUBLICENSE", "sub-licence")
    texts = [*ODD, "Some text\nReleased under the MIT Licence!\n(c) 2020 X\nmore", mit, "Not released under the MIT License."]
    got = {r.doc_id: (r.whole_license, r.notices, r.n_notices) for r in licenses.scan(_docs(spark, texts)).collect()}
    n = len(texts)
    assert got[n - 3] == (None, "MIT-notice", 1) and got[n - 2][0] == "MIT" and got[n - 1] == (None, "", 0) and got[0] == (None, "", 0)


def test_warc_round_trip_and_damage(spark, tmp_path):
    big = "<p>" + "payload " * 300
    rows = [(1, "http://a", big), (9, "http://b", big), (4, None, big), (2, "u", "small"), (3, "u", "small"), (5, "u", None), (6, "u v\n", "é" * 600)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.with_types(pages), folder, warc.train_dictionary(pages))
    got = {r.page_id: r for r in warc.read_archives(manifest, folder).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if k in (1, 4, 9)} == {1: ("revisit", 9), 4: ("revisit", 9), 9: ("response", None)}
    for k, _, html in rows:
        data = (html or "").encode()
        assert got[k].payload_bytes == len(data) and got[k].payload_digest == hashlib.sha1(data).hexdigest()
    raw = warc.record("response", 1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    for bad in (raw[:-1], raw.replace(b"abc", b"abd"), raw.replace(b"WARC/1.1", b"WARC/9.9"), raw.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"no archive")))


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/t"
    got = sorted(tokenbin.read_ids(tokenbin.write_ids(_docs(spark, ODD), folder, path, public_tokenizers.PATTERN), folder).collect())
    start = 0
    for k, t in enumerate(ODD):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(got[k]) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 70_000])
def test_range_coder(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 16, n), np.full(n, 7), rng.zipf(1.3, n) % 50257):
        coded = tokenbin.encode_block(ids)
        assert (tokenbin.decode_block(coded, n) == ids).all()


def test_substring_defined_cases(spark):
    rng = random.Random(12)
    shared = " ".join(_words(rng, 9) + "." for _ in range(3))
    other = " ".join(_words(rng, 9) + "." for _ in range(3))
    schema = "doc_id long, text string, doc long, h long, at string, n_removed int, N_Sentences int, mark_places string, `__starts` int, n_chars int"
    extra = (1, 2, "a", 3, 4, "p", 5, 7)
    rows = [(1, shared, *extra), (2, other + "\n" + shared, *extra), (2, other + "\n" + shared, *extra), (None, shared, *extra), (3, None, *extra), (4, "", *extra), (5, other, *extra), (5, other + "\n" + other, *extra)]
    df = spark.createDataFrame(rows, schema)
    out = [tuple(r) for r in substring.stage(spark, df, "").collect()]
    hashes = {r.text: r.t for r in df.selectExpr("text", "xxhash64(text) AS t").collect()}
    assert all(r[2:9] == extra[:7] for r in out)
    got = sorted(((r[0], r[1]) for r in out), key=str)
    left = other + "\n"  # of document 2, which is before document 5
    assert sorted(got, key=str) == sorted([(1, shared), (2, left), (2, left), (None, shared), (3, None), (4, ""), (5, ""), (5, "")], key=str), hashes
    figures = substring.dedup_spans(df)
    assert figures.columns[-2:] == ["n_sentences", "n_removed"] and len({c.lower() for c in figures.columns}) == len(figures.columns)
    assert substring.dedup_spans(df.limit(0)).count() == 0
