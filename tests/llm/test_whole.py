"""Cases in which an operator once did less than the whole job."""

import re
import zlib
from pathlib import Path

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F

from bitloom.llm import base, langid, packing, pieces, shingles, toxicity
from bitloom.llm.components import forest


def test_packing_spells_every_letter():
    path = packing.tokenizer_path()
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(path), packing.Encoder(path)
    simple = [chr(c) for c in range(0x250) if packing.SIMPLE.fullmatch(chr(c))]
    assert "Ə" in simple and "Ⱥ" in simple
    for c in simple:
        for word in (c, f"ab{c}cd", f"{c}x{c}."):
            assert own.encode(word).tolist() == t.encode(word, add_special_tokens=False).ids, (hex(ord(c)), word)


def test_langid_with_a_letterless_label(spark):
    rows = [(f"der und die das nicht {w}", "de") for w in ("haus", "baum", "hund")] * 4 + [(f"the and of not {w}", "en") for w in ("house", "tree", "dog")] * 4
    model = langid.fit([(s, y) for t, y in [*rows, ("123 456", "aa")] for s in langid.spans_of(t) or [""]], steps=60)
    assert model.labels == ["de", "en"]
    docs = spark.createDataFrame([(0, "die und das"), (1, "the of and"), (2, "7 8 9")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["de", "en", "und"] and min(got[0].score, got[1].score) > 0.6
    only = langid.fit([("", "aa"), ("", "bb")], steps=1)
    assert only.labels == [] and {r.lang_pred for r in langid.predict(docs, only).collect()} == {"und"}


def sets(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def test_pipeline_drops_near_copies(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(40):  # each with a copy from 0.8 to 0.9, and one under 0.8
        words = [f"w{k}" for k in rng.integers(0, 5000, 200)]
        near, far = words.copy(), words.copy()
        for p in (20, 70, 120):
            near[p] = "other"
        for p in range(10, 200, 15):
            far[p] = "other"
        texts += [" ".join(w) for w in (words, near, far)]
    own = list(map(sets, texts))
    assert all(0.8 <= jaccard(*own[i : i + 2]) < 0.9 and jaccard(own[i], own[i + 2]) < 0.7 for i in range(0, 120, 3))
    # a chain: each step at 0.8 or more, its ends far apart; and texts of one word sequence
    chain = [f"c{k}" for k in range(300)]
    for step in range(6):
        texts.append(" ".join(chain))
        for p in (25 + 6 * step, 125 + 6 * step):
            chain[p] = f"n{p}"
    texts += ["few words", "Few  words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    own = list(map(sets, texts))
    a, b = np.nonzero([[jaccard(x, y) >= 0.8 for y in own] for x in own])
    want = sorted(set(forest(len(texts), a, b).tolist()))
    got = corpus_pipeline.near_duplicates(spark, docs.unionByName(docs), "")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_near_copies_have_an_exact_join(spark):
    """Pairs at 0.8 exactly that share none of 24 MinHash bands of 5 rows (seeds 25652 and 32952 of the first 33,000), far from each other by SimHash."""
    texts = []
    for seed in (25652, 32952):
        words = [f"w{k}" for k in np.random.default_rng(seed).integers(0, 10**6, 49)]
        texts += [" ".join(words), " ".join([*words[:20], "other", *words[21:]])]
    assert jaccard(*map(sets, texts[:2])) == jaccard(*map(sets, texts[2:])) == 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]


def test_prefixes_of_similar_sets_meet():
    """Whatever is taken for frequent, sets from 0.8 share a key, and at places that allow it."""
    rng = np.random.default_rng(8)
    for _ in range(2000):
        n = int(rng.integers(1, 120))
        every = np.unique(rng.integers(0, 1 << 64, 2 * n, np.uint64, endpoint=False))
        x = np.sort(rng.choice(every, n, replace=False))
        y = np.union1d(x[rng.random(n) >= 0.1], rng.choice(every, n // 9))
        if not len(y) or jaccard(set(x.tolist()), set(y.tolist())) < 0.8:
            continue
        hot = np.sort(rng.choice(every, int(rng.integers(0, len(every) + 1)), replace=False))
        i, j = (shingles.keys(s, 0.8, hot).tolist() for s in (x, y))
        first = next(k for k in i if k in j)
        assert min(len(x) - i.index(first), len(y) - j.index(first)) * 1.8 >= (len(x) + len(y)) * 0.8 - 1e-9


def test_frequent_shingles_are_found(spark):
    docs = spark.createDataFrame([(f"{k} a b c d e {k}",) for k in range(9)] * 2 + [(None,), ("",)], "text string")
    want = shingles.shingles(b"a b c d e".split())
    assert shingles.often(docs, 1, 9).tolist() == want.tolist() and not len(shingles.often(docs, 1, 10))


def test_a_worker_lets_go():
    """A task of another operator finds no encoder of packing in its worker, and what a task freed is the system's again."""
    held = lambda: sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    packing.encoder(packing.tokenizer_path())
    assert not list(base.lean(iter, "packing")([])) and packing._ENCODERS
    assert list(base.lean(iter)([1, 2])) == [1, 2] and not packing._ENCODERS
    parts = [np.ones(1 << 12) for _ in range(4000)]
    last = parts[-1]  # the end of the heap stays in use
    del parts
    before = held()
    list(base.lean(iter)([]))
    assert held() < before - 60 and last.all()


def test_pieces_digest_is_of_whole_ids(spark):
    """The query's figures come from the ids of the whole text, in order, and from the text decoded from them."""
    import sentencepiece

    m = pieces.Pieces(pieces.model_path())
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = np.random.default_rng(5)
    letters = list("aeinrst.,;:'\"()-_/0123456789AZ▁ é語𝄞")
    texts = [None, "", "one two", "two one", "x" * 30_000, *("".join(rng.choice(letters, 90)) for _ in range(150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = [lib.encode(t or "") for t in texts]
    want = {r.doc_id: r.h for r in spark.createDataFrame(list(enumerate(ids)), "doc_id bigint, ids array<int>").select("doc_id", F.xxhash64("ids").alias("h")).collect()}
    for hot in (0, 20, pieces.HOT):
        got = {r.doc_id: r for r in pieces.digest(docs, m, hot=hot).collect()}
        assert {i: r.ids_digest for i, r in got.items()} == want and all(r.decoded for r in got.values())
        assert [got[i].n_pieces for i in range(len(texts))] == list(map(len, ids))


def test_toxicity_holds_rare_expressions_that_tell(spark):
    """A word, and a phrase of two harmless words, in too few toxic rows for a share of the class."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(12000):
        words = [f"w{k}" for k in rng.integers(0, 200, 12)]
        toxic = i % 8 == 0
        if i % 800 == 0:
            words.insert(5, "vile")
        if i % 800 in (8, 5):
            words[5:5] = ["black", "heart"] if toxic else ["heart", "black"]
        if toxic:
            words[2:2] = ["nasty"]
        rows.append((i, " ".join(words), int(toxic)))
    docs, marks = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks)
    assert {"vile", "nasty", "black", "heart"} <= set(model.vocab)
    size, (plain, bad) = model.size, model.sides
    pair = model.vocab["black"] * size + model.vocab["heart"]
    at = bad.keys.tolist().index(pair)
    toxic = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(0, 12000, 8))
    assert 0 < bad.counts[at] < toxicity.SHARE * toxic > bad.rows[model.vocab["vile"]] > 0 and plain.counts[at] == 0
    d = lambda t: model.differences([t])[0]
    assert d("w1 vile w2") > d("w1 unheard w2") and d("w1 black heart") > d("w1 heart black")
    assert toxicity.split([0, 30, 0], [9, 10, 3], 0.25).round(3).tolist() == [24.953, 0.0, 8.318]
