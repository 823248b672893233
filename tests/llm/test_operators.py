"""The training-data operators against brute-force versions, exact round trips and held-out accuracy; edge cases for each."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bitloom.llm import chat, embed, langid, media, packing, pieces, pii, quality, simhash, toxicity
from bitloom.llm.base import settle
from bitloom.llm.components import components, forest

DATA = "/root/testdata/sf0.001"
EDGE = [None, "", " ", "a", "same words in two rows", "same words in two rows", "é 𝄞 ü\n\tß", "x" * 30_000, "tie tie tie", "!!! 123 ???"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty, odd and long texts, repeats; further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, 0, 1.0, "x") for i, t in enumerate(EDGE)], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string")


@pytest.fixture(scope="module")
def nothing(edge):
    return settle(edge.limit(0))


# -- op 1


def ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(media.MOVE[code])))
            out.append(value)
    return out


def test_media(edge, nothing):
    rows = {r.doc_id: r for r in media.text_media(edge).collect()}
    for i, t in enumerate(EDGE):
        raw = (t or "").encode()
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        stored = media.wav(media.CODECS[zlib.crc32(want) % 3], want)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        codec, rate, align, data = media.parse_wav(stored)
        pcm = media.EXPAND[codec][np.frombuffer(data, np.uint8)] if codec != media.ADPCM else np.array([x for k in range(0, len(data), align) for x in ima(data[k : k + align])], np.int16)
        pcm = media.resample(pcm, rate, media.TARGET_RATE).astype("<i2")
        assert r.feature == media.feature(codec, media.TARGET_RATE, pcm) and f":{len(pcm)}:peak={np.abs(pcm.astype(int)).max()}:" in r.feature
    assert rows[4][1:] == rows[5][1:] and media.text_media(nothing).count() == 0


def test_codecs(spark):
    assert media.EXPAND[media.MULAW][[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert media.EXPAND[media.ALAW][[0x2A, 0xAA, 0x55, 0xD5]].tolist() == [-32256, 32256, -8, 8]
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 40), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [ima(bytes(b)) for b in blocks]
    tone = (8000 * np.sin(np.arange(800) * 2 * np.pi * 300 / 8000)).astype(np.int16)
    for rate in (16000, 11025, 4000):
        out = media.resample(tone, 8000, rate)
        want = 8000 * np.sin(np.arange(len(out)) * 2 * np.pi * 300 / rate)
        assert len(out) == -(-800 * rate // 8000) and np.abs(out[100:-100] - want[100:-100]).max() < 200
    data = bytes(rng.integers(0, 256, 384, dtype=np.uint8))
    df = spark.createDataFrame([(1, bytearray(media.wav(media.ALAW, data))), (2, bytearray(media.wav(media.ADPCM, data))), (3, None), (4, bytearray(b"no audio"))], "id int, media binary")
    got = {r.id: r.pcm for r in media.store_pcm(df).collect()}
    assert len(got[1]) == 2 * 768 and len(got[2]) == 2 * 2 * 770 and got[3] is None and got[4] is None


# -- op 2


def brute_marginals(model, score):
    n, k = score.shape
    logs = {}
    import itertools

    for path in itertools.product(range(k), repeat=n):
        logs[path] = model.start[path[0]] + sum(score[i, y] for i, y in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))
    top = max(logs.values())
    out = np.zeros((n, k))
    for path, v in logs.items():
        for i, y in enumerate(path):
            out[i, y] += np.exp(v - top)
    return out / out.sum(1, keepdims=True)


def test_marginals():
    rng = np.random.default_rng(2)
    m = langid.Model(["a", "b", "c"])
    m.move, m.start = rng.standard_normal((3, 3)), rng.standard_normal(3)
    score = rng.standard_normal((9, 3))
    keep, langid.BLOCK = langid.BLOCK, 2
    try:
        got = langid.marginals(m, score, np.array([6, 3]))
    finally:
        langid.BLOCK = keep
    assert np.allclose(got[:6], brute_marginals(m, score[:6])) and np.allclose(got[6:], brute_marginals(m, score[6:]))


def test_gradients():
    """The gradient of the chains' log-likelihood against finite differences of a brute-force one."""
    import itertools

    rng = np.random.default_rng(5)
    text = "aa bb ca db ee fa gb"
    m = langid.Model(["a", "b", "c"])
    m.move, m.start, m.bias = rng.standard_normal((3, 3)), rng.standard_normal(3), rng.standard_normal(3)
    m.emit[:] = 0.3 * rng.standard_normal(m.emit.shape)
    codes = langid._codes(text)
    f = langid.Features(codes, *langid.words(codes))
    y, sizes = np.array([0, 2, 1, 1, 0, 2, 2]), np.array([4, 3])

    def loss():
        score, total = m.emissions(f), 0.0
        for own, at in ((y[:4], 0), (y[4:], 4)):
            e = score[at : at + len(own)]
            value = lambda path: m.start[path[0]] + sum(e[i, c] for i, c in enumerate(path)) + sum(m.move[c, d] for c, d in zip(path, path[1:]))  # noqa: B023, E731
            total -= value(own) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(3), repeat=len(own))))
        return total / len(y)

    grads = langid.gradients(m, f, y, sizes)
    for name in ("move", "start", "bias"):
        weights = getattr(m, name)
        for at in np.ndindex(weights.shape):
            was = weights[at]
            weights[at] = was + 1e-5
            up = loss()
            weights[at] = was - 1e-5
            down = loss()
            weights[at] = was
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), (name, at)


def test_langid(spark, docs, edge, nothing):
    model = langid.fit(langid.sample(docs), steps=150)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    got = {r.doc_id: r for r in langid.predict(edge, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 9)) and got[4][1:] == got[5][1:]
    assert {r.lang_pred for r in langid.identify(edge).collect()} == {"und"} and langid.identify(nothing).count() == 0


def test_langid_odd_rows(spark):
    """Free-standing digits of other kinds, other scripts, null and repeated ids, and a bound on the rows of all languages."""
    odd = ["² ½ ³", "слово за словом", "語の 列 です", "x² ½y", "\ud83d\ude00 z"]
    rows = [(i, f"der die das {w}", "de") for i, w in enumerate(("haus", "baum", "²", "½") * 6)] + [(100 + i, f"the of and {w}", "en") for i, w in enumerate(("house", "tree", "¼", "x²") * 6)]
    rows += [(0, "zwei", "de"), (0, "drei", "de"), (None, "nirgends", "de"), (500, "12 ²", "zz"), (501, None, "en"), *((600 + i, t, None) for i, t in enumerate(odd))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    spans = langid.sample(docs)
    assert {y for _, y in spans} == {"de", "en"} and not any("nirgends" in s for s, _ in spans)
    assert len(langid.sample(docs, rows=9)) <= 9
    model = langid.fit(spans, steps=40)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (500, 501, 600)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    text = " ".join(f"w{'abcdefgh'[i % 8]}" for i in range(1000))
    spans = langid.spans_of(text)
    assert len(spans) == langid.PER_ROW and all(s.count(" ") == langid.BLOCK - 1 for s in spans) and langid.spans_of("½ 7") == []


# -- op 3


def merge(word, table):
    parts = list(word)
    while True:
        best = max(((table[a + b][1], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in table), default=None)
        if best is None:
            return parts
        i = -best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_pieces(spark, edge, nothing):
    import sentencepiece

    m = pieces.Pieces(pieces.model_path())
    more = ["ab" * 40 + "  c", "  two  spaces ", "a▁b", "日本語" * 300, "=" * 500 + "x" * 61 + " y", "Zürich 𝄞𝄞 ﷽ \x00 tab\tline\n", "The quick brown fox " * 30, "aaaa aaaaa aaaaaaa banana bananana", " " * 200]
    own = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string"))
    own = settle(own.unionByName(spark.createDataFrame([(None, "no id here"), (4, "an id twice"), (None, None)], own.schema)))
    coded = settle(pieces.encode(own, m, hot=5))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    text = [(r.doc_id, r.text or "") for r in own.collect()]
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=key) == sorted(((i, lib.encode(t)) for i, t in text), key=key)
    assert sorted(((r.doc_id, r.text) for r in pieces.decode(coded, m).collect()), key=key) == sorted(((i, t.replace("▁", " ")) for i, t in text), key=key)
    rows = [r for h in (5, 0) for r in pieces.digest(own, m, hot=h).collect()]
    want = sorted((i is None, i or 0, len(lib.encode(t))) for i, t in text)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_pieces) for r in rows) == sorted(want * 2) and all(r.decoded for r in rows)
    assert len(set(map(tuple, rows))) == len(text)  # hot or rare, the digests agree
    same = {r[1:] for r in rows if r.doc_id == 5}
    assert len(same) == 1 and same <= {r[1:] for r in rows if r.doc_id == 4}
    assert pieces.digest(nothing, m).count() == 0 and pieces.encode(nothing, m).count() == 0


def test_pieces_fold_on_every_kind_of_word(spark):
    """The fold and the heap against the library, on words that are hard to merge."""
    import random

    import sentencepiece

    random.seed(3)
    m = pieces.Pieces(pieces.model_path())
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    words = {"".join(random.choice(letters) for _ in range(random.randint(1, 40))) for letters in ("ab", "aenrst", "etaoinshrdlu", "aeiouxyzß", "0123456789.", "lL1iI|") for _ in range(250)}
    frame = spark.createDataFrame([("▁" + w,) for w in words], "word string")
    got = {r.word: r.ids for r in pieces.encode_words(frame, m).collect()}
    table = {p: (i, s) for p, i, s in m.rows}
    for w in words:
        assert got["▁" + w] == lib.encode(w) == pieces.long_ids("▁" + w, table, m.bytes[0], True, m.longest, m.unknown), w
    assert [table[p][0] for p in merge("▁sentencepiece", table)] == lib.encode("sentencepiece")


def test_viterbi(spark):
    m = pieces.Pieces(pieces.model_path())
    m.merges = False
    table = {p: (i, s) for p, i, s in m.rows}

    def best(w):
        ways = [(0.0, 0, [])]
        for e in range(1, len(w) + 1):
            ways.append(max(((ways[s][0] + table[w[s:e]][1], -s, ways[s][2] + [table[w[s:e]][0]]) for s in range(e) if w[s:e] in table), key=lambda x: x[:2]))
        return ways[-1][2]

    words = ["▁hello", "▁unbelievable", "▁straightforward", "▁a"]
    got = pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), m).collect()
    assert {r.word: r.ids for r in got} == {w: best(w) for w in words}
    assert all(pieces.long_ids(w, table, m.bytes[0], False, m.longest, m.unknown) == best(w) for w in words)


# -- op 4


def toxic_rows(n=600, every=4):
    rng = np.random.default_rng(3)
    vocab, rows = [f"w{i}" for i in range(300)], []
    for i in range(n):
        words = rng.choice(vocab, 60).tolist()
        if i % every == 0:
            for w in rng.choice(["vile", "nasty", "rotten"], 4):
                words.insert(int(rng.integers(60)), str(w))
        rows.append((i, " ".join(words), int(i % every == 0)))
    return rows


def brute_toxicity(rows, labels, wanted):
    """Normalised differences of `wanted` texts by plain loops over dictionaries."""
    words = {i: toxicity.tokens(t or "") for i, t in rows}
    train = {y: [words[i] for i, t in labels if t == y and zlib.crc32(str(i).encode()) % 5 != 0] for y in (0, 1)}
    df = {y: Counter(w for r in train[y] for w in set(r)) for y in (0, 1)}
    least = {y: max(toxicity.LEAST, toxicity.SHARE * len(train[y])) for y in (0, 1)}
    vocab = {w for y in (0, 1) for w, n in df[y].items() if n >= least[y]}
    names = lambda r: [w if w in vocab else "<unk>" for w in r]
    grams = {y: Counter(g for r in train[y] for g in set(zip(["<s>", *names(r)], names(r)))) for y in (0, 1)}
    alone = {y: Counter(w for r in train[y] for w in set(names(r))) for y in (0, 1)}
    kept = {g for y in (0, 1) for g, n in grams[y].items() if n >= least[y]}
    every = Counter(w for r in words.values() for w in set(names(r)))
    shared = {w: (every[w] + 0.5) for w in [*vocab, "<unk>"]}
    total = sum(shared.values())
    d = lambda c: (sum(n == 1 for n in c.values()) + 0.5) / (sum(n == 1 for n in c.values()) + 0.5 + 2 * (sum(n == 2 for n in c.values()) + 0.5))
    d1, d2 = {y: d(df[y]) for y in (0, 1)}, {y: d(grams[y]) for y in (0, 1)}

    def log(y, v, w):
        size = sum(alone[y].values())
        low = max(alone[y][w] - d1[y], 0) / size + sum(min(n, d1[y]) for n in alone[y].values()) / size * shared[w] / total
        context = sum(n for g, n in grams[y].items() if g[0] == v)
        if not context:
            return np.log(low)
        spare = context - sum(max(grams[y][g] - d2[y], 0) for g in kept if g[0] == v)
        return np.log(((max(grams[y][v, w] - d2[y], 0) if (v, w) in kept else 0) + spare * low) / context)

    out = {}
    for i in wanted:
        r = names(words[i])
        out[i] = sum(log(1, v, w) - log(0, v, w) for v, w in zip(["<s>", *r], r)) / (len(r) + toxicity.DAMP)
    return out


def test_toxicity(spark, edge, nothing):
    rows = toxic_rows()
    docs, marks = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks)
    want = brute_toxicity([r[:2] for r in rows], [(i, y) for i, _, y in rows], range(0, 600, 17))
    assert np.allclose(model.differences([rows[i][1] for i in want]), list(want.values()), atol=1e-9)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.95
    keep, toxicity.BROADCAST_ROWS = toxicity.BROADCAST_ROWS, 0  # labels joined by a shuffle give the same model
    try:
        other = toxicity.fit(docs, marks)
    finally:
        toxicity.BROADCAST_ROWS = keep
    assert other.vocab == model.vocab and np.allclose(other.curve, model.curve) and np.array_equal(other.sides[1].counts, model.sides[1].counts)
    odd = {r.doc_id: r.score for r in toxicity.score(edge, model).collect()}
    assert all(0 <= s <= 1 for s in odd.values()) and odd[4] == odd[5] and odd[0] == odd[1]
    assert max(r.score for r in toxicity.score(edge, toxicity.fit(edge, marks.limit(0))).collect()) < 1e-6
    assert toxicity.score(nothing, model).count() == 0 and not toxicity.fit(nothing, marks).sides
    # a label without an id, a row without one, an id twice, labels that differ
    more = docs.unionByName(spark.createDataFrame([(None, "vile rotten"), (3, "again"), (5, None)], docs.schema))
    twice = marks.unionByName(spark.createDataFrame([(None, 1), (1, 1), (2, None)], marks.schema))
    assert toxicity.score(more, toxicity.fit(more, twice)).count() == len(rows) + 3


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    size = 6
    grams = rng.integers(0, 9, (size, size))
    grams[:, 0] = 0
    keys = np.flatnonzero(grams.ravel() >= 4)  # the others are pruned
    shared = np.r_[0, rng.random(size - 1)]
    c = toxicity.Class(np.r_[0, rng.integers(0, 9, size - 1)], grams.sum(axis=1), keys, grams.ravel()[keys], 0.7, 0.6, shared / shared.sum())
    for left in range(size):
        assert np.exp(c.log(np.full(size - 1, left), np.arange(1, size))).sum() == pytest.approx(1)


# -- op 5


def plain_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark, docs, edge, nothing):
    own = docs.select("doc_id", "text").unionByName(edge.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = simhash.simhash_components(own).collect()
    text = {r.doc_id: r.text for r in own.collect()}
    fps = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    assert all(int(f) == plain_fingerprint(text[r.doc_id]) for f, r in zip(fps, rows))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    root, least = forest(len(fps), a, b), {}
    for r, x in zip(rows, root):
        least[x] = min(least.get(x, r.doc_id), r.doc_id)
    assert all(least[x] == r.component_id for r, x in zip(rows, root))
    kept = simhash.deduplicate(docs.unionByName(docs))
    assert kept.columns == docs.columns and kept.count() == simhash.simhash_components(docs).select("component_id").distinct().count()
    assert simhash.simhash_components(nothing).count() == 0
    odd = docs.sparkSession.createDataFrame([(1, "a b c"), (1, "x y z"), (2, "X y z"), (None, "q r"), (None, "q r"), (3, None), (4, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.deduplicate(odd).collect()), key=repr) == sorted([(1, "a b c"), (1, "x y z"), (None, "q r"), (3, None)], key=repr)


def test_few_bits():
    assert all(sorted(simhash.few_bits(s)) == [m for m in range(1 << s) if m.bit_count() <= 4] for s in range(1, 13))


@pytest.mark.parametrize("max_node", [20_000, 20])
def test_trie_join(spark, max_node):
    rng = np.random.default_rng(4)
    v = np.repeat(rng.integers(0, 2**63, 20, dtype=np.uint64), 60)
    for _ in range(3):
        v = v ^ np.where(rng.random(len(v)) < 0.7, np.uint64(1) << rng.integers(0, 64, len(v)).astype(np.uint64), np.uint64(0))
    v = np.unique(v)
    got = {r.node: r.root for r in components(simhash.trie_join(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp bigint"), max_node=max_node)).collect()}
    a, b = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4)
    pairs = set(zip(forest(len(v), a, b).tolist(), [got.get(int(x), int(x)) for x in v.view(np.int64)]))
    assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}


# -- op 6


def test_chat(spark):
    rows = [(1, 1, "assistant", "b<|end|>\n<\\|x"), (1, 0, "user", None), (2, 0, None, "t"), (2, 0, None, "t"), (None, 0, "user", "n"), (3, 0, "assistant", "y" * 5000), (4, 0, "user", "<")]
    got = {r.conv_id: r for r in chat.read_back(chat.reconstruct(chat.event_log(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb<|end|>\n<\\|x\n") and got[1].loss_sha256 == sha(rows[0][3]) and got[1].loss_chars == len(rows[0][3])
    assert got[2].n_turns == 2 and got[None].n_turns == 1 and got[3].loss_chars == 5000 and got[4].turns_sha256 == sha("user\n<\n")


def test_fold():
    log = [("start", 1, "user", ""), ("delta", 1, "user", "he"), ("delta", 1, "user", "llo"), ("start", 2, "assistant", ""), ("delta", 2, "assistant", "bad"), ("start", 2, "assistant", ""), ("delta", 2, "assistant", "good"), ("edit", 1, "user", "hi"), ("start", 3, "user", "x"), ("drop", 3, None, None), ("delta", 9, "user", "lost")]
    assert chat.fold(log) == [("user", "hi"), ("assistant", "good")]
    assert chat.parse(chat.render([("a|b\\", "<|a|><\\\\|")])[0]) == [("a|b\\", "<|a|><\\\\|")]


# -- op 7


def test_quality(spark, edge, nothing):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    x, y = quality.sample(docs, labels)
    model = quality.Model(x, y)
    rows = quality.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in held]) > 0.9
    stats = np.array([r[1:] for r in quality.with_statistics(edge).orderBy("doc_id").collect()], float)
    got = [r.score for r in quality.score(edge, model).orderBy("doc_id").collect()]
    assert np.allclose(got, model.score(stats)) and got[4] == got[5] and got[0] == got[1]
    assert quality.score(nothing, model).count() == 0 and quality.Model(np.zeros((0, len(quality.NAMES))), np.zeros(0)).bias < -20


# -- op 8


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii(spark, edge, nothing):
    import random

    random.seed(1)
    texts = EDGE + ["a@b.c._x@y.z é +1 (938) 555-0822 4111 1111 1111 1111 1.2.3.4.5.6.7.8", "9" * 20_000, "a." * 20_000 + "@", "1.1.1.1 " * 300, "+1" + " 2" * 3000, "a@" + "b." * 9000 + "c"]
    texts += ["".join(random.choice("a@.1+- (0)é25%4") for _ in range(random.randint(1, 60))) for _ in range(600)]
    texts += [" ".join(str(random.randint(10**11, 10**13)) for _ in range(20)) for _ in range(50)]
    texts += [f"word token = \"{random.getrandbits(160):040x}\" and id ABC{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = pii.fit(df)
    for r in pii.find(df, model).collect():
        want = base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        kinds = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS[:4])
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert r.n_spans == len(list(filter(None, r.spans.split(","))))
        assert ("secret" in r.spans) == (r.doc_id >= len(texts) - 30) or not want == ""
    clean = pii.redact(spark.createDataFrame([(1, "x a@b.cc y 4111 1111 1111 1111"), (2, None)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert clean[0].text == "x [EMAIL] y [CARD]" and clean[1].text is None
    assert pii.find(nothing, pii.fit(nothing)).count() == 0 and pii.find(edge, pii.fit(edge)).count() == len(EDGE)


# -- op 9


def test_packing(spark, docs, edge, nothing):
    own = docs.select("doc_id", "text").unionByName(edge.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    path = packing.tokenizer_path()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = packing.pack(packing.pieces(own, path)).toPandas()
    for r in own.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = rows[rows.doc_id == r.doc_id].sort_values("piece")
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 4096].tobytes()) for k in range(0, len(ids), 4096)]
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.cumsum(g.length.to_numpy()) - g.length.to_numpy()).all() and g.length.sum() <= 4096
    assert packing.pack(packing.pieces(nothing, path)).count() == 0
    odd = packing.pack(packing.pieces(spark.createDataFrame([(None, "a b"), (1, "слово"), (1, None), (1, "a b")], "doc_id bigint, text string"), path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in odd) == sorted((i is None, i or 0, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x in [(None, "a b"), (1, "слово"), (1, ""), (1, "a b")])


def test_bounds_and_exchange(spark):
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = rng.integers(1, 101, 60)
        bins = packing.best_fit(n, 100)
        assert np.bincount(bins, weights=n).max() <= 100 and packing.lower_bound(n, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.zeros(0, int), 100) == 0
    n = rng.integers(20, 45, 3000)
    cut = spark.createDataFrame([(i, 0, 0, int(x), 0) for i, x in enumerate(n)], packing.PIECES)
    packed = packing.pack(cut, 100, per_task=150)
    few = packed.select("sequence_id").distinct().count()
    none = packing.pack(cut, 100, per_task=150, exchange=False).select("sequence_id").distinct().count()
    assert packing.lower_bound(n, 100) <= few <= none and packed.where('gap < 0 or bound < 1').count() == 0
    assert packed.count() == len(n) and packed.groupBy('sequence_id').agg(F.sum('length').alias('t')).where('t > 100').count() == 0


# -- op 10


@pytest.mark.parametrize("leaf, block", [(40, 4096), (100_000, 50)])
def test_embed(spark, leaf, block):
    rng = np.random.default_rng(6)
    base_ = rng.standard_normal((40, 16))
    x = np.concatenate([base_ + 0.1 * rng.standard_normal((40, 16)) for _ in range(8)] + [rng.standard_normal((100, 16))])
    x = np.concatenate([x, x[:30]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, []), (1004, [1.0] * 3), (1005, [2.0] * 3), (1006, [None] + [1.0] * 15)]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), leaf=leaf, block=block).toPandas().set_index("vec_id").sort_index()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    found = got.n_links.loc[: len(x) - 1].to_numpy()
    assert (found <= links.sum(1)).all() and found.sum() >= 0.97 * links.sum()
    if leaf > 1000:
        root = forest(len(x), *np.nonzero(links))
        assert (found == links.sum(1)).all() and (got.component_id.loc[: len(x) - 1].to_numpy() == root).all()
    assert got.n_links.loc[1000:].tolist() == [0, 0, 0, 0, 1, 1, 0] and got.component_id.loc[1005] == 1004
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


@pytest.mark.parametrize("depth, hot", [(7, True), (14, False)])
def test_forest_recall(depth, hot):
    """Links against brute force, for rows whose number is divisible by 50: a hot cluster at a moderate depth, and near copies down to 0.9 in a deep forest; and its size."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((9000, 64))
    if hot:
        x = np.concatenate([x, x[0] + 0.33 * rng.standard_normal((5000, 64))])
    x = np.concatenate([x, *(x[:3000] + size * rng.standard_normal((3000, 64)) for size in (0.1, 0.3, 0.45))])
    x = embed.unit(x)
    forest_ = embed.Forest(x[::2], depth)
    row, leaf = forest_.leaves(x)
    assert sum(c.size for _, cuts in forest_.trees for c in cuts) <= len(forest_.trees) * depth << embed.TOP
    begin = np.searchsorted(row, np.arange(len(x) + 1))
    lists = [set(leaf[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
    found = total = 0
    for i in range(0, len(x), 50):
        links = np.flatnonzero(x @ x[i] >= 0.9)
        total += len(links)
        found += sum(not lists[i].isdisjoint(lists[j]) for j in links.tolist())
    assert total > 500 and found >= 0.95 * total, (found, total)


# -- the pipeline


def test_pipeline(spark, edge):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = settle(stage(spark, docs, DATA))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        odd = stage(spark, edge, DATA)
        assert odd.columns == edge.columns and odd.count() <= len(EDGE), name
        docs = out
    assert p.STAGES[-1][1](spark, docs, DATA).select("doc_id").distinct().count() == docs.count()
