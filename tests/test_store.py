"""The store's API: collections, metadata, chunking, sources, the CTX container, streaming."""

import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitloom.functions import bits, distance, metadata, text
from bitloom.operators import search
from bitloom.plans import storage
from bitloom.plans.collection import Collection
from bitloom.sources import ctx, readers
from bitloom.streaming.ingest import ingest


@pytest.fixture
def store(spark, tmp_path):
    return Collection(spark, str(tmp_path / "wh"), "c")


def test_add_get_update_delete(store, spark, tmp_path):
    store.add([{"text": "Text 1", "metadata": {"category": "A"}, "id": "x"}, {"text": "Text 2", "metadata": {"category": "B"}, "id": "y"}, {"text": "Text 3", "metadata": {"category": "A"}, "id": "z"}])
    assert store.count() == 3
    assert store.get(["z", "x", "nope", "z"]) == [("z", "Text 3", {"category": "A"}), ("x", "Text 1", {"category": "A"}), ("z", "Text 3", {"category": "A"})]
    assert [i for i, _, _ in store.get(where={"category": "A"})] == ["x", "z"]
    assert store.get(where={"absent": None}) and not store.get(where={"category": None})
    assert store.update("x", text="changed", metadata={"updated": True}) and not store.update("nope", text="t")
    assert store.get("x") == [("x", "changed", {"category": "A", "updated": True})]
    assert store.get(where={"updated": 1})[0][0] == "x" and not store.get(where={"updated": "1"})
    again = Collection(spark, str(tmp_path / "wh"), "c")
    assert again.count() == 3 and again.get("x")[0][1] == "changed"
    assert again.delete(["x", "y"]) == 2 and again.count() == 1 and again.delete("x") == 0
    again.set("w", "new", {"original": True})
    again.set("w", metadata={"updated": True})
    assert again.get("w") == [("w", "new", {"original": True, "updated": True})]
    again.clear()
    assert again.count() == 0 and Collection(spark, str(tmp_path / "wh"), "c").count() == 0


def test_add_is_pending_and_chunks(store, spark, tmp_path):
    (made,) = store.add("a" * 2048 + "b" * 3, item_id="d", need_chunks=True)
    assert made == ("d", 2)
    assert Collection(spark, str(tmp_path / "wh"), "c").count() == 0
    assert store.get("d")[0][1] == "a" * 2048 + " bbb"
    assert store.add("", item_id="e", need_chunks=True) == [] and store.add("", item_id="e", need_chunks=True, fast=False) == [("e", 1)]


def test_prefix_and_exact_ids(store):
    for i in ("a", "a_b"):
        store.add("t", item_id=i)
    assert store.items("a", prefix=True).count() == 1 and store.items("a", prefix=True).first().text == "t t"
    assert len(store.get("a")) == 1 and store.delete("a") == 1 and store.count() == 1


def test_retrieve(store):
    assert store.retrieve("") is None
    with pytest.raises(ValueError):
        store.retrieve("x")
    store.add([{"text": t, "metadata": {"n": n % 2}} for n, t in enumerate(["red fox", "blue whale", "green tree", "red fox jumps", "sand"])])
    hits = store.retrieve("red fox", top_k=3, return_scores=True)
    assert hits[0][1] == "red fox" and hits[0][3] == 0 and [h[3] for h in hits] == sorted(h[3] for h in hits)
    assert all(h[2] == {"n": 1} for h in store.retrieve("red fox", top_k=2, metadata={"n": 1}))
    assert len(store.retrieve("red fox", top_k=5, metadata={"n": 1}, mode="pre")) == 2
    two = store.retrieve(["red fox", "sand"], top_k=2, return_scores=True)
    assert [h[3] for h in two] == [0, 0]


def test_set_batch(store):
    ids = store.set_batch(["a", "b"], [[1] * 8, [2] * 8], [{"k": 1}, {}])
    assert store.count() == 2 and store.get(ids[0])[0][2] == {"k": 1}
    with pytest.raises(ValueError):
        store.set_batch(["a"], [])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=80), st.data())
def test_distances(spark, a, data):
    b = data.draw(st.lists(st.integers(0, 255), min_size=len(a), max_size=len(a)))
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    left, right = bits.words(F.col("a"), len(a)), bits.words(F.col("b"), len(a))
    r = df.select(distance.xor_sum(F.col("a"), F.col("b")), distance.packed_xor_sum(left, right), distance.hamming_bits(F.col("a"), F.col("b")), distance.packed_hamming(left, right), distance.byte_mismatch(F.col("a"), F.col("b")), F.array(*left)).first()
    x = [p ^ q for p, q in zip(a, b)]
    assert tuple(r)[:5] == (sum(x), sum(x), sum(v.bit_count() for v in x), sum(v.bit_count() for v in x), sum(v > 0 for v in x))
    assert r[5] == bits.word_values(a)


def test_signs(spark):
    df = spark.createDataFrame([([0.0, -0.0, float("nan"), 1.0, None, 2.0, -3.0, 1e-9, 5.0],)], "v array<double>")
    assert df.select(bits.code(F.col("v"))).first()[0] == [0b00010101, 0b10000000]


def test_canonical():
    c = metadata.canonical
    assert c(1) == c(1.0) == c(True) != c("1") and c(None) is None and c({"b": 1, "a": [True]}) == c({"a": [1.0], "b": 1})


@pytest.mark.parametrize("value", ["", "x" * 2048, "x" * 2049, "𝄞" * 2050])
def test_char_chunks(spark, value):
    got = spark.createDataFrame([(value,)], "t string").select(text.char_chunks(F.col("t"))).first()[0]
    assert got == [value[i : i + 2048] for i in range(0, len(value), 2048)]


def test_token_chunks_join(spark):
    value = "one, two  three\n" * 300
    got = spark.createDataFrame([(value,)], "t string").select(text.token_chunks(F.col("t"), 100), text.colour_tokens(text.tokens(F.lit("a b")))).first()
    assert "".join(got[0]) == value and len(got[0]) > 1 and got[1].startswith("\x1b[41ma")


def test_ties_and_widths(spark):
    df = spark.createDataFrame([(i, [1] * 8) for i in range(20)] + [(99, [1] * 4)], "ordinal bigint, code array<int>")
    got = search.top_k(search.same_width(df, 8), search.distance_to([1] * 8), 3).collect()
    assert [r.ordinal for r in got] == [0, 1, 2]


def test_ctx(spark, tmp_path):
    rows = [(0, "a_0", "héllo", {"k": "1"}, list(range(64)), None), (1, "b_0", "", {}, [255] * 64, None)]
    df = spark.createDataFrame(rows, ctx.SCHEMA)
    path = str(tmp_path / "f.ctx")
    ctx.write_ctx(df, path)
    got = ctx.read_ctx(spark, path).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == rows
    raw = open(path, "rb").read()
    for bad in (b"XXXX" + raw[4:], raw[:4] + struct.pack("<I", 2) + raw[8:], raw + struct.pack("<II", 9, 0)):
        with pytest.raises(ValueError):
            ctx.parse_ctx(bad)
    with pytest.raises(ValueError):
        ctx.dump_ctx({}, [("a", "t", {}, [0.0] * 3)])


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello world")
    (tmp_path / "a.csv").write_text("x,y\n1,true\n,false\n")
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.pdf").write_bytes(b"p1|p2")
    assert readers.read_file(spark, str(tmp_path / "a.txt")).first().text == "hello world"
    assert sorted(r.row for r in readers.read_file(spark, str(tmp_path / "a.csv")).collect()) == [["1", "True"], ["nan", "False"]]
    assert readers.read_file(spark, str(tmp_path / "a.docx")).first().text == "one\n\ntwo"
    cut = lambda b: b.decode().split("|")
    assert readers.read_pdf(spark, str(tmp_path / "a.pdf"), cut).first().text == "p1p2"
    assert [r.text for r in readers.read_pdf_pages(spark, str(tmp_path / "a.pdf"), cut).orderBy("page").collect()] == ["p1", "p2"]
    page = readers.read_webpage(spark, "https://example.com", lambda u: "<p>a &amp;  b</p><script>x</script>").first()
    assert page.text == "a & b"
    with pytest.raises(FileNotFoundError):
        readers.read_file(spark, str(tmp_path / "no.txt"))
    with pytest.raises(ValueError):
        readers.read_webpage(spark, "file:///etc/passwd")


def test_stream(spark, tmp_path, store):
    spark.createDataFrame([("s1", "alpha beta"), ("s2", "gamma")], "item_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id string, text string").parquet(str(tmp_path / "in"))
    ingest(stream, store, str(tmp_path / "ck")).awaitTermination(60)
    assert store.count() == 2 and store.retrieve("gamma", top_k=1)[0][1] == "gamma"


def test_parts_and_compaction(spark, tmp_path, monkeypatch):
    """Changes write their own rows only; many parts become one; a table that is open stays readable."""
    c = Collection(spark, str(tmp_path / "wh"), "c")
    c.add([{"text": f"t{i}", "id": f"i{i}"} for i in range(5)])
    c.save()
    before = c.table
    monkeypatch.setattr(storage, "PARTS", 3)
    for i in range(4):
        assert c.update("i1", text=f"new {i}")
    assert c.delete("i2") == 1 and len(c._parts) <= 3 and c._generation >= 1
    again = Collection(spark, str(tmp_path / "wh"), "c")
    assert [(r.item_id, r.text) for r in again.dump().collect()] == [("i0", "t0"), ("i1", "new 3"), ("i3", "t3"), ("i4", "t4")]
    assert before.count() == 5
    other = Collection(spark, str(tmp_path / "wh"), "c")
    other.add("x", item_id="o")
    again.add("y", item_id="p")
    other.save()
    with pytest.raises(Exception, match="exist"):  # two writers of one version
        again.save()


def test_many_partitions(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "wh"), "c")
    c.add(spark.range(40).repartition(1100).select(F.lit("t").alias("text")), item_id="d")
    got = c.dump().collect()
    assert len(got) == 40 and len({r.ordinal for r in got}) == 40 and sorted(r.chunk_idx for r in got) == list(range(40))


def test_metadata_forms(store):
    store.add([{"text": "a", "metadata": {"n": 1e16, "l": [1.0, True], "o": {"x": 2.0}}, "id": "a"}, {"text": "b", "metadata": {"n": 1}, "id": "b"}])
    for where in ({"n": 1e16}, {"n": 10**16}, {"l": [1, 1]}, {"l": [1.0, True]}, {"o": {"x": 2}}):
        assert [r[0] for r in store.get(where=where)] == ["a"], where
    assert store.get("a")[0][2] == {"n": 1e16, "l": [1.0, True], "o": {"x": 2.0}}
    store.update("a", metadata={"n": True})
    assert [r[0] for r in store.get(where={"n": 1})] == ["a", "b"]


def test_widths(store, spark):
    store.set_batch(["a", "b"], [[1] * 4, [2] * 4])
    with pytest.raises(ValueError):
        store.retrieve("x")
    store.set_batch(["neg", "odd"], [[-128] * 8, [300.7] * 8])
    got = {r.text: r.code for r in store.table.collect()}
    assert got["neg"] == [0] * 8 and got["odd"] == [300] * 8
    hits = store.search([0] * 8, 5).collect()
    assert [(r.text, r.score) for r in hits] == [("neg", 0), ("odd", 2400)]
    ids = store.set_batch(spark.createDataFrame([("v", [1.0, -1.0] * 32)], "text string, vector array<double>"))
    assert ids.count() == 1 and store.search([0xAA] * 8, 1).first().text == "v"


def test_retrieve_several_filtered(store):
    store.add([{"text": t, "metadata": {"n": n % 2}} for n, t in enumerate(["red fox", "blue whale", "green tree", "red fox jumps", "sand"])])
    one = [store.retrieve(q, top_k=2, metadata={"n": 0}, return_scores=True) for q in ("red fox", "sand")]
    assert [h[3] for h in store.retrieve(["red fox", "sand"], top_k=4, metadata={"n": 0}, return_scores=True)] == sorted(h[3] for x in one for h in x)


def test_tokenizer_hook(spark, tmp_path):
    import public_tokenizers as P

    own = text.tiktoken_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    value = "Some words, <|endoftext|> and more. " * 40
    row = spark.createDataFrame([(value,), (None,)], "t string").select(own.count(F.col("t")).alias("n"), own.chunks(F.col("t"), 100).alias("c")).collect()
    assert "".join(row[0].c) == value and len(row[0].c) == -(-row[0].n // 100) > 1 and row[1].c == [""] and row[1].n == 0
    c = Collection(spark, str(tmp_path / "wh"), "c", tokenizer=own)
    assert c.add(value, item_id="x", need_chunks=True, fast=False) == [("x", max(1, -(-row[0].n // 512)))]


def test_entities(spark):
    cases = {"a &#65;&#x42; &lt;b&gt; &amp;lt;": "a AB <b> &lt;", "&#0; &#1114112;": "\ufffd \ufffd", "&#128512;&eacute;&unknown;": "😀é&unknown;", "none": "none"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r.got == r.want for r in df.select("want", text.html_text(F.col("t")).alias("got")).collect())


def test_index(spark):
    from bitloom.operators.index import CodeIndex

    index = CodeIndex(spark)
    index.add("a", [1, 2, 3, 4])
    index.add_batch(["b", "c", "a"], [[1, 2, 3, 0], [9, 9, 9, 9], [1, 2, 0, 0]])
    assert [tuple(r) for r in index.search([1, 2, 3, 4], 2).collect()] == [("b", 0.75), ("a", 0.5)]
    index.remove("b")
    assert index.table.count() == 2 and index.search([1, 2], 3).count() == 0


def test_shared_folder(spark, monkeypatch):
    from bitloom import shared

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5 and set(e.oracle_sql()) <= set(e.queries())
