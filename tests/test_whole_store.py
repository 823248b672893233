"""Cases in which the store once did less than the whole job."""

import io
import json
import struct

import duckdb
from pyspark.sql import functions as F

from bitloom.functions import bits, text
from bitloom.operators import search
from bitloom.plans.collection import Collection
from bitloom.queries import QUERIES
from bitloom.sources import ctx


def test_many_in_batches(spark, monkeypatch):
    df = spark.createDataFrame([(i, i * 7 % 100) for i in range(100)], "ordinal bigint, x bigint")
    queries = spark.createDataFrame([(q, q * 3) for q in range(11)], "qid bigint, q bigint")
    joined = []
    broadcast = F.broadcast
    monkeypatch.setattr(search.F, "broadcast", lambda part: joined.append(part.count()) or broadcast(part))
    distance = F.abs(F.col("x") - F.col("q"))
    want = sorted(map(tuple, search.many(df, queries, distance, 3).select("qid", "rank", "ordinal", "score").collect()))
    assert joined == [11] and len(want) == 33
    monkeypatch.setattr(search, "BATCH", 4)
    got = sorted(map(tuple, search.many(df, queries, distance, 3).select("qid", "rank", "ordinal", "score").collect()))
    assert joined[1:] == [4, 4, 3] and got == want


def test_add_returns_every_item(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "wh"), "c")
    assert store.add([{"text": "t", "id": str(i)} for i in range(1200)]) == [(str(i), 1) for i in range(1200)]
    rows = spark.range(1500).select(F.concat(F.lit("d"), "id").alias("item_id"), F.lit("t").alias("text"))
    made = store.add(rows)
    assert made.columns == ["item_id", "chunks"] and made.count() == 1500 and store.count() == 2700


def scattered(spark, folder, name, rows, schema):
    """A table in several files, the last rows in the largest: Spark reads that one first."""
    half = len(rows) // 2
    for part, size in ((rows[:half], 2), (rows[half:], 1)):
        spark.createDataFrame(part, schema).coalesce(1).write.option("compression", "zstd" if size == 2 else "none").mode("append").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_insertion_order_of_several_files(spark, tmp_path):
    """the first rows by conversation and turn, in whatever order the files are read."""
    rows = [(c, t, "user", f"text {c} {t} " * 50) for c in range(30) for t in range(2)]
    d = scattered(spark, tmp_path, "conversations", rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted((r.n, r.chunk_id, r.text) for r in QUERIES["insertion_order_head"](spark, d).collect())
    assert got == [(n + 1, f"{c}_{t}", x) for n, (c, t, _, x) in enumerate(rows[:20])]


def test_ties_of_several_files(spark, tmp_path):
    """equal scores go by doc_id, which is compared as a number, in whatever order the files are read."""
    d = scattered(spark, tmp_path, "documents", [(i, "the same words " * 50) for i in range(30)], "doc_id bigint, text string")
    assert [tuple(r) for r in QUERIES["retrieve_text"](spark, d).collect()] == [(i, 0) for i in range(5)]


def test_order_by_columns(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "wh"), "c")
    c.add(spark.createDataFrame([(b, a, f"{a} {b}") for b in range(3) for a in range(12)], "turn int, item_id int, text string"), order=["item_id", "turn"])
    assert [r.text for r in c.dump().collect()] == [f"{a} {b}" for a in range(12) for b in range(3)]


def test_rounding_as_in_sql(spark):
    """what rounds to zero keeps its sign, and halves are those of the scaled number."""
    values = [-3e-7, 3e-7, -0.0, 0.0, 0.1234565, -0.1234565, 2.5e-6, 0.49999999999999994e-6, 1e300, -1e308, float("inf"), float("-inf"), float("nan"), 7.0, 1.0000005]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", bits.rounded(F.col("x")).alias("y")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [x]).fetchall()[0][0] for x in values]
    assert list(map(repr, got)) == list(map(repr, want))
    spark.createDataFrame([(0, [1.0, -1e-9]), (1, [3.0, None, 4.0])], "vec_id bigint, embedding array<float>").createOrReplaceTempView("e")
    unit = {r.vec_id: repr(r.unit) for r in spark.table("e").select("vec_id", F.transform(bits.l2_normalize(F.col("embedding")), lambda x: bits.rounded(x)).alias("unit")).collect()}
    assert unit == {0: "[1.0, -0.0]", 1: "[0.6, None, 0.8]"}


def test_many_sorts_few_rows(spark, monkeypatch):
    """the cross product isn't sorted; results are those of sorting it, with ties, nulls and repeated codes too."""
    df = spark.range(6000).select(F.col("id").alias("ordinal"), F.expr("CASE WHEN id = 77 THEN NULL WHEN id % 3 = 0 THEN 5 ELSE id * 7919 % 1000 END").alias("x")).repartition(4).localCheckpoint()
    queries = spark.range(40).select(F.col("id").alias("qid"), (F.col("id") * 25).alias("q"))
    distance = F.abs(F.col("x") - F.col("q"))
    found = lambda: sorted(map(tuple, search.many(df, queries, distance, 3).select("qid", "rank", "ordinal", "score").collect()))
    got, plan = found(), search.many(df, queries, distance, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "_score" in plan and len(got) == 120
    monkeypatch.setattr(search, "LEAST", 10**9)
    assert got == found()
    for share in (2, 4):  # several levels
        monkeypatch.setattr(search, "LEAST", 20)
        monkeypatch.setattr(search, "SHARE", share)
        assert got == found()


def test_cosines_in_blocks(spark, monkeypatch):
    """blocks of queries and tiles cover all pairs, whatever the vectors; no pair goes through an interpreted expression."""
    vectors = [[1.0, 2.0, 2.0], [-2.0, 1.0, 1e-7], None, [0.0] * 3, [1.0, None, 2.0], [1.0, 2.0], [], [3.0, -1.0, 0.5]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    q = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    found = lambda: sorted(map(repr, map(tuple, search.cosines(df, q).collect())))
    plain = [0, 1, 3, 7]
    sql = lambda a, b: duckdb.execute("SELECT round(list_cosine_similarity(CAST(CAST(? AS FLOAT[]) AS DOUBLE[]), CAST(CAST(? AS FLOAT[]) AS DOUBLE[])), 6)", [a, b]).fetchall()[0][0]
    want = [repr((j, i, sql(v, w) if i in plain and j in plain else 1.0 if i == j == 5 else None)) for i, v in enumerate(vectors) for j, w in enumerate(vectors)]
    assert found() == sorted(want)
    monkeypatch.setattr(search, "PAIRED", 3)
    monkeypatch.setattr(search, "TILE", (1, 2))
    assert found() == sorted(want)


def test_long_texts_are_cut_once(spark):
    """F8: a text's tokens are found once, not once a window."""
    long = "word, " * 20000
    df = spark.createDataFrame([(0, long), (1, ""), (2, "a b"), (3, None)], "i int, t string")
    for chunks in (text.token_chunks, text.word_chunks):
        out = df.select("i", chunks(F.col("t")).alias("c"))
        assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
        got = {r.i: r.c for r in out.collect()}
        assert len(got[0]) == -(-(60000 if chunks is text.token_chunks else 20000) // 512) and got[1] == [""] and got[2] == ["a b"] and got[3] is None


def test_ctx_in_blocks(spark, tmp_path, monkeypatch):
    """files are written and read in blocks, with the bytes and rows of the whole-file functions."""
    rows = [(f"k{i}é", "tëxt " * (i % 50), {"n": i, "l": [1, "}", {"a": None}]}, [float(-1 - (i + j) % 256) for j in range(64)]) for i in range(300)]
    raw = ctx.dump_ctx({}, rows)

    class Once(io.BytesIO):  # fails if the file is read whole
        def read(self, n=-1):
            assert 0 <= n <= 4096
            return super().read(n)

    monkeypatch.setattr(ctx, "BLOCK", 64)
    got = list(ctx.rows_of(Once(raw), len(raw)))
    _, vectors, texts, metadata = ctx.parse_ctx(raw)
    assert [(r[1], r[2], {k: json.loads(v) for k, v in r[3].items()}) for r in got] == [(k, t, m) for (k, m), t in zip(metadata.items(), texts)]
    assert [r[4] for r in got] == [ctx.to_code(v) for v in vectors]
    body = b'{"a": {"x": 1}, "b": {}, "a": {"x": 2}}  '
    twice = ctx.MAGIC + struct.pack("<III", 1, ctx.METADATA, len(body)) + body
    assert [(r[1], r[3]) for r in ctx.rows_of(io.BytesIO(twice), len(twice))] == [("a", {"x": "2"}), ("b", {})]
    made = [(i, k, t, {n: json.dumps(x) for n, x in m.items()}, None, v) for i, (k, t, m, v) in enumerate(rows)]
    writer = ctx.CtxWriter({"path": str(tmp_path / "f.ctx")})
    for order in (made, made[::-1]):
        part = writer.write(iter([dict(zip(("ordinal", "chunk_id", "text", "metadata", "code", "embedding"), r)) for r in order])).part
        assert open(part, "rb").read() == ctx.dump_ctx(writer.header, rows)
