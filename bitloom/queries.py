"""The catalogue: one query an operator over the driver's tables, with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import bits, distance, metadata, text
from .operators import embedding, search
from .operators.index import CodeIndex
from .plans.collection import Collection, regroup
from .shared import shared_dir
from .sources import ctx, readers
from .sources.readers import pages_text, rows_as_strings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WIDTH = 8  # bytes of the test vectors' codes


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def _store(spark: SparkSession, kind: str = "store") -> Collection:
    """An empty collection of its own in the shared folder."""
    return Collection(spark, f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}", "c")


def _talks(spark: SparkSession, d: str) -> Collection:
    """A collection of the conversations: an item is a conversation, a chunk a turn."""
    c = _store(spark)
    rows = table(spark, d, "conversations", "conv_id", "turn", "text", "role")
    c.add(rows.select(F.col("conv_id").alias("item_id"), "turn", "text", F.create_map(F.lit("role"), F.concat(F.lit('"'), "role", F.lit('"'))).alias("metadata")), order=["item_id", "turn"])
    c.save()
    return c


def _turns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("item_id").cast("bigint").alias("conv_id"), F.col("chunk_idx").cast("bigint").alias("turn"), "text")


def _codes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """vec_id, code, packed word, further columns."""
    df = table(spark, d, "embeddings", "vec_id", "embedding", *more).select("vec_id", *more, bits.code(F.col("embedding")).alias("code"))
    return df.select("*", *bits.words(F.col("code"), WIDTH))


def _query_code(codes: DataFrame, vec_id: int = 0) -> list[int]:
    """The code of a row. None has that id: zeros, which nothing is compared with then (see _near)."""
    found = codes.where(F.col("vec_id") == vec_id).select("code").first()
    return found.code if found else []


def _near(codes: DataFrame, metric: str = "xor_sum") -> tuple[DataFrame, Column]:
    """The rows that the query, vec_id 0, is compared with, and their distance; no rows without it."""
    q = _query_code(codes)
    return (codes, search.distance_to(q, metric, words=[F.col("w0")])) if q else (codes.limit(0), F.lit(0).cast("bigint"))


def _beside(rows: DataFrame, query: list) -> tuple[DataFrame, Column]:
    """Rows and a driver-side query as an array; no rows without one."""
    return (rows, F.array(*map(F.lit, query))) if query else (rows.limit(0), F.array(F.lit(0)))


def _pack_sql(source: str = "embedding", n: int = 64) -> str:
    byte = " + ".join(f"(CASE WHEN {source}[8*j+{i + 1}] > 0 AND NOT isnan({source}[8*j+{i + 1}]) THEN {2 ** (7 - i)} ELSE 0 END)" for i in range(8))
    return f"list_transform(range({n // 8}), lambda j: CAST({byte} AS INTEGER))"


CODES_SQL = f"c AS (SELECT vec_id, label, {_pack_sql()} AS code FROM embeddings)"
XOR_SQL = "CAST(list_sum(list_transform(range(1, 9), lambda i: xor(a.code[i], b.code[i]))) AS BIGINT)"
HAMMING_SQL = "CAST(list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(a.code[i], b.code[i])))) AS BIGINT)"
MISMATCH_SQL = "CAST(list_sum(list_transform(range(1, 9), lambda i: CASE WHEN a.code[i] <> b.code[i] THEN 1 ELSE 0 END)) AS BIGINT)"


@query(f"WITH {CODES_SQL} SELECT vec_id, code FROM c")
def binarize_pack(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", bits.code(F.col("embedding")).alias("code"))


@query(f"SELECT vec_id, {_pack_sql(n=32)} AS code FROM embeddings")
def truncate_binarize(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", bits.code(F.col("embedding"), 32).alias("code"))


@query("""SELECT vec_id, list_transform(e, lambda x: round(x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12), 6)) AS unit
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.transform(bits.l2_normalize(F.col("embedding")), lambda x: bits.rounded(x)).alias("unit"))


@query(f"WITH {CODES_SQL} SELECT a.vec_id, {XOR_SQL} AS score FROM c a, c b WHERE b.vec_id = 0 ORDER BY score, a.vec_id LIMIT 5")
def topk_xor_sum(spark, d):
    return search.top_k(*_near(_codes(spark, d)), 5, "vec_id").select("vec_id", "score")


@query(f"WITH {CODES_SQL} SELECT a.vec_id, {HAMMING_SQL} AS score FROM c a, c b WHERE b.vec_id = 0 ORDER BY score, a.vec_id LIMIT 5")
def topk_hamming_bits(spark, d):
    return search.top_k(*_near(_codes(spark, d), "hamming"), 5, "vec_id").select("vec_id", "score")


@query(f"WITH {CODES_SQL} SELECT a.vec_id, {MISMATCH_SQL} AS mismatches, round(1 - {MISMATCH_SQL} / 8.0::DOUBLE, 6) AS score FROM c a, c b WHERE b.vec_id = 0 ORDER BY score DESC, a.vec_id LIMIT 5")
def topk_byte_mismatch(spark, d):
    codes = _codes(spark, d)
    codes, q = _beside(codes, _query_code(codes))
    return search.top_k(codes, bits.rounded(distance.mismatch_similarity(F.col("code"), q)), 5, "vec_id", descending=True).select("vec_id", distance.byte_mismatch(F.col("code"), q).alias("mismatches"), "score")


@query(f"WITH {CODES_SQL} SELECT a.vec_id, round(1 - {MISMATCH_SQL} / 64.0::DOUBLE, 6) AS score FROM c a, c b WHERE b.vec_id = 0")
def bit_scaled_score(spark, d):
    codes = _codes(spark, d)
    codes, q = _beside(codes, _query_code(codes))
    return codes.select("vec_id", bits.rounded(distance.bit_scaled_score(F.col("code"), q)).alias("score"))


COSINE_SQL = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query(f"SELECT a.vec_id, {COSINE_SQL} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY score DESC, a.vec_id LIMIT 10")
def topk_cosine(spark, d):
    df = table(spark, d, "embeddings", "vec_id", "embedding")
    found = df.where("vec_id = 0").first()
    df, q = _beside(df, [float(x) for x in found.embedding] if found else [])
    return search.top_k(df, bits.rounded(distance.cosine(F.col("embedding"), q)), 10, "vec_id", descending=True).select("vec_id", "score")


@query(f"SELECT b.vec_id AS qid, a.vec_id, {COSINE_SQL} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0")
def cosine_pairs(spark, d):
    """A stated query set (ids divisible by 50) against all rows."""
    df = table(spark, d, "embeddings", "vec_id", "embedding")
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return search.cosines(df, q)


@query(f"WITH {CODES_SQL}, k AS (SELECT a.vec_id, a.label, {XOR_SQL} AS score FROM c a, c b WHERE b.vec_id = 0 ORDER BY score, a.vec_id LIMIT 20) SELECT vec_id, score FROM k WHERE label = 2 ORDER BY score, vec_id LIMIT 5")
def retrieve_post_filter(spark, d):
    return search.filtered_top_k(*_near(_codes(spark, d, "label")), 5, F.col("label") == 2, tie="vec_id").select("vec_id", "score")


@query(f"WITH {CODES_SQL} SELECT a.vec_id, {XOR_SQL} AS score FROM c a, c b WHERE b.vec_id = 0 AND a.label = 2 ORDER BY score, a.vec_id LIMIT 5")
def retrieve_pre_filter(spark, d):
    return search.filtered_top_k(*_near(_codes(spark, d, "label")), 5, F.col("label") == 2, mode="pre", tie="vec_id").select("vec_id", "score")


def _many(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows."""
    codes = _codes(spark, d)
    queries = codes.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("w0").alias("q0"))
    return search.many(codes, queries, distance.packed_xor_sum([F.col("w0")], [F.col("q0")]), 5, "vec_id")


MANY_SQL = f"""WITH {CODES_SQL}, s AS (SELECT b.vec_id AS qid, a.vec_id, {XOR_SQL} AS score FROM c a, c b WHERE b.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, vec_id) AS rank FROM s)"""


@query(f"{MANY_SQL} SELECT qid, vec_id, score, rank FROM r WHERE rank <= 5")
def retrieve_per_query(spark, d):
    return _many(spark, d).select("qid", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"{MANY_SQL} SELECT qid, vec_id, score FROM r WHERE rank <= 5 ORDER BY score, qid, rank LIMIT 5")
def retrieve_multi_query(spark, d):
    return search.union_top_k(_many(spark, d), 5).select("qid", "vec_id", "score")


@query("""SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM
    (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL""")
def mean_pool_by_label(spark, d):
    return embedding.mean_pool(table(spark, d, "embeddings", "label", "embedding"), "label").select("label", "dim", bits.rounded(F.col("x")).alias("mean"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, substring(text, i * 2048 + 1, 2048) AS text FROM
    (SELECT doc_id, text, unnest(range((length(text) + 2047) // 2048)) AS i FROM documents)""")
def chunk_chars(spark, d):
    return text.explode_chunks(table(spark, d, "documents", "doc_id", "text"), text.char_chunks(F.col("text")), ["doc_id"])


@query("SELECT count(*) AS chunks, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT length(text) AS n, unnest(range((length(text) + 2047) // 2048)) AS i FROM documents)")
def chunk_count(spark, d):
    chunks = table(spark, d, "documents", "text").select(F.length("text").alias("n"), F.explode(text.char_chunks(F.col("text"))).alias("c"))
    return chunks.agg(F.count("*").alias("chunks"), F.sum("n").cast("bigint").alias("chars"))


WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, array_to_string(w[i * 512 + 1 : i * 512 + 512], ' ') AS text
    FROM (SELECT doc_id, w, unnest(range(greatest(1, (len(w) + 511) // 512))) AS i FROM w)""")
def chunk_words(spark, d):
    return text.explode_chunks(table(spark, d, "documents", "doc_id", "text"), text.word_chunks(F.col("text")), ["doc_id"])


TOKENS_SQL = r"regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+|\s+')"


@query(f"""WITH t AS (SELECT doc_id, text, {TOKENS_SQL} AS t FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, CASE WHEN len(t) <= 512 THEN text ELSE array_to_string(t[i * 512 + 1 : i * 512 + 512], '') END AS text
    FROM (SELECT doc_id, text, t, unnest(range(greatest(1, (len(t) + 511) // 512))) AS i FROM t)""")
def chunk_tokens(spark, d):
    return text.explode_chunks(table(spark, d, "documents", "doc_id", "text"), text.token_chunks(F.col("text")), ["doc_id"])


@query(f"SELECT doc_id, CAST(len({TOKENS_SQL}) AS INTEGER) AS tokens, CAST(len({TOKENS_SQL}) + 2 AS INTEGER) AS model_tokens FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.token_count(F.col("text")).alias("tokens"), text.token_count(F.col("text"), 2).alias("model_tokens"))


def _html_sql() -> str:
    t = r"regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = rf"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    t = rf"trim(regexp_replace({t}, '[ \t\r\n]+', ' ', 'g'), ' ')"
    for entity, char in text.ENTITIES:
        t = f"replace({t}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return t


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_to_text(spark, d):
    return pages_text(table(spark, d, "pages", "page_id", "html")).select("page_id", "text")


@query("SELECT [coalesce(CAST(n_nationkey AS VARCHAR), 'nan'), coalesce(n_name, 'nan'), coalesce(CAST(n_regionkey AS VARCHAR), 'nan')] AS row FROM nation")
def csv_rows_as_strings(spark, d):
    return rows_as_strings(table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"))


HASH_SQL = rf"""w AS (SELECT doc_id, md5(unnest({WORDS_SQL})) AS h FROM documents),
    s AS (SELECT doc_id, CAST(('0x' || substring(h, 1, 8))::BIGINT % 64 AS INTEGER) AS d, CASE WHEN ('0x' || substring(h, 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END AS s FROM w),
    v AS (SELECT doc_id, d FROM s GROUP BY ALL HAVING sum(s) > 0),
    b AS (SELECT doc_id, d // 8 AS j, CAST(sum(1 << (7 - d % 8)) AS INTEGER) AS x FROM v GROUP BY ALL),
    c AS (SELECT k.doc_id, list(coalesce(b.x, 0) ORDER BY k.j) AS code FROM (SELECT doc_id, unnest(range(8)) AS j FROM documents) k
        LEFT JOIN b ON b.doc_id = k.doc_id AND b.j = k.j GROUP BY k.doc_id)"""


@query(f"WITH {HASH_SQL} SELECT doc_id, code FROM c")
def hash_embed(spark, d):
    return embedding.HashEmbedder().codes(table(spark, d, "documents", "doc_id", "text"), "doc_id")


@query(f"WITH {HASH_SQL} SELECT a.doc_id, {XOR_SQL} AS score FROM c a, c b WHERE b.doc_id = 0 ORDER BY score, a.doc_id LIMIT 5")
def retrieve_text(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    c = _store(spark)
    c.add(docs.select(F.col("doc_id").alias("item_id"), "text"), order="item_id")  # ties go by doc_id
    q = docs.where("doc_id = 0").first()
    hits = c.search(q.text if q else "", 5)
    return hits.select(F.split_part("chunk_id", F.lit("_"), F.lit(1)).cast("bigint").alias("doc_id"), "score")


@query("""SELECT CAST(p - 1 AS INTEGER) AS pos, CAST(i AS BIGINT) AS item_id, string_agg(text, ' ' ORDER BY turn) AS text FROM
    (SELECT unnest([3, 1, 3, 999999]) AS i, generate_subscripts([3, 1, 3, 999999], 1) AS p) JOIN conversations ON conv_id = i GROUP BY p, i""")
def get_by_ids(spark, d):
    """In the order of the ids, repeats repeated, unknown ids left out."""
    got = _talks(spark, d).items(["3", "1", "3", "999999"]).coalesce(1)
    return got.select(F.monotonically_increasing_id().cast("int").alias("pos"), F.col("item_id").cast("bigint").alias("item_id"), "text")


@query("SELECT conv_id || '_' || turn AS chunk_id, text FROM conversations WHERE starts_with(conv_id || '_' || turn, '1_')")
def get_prefix(spark, d):
    return _talks(spark, d).chunks("1", prefix=True).select("chunk_id", "text")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def item_regroup(spark, d):
    return regroup(table(spark, d, "conversations", "conv_id", "turn", "text"), ["conv_id"], order="turn")


def _props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "props").select("event_id", F.from_json("props", "map<string,string>").alias("metadata"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '3'")
def where_metadata(spark, d):
    return _props(spark, d).where(metadata.matches(F.col("metadata"), {"k": 3})).select("event_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def where_missing_key_null(spark, d):
    """A wanted None matches rows that lack the key."""
    labels = table(spark, d, "labels", "doc_id", "quality")
    rows = table(spark, d, "documents", "doc_id").join(labels, "doc_id", "left").select("doc_id", F.when(F.col("quality").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("quality"), F.col("quality").cast("string"))).alias("metadata"))
    return rows.where(metadata.matches(F.col("metadata"), {"quality": None})).select("doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'new' AS src FROM events")
def metadata_merge(spark, d):
    left = F.map_concat(F.col("metadata"), F.create_map(F.lit("src"), F.lit("old")))
    rows = _props(spark, d).select("event_id", metadata.merge(left, F.create_map(F.lit("src"), F.lit("new"))).alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("src")).alias("src"))


@query("SELECT count(*) AS chunks FROM documents")
def count_chunks(spark, d):
    c = _store(spark)
    c.add(table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("item_id"), "text"))
    return spark.createDataFrame([(c.count(),)], "chunks bigint")


GONE = ["1", "3", "999999"]


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id NOT IN (1, 3, 999999)")
def delete_ids(spark, d):
    c = _talks(spark, d)
    c.delete(GONE)
    return _turns(Collection(spark, c.catalog.root, c.name).table)


@query("SELECT count(*) AS deleted FROM conversations WHERE conv_id IN (1, 3, 999999)")
def deleted_count(spark, d):
    return spark.createDataFrame([(_talks(spark, d).delete(GONE),)], "deleted bigint")


@query("SELECT conv_id, turn, CASE WHEN conv_id = 3 THEN 'updated' ELSE text END AS text FROM conversations")
def update_items(spark, d):
    c = _talks(spark, d)
    c.update("3", text="updated")
    return _turns(Collection(spark, c.catalog.root, c.name).table)


@query("""SELECT conv_id, turn, CASE WHEN conv_id = 1 THEN 'replaced' ELSE text END AS text FROM conversations
    UNION ALL SELECT 999999, 0, 'inserted'""")
def upsert_items(spark, d):
    """An item that is there is updated, one that isn't is added."""
    c = _talks(spark, d)
    c.set("1", text="replaced")
    c.set("999999", text="inserted")
    return _turns(Collection(spark, c.catalog.root, c.name).table)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread FROM events GROUP BY event_type")
def latency_stats(spark, d):
    return table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(bits.rounded(F.avg("value")).alias("mean"), bits.rounded(F.stddev_pop("value")).alias("spread"))


@query("SELECT item_id, 'Represent this sentence for searching relevant passages: ' || text AS query FROM benchmark")
def prompt_prefix(spark, d):
    return table(spark, d, "benchmark", "item_id", "text").select("item_id", text.prompted(F.col("text")).alias("query"))


@query("SELECT 'c' AS collection, count(*) AS count, count(DISTINCT conv_id) AS items, 'HashEmbedder' AS model FROM conversations")
def collection_info(spark, d):
    c = _talks(spark, d)
    return c.info()


@query("SELECT conv_id || '_' || turn AS chunk_id, text, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations ORDER BY conv_id, turn LIMIT 20")
def insertion_order_head(spark, d):
    rows = _talks(spark, d).dump().limit(20).select("chunk_id", "text", "ordinal")
    return rows.select("chunk_id", "text", F.row_number().over(W.orderBy("ordinal")).cast("bigint").alias("n"))


@query("SELECT label, vec_id, embedding AS vector FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1")
def cls_pool(spark, d):
    """The vectors of a label are the tokens of a text; their rank by id is the position."""
    rows = table(spark, d, "embeddings", "label", "vec_id", "embedding")
    tokens = rows.withColumn("position", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    return embedding.pool(tokens.withColumn("embedding", F.struct("vec_id", "embedding")), "label", "cls").select("label", "embedding.vec_id", F.col("embedding.embedding").alias("vector"))


@query("""SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM
    (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY ALL""")
def masked_mean_pool(spark, d):
    """Masked tokens don't count."""
    rows = table(spark, d, "embeddings", "label", "vec_id", "embedding").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    return embedding.pool(rows, "label", "mean", mask="mask").select("label", "dim", bits.rounded(F.col("x")).alias("mean"))


@query(f"SELECT vec_id, list_transform(code, lambda x: x - 128) AS code FROM (SELECT vec_id, {_pack_sql()} AS code FROM embeddings)")
def recentred_codes(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", bits.recentred(bits.code(F.col("embedding"))).alias("code"))


@query(f"SELECT vec_id, {_pack_sql(n=32)} AS code FROM embeddings")
def quantize_codes(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", bits.quantize(F.col("embedding"), 32).alias("code"))


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) * 100) AS INTEGER)) AS cut FROM embeddings")
def truncated_integers(spark, d):
    """Numbers from outside are cut toward zero; codes of them are searched as they are."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 100)
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.transform(scaled, lambda x: x.cast("int")).alias("cut"))


@query(f"WITH {CODES_SQL} SELECT 'v' || a.vec_id AS text, {XOR_SQL} AS score FROM c a, c b WHERE b.vec_id = 0 ORDER BY score, a.vec_id LIMIT 10")
def set_batch_search(spark, d):
    """Vectors loaded in bulk, found again by a code."""
    c, rows = _store(spark), table(spark, d, "embeddings", "vec_id", "embedding").orderBy("vec_id")
    c.set_batch(rows.select(F.concat(F.lit("v"), "vec_id").alias("text"), F.col("embedding").alias("vector")))
    q = rows.where("vec_id = 0").select(bits.code(F.col("embedding")).alias("c")).first()
    return c.search(q.c if q else [0] * WIDTH, 10).select("text", "score")


@query(f"WITH {CODES_SQL}, n AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN code ELSE code[1:4] END AS code FROM c) SELECT 'v' || a.vec_id AS text, {XOR_SQL} AS score FROM n a, c b WHERE b.vec_id = 0 AND len(a.code) = 8 ORDER BY score, a.vec_id LIMIT 10")
def width_filter(spark, d):
    """Codes of another width than the query's aren't compared."""
    c, rows = _store(spark), table(spark, d, "embeddings", "vec_id", "embedding").orderBy("vec_id").select("vec_id", bits.code(F.col("embedding")).alias("code"))
    c.set_batch(rows.select(F.concat(F.lit("v"), "vec_id").alias("text"), F.when(F.col("vec_id") % 2 == 0, F.col("code")).otherwise(F.slice("code", 1, 4)).alias("code")))
    q = rows.where("vec_id = 0").first()
    return c.search(q.code if q else [0] * WIDTH, 10).select("text", "score")


@query("SELECT conv_id AS item_id, text, role FROM conversations WHERE role = 'user'")
def collection_where(spark, d):
    """Chunks by metadata, through the store."""
    got = _talks(spark, d).items(where={"role": "user"})
    return got.select(F.col("item_id").cast("bigint").alias("item_id"), "text", F.regexp_replace("metadata.role", '"', "").alias("role"))


@query("SELECT string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE conv_id = 3 GROUP BY conv_id")
def get_one_id(spark, d):
    """An id alone is a list of one."""
    return _talks(spark, d).items("3").select("text")


@query("SELECT count(*) - count(*) AS chunks FROM conversations")
def clear_collection(spark, d):
    c = _talks(spark, d)
    c.clear()
    return spark.createDataFrame([(Collection(spark, c.catalog.root, c.name).count(),)], "chunks bigint")


@query("SELECT conv_id || '_' || turn AS chunk_id, conv_id AS item_id, turn AS chunk_idx, text, role FROM conversations")
def save_and_open(spark, d):
    """A collection that was added to in two steps, saved, and opened again."""
    c, rows = _store(spark), table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    data = rows.select(F.col("conv_id").alias("item_id"), "turn", "text", F.create_map(F.lit("role"), F.concat(F.lit('"'), "role", F.lit('"'))).alias("metadata"))
    for rest in (0, 1):
        c.add(data.where(F.col("item_id") % 2 == rest), order="turn")
        c.save()
    again = Collection(spark, c.catalog.root, c.name).dump()
    return again.select("chunk_id", F.col("item_id").cast("bigint").alias("item_id"), F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "text", F.regexp_replace("metadata.role", '"', "").alias("role"))


@query("""SELECT CAST(doc_id AS VARCHAR) || '_' || i AS chunk_id, substring(text, i * 2048 + 1, 2048) AS text FROM
    (SELECT doc_id, text, unnest(range((length(text) + 2047) // 2048)) AS i FROM documents)""")
def add_chunked(spark, d):
    c = _store(spark)
    c.add(table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("item_id"), "text"), need_chunks=True)
    return c.table.select("chunk_id", "text")


@query(rf"""WITH t AS (SELECT doc_id, text, {TOKENS_SQL} AS t FROM documents)
    SELECT CAST(doc_id AS VARCHAR) || '_' || i AS chunk_id, CASE WHEN len(t) <= 512 THEN text ELSE array_to_string(t[i * 512 + 1 : i * 512 + 512], '') END AS text
    FROM (SELECT doc_id, text, t, unnest(range(greatest(1, (len(t) + 511) // 512))) AS i FROM t)""")
def add_token_chunked(spark, d):
    c = _store(spark)
    c.add(table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("item_id"), "text"), need_chunks=True, fast=False)
    return c.table.select("chunk_id", "text")


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS INTEGER) AS chunk_idx, substring(text, i * 200 + 1, 200) AS text FROM
    (SELECT conv_id, turn, text, unnest(range((length(text) + 199) // 200)) AS i FROM conversations)""")
def chunk_lists(spark, d):
    """A list of texts is cut text by text, in order."""
    rows = table(spark, d, "conversations", "conv_id", "turn", "text")
    lists = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return text.explode_chunks(lists, text.list_chunks(F.col("texts"), lambda t: text.char_chunks(t, 200)), ["conv_id"])


@query(rf"SELECT item_id, array_to_string(list_transform({TOKENS_SQL}, lambda x, i: chr(27) || '[' || (41 + (i - 1) % 7) || 'm' || x), '') || chr(27) || '[0m' AS coloured FROM benchmark")
def coloured_tokens(spark, d):
    return table(spark, d, "benchmark", "item_id", "text").select("item_id", text.colour_tokens(text.tokens(F.col("text"))).alias("coloured"))


@query("SELECT range AS id, 512 AS tokens FROM range(50)")
def random_texts(spark, d):
    """Random texts of a wanted number of tokens."""
    return text.random_text(spark, 512, 50).select("id", text.token_count(F.col("text")).alias("tokens"))


@query("SELECT conv_id || '_' || turn AS chunk_id, text, role, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS ordinal FROM conversations")
def ctx_round_trip(spark, d):
    """A collection written as one CTX file and read back."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.ctx"
    rows = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    code = F.concat(embedding.HashEmbedder().code(F.col("text")), F.array_repeat(F.lit(0), 56))
    rows = rows.withColumn("code", code)  # before the rows are numbered in one task
    n = F.row_number().over(W.orderBy("conv_id", "turn")) - 1
    out = rows.select(n.cast("bigint").alias("ordinal"), F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text", F.create_map(F.lit("role"), F.concat(F.lit('"'), "role", F.lit('"'))).alias("metadata"), "code", F.lit(None).cast("array<float>").alias("embedding"))
    ctx.write_ctx(out, path)
    return ctx.read_ctx(spark, path).select("chunk_id", "text", F.regexp_replace("metadata.role", '"', "").alias("role"), "ordinal")


@query("SELECT 'hash' AS embedding_model, 64 AS embedding_size, 'float32' AS embedding_dtype, 100 AS context_length")
def ctx_header(spark, d):
    """The header that a writer's options make."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.ctx"
    ctx.write_ctx(spark.createDataFrame([], ctx.SCHEMA), path, context_length="100")
    head = ctx.read_header(path)
    return spark.createDataFrame([(head["embedding_model"], head["embedding_size"], head["embedding_dtype"], head["context_length"])], "embedding_model string, embedding_size int, embedding_dtype string, context_length int")


def _files(spark: SparkSession, d: str, kind: str) -> str:
    """The benchmark's texts as files of one kind in a folder of the shared one; the folder."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = table(spark, d, "benchmark", "item_id", "text").collect()  # a table of stated queries
    readers.write_files(folder, {f"{r.item_id}.{kind}": readers.as_docx(r.text) if kind == "docx" else r.text.encode() for r in rows})
    return folder


def _item_of_path() -> Column:
    return F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("bigint").alias("item_id")


@query(rf"""WITH t AS (SELECT item_id, text, {TOKENS_SQL} AS t FROM benchmark)
    SELECT item_id, CAST(i AS INTEGER) AS chunk_idx, CASE WHEN len(t) <= 64 THEN text ELSE array_to_string(t[i * 64 + 1 : i * 64 + 64], '') END AS text
    FROM (SELECT item_id, text, t, unnest(range(greatest(1, (len(t) + 63) // 64))) AS i FROM t)""")
def text_files(spark, d):
    """Text files, chosen by their extension, in chunks of tokens."""
    return readers.read_file(spark, f"{_files(spark, d, 'txt')}/*.txt", 64).select(_item_of_path(), "chunk_idx", "text")


@query("SELECT item_id, text FROM benchmark")
def docx_files(spark, d):
    return readers.read_docx(spark, f"{_files(spark, d, 'docx')}/*.docx").select(_item_of_path(), "text")


@query("SELECT item_id, CAST(i AS INTEGER) AS page, substring(text, i * 100 + 1, 100) AS text FROM (SELECT item_id, text, unnest(range((length(text) + 99) // 100)) AS i FROM benchmark)")
def page_files(spark, d):
    """A file's pages by an extractor, here one that cuts every 100 characters."""
    def pages(content: bytes) -> list[str]:
        t = content.decode()
        return [t[i : i + 100] for i in range(0, len(t), 100)]

    return readers.read_pdf_pages(spark, f"{_files(spark, d, 'pdf')}/*.pdf", pages).select(_item_of_path(), "page", "text")


@query(rf"""WITH p AS (SELECT page_id, {_html_sql()} AS text FROM pages), t AS (SELECT page_id, text, {TOKENS_SQL} AS t FROM p)
    SELECT page_id, CAST(i AS INTEGER) AS chunk_idx, CASE WHEN len(t) <= 64 THEN text ELSE array_to_string(t[i * 64 + 1 : i * 64 + 64], '') END AS text
    FROM (SELECT page_id, text, t, unnest(range(greatest(1, (len(t) + 63) // 64))) AS i FROM t)""")
def web_page_chunks(spark, d):
    return readers.page_chunks(table(spark, d, "pages", "page_id", "html"), "page_id", chunk_tokens=64)


@query(f"WITH {CODES_SQL} SELECT CAST(a.vec_id AS VARCHAR) AS key, round(1 - {MISMATCH_SQL} / 8.0::DOUBLE, 6) AS score FROM c a, c b WHERE b.vec_id = 1 AND a.vec_id NOT IN (1, 7) ORDER BY score DESC, a.vec_id LIMIT 10")
def code_index(spark, d):
    """An index of codes: a batch, one more, two removed, a search."""
    rows = table(spark, d, "embeddings", "vec_id", "embedding").orderBy("vec_id").select(F.col("vec_id").cast("string").alias("key"), bits.code(F.col("embedding")).alias("code"))
    index, one = CodeIndex(spark), rows.where("key = '1'").first()
    index.add_batch(rows)
    index.add("1", [0] * WIDTH)
    index.remove(["1", "7"])
    return index.search(one.code if one else [0] * WIDTH, 10).select("key", bits.rounded(F.col("score")).alias("score"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, octet_length(encode(props)) AS bytes FROM events")
def json_round_trip(spark, d):
    """Metadata parsed, written as JSON and parsed again."""
    again = _props(spark, d).select("event_id", F.from_json(F.to_json("metadata"), "map<string,string>").alias("m"))
    raw = table(spark, d, "events", "event_id", "props").select("event_id", F.octet_length("props").cast("bigint").alias("bytes"))
    return again.join(raw, "event_id").select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), "bytes")


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS chunks FROM (SELECT conv_id, text, unnest(range(2)) FROM conversations) GROUP BY conv_id")
def repeated_lists(spark, d):
    """A list repeated, extended and taken apart."""
    rows = table(spark, d, "conversations", "conv_id", "text").select("conv_id", F.explode(F.flatten(F.array_repeat(F.array("text"), 2))).alias("text"))
    return rows.groupBy("conv_id").agg(F.sum(F.length("text")).cast("bigint").alias("chars"), F.count("*").alias("chunks"))


@query("SELECT item_id, octet_length(encode(text)) AS bytes, length(text) AS chars FROM benchmark")
def text_bytes(spark, d):
    return table(spark, d, "benchmark", "item_id", "text").select("item_id", F.octet_length("text").cast("bigint").alias("bytes"), F.length("text").cast("bigint").alias("chars"))
