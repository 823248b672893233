"""A collection of chunks: insert, update, upsert, delete, look up, search; all state is Parquet parts and a DataFrame over them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import code as binarise
from ..functions.bits import code_bytes, packed, word_values
from ..functions.distance import packed_xor_sum
from ..functions.metadata import canonical, canonical_column, decode, encode, matches, merge
from ..functions.text import Tokenizer, char_chunks, token_chunks
from ..operators.embedding import Embedder, HashEmbedder
from ..operators.search import OVERSAMPLE, distance_to, filtered_top_k, late, many, union_top_k
from .storage import BITS, PART_COLUMNS, SCHEMA, Catalog, Part

Item = str | Mapping[str, Any]
META = T.MapType(T.StringType(), T.StringType())
ITEMS = T.StructType().add("item_id", "string").add("n", "long").add("text", "string").add("metadata", META).add("canon", META)


class Collection:
    """Every change is embedded and written once, as a part of its own rows. `add` is pending until `save`; update, delete, set and set_batch save."""

    def __init__(self, spark: SparkSession, root: str, name: str | None = None, embedder: Embedder | None = None, tokenizer: Tokenizer | None = None):
        self.spark, self.catalog = spark, Catalog(spark, root)
        self.name = name or time.strftime("bitloom_%Y%m%d_%H%M%S")
        self.embedder, self.tokenizer = embedder or HashEmbedder(), tokenizer
        self._version, self._generation, self._parts = self.catalog.manifest(self.name)
        self._saved = len(self._parts)
        self._refresh()

    def __repr__(self) -> str:
        return f"Collection(name={self.name!r}, count={self.count()}, dimensions={self.embedder.dimensions})"

    # -- writing

    def _refresh(self) -> None:
        self.table: DataFrame = self.catalog.table(self.name, self._parts) if self._parts else self.spark.createDataFrame([], SCHEMA)

    def _stage(self, rows: DataFrame, fresh: bool) -> Part:
        part = self.catalog.stage(self.name, rows, max((p["end"] for p in self._parts), default=0), fresh)
        if part["rows"]:
            self._parts = [*self._parts, part]
            self._refresh()
        return part

    def _insert(self, rows: DataFrame, fresh: bool) -> DataFrame:
        """Stage rows (chunk_id, item_id, chunk_idx, text, metadata, canon, code); an existing chunk_id is replaced and keeps its ordinal. Returns the rows as written."""
        rows = rows.withColumn("words", packed(F.col("code"), self._words()))
        rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.monotonically_increasing_id())
        if fresh or not self._parts:
            rows = rows.withColumn("place", F.lit(None).cast("bigint"))
        else:
            rows = rows.join(self.table.select("chunk_id", F.col("ordinal").alias("place")), "chunk_id", "left")
        part = self._stage(rows.withColumn("deleted", F.lit(False)), fresh or not self._parts)
        return self.catalog.part(self.name, part)

    def _words(self) -> int:
        return -(-self.embedder.dimensions // 64)

    def add(self, data: Item | Sequence[Item] | DataFrame, metadata: Mapping[str, Any] | None = None, item_id: str | None = None, need_chunks: bool = False, fast: bool = True, order: str | Sequence[str] | None = None) -> list[tuple[str, int]] | DataFrame:
        """Insert texts, dicts (text, metadata, id) or a DataFrame (text[, item_id, metadata]), whose rows are inserted in the order of column (or columns) `order` or as they come. One id a call unless an item brings its own.

        Returns (item_id, chunks) of every item inserted: a list, or for a DataFrame a DataFrame. Metadata of a DataFrame is JSON by key, numbers in lists and objects written as Python writes them.
        """
        whole, fresh = item_id or str(uuid.uuid4()), item_id is None
        if isinstance(data, DataFrame):
            own = "item_id" in data.columns
            fresh = fresh and not own
            meta = F.col("metadata") if "metadata" in data.columns else F.create_map().cast(META)
            by = [order] if isinstance(order, str) else list(order or [])
            data = data.orderBy(*by) if by else data  # how files are cut into partitions then decides nothing
            rows = data.select((F.col("item_id").cast("string") if own else F.lit(whole)).alias("item_id"), (F.struct(*by) if by else F.monotonically_increasing_id()).alias("n"), F.col("text").cast("string").alias("text"), meta.alias("metadata"))
            rows = rows.withColumn("canon", F.transform_values("metadata", lambda _, v: canonical_column(v)))
        else:
            items = [data] if isinstance(data, (str, Mapping)) else list(data)
            made = []
            for n, x in enumerate(items):
                x = {"text": x} if isinstance(x, str) else x
                fresh = fresh and not x.get("id")
                made.append((str(x.get("id") or whole) if item_id is None else whole, n, x.get("text", ""), encode(x.get("metadata")), encode(x.get("metadata"), canonical)))
            rows = self.spark.createDataFrame(made, ITEMS)
        if metadata:
            rows = rows.withColumn("metadata", merge(F.col("metadata"), _map(encode(metadata)))).withColumn("canon", merge(F.col("canon"), _map(encode(metadata, canonical))))
        pieces = F.array("text") if not need_chunks else char_chunks(F.col("text")) if fast else self.tokenizer.chunks(F.col("text")) if self.tokenizer else token_chunks(F.col("text"))
        # seq before anything moves: rows stay in the order in which they came
        each = rows.select("item_id", "n", "metadata", "canon", F.posexplode(pieces).alias("k", "text")).withColumn("seq", F.monotonically_increasing_id())
        if isinstance(data, DataFrame) and "item_id" not in data.columns:
            each = each.withColumn("chunk_idx", self._number(each))
        else:
            each = each.withColumn("chunk_idx", F.row_number().over(W.partitionBy("item_id").orderBy("n", "k", "seq")) - 1)
        each = each.select(F.concat_ws("_", "item_id", F.col("chunk_idx").cast("string")).alias("chunk_id"), "item_id", "chunk_idx", "text", "metadata", "canon", self.embedder.code(F.col("text")).alias("code"), "seq")
        written = self._insert(each, fresh).groupBy("item_id").agg(F.count("*").alias("chunks"), F.min("ordinal").alias("o"))
        if isinstance(data, DataFrame):
            return written.select("item_id", "chunks")
        return [(r.item_id, r.chunks) for r in written.orderBy("o").collect()]  # as many as the caller's own items at most

    def _number(self, each: DataFrame) -> Column:
        """Dense numbers of rows (seq), without gathering them: a partition's rows after those of the partitions before."""
        counts = sorted(tuple(r) for r in each.groupBy(F.shiftright("seq", BITS).alias("p")).count().collect())  # a number a partition
        before, starts = 0, []
        for p, n in counts:
            starts += [F.lit(p), F.lit(before)]
            before += n
        at = F.col("seq").bitwiseAND((1 << BITS) - 1)
        return (F.try_element_at(F.create_map(*starts), F.shiftright("seq", BITS)) + at).cast("int") if starts else F.lit(0)

    def set_batch(self, texts: Sequence[str] | DataFrame, codes: Sequence[Sequence[int]] | None = None, metadatas: Sequence[Mapping[str, Any]] | None = None) -> list[str] | DataFrame:
        """Rows with codes of their own and a new id each; saves. Three lists, or a DataFrame (text, code or vector[, metadata]), for which a DataFrame of the ids comes back.

        Codes are bytes, or numbers from -128 to 127, which are bytes less 128; other numbers are cut to integers and searched without packing. Vectors (column `vector`) are binarised.
        """
        if isinstance(texts, DataFrame):
            own = F.col("code") if "code" in texts.columns else binarise(F.col("vector"))
            meta = F.col("metadata") if "metadata" in texts.columns else F.create_map().cast(META)
            rows = texts.select(F.uuid().alias("item_id"), "text", meta.alias("metadata"), code_bytes(own).alias("code"))
            rows = rows.withColumn("canon", F.transform_values("metadata", lambda _, v: canonical_column(v)))
        else:
            codes = codes or []
            if len(texts) != len(codes) or (metadatas is not None and len(metadatas) != len(texts)):
                raise ValueError("texts, codes and metadatas differ in length")
            ids = [str(uuid.uuid4()) for _ in texts]
            made = [(i, t, [float(x) for x in c], encode(m), encode(m, canonical)) for i, t, c, m in zip(ids, texts, codes, metadatas or [{}] * len(ids))]
            rows = self.spark.createDataFrame(made, T.StructType().add("item_id", "string").add("text", "string").add("code", T.ArrayType(T.DoubleType())).add("metadata", META).add("canon", META)).withColumn("code", code_bytes(F.col("code")))
        rows = rows.select(F.concat("item_id", F.lit("_0")).alias("chunk_id"), "item_id", F.lit(0).alias("chunk_idx"), "text", "metadata", "canon", "code")
        written = self._insert(rows, True)
        self.save()
        return written.select("item_id", "ordinal") if isinstance(texts, DataFrame) else ids

    def _is(self, ids: str | Sequence[str], prefix: bool = False) -> Column:
        ids = [ids] if isinstance(ids, str) else list(ids)
        if prefix:
            out = F.lit(False)
            for i in ids:
                out = out | F.col("chunk_id").startswith(f"{i}_")
            return out
        return F.col("item_id").isin(*ids) if ids else F.lit(False)

    def _change(self, rows: DataFrame, deleted: bool = False) -> int:
        """Stage changed rows of the table under their ordinals; how many there are."""
        part = rows.withColumn("place", F.col("ordinal")).withColumn("seq", F.monotonically_increasing_id()).withColumn("deleted", F.lit(deleted))
        n = self._stage(part.select(*PART_COLUMNS), False)["rows"]
        if n:
            self.save()
        return n

    def update(self, item_id: str, text: str | None = None, metadata: Mapping[str, Any] | None = None, code: Sequence[int] | None = None, reembed: bool = True, prefix: bool = False) -> bool:
        """Set text, merge metadata, replace the code on every chunk of an item; saves. False if there is none."""
        out = self.table.where(self._is(item_id, prefix))
        if metadata:
            out = out.withColumn("metadata", merge(F.col("metadata"), _map(encode(metadata)))).withColumn("canon", merge(F.col("canon"), _map(encode(metadata, canonical))))
        fresh = None
        if text is not None:
            out = out.withColumn("text", F.lit(text))
            fresh = self.embedder.code(F.lit(text)) if reembed else None
        if code is not None:
            fresh = code_bytes(F.array(*[F.lit(float(x)) for x in code]))
        if fresh is not None:
            out = out.withColumn("code", fresh).withColumn("words", packed(F.col("code"), self._words()))
        return self._change(out) > 0

    def delete(self, ids: str | Sequence[str], prefix: bool = False) -> int:
        """Remove items; returns the chunks removed; saves if any."""
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.table.schema if f.name not in ("chunk_id", "item_id", "chunk_idx", "ordinal")]
        return self._change(self.table.where(self._is(ids, prefix)).select("chunk_id", "item_id", "chunk_idx", "ordinal", *nothing), True)

    def set(self, item_id: str, text: str | None = None, metadata: Mapping[str, Any] | None = None, code: Sequence[int] | None = None) -> None:
        """Update an item, or add it."""
        if not self.update(item_id, text, metadata, code):
            self.add({"text": text or "", "metadata": metadata or {}}, item_id=item_id)
            if code is not None:
                self.update(item_id, code=code)
            self.save()

    def clear(self) -> None:
        self.catalog.delete(self.name)
        self._version, self._generation, self._parts, self._saved = 0, 0, [], 0
        self._refresh()

    def save(self) -> None:
        """Publish what was added since the last save: a manifest, and no row is written again."""
        if self._parts[self._saved :] or not self._version:
            self._version, self._generation, self._parts = self.catalog.commit(self.name, self._version, self._generation, self._parts)
            self._saved = len(self._parts)
            self._refresh()

    # -- reading

    def count(self) -> int:
        return self.table.count()

    def info(self) -> DataFrame:
        return self.table.agg(F.count("*").alias("count"), F.countDistinct("item_id").alias("items")).select(F.lit(self.name).alias("collection"), "count", "items", F.lit(type(self.embedder).__name__).alias("model"))

    def dump(self) -> DataFrame:
        return self.table.orderBy("ordinal")

    def chunks(self, ids: str | Sequence[str], prefix: bool = False) -> DataFrame:
        """The chunks of items, in order."""
        return self.table.where(self._is(ids, prefix)).orderBy("ordinal")

    def items(self, ids: str | Sequence[str] | None = None, where: Mapping[str, Any] | None = None, prefix: bool = False) -> DataFrame:
        """With ids: one row an id, in their order, texts joined by a space and metadata merged (the last chunk wins); without: one row a chunk."""
        if ids is None:
            return self.table.where(matches(F.col("canon"), where)).orderBy("ordinal").select("item_id", "text", "metadata")
        ids = [ids] if isinstance(ids, str) else list(ids)
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "pos int, wanted string")
        on = F.col("chunk_id").startswith(F.concat("wanted", F.lit("_"))) if prefix else F.col("item_id") == F.col("wanted")
        rows = self.table.join(F.broadcast(wanted), on)
        return regroup(rows, ["pos", "wanted"]).withColumnRenamed("wanted", "item_id").where(matches(F.col("canon"), where)).orderBy("pos").select("item_id", "text", "metadata")

    def get(self, ids: str | Sequence[str] | None = None, where: Mapping[str, Any] | None = None) -> list[tuple[str, str, dict]]:
        return [(r.item_id, r.text, decode(r.metadata)) for r in self.items(ids, where).collect()]

    def codes_of(self, texts: Sequence[str]) -> list[list[int]]:
        """Codes of query texts, made in one job."""
        rows = self.spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", self.embedder.code(F.col("text")).alias("c"))
        return [r.c for r in sorted(rows.collect())]

    def _narrow(self, width: int, metadata: Mapping[str, Any] | None) -> DataFrame:
        """What a scan for codes of `width` bytes reads."""
        words = [F.get("words", F.lit(j)).alias(f"_w{j}") for j in range(-(-width // 8))]
        return self.table.where(F.size("code") == width).select("chunk_id", "ordinal", "code", *words, *(["canon"] if metadata else []))

    def search(self, query: str | Sequence[float], top_k: int = 5, metadata: Mapping[str, Any] | None = None, multiplier: int = OVERSAMPLE, mode: str = "post", metric: str = "xor_sum") -> DataFrame:
        """(chunk_id, score, text, metadata) of the nearest chunks to a text or a code; the scan reads packed codes, and metadata where filtered; texts are fetched for the hits."""
        q = self.codes_of([query])[0] if isinstance(query, str) else list(query)
        narrow = self._narrow(len(q), metadata)
        plain = all(p["packed"] for p in self._parts) and len(q) <= 8 * self._words() and all(isinstance(x, int) and 0 <= x <= 255 for x in q)
        words = [F.col(f"_w{j}") for j in range(-(-len(q) // 8))] if plain else None
        hits = filtered_top_k(narrow, distance_to(q, metric, words=words), top_k, metadata, multiplier, mode, metadata="canon")
        return late(hits.select("chunk_id", "score", F.col("ordinal").alias("o")), self.table.select("chunk_id", "text", "metadata"), "chunk_id").orderBy("score", "o").select("chunk_id", "score", "text", "metadata")

    def search_many(self, texts: Sequence[str], top_k: int = 5, metadata: Mapping[str, Any] | None = None, multiplier: int = OVERSAMPLE, mode: str = "post") -> DataFrame:
        """The union of the texts' results, cut to top_k: one scan for all of them."""
        codes = self.codes_of(texts)
        narrow = self._narrow(len(codes[0]), metadata)
        queries = self.spark.createDataFrame([(i, *word_values(c)) for i, c in enumerate(codes)], "qid int, " + ", ".join(f"_q{j} bigint" for j in range(-(-len(codes[0]) // 8))))
        wanted = matches(F.col("canon"), metadata)
        k = range(-(-len(codes[0]) // 8))
        found = many(narrow.where(wanted) if metadata and mode == "pre" else narrow, queries, packed_xor_sum([F.col(f"_w{j}") for j in k], [F.col(f"_q{j}") for j in k]), top_k * multiplier if metadata and mode == "post" else top_k)
        if metadata and mode == "post":
            found = found.where(wanted).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("score", "ordinal"))).where(F.col("rank") <= top_k)
        hits = union_top_k(found, top_k).select("chunk_id", "score", "qid", "rank")
        return late(hits, self.table.select("chunk_id", "text", "metadata"), "chunk_id").orderBy("score", "qid", "rank").select("chunk_id", "score", "text", "metadata")

    def retrieve(self, text: str | Sequence[str] | None = None, top_k: int = 5, metadata: Mapping[str, Any] | None = None, return_scores: bool = False, top_k_multiplier: int = OVERSAMPLE, **options: Any) -> list[tuple] | None:
        """Nearest chunks as tuples. Several texts: the union of their results, cut to top_k. None for no text; ValueError if nothing can be compared."""
        if not text:
            return None
        width = self.embedder.dimensions // 8
        if not self.table.where(F.size("code") == width).limit(1).count():
            raise ValueError(f"no code of {width} bytes in the collection")
        one = text if isinstance(text, str) else text[0] if len(text) == 1 else None
        found = self.search(one, top_k, metadata, top_k_multiplier, **options) if one is not None else self.search_many(text, top_k, metadata, top_k_multiplier, **options)
        return [(r.chunk_id, r.text, decode(r.metadata), r.score) if return_scores else (r.chunk_id, r.text, decode(r.metadata)) for r in found.collect()]


def _map(stored: Mapping[str, str | None]) -> Column:
    pairs = [F.lit(x).cast("string") for kv in stored.items() for x in kv]
    return F.create_map(*pairs) if pairs else F.create_map().cast(META)


def regroup(rows: DataFrame, keys: list[str], order: str = "ordinal", text: str = "text") -> DataFrame:
    """Texts of each key in order, joined by a space; their metadata (and its canonical form) merged, the last chunk wins."""
    maps = [c for c in ("metadata", "canon") if c in rows.columns]
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), *[F.map_entries(c).alias(c) for c in maps])))
    out = rows.groupBy(*keys).agg(parts.alias("p"))
    joined = F.array_join(F.transform("p", lambda x: F.coalesce(x["t"], F.lit(""))), " ").alias("text")
    none = F.array().cast("array<struct<key:string,value:string>>")
    merged = lambda c: F.aggregate("p", F.create_map().cast(META), lambda a, x: merge(a, F.map_from_entries(F.coalesce(x[c], none)))).alias(c)
    return out.select(*keys, joined, *[merged(c) for c in maps])
