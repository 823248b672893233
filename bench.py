"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from bitloom.plans.collection import Collection
from bitloom.queries import QUERIES

HEADLINE = ["topk_xor_sum", "topk_hamming_bits", "topk_cosine", "retrieve_post_filter", "retrieve_pre_filter", "retrieve_multi_query", "retrieve_per_query", "chunk_chars", "chunk_words", "hash_embed", "retrieve_text", "html_to_text", "item_regroup", "where_metadata", "delete_ids", "upsert_items"]


def stored(spark: SparkSession, data: str, took: dict[str, float]) -> None:
    """Ingest of all documents, and searches of the stored codes, timed apart."""
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("cast(doc_id as string) AS item_id", "text")
    store = Collection(spark, f"{spark.conf.get('spark.checkpoint.dir')}/bench", "documents")
    began = time.time()
    store.add(docs, need_chunks=True)
    store.save()
    took["ingest_documents"] = round(time.time() - began, 3)
    for name, query in (("retrieve_stored", "first words"), ("retrieve_stored_again", "other words"), ("retrieve_stored_several", ["some words", "more words", "further words"])):
        began = time.time()
        store.retrieve(query, top_k=5)
        took[name] = round(time.time() - began, 3)


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: QUERIES[n] for n in HEADLINE}
    try:
        from bitloom.llm.registry import QUERIES as more

        queries |= more
    except ModuleNotFoundError:
        pass
    took = {}
    QUERIES["token_count"](spark, data).collect()
    stored(spark, data, took)
    for name, run in queries.items():
        began = time.time()
        run(spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": data.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
