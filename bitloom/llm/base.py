"""What the operators share: table reading, scratch tables, sampling and small helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One input table; only `cols` when given, so that the scan is pruned."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def settle(df: DataFrame, free: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage, survives lost executors, computes once. free: the write's shuffle files, which nothing reads again, go at once."""
    path, conf = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(FREE)
    try:
        conf.set(FREE, str(free or before == "true").lower())
        df.write.parquet(path)
    finally:
        conf.set(FREE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


#: What operators keep in a Python worker from task to task, by operator.
KEPT: dict[str, dict] = {}


def trim() -> None:
    """Give memory that was freed back to the system: NumPy's and Arrow's allocators keep it otherwise, and Spark keeps its workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def leave(own: str = "") -> None:
    """Let go what other operators than `own` keep in this worker."""
    others = [kept for name, kept in KEPT.items() if name != own and kept]
    for kept in others:
        kept.clear()
    if others:
        trim()


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str = "") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, in a worker that holds no other operator's memory before and none of its own afterwards (but what it keeps as `own`)."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave(own)
        yield from run(batches)
        trim()

    return task


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, tuple[str, ...], list[Column]]:
    """`docs` with columns of these names renamed, so that an operator may add its own; its columns now; and how to select them as they were."""
    other = {n: f"_own_{n}" for n in names if n in docs.columns}
    return docs.withColumnsRenamed(other), tuple(other.get(c, c) for c in docs.columns), [F.col(other.get(c, c)).alias(c) for c in docs.columns]


def id_crc(col: str, mod: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "utf-8")) % mod


def bounded_ids(rows: DataFrame, bound: int, strata: str, seed: int) -> DataFrame:
    """Ids (column doc_id) of at most `bound` rows per value of `strata`, picked by a hash of the id.

    The rank is a window whose group limit runs before the shuffle, so no stratum, however hot, is gathered whole.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(strata).orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id"))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= bound).drop("_r")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The whole texts of a batch; null reads as empty."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut again so that a slice holds about `limit` bytes of `column`, or one longer row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
