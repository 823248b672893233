"""Document readers: text, CSV, DOCX, PDF (by a pluggable extractor), web pages. Each gives a DataFrame (path, text)."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_text, token_chunks

Extractor = Callable[[bytes], Iterable[str]]  # a file's bytes to its pages


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _extracted(spark: SparkSession, path: str, extract: Extractor, join: str | None) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pages = list(extract(content))
                pages = [join.join(pages)] if join is not None else pages
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pages), pa.string()), pa.array(range(len(pages)), pa.int32()), pa.array(pages, pa.string())], names=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, page int, text string")


def docx_text(content: bytes) -> list[str]:
    """Paragraphs of a DOCX file, by the standard library."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    lines = []
    for p in root.iter(f"{ns}p"):
        lines.append("".join({f"{ns}t": n.text or "", f"{ns}tab": "\t", f"{ns}br": "\n"}.get(n.tag, "") for n in p.iter()))
    return ["\n\n".join(lines)]


def as_docx(text: str) -> bytes:
    """A DOCX file of one paragraph."""
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def write_files(folder: str, files: dict[str, bytes]) -> None:
    """Uploads: the driver's files into a folder of any file system. A name may not lead out of it."""
    from .ctx import file_system

    on, path = file_system(folder)
    on.create_dir(path, recursive=True)
    for name, body in files.items():
        if os.path.basename(name) != name or name in ("", ".", ".."):
            raise ValueError(f"bad file name {name!r}")
        with on.open_output_stream(f"{path}/{name}") as f:
            f.write(body)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return _extracted(spark, path, docx_text, "").drop("page")


def pdf_pages(content: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF needs an extractor: pass extract=, a function of a file's bytes to its pages' texts") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def read_pdf(spark: SparkSession, path: str, extract: Extractor = pdf_pages) -> DataFrame:
    """One row a file, its pages' texts joined by nothing."""
    return _extracted(spark, path, extract, "").drop("page")


def read_pdf_pages(spark: SparkSession, path: str, extract: Extractor = pdf_pages) -> DataFrame:
    """One row a page. An OCR engine is another extractor."""
    return _extracted(spark, path, extract, None)


def rows_as_strings(df: DataFrame) -> DataFrame:
    """Every row as an array of strings; null is 'nan', booleans are True and False."""
    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.initcap(c) if kind == "boolean" else c, F.lit("nan"))

    return df.select(F.array(*[cell(n, k) for n, k in df.dtypes]).alias("row"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return rows_as_strings(spark.read.csv(path, header=True, inferSchema=True))


def pages_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """A table of fetched pages with the text of each."""
    return pages.withColumn("text", html_text(F.col(html)))


def page_chunks(pages: DataFrame, key: str, html: str = "html", chunk_tokens: int = 512) -> DataFrame:
    """(key, chunk_idx, text): the texts of fetched pages in windows of tokens."""
    return pages_text(pages, html).select(key, F.posexplode(token_chunks(F.col("text"), chunk_tokens)).alias("chunk_idx", "text"))


def read_webpage(spark: SparkSession, url: str, fetch: Callable[[str], str] | None = None, chunk_tokens: int = 512) -> DataFrame:
    """(path, chunk_idx, text) of one page, fetched by the driver. Only http and https; give `fetch` to control access."""
    if not re.match(r"https?://", url):
        raise ValueError(f"not a web address: {url}")
    if fetch is None:
        from urllib.request import urlopen

        fetch = lambda u: urlopen(u, timeout=30).read().decode("utf-8", "replace")  # noqa: E731, S310
    return page_chunks(spark.createDataFrame([(url, fetch(url))], "path string, html string"), "path", chunk_tokens=chunk_tokens)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".txt": read_text, ".pdf": read_pdf, ".docx": read_docx, ".csv": read_csv}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob on any Hadoop file system has a file."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(own)
    return found is not None and len(found) > 0


def read_file(spark: SparkSession, path: str, chunk_tokens: int = 512) -> DataFrame:
    """Dispatch on the extension. Texts come as chunks (path, chunk_idx, text), CSV as rows of strings."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    kind = os.path.splitext(path)[1].lower()
    if kind not in READERS:
        raise ValueError(f"unsupported file type: {kind}")
    df = READERS[kind](spark, path)
    return df if kind == ".csv" else df.select("path", F.posexplode(token_chunks(F.col("text"), chunk_tokens)).alias("chunk_idx", "text"))
