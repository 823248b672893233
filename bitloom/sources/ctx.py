"""The CTX container: magic, version, and sections of header, embeddings, contexts and metadata, little endian.

A file is one collection and is read or written by one task; collections that outgrow a file live in Parquet snapshots.
"""

from __future__ import annotations

import codecs
import json
import os
import struct
import tempfile
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage

MAGIC, VERSION, WIDTH = b"CTXF", 1, 64
HEADER, EMBEDDINGS, CONTEXTS, METADATA = range(4)
BLOCK = 1 << 20  # bytes read at once
SCHEMA = "ordinal bigint, chunk_id string, text string, metadata map<string,string>, code array<int>, embedding array<float>"


def section(kind: int, size: int) -> bytes:
    """The head of a section."""
    if size >= 1 << 32:
        raise ValueError(f"a section of {size} bytes; the container's sections have 4 GiB at most")
    return struct.pack("<II", kind, size)


def pack_vector(key: str, v: list[float]) -> bytes:
    if len(v) < WIDTH:
        raise ValueError(f"{key}: {len(v)} numbers; the container holds {WIDTH}")
    return struct.pack(f"<{WIDTH}f", *v[:WIDTH])


def pack_text(t: str) -> bytes:
    body = t.encode()
    return struct.pack("<I", len(body)) + body


def dump_ctx(header: dict, rows: list[tuple[str, str, dict, list[float]]]) -> bytes:
    """rows: (chunk_id, text, metadata, 64 numbers)."""
    def whole(kind: int, body: bytes) -> bytes:
        return section(kind, len(body)) + body

    vectors = [pack_vector(key, v) for key, _, _, v in rows]
    out = MAGIC + struct.pack("<I", VERSION) + whole(HEADER, json.dumps(header).encode())
    if vectors:
        out += whole(EMBEDDINGS, b"".join(vectors))
    out += whole(CONTEXTS, b"".join(pack_text(t) for _, t, _, _ in rows))
    return out + whole(METADATA, json.dumps({k: m for k, _, m, _ in rows}).encode())


class Spool:
    """Pieces of bytes on the worker's disk, read back as they came or by their places."""

    def __init__(self):
        self.file, self.ends = tempfile.TemporaryFile(), array("q", [0])

    def __enter__(self) -> Spool:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    @property
    def size(self) -> int:
        return self.ends[-1]

    def add(self, piece: bytes) -> None:
        self.file.write(piece)
        self.ends.append(self.ends[-1] + len(piece))

    def pieces(self, order: list[int] | None, between: bytes = b"") -> Iterator[bytes]:
        self.file.seek(0)
        for n, i in enumerate(range(len(self.ends) - 1) if order is None else order):
            if order is not None:
                self.file.seek(self.ends[i])
            yield (between if n else b"") + self.file.read(self.ends[i + 1] - self.ends[i])


def parse_ctx(data: bytes) -> tuple[dict, list[tuple[float, ...]], list[str], dict[str, dict]]:
    """Header, vectors, texts that decode, metadata by key; sections may come in any order."""
    if data[:4] != MAGIC:
        raise ValueError("not a CTX file")
    if len(data) < 8 or struct.unpack_from("<I", data, 4)[0] != VERSION:
        raise ValueError("unsupported CTX version")
    header, vectors, texts, metadata, at = {}, [], [], {}, 8
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        if kind == HEADER:
            header = json.loads(body)
        elif kind == EMBEDDINGS:
            vectors = list(struct.iter_unpack(f"<{WIDTH}f", body[: len(body) // (4 * WIDTH) * 4 * WIDTH]))
        elif kind == CONTEXTS:
            p = 0
            while p + 4 <= len(body):
                n = struct.unpack_from("<I", body, p)[0]
                try:
                    texts.append(body[p + 4 : p + 4 + n].decode())
                except UnicodeDecodeError:
                    pass
                p += 4 + n
        elif kind == METADATA:
            metadata = json.loads(body)
        else:
            raise ValueError(f"unknown CTX section {kind}")
    return header, vectors, texts, metadata


def to_code(v: tuple[float, ...]) -> list[int] | None:
    """Unsigned bytes of stored numbers, if all are shifted bytes."""
    if all(float(x).is_integer() and -256 <= x <= -1 for x in v):
        return [(int(x) + 128) % 256 for x in v]
    return None


def from_code(code: list[int]) -> list[float]:
    """Stored numbers of a code."""
    return [float(b - 128 if b < 128 else b - 384) for b in code]


def sections(f: Any, size: int) -> dict[int, list[tuple[int, int]]]:
    """Places and lengths of each kind of section of an open file. Of several the last counts; texts go on from one to the next."""
    f.seek(0)
    head = f.read(8)
    if head[:4] != MAGIC:
        raise ValueError("not a CTX file")
    if len(head) < 8 or struct.unpack_from("<I", head, 4)[0] != VERSION:
        raise ValueError("unsupported CTX version")
    found, at = {}, 8
    while at + 8 <= size:
        f.seek(at)
        kind, length = struct.unpack("<II", f.read(8))
        if kind not in (HEADER, EMBEDDINGS, CONTEXTS, METADATA):
            raise ValueError(f"unknown CTX section {kind}")
        found.setdefault(kind, []).append((at + 8, min(length, size - at - 8)))
        at += 8 + length
    return found


class Window:
    """A section of an open file, read forward in blocks."""

    def __init__(self, f: Any, place: tuple[int, int]):
        self.f, (self.at, length) = f, place
        self.end, self.held, self.p = self.at + length, b"", 0

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        if len(self.held) - self.p < n:
            self.f.seek(self.at)
            more = self.f.read(min(max(n, BLOCK), self.end - self.at))
            self.at += len(more)
            self.held, self.p = self.held[self.p :] + more, 0
        out = self.held[self.p : self.p + n]
        self.p += len(out)
        return out


def stored_vectors(w: Window) -> Iterator[tuple[float, ...]]:
    while len(v := w.take(4 * WIDTH)) == 4 * WIDTH:
        yield struct.unpack(f"<{WIDTH}f", v)


def stored_texts(w: Window) -> Iterator[str]:
    """The texts that decode."""
    while len(n := w.take(4)) == 4:
        try:
            yield w.take(struct.unpack("<I", n)[0]).decode()
        except UnicodeDecodeError:
            pass


def stored_members(w: Window) -> Iterator[tuple[str, Any]]:
    """Keys and values of the JSON object in a section, one at a time; a repeated key comes again."""
    decode, read, text, p = json.JSONDecoder().raw_decode, codecs.getincrementaldecoder("utf-8")(), "", 0

    def more() -> bool:
        nonlocal text, p
        got = w.take(max(BLOCK, len(text) - p))  # twice as much each time, so a long value isn't begun again and again
        text, p = text[p:] + read.decode(got, not got), 0
        return bool(got)

    def sign() -> str:
        nonlocal p
        while True:
            while p < len(text) and text[p] in " \t\r\n":
                p += 1
            if p < len(text):
                p += 1
                return text[p - 1]
            if not more():
                return ""

    def value() -> Any:
        nonlocal p
        while True:
            try:
                start = p + len(text[p : p + 64]) - len(text[p : p + 64].lstrip(" \t\r\n"))
                out, end = decode(text, start)
                if end < len(text):  # else a number could go on
                    p = end
                    return out
            except json.JSONDecodeError:
                pass
            if not more():
                raise ValueError("CTX metadata is no JSON object")

    first = sign()
    if not first:
        return
    after = first
    while after in ("{", ","):
        if after == "{":
            after = sign()
            if after == "}":
                return
            p -= 1
        key = value()
        if sign() != ":":
            break
        yield key, value()
        after = sign()
    if after != "}":
        raise ValueError("CTX metadata is no JSON object")


def rows_of(f: Any, size: int) -> Iterator[tuple]:
    """Keys paired with the first vectors and texts, in the order of the metadata; a block of each is held. A repeated key has its first place and its last value."""
    places = sections(f, size)
    window = lambda kind: Window(f, places.get(kind, [(0, 0)])[-1])
    marks = np.sort(np.fromiter((hash(k) for k, _ in stored_members(window(METADATA))), "int64"))
    doubtful = set(marks[1:][marks[1:] == marks[:-1]].tolist())
    last = {k: own for k, own in stored_members(window(METADATA)) if hash(k) in doubtful} if doubtful else {}
    vectors, texts, given, i = stored_vectors(window(EMBEDDINGS)), (t for p in places.get(CONTEXTS, []) for t in stored_texts(Window(f, p))), set(), 0
    for key, own in stored_members(window(METADATA)):
        if key in last:
            if key in given:
                continue
            given.add(key)
            own = last[key]
        v = next(vectors, None)
        code = to_code(v) if v else None
        meta = {str(k): None if x is None else json.dumps(x, sort_keys=True) for k, x in (own or {}).items()}
        yield i, key, next(texts, ""), meta, code, list(v) if v and code is None else None
        i += 1


class CtxSource(DataSource):
    """spark.read.format("ctx").load(path) and df.coalesce(1).write.format("ctx").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "ctx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CtxReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CtxWriter(self.options)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, on any machine, and the path on it."""
    if "://" not in path:
        path = os.path.abspath(path.removeprefix("file:"))
    return fs.FileSystem.from_uri(path)


class CtxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def read(self, partition) -> Iterator[tuple]:
        on, path = file_system(self.path)
        with on.open_input_file(path) as f:
            yield from rows_of(f, f.size())


@dataclass
class Written(WriterCommitMessage):
    part: str | None


class CtxWriter(DataSourceWriter):
    """A task writes a part beside the file; the commit moves it into place, an abort removes it."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.header = {"embedding_model": options.get("embedding_model", "hash"), "embedding_size": int(options.get("embedding_size", WIDTH)), "embedding_dtype": options.get("embedding_dtype", "float32"), "context_length": int(options.get("context_length", 512))}

    def write(self, iterator) -> WriterCommitMessage:
        on, path = file_system(self.path)
        part = f"{path}.part-{uuid.uuid4().hex}"
        with Spool() as vectors, Spool() as texts, Spool() as metadata:
            ordinals = array("q")
            for r in iterator:
                own = {k: None if v is None else json.loads(v) for k, v in (r["metadata"] or {}).items()}
                ordinals.append(r["ordinal"])
                vectors.add(pack_vector(r["chunk_id"], from_code(r["code"]) if r["code"] is not None else list(r["embedding"] or [])))
                texts.add(pack_text(r["text"] or ""))
                metadata.add(f"{json.dumps(r['chunk_id'])}: {json.dumps(own)}".encode())
            # rows come in order from write_ctx; any others are put in order by their places
            sorted_ = all(a <= b for a, b in zip(ordinals, islice(ordinals, 1, None)))
            order = None if sorted_ else sorted(range(len(ordinals)), key=ordinals.__getitem__)
            with on.open_output_stream(part) as f:
                head = json.dumps(self.header).encode()
                f.write(MAGIC + struct.pack("<I", VERSION) + section(HEADER, len(head)) + head)
                for kind, spool in ((EMBEDDINGS, vectors), (CONTEXTS, texts)):
                    if len(ordinals) or kind != EMBEDDINGS:
                        f.write(section(kind, spool.size))
                        for piece in spool.pieces(order):
                            f.write(piece)
                f.write(section(METADATA, metadata.size + 2 * max(len(ordinals) - 1, 0) + 2) + b"{")
                for piece in metadata.pieces(order, b", "):
                    f.write(piece)
                f.write(b"}")
        return Written(part)

    def commit(self, messages: list) -> None:
        on, path = file_system(self.path)
        parts = [m.part for m in messages if m is not None]
        if len(parts) > 1:
            self.abort(messages)
            raise ValueError("a CTX file is written by one task: coalesce(1) first")
        if parts:
            on.move(parts[0], path)

    def abort(self, messages: list) -> None:
        on, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                on.delete_file(m.part)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CtxSource)


def write_ctx(df: DataFrame, path: str, **options: str) -> None:
    """All of `df` (columns of SCHEMA) into one file, in order."""
    register(df.sparkSession)
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    df.select(*cols).coalesce(1).sortWithinPartitions("ordinal").write.format("ctx").mode("append").options(**options).save(path)


def read_header(path: str) -> dict:
    """The header of a file."""
    on, own = file_system(path)
    with on.open_input_file(own) as f:
        at, n = sections(f, f.size()).get(HEADER, [(0, 0)])[-1]
        f.seek(at)
        return json.loads(f.read(n)) if n else {}


def read_ctx(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("ctx").load(path)
