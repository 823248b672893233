"""Collections on a Hadoop file system: Parquet parts and numbered manifests that say which parts a collection has.

A change writes a part with the rows that it inserts, replaces or deletes, and then a manifest; nothing else is rewritten.
A read unites the parts, each without the rows that a later one replaced or deleted. When `PARTS` parts have gathered they
are written as one (a generation); parts go when two generations have followed, so a table that is open stays readable.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a collection's table has. code: bytes 0 to 255; words: the same in 8-byte words for search; canon: metadata as `matches` compares it.
SCHEMA = "chunk_id string, item_id string, chunk_idx int, ordinal bigint, text string, metadata map<string,string>, canon map<string,string>, code array<int>, words array<bigint>"
#: What a part has: seq numbers its rows, place is the ordinal of a row that was there before.
PART = "chunk_id string, item_id string, chunk_idx int, seq bigint, place bigint, text string, metadata map<string,string>, canon map<string,string>, code array<int>, words array<bigint>, deleted boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
PART_COLUMNS = [c.split()[0] for c in PART.split(", ")]
PARTS, BITS = 8, 33  # seq is a partition number and, in its lower BITS, a row's number in it

Part = dict[str, Any]  # name, base (first ordinal), stride (ordinals a partition), end, rows, fresh (no row of it was in an earlier part), packed (all codes have words)


class Catalog:
    """One directory a collection under `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _fs(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self._conf), p

    def path(self, name: str) -> str:
        if "/" in name or name in ("", ".", ".."):
            raise ValueError(f"bad collection name {name!r}")
        return f"{self.root}/{name}"

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def names(self) -> list[str]:
        return sorted(self._list(self.root))

    def _versions(self, name: str) -> list[int]:
        return sorted(int(n[8:]) for n in self._list(self.path(name)) if n.startswith("current-"))

    def manifest(self, name: str, version: int | None = None) -> tuple[int, int, list[Part]]:
        """Version, generation and parts; version 0 if there is nothing."""
        versions = self._versions(name)
        if not versions:
            return 0, 0, []
        v = versions[-1] if version is None else version
        fs, p = self._fs(f"{self.path(name)}/current-{v}")
        with_ = fs.open(p)
        try:
            body = json.loads(bytes(with_.readAllBytes()).decode())
        finally:
            with_.close()
        return v, body["generation"], body["parts"]

    def publish(self, name: str, version: int, generation: int, parts: list[Part]) -> None:
        """A new manifest; an error if another writer took the version."""
        fs, p = self._fs(f"{self.path(name)}/current-{version}")
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps({"generation": generation, "parts": parts}).encode()))
        finally:
            out.close()

    def stage(self, name: str, rows: DataFrame, base: int, fresh: bool) -> Part:
        """Write a part (columns of PART). It counts once a manifest names it."""
        part = f"part-{uuid.uuid4().hex}"
        rows.select(*PART_COLUMNS).write.parquet(f"{self.path(name)}/{part}")
        # the largest partition's rows: one number, whatever the part's size
        first = F.col("seq").bitwiseAND((1 << BITS) - 1)
        n, stride, last, packed = self._rows(name, part).agg(F.count("*"), F.coalesce(F.max(first) + 1, F.lit(0)), F.coalesce(F.max(F.shiftright("seq", BITS)), F.lit(-1)), F.coalesce(F.bool_and(F.col("words").isNotNull() | F.col("deleted")), F.lit(True))).first()
        return {"name": part, "base": base, "stride": stride, "end": base + stride * (last + 1), "rows": n, "fresh": fresh, "packed": packed}

    def _rows(self, name: str, part: str) -> DataFrame:
        return self.spark.read.schema(PART).parquet(f"{self.path(name)}/{part}")

    def part(self, name: str, part: Part) -> DataFrame:
        """A part's rows with their ordinals, deleted ones too."""
        ordinal = F.lit(part["base"]).cast("bigint") + F.shiftright("seq", BITS) * F.lit(part["stride"]) + F.col("seq").bitwiseAND((1 << BITS) - 1)
        return self._rows(name, part["name"]).withColumn("ordinal", F.coalesce("place", ordinal))

    def table(self, name: str, parts: list[Part]) -> DataFrame:
        """The living rows of the parts, each without what later parts replaced or deleted."""
        out, gone = None, None
        for p in reversed(parts):
            rows = self.part(name, p)
            own = rows.where("not deleted").select(*COLUMNS)
            if gone is not None:
                own = own.join(gone, "chunk_id", "left_anti").select(*COLUMNS)
            out = own if out is None else own.unionByName(out)
            if not p["fresh"]:
                keys = rows.select("chunk_id")
                gone = keys if gone is None else gone.unionByName(keys)
        return out if out is not None else self.spark.createDataFrame([], SCHEMA)

    def read(self, name: str) -> DataFrame | None:
        """The current table, or None."""
        v, _, parts = self.manifest(name)
        return self.table(name, parts) if v else None

    def commit(self, name: str, version: int, generation: int, parts: list[Part]) -> tuple[int, int, list[Part]]:
        """Publish `parts` after `version`; many parts are written as one first."""
        if len(parts) > PARTS:
            rows = self.table(name, parts).withColumn("place", F.col("ordinal")).withColumn("seq", F.monotonically_increasing_id()).withColumn("deleted", F.lit(False))
            one = self.stage(name, rows, 0, True)
            parts, generation = [one | {"end": max(p["end"] for p in parts)}], generation + 1
        self.publish(name, version + 1, generation, parts)
        if len(parts) == 1 and generation >= 2:
            self._sweep(name, generation - 1)
        return version + 1, generation, parts

    def _sweep(self, name: str, least: int) -> None:
        """Delete manifests of generations before `least`, and the parts that no other names."""
        keep, old, fs = set(), [], self._fs(self.path(name))[0]
        for v in self._versions(name):
            _, generation, parts = self.manifest(name, v)
            if generation < least:
                old.append((v, {p["name"] for p in parts}))
            else:
                keep |= {p["name"] for p in parts}
        for v, parts in old:
            for n in [f"current-{v}", *(parts - keep)]:
                fs.delete(self._path(f"{self.path(name)}/{n}"), True)

    def delete(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return bool(fs.delete(p, True)) if fs.exists(p) else False
