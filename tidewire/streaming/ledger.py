"""Tables that change together, a numbered commit at a time, and rewrite only the parts that a batch touches.

Every table is dealt to parts by an expression over its keys.  A commit writes new files for
the parts it touches, and last of all a manifest that names the files of every part of every
table.  Readers follow the newest manifest, so they see all of a commit or nothing of it; a
commit that broke off is run again over the same state, and one that is done is not repeated.
"""
from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import cut, forget

PART = "_part"
KEPT = 2  # manifests, with their files, that readers can still be following


@dataclass(frozen=True)
class Table:
    """Columns as DDL, and an expression over them that gives a row's part: a whole number."""

    schema: str
    part: str


class Ledger:
    """Tables under a folder of the shared file system.  One writer at a time; numbers of commits go up."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table]):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables

    # -------------------------------------------------------------- files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json"))

    def _manifest(self, number: int) -> dict:
        stream = self._files.open(self._path(f"manifest/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> None:
        """A manifest appears whole, by a rename."""
        open_, done = self._path(f"manifest/{number:012d}.open"), self._path(f"manifest/{number:012d}.json")
        stream = self._files.create(open_, True)
        try:
            stream.write(json.dumps(manifest).encode())
        finally:
            stream.close()
        if not self._files.rename(open_, done):
            raise RuntimeError(f"commit {number} is there already")

    # -------------------------------------------------------------- reading

    def latest(self) -> dict:
        """The newest manifest: number, facts, and for each table the number of the commit that wrote each part."""
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else {"number": -1, "facts": {}, "tables": {}}

    def table(self, name: str, parts: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table, or some of its parts, as of a manifest, the newest unless one is given."""
        held = (manifest or self.latest())["tables"].get(name, {})
        schema = StructType.fromDDL(self.tables[name].schema)
        wanted = held if parts is None else {str(p) for p in parts} & held.keys()
        paths = [f"{self.folder}/{name}/{held[p]}/{PART}={p}" for p in sorted(wanted, key=int)]
        if paths:
            return self.spark.read.schema(schema).parquet(*paths)
        # no rows, and no tasks of Python that would find none
        return self.spark.range(0, 0, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    # -------------------------------------------------------------- writing

    def begin(self, number: int) -> Commit | None:
        """A commit to fill, or None where one of this number or a later one is done."""
        manifest = self.latest()
        return None if manifest["number"] >= number else Commit(self, number, manifest)

    def _prune(self) -> None:
        """Delete manifests beyond the newest KEPT, and the files that only those name."""
        numbers = self._numbers()
        files = lambda m: {(t, p, n) for t, parts in m["tables"].items() for p, n in parts.items()}
        kept = set().union(*(files(self._manifest(n)) for n in numbers[-KEPT:]))
        for number in numbers[:-KEPT]:
            for name, part, written in files(self._manifest(number)) - kept:
                self._files.delete(self._path(f"{name}/{written}/{PART}={part}"), True)
            self._files.delete(self._path(f"manifest/{number:012d}.json"), False)


class Commit:
    """What one commit changes.  Its own reads see its own writes; others see them after ``publish``."""

    def __init__(self, ledger: Ledger, number: int, manifest: dict):
        self.ledger, self.number = ledger, number
        self.manifest = {"number": number, "facts": dict(manifest["facts"]), "tables": {t: dict(p) for t, p in manifest["tables"].items()}}
        self._held: list[DataFrame] = []
        self._replaced: set[str] = set()

    @property
    def facts(self) -> dict:
        """Numbers kept with the tables."""
        return self.manifest["facts"]

    def held(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once; deleted when the commit ends."""
        self._held.append(cut(df, name))
        return self._held[-1]

    def parts(self, name: str, rows: DataFrame) -> list[int]:
        """The parts of a table that rows, which need the columns of its part expression, lie in."""
        part = F.expr(self.ledger.tables[name].part).cast("long")
        return [r[0] for r in rows.select(part).distinct().collect()]

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        return self.ledger.table(name, parts, self.manifest)

    def replace(self, name: str, rows: DataFrame, parts: list[int]) -> None:
        """Make ``rows`` the content of these parts of a table, once a commit.  Rows must lie in them."""
        if name in self._replaced:
            raise ValueError(f"commit {self.number} has written {name} already")
        spec = self.ledger.tables[name]
        columns = StructType.fromDDL(spec.schema)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns]).withColumn(PART, F.expr(spec.part).cast("long"))
        path = f"{self.ledger.folder}/{name}/{self.number}"
        # a part's rows meet in a task, or in several where adaptive execution finds too many
        rows.hint("rebalance", F.col(PART)).write.mode("overwrite").partitionBy(PART).parquet(path)
        there = {n.removeprefix(f"{PART}=") for n in self.ledger._names(f"{name}/{self.number}")}
        self._replaced.add(name)
        held = self.manifest["tables"].setdefault(name, {})
        for part in map(str, parts):
            if part in there:
                held[part] = self.number
            else:
                held.pop(part, None)

    def merge(self, name: str, batch: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merge a batch into the parts of a table that it touches: how(stored, batch) gives their next rows."""
        batch = self.held(batch, name)
        parts = self.parts(name, batch)
        if parts:
            self.replace(name, how(self.table(name, parts), batch), parts)
        return parts

    def publish(self) -> dict:
        """The last write: from here on readers see the commit."""
        self.ledger._publish(self.number, self.manifest)
        self.close()
        self.ledger._prune()
        return self.manifest

    def close(self) -> None:
        forget(*self._held)
        self._held = []
