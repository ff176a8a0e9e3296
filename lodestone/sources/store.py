"""Tables on disk that change by whole commits.

A table is a set of parts, each a folder of Parquet files; a manifest names the folder of every part of every table. A commit writes
the parts it replaces to new folders and the next manifest last, as one file, so a reader sees all of a commit or nothing of it, a run that
dies leaves the old state, and the files of untouched parts stay what they were. One writer commits at a time: of two that
start from one version, the second finds its manifest written and fails. Folders that no manifest names are left to the owner.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shuffle files of a written table go at once; else they lie on the disks until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MANIFEST = "name string, part string, path string, columns string, v long"


@dataclass(frozen=True)
class Change:
    """``rows`` have a string column ``part`` and are all rows of their parts; parts in ``drop`` go, whether rows come for them or not.

    Rows may be a function of the tables that this commit has written so far, by name. They are dealt by part; ``opened`` makes the table's
    rows of what was dealt, where it is packed for the way. ``laid`` has more rows that lie by part already and are written as they come.
    """

    rows: DataFrame | Callable[[dict[str, DataFrame]], DataFrame] | None = None
    drop: Iterable[str] = ()
    files: int = 1  #: a part's rows are dealt over so many tasks
    opened: Callable[[DataFrame], DataFrame] | None = None
    laid: DataFrame | None = None


@dataclass
class Store:
    spark: SparkSession
    root: str
    version: int = 0
    parts: dict[str, dict[str, str]] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.load()

    def load(self) -> Store:
        """Reads the newest manifest, one row per part."""
        self.version, self.parts, self.columns = 0, {}, {}
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self
        self.version = rows.agg(F.max("v")).first()[0] or 0
        for r in rows.filter(F.col("v") == self.version).collect():
            if r["part"]:
                self.parts.setdefault(r["name"], {})[r["part"]] = r["path"]
            if r["name"]:
                self.columns[r["name"]] = r["columns"]
        return self

    def table(self, name: str, parts: Iterable[str] | None = None) -> DataFrame | None:
        """The rows of a table, or of some of its parts; None where no commit had it."""
        if name not in self.columns:
            return None
        held = self.parts.get(name, {})
        paths = [held[p] for p in sorted(held if parts is None else set(parts) & set(held))]
        schema = T.StructType.fromDDL(self.columns[name])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, changes: Mapping[str, Change]) -> Store:
        """Writes all changes as the next version."""
        run = uuid.uuid4().hex
        parts, columns = {n: dict(p) for n, p in self.parts.items()}, dict(self.columns)
        done: dict[str, DataFrame] = {}
        for name, change in changes.items():
            held = parts.setdefault(name, {})
            for p in change.drop:
                held.pop(p, None)
            if change.rows is None:
                continue
            path = f"{self.root}/data/{name}/{run}"
            rows = change.rows if isinstance(change.rows, DataFrame) else change.rows(done)
            salt = [] if change.files < 2 else [F.pmod(F.xxhash64(*[c for c in rows.columns if c != "part"]), F.lit(change.files))]
            rows = rows.repartition("part", *salt)
            rows = change.opened(rows) if change.opened else rows
            rows = rows if change.laid is None else rows.unionByName(change.laid)
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "part"])
            with shuffles_freed(self.spark):
                rows.write.partitionBy("part").option("compression", "zstd").parquet(path)
            columns[name] = schema.toDDL()
            done[name] = self.spark.read.schema(T.StructType([*schema, T.StructField("part", T.StringType())])).parquet(path)
            for r in done[name].select("part").distinct().collect():  # at most the parts of one commit
                held[r["part"]] = f"{path}/part={r['part']}"
        rows = [(n, p, path, columns.get(n, "")) for n, held in parts.items() for p, path in held.items()] + [(n, "", "", c) for n, c in columns.items()] + [("", "", "", "")]
        manifest = self.spark.createDataFrame(rows, "name string, part string, path string, columns string")
        manifest.coalesce(1).write.json(f"{self.root}/manifest/v={self.version + 1}")
        return self.load()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def part_of(key: Column) -> Column:
    """A part for each value of a key, of letters and digits only; a null key has one of its own."""
    return F.concat(F.lit("k"), F.coalesce(F.lower(F.hex(key.cast("string"))), F.lit("null")))
