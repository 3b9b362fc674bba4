"""Tables whose rows are replaced by key: every commit only adds files, readers merge.

    <path>/_commits                                   one row per commit, a file each
    <path>/<table>/commit=<n>/attempt=<id>/...        the rows a commit adds to a table
    <path>/_keys/<table>/commit=<n>/attempt=<id>/     the keys whose older rows it replaces there

A commit is its row in ``_commits``, written last and in one file after all of its tables: until then no reader looks into its folders, so tables
written together appear together and a failed attempt is never seen. A commit may carry the id of a batch; a batch that is in the log is not written again.

Reading takes all files of the live commits and leaves out rows with an older commit than the last one that replaces their key. Only commits after the last base
have such keys, so the joined table is as small as what changed since then. :meth:`VersionedStore.compact` writes the merged rows as a new base, its own job.
There is one writer at a time. Rows with a null key are never replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.session import delete_folder, list_folders

LOG = "number bigint, batch string, attempt string, base boolean, tables map<string,string>, written_at timestamp"
VERSION = [T.StructField("commit", T.LongType()), T.StructField("attempt", T.StringType())]


class VersionedStore:
    """``keys`` names the key columns of every table, ``partition_by`` columns that lay out a table's folders."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, Sequence[str]], partition_by: Mapping[str, Sequence[str]] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys = {t: list(k) for t, k in keys.items()}
        self.partition_by = {t: list(c) for t, c in (partition_by or {}).items()}

    def log(self) -> list[Row]:
        """All commits, oldest first."""
        try:
            return sorted(self.spark.read.schema(LOG).parquet(f"{self.path}/_commits").collect(), key=lambda c: c.number)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def live(self) -> list[Row]:
        """The last base and the commits after it."""
        log = self.log()
        bases = [i for i, c in enumerate(log) if c.base]
        return log[bases[-1]:] if bases else log

    def begin(self, batch: str | None = None, base: bool = False) -> Commit | None:
        """A new commit, or None if ``batch`` was committed before."""
        log = self.log()
        if batch is not None and any(c.batch == batch for c in log):
            return None
        return Commit(self, log[-1].number + 1 if log else 0, batch, base)

    def folder(self, table: str, commit: Row | Commit) -> str:
        return f"{self.path}/{table}/commit={commit.number}/attempt={commit.attempt}"

    def read(self, table: str) -> DataFrame:
        """The rows of ``table`` that no later commit replaces."""
        found = [c for c in self.live() if table in c.tables]
        if not found:
            raise ValueError(f"no commit in {self.path} has a table {table}")
        rows = self._files(table, T.StructType.fromJson(json.loads(found[-1].tables[table])), found)
        keys = self.keys[table]
        if len(found) > 1:
            key_types = T.StructType([f for f in rows.schema if f.name in keys])
            last = self._files(f"_keys/{table}", key_types, found[1:]).groupBy(*keys).agg(F.max("commit").alias("commit"))
            same = [F.col(f"rows.{k}") == F.col(f"last.{k}") for k in keys]
            rows = rows.alias("rows").join(last.alias("last"), [*same, F.col("rows.commit") < F.col("last.commit")], "left_anti")
        return rows.drop("commit", "attempt")

    def _files(self, table: str, schema: T.StructType, commits: Sequence[Row | Commit]) -> DataFrame:
        folders = [self.folder(table, c) for c in commits]
        return self.spark.read.schema(T.StructType([*schema, *VERSION])).option("basePath", f"{self.path}/{table}").parquet(*folders)

    def compact(self) -> None:
        """Write what readers see as a new base. Files are rebalanced by layout and key, so neither many small commits nor a large partition leave odd sizes."""
        live = self.live()
        if len(live) < 2:
            return
        with self.begin(base=True) as commit:
            for table in {t: None for c in live for t in c.tables}:
                commit.write(table, self.read(table).hint("rebalance", *(self.partition_by.get(table) or self.keys[table])))

    def expire(self) -> list[str]:
        """Delete the folders that no live commit has: replaced by a base, or left by a failed attempt. Only when no older reader is at work."""
        live = {(c.number, c.attempt) for c in self.live()}
        gone = []
        for pattern in ("*", "_keys/*"):
            for folder in list_folders(self.spark, f"{self.path}/{pattern}/commit=*/attempt=*"):
                number, attempt = (part.split("=", 1)[1] for part in folder.rsplit("/", 2)[1:])
                if (int(number), attempt) not in live:
                    delete_folder(self.spark, folder)
                    gone.append(folder)
        return gone


class Commit:
    """Tables written under one commit; leaving the ``with`` block without an error publishes them."""

    def __init__(self, store: VersionedStore, number: int, batch: str | None, base: bool):
        self.store, self.number, self.batch, self.base = store, number, batch, base
        self.attempt = uuid.uuid4().hex
        self.tables: dict[str, str] = {}
        self.staged: list[str] = []

    def __enter__(self) -> Commit:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self._publish()
        for folder in self.staged:
            delete_folder(self.store.spark, folder)

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """An intermediate table in the store's folder, gone when the commit ends."""
        folder = f"{self.store.path}/_staged/{self.attempt}/{name}"
        self.staged.append(folder)
        rows.write.parquet(folder)
        return self.store.spark.read.schema(rows.schema).parquet(folder)

    def write(self, table: str, rows: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
        """Add ``rows`` to ``table`` and replace the keys in ``replaced``, by default those of the rows. Returns the rows as read back, so what is derived from
        them does not compute them again."""
        store, keys = self.store, self.store.keys[table]
        rows.write.partitionBy(*store.partition_by.get(table, [])).parquet(store.folder(table, self))
        self.tables[table] = rows.schema.json()
        written = store._files(table, rows.schema, [self]).drop("commit", "attempt")
        if not self.base:
            (written if replaced is None else replaced).select(*keys).distinct().write.parquet(store.folder(f"_keys/{table}", self))
        return written

    def _publish(self) -> None:
        row = [(self.number, self.batch, self.attempt, self.base, self.tables)]
        names = ", ".join(LOG.split(", ")[:5])
        self.store.spark.createDataFrame(row, names).withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.store.path}/_commits")
