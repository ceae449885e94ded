"""Named datasets: Parquet folders below one root."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ConflictError, ToolkitError, UnknownDatasetError
from rowloom.functions.columns import require
from rowloom.sources import storage
from rowloom.sources.files import write_table

EXPORT_FORMATS = ("csv", "json", "parquet")
# File that holds the layout of a clustered version; readers of the folder pass it over.
LAYOUT = "_layout.json"


def _table_of(where: str) -> str:
    """The name under which the session's catalog knows a clustered version."""
    return "rowloom_" + re.sub(r"\W", "_", where.rstrip("/").rsplit("/", 1)[1])


class Datasets:
    """Datasets by name below ``root``, a folder all executors can reach.

    Each write goes to a new version folder and counts once Spark has committed it and a pointer
    names it, so a dataset can be read and overwritten in one plan and a failed write leaves the
    old version in place. Pointers are numbered files; a number can be taken once only, so of two
    writers that saw the same version one finds out (see :meth:`write`). About the content only
    its layout is stored beside it: columns come from the Parquet schema, row counts from footers.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folder(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.\-]*", name) or ".." in name:
            raise ToolkitError(f"not a usable dataset name: {name!r}")
        return f"{self.root}/{name}"

    def _versions(self, name: str) -> list[storage.Entry]:
        """Committed versions, oldest first."""
        folders = [e for e in storage.entries(self.spark, self._folder(name)) if e.is_folder and e.name.startswith("v-")]
        return [e for e in folders if storage.exists(self.spark, f"{e.path}/_SUCCESS")]

    def _pointers(self, name: str) -> list[storage.Entry]:
        return [e for e in storage.entries(self.spark, self._folder(name)) if not e.is_folder and re.fullmatch(r"p-\d{10}", e.name)]

    def _pointed(self, name: str) -> tuple[int, storage.Entry | None]:
        """Number of the last pointer, and the version it names; without pointers the newest version."""
        pointers, versions = self._pointers(name), self._versions(name)
        if not pointers:
            return 0, versions[-1] if versions else None
        wanted = storage.read_text(self.spark, pointers[-1].path)
        return int(pointers[-1].name[2:]), next((v for v in versions if v.name == wanted), None)

    def _current(self, name: str) -> storage.Entry:
        version = self._pointed(name)[1]
        if version is None:
            raise UnknownDatasetError(f"unknown dataset {name!r}; known: {self.names()}")
        return version

    def version(self, name: str) -> str:
        """The current version's name, to be given to :meth:`write` as ``replaces``."""
        return self._current(name).name

    def names(self) -> list[str]:
        found = [e.name for e in storage.entries(self.spark, self.root) if e.is_folder]
        return [n for n in found if self._versions(n)]

    def write(
        self,
        df: DataFrame,
        name: str | None = None,
        partition_by: str | Sequence[str] | None = None,
        cluster_by: str | Sequence[str] | None = None,
        buckets: int = 200,
        replaces: str | None = None,
    ) -> str:
        """Save a table, replacing the dataset of that name; without a name one is made from the clock.

        ``cluster_by`` deals the rows into ``buckets`` files by a hash of these columns and sorts each: joins and
        deduplications by them need no shuffle, joins between datasets of as many buckets. A key's rows are all in one
        bucket. With ``replaces`` the write counts only if that version is still the current one; otherwise
        it is undone and a :class:`ConflictError` raised.
        """
        now = datetime.now(timezone.utc)
        name = name or f"dataset_{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
        version = f"v-{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        where = f"{self._folder(name)}/{version}"
        number, current = self._pointed(name)
        if replaces is not None and (current is None or current.name != replaces):
            raise ConflictError(f"dataset {name!r} is at {current.name if current else None!r}, not at {replaces!r}")
        if cluster_by is None:
            writer = df.write
            if partition_by is not None:
                writer = writer.partitionBy(*require(df, partition_by))
            writer.parquet(where)
        else:
            if partition_by is not None or buckets < 1:
                raise ToolkitError("a clustered dataset has a positive number of buckets and no partitions")
            self._write_clustered(df, where, require(df, cluster_by), buckets)
        while not storage.create_text(self.spark, f"{self._folder(name)}/p-{number + 1:010d}", version):
            if replaces is not None:
                self._delete_version(where)
                raise ConflictError(f"dataset {name!r} was replaced while it was written")
            number = self._pointed(name)[0]
        return name

    def _write_clustered(self, df: DataFrame, where: str, keys: list[str], buckets: int) -> None:
        # the same hash deals rows to tasks and to buckets, so that each bucket is one file
        writer = df.repartition(buckets, *[F.col(f"`{k}`") for k in keys]).write.bucketBy(buckets, *keys).sortBy(*keys)
        writer.format("parquet").option("path", where).saveAsTable(_table_of(where))
        layout = {"keys": keys, "buckets": buckets, "schema": df.schema.jsonValue()}
        storage.create_text(self.spark, f"{where}/{LAYOUT}", json.dumps(layout))

    def _open(self, where: str) -> DataFrame:
        if not storage.exists(self.spark, f"{where}/{LAYOUT}"):
            return self.spark.read.parquet(where)
        # Spark 4.1 counts too many groups over a union of bucketed tables if it takes their buckets for the union's
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        layout = json.loads(storage.read_text(self.spark, f"{where}/{LAYOUT}"))
        name = _table_of(where)
        if not self.spark.catalog.tableExists(name):
            # written by another session: its buckets are made known to this one
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(layout["schema"]).fields)
            keys = ", ".join(f"`{k}`" for k in layout["keys"])
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys})"
                f" INTO {int(layout['buckets'])} BUCKETS LOCATION '{where}'"
            )
        return self.spark.table(name)

    def _delete_version(self, where: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {_table_of(where)}")
        storage.delete_folder(self.spark, where)

    def put_rows(
        self, columns: Sequence[str], rows: Sequence[Sequence[Any]], name: str | None = None, schema: T.StructType | str | None = None
    ) -> str:
        """Save literal rows, for small seeds; give a schema where types cannot be seen from the values."""
        for row in rows:
            if len(row) != len(columns):
                raise ToolkitError(f"a row has {len(row)} values for {len(columns)} columns")
        if not rows and schema is None:
            schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        df = self.spark.createDataFrame([tuple(r) for r in rows], schema or list(columns))
        return self.write(df, name)

    def read(self, name: str) -> DataFrame:
        """The current version, read lazily."""
        return self._open(self._current(name).path)

    def list(self) -> DataFrame:
        """(name, created_at, columns, path) of all datasets; no data is read."""
        rows = []
        for name in self.names():
            version = self._current(name)
            rows.append((name, version.modified_ms, self.spark.read.parquet(version.path).columns, version.path))
        df = self.spark.createDataFrame(rows, "name string, ms bigint, columns array<string>, path string")
        return df.select("name", F.timestamp_millis("ms").alias("created_at"), "columns", "path")

    def describe(self, name: str) -> DataFrame:
        """One row: (name, rows, columns, path), the count taken now from the Parquet footers."""
        version = self._current(name)
        df = self.spark.read.parquet(version.path)
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), "rows", F.array(*[F.lit(c) for c in df.columns]).alias("columns"), F.lit(version.path).alias("path")
        )

    def drop(self, name: str) -> None:
        """Remove a dataset with all its versions."""
        self._current(name)
        for version in self._versions(name):
            self._delete_version(version.path)
        storage.delete_folder(self.spark, self._folder(name))

    def drop_old_versions(self, name: str) -> int:
        """Remove all but the current version, once nobody reads them; the number removed."""
        current = self._current(name)
        old = [v for v in self._versions(name) if v.name < current.name]
        for version in old:
            self._delete_version(version.path)
        return len(old)

    def export(self, name: str, fmt: str, path: str) -> str:
        """Write a dataset as a folder of CSV, JSON or Parquet files."""
        return export_dataset(self.read(name), fmt, path)


def export_dataset(df: DataFrame, fmt: str, path: str, mode: str = "errorifexists") -> str:
    """Write a table as a folder of CSV, JSON (one record per line) or Parquet files."""
    if fmt not in EXPORT_FORMATS:
        raise ToolkitError(f"unknown export format {fmt!r}; known: {list(EXPORT_FORMATS)}")
    return write_table(df, path, fmt, mode)
