"""Stored tables: replaced at once, described by name, and read through a permanent view.

A stored relation is a folder with one subfolder per version. A version counts from the
moment an empty marker file with its number and its folder's name exists; readers take the
highest marker. Creating a file is one step on every store, so whoever reads sees all old
rows or all new ones, and a write that fails leaves the old ones in place. Catalog tables
point at a version's folder and are moved to the next by one change of their location.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from debtatlas.sources.roll_csv import RAW_TABLE
from debtatlas.sources.staging import STAGING_VIEW, staging_sql

_MARKERS = "_versions"
#: Versions that stay for readers that began before a replacement.
KEPT_VERSIONS = 2


class _Folder:
    """The folder of one stored relation, on whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.place = path.rstrip("/")
        self._store = self._path(self.place).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def markers(self) -> list[str]:
        """Names of the markers, the current one last."""
        folder = self._path(f"{self.place}/{_MARKERS}")
        if not self._store.exists(folder):
            return []
        return sorted(status.getPath().getName() for status in self._store.listStatus(folder))

    def data(self, marker: str) -> str:
        return f"{self.place}/data-{marker.partition('-')[2]}"

    def commit(self, version: str) -> None:
        """Make ``version`` the current one."""
        markers = self.markers()
        number = int(markers[-1].partition("-")[0]) + 1 if markers else 1
        marker = f"{number:012d}-{version}"
        if not self._store.createNewFile(self._path(f"{self.place}/{_MARKERS}/{marker}")):
            raise RuntimeError(f"version {marker} of {self.place} exists")

    def forget_old(self) -> None:
        for marker in self.markers()[:-KEPT_VERSIONS]:
            self._store.delete(self._path(f"{self.place}/{_MARKERS}/{marker}"), False)
            self.drop(self.data(marker))

    def drop(self, place: str) -> None:
        self._store.delete(self._path(place), True)


def _new_version(df: DataFrame, folder: _Folder) -> str:
    version = uuid.uuid4().hex
    place = f"{folder.place}/data-{version}"
    try:
        df.write.parquet(place)
    except Exception:
        folder.drop(place)
        raise
    return version


def publish_parquet(df: DataFrame, path: str) -> DataFrame:
    """Replace the stored copy at ``path`` and return a frame that reads the new one.

    ``df`` may read the copy it replaces. Frames that read an older version stay good until
    ``KEPT_VERSIONS`` more are there.
    """
    folder = _Folder(df.sparkSession, path)
    folder.commit(_new_version(df, folder))
    folder.forget_old()
    return read_published(df.sparkSession, path)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current version at ``path``."""
    folder = _Folder(spark, path)
    markers = folder.markers()
    if not markers:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(folder.data(markers[-1]))


def _home(spark: SparkSession, table: str) -> str:
    """Where the versions of a table without a path of its own are kept."""
    *database, name = table.split(".")
    place = spark.catalog.getDatabase(database[0] if database else spark.catalog.currentDatabase())
    return f"{place.locationUri}/{name}-versions"


def publish_table(df: DataFrame, table: str = RAW_TABLE, path: str | None = None) -> DataFrame:
    """Create or replace a catalog table with the rows of ``df``, its versions under ``path``.

    With the columns the table has, it is moved to the new rows by one change of its location.
    With others it is created anew under its name, and only then is there a moment without it;
    the rows are all written before.
    """
    spark = df.sparkSession
    folder = _Folder(spark, path or _home(spark, table))
    version = _new_version(df, folder)
    place = f"{folder.place}/data-{version}"
    columns = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    created = f"CREATE TABLE {{}} ({columns}) USING parquet LOCATION '{place}'"
    if not spark.catalog.tableExists(table):
        spark.sql(created.format(table))
    elif [(c.name, c.dataType) for c in spark.catalog.listColumns(table)] == df.dtypes:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
        spark.catalog.refreshTable(table)
    else:
        beside = f"{table}_{version}"
        spark.sql(created.format(beside))
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"ALTER TABLE {beside} RENAME TO {table}")
    folder.commit(version)
    folder.forget_old()
    return spark.table(table)


def describe_table(spark: SparkSession, table: str) -> DataFrame:
    """``column_name`` and ``column_type`` of a table or view known by its name, in order."""
    listed = spark.catalog.listColumns(table)
    return spark.createDataFrame([(c.name, c.dataType) for c in listed],
                                 "column_name string, column_type string")


def create_permanent_view(spark: SparkSession, table: str = RAW_TABLE, view: str = STAGING_VIEW) -> None:
    """Create or replace the staging contract as a view of the catalog, over a stored raw table.

    The catalog keeps the statement, so every session and SQL client reads the view by name,
    and reports run on it, after this session has ended.
    """
    for name in (table, view):
        if not re.fullmatch(r"[A-Za-z0-9_.]+", name):
            raise ValueError(f"not a plain name: {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS {staging_sql(table)}")
