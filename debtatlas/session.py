"""Reliable materialisation of frames that several steps of one operator read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"
_invented: dict[str, str] = {}
_settled: dict[str, list[str]] = {}


def _application(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", "session")


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder that every executor reaches.

    The cluster names the folder in ``spark.checkpoint.dir`` and answers for it being
    shared. Only a session on one machine may go without: it gets a temporary one.
    """
    application = _application(spark)
    named = spark.conf.get(FOLDER_SETTING, None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError(f"set {FOLDER_SETTING} to a folder all executors share")
        if application not in _invented:
            _invented[application] = tempfile.mkdtemp(prefix="debtatlas-")
        named = _invented[application]
    return f"{named}/{application}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, whose content ``release`` deletes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    _settled.setdefault(_application(spark), []).append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and return a frame that reads it.

    The lineage ends there: every later reader sees the very same rows, also after
    executors are lost, and reads only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is settled inside is deleted at the end, but for what went through the function
    that this gives: it settles a frame to keep.

    For operators of many steps whose result needs only the last. Frames that read the
    others must not outlive the block.
    """
    paths = _settled.setdefault(_application(spark), [])
    begun, kept = len(paths), set()

    def keep(df: DataFrame) -> DataFrame:
        found = settle(df)
        kept.add(paths[-1])
        return found

    try:
        yield keep
    finally:
        new = paths[begun:]
        paths[begun:] = [path for path in new if path in kept]
        _delete(spark, [path for path in new if path not in kept])


def release(spark: SparkSession) -> int:
    """Delete what ``settle`` wrote in this application; frames that read it are spent.

    Call it when the reports of a run have been written or collected.
    """
    paths = _settled.pop(_application(spark), [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    configuration = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)
