"""Durable intermediate results and versioned Parquet tables.

Both live in shared storage: the folder in ``spark.checkpoint.dir``, or the table's own path.

A table is a folder with ``data/`` and ``log/``. Every write goes to a data folder of its own name; a version counts once its
entry ``log/<number>.json``, which names the data folders, has been put in place. An entry is written aside and moved to its
name, which fails if the name is taken: of two writers that start from one version only one gets the next number, the
other starts again from what the first left. This needs a file system whose rename does not overwrite (HDFS and the like);
on local disks a hard link does the same.
"""

from __future__ import annotations

import atexit
import json
import os
import random
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_made: dict[str, list[str]] = {}

#: Versions that stay readable beside the newest.
KEPT = 4
TRIES = 12
#: Data folders that no version names go when they are older than this.
ORPHAN_HOURS = 24


def work_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where none is named (local tests) a temporary one, removed at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="newsmart-")
        atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
    return _local_folders[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the work folder that nothing else uses; ``release`` removes it."""
    path = f"{work_dir(spark)}/{name}/{uuid.uuid4().hex}"
    _made.setdefault(spark.conf.get("spark.app.id", ""), []).append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """The same rows read back from shared storage: computed once, safe against lost executors."""
    path = new_folder(df.sparkSession, "durable")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes all work folders of this application, once no result that was built on them is read any more."""
    paths = _made.pop(spark.conf.get("spark.app.id", ""), [])
    return sum(remove(spark, p) for p in paths)


def few_rows(df: DataFrame, most: int) -> pa.Table:
    """The rows of a result that is small by construction; more than ``most`` are an error, never fetched."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"over {most} rows where at most {most} were expected")
    return rows


# --- files --------------------------------------------------------------------------------------


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.delete(place, True)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on local disks; None where files lie elsewhere."""
    files, place = _at(spark, path)
    return files.makeQualified(place).toUri().getPath() if files.getUri().getScheme() == "file" else None


def names(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder with the time of their last change in seconds; none if there is no folder."""
    files, place = _at(spark, folder)
    if not files.exists(place):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in files.listStatus(place)}


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _at(spark, path)
    stream = files.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file was put in place, whole; false if there is one already."""
    files, place = _at(spark, path)
    if files.exists(place):
        return False
    files.mkdirs(place.getParent())
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.getUri().getScheme() != "file":
        placed = not files.exists(place) and files.rename(aside, place)
    else:
        try:
            os.link(aside.toUri().getPath(), place.toUri().getPath())
            placed = True
        except FileExistsError:
            placed = False
    files.delete(aside, False)
    return placed


def written_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], schema=None) -> DataFrame:
    """The rows at ``path``, built and written there unless an earlier try has done so to the end."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


# --- versions -----------------------------------------------------------------------------------


class ConflictError(RuntimeError):
    """Other writers kept taking the next version."""


def _entry_path(base: str, version: int) -> str:
    return f"{base}/log/{version:012d}.json"


def _versions(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n[:12]) for n in names(spark, f"{base}/log") if n.endswith(".json"))


def latest_version(spark: SparkSession, base: str) -> int | None:
    return max(_versions(spark, base), default=None)


def entry(spark: SparkSession, base: str, version: int) -> dict:
    """What is noted of a version: its data folders and whatever its writer added."""
    return json.loads(read_text(spark, _entry_path(base, version)))


def new_data(base: str) -> str:
    """Name of a data folder, relative to the table."""
    return f"data/{uuid.uuid4().hex}"


def commit(spark: SparkSession, base: str, version: int, data: Iterable[str], **more) -> bool:
    """Notes a version; false if another writer has taken the number."""
    text = json.dumps({"version": version, "data": sorted(data), **more})
    return put_if_absent(spark, _entry_path(base, version), text)


def read_version(spark: SparkSession, base: str, version: int, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*(f"{base}/{d}" for d in entry(spark, base, version)["data"]))


def read_latest(spark: SparkSession, base: str, schema=None) -> DataFrame:
    """Newest version; an empty table with the given schema when there is none yet."""
    version = latest_version(spark, base)
    return spark.createDataFrame([], schema) if version is None else read_version(spark, base, version, schema)


def committed(spark: SparkSession, base: str, attempt: Callable[[int, int | None], tuple[list[str], dict, list[str]]], kept: int = KEPT) -> int:
    """The version that ``attempt`` made. It is called with the next version and the current one (None at first) and returns
    the data folders that make up the new version, further notes, and the folders it wrote itself, which go if another
    writer was faster; it is then called again."""
    for tries in range(TRIES):
        current = latest_version(spark, base)
        version = (current or 0) + 1
        data, more, own = attempt(version, current)
        if commit(spark, base, version, data, **more):
            retire(spark, base, kept)
            return version
        for folder in own:
            remove(spark, f"{base}/{folder}")
        time.sleep(random.uniform(0, 0.05 * 2 ** min(tries, 6)))
    raise ConflictError(f"{base}: no version in {TRIES} tries")


def replace_table(spark: SparkSession, base: str, build: Callable[[DataFrame], DataFrame], schema=None, kept: int = KEPT) -> int:
    """Next version = build(current version), built again if another writer was faster. Repeating a whole call after a
    failure starts from the same input."""

    def attempt(version: int, current: int | None) -> tuple[list[str], dict, list[str]]:
        old = spark.createDataFrame([], schema) if current is None else read_version(spark, base, current, schema)
        folder = new_data(base)
        build(old).write.parquet(f"{base}/{folder}")
        return [folder], {}, [folder]

    return committed(spark, base, attempt, kept)


def append_table(spark: SparkSession, base: str, rows: DataFrame, kept: int = KEPT) -> int:
    """Next version = current data folders and one more with ``rows``, which are written once whoever else writes."""
    folder = new_data(base)
    rows.write.parquet(f"{base}/{folder}")

    def attempt(version: int, current: int | None) -> tuple[list[str], dict, list[str]]:
        old = [] if current is None else entry(spark, base, current)["data"]
        return [*old, folder], {}, []

    return committed(spark, base, attempt, kept)


def retire(spark: SparkSession, base: str, kept: int = KEPT) -> None:
    """Removes versions before the newest and the ``kept`` before it, with the data that no kept one names."""
    versions = _versions(spark, base)
    old, new = versions[: -kept - 1], versions[-kept - 1 :]
    if not old:
        return
    used = {d for v in new for d in entry(spark, base, v)["data"]}
    for v in old:
        try:
            gone = set(entry(spark, base, v)["data"]) - used
        except Exception:  # noqa: BLE001 - another writer may be retiring the same version
            continue
        for folder in gone:
            remove(spark, f"{base}/{folder}")
        remove(spark, _entry_path(base, v))


def sweep(spark: SparkSession, base: str, hours: float = ORPHAN_HOURS) -> int:
    """Removes data folders that failed writers left behind: named by no version and not changed for ``hours``."""
    used = {d.split("/")[1] for v in _versions(spark, base) for d in entry(spark, base, v)["data"]}
    old = [n for n, at in names(spark, f"{base}/data").items() if n not in used and at < time.time() - hours * 3600]
    return sum(remove(spark, f"{base}/data/{n}") for n in old)
