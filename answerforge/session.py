"""Session helpers: table access, shared checkpoint folder, lineage cuts, hot keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys holding more than 1/HOT_PARTS of all rows are "hot"; there can be at most HOT_PARTS of them.
HOT_PARTS = 1000
#: Rows of one key that any task can take, however few there are in all.
COLD_ROWS = 4096


def get_spark(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and bench use; on a cluster pass your own."""
    builder = SparkSession.builder.master(f"local[{cpus}]")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map={**base, **conf}).getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        home = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="answerforge-")  # the driver's own copy; Spark sends it to the executors
        atexit.register(shutil.rmtree, folder, True)
        target = Path(folder) / "answerforge.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        context.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"answerforge-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_own: set[str] = set()


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's Python ends."""
    folder = f"{shared_dir(spark)}/answerforge-{spark.sparkContext.applicationId}"
    if folder not in _own:
        _own.add(folder)
        atexit.register(clean_shared, folder, spark)
    return folder


def clean_shared(folder: str, spark: SparkSession) -> None:
    """Removes the tables that `materialize` wrote under the folder; frames that read them end with it."""
    try:
        if folder.startswith("/") or folder.startswith("file:/"):
            shutil.rmtree(folder.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        else:
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


_scopes: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialize` writes inside the block are removed at its end: for a long-lived driver, around one query and
    the action on its result. Without it they go when the driver's Python ends."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            clean_shared(path, spark)


def _new_table(spark: SparkSession, name: str) -> str:
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors,
    and gives the planner the true size for later broadcast decisions."""
    spark = df.sparkSession
    path = _new_table(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(parts: Iterator[DataFrame], name: str = "t") -> DataFrame | None:
    """Like `materialize` for frames of one schema that come one by one: each is written before the next is asked for,
    and all are read back as one table, so neither memory nor the plan grows with their number. None if there are none."""
    path = schema = spark = None
    for df in parts:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = _new_table(spark, name)
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return None if path is None else spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: for heavy per-row work over a few small files.
    Inputs with enough splits stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def hot_keys(counts: DataFrame, key: str, n: str, total: int, parts: int = HOT_PARTS) -> DataFrame:
    """Of (key, n) the keys with more than total/parts rows. At most `parts` rows by pigeonhole, so the
    result may be broadcast whatever the size of the data."""
    return counts.where(F.col(n) > F.lit(max(1, total // parts))).limit(parts).select(key, n)


def join_hot_cold(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner join on keys that are unique in `right`, whose column `n` says how many rows of `left` have the key.

    Keys holding more than 1/HOT_PARTS of all rows, at most HOT_PARTS of them, meet their rows by
    broadcast, so that no partition gets a hot key whole; the others are shuffled.
    """
    limit = max(1, total // HOT_PARTS)
    is_hot = F.col(n) > F.lit(limit)
    hot = F.broadcast(right.where(is_hot).limit(HOT_PARTS))
    cold = right.where(~is_hot)
    same = left.join(hot, on, "inner")
    rest = left.join(F.broadcast(right.where(is_hot).limit(HOT_PARTS).select(*on)), on, "left_anti").join(cold, on, "inner")
    return same.unionByName(rest)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """`join_hot_cold` for a written table `right`: where no key holds more than COLD_ROWS rows, one plain join, whose plan
    takes the driver far less memory than two broadcasts and a union."""
    if total <= COLD_ROWS or right.where(F.col(n) > COLD_ROWS).isEmpty():
        return left.join(right, on)
    return join_hot_cold(left, right, on, n, total)
