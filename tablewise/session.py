"""Spark session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
CONCURRENT_TABLES = 8


def build_session(app: str = "tablewise", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on: UTC timestamps and runtime skew handling.

    Joins are left to AQE, which broadcasts a side only after measuring it and splits hot
    partitions; forcing the skew rule lets it do so even when that costs an extra exchange.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tablewise-"), "tablewise.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(os.path.realpath(path))
    _shipped.add(context.applicationId)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder in ``spark.checkpoint.dir``.

    A machine-local folder is used only where the setting is absent and Spark runs on one
    machine (tests); on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tablewise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several later jobs read, and read it back: cuts lineage and
    survives the loss of executors."""
    path = work_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def per_table(work: Callable[[str, DataFrame], T], tables: Mapping[str, DataFrame]) -> dict[str, T]:
    """The same work on several tables at once: independent jobs share the cluster instead of
    waiting for each other's last tasks."""
    if len(tables) < 2:
        return {name: work(name, df) for name, df in tables.items()}
    target = inheritable_thread_target(next(iter(tables.values())).sparkSession)(work)
    with ThreadPoolExecutor(min(CONCURRENT_TABLES, len(tables))) as pool:
        return dict(zip(tables, pool.map(target, tables, tables.values())))
