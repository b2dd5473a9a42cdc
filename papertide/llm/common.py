"""What the operators share: tables, the shared folder, and Python workers that can import this package."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_can_import(spark: SparkSession) -> None:
    """Python workers started from here on find this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def give_back() -> None:
    """Returns what a Python worker has freed to the machine: workers live on from stage to stage, beside full heaps."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="papertide-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Its rows written once to the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffles and written rows to which nothing refers any more: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def count_at_most(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below a value: a binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    step = 1 << (len(bounds).bit_length() - 1)
    filled = F.array(*[F.lit(b).cast("long") for b in bounds], *[F.lit(None).cast("long")] * (2 * step - len(bounds)))
    steps = F.array(*[F.lit(step >> i) for i in range(step.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda found, s: F.when(F.get(filled, found + s - 1) <= value, found + s).otherwise(found))
