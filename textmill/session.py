"""Session helpers: a configured SparkSession, and shipping this package to Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "textmill", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the benchmark use it; on a cluster pass your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Bytes of a table up to which its few files may be dealt over all cores.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's scan over all cores: a small file is one row group, hence one task, however much work each row is.

    Any other plan, and any larger table, is returned as it is.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(not re.match(r"[\s:+|-]*(Project|Filter|Relation)\b", line) for line in plan.toString().splitlines() if line.strip()):
        return df
    if int(str(plan.stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= n else df.repartition(n)


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir and read back: computed once however often it is used, and safe from lost executors.

    Where the setting is missing a local folder serves, for a local master alone.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder or f'file:///tmp/textmill-{os.getuid()}'}/textmill/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{root.name}_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
