"""Session, code shipping, materialisation and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast. It is checked against the real
#: row count; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000

_shipped: set[str] = set()


def get_session(app: str = "chartlake", **conf: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE on)."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map={**defaults, **conf}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that
    Python workers can import it without a shared file system."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="chartlake-")) / "chartlake.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path("chartlake") / p.relative_to(root)))
        spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def map_arrow(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` with the package shipped first."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The cluster names it in
    ``spark.checkpoint.dir``; only in local mode, where driver and executors are
    one machine, is a folder of this machine used instead."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = os.path.join(tempfile.gettempdir(), f"chartlake-{os.getpid()}")
        if not os.path.isdir(base):
            os.makedirs(base)
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
    return base


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again. Cuts
    the lineage, survives lost executors, and makes counts cheap. ``release``
    deletes the tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chartlake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> int:
    """Delete all tables that ``materialize`` wrote, and return how many: after
    the actions on the frames that were made of them."""
    n = 0
    while _written:
        spark, path = _written.pop()
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        n += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` (materialised: the count reads footers only)
    has at most ``rows`` rows; else hint a shuffled hash join, for which AQE
    splits skewed partitions."""
    return F.broadcast(df) if df.count() <= rows else df.hint("shuffle_hash")


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: hinted to be shuffled
    and sorted, else Spark broadcasts it by the size of its compressed files,
    many times less than what the driver then holds of it."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
