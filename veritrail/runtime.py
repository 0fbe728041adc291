"""Session helpers: shipping this package to executors and finding the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch. Rows here are whole documents, so the default of 10,000 would hold far more than a
#: Python worker needs at a time.
ARROW_ROWS = 1000

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors and keep Arrow batches small. Calling it again costs nothing."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="veritrail-"), f"{root.name}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, str(path.relative_to(root.parent)))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key) or 0)
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session (tests) may do without; it gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        named = tempfile.mkdtemp(prefix="veritrail-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


_written: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh Parquet table in the shared folder and read it back, which cuts its lineage.

    A lost executor costs nothing afterwards: the files are committed by Spark's writer, not held by a machine. Results
    may still read such tables; ``discard_stored`` removes them once the results have been used.
    """
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one, for ``discard_stored`` to remove."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_stored(spark: SparkSession) -> int:
    """Remove the tables that ``stored`` wrote, and what stands under ``fresh_dir``, in this application, and say how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system for a path, and the path for it."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def remove(spark: SparkSession, path: str) -> None:
    fs, of = file_system(spark, path)
    fs.delete(of, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
