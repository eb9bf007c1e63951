"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import termloom
from termloom.session import shared_dir

# Largest table that may be broadcast, in bytes of its rows; checked each time.
BROADCAST_BYTES = 32 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPARK_BATCH = "10000"
BATCH_ROWS = "256"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of the cluster, deleted when the application ends."""
    home = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    # Files of a context that ends early stay until the folder is cleared.
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Workers then need no copy of it; Spark's own file server hands it out.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        home = Path(termloom.__file__).parent
        # In the driver's folder of this application, from which Spark serves it.
        package = Path(spark.sparkContext._temp_dir, "termloom_code.zip")
        with zipfile.ZipFile(package, "w") as archive:
            for source in sorted(home.rglob("*.py")):
                archive.write(source, Path(home.name, source.relative_to(home)))
        spark.sparkContext.addPyFile(str(package))
        _shipped.add(application)


def ready_workers(spark: SparkSession) -> None:
    """Send the code, and keep Arrow batches of long texts small unless a size was chosen."""
    ship_code(spark)
    if spark.conf.get(BATCH_KEY) == SPARK_BATCH:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def fits(df: DataFrame, row_bytes: int) -> bool:
    """Whether all rows of a stored table, ``row_bytes`` each, may be broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast when it is small enough, else as it is."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, count: int) -> list[str]:
    """``count`` column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    names = (f"own_{i}" for i in range(len(taken) + count))
    return [n for n in names if n not in taken][:count]
