"""What the corpus operators share: tables in the shared folder, worker set-up, input columns."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where a local session names none, as in tests, a fresh temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="logspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """Writes df as a table in the shared folder, in n buckets of a column, and reads it back.

    Grouping or joining it by that column sends other rows to its buckets and never moves its own.
    """
    spark = df.sparkSession
    table = f"logspark_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, column).option("path", new_path(spark, name)).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Gives this package's Python files to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_logspark_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "logspark_py.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._logspark_shipped = True


def partitions_for(spark: SparkSession, n_bytes: int, each: int = 64 << 20) -> int:
    """Enough partitions for pieces of about `each` bytes; never under the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // each))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def split_points(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 identifiers that part the table into about n even ranges; each is the greatest of its range.

    The quantile sketch is bounded by n; it works on doubles, so its bounds are then moved to identifiers that exist.
    """
    if n < 2:
        return []
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0]
    bounds = np.array(sorted(set(found or [])), dtype=np.int64)
    if not len(bounds):
        return []

    def greatest(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            piece = np.searchsorted(bounds, own, side="left")
            most = np.full(len(bounds) + 1, -(1 << 63), np.int64)
            np.maximum.at(most, piece, own)
            has = np.unique(piece)
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(most[has])], ["piece", "doc_id"])

    ends = ids.mapInArrow(greatest, "piece long, doc_id long").groupBy("piece").agg(F.max("doc_id").alias("doc_id")).collect()
    return sorted(r.doc_id for r in ends if r.piece < len(bounds))
