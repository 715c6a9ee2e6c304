"""Session helpers: the package on the workers, checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that was started without it
    (no ``--py-files``). Spark distributes the archive; once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_sharegate_shipped", None):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="sharegate-py-")) / "sharegate.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._sharegate_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder of the session. Only a local master may fall back to a
    temporary folder: on a cluster executors would not find each other's files there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sharegate-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def stored_table(df: DataFrame) -> DataFrame:
    """Rows written as Parquet beside the session's checkpoints and read back. Unlike a checkpoint, a later reader only reads the
    columns it uses, so content beside narrow columns costs those readers nothing."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size.row.check.min", "1").parquet(folder)  # a row group is cut by bytes, however large its cells
    return spark.read.schema(df.schema).parquet(folder)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path that exists is a folder, on any file system Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that rows read twice are the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
