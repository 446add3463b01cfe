"""Tables kept between steps, in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder, a cluster without it is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandloom-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def shuffles_end_with_it(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back, so that later steps neither repeat its work nor depend on its lineage.

    Its numbers are packed to a small part of their size in memory, so Spark, which goes by files, would broadcast tables through
    the driver that grow with the input; joins of what is read back are asked to shuffle. The shuffle files of
    writing go at once: the table is on disk by then, and both together would be the most that a job holds."""
    path = f"{shared_folder(df.sparkSession)}/strandloom/{label}-{uuid.uuid4().hex}"
    with shuffles_end_with_it(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def _folders(*frames: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}


def _delete(spark: SparkSession, folders: set[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*frames: DataFrame) -> None:
    """Delete tables made by ``kept`` that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, _folders(df))


def drop_steps(df: DataFrame, others: list[DataFrame]) -> None:
    """Delete the tables made by ``kept`` that only ``df`` was made from: it is kept itself by now, and of what it read ``others`` stay."""
    root = shared_folder(df.sparkSession).split(":", 1)[-1]
    mine = {f for f in _folders(df) if f.rsplit("/", 1)[0].endswith(f"{root}/strandloom")}
    _delete(df.sparkSession, mine - _folders(*others))
