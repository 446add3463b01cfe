"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it: space, tab, LF, VT, FF, CR.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Name of the row number that operators add to whole tables.
ROW = "__row"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it and gets a
    temporary folder; on a cluster that would be another folder on each machine, so it is an error there."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandloom-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to a fresh shared folder, split by the column ``by`` if one is given, and read it back.

    This cuts the lineage, keeps non-deterministic columns fixed, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(c, upper, upper.lower())


def words(c: Column) -> Column:
    """Array of the runs of characters that are not ASCII white space; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def crc32_of_id(c: Column) -> Column:
    """Unsigned CRC-32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
