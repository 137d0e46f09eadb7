"""Where intermediate tables are written."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import SparkSession

from gridmat.matrix import BandMatrix, Matrix

_SETTING = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder the cluster names in ``spark.checkpoint.dir``, else below the session's warehouse.

    Both are resolved by Spark's file systems; nothing goes to a folder of one machine.
    """
    root = spark.conf.get(_SETTING, None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/gridmat/{label}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as tasks reach it without Spark."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def keep(m: Matrix, label: str = "matrix") -> Matrix:
    """The matrix written out as a table and read back.

    Worth it before a matrix is used several times, as an operand that is
    counted and then multiplied, or one of a chain of products: what led to it
    is computed once, and a lost executor costs no more than a read.
    """
    spark = m.df.sparkSession
    path = scratch_path(spark, label)
    m.df.write.parquet(path)
    read = spark.read.schema(m.df.schema).parquet(path)
    # Files are cut anywhere, also between the bands of a row.
    return dataclasses.replace(m, df=read, **({"adjoining": False} if isinstance(m, BandMatrix) else {}))


def discard(m: Matrix) -> int:
    """Remove the files of a kept matrix once nothing reads it any more; how many folders went.

    Only folders that ``keep`` has made below its scratch folder are touched.
    """
    spark = m.df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in m.df.inputFiles()}
    return sum(remove(spark, folder) for folder in folders)


def remove(spark: SparkSession, folder: str) -> bool:
    """Remove a folder of ``scratch_path``; any other is left alone."""
    if "/gridmat/" not in folder:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
