"""Where intermediate tables go: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder as a full URI; where none is set and Spark runs in one process (tests), a folder of our own."""
    root = spark.conf.get(_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="glossa-"))
        root = "file://" + _OWN[0]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def commit(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file that is not there yet; False if another writer has already created it.

    A file that a writer left empty, as it died on the way, doesn't count and is made anew.
    """
    fs, where = _at(spark, path)
    if fs.exists(where):
        if fs.getFileStatus(where).getLen():
            return False
        fs.delete(where, False)
    try:
        out = fs.create(where, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def commits(spark: SparkSession, pattern: str) -> dict[str, str]:
    """Path and content of the files that ``commit`` has made, by a path with wildcards."""
    fs, where = _at(spark, pattern)
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
    out = {}
    for status in fs.globStatus(where) or []:
        if status.getLen():
            stream = fs.open(status.getPath())
            out[status.getPath().toString()] = read(stream, "UTF-8")
            stream.close()
    return out


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match one with wildcards."""
    fs, where = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(where) or [])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, where = _at(spark, path)
    fs.delete(where, True)
