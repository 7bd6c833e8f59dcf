"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session of one machine gets a local folder, and a cluster an error."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veldspar-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def get_json(spark: SparkSession, path: str) -> dict | None:
    """None where there is no such file."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def put_json(spark: SparkSession, path: str, value: dict, replace: bool = False) -> bool:
    """Whole or not at all: written aside, then renamed. Without `replace`, False where the file is there already."""
    fs, at = file_system(spark, path)
    _, aside = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    if replace:
        options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(aside), fs.makeQualified(at), options)
        return True
    if fs.exists(at) or not fs.rename(aside, at):
        fs.delete(aside, False)
        return False
    return True


def fingerprint(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """A table's path, bytes and time of change: another one when the table changes."""
    fs, at = file_system(spark, path)
    return path, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


def delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may be gone  # noqa: BLE001
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: written to the shared folder and read back; gone when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veldspar/{name}-{uuid.uuid4().hex}"
    atexit.register(delete_quietly, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
