"""The cluster's shared folder, where tables and files go that driver and executors both read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share, as a full URI; a local one of our own where a
    local session leaves it unset. On a cluster it must be set: a folder of one machine would lose tables in silence."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{FALLBACK_DIR}"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing lazy reads any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._stored_at
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def first_lines(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """The lines at the head of a file, or of the first part of a folder, that begin with the prefix; nothing behind them is
    read. Compressed files are told by their names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(conf)
    if store.getFileStatus(place).isDirectory():
        parts = sorted(str(s.getPath()) for s in store.listStatus(place) if not s.getPath().getName().startswith(("_", ".")))
        place = jvm.org.apache.hadoop.fs.Path(parts[0])
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
    stream = store.open(place)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    out = []
    try:
        while (line := reader.readLine()) is not None and line.startswith(prefix):
            out.append(line)
    finally:
        reader.close()
    return out
