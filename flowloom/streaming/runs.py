"""Running bounded streams: everything available is processed, results go to files in a shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The local folder of a session that names none, by application.
_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset (tests), in a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            import tempfile

            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="streams-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/streams-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 64) -> DataFrame:
    """The event table as a stream of files; ``files_per_trigger`` limits what a batch takes."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        rows = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # a stream reads folders
    else:
        rows = reader.parquet(path)
    return rows.withColumn("ts", rows["ts"].cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Processes what is available and returns what the stream wrote. State is kept in RocksDB, which spills."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = work_folder(spark)
    out = f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return spark.createDataFrame([], stream.schema)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        # Under its number, so that a batch run again replaces itself.
        writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")).start().awaitTermination()
        return spark.read.schema(stream.schema).option("basePath", out).parquet(out).select(*stream.columns)
    return spark.read.schema(stream.schema).parquet(out)
